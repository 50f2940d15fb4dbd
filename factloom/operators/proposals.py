"""Abstractions proposed for clusters of functions that differ in a few places."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import damped
from ..functions.text import candidate_score
from .candidates import judge_columns, trait_evidence


def proposals(members: DataFrame, columns: DataFrame, facts: DataFrame, groups: DataFrame, workspace: DataFrame, max_holes: int = 4) -> DataFrame:
    """`cluster, kind, score, support, lift, holes, coverage, common`: one proposal a cluster at most.

    members: `cluster, id, coverage`; columns: `cluster, var, kind, value`, a row for each member's value; facts: `id, type, key,
    implements, effects, substance, boilerplate`; groups: `key, score`; workspace: `type` of the code's own types.

    A cluster whose holes include a trait is a trait_method, with several a capability_set; the lift is the least group score. Else, if
    some type hole has own types only and all other holes call outside the code, and every member has substance and is no boilerplate,
    it is a generic_fn; else, with few enough holes and no boilerplate, it is to be parameterized; but neither if all members implement
    an interface. A cluster all of whose judged holes are suppressed is `suppressed`. Others propose nothing.
    """
    calls = F.col("kind").isin("method", "free_fn")
    judged = judge_columns(columns.filter(calls), facts, groups)
    traits = trait_evidence(judged).join(judged.filter("verdict = 'trait'").groupBy("cluster").agg(F.count("*").alias("n_traits")), "cluster")
    hidden = judged.groupBy("cluster").agg(F.bool_and(F.col("verdict") == "suppressed").alias("hidden"))
    known = columns.join(facts.select(F.col("id").alias("value"), F.lit(True).alias("inside")), "value", "left").join(workspace.select(F.col("type").alias("value"), F.lit(True).alias("own")), "value", "left")
    holes = known.groupBy("cluster", "var", "kind").agg(F.bool_and(F.coalesce("own", F.lit(False))).alias("own"), F.bool_or(F.coalesce("inside", F.lit(False))).alias("inside"))
    holes = holes.groupBy("cluster").agg(F.count("*").alias("holes"), F.bool_or((F.col("kind") == "type") & F.col("own")).alias("own_type"), F.bool_and((F.col("kind") == "type") | (calls & ~F.col("inside"))).alias("outside"))
    sites = members.join(facts.select("id", "implements", "substance", "boilerplate"), "id").groupBy("cluster").agg(
        F.count("*").alias("support"), F.expr("sum(coverage) div count(coverage)").alias("coverage"), F.bool_and(F.coalesce("implements", F.lit(False))).alias("forced"), F.bool_and(F.coalesce("substance", F.lit(False))).alias("substance"), F.bool_or(F.coalesce("boilerplate", F.lit(False))).alias("boilerplate")
    )
    out = sites.join(holes, "cluster", "left").fillna(0, ["holes"]).join(traits, "cluster", "left").join(hidden, "cluster", "left")
    generic = ~F.col("forced") & F.col("substance") & ~F.col("boilerplate") & F.coalesce(F.col("own_type") & F.col("outside"), F.lit(False))
    spare = ~F.col("forced") & ~F.col("boilerplate") & (F.col("holes") <= max_holes)
    kind = F.when(F.col("n_traits") == 1, "trait_method").when(F.col("n_traits") > 1, "capability_set").when(F.coalesce("hidden", F.lit(False)), "suppressed").when(generic, "generic_fn").when(spare, "parameterize")
    out = out.withColumn("kind", kind).filter("kind is not null").withColumn("lift", F.coalesce("lift", F.lit(0)))
    score = candidate_score(F.col("support"), F.col("lift"), F.col("coverage"), F.col("holes"), F.coalesce("mismatch", F.lit(False)))
    return out.select("cluster", "kind", F.when(F.col("kind") == "suppressed", 0).otherwise(damped(score, F.col("kind"))).cast("long").alias("score"), "support", "lift", "holes", "coverage", F.coalesce("common", F.lit(False)).alias("common"))
