"""Findings as candidates (M4, M6, M8, M10-M17, P13, P14, D8, F2, F10, J15): one shape, fixed scores, a registry of builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The milli score of each kind of finding.
SCORES = {
    "ccgraph_clone": 750, "inconsistent_clone": 600, "mined_rule": 750, "alattin_rule": 750, "deviant_behavior": 800, "obligation": 800, "taint_flow": 900, "dependence_cluster": 650,
    "value_object": 450, "primitive_obsession": 350, "aggregate": 400, "repository": 400, "factory": 450, "specification": 450, "entity_identity": 450, "missing_identity": 400, "mutable_identity": 350,
    "anemic_model": 400, "domain_service": 350, "guard_clause": 500, "enum_dispatch": 500, "type_switch": 450, "nilerr": 800, "forcetypeassert": 700, "typednil": 750,
}
#: The kinds that a comment can suppress.
SUPPRESSIBLE = ("nilerr", "forcetypeassert", "typednil")


def candidates(kind: str, findings: DataFrame, observation: Column, group: list[str], score: Column | None = None) -> DataFrame:
    """`kind, score, observation, sites` from findings with `path, line, id, name`: one candidate for each group, its sites in order."""
    sites = F.sort_array(F.collect_list(F.struct("path", "line", "id", "name")))
    out = findings.withColumn("__o", observation).groupBy(*group).agg(sites.alias("sites"), F.min("__o").alias("observation"), *([F.max(score).alias("score")] if score is not None else []))
    return out.select(F.lit(kind).alias("kind"), (F.col("score") if score is not None else F.lit(SCORES[kind])).cast("long").alias("score"), "observation", "sites")


def located(findings: DataFrame, facts: DataFrame, id_col: str = "id") -> DataFrame:
    """Findings with the facts of their function; those of unknown functions are left out."""
    return findings.join(facts.select(id_col, "path", "line", "name"), id_col)


def static_findings(kind: str, hits: DataFrame) -> DataFrame:
    """Candidates of hits (`path, line, id, name, detail, suppressed array<string>`), one each, without suppressed ones."""
    kept = hits.filter(~F.coalesce(F.array_contains("suppressed", kind), F.lit(False))) if kind in SUPPRESSIBLE else hits
    return candidates(kind, kept, F.col("detail"), ["path", "line", "id", "detail"])


def anemic_models(functions: DataFrame, services: DataFrame, least: int = 3) -> DataFrame:
    """Types that enough functions (`id, name, path, line, type`), no services among them, read and write from outside."""
    own = functions.join(services.select("id").distinct(), "id", "left_anti")
    many = own.groupBy("type").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least).select("type")
    return candidates("anemic_model", own.join(many, "type"), F.concat(F.lit("type "), F.col("type")), ["type"])


def domain_services(functions: DataFrame, least: int = 2) -> DataFrame:
    """Functions (`id, name, path, line, type`) that work on enough types."""
    many = functions.groupBy("id").agg(F.countDistinct("type").alias("n")).filter(F.col("n") >= least).select("id")
    one = functions.join(many, "id").select("id", "name", "path", "line").distinct()
    return candidates("domain_service", one, F.concat(F.lit("function "), F.col("name")), ["id"])


def factories(hits: DataFrame, least_fields: int = 5, most_fields: int = 4, least: int = 2) -> DataFrame:
    """Types that enough functions build (`id, name, path, line, type, fields`) with a number of fields within the bounds. The
    default bounds exclude each other, so it finds nothing until they are set."""
    own = hits.filter((F.col("fields") >= least_fields) & (F.col("fields") <= most_fields))
    many = own.groupBy("type").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least).select("type")
    return candidates("factory", own.join(many, "type"), F.concat(F.lit("type "), F.col("type")), ["type"])


def specifications(hits: DataFrame, least: int = 2) -> DataFrame:
    """Rules (`id, name, path, line, type, rule`) on a type that enough functions repeat."""
    many = hits.groupBy("type", "rule").agg(F.countDistinct("id").alias("n")).filter(F.col("n") >= least).select("type", "rule")
    return candidates("specification", hits.join(many, ["type", "rule"]), F.concat_ws(" ", "rule", "type"), ["type", "rule"])


def judge_columns(values: DataFrame, facts: DataFrame, groups: DataFrame) -> DataFrame:
    """`cluster, var, verdict, key, score, mismatch` of the method-like holes of templates (`cluster, var, value`).

    A hole is a trait if its distinct values are all known functions (facts: `id, type, key, implements, effects`) of two types or
    more from one package, with one signature key among the groups (`key, score`); suppressed if all of them implement an
    interface already; else skip. An empty type is no type. mismatch: their effects differ.
    """
    own = values.select("cluster", "var", "value").distinct().join(facts, F.col("value") == F.col("id"), "left")
    kind = F.nullif(F.coalesce("type", F.lit("")), F.lit(""))
    package = F.nullif(F.when(kind.contains("."), F.regexp_replace(kind, r"\.[^.]*$", "")), F.lit(""))
    found = own.groupBy("cluster", "var").agg(
        F.bool_and(F.col("id").isNotNull()).alias("known"), F.countDistinct(kind).alias("types"), F.countDistinct(package).alias("packages"), F.bool_and(F.coalesce("implements", F.lit(False))).alias("all_implement"),
        F.min("key").alias("key"), F.max("key").alias("other"), F.countDistinct("effects").alias("effects"),
    )
    out = found.join(groups.select(F.col("key"), "score"), "key", "left")
    fit = F.col("known") & (F.col("types") >= 2) & (F.col("packages") <= 1)
    verdict = F.when(~fit, "skip").when(F.col("all_implement"), "suppressed").when((F.col("key") == F.col("other")) & F.col("score").isNotNull(), "trait").otherwise("skip")
    return out.select("cluster", "var", verdict.alias("verdict"), "key", F.when(verdict == "trait", F.col("score")).alias("score"), (F.col("effects") > 1).alias("mismatch"))


def trait_evidence(judged: DataFrame) -> DataFrame:
    """`cluster, lift, mismatch, common`: clusters with a trait among their holes; the lift is the least group score, below 500
    the signature is common."""
    t = judged.filter("verdict = 'trait'").groupBy("cluster").agg(F.min("score").alias("lift"), F.bool_or("mismatch").alias("mismatch"))
    return t.withColumn("common", F.col("lift") < 500)


def substantial(nodes: DataFrame, edges: DataFrame, guard: bool = True, least: int = 2) -> DataFrame:
    """`g`: bodies with enough calls or, with the guard, one whose data does not come from parameters alone."""
    calls = nodes.filter("kind = 'call'").select("g", "node")
    n = calls.groupBy("g").agg(F.count("*").alias("calls"))
    params = nodes.select("g", F.col("node").alias("src"), (F.col("kind") == "param").alias("param"))
    fed = edges.filter("kind = 'data'").join(calls, (edges["g"] == calls["g"]) & (edges["dst"] == calls["node"])).select(edges["g"], "src").join(params, ["g", "src"]).groupBy("g").agg(F.bool_or(~F.col("param")).alias("own"))
    out = n.join(fed, "g", "left").withColumn("own", F.coalesce("own", F.lit(False)))
    return out.filter((F.col("calls") >= least) | (F.lit(guard) & (F.col("calls") == 1) & F.col("own"))).select("g")
