"""Baseline gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rollup import rank_within

EPSILON = 1e-9


def rule_totals(diagnostics: DataFrame, functions: int | DataFrame, rule_col: str = "rule", actual_col: str = "actual", limit_col: str = "max") -> DataFrame:
    """`rule, limit, excess, functions, per_1000`: the sum of what lies above the limit, and its rate per 1000 functions.

    A rule with two limits is an error when the result is read. functions: the number, or a table of `rule, functions`.
    """
    out = diagnostics.groupBy(F.col(rule_col).alias("rule")).agg(
        F.min(limit_col).cast("long").alias("lo"), F.max(limit_col).cast("long").alias("hi"), F.sum(F.greatest(F.col(actual_col) - F.col(limit_col), F.lit(0))).cast("long").alias("excess")
    )
    limit = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.raise_error(F.lit("a rule has two limits")).cast("long"))
    out = out.withColumn("limit", limit).drop("lo", "hi")
    out = out.withColumn("functions", F.lit(functions).cast("long")) if isinstance(functions, int) else out.join(functions, "rule")
    rate = F.when(F.col("functions") > 0, F.col("excess") * 1000.0 / F.col("functions")).otherwise(0.0)
    return out.select("rule", "limit", "excess", "functions", rate.alias("per_1000"))


def check(current: DataFrame, baseline: DataFrame, tolerance: float) -> DataFrame:
    """`rule, now, base, status` for the rules there are now: regression or improvement beyond the tolerance, else ok.

    A rule that the baseline lacks has base 0; one with another limit there is an error when the result is read.
    """
    b = baseline.select("rule", F.col("limit").alias("base_limit"), F.col("per_1000").alias("base"))
    out = current.join(b, "rule", "left").withColumn("base", F.coalesce("base", F.lit(0.0)))
    same = F.coalesce(F.col("limit") == F.col("base_limit"), F.lit(True))
    status = F.when(~same, F.raise_error(F.lit("a rule's limit has changed")).cast("string"))
    status = status.when(F.col("per_1000") > F.col("base") * (1 + tolerance) + EPSILON, "regression").when(F.col("per_1000") < F.col("base") * (1 - tolerance) - EPSILON, "improvement").otherwise("ok")
    return out.select("rule", F.col("per_1000").alias("now"), "base", status.alias("status"))


def worst_offenders(diagnostics: DataFrame, rule_col: str, *order, top: int = 5) -> DataFrame:
    """The `top` worst rows of each rule."""
    return rank_within(diagnostics, [rule_col], *order, at_most=top)
