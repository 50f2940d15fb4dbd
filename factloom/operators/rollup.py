"""Complexity rollups, rankings and the overall score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rollup(functions: DataFrame, file_col: str, score_col: str, second_col: str) -> DataFrame:
    """One row a file: functions, total, peak, average of both scores; averages of nothing are 0."""
    return functions.groupBy(file_col).agg(
        F.count("*").alias("functions"), F.sum(score_col).cast("long").alias("total"), F.max(score_col).alias("peak"), F.coalesce(F.avg(score_col), F.lit(0.0)).alias("average"),
        F.sum(second_col).cast("long").alias("second_total"), F.max(second_col).alias("second_peak"), F.coalesce(F.avg(second_col), F.lit(0.0)).alias("second_average"),
    )


def report_summary(functions: DataFrame, score_col: str) -> DataFrame:
    """One row for the whole report: count, total, peak, floor of the mean; zeros when empty."""
    n, total = F.count("*"), F.coalesce(F.sum(score_col), F.lit(0)).cast("long")
    return functions.agg(n.alias("functions"), total.alias("total"), F.coalesce(F.max(score_col), F.lit(0)).cast("long").alias("peak"), F.expr(f"coalesce(sum({score_col}), 0) div greatest(count(*), 1)").cast("long").alias("mean"))


def keep_top(items: DataFrame, score_col: str, minimum, top: int, *order: Column) -> DataFrame:
    """Those of at least the minimum, best first, `top` at most; `rank` from 1. A top-k: no sort of all rows."""
    order = order or (F.col(score_col).desc(),)
    best = items.filter(F.col(score_col) >= minimum).orderBy(*order).limit(top)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def rank_within(items: DataFrame, group: list[str], *order: Column, name: str = "rank", at_most: int | None = None) -> DataFrame:
    """Ranks the rows of each group; with at_most, only the best are kept, and most rows go before the shuffle."""
    ranked = items.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked if at_most is None else ranked.filter(F.col(name) <= at_most)


def overall_score(findings: DataFrame, score_milli: str) -> DataFrame:
    """100 less a hundredth of each finding's milli score, rounded down each; not below 0."""
    return findings.agg(F.expr(f"greatest(100 - coalesce(sum({score_milli} div 100), 0), 0)").cast("long").alias("score"))


def nested_report(functions: DataFrame, file_col: str, *columns: str, order: list[str]) -> DataFrame:
    """Files with an array of their functions, in the order of the named columns (they come first in each struct)."""
    return functions.groupBy(file_col).agg(F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("functions"))
