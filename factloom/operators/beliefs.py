"""Beliefs and the sites that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beliefs(sites: DataFrame, callee_col: str, checked_col: str, least: int = 5, fraction: float = 0.9) -> DataFrame:
    """`callee, sites, checked, fraction`: callees with enough sites of which enough are checked."""
    out = sites.groupBy(F.col(callee_col).alias("callee")).agg(F.count("*").alias("sites"), F.count_if(F.col(checked_col)).alias("checked"))
    return out.withColumn("fraction", F.col("checked") / F.col("sites")).filter((F.col("sites") >= least) & (F.col("fraction") >= fraction))


def belief_violations(sites: DataFrame, callee_col: str, checked_col: str, least: int = 5, fraction: float = 0.9) -> DataFrame:
    """The unchecked sites of callees that are believed to need a check, with the belief."""
    held = beliefs(sites, callee_col, checked_col, least, fraction).withColumnRenamed("callee", "__believed")
    return sites.filter(~F.col(checked_col)).join(held, F.col(callee_col) == F.col("__believed")).drop("__believed")
