"""Mixing sources to target weights: repetition rates for each source, then floor(rate) copies of each document and one more by
a Bernoulli draw seeded with a hash of its id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, store, table

#: Columns that `mixed` adds.
MADE = ("mix_size", "mix_source_size", "mix_target", "mix_copies")


def word_count(text_col: str):
    """Words `[^\\x20\\x09-\\x0D]+` of the text; null: 0."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """From `src, size` rows: `src, source_size, target`. One row for each source: the sums are made before any shuffle.

    Sources by code point, null last, weigh `weights`, repeating. Targets share `share` times all sizes by weight; those
    above `cap` times their source's size stop there and the excess is shared again among the rest. In order of cap / weight
    the capped sources come first, so one pass over the sources finds the level.
    """
    sums = sized.groupBy("src").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("rank", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("cap") / F.col("weight"))
    w = Window.orderBy("ratio", "rank")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("free", F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "rank", "level"))).over(every))
    capped = F.col("free").isNull() | (F.struct("ratio", "rank") < F.struct("free.ratio", "free.rank"))
    return ranked.select("src", "source_size", F.when(capped, F.col("cap")).otherwise(F.col("free.level") * F.col("weight")).alias("target"))


def draw(id_col: str, seed: str):
    """A number in [0, 1) that the id and the seed decide: 52 bits of an MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), seed: str = "mix") -> DataFrame:
    """docs with `mix_size, mix_source_size, mix_target, mix_copies` added; columns of these names are replaced.

    Every source keeps its own rate, so a hot source needs no dealing: the source table has one row a source, Catalyst
    broadcasts it if its written size is small and joins by shuffle, split where skewed, if not. A null source is a source.
    Sources without words get no copies. Rows that repeat an id share its draw. No row is dropped here. What a source gives is its
    target on average; with f the fraction of its rate, the standard deviation is the root of f (1 - f) times the sum of its squared
    sizes, so a source of a few long documents can miss its target by tens of percent, one of many by little.
    """
    plain = docs.drop(*MADE)
    targets = store(source_targets(plain.select(F.col(source_col).alias("src"), word_count(text_col).alias("size")), share, cap, weights), "mix-targets")
    targets = targets.select(F.col("src").alias("__mix_src"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"))
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.col("mix_target") / F.col("mix_source_size"), F.lit(cap))).otherwise(0.0)
    out = plain.withColumn("mix_size", word_count(text_col)).join(targets, F.col(source_col).eqNullSafe(F.col("__mix_src"))).drop("__mix_src")
    return out.withColumn("mix_copies", (F.floor(rate) + (draw(id_col, seed) < rate - F.floor(rate)).cast("long")).cast("long"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of docs as often as it was drawn, columns as they were."""
    own = {c: fresh("__" + c, docs.columns) for c in docs.columns if c.lower() in MADE}
    out = mixed(docs.withColumnsRenamed(own), **options)
    copies = F.explode(F.expr("array_repeat(0, cast(mix_copies as int))"))
    return out.filter("mix_copies > 0").withColumn(fresh("__copy", out.columns), copies).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_copies") * F.col("mix_size")).alias("taken"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rk FROM sums),
weighted AS (
  SELECT *, CAST([3, 1, 2][CAST(rk % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, CAST(source_size AS DOUBLE) * 2.0::DOUBLE AS cap FROM ranked),
levelled AS (
  SELECT *, cap / weight AS ratio,
    (CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted),
free AS (SELECT ratio AS fratio, rk AS frk, level AS flevel FROM levelled WHERE ratio > level ORDER BY ratio, rk LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN frk IS NULL OR ratio < fratio OR (ratio = fratio AND rk < frk) THEN cap ELSE flevel * weight END AS target
  FROM levelled LEFT JOIN free ON TRUE),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM rated
"""
