"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. A partial partition is a tuple of k sums; differencing takes the two with the largest
spread and adds one to the other in opposite order, until one is left. Groups of more than a small share of a shard, a bounded
number, are differenced first. What they make of the shards then enters the differencing of every block of the other groups as
one more partial partition, scaled by the block's share of the bytes: so each block fills the shards up to one level, its subsets
are the shards themselves, and blocks are tasks of their own. What they leave uneven is some bytes each. No text is shuffled.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table


def difference(parts: np.ndarray) -> np.ndarray:
    """parts: n partial partitions into k sums. Returns for each of them the final subset of each of its k sums.

    Ties in spread go to the earlier part, so that reruns agree.
    """
    n, k = parts.shape
    if n == 0:
        return np.zeros((0, k), np.int64)
    order = np.argsort(-parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, order, axis=1))
    heap = [(-int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    made, left, right = np.empty((max(n - 1, 0), k), np.int16), [], []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        p = np.argsort(-both, kind="stable")
        both = both[p]
        both = both - both[-1]  # only differences matter, and small numbers cannot overflow
        sums[a] = sums[b] = None
        made[len(left)] = p
        heapq.heappush(heap, (-int(both[0]), n + len(left)))
        left.append(a)
        right.append(b)
        sums.append(both)
    label = np.empty((n + len(left), k), np.int16)
    label[-1] = np.arange(k)
    for i in range(len(left) - 1, -1, -1):
        own, p = label[n + i], made[i]
        label[left[i]][p] = own
        label[right[i]][k - 1 - p] = own
    out = np.empty((n, k), np.int64)
    np.put_along_axis(out, order, label[:n].astype(np.int64), axis=1)
    return out


def _difference_block(loads: np.ndarray, rest: int):
    """loads: what the large groups put in each shard; rest: bytes of all other groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        size = pdf["bytes"].to_numpy(np.int64)
        parts = np.zeros((len(pdf) + 1, len(loads)), np.int64)
        parts[0] = np.rint(loads * (float(size.sum()) / max(rest, 1)))
        parts[1:, 0] = size
        to = difference(parts)
        shard = np.empty(len(loads), np.int32)
        shard[to[0]] = np.arange(len(loads))  # the subset that holds shard j's load is shard j
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "shard": shard[to[1:, 0]]})

    return run


def differencing_shards(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, block_groups: int = 16384, large: int = 64, chunk_rows: int = 20000) -> DataFrame:
    """Every row of docs gets a shard in 0..n_shards-1 and a gapless slot in it: `id, size, text_crc32, shard, slot`.

    size is the text's UTF-8 bytes (null: 0) plus `overhead`. Equal texts stay together; null texts are one group, apart from
    the empty text. Byte totals differ by little unless one group alone exceeds the mean, which then fills its shard alone.
    Groups of over a `large`-th of a shard's mean, n_shards x large at most, are dealt out on the driver; for over 500 shards the share
    grows, so that the driver's sums stay below n_shards^2 or 1 << 24 numbers. Repeated ids keep a slot each. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + overhead).alias("size"),
        F.coalesce(F.crc32(F.col(text_col).cast("binary")), F.lit(0)).alias("crc"),
        F.coalesce(F.unhex(F.md5(F.col(text_col).cast("binary"))), F.lit(b"")).alias("key"),
    )
    rows = store(rows, "shard-rows")
    groups = store(rows.groupBy("key").agg(F.sum("size").alias("bytes")), "shard-groups")
    n_groups, total = groups.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    large = max(1, min(large, (1 << 24) // n_shards**2))
    is_large = F.col("bytes") * F.lit(n_shards * large) > F.lit(total)
    heavy = sorted(groups.filter(is_large).collect(), key=lambda r: (-r.bytes, bytes(r.key)))
    parts = np.zeros((len(heavy), n_shards), np.int64)
    parts[:, 0] = [r.bytes for r in heavy]
    to, loads = difference(parts)[:, 0], np.zeros(n_shards, np.int64)
    np.add.at(loads, to, parts[:, 0])
    n_blocks = max(1, math.ceil(n_groups / block_groups))
    light = groups.filter(~is_large).withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks)).cast("int"))
    dealt = light.groupBy("block").applyInPandas(_difference_block(loads, int(total - loads.sum())), "key binary, shard int")
    dealt = dealt.union(spark.createDataFrame([(bytearray(r.key), int(j)) for r, j in zip(heavy, to)], "key binary, shard int"))
    by_key = store(dealt, "shard-places")
    n_rows = rows.count()
    chunks = max(1, math.ceil(n_rows / chunk_rows))
    dealt = store(rows.join(by_key, "key").select("id", "size", "crc", "shard", F.pmod(F.xxhash64("id", "crc", "size"), F.lit(chunks)).cast("int").alias("chunk")), "shard-dealt")
    counts = dealt.groupBy("shard", "chunk").count()
    before = counts.select("shard", "chunk", (F.sum("count").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("count")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "crc", "size"))
    return dealt.withColumn("rank", rank).join(before, ["shard", "chunk"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"))


def op1_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = differencing_shards(table(spark, sf_dir, "documents"), 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
