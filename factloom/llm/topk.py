"""Exact top-k by no-random-access aggregation.

Each dimension is a list of a block's candidates sorted by their component; a query reads it from the top where its own component
is positive, from the bottom where negative. What it has not read of a candidate is bounded: from above by the last value read, from
below by the list's other end. So each candidate has a lower and an upper score. The k-th largest lower score, or the k-th exact
score of the blocks before if that is larger, is a threshold; whoever's upper score is below it is out. A query reads on, in lists
where its weight times the list's spread is large one step ahead of the others, until few are left or all is read; then it stops,
and the scores of those left are resolved.

A task reads its candidates block by block and keeps k rows a query. The bounds of many queries are matrix products: with t and b
the last values read from the top and the bottom, the upper scores are q+ max(x, t) + q- min(x, b).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import store, table, trimmed

#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
#: Shares of a list that are read in turn.
DEPTHS = (0.0, 1 / 16, 1 / 8, 1 / 4, 1 / 2, 5 / 8, 3 / 4, 7 / 8, 1.0)
#: Bytes of a block of queries, which is broadcast, and pairs of a query and a candidate in a task, about.
QUERY_BYTES, TASK_PAIRS = 16 << 20, 1 << 27


def usable(vector: str) -> Column:
    """A vector that is not null and holds no null and no component that isn't finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _rows(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows; a shorter one is filled with zeros, what is beyond width meets zeros only and is left out."""
    sizes = np.asarray(column.value_lengths(), dtype=np.int64)
    flat = np.asarray(column.flatten(), dtype=np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    own, use = np.repeat(np.arange(len(sizes)), sizes), place < width
    out[own[use], place[use]] = flat[use]
    return out


class Lists:
    """A block's lists, read to some depth: what the bounds are made of, kept for all queries of the block."""

    def __init__(self, x: np.ndarray):
        self.x = x.astype(np.float64)
        self.sorted = np.sort(self.x, axis=0)
        self.low, self.high = self.sorted[0], self.sorted[-1]
        self.spread = self.x.std(axis=0)
        self.known: dict[int, tuple[np.ndarray, ...]] = {}

    def at(self, step: int) -> tuple[np.ndarray, ...]:
        """At DEPTHS[step]: components as bounded from above and from below, of lists read from the top; of those read from the bottom."""
        if step not in self.known:
            n, d = len(self.x), math.ceil(len(self.x) * DEPTHS[step])
            t = self.sorted[n - d] if d else self.high
            b = self.sorted[d - 1] if d else self.low
            top, bottom = self.x >= t if d else np.zeros_like(self.x, bool), self.x <= b if d else np.zeros_like(self.x, bool)
            self.known[step] = (np.where(top, self.x, t), np.where(top, self.x, self.low), np.where(bottom, self.x, b), np.where(bottom, self.x, self.high))
        return self.known[step]


def block_top(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None, figures: dict | None = None, lists: Lists | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query among x, x sorted by id: query's row, candidate's row, score. Ties go to the smaller id.

    floor: for each query a score that k candidates of other blocks reach; who is below may be left out. figures: sums up pairs,
    pairs pruned by bounds while the query had not read all, entries of lists read, and all entries.
    """
    n, width = x.shape
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(width, 1)
    fit = bound < EXACT
    kind = np.float64 if fit else object  # sums beyond doubles: Python's integers, exact
    slack = 0.0 if fit else bound * 1e-9
    live = np.ones((len(q), n), bool)
    live[q_ids[:, None] == x_ids[None, :]] = False
    pairs = int(live.sum())
    enough = np.minimum(live.sum(axis=1), 2 * k)
    threshold = np.full(len(q), -np.inf) if floor is None else floor.astype(np.float64)
    if n and width and len(q):
        lists = lists or Lists(x)
        weight = np.abs(q) * lists.spread
        place = np.argsort(np.argsort(-weight, axis=1, kind="stable"), axis=1, kind="stable")
        pace = 3 * place // width  # 0: the third of the lists that weigh most
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)
        active = np.flatnonzero(live.any(axis=1))
        entries, read, last = (q != 0).sum(axis=1), np.zeros(len(q)), len(DEPTHS) - 1
        for step in range(1, last + 2):
            if step == last + 1:
                pruned = pairs - int(live.sum())  # the last step reads all
            if not len(active):
                break
            low, high = np.zeros((len(active), n)), np.zeros((len(active), n))
            read[active] = 0.0
            for c in range(3):
                at = min(max(step + 1 - c, 0), last)
                t_high, t_low, b_low, b_high = lists.at(at)
                mask = pace[active] == c
                u, v = up[active] * mask, down[active] * mask
                high += u @ t_high.T + v @ b_low.T
                low += u @ t_low.T + v @ b_high.T
                read[active] += (mask & (q[active] != 0)).sum(axis=1) * DEPTHS[at]
            low[~live[active]] = -np.inf
            if n > k:
                threshold[active] = np.maximum(threshold[active], np.partition(low, n - k, axis=1)[:, n - k])
            live[active] &= high >= (threshold[active] - slack)[:, None]
            active = active[live[active].sum(axis=1) > enough[active]]
            pruned = pairs - int(live.sum()) if step <= last else pruned
        if figures is not None:
            for name, more in (("pairs", pairs), ("pruned", pruned), ("read", float(read.sum()) * n), ("entries", int(entries.sum()) * n)):
                figures[name] = figures.get(name, 0) + more
    rows, cols, scores = [], [], []
    for i in range(len(q)):
        at = np.flatnonzero(live[i])
        s = x[at].astype(kind) @ q[i].astype(kind)
        best = np.argsort(-s, kind="stable")[:k]
        rows.append(np.full(len(best), i))
        cols.append(at[best])
        scores.append(np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in s[best]], np.int64))
    return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (rows, cols, scores))


class Best:
    """The k best of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.ids, self.scores = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n

    def floor(self, a: int, b: int) -> np.ndarray:
        own = (s[self.k - 1] if len(s) == self.k else -(1 << 63) for s in self.scores[a:b])
        return np.array([float(v) if v > -(1 << 63) else -np.inf for v in own])

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """rows in order."""
        cut = np.flatnonzero(np.diff(rows, prepend=-1))
        for i, a, b in zip(rows[cut].tolist(), cut.tolist(), np.append(cut[1:], len(rows)).tolist()):
            x, s = np.concatenate([self.ids[i], ids[a:b]]), np.concatenate([self.scores[i], scores[a:b]])
            keep = np.lexsort((x, ~s))[: self.k]  # ~s falls as s grows, without an overflow
            self.ids[i], self.scores[i] = x[keep], s[keep]


def scan(q: np.ndarray, q_ids: np.ndarray, blocks: Iterator[tuple[np.ndarray, np.ndarray]], k: int, figures: dict | None = None) -> Best:
    """The k best of all blocks (rows, ids) for every query."""
    best = Best(len(q), k)
    for x, x_ids in blocks:
        order = np.argsort(x_ids, kind="stable")
        x, x_ids = x[order], x_ids[order]
        lists = Lists(x) if x.size else None
        for a in range(0, len(q), 64):
            i, j, s = block_top(q[a : a + 64], q_ids[a : a + 64], x, x_ids, k, best.floor(a, a + 64), figures, lists)
            best.add(a + i, x_ids[j], s)
    return best


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024, query_bytes: int = QUERY_BYTES, candidate_block: int = 8192) -> DataFrame:
    """`query_id, rank, id, score`: for each row of queries the k rows of vectors with the largest integer inner product of
    floor(scale * component), but not the row of its own id. Fewer if there are fewer; ties to the smaller id.

    Vectors that are null or hold a null or a component that isn't finite take no part; a shorter vector counts as filled with
    zeros; an empty one scores 0. Scores beyond a long stop at its ends. Rows that repeat an id are candidates of their own, and
    neither is one for the other; repeated query ids are asked once, by their first vector.

    Queries come in blocks of about query_bytes, which are broadcast; each block is one scan of the candidates, of which none is
    copied or shuffled unless there are too few splits for the work. A task keeps k rows a query, which a window merges.
    """
    quantised = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))

    def ready(df: DataFrame) -> DataFrame:
        return df.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), quantised.alias("v"))

    spark = vectors.sparkSession
    x, asked = ready(vectors), store(ready(queries).groupBy("id").agg(F.min("v").alias("v")), "top-queries")
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n * 8 * max(width, 1) // query_bytes))
    tasks = -(-vectors.count() * -(-n // blocks) // TASK_PAIRS)
    if tasks > spark.sparkContext.defaultParallelism:
        x = x.repartition(tasks, "id", "v")
    if blocks > 1:
        x = store(x, "top-vectors")

    def against(block: int) -> DataFrame:
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow().combine_chunks()  # about query_bytes
        column = own.column("v").combine_chunks() if own.num_rows else pa.array([], pa.list_(pa.int64()))
        held = spark.sparkContext.broadcast((_rows(column, width), own.column("id").to_numpy()))
        rows = max(1, min(candidate_block, (1 << 21) // max(width, 1)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q, q_ids = held.value
            parts = (b.slice(a, rows) for b in batches for a in range(0, b.num_rows, rows))
            best = scan(q, q_ids, ((_rows(p.column(1), width), p.column(0).to_numpy()) for p in parts), k)
            for a in range(0, len(q), 4096):
                ids, scores = best.ids[a : a + 4096], best.scores[a : a + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids[a : a + 4096], [len(i) for i in ids])), pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "id", "score"])

        found = x.mapInArrow(trimmed(run), "query_id long, id long, score long")
        return found if blocks == 1 else store(found, "top-found")

    found = against(0)
    for block in range(1, blocks):
        found = found.union(against(block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op2_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0")).withColumnRenamed("id", "vec_id")


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""
