"""Association rules and their violations, single, double and disjunctive."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoint import cut

#: Up to how many items baskets are counted as bits; baskets of a task, about, and of a block at most.
DENSE, DEALT, BLOCK = 1024, 32_768, 65_536
#: Up to how many triples are named to every task.
NAMED = 1 << 18


def call_sets(baskets: DataFrame, id_col: str, item_col: str) -> DataFrame:
    """Distinct `id, item`; empty and null items don't count, and baskets without any are left out."""
    return baskets.select(F.col(id_col).alias("id"), F.col(item_col).alias("item")).filter("item is not null and item <> ''").distinct()


def array_sets(rows: DataFrame, id_col: str, items: Column) -> DataFrame:
    """call_sets of rows that hold arrays of items. Rows whose id no other row has are distinct by themselves and not shuffled."""
    own = rows.select(F.col(id_col).alias("id"), items.alias("items"))
    several = cut(own.filter("id is not null").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    once = own.filter("id is not null").join(several, "id", "left_anti").select("id", F.explode(F.array_distinct("items")).alias("item")).filter("item is not null and item <> ''")
    again = own.join(several, "id", "left_semi").union(own.filter("id is null"))
    return once.union(call_sets(again.select("id", F.explode("items").alias("item")), "id", "item"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    """A row of bits for each of width items: which baskets have it, for blocks of baskets (column 0: arrays of items' numbers)."""
    has, at = np.zeros((width, BLOCK), bool), 0
    for batch in batches:
        codes = batch.column(0)
        sizes, items = np.diff(np.asarray(codes.offsets)), np.asarray(codes.flatten())
        ends, done = np.cumsum(sizes), 0
        while done < len(sizes):
            upto = min(len(sizes), done + BLOCK - at)
            first = ends[done - 1] if done else 0
            has[items[first : ends[upto - 1]], at + np.repeat(np.arange(upto - done), sizes[done:upto])] = True
            at, done = at + upto - done, upto
            if at == BLOCK:
                yield np.packbits(has, axis=1).view(np.uint64)
                has[:], at = False, 0
    if at:
        yield np.packbits(has[:, : -(-at // 64) * 64], axis=1).view(np.uint64)


class Baskets:
    """Frequent items of distinct baskets. Counts are partial sums before each shuffle; only frequent items make pairs.

    Up to DENSE items, blocks of baskets are counted as bits, a row for each item: a task gives its sums, not a row for each basket and
    pair, so work grows with the baskets and with no square of their sizes. Beyond that, baskets are joined.
    """

    def __init__(self, sets: DataFrame, support: float = 0.1, confidence: float = 0.9):
        self.sets, self.support, self.confidence = cut(sets), support, confidence
        self.n = self.sets.agg(F.count_distinct("id")).first()[0]
        self.least = max(1, math.ceil(support * self.n))
        self.df = cut(self.sets.groupBy("item").agg(F.count("*").alias("df")))
        self.often = cut(self.df.filter(F.col("df") >= self.least))
        self.names, self._half, self._frequent = self.listed(self.often), None, None

    @staticmethod
    def listed(items: DataFrame) -> list | None:
        """The items in order, if there are no more than DENSE."""
        names = [r.item for r in items.select("item").orderBy("item").limit(DENSE + 1).collect()]
        return names if len(names) <= DENSE else None

    @property
    def frequent(self) -> DataFrame:
        """`id, item, df`: frequent items."""
        if self._frequent is None:
            self._frequent = cut(self.sets.join(self.often, "item").select("id", "item", "df"))
        return self._frequent

    def numbered(self, names: list) -> DataFrame:
        return self.sets.sparkSession.createDataFrame(list(enumerate(names)), self.sets.select(F.lit(0).alias("i"), "item").schema)

    def counted(self, names: list, solve: Callable[[np.ndarray], Iterator[tuple]], columns: list[str]) -> DataFrame:
        """columns (items) and n, the sums of what solve gives for the bits of each block: arrays of numbers of names, and counts."""
        width, code = len(names), self.numbered(names)
        types = pa.schema([(c, pa.int32()) for c in columns] + [("n", pa.int64())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bits in _blocks(batches, width):
                for found in solve(bits):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, types.types)], schema=types)

        rows = self.sets.filter("id is not null").join(F.broadcast(code), "item").select("id", "i").repartition(max(1, -(-self.n // DEALT)), "id")
        made = rows.groupBy("id").agg(F.collect_list("i").alias("codes")).select("codes").mapInArrow(run, ", ".join(f"{c} int" for c in columns) + ", n long")
        out = made.groupBy(*columns).agg(F.sum("n").alias("n"))
        for c in columns:
            out = out.withColumnRenamed(c, "i").join(F.broadcast(code), "i").drop("i").withColumnRenamed("item", c)
        return out.select(*columns, "n")

    def pair_counts(self, names: list) -> DataFrame:
        """`a, b, n`: baskets with both, a < b."""

        def solve(bits: np.ndarray) -> Iterator[tuple]:
            for a in range(len(bits) - 1):
                n = np.bitwise_count(bits[a] & bits[a + 1 :]).sum(axis=1, dtype=np.int64)
                b = np.flatnonzero(n)
                if len(b):
                    yield np.full(len(b), a), b + a + 1, n[b]

        return self.counted(names, solve, ["a", "b"])

    def half(self) -> DataFrame:
        """`a, b, n`: baskets with both, a < b, both frequent."""
        if self._half is None:
            if self.names is not None:
                half = self.pair_counts(self.names)
            else:
                a, b = self.frequent.select("id", F.col("item").alias("a")), self.frequent.select("id", F.col("item").alias("b"))
                half = a.join(b, "id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
            self._half = cut(half)
        return self._half

    def pairs(self) -> DataFrame:
        """`a, b, n`: baskets with both, a <> b, both frequent."""
        return self.half().union(self.half().select("b", "a", "n"))

    def single(self) -> DataFrame:
        """`a, b, n, df_a`: rules A -> B of enough support and confidence."""
        df = self.df.select(F.col("item").alias("a"), F.col("df").alias("df_a"))
        return self.pairs().join(df, "a").filter((F.col("n") / self.n >= self.support) & (F.col("n") / F.col("df_a") >= self.confidence))

    def double(self) -> DataFrame:
        """`a, b, c, n, n_ab`: rules {A, B} -> C with a < b < c, over frequent items.

        As bits, only triples are counted for which the least count of their pairs would be enough: none of the others can be a rule.
        """
        if self.names is not None:
            n_ab = self.half().select("a", "b", F.col("n").alias("n_ab")).filter(F.col("n_ab") >= self.least)
            n = self.counted(self.names, self._triples(n_ab), ["a", "b", "c"])
            return n.join(F.broadcast(n_ab), ["a", "b"]).filter((F.col("n") / self.n >= self.support) & (F.col("n") / F.col("n_ab") >= self.confidence))
        x = self.frequent.select("id", "item")
        ab = x.select("id", F.col("item").alias("a")).join(x.select("id", F.col("item").alias("b")), "id").filter("a < b")
        n_ab = cut(ab.groupBy("a", "b").agg(F.count("*").alias("n_ab")).filter(F.col("n_ab") >= self.least))
        abc = ab.join(n_ab.select("a", "b"), ["a", "b"]).join(x.select("id", F.col("item").alias("c")), "id").filter("b < c")
        n = abc.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
        return n.join(n_ab, ["a", "b"]).filter((F.col("n") / self.n >= self.support) & (F.col("n") / F.col("n_ab") >= self.confidence))

    def _triples(self, n_ab: DataFrame) -> Callable[[np.ndarray], Iterator[tuple]]:
        place, size, every, support, confidence = {x: i for i, x in enumerate(self.names)}, len(self.names), self.n, self.support, self.confidence
        known = np.zeros((size, size), np.int64)
        for r in n_ab.collect():
            known[place[r.a], place[r.b]] = known[place[r.b], place[r.a]] = r.n_ab

        def solve(bits: np.ndarray) -> Iterator[tuple]:
            for a in range(size):
                later = np.flatnonzero(known[a, a + 1 :]) + a + 1
                most = np.minimum(known[a], known[later])
                could = (most / every >= support) & (most / known[a, later][:, None] >= confidence) & (np.arange(size) > later[:, None])
                found = []
                for b, which in zip(later.tolist(), could):
                    c = np.flatnonzero(which)
                    if len(c):
                        found.append((np.full(len(c), b), c, np.bitwise_count(bits[a] & bits[b] & bits[c]).sum(axis=1, dtype=np.int64)))
                if found:
                    b, c, n = (np.concatenate(x) for x in zip(*found))
                    yield np.full(len(b), a), b, c, n

        return solve

    def disjunctive(self) -> DataFrame:
        """`a, b, c, n, df_a`: A -> B or C, A frequent, b < c any items, where neither A -> B nor A -> C is a rule; n counts baskets
        with A and B or C: |AB or AC| = |AB| + |AC| - |ABC|.

        An item that isn't frequent is never a consequent by itself, but may be an alternative. It only can if it makes up what A's
        best other alternative lacks, so only items with as many baskets meet the frequent ones; no alternative is lost by that.
        """
        df = self.df.select(F.col("item").alias("a"), F.col("df").alias("df_a"))
        rule = (F.col("n") / self.n >= self.support) & (F.col("n") / F.col("df_a") >= self.confidence)
        open_ = cut(self.pairs().join(df, "a").filter(~rule))
        least = F.ceil(F.col("df_a") * self.confidence - 1e-9)
        best = open_.groupBy("a").agg(F.max("n").alias("best"))
        lack = cut(df.filter(F.col("df_a") >= self.least).join(best, "a", "left").withColumn("lack", F.greatest(least - F.greatest(F.coalesce("best", F.lit(0)), F.lit(self.least - 1)), F.lit(1))).select("a", "df_a", "lack"))
        fewest = lack.agg(F.min("lack")).first()[0]
        rare = self.df.filter((F.col("df") < self.least) & (F.col("df") >= F.lit(fewest))).select(F.col("item").alias("b"), F.col("df").alias("df_b"))
        names = self.names and self.listed(self.often.select("item").union(rare.select("b")))
        if names:
            half = cut(self.pair_counts(names))
            met = half.union(half.select("b", "a", "n")).join(lack, "a").join(rare, "b").filter("df_b >= lack and n >= lack")
        else:
            with_a = self.frequent.select("id", F.col("item").alias("a")).join(lack, "a")
            met = with_a.join(self.sets.withColumnRenamed("item", "b").join(rare, "b"), "id").filter("df_b >= lack").groupBy("a", "b", "df_a", "lack").agg(F.count("*").alias("n")).filter("n >= lack")
        open_ = cut(open_.select("a", "b", "n", "df_a").union(met.select("a", "b", "n", "df_a")))
        b, c = open_.withColumnRenamed("n", "n_b"), open_.select("a", F.col("b").alias("c"), F.col("n").alias("n_c"))
        could = b.join(c, "a").filter("b < c").filter(F.col("n_b") + F.col("n_c") >= least)
        could = cut(could.withColumn("few", F.when(F.col("n_b") <= F.col("n_c"), F.col("b")).otherwise(F.col("c"))).withColumn("many", F.when(F.col("n_b") <= F.col("n_c"), F.col("c")).otherwise(F.col("b"))))
        n_abc = self._all_three(could)
        out = could.join(n_abc, ["a", "b", "c"], "left").withColumn("n", F.col("n_b") + F.col("n_c") - F.coalesce("n_abc", F.lit(0)))
        return out.filter((F.col("n") / self.n >= self.support) & (F.col("n") / F.col("df_a") >= self.confidence)).select("a", "b", "c", "n", "df_a")

    def _all_three(self, could: DataFrame) -> DataFrame:
        """`a, b, c, n_abc`: baskets with all three of each row (`a, b, c`, of b and c the one `few` have and the one `many` have)."""
        names = self.names and could.count() <= NAMED and self.listed(could.select(F.explode(F.array("a", "b", "c")).alias("item")).distinct())
        if names:
            place = {x: i for i, x in enumerate(names)}
            triples = np.array([[place[x] for x in r] for r in could.select("a", "b", "c").collect()], np.int32)

            def solve(bits: np.ndarray) -> Iterator[tuple]:
                for part in np.array_split(triples, -(-len(triples) // 1024)):
                    a, b, c = part.T
                    yield a, b, c, np.bitwise_count(bits[a] & bits[b] & bits[c]).sum(axis=1, dtype=np.int64)

            return self.counted(names, solve, ["a", "b", "c"]).withColumnRenamed("n", "n_abc")
        used = could.select(F.explode(F.array("few", "many")).alias("item")).distinct()
        x = cut(self.sets.join(used, "item").select("id", "item"))
        has_few = self.frequent.select("id", F.col("item").alias("a")).join(could.select("a").distinct(), "a").join(x.withColumnRenamed("item", "few"), "id")
        all_three = has_few.join(could.select("a", "few", "many", "b", "c"), ["a", "few"]).join(x.withColumnRenamed("item", "many"), ["id", "many"])
        return all_three.groupBy("a", "b", "c").agg(F.count("*").alias("n_abc"))


def violations(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """`id, a, b`: baskets with A that lack B."""
    has = sets.join(rules.select("a", "b"), F.col("item") == F.col("a")).select("id", "a", "b")
    return has.join(sets.select("id", F.col("item").alias("b")), ["id", "b"], "left_anti").select("id", "a", "b")


def double_violations(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """`id, a, b, c`: baskets with A and B that lack C."""
    has = sets.withColumnRenamed("item", "a").join(rules.select("a", "b", "c"), "a").join(sets.withColumnRenamed("item", "b"), ["id", "b"])
    return has.join(sets.select("id", F.col("item").alias("c")), ["id", "c"], "left_anti").select("id", "a", "b", "c")


def disjunctive_violations(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """`id, a, b, c`: baskets with A that have neither B nor C."""
    has = sets.withColumnRenamed("item", "a").join(rules.select("a", "b", "c"), "a")
    no_b = has.join(sets.select("id", F.col("item").alias("b")), ["id", "b"], "left_anti")
    return no_b.join(sets.select("id", F.col("item").alias("c")), ["id", "c"], "left_anti").select("id", "a", "b", "c")
