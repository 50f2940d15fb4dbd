"""SimHash near-duplicates by covering locality-sensitive hashing.

For radius r there are 2^(r+1) - 1 tables. Bit i of a fingerprint has a fixed non-zero code m(i) of r + 1 bits; table v keeps the
bits for which m(i) and v have an odd number of ones in common. Any r bits leave a v that is orthogonal to all their codes, so
two fingerprints that differ in at most r bits agree on all that table v keeps: every such pair collides in some table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, ragged, slices, store, table, trimmed
from .components import components

#: A bucket with more fingerprints is dealt out as pairs of parts, each a task of its own.
BUCKET = 16384


def text_fingerprints(column: pa.Array, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """The 64-bit SimHash of each text, unsigned; texts without words: 0."""
    block = Block(column)
    starts, ends, first, solid = block.words()
    buf = block.buf
    if not len(starts):
        return np.zeros(block.n, np.uint64)
    keep = solid.copy()
    keep[ends[ends < len(buf)]] = True  # one space after each word
    plain = np.where(solid, buf, 32).astype(np.uint8)
    plain[(plain >= 65) & (plain <= 90)] += 32
    at = np.cumsum(keep) - 1
    data = plain[keep].tobytes()
    begin, end = at[starts], at[ends - 1] + 1
    n_words = np.diff(first)
    n = np.where(n_words >= shingle, n_words - shingle + 1, n_words > 0).astype(np.int64)
    doc = np.repeat(np.arange(block.n), n)
    word = ragged(first[:-1], n)
    last = np.minimum(word + shingle, first[1:][doc]) - 1
    counts = np.zeros((block.n, 64), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(word), 1 << 15):
        w, z, d = word[a : a + (1 << 15)], last[a : a + (1 << 15)], doc[a : a + (1 << 15)]
        h = np.fromiter((digest(data[s:e], seed) for s, e in zip(begin[w].tolist(), end[z].tolist())), np.uint64, len(w))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.diff(d, prepend=-1))
        counts[d[cut]] += np.add.reduceat(bits, cut, axis=0, dtype=np.int32)
    return np.packbits((2 * counts > n[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """`id, fp`: one row for each row of docs; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_fingerprints(part.column(1), shingle, seed).view(np.int64))], ["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(trimmed(run), f"id {source.schema['id'].dataType.simpleString()}, fp long")


def covering_masks(radius: int, bits: int = 64) -> list[int]:
    """The bits that each of the 2^(radius+1) - 1 tables keeps."""
    codes = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % codes + 1) & v).bit_count() % 2) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(fps: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the graph that links fingerprints at `radius` or fewer differing bits; never all pairs."""
    left, right = [], []
    rest = fps.view(np.uint64).copy()
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= radius
            if near.any():
                found = rest[near]
                left += [int(node)] * len(found)
                right += found.tolist()
                queue += list(found)
                rest = rest[~near]
    return left, right


def _link_buckets(radius: int, most: int):
    """Reads rows sorted by (t, key); a bucket may span batches. Yields links, or the rows of a bucket above `most`, with b null."""

    def out(t, key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(key, pa.int64()), pa.array(np.asarray(a, np.uint64).view(np.int64)), b], ["t", "key", "a", "b"])

    def solve(t, key, fp):
        cut = np.flatnonzero((np.diff(t, prepend=t[0] - 1) != 0) | (np.diff(key, prepend=key[0]) != 0) | (np.arange(len(t)) == 0))
        size = np.diff(np.append(cut, len(t)))
        two = cut[size == 2]
        near = np.bitwise_count((fp[two] ^ fp[two + 1]).view(np.uint64)) <= radius
        left, right = fp[two[near]].view(np.uint64).tolist(), fp[two[near] + 1].view(np.uint64).tolist()
        large = []
        for c, n in zip(cut[size > 2].tolist(), size[size > 2].tolist()):
            if n > most:
                large.append((c, n))
            else:
                a, b = spanning(fp[c : c + n], radius)
                left += a
                right += b
        if left:
            yield out(np.zeros(len(left), np.int32), np.zeros(len(left), np.int64), left, pa.array(np.asarray(right, np.uint64).view(np.int64)))
        for c, n in large:
            yield out(t[c : c + n], key[c : c + n], fp[c : c + n].view(np.uint64), pa.nulls(n, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, spilled = None, None  # the rows of a bucket that may go on; the bucket that has been given up as too large
        for batch in batches:
            if not batch.num_rows:
                continue
            t, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            if spilled is not None:
                same = (t == spilled[0]) & (key == spilled[1])
                if same.any():
                    yield out(t[same], key[same], fp[same].view(np.uint64), pa.nulls(int(same.sum()), pa.int64()))
                    t, key, fp = t[~same], key[~same], fp[~same]
                if len(t):
                    spilled = None
                else:
                    continue
            if held is not None:
                t, key, fp = (np.concatenate(x) for x in zip(held, (t, key, fp)))
            open_ = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if (t[0], key[0]) != (t[-1], key[-1]) else 0
            if open_:
                yield from solve(t[:open_], key[:open_], fp[:open_])
            held = t[open_:], key[open_:], fp[open_:]
            if len(held[0]) > most:
                spilled = held[0][0], held[1][0]
                yield out(held[0], held[1], held[2].view(np.uint64), pa.nulls(len(held[0]), pa.int64()))
                held = None
        if held is not None:
            yield from solve(*held)

    return run


def near_links(distinct: DataFrame, radius: int = 4, most: int = BUCKET) -> DataFrame:
    """`a, b`: links that connect exactly what the pairs of fingerprints within `radius` connect. distinct: one row a fingerprint, `fp`.

    A bucket of up to `most` fingerprints is solved in one task, which emits a spanning forest. The fingerprints of larger
    buckets are dealt into parts of about most / 2, and each pair of parts is a task: exact, and no task grows with a bucket.
    """
    tables = F.array(*[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for v, m in enumerate(covering_masks(radius))])
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    found = store(rows.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(trimmed(_link_buckets(radius, most)), "t int, key long, a long, b long"), "simhash-links")
    links, large = found.filter("b is not null").select("a", "b"), found.filter("b is null")
    if large.isEmpty():
        return links
    sizes = large.groupBy("t", "key").count().withColumn("parts", F.ceil(F.col("count") * 2 / F.lit(most)).cast("int"))
    dealt = large.join(sizes, ["t", "key"]).withColumn("i", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("t", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "a")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = spanning(pdf["a"].to_numpy(), radius)
        return pd.DataFrame({"a": np.asarray(left, np.uint64).view(np.int64), "b": np.asarray(right, np.uint64).view(np.int64)})

    return links.union(dealt.groupBy("t", "key", "lo", "hi").applyInPandas(solve, "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """`id, fp, component_id`: each row's fingerprint and the smallest id reachable by links of at most `radius` bits.

    Exact copies share a fingerprint and meet as one row before any table is built, so a hot group of copies costs nothing.
    Null and empty texts have fingerprint 0 and are linked like any other. Rows with a null id are in a component, and never
    name one unless all its ids are null. Repeated ids each get a row; an empty table gives none.
    """
    prints = store(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-prints")
    first = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    roots = components(near_links(first.select("fp"), radius))
    rooted = first.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    rooted = store(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return prints.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("id", "fp", "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without those that have a near-duplicate of smaller id; of rows that repeat an id one stays. Rows of null id stay."""
    found = store(simhash_components(docs, id_col, text_col, **options), "simhash-found")
    gone = found.filter("id != component_id").select(F.col("id").alias("__gone")).distinct()
    kept = docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
    if found.filter("id is not null").groupBy("id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter(F.col(id_col).isNotNull()).dropDuplicates([id_col]).union(kept.filter(F.col(id_col).isNull()))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
