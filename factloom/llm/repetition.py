"""Quality rules on repetition, by suffix arrays over words.

Documents of a batch are sorted together by prefix doubling, each apart from the others; ranks of every doubling give the
longest common prefix of neighbours. An LCP interval whose occurrences differ in the word before is a maximal repeated
substring. Every suffix lies in one innermost interval, whose depth is the larger LCP with its two neighbours; each other
repeat at that place is a prefix of it, and an interval that is not maximal to the left lies inside the span of one that is. So
the union of the spans of all maximal repeats of `least` words or more is the union of the innermost spans, and the longest
repeat is the largest LCP.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Block, joined, slices, table, trimmed

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def suffix_arrays(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For documents first[d]..first[d+1] of ids: positions in suffix order, document by document, and the LCP of each with the
    one before it (0 at a document's first)."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stop = first[1:][doc]
    key = doc * (int(ids.max()) + 1) + ids
    active = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    rank[active] = np.searchsorted(key[active], key[active], "left")
    levels, h = [rank.astype(np.int32)], 1
    while True:
        lead = rank[active]
        same = np.zeros(len(active), bool)
        same[1:] = lead[1:] == lead[:-1]
        same[:-1] |= same[1:]
        active = active[same]
        if not len(active):
            break
        ahead = active + h
        inside = ahead < stop[active]
        second = np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        lead = rank[active]
        pair = lead * (n + 2) + second
        order = np.argsort(pair, kind="stable")
        active, pair, lead = active[order], pair[order], lead[order]
        index = np.arange(len(active))
        new_pair, new_lead = np.ones(len(active), bool), np.ones(len(active), bool)
        new_pair[1:], new_lead[1:] = pair[1:] != pair[:-1], lead[1:] != lead[:-1]
        at = np.maximum.accumulate(np.where(new_pair, index, 0)) - np.maximum.accumulate(np.where(new_lead, index, 0))
        rank[active] = lead + at
        h *= 2
        levels.append(rank.astype(np.int32))
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(levels[0][a] == levels[0][b])
    a, b, total = a[live], b[live], np.zeros(len(live), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.flatnonzero((a < n) & (b < n))
        ok = ok[levels[k][a[ok]] == levels[k][b[ok]]]
        total[ok] += 1 << k
        a[ok] += 1 << k
        b[ok] += 1 << k
    lcp[live + 1] = total
    return order, lcp


def _covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def _per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[first])


def repetition(column: pa.Array, window: int = 8, least: int = 8) -> dict[str, np.ndarray]:
    """Counts for each text; spans of words that repeats of at least `least` words cover, and the longest repeat."""
    block = Block(column)
    starts, ends, first, solid = block.words()
    n_words = np.diff(first)
    letters = solid & ((block.buf & 0xC0) != 0x80)
    out = {"n_words": n_words, "word_chars": _per_doc(letters, block.off), "n_symbols": _per_doc(SYMBOL[block.buf], block.off)}
    ids = np.asarray(joined(block.buf, solid, starts, ends).dictionary_encode().indices).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    order, lcp = suffix_arrays(ids, first)
    depth = np.zeros(len(ids), np.int64)
    depth[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    at = np.flatnonzero(depth >= window)
    out["n_repeat_words"] = _per_doc(_covered(len(ids), at, np.full(len(at), window)), first)
    at = np.flatnonzero(depth >= least)
    out["n_covered_words"] = _per_doc(_covered(len(ids), at, depth[at]), first)
    out["longest_repeat"] = np.maximum.reduceat(np.append(depth, 0), first[:-1]) * (n_words > 0) if block.n else np.zeros(0, np.int64)
    out["n_dup_lines"] = _dup_lines(block, starts)
    return out


def _dup_lines(block: Block, starts: np.ndarray) -> np.ndarray:
    """Lines (split at \\n) with a word that equal an earlier line of their document."""
    out = np.zeros(block.n, np.int64)
    edges = np.unique(np.concatenate([block.off, np.flatnonzero(block.buf == 10) + 1]))
    begin, end = edges[:-1], edges[1:]
    if not len(begin):
        return out
    end = end - (block.buf[end - 1] == 10)
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[worded], end[worded]
    if not len(begin):
        return out
    doc = np.searchsorted(block.off, begin, "right") - 1
    keep = np.zeros(len(block.buf) + 1, np.int8)
    keep[begin] += 1
    np.add.at(keep, end, -1)
    inside = np.cumsum(keep[:-1]) > 0
    line = np.asarray(joined(block.buf, inside, begin, end).dictionary_encode().indices).astype(np.int64)
    key = doc * (line.max() + 1) + line
    _, once = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[once] = False
    np.add.at(out, doc[again], 1)
    return out


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, least: int = 5, max_covered: float = 0.3, max_repeat: int = 64) -> DataFrame:
    """One row for each row of docs: `id`, the counts of `repetition`, `repeats_failed`.

    A text fails if repeats of `least` words or more cover over `max_covered` of its words or one is longer than `max_repeat`
    words. Null and empty texts have zero counts and don't fail here. A map over the scan: nothing is shuffled, whole texts are
    used, a batch holds some MB or one document. Repeated ids each get a row.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                got = repetition(part.column(1), window, least)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(got[k], pa.int64()) for k in names)], ["id", *names])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = source.mapInArrow(trimmed(run), f"id {source.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in names))
    failed = (F.col("n_covered_words") > F.lit(max_covered) * F.col("n_words")) | (F.col("longest_repeat") > max_repeat)
    return found.withColumn("repeats_failed", failed)


def op4_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repetition_rules(table(spark, sf_dir, "documents"))
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.withColumnRenamed("id", "doc_id").withColumn("base_failed", base)
    return found.withColumn("kept", ~F.col("base_failed") & ~F.col("repeats_failed")).drop("repeats_failed")
