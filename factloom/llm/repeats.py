"""Suffix-array removal of strings that occur earlier.

Every window of `window` bytes is assigned to the k-gram in it with the least hash (the first of equals), so equal windows, wherever
they stand, are assigned to equal k-grams at equal offsets. A run of windows with one such anchor is a context: one in about 40 bytes
of text. Only contexts whose k-gram is the anchor of another can hold a repeat: this selects candidates, and nothing else is decided
by a hash. Within some texts of a scan they get a suffix array at once; contexts all of whose windows it has earlier go no further.
The bytes of the others are fetched, dealt out by k-gram, and go to a logarithmic index family: each new batch, in document order,
gets a suffix array of its windows, is merge-scanned against the suffix arrays of the levels there are, and levels of equal size
merge geometrically. Windows that a level or the batch has already are repeats.

A k-gram in very many contexts is dealt out twice: first in parts of a bounded number, where what is not the part's first is found;
what is left, one window for each part at most, is dealt out by the windows' bytes. So no task grows with it.

`without_repeats` indexes one table. `SuffixIndex` keeps the levels in a shared folder, so that later batches meet them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Block, ragged, slices, store, table, trimmed

WINDOW = 100
GRAM = 24
#: Contexts of one k-gram above which it is dealt out twice, and of each part then.
HOT = 4096
#: Contexts of a shard, about, and of a batch in it.
SHARD, BATCH = 12_000, 6_000
_MASK = np.uint64((1 << 24) - 1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _constants(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = 0x9E3779B97F4A7C15
    powers, inverse = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return values, powers, inverse


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def contexts(buf: np.ndarray, off: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The contexts of the documents off[d]..off[d+1] of buf (under 16 MB): doc, m (place of the k-gram in the document), lo and hi
    (m minus the first and the last window's start), h (40 bits of the k-gram's hash)."""
    n = len(buf)
    out = {k: np.zeros(0, np.int64) for k in ("doc", "m", "lo", "hi", "h")}
    if n < window:
        return out
    values, powers, inverse = _constants(1 << max(20, (n + 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[buf] * powers[:n], out=total[1:])
    g = n - gram + 1
    key = _mix((total[gram:] - total[:g]) * inverse[:g])
    w = window - gram + 1
    packed = (key & ~_MASK) | np.arange(g, dtype=np.uint64)
    padded = np.full(-(-g // w) * w, np.uint64(2**64 - 1))
    padded[:g] = packed
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    nw = n - window + 1
    least = np.minimum(behind[:nw], ahead[w - 1 : w - 1 + nw])
    room = np.repeat(off[1:], np.diff(off))[:nw] - np.arange(nw)
    s = np.flatnonzero(room >= window)
    if not len(s):
        return out
    at = (least[s] & _MASK).astype(np.int64)
    new = np.ones(len(s), bool)
    new[1:] = (at[1:] != at[:-1]) | (s[1:] != s[:-1] + 1)
    first = np.flatnonzero(new)
    a, b, m = s[first], s[np.append(first[1:], len(s)) - 1], at[first]
    doc = np.searchsorted(off, a, "right") - 1
    return {"doc": doc, "m": m - off[doc], "lo": m - a, "hi": m - b, "h": (key[m] >> np.uint64(24)).astype(np.int64)}


def merged_spans(doc: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one."""
    if not len(doc):
        return doc, s, e
    order = np.lexsort((s, doc))
    doc, s, e = doc[order], s[order], e[order]
    group = np.cumsum(np.diff(doc, prepend=doc[0]) != 0)
    big = int(e.max()) + 1
    top = np.maximum.accumulate(group * big + e)
    new = np.ones(len(doc), bool)
    new[1:] = group[1:] * big + s[1:] > top[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], s[first], top[last] - group[last] * big


def _pack(m, lo, hi):
    return (m << 14) | (lo << 7) | hi


def _unpack(p):
    return p >> 14, (p >> 7) & 127, p & 127


#: What a task of the family gives: spans (kind 0: batch, id, s, e), windows that are the first of their part (kind 1: batch, id, s,
#: buf), levels (kind 2: shard, s and e their first and last number, buf, sa).
_MADE = "kind int, shard int, batch int, id long, s long, e long, buf binary, sa binary"
#: What it reads, sorted by the first five: levels (kind 0: id and at their first and last number) and pieces (kind 1) of n windows.
_PIECES = "shard int, kind int, batch int, id long, at long, n int, buf binary, sa binary"


def _made(kind: int, shard: int, batch, ids, s, e, buf=None, sa=None) -> pa.RecordBatch:
    n = len(ids)
    none = pa.nulls(n, pa.binary())
    ints = [pa.array(np.full(n, x, np.int32)) for x in (kind, shard)] + [pa.array(np.asarray(batch, np.int32))]
    return pa.RecordBatch.from_arrays([*ints, *(pa.array(np.asarray(x, np.int64)) for x in (ids, s, e)), none if buf is None else buf, none if sa is None else sa], ["kind", "shard", "batch", "id", "s", "e", "buf", "sa"])


def _binary(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """buf[start[i] : start[i] + size[i]] for all i."""
    off = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[ragged(start, size)]))])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one run, and where each value begins (n + 1 long)."""
    column = column.cast(pa.binary())
    off = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


def suffix_array(buf: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows at starts in their order: their keys, their places in starts (of equal ones the first first), and which equal the
    one before."""
    keys = window_keys(buf, starts, window)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    return keys, order, again


#: Contexts of some texts: h, id, p; and spans: h is -1, p the start, e the end.
_ANCHORS = "h long, id long, p long, e long"


def _anchors(window: int, gram: int, piece: int = 1 << 19):
    """Contexts of whole texts, without those whose windows all occur earlier in the same part of some texts; spans for these."""

    def rows(h, ids, p, e) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (h, ids, p)] + [e], ["h", "id", "p", "e"])

    def part_of(ids: np.ndarray, buf: np.ndarray, off: np.ndarray, before: np.ndarray):
        """before: where in its document each text begins, for a text in pieces."""
        x = contexts(buf, off, window, gram)
        doc, n = x["doc"], x["lo"] - x["hi"] + 1
        _, kind, count = np.unique(x["h"], return_inverse=True, return_counts=True)
        met = np.flatnonzero(count[kind] > 1)
        keep = np.ones(len(doc), bool)
        if len(met):
            met = met[np.lexsort((x["m"][met], ids[doc[met]]))]
            first = x["m"][met] - x["lo"][met]
            starts, own = ragged(off[doc[met]] + first, n[met]), np.repeat(np.arange(len(met)), n[met])
            _, order, again = suffix_array(buf, starts, window)
            gone = order[again]
            keep[met] = np.bincount(own[order[~again]], minlength=len(met)) > 0
            d = doc[met][own[gone]]
            d, s, e = merged_spans(d, starts[gone] - off[d] + before[d], starts[gone] - off[d] + before[d] + window)
            yield rows(np.full(len(d), -1), ids[d], s, pa.array(e.astype(np.int64)))
        p = _pack(x["m"] + before[doc], x["lo"], x["hi"])[keep]
        yield rows(x["h"][keep], ids[doc[keep]], p, pa.nulls(len(p), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", piece):
                ids, block = np.asarray(part.column(0)), Block(part.column(1))
                for at in range(0, max(1, len(block.buf) - window + 1), 2 * piece):  # only one very long document takes several turns
                    buf = block.buf[at : at + 2 * piece + window - 1]
                    yield from part_of(ids, buf, np.clip(block.off - at, 0, len(buf)), np.maximum(at - block.off[:-1], 0))

    return run


def _met(hot: int):
    """Reads anchors sorted by h. Gives spans as they are (part -1), and contexts whose k-gram has another: part 0, or, if it has over
    `hot`, 1 for the first `hot` of them, 2 for the next, and so on. Holds `hot` rows of a k-gram between batches."""

    def rows(h, ids, p, e, part) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (h, ids, p)] + [e, pa.array(np.asarray(part, np.int32))], ["h", "id", "p", "e", "part"])

    def groups(h, ids, p, seen: int) -> pa.RecordBatch:
        """Whole k-grams, but for the first, of which `seen` contexts have been given before, and the last, if it is hot."""
        first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(first, len(h)))
        own = np.repeat(np.arange(len(first)), size)
        ordinal, is_hot = np.arange(len(h)) - first[own], size > hot
        ordinal[own == 0] += seen
        is_hot[0] |= seen > 0
        keep = is_hot[own] | (size[own] > 1)
        return rows(h[keep], ids[keep], p[keep], pa.nulls(int(keep.sum()), pa.int64()), np.where(is_hot[own], 1 + ordinal // hot, 0)[keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, current, seen = None, None, 0
        for batch in batches:
            h, ids, p = (np.asarray(batch.column(k)) for k in range(3))
            span = h < 0
            if span.any():
                yield rows(h[span], ids[span], p[span], batch.column(3).filter(pa.array(span)), np.full(int(span.sum()), -1))
                h, ids, p = h[~span], ids[~span], p[~span]
            if not len(h):
                continue
            if held is not None:
                h, ids, p = (np.concatenate(x) for x in zip(held, (h, ids, p)))
            seen = seen if h[0] == current else 0
            last = int(np.searchsorted(h, h[-1]))
            if last:
                yield groups(h[:last], ids[:last], p[:last], seen)
                seen = 0
            h, ids, p = h[last:], ids[last:], p[last:]
            if seen or len(h) > hot:
                yield groups(h, ids, p, seen)
                held, current, seen = None, h[0], seen + len(h)
            else:
                held = h, ids, p
        if held is not None:
            yield groups(*held, 0)

    return run




def _fetch(window: int, most: int = 4 << 20):
    """From documents `batch, id, text, asked` to the pieces asked of them; `most` bytes of pieces at once, about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", most):
                block, asked = Block(part.column(2)), part.column(3)
                doc = np.repeat(np.arange(block.n), np.asarray(asked.value_lengths()))
                p, shard = (np.asarray(asked.flatten().field(k)) for k in ("p", "shard"))
                m, lo, hi = _unpack(p)
                n, start = lo - hi + 1, block.off[doc] + m - lo
                upto = np.cumsum(n + window - 1)
                at = 0
                while at < len(n):
                    end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
                    x = slice(at, end)
                    rows = pa.array(doc[x])
                    yield pa.RecordBatch.from_arrays([pa.array(shard[x]), pa.array(np.ones(end - at, np.int32)), part.column(0).take(rows), part.column(1).take(rows), pa.array((m - lo)[x]), pa.array(n[x].astype(np.int32)), _binary(block.buf, start[x], n[x] + window - 1), pa.nulls(end - at, pa.binary())], ["shard", "kind", "batch", "id", "at", "n", "buf", "sa"])
                    at = end

    return run


def window_keys(buf: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """The windows at these places, comparable; with a last byte, for numpy drops zeros at the end."""
    keys = np.ones((len(at), window + 1), np.uint8)
    if len(at):
        keys[:, :-1] = np.lib.stride_tricks.sliding_window_view(buf, window)[at]
    return keys.view(f"S{window + 1}").ravel()


def merge_scan(level: np.ndarray, batch: np.ndarray) -> np.ndarray:
    """Which of the batch's keys the level has; both sorted and distinct. A stable sort of two runs is their merge."""
    order, n = np.argsort(np.concatenate([level, batch]), kind="stable"), len(level)
    at = np.flatnonzero(order >= n)
    at = at[at > 0]
    at = at[order[at - 1] < n]  # only what comes right after one of the level can equal it
    own = order[at] - n
    out = np.zeros(len(batch), bool)
    out[own] = level[order[at - 1]] == batch[own]
    return out


@dataclass
class Level:
    """A suffix array cut at the window: places of distinct windows in buf, in their order; of batches first to last."""

    buf: np.ndarray
    sa: np.ndarray
    first: int
    last: int
    stored: bool = False
    keys: np.ndarray | None = field(default=None, repr=False)


class SuffixLevels:
    """The index family: each level is over twice the next."""

    def __init__(self, window: int = WINDOW):
        self.window, self.levels, self.next = window, [], 0

    def load(self, buf: np.ndarray, sa: np.ndarray, first: int, last: int) -> None:
        """A stored level, the older ones first."""
        self.levels.append(Level(buf, sa, first, last, True))
        self.next = max(self.next, last + 1)

    def _keys(self, level: Level) -> np.ndarray:
        if level.keys is None:
            level.keys = window_keys(level.buf, level.sa, self.window)
        return level.keys

    def add(self, buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Indexes the windows at starts, in order; which of them occur earlier, in the levels or in this batch."""
        keys, order, again = suffix_array(buf, starts, self.window)
        first = np.flatnonzero(~again)
        own, known = keys[first], np.zeros(len(first), bool)
        for level in self.levels:
            known |= merge_scan(self._keys(level), own)
        again[first[known]] = True
        if not known.all():
            self.levels.append(self._level(buf, starts[order[first[~known]]], own[~known]))
        while len(self.levels) > 1 and len(self.levels[-2].sa) <= 2 * len(self.levels[-1].sa):
            b, a = self.levels.pop(), self.levels.pop()
            both = np.concatenate([self._keys(a), self._keys(b)])
            merged = np.argsort(both, kind="stable")
            sa = np.concatenate([a.sa, b.sa + len(a.buf)])[merged]
            self.levels.append(Level(np.concatenate([a.buf, b.buf]), sa, a.first, b.last, keys=both[merged]))
        out = np.empty(len(keys), bool)
        out[order] = again
        return out

    def _level(self, buf: np.ndarray, sa: np.ndarray, keys: np.ndarray) -> Level:
        """A level of one batch; bytes that no window covers are left out."""
        cover = np.zeros(len(buf) + 1, np.int32)
        cover[sa] += 1  # places are distinct
        cover[sa + self.window] -= 1
        keep = np.cumsum(cover[:-1]) > 0
        self.next += 1
        return Level(buf[keep], (np.cumsum(keep) - 1)[sa], self.next - 1, self.next - 1, keys=keys)


def _match(window: int, batch_rows: int, parts_from: int, keep: bool):
    """Reads rows of _PIECES: a family for each shard, which begins with its stored levels; batches in document order. Shards from
    parts_from on are parts of hot k-grams: they also give the windows that they have first. With keep, new levels are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, current, held, rows = SuffixLevels(window), None, [], 0

        def work():
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            came, ids, at, n = (np.asarray(part.column(k)).astype(np.int64) for k in ("batch", "id", "at", "n"))
            buf, off = _flat(part.column("buf"))
            doc = np.cumsum((np.diff(ids, prepend=ids[0]) != 0) | (np.diff(came, prepend=came[0]) != 0))
            lead = np.searchsorted(doc, np.arange(doc[-1] + 1))
            starts, own, s = ragged(off[:-1], n), np.repeat(doc, n), ragged(at, n)
            again = family.add(buf, starts)
            gone, a, e = merged_spans(own[again], s[again], s[again] + window)
            yield _made(0, current, came[lead][gone], ids[lead][gone], a, e)
            if current >= parts_from:
                left = np.flatnonzero(~again)
                for k in range(0, len(left), 20_000):
                    x = left[k : k + 20_000]
                    yield _made(1, current, came[lead][own[x]], ids[lead][own[x]], s[x], s[x], _binary(buf, starts[x], np.full(len(x), window)))

        def done():
            if held:
                yield from work()
            if keep and current is not None and current < parts_from:
                for x in family.levels:
                    if not x.stored:
                        yield _made(2, current, [0], [0], [x.first], [x.last], pa.array([x.buf.tobytes()], pa.binary()), pa.array([x.sa.astype(np.int64).tobytes()], pa.binary()))

        for batch in batches:
            shard, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (kind[1:] != kind[:-1]))) if len(shard) else []
            for a, b in zip(cuts, [*cuts[1:], len(shard)]):
                if shard[a] != current:
                    yield from done()
                    family, current, held, rows = SuffixLevels(window), int(shard[a]), [], 0
                if kind[a] == 0:
                    for i in range(a, b):
                        family.load(np.frombuffer(batch.column(6)[i].as_py(), np.uint8), np.frombuffer(batch.column(7)[i].as_py(), np.int64), batch.column(3)[i].as_py(), batch.column(4)[i].as_py())
                    continue
                while a < b:
                    take = min(int(b - a), batch_rows - rows)
                    held.append(batch.slice(int(a), take))
                    rows, a = rows + take, a + take
                    if rows >= batch_rows:
                        yield from work()
                        held, rows = [], 0
        yield from done()

    return run


def _by_bytes(window: int, shards: int):
    """Windows that are the first of their part, to pieces dealt out by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            buf, off = _flat(batch.column(3))
            values, powers, _ = _constants(1 << 20)
            h = _mix((values[buf] * powers[np.arange(len(buf)) % window]).reshape(-1, window).sum(axis=1, dtype=np.uint64))
            shard = (h % np.uint64(shards)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.ones(n, np.int32)), batch.column(0), batch.column(1), batch.column(2), pa.array(np.ones(n, np.int32)), batch.column(3), pa.nulls(n, pa.binary())], ["shard", "kind", "batch", "id", "at", "n", "buf", "sa"])

    return run


def _dealt(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("shard").sortWithinPartitions("shard", "kind", "batch", "id", "at")


def _pieces(docs: DataFrame, contexts: DataFrame, shards: int, window: int) -> DataFrame:
    """docs: `batch, id, text`; contexts: `batch, h, id, p, part`. Those of part 0 are dealt out by k-gram, the others by k-gram and
    part, into shards of their own."""
    shard = F.when(F.col("part") > 0, F.lit(shards) + F.pmod(F.xxhash64("h", "part"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("h"), F.lit(shards)))
    asked = contexts.groupBy("batch", "id").agg(F.collect_list(F.struct("p", shard.cast("int").alias("shard"))).alias("asked"))
    return docs.join(asked, ["batch", "id"]).select("batch", "id", "text", "asked").mapInArrow(trimmed(_fetch(window)), _PIECES)


def _left(made: DataFrame, window: int, shards: int) -> DataFrame:
    return made.filter("kind = 1").select("batch", "id", "s", "buf").mapInArrow(trimmed(_by_bytes(window, shards)), _PIECES)


def repeat_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, batch: int = BATCH) -> DataFrame:
    """`id, spans`: of each document of docs (`id` long, unique; `text`) that has any, the byte spans [s, e) to remove, by start;
    they may overlap or touch."""
    one = F.lit(0).alias("batch")
    anchors = docs.mapInArrow(trimmed(_anchors(window, gram)), _ANCHORS).repartition("h", F.when(F.col("h") < 0, F.col("id"))).sortWithinPartitions("h")
    met = store(anchors.mapInArrow(trimmed(_met(hot)), f"{_ANCHORS}, part int"), "repeat-met")
    spans = met.filter("part < 0").select("id", F.col("p").alias("s"), "e")
    need = met.filter("part >= 0").select(one, "h", "id", "p", "part")
    n, most = need.agg(F.count("*"), F.max("part")).first()
    if n:
        shards = max(1, -(-n // shard))
        made = store(_dealt(_pieces(docs.select(one, "id", "text"), need, shards, window)).mapInArrow(trimmed(_match(window, batch, shards, False)), _MADE), "repeat-made")
        spans = spans.union(made.filter("kind = 0").select("id", "s", "e"))
        if most:
            shards = max(1, -(-made.filter("kind = 1").count() // (32 * shard)))
            more = store(_dealt(_left(made, window, shards)).mapInArrow(trimmed(_match(window, 32 * batch, shards, False)), _MADE), "repeat-more")
            spans = spans.union(more.filter("kind = 0").select("id", "s", "e"))
    return spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


class SuffixIndex:
    """The family in a folder that all executors share: documents, anchors and levels of all batches, a row a level and shard.

    `add(docs)` indexes a batch (`id` long, unique; `text`) and returns `id, spans` of what occurs earlier: in a batch before, or in
    this one before it. Levels that a batch merged stand in for the ones they came from; those stay where they are. A k-gram's
    contexts are fetched when it is found to be an anchor again, which may be batches later; when it gets hot, its windows go to the
    shards by bytes. When shards have grown over twice as large as asked for, the index is built anew with more of them.

    A batch counts once its row in the folder `batches` is written; what a failed one left is overwritten.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard: int = SHARD, batch: int = BATCH):
        self.spark, self.path = spark, path
        self.window, self.gram, self.hot, self.shard, self.batch = window, gram, hot, shard, batch

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _state(self) -> tuple[int, int, int]:
        """Batches so far, the build that counts, its number of shards."""
        last = self._read("batches", "batch int, build int, shards int").orderBy(F.desc("batch")).head(1)
        return (last[0].batch + 1, last[0].build, last[0].shards) if last else (0, 0, 0)

    def _upto(self, name: str, schema: str, batch: int) -> DataFrame:
        """Rows of the batches before this one, with `batch`."""
        return self._read(name, f"{schema}, batch int").filter(F.col("batch") < batch)

    def _levels(self, folder: str, batch: int) -> DataFrame:
        """Levels as rows of _PIECES, without those that a later one stands in for: their numbers lie within its own."""
        rows = self._upto(folder, "shard int, s long, e long, buf binary, sa binary", batch)
        before = F.max("e").over(Window.partitionBy("shard").orderBy("s", F.desc("e")).rowsBetween(Window.unboundedPreceding, -1))
        live = rows.select("shard", "s", "e").withColumn("before", before).filter("before is null or e > before").drop("before")
        return rows.join(live, ["shard", "s", "e"]).select("shard", F.lit(0).alias("kind"), F.lit(-1).alias("batch"), F.col("s").alias("id"), F.col("e").alias("at"), F.lit(0).alias("n"), "buf", "sa")

    def _scan(self, pieces: DataFrame, folder: str, batch: int, rows: int, shards: int) -> DataFrame:
        both = _dealt(pieces.union(self._levels(folder, batch)))
        made = store(both.mapInArrow(trimmed(_match(self.window, rows, shards, True)), _MADE), "index-made")
        made.filter("kind = 2").select("shard", "s", "e", "buf", "sa").write.mode("overwrite").parquet(f"{self.path}/{folder}/batch={batch}")
        return made

    def add(self, docs: DataFrame) -> DataFrame:
        batch, build, shards = self._state()
        docs.select(F.col("id").cast("long").alias("id"), "text").write.mode("overwrite").parquet(f"{self.path}/docs/batch={batch}")
        texts = self._upto("docs", "id long, text string", batch + 1)
        fresh = texts.filter(F.col("batch") == batch).select("id", "text")
        fresh.mapInArrow(trimmed(_anchors(self.window, self.gram)), _ANCHORS).write.mode("overwrite").parquet(f"{self.path}/anchors/batch={batch}")
        rows, new = self._upto("anchors", _ANCHORS, batch + 1), F.col("batch") == batch
        anchors, own = rows.filter("h >= 0").select("h", "id", "p", "batch"), rows.filter((F.col("h") < 0) & new).select("id", F.col("p").alias("s"), "e")
        grams = store(anchors.groupBy("h").agg(F.count_if(~new).alias("old"), F.count("*").alias("n")).filter("n > 1"), "index-grams")
        total = grams.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        wanted = anchors.join(grams, "h")
        if not shards or total > 2 * shards * self.shard:
            build, shards = build + 1, max(1, -(-total // self.shard))
        else:  # of the batches before, what has not been asked for yet
            late = (F.col("old") == 1) | ((F.col("n") > self.hot) & (F.col("old") <= self.hot))
            wanted = wanted.filter(new | ((F.col("n") > F.col("old")) & late))
        part = F.when(F.col("n") > self.hot, 1 + F.pmod(F.xxhash64("batch", "id", "p"), F.ceil(F.col("n") / F.lit(self.hot)))).otherwise(0)
        pieces = _pieces(texts.select("batch", "id", "text"), wanted.select("batch", "h", "id", "p", part.alias("part")), shards, self.window)
        made = self._scan(pieces, f"levels/build={build}/grams", batch, self.batch, shards)
        more = self._scan(_left(made, self.window, shards), f"levels/build={build}/bytes", batch, 32 * self.batch, shards)
        self.spark.createDataFrame([(batch, build, shards)], "batch int, build int, shards int").coalesce(1).write.mode("append").parquet(f"{self.path}/batches")
        spans = own.union(made.union(more).filter((F.col("kind") == 0) & new).select("id", "s", "e"))
        return spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            block, spans = Block(part.column(1)), part.column(2)
            doc = np.repeat(np.arange(block.n), np.asarray(pc.fill_null(spans.value_lengths(), 0)))
            flat = spans.flatten()
            doc, s, e = merged_spans(doc, np.asarray(flat.field("s")), np.asarray(flat.field("e")))
            edge = np.zeros(len(block.buf) + 1, np.int8)
            edge[block.off[doc] + s] += 1  # merged spans of a document neither touch nor overlap
            np.add.at(edge, block.off[doc] + e, -1)
            kept = np.cumsum(edge[:-1], dtype=np.int8) == 0
            off = np.concatenate([[0], np.cumsum(kept)])[block.off]
            data = memoryview(np.ascontiguousarray(block.buf[kept]))
            digest = [hashlib.sha256(data[i:j]).hexdigest() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            counts = [block.lengths, block.lengths - np.diff(off), np.bincount(doc, minlength=block.n)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x.astype(np.int64)) for x in counts), pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, **options) -> DataFrame:
    """For each row of docs: `id, n_bytes, n_removed, n_spans, kept_sha256`: what is left once each byte is removed that is
    covered by a string of `window` bytes which also starts earlier (smaller id, or same document and earlier start).

    Texts are whole, as UTF-8; null is empty; matches never cross documents. Null ids come first. Rows that repeat an id and a
    text are one document and get one result each; texts that share an id are ordered by their hash.
    """
    if not gram < window < gram + 128:
        raise ValueError("the window must be longer than the k-gram, by less than 128")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    ids = docs.agg(F.count("*"), F.count("id")).first()
    plain = isinstance(docs.schema["id"].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)) and ids[0] == ids[1]
    plain = plain and docs.groupBy("id").count().filter("count > 1").isEmpty()
    if plain:
        keyed, kind = docs.withColumn("id", F.col("id").cast("long")), docs.schema["id"].dataType
    else:  # places in the order of (id, hash of the text) stand for the ids
        tagged = docs.withColumn("tag", F.xxhash64("text"))
        order = tagged.select("id", "tag").distinct().orderBy(F.col("id").asc_nulls_first(), "tag")
        order = store(order.withColumn("place", F.monotonically_increasing_id()), "repeat-order").select(F.col("id").alias("own"), F.col("tag").alias("own_tag"), "place")
        placed = store(tagged.join(order, F.col("id").eqNullSafe(F.col("own")) & (F.col("tag") == F.col("own_tag"))).select("place", F.col("id").alias("own"), "text"), "repeat-placed")
        keyed = placed.select(F.col("place").alias("id"), "text")
    spans = repeat_spans(keyed.dropDuplicates(["id"]) if not plain else keyed, window, gram, **options)
    cut = keyed.join(spans, "id", "left").select("id", "text", "spans").mapInArrow(trimmed(_cut), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if plain:
        return cut.withColumn("id", F.col("id").cast(kind))
    back = placed.select("place", "own").distinct()
    return cut.join(back, cut["id"] == back["place"]).select(F.col("own").alias("id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
