"""Token ids in a file of directly addressable codes.

A segment holds the ids of some documents. Each id is cut into chunks of 8 bits. Level 1 has the lowest chunk of every id, and a
bitmap that says which ids go on; level 2 has the next chunk of those only, and so on. A rank directory counts the ones before
every 512 bits, so the place of an id's next chunk is one directory entry and a few population counts away: any token can be
read without decoding others.

Layout, little-endian: `DAC1`, number of documents u4, of ids u8, of levels u4; the documents' ids i8, a byte each that is 1 for
a null id, the first token of each u8 and one more; then for each level: its length u8, chunks, the bitmap in u8 words, the
directory u8.
"""

from __future__ import annotations

import json
import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Block, ragged, slices, store, table, trimmed
from .wordpool import WordPool

MAGIC = b"DAC1"
#: Ids of a segment, about; a longer document makes a longer segment. Small, for Arrow and Parquet count rows, not bytes.
SEGMENT = 1 << 13
#: Ranges of ids at most, each a task of its own: as many as a shuffle can well have. Beyond, ranges grow, and their sort spills.
RANGES = 100_000
#: Ids that are read for the cut of a range, about; the driver holds RANGES times as many at most.
CUT_SAMPLE = 50


def pack(doc_ids: list, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """One segment. starts: the first token of each document, and the number of ids."""
    out = [MAGIC, np.uint32(len(doc_ids)).tobytes(), np.uint64(len(ids)).tobytes()]
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(rest) // 64), np.uint64)
        words.view(np.uint8)[: len(bits)] = bits
        ones = np.bitwise_count(words).astype(np.uint64)
        ones = np.append(ones, np.zeros(-len(ones) % 8, np.uint64)).reshape(-1, 8).sum(axis=1)
        directory = np.cumsum(ones, dtype=np.uint64) - ones
        levels.append(np.uint64(len(rest)).tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + words.tobytes() + directory.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out.append(np.uint32(len(levels)).tobytes())
    out.append(np.array([0 if d is None else d for d in doc_ids], np.int64).tobytes())
    out.append(bytes(d is None for d in doc_ids))
    out.append(np.asarray(starts, np.uint64).tobytes())
    return b"".join(out + levels)


class Segment:
    """Reads a segment in place."""

    def __init__(self, data):
        self.data, self.at = memoryview(data), 0
        if bytes(self._take(np.uint8, 4)) != MAGIC:
            raise ValueError("this is no segment of directly addressable codes")
        n_docs, self.n = int(self._take(np.uint32, 1)[0]), int(self._take(np.uint64, 1)[0])
        n_levels = int(self._take(np.uint32, 1)[0])
        ids, null = self._take(np.int64, n_docs), self._take(np.uint8, n_docs)
        self.doc_ids = [None if z else i for i, z in zip(ids.tolist(), null.tolist())]
        self.starts = self._take(np.uint64, n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            m = int(self._take(np.uint64, 1)[0])
            words = -(-m // 64)
            self.levels.append((self._take(np.uint8, m), self._take(np.uint64, words), self._take(np.uint64, -(-words // 8))))

    def _take(self, kind, n: int) -> np.ndarray:
        x = np.frombuffer(self.data, kind, n, self.at)
        self.at += x.nbytes
        return x

    def tokens(self, at) -> np.ndarray:
        """The ids at any positions, each by its own path through the levels."""
        at = np.asarray(at, np.int64)
        out, live, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
        for chunks, words, directory in self.levels:
            out[live] |= chunks[at].astype(np.uint32) << np.uint32(shift)
            on = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            at, live = at[on], live[on]
            if not len(at):
                break
            word = at >> 6
            rank = directory[at >> 9].astype(np.int64)
            for k in range(7):
                before = (word & ~7) + k
                rank += np.where(before < word, np.bitwise_count(words[np.minimum(before, len(words) - 1)]), 0)
            rank += np.bitwise_count(words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at, shift = rank, shift + 8
        return out

    def all_tokens(self) -> np.ndarray:
        """All ids in turn, level by level."""
        value = None
        for chunks, words, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if value is not None:
                on = np.unpackbits(words.view(np.uint8), count=len(chunks), bitorder="little").view(bool)
                own[on] |= value << np.uint32(8)
            value = own
        return value

    def document(self, k: int) -> np.ndarray:
        return self.tokens(np.arange(self.starts[k], self.starts[k + 1]))


_TOKENIZERS: dict[int, WordPool] = {}


def surface_lengths(tokenizer) -> np.ndarray:
    """How many bytes of text each id stands for: the token's characters without the mark of a word's end. Special tokens: a
    length that no text has, so that words which hold one are coded alone."""
    suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
    out = np.full(tokenizer.get_vocab_size(), 1 << 40, np.int64)
    special = tokenizer.get_added_tokens_decoder()
    for token, i in tokenizer.get_vocab().items():
        if i not in special:
            out[i] = len(token.removesuffix(suffix) if suffix else token)
    return out


def _settled(word: str) -> bool:
    """Whether lower case and NFC leave the word as it is."""
    return word == word.lower() and unicodedata.is_normalized("NFC", word)


def _pool(source: str) -> WordPool:
    """This worker's tokenizer with the words it has coded."""
    key = hash(source)
    if key not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(source)
        surface = surface_lengths(tokenizer)

        def one_by_one(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            ids = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

        def together(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            """Words as one text; where each ends is known by the lengths of the tokens, which only fall short if one was not kept whole."""
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)[0].ids, np.uint32)
            ends, upto = np.cumsum([len(w) for w in words]), np.cumsum(surface[ids])
            at = np.searchsorted(upto, ends)
            if at[-1] != len(ids) - 1 or not np.array_equal(upto[at], ends):
                return one_by_one(words)
            return ids, np.diff(at, prepend=-1)

        def encode(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            plain = np.fromiter((w.isascii() or _settled(w.decode()) for w in words), bool, len(words))
            order = np.argsort(~plain, kind="stable")
            m, got = int(plain.sum()), []
            for a, b, run in ((0, m, together), (m, len(words), one_by_one)):
                got += [run([words[i] for i in order[k : min(k + 2000, b)].tolist()]) for k in range(a, b, 2000)]
            ids, counts = (np.concatenate([x[i] for x in got]) for i in (0, 1))
            back = np.empty(len(words), np.int64)
            back[order] = np.arange(len(words))
            return ids[ragged((np.cumsum(counts) - counts)[back], counts[back])], counts[back]

        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordPool(encode, 1_000_000)
    return _TOKENIZERS[key]


def encode_texts(pool: WordPool, column: pa.Array, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in turn, each with end_id after it, and where each text begins (n + 1 long).

    The tokenizer must split at `[\\x20\\x09-\\x0D]` and drop it, as this one does: a text's ids are then those of its words.
    """
    block = Block(column)
    starts, ends, first, _ = block.words()
    ids, counts = pool.code(block.buf, starts, ends)
    before = np.concatenate([[0], np.cumsum(counts)])[first]
    if end_id is None:
        return ids, before
    out = np.full(len(ids) + block.n, end_id, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(block.n), np.diff(before))] = ids
    return out, before + np.arange(block.n + 1)


def range_cuts(ids: DataFrame, rows_per_range: int) -> np.ndarray:
    """Where ranges of about rows_per_range rows of `id` begin, but for the first: increasing. They only balance tasks; any cuts
    give the same file. RANGES x CUT_SAMPLE ids, about, reach the driver at most."""
    n = ids.count()
    ranges = min(RANGES, -(-n // rows_per_range))
    if ranges < 2:
        return np.zeros(0, np.int64)
    share = min(1.0, ranges * CUT_SAMPLE / n)
    few = ids.filter(F.col("id").isNotNull() & (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))).groupBy("id").agg(F.count("*").alias("n"))
    rows = sorted((r.id, r.n) for r in few.collect())
    if not rows:
        return np.zeros(0, np.int64)
    value, upto = np.array([v for v, _ in rows], np.int64), np.cumsum([c for _, c in rows])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return np.unique(value[at])


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, rows_per_range: int = 10_000, segment: int = SEGMENT) -> DataFrame:
    """Writes the ids of all texts to segments, in ascending order of id, and returns the files as a table: `range, seq,
    first, n_tokens, payload`, one segment a row, `first` the ids before it in its range, `payload` in the layout above. tokenizer: the JSON of a `tokenizers` tokenizer.

    Ranges of ids are cut by the id column alone, at quantiles of the ids of smallest hash, so a text is encoded once; only ids are
    shuffled, in 2 bytes where the vocabulary allows, each range to its own task. Spark's committer writes the files to the shared
    folder, so a lost executor's part is written again. Null ids come first. Rows of equal id stand in the order of their ids'
    bytes. Null text: empty. Ids must be integers.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = range_cuts(source.select("id"), rows_per_range)
    ranges = len(cuts) + 1
    vocabulary = spark.sparkContext.broadcast(tokenizer)
    kind = np.uint16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _pool(vocabulary.value)
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                ids, at = encode_texts(pool, part.column(1), end_id)
                narrow = not len(ids) or int(ids.max()) <= np.iinfo(kind).max
                data = ids.astype(kind if narrow else np.uint32)
                off = at * data.itemsize
                payload = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                place = np.searchsorted(cuts, part.column(0).fill_null(-(1 << 63)).to_numpy(), "right")
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), part.column(0), pa.array([data.itemsize] * part.num_rows, pa.int32()), payload], ["range", "id", "width", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, place, seq, before = [], 0, None, 0, 0

        def flush():
            ids = np.concatenate([x for _, x in held])
            starts = np.concatenate([[0], np.cumsum([len(x) for _, x in held])])
            payload = pack([d for d, _ in held], starts, ids)
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([seq], pa.int64()), pa.array([before], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([payload], pa.binary())], ["range", "seq", "first", "n_tokens", "payload"])

        for batch in batches:
            for r, d, w, x in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (r != place or count >= segment):
                    yield flush()
                    seq, before = (seq + 1, before + count) if r == place else (0, 0)
                    held, count = [], 0
                place = r
                held.append((d, np.frombuffer(x, kind if w == 2 else np.uint32).astype(np.uint32)))
                count += len(held[-1][1])
        if held:
            yield flush()

    coded = source.mapInArrow(trimmed(encode), "range int, id long, width int, ids binary")
    files = coded.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "id", "ids").mapInArrow(trimmed(build), "range int, seq long, first long, n_tokens long, payload binary")
    return store(files, "tokens")


def read_tokens(files: DataFrame) -> DataFrame:
    """From the files of write_tokens: `id, start, n_tokens, ids_crc32` of each document; start counts all ids before it.

    Sums for each range say where a range begins; they are RANGES rows of two longs at most, so they are broadcast, and no payload
    moves.
    """
    totals = files.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    totals = totals.select("range", (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = Segment(payload.as_buffer())
                ids, starts = part.all_tokens().astype("<u4"), part.starts
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(part.doc_ids, pa.int64()), pa.array(before + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(totals), "range").select((F.col("before") + F.col("first")).alias("at"), "payload")
    return placed.mapInArrow(trimmed(read), "id long, start long, n_tokens long, ids_crc32 long")


def op9_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        files = write_tokens(table(spark, sf_dir, "documents"), f.read())
    return read_tokens(files).withColumnRenamed("id", "doc_id")
