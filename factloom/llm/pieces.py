"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Words of equal length advance together, one character a step. Hashes of all substrings probe the sorted keys of the pieces; at
each step the best candidate that ends there is kept with a pointer back.

Two kinds of model. Unigram: a candidate scores its own plus the best of its start; the maximum wins. BPE: merging by score gives
the one segmentation in which every two neighbours are what merging makes of the two together; so a candidate counts if it
agrees with the last piece of the best path to its start, exactly one does, and the search returns the library's ids. Agreement
of two pieces is found once by merging their characters and kept in a sorted table.
"""

from __future__ import annotations

import heapq
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Block, ragged, slices, table, trimmed
from .wordpool import WordPool

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE_MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """The fields of a protocol-buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(tag & 7)
            if n is None:
                n = varint()
            yield tag >> 3, data[at : at + n]
            at += n


class PieceModel:
    """A SentencePiece model: pieces, scores, kinds, and whether texts get a space in front."""

    def __init__(self, data: bytes):
        self.pieces, self.scores, self.kinds, self.type, self.prefix, squeeze, charsmap = [], [], [], UNIGRAM, True, True, b""
        for field, value in _fields(data):
            if field == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", f[2])[0] if 2 in f else 0.0)
                self.kinds.append(f.get(3, NORMAL))
            elif field == 2:
                self.type = dict(_fields(value)).get(3, UNIGRAM)
            elif field == 3:
                f = dict(_fields(value))
                charsmap, self.prefix, squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if charsmap or squeeze:
            raise ValueError("only models that leave characters and white space as they are can be used")
        if self.type not in (UNIGRAM, BPE) or USER in self.kinds or BYTE not in self.kinds:
            raise ValueError("only unigram and BPE models with bytes for unknown characters and no user symbols can be used")
        self.byte_id = np.zeros(256, np.uint32)
        for i, kind in enumerate(self.kinds):
            if kind == BYTE:
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.normal = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.n = len(self.pieces)
        self.longest = max((len(p) for p in self.normal), default=1)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.normal):
            raise ValueError("pieces go on over a space: words can't be coded apart")
        # ASCII bytes in no piece never merge: words end on both sides of them
        self.apart = np.zeros(256, bool)
        self.apart[:128] = True
        self.apart[list({ord(c) for p in self.normal for c in p if ord(c) < 128})] = False
        self.apart[32] = False
        self.unknown_score = min([self.scores[i] for i in self.normal.values()], default=0.0) - 10.0
        self._tables()
        self._decoding()

    def _tables(self) -> None:
        """For each length of a piece the sorted hash keys and the piece of each; a bit table that most substrings fail."""
        self.by_length, self.sieve = {}, np.zeros(1 << 20, bool)
        names = {}
        for p, i in self.normal.items():
            names.setdefault(len(p), []).append((p, i))
        for m, own in names.items():
            chars = np.array([[ord(c) for c in p] for p, _ in own], np.uint64)
            keys = np.zeros(len(own), np.uint64)
            for j in range(m):
                keys += _mixed(chars[:, j]) * _power(np.uint64(j))
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            if (keys[1:] == keys[:-1]).any():
                raise ValueError("two pieces have the same key")
            self.by_length[m] = keys, np.array([i for _, i in own], np.int32)[order]
            self.sieve[(keys >> np.uint64(44)).astype(np.int64)] = True
        self.score = np.append(np.array(self.scores, np.float64), self.unknown_score)
        self.pairs, self.agree = np.zeros(0, np.int64), np.zeros(0, bool)  # sorted; what was found late is kept apart
        self.late_pairs, self.late_agree = self.pairs, self.agree

    def _decoding(self) -> None:
        parts = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(SPACE_MARK, " ").encode() for p, k in zip(self.pieces, self.kinds)]
        self.out_bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.out_count = np.array([len(p) for p in parts], np.int64)
        self.out_start = np.cumsum(self.out_count) - self.out_count

    def merged(self, text: str, cut: int) -> bool:
        """Whether merging text[:cut] + text[cut:] by score, leftmost first, leaves just these two parts; cut 0: one part."""
        n = len(text)
        right, left, sign = list(range(1, n + 1)), list(range(-1, n)), [text[i] for i in range(n)]
        heap: list = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b < n:
                i = self.normal.get(sign[a] + sign[b])
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], a, b, len(sign[a]) + len(sign[b])))

        for i in range(n - 1):
            offer(i, i + 1)
        gone = [False] * n
        while heap:
            _, a, b, size = heapq.heappop(heap)
            if gone[a] or gone[b] or right[a] != b or len(sign[a]) + len(sign[b]) != size:
                continue
            if b == cut:
                return False
            sign[a] += sign[b]
            gone[b] = True
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return right[0] == (cut or n) and (not cut or right[cut] == n)

    def agreeing(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair of pieces as they are. first may be n: a character that is in no piece, or no
        piece at all; second is then asked whether its own characters merge to it."""
        key = first.astype(np.int64) * (self.n + 1) + second
        known, value = _looked_up(self.pairs, self.agree, key)
        rest = np.flatnonzero(~known)
        if len(rest):
            late, value[rest] = _looked_up(self.late_pairs, self.late_agree, key[rest])
            rest = rest[~late]
        if len(rest):
            new, row = np.unique(key[rest], return_inverse=True)
            found = np.array([self._agree(k // (self.n + 1), k % (self.n + 1)) for k in new.tolist()], bool)
            value[rest] = found[row]
            place = np.searchsorted(self.late_pairs, new)
            self.late_pairs, self.late_agree = np.insert(self.late_pairs, place, new), np.insert(self.late_agree, place, found)
            if len(self.late_pairs) > 4096:
                place = np.searchsorted(self.pairs, self.late_pairs)
                self.pairs, self.agree = np.insert(self.pairs, place, self.late_pairs), np.insert(self.agree, place, self.late_agree)
                self.late_pairs, self.late_agree = self.late_pairs[:0], self.late_agree[:0]
                if len(self.pairs) > 4_000_000:  # bounds the memory; results are the same
                    self.pairs, self.agree = self.late_pairs, self.late_agree
        return value

    def _agree(self, a: int, b: int) -> bool:
        if b == self.n:
            return True
        if a == self.n:
            return self.merged(self.pieces[b], 0)
        return self.merged(self.pieces[a] + self.pieces[b], len(self.pieces[a]))

    def viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words in turn, and the number of each. Spaces are those of the text, not yet marks."""
        texts = [w.decode().replace(" ", SPACE_MARK) for w in words]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(size, kind="stable")
        flats, counts = [], np.zeros(len(texts), np.int64)
        a = 0
        while a < len(order):  # words of one length, or of nearly one among the long ones, up to a bound of characters
            n = int(size[order[a]])
            b = int(np.searchsorted(size[order], n if n <= 24 else n + n // 8, "right"))
            b = min(b, a + max(1, (1 << 18) // max(n, 1)))
            flat, counts[order[a:b]] = self._together([texts[i] for i in order[a:b]], size[order[a:b]])
            flats.append(flat)
            a = b
        if not flats:
            return np.zeros(0, np.uint32), counts
        start = np.empty(len(texts), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return np.concatenate(flats)[ragged(start, counts)].astype(np.uint32), counts

    def _together(self, texts: list[str], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        total, begin = len(code), np.cumsum(size) - size
        inside = np.arange(total) - np.repeat(begin, size)  # characters of the same word before this one
        power = _power(np.arange(total, dtype=np.uint64))
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(code.astype(np.uint64)) * power, dtype=np.uint64)])
        inverse = _inverse_power(np.arange(total, dtype=np.uint64))
        lengths = sorted(m for m in self.by_length if m <= int(size.max()))
        found = np.full((len(lengths), total), -1, np.int32)  # the piece of each length that ends at each character
        for row, m in enumerate(lengths):
            last = np.flatnonzero(inside >= m - 1)
            key = (prefix[last + 1] - prefix[last + 1 - m]) * inverse[last + 1 - m]
            may = self.sieve[(key >> np.uint64(44)).astype(np.int64)]
            last, key = last[may], key[may]
            keys, pieces = self.by_length[m]
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            found[row, last[hit]] = pieces[at[hit]]
        if lengths and lengths[0] == 1:
            found[0, found[0] < 0] = self.n  # a character of its own that no piece has
        else:
            lengths, found = [1, *lengths], np.concatenate([np.full((1, total), self.n, np.int32), found])
        piece, back = np.full(total, self.n, np.int32), np.ones(total, np.int32)
        best = np.zeros(total)
        alive = np.arange(len(size))
        for step in range(int(size.max())):
            alive = alive[size[alive] > step]
            here = begin[alive] + step
            top, top_piece, top_back = np.full(len(here), -np.inf), np.full(len(here), self.n, np.int32), np.ones(len(here), np.int32)
            for row, m in enumerate(lengths):
                if m > step + 1:
                    break
                c = found[row, here]
                live = np.flatnonzero(c >= 0)
                if not len(live):
                    continue
                before = here[live] - m
                starts = np.full(len(live), m == step + 1)
                if self.type == BPE:
                    last = np.where(starts, self.n, piece[np.maximum(before, 0)])
                    value = np.where(self.agreeing(last, c[live]), 0.0, -np.inf)
                else:
                    value = np.where(starts, 0.0, best[np.maximum(before, 0)]) + self.score[c[live]]
                better = value > top[live]
                won = live[better]
                top[won], top_piece[won], top_back[won] = value[better], c[won], m
            piece[here], back[here], best[here] = top_piece, top_back, top
        ends = np.zeros(total, bool)
        at, word = begin + size - 1, np.arange(len(size))
        live = size > 0
        at, word = at[live], word[live]
        while len(at):
            ends[at] = True
            at = at - back[at]
            live = at >= begin[word]
            at, word = at[live], word[live]
        at = np.flatnonzero(ends)
        ids, unknown = piece[at].astype(np.int64), piece[at] == self.n
        counts = np.ones(len(at), np.int64)
        owner = np.searchsorted(begin, at, "right") - 1
        if unknown.any():
            raw = [chr(c).encode() for c in code[at[unknown]].tolist()]
            counts[unknown] = list(map(len, raw))
            flat = np.repeat(ids, counts)
            flat[np.repeat(unknown, counts)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
            ids = flat
        return ids, np.bincount(owner, weights=counts, minlength=len(size)).astype(np.int64)

    def encode(self, column: pa.Array, pool: WordPool) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text's begin (n + 1 long). Null and empty texts have none."""
        column = pc.replace_substring(pc.fill_null(column.cast(pa.large_string()), ""), SPACE_MARK, " ")
        if self.prefix:
            full = pc.greater(pc.binary_length(column), 0)
            column = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())), column)
        block = Block(column)
        n = len(block.buf)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(block.n + 1, np.int64)
        apart, space = self.apart[block.buf], block.buf == 32
        edge = np.zeros(n + 1, bool)
        edge[block.off] = True
        edge[n] = True
        edge[:-1] |= apart
        edge[1:] |= apart
        edge[1:n] |= space[1:] & ~space[:-1]
        cut = np.flatnonzero(edge)
        ids, counts = pool.code(block.buf, cut[:-1], cut[1:])
        return ids, np.concatenate([[0], np.cumsum(counts)])[np.searchsorted(cut[:-1], block.off)]

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids[at[d]:at[d + 1]]: bytes that are no UTF-8 become U+FFFD, one leading space goes if the model adds one."""
        counts = self.out_count[ids]
        data = self.out_bytes[ragged(self.out_start[ids], counts)].tobytes()
        cut = np.concatenate([[0], np.cumsum(counts)])[at].tolist()
        out = []
        for a, b in zip(cut[:-1], cut[1:]):
            a += self.prefix and data[a : min(a + 1, b)] == b" "
            out.append(data[a:b].decode("utf-8", "replace"))
        return out


def _looked_up(keys: np.ndarray, values: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are in the sorted table, and their values."""
    if not len(keys):
        return np.zeros(len(key), bool), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
    known = keys[at] == key
    return known, values[at] & known


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return x * np.uint64(0x94D049BB133111EB)


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    out, square = np.ones(len(exponents), np.uint64), base
    top = int(exponents.max()) if len(exponents) else 0
    for bit in range(top.bit_length()):
        out[(exponents >> np.uint64(bit)) & np.uint64(1) == 1] *= np.uint64(square)
        square = square * square % (1 << 64)
    return out


_KEPT: dict[int, np.ndarray] = {}


def _power(exponents, base: int = int(_BASE)):
    """base ** exponents modulo 2 ** 64; runs 0, 1, 2, ... are kept."""
    if np.ndim(exponents) == 0:
        return np.uint64(pow(base, int(exponents), 1 << 64))
    if base not in _KEPT or len(_KEPT[base]) < len(exponents):
        _KEPT[base] = _powers(base, np.arange(max(len(exponents), 1 << 16), dtype=np.uint64))
    return _KEPT[base][: len(exponents)]


def _inverse_power(exponents):
    return _power(exponents, pow(int(_BASE), -1, 1 << 64))


_MODELS: dict[int, tuple[PieceModel, WordPool]] = {}


def _model(data: bytes) -> tuple[PieceModel, WordPool]:
    """This worker's model with the words it has coded."""
    key = zlib.crc32(data)
    if key not in _MODELS:
        model = PieceModel(data)
        _MODELS.clear()
        _MODELS[key] = model, WordPool(model.viterbi, 500_000)
    return _MODELS[key]


def with_pieces(docs: DataFrame, model: bytes, text_col: str = "text", ids_col: str = "piece_ids", decoded_col: str | None = None) -> DataFrame:
    """docs with the ids of each whole text, and with the text decoded from them if decoded_col is given. Columns of these
    names are replaced. Null text: null ids, null decoded text; empty: no ids, empty. A map over the scan: nothing is shuffled.
    """
    plain = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    held = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary file
    names = [*plain.columns, ids_col, *([decoded_col] if decoded_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, pool = _model(held.value)
        for batch in batches:
            for part in slices(batch, text_col, 1 << 19):
                column = part.column(part.schema.get_field_index(text_col))
                ids, at = pieces.encode(column, pool)
                null = np.asarray(pc.is_null(column))
                arrays = [*part.columns, pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32)), mask=pa.array(null))]
                if decoded_col:
                    arrays.append(pa.array(pieces.decode(ids, at), pa.string(), mask=null))
                yield pa.RecordBatch.from_arrays(arrays, names)

    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    return plain.mapInArrow(trimmed(run), T.StructType([*plain.schema.fields, *more]))


def public_model() -> bytes:
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of ids, their CRC-32 as little-endian unsigned 32-bit integers, CRC-32 of the decoded text, and
    whether that is the text again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = with_pieces(docs, public_model(), decoded_col="decoded")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            at, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            at = at.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])], pa.int64()), *batch.columns[2:]],
                ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"],
            )

    same = F.coalesce(F.col("decoded") == F.col("text"), F.col("text").isNull())
    coded = coded.select("doc_id", F.coalesce("piece_ids", F.array().cast("array<int>")).alias("ids"), F.coalesce(F.crc32(F.col("decoded").cast("binary")), F.lit(0)).alias("decoded_crc32"), same.alias("round_trip"))
    return coded.mapInArrow(trimmed(digest), "doc_id long, n_tokens long, ids_crc32 long, decoded_crc32 long, round_trip boolean")
