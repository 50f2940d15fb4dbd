"""Language ID by nearest centroids.

A text is a vector of hashed byte n-grams (orders 1 to 3, of the lower-cased text, runs of ASCII other than letters as one space),
weighted by TF-IDF and normalised. IDF counts every training document. Each language has several centroids, found by spherical
k-means on a bounded sample of its training documents. A text gets the language of the centroid with the largest cosine. It is
rejected if that cosine is below the centroid's floor for texts of its length: short texts are farther from any centroid, so
floors are measured on pieces of several lengths, cut from the sample.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Block, fresh, slices, table, trimmed

#: Slots of the hashed n-grams.
SLOTS = 4096
UNKNOWN = "und"
#: Bytes of the pieces that floors are measured on; a text counts as the longest that is not longer than it.
LENGTHS = (8, 16, 32, 64, 128, 256, 512, 1024)
#: Bytes as they count: ASCII that is no letter is one kind.
_PLAIN = np.arange(256, dtype=np.uint32)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 32


def gram_counts(column: pa.Array, slots: int = SLOTS) -> np.ndarray:
    """Counts of the hashed n-grams of each text: float32, one row a text. N-grams never cross texts."""
    block = Block(pc.utf8_lower(column.cast(pa.large_string())))
    counts = np.zeros((block.n, slots), np.float32)
    for d0 in range(0, block.n, 64):
        d1 = min(d0 + 64, block.n)
        at, upto = int(block.off[d0]), int(block.off[d1])
        flat = np.zeros((d1 - d0) * slots, np.int64)
        for a in range(at, upto, 1 << 20):  # a very long text in pieces; n-grams at a seam are read with the piece before
            b = min(a + (1 << 20), upto)
            x = _PLAIN[block.buf[a : min(b + 2, upto)]]
            doc = np.repeat(np.arange(d1 - d0), np.diff(np.clip(block.off[d0 : d1 + 1], a, a + len(x))))
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != 32) | (x[:-1] != 32) | (doc[1:] != doc[:-1])
            own = int(keep[: b - a].sum())
            x, doc = x[keep], doc[keep]
            base = doc * slots
            key = x.astype(np.uint32)
            for order in (1, 2, 3):
                m = len(x) - order + 1
                if m <= 0:
                    break
                if order > 1:
                    key = key[:m] * np.uint32(257) + x[order - 1 :]
                slot = ((key + np.uint32(order * 0x1000193)) * np.uint32(2654435761)) >> np.uint32(32 - int(slots).bit_length() + 1)
                ok = np.arange(m) < own
                if order > 1:
                    ok &= doc[:m] == doc[order - 1 :]
                flat += np.bincount(base[:m][ok] + slot[ok], minlength=len(flat))
        counts[d0:d1] = flat.reshape(-1, slots)
    return counts


def tfidf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Log-scaled counts times IDF, each row of length 1; a row of zeros stays."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class LanguageModel:
    langs: list[str]  # of each centroid
    centroids: np.ndarray  # rows of length 1
    floor: np.ndarray  # cosine below which a text is rejected, by centroid and length
    idf: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score (the cosine, 0 to 1) and whether it is rejected. Null texts and those without a letter: und, 0, rejected."""
        lettered = np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False)) if len(column) else np.zeros(0, bool)
        langs, score, rejected = [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        if len(self.langs):
            size = np.searchsorted(LENGTHS, np.asarray(pc.fill_null(pc.binary_length(column), 0)), "right") - 1
            for a in range(0, len(column), 256):
                cosine = tfidf(gram_counts(column.slice(a, 256), len(self.idf)), self.idf) @ self.centroids.T
                best = cosine.argmax(axis=1)
                for i in np.flatnonzero(lettered[a : a + 256]).tolist():
                    langs[a + i] = self.langs[best[i]]
                    score[a + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
                    rejected[a + i] = cosine[i, best[i]] < self.floor[best[i], max(0, size[a + i])]
        return langs, score, rejected


def _spherical_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k-means by cosine. Starts from the mean and then always the row farthest from what there is; so reruns agree."""
    mean = x.mean(axis=0)
    c = [mean / max(np.linalg.norm(mean), 1e-12)]
    best = x @ c[0]
    while len(c) < min(k, len(x)):
        c.append(x[int(best.argmin())])
        best = np.maximum(best, x @ c[-1])
    c = np.array(c, np.float32)
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            if (own == j).any():
                m = x[own == j].mean(axis=0)
                c[j] = m / max(np.linalg.norm(m), 1e-12)
    return c


def pieces_of(texts: list[str], n: int) -> list[str]:
    """A run of about n bytes of each text that has as many; where it begins, the text decides."""
    out = []
    for raw in (t.encode() for t in texts):
        if len(raw) >= n:
            at = zlib.crc32(raw) % (len(raw) - n + 1)
            out.append(raw[at : at + n].decode(errors="ignore"))
    return out


def floors(x_of, centroids: np.ndarray, texts: list[str], share: float, slack: float) -> np.ndarray:
    """For each of LENGTHS the cosine that all but `share` of the pieces reach, times slack; never less than for shorter ones. Where
    no text is long enough, that of the longest there is."""
    out, last = [], 0.0
    for n in LENGTHS:
        some = pieces_of(texts, n)
        if some:
            last = max(last, slack * float(np.quantile((x_of(some) @ centroids.T).max(axis=1), share)))
        out.append(last)
    return np.array(out)


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", clusters: int = 3, per_language: int = 600, reject_share: float = 0.001, slack: float = 0.9, slots: int = SLOTS) -> LanguageModel:
    """Learns from all rows of train with a non-null language and a letter in the text.

    Document frequencies count every such row: a sum of `slots` numbers a task. Centroids come from at most `per_language` rows of
    each language, of the smallest hashes of id and text; rows that repeat both count once. Only rows whose hash is below a bound,
    which the language's count sets so that about twice as many pass, are shuffled, so a hot language is not gathered. One task a
    language holds these. Floors leave `reject_share` of the pieces of the sample, times `slack`: what is unlike all training
    texts, and what has no letter, is rejected. A sample with few texts of a length gives that length a low floor. The model that
    reaches the driver has clusters x languages rows. The number of languages must stay below 10,000.
    """
    train = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, df = Counter(), np.zeros(slots, np.int64)
        for batch in batches:
            langs.update(batch.column(1).to_pylist())
            for part in slices(batch, "text", 1 << 20):
                for a in range(0, part.num_rows, 256):
                    df += (gram_counts(part.column(0).slice(a, 256), slots) > 0).sum(axis=0)
        names = list(langs)
        yield pa.RecordBatch.from_arrays([pa.array([*range(slots), *[-1] * len(names)], pa.int32()), pa.array([None] * slots + names, pa.string()), pa.array([*df.tolist(), *[langs[x] for x in names]], pa.int64())], ["slot", "lang", "n"])

    sums = train.select("text", "lang").mapInArrow(trimmed(frequencies), "slot int, lang string, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n")).collect()
    df, sizes = np.zeros(slots), {}
    for r in sums:
        if r.slot < 0:
            sizes[r.lang] = r.n
        else:
            df[r.slot] = r.n
    if not sizes:
        return LanguageModel([], np.zeros((0, slots), np.float32), np.zeros((0, len(LENGTHS))), np.ones(slots, np.float32))
    idf = np.log((1 + sum(sizes.values())) / (1 + df)).astype(np.float32) + np.float32(1)
    bounds = train.sparkSession.createDataFrame([(k, min(1 << 30, -(-(2 * per_language << 30) // n))) for k, n in sizes.items()], "own string, bound long")
    hashed = train.withColumn("h", F.xxhash64("id", "text")).join(F.broadcast(bounds), F.col("lang") == F.col("own"))  # one row a language
    some = hashed.filter(F.pmod("h", F.lit(1 << 30)) < F.col("bound")).groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))
    sample = some.withColumn("rank", rank).filter(F.col("rank") <= per_language)

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("rank", kind="stable")["text"].tolist()
        x_of = lambda some: np.concatenate([tfidf(gram_counts(pa.array(some[a : a + 64]), slots), idf) for a in range(0, len(some), 64)])
        c = _spherical_means(x_of(texts), clusters)
        return pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": range(len(c)), "centroid": [row.astype(np.float32).tobytes() for row in c], "floor": [floors(x_of, c, texts, reject_share, slack).tolist()] * len(c)})

    found = sample.groupBy("lang").applyInPandas(means, "lang string, k int, centroid binary, floor array<double>").collect()
    found.sort(key=lambda r: (r.lang, r.k))
    return LanguageModel([r.lang for r in found], np.array([np.frombuffer(r.centroid, np.float32) for r in found]).reshape(-1, slots), np.array([r.floor for r in found]), idf)


def languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id, lang_pred, score, rejected` for every row of docs: a map over the scan, whole texts, nothing shuffled. Only the text
    is read for a prediction. Repeated ids each get a row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # clusters x languages rows of `slots` numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                langs, score, rejected = held.value.predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)], ["id", "lang_pred", "score", "rejected"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(trimmed(run), f"id {source.schema['id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def with_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with whether each is rejected as its last column, `__lang_rejected`, by a map that carries all columns along. Where a column
    has that name already, the new one has an underscore more."""
    flag = fresh("__lang_rejected", docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col, 1 << 20):
                _, _, rejected = held.value.predict(part.column(part.schema.get_field_index(text_col)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rejected)], [*names, flag])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField(flag, T.BooleanType())]))


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from training: CRC-32 of its id as text, modulo 4, is 2. A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op5_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()))
    found = languages(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
