"""What the operators of this folder share: tables, cut points, blocks of text in numpy."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..operators.checkpoint import shared_dir

#: White space of `[^\x20\x09-\x0D]+`.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: cuts the lineage, survives lost executors, and tells
    Catalyst the real size, so that a later join is broadcast only if its side is small."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(name: str, columns: list[str]) -> str:
    """name, or, where a column has it, name with underscores after it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


class Block:
    """The texts of an Arrow column as one run of UTF-8 bytes. A null is empty."""

    def __init__(self, column: pa.Array):
        self.null = np.asarray(pc.is_null(column))
        column = pc.fill_null(column.cast(pa.large_string()), "")
        self.n = len(column)
        _, offsets, data = column.buffers()
        off = np.frombuffer(offsets, np.int64, self.n + 1 + column.offset)[column.offset :] if self.n else np.zeros(1, np.int64)
        first, last = int(off[0]), int(off[-1])
        self.off = off - first
        self.buf = np.frombuffer(data, np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.off)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of the words, the index of each document's first word (n + 1 long), and what is not space."""
        n = len(self.buf)
        solid = ~SPACE[self.buf]
        edge = np.zeros(n + 1, bool)
        edge[self.off] = True
        edge[n] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return starts, ends, np.searchsorted(starts, self.off), solid


def joined(buf: np.ndarray, solid: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words as an Arrow array, without a copy for each."""
    off = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=off[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(buf[solid])])


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part holds about `most` bytes of text, or one longer document: bounds the memory."""
    if not batch.num_rows:
        return
    col = batch.column(batch.schema.get_field_index(column))
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(col), 0), dtype=np.int64))
    at, n = 0, batch.num_rows
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, for all i in turn."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    skip = np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + np.arange(total) - skip


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and at a partition's end the worker's free memory goes back to the system: workers live on, and stages differ."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: it keeps its own way

    return whole
