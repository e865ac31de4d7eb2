"""Helpers shared by the training-data operators.

Everything here works on Arrow buffers so that whole batches of text are hashed
or scanned with numpy instead of row by row.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None

#: Bytes of text that one numpy pass works on; bounds the worker's memory.
CHUNK_BYTES = 1 << 20
#: Identifiers that are sent to every task (about 16 bytes each); more of them are joined by a shuffle.
MOST_IDS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. Where none is set, a temporary one in local mode (tests); on a cluster
    that is an error, as its machines don't share such a folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="ckpt-"))
    return named or sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    last = offsets[-1] if len(offsets) else 0
    return raw[first:last], offsets - first


def slices(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `most` bytes in `column`; a longer text is a run of its own."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = buffers(batch.column(column))
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(n, max(end, start + 1))
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, columns: list[str], fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | StructType, by: str, most: int = CHUNK_BYTES) -> DataFrame:
    """Apply `fn` to Arrow batches of `columns`, sliced by the size of column `by`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, by, most):
                out = fn(part)
                if out.num_rows:
                    yield out
        release()

    return df.select(*columns).mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task no longer uses back to the machine: workers live on, and an executor's bound counts what they keep."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def fresh(docs: DataFrame, name: str) -> str:
    """`name`, with as many underscores as no column of `docs` has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small(ids: DataFrame) -> DataFrame:
    """`ids`, written down and marked for broadcast if it has at most MOST_IDS rows."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= MOST_IDS else ids


def keep_rows(docs: DataFrame, drop_ids: DataFrame) -> DataFrame:
    """Rows of `docs` whose doc_id is not in `drop_ids` (a column doc_id); a null doc_id stays.

    Up to MOST_IDS identifiers no row of `docs` is shuffled.
    """
    name = fresh(docs, "__drop_id")
    return docs.join(small(drop_ids.select(F.col("doc_id").alias(name)).distinct()), F.col("doc_id") == F.col(name), "left_anti")


def splitmix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser that spreads a polynomial hash over all bits."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: ASCII lower case of each byte.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 256), _BASE, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p, dtype=np.uint64)
    return _powers


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all rows, and the first word of each row (one more for the end).

    A word is a run of ASCII letters and digits and of all characters beyond ASCII, in lower case; it
    doesn't cross rows. A null has none.
    """
    data, offsets = buffers(pc.utf8_lower(col))
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), np.zeros(len(offsets), np.int64)
    is_word = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[1:n] = is_word[1:] != is_word[:-1]
    edge[0], edge[n] = is_word[0], is_word[-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    both = cut[is_word[cut] & is_word[cut - 1]]
    marks = np.flatnonzero(edge)
    if len(both):
        both = np.unique(both)
        marks = np.sort(np.concatenate([marks, both, both]), kind="stable")
    starts, ends = marks[0::2], marks[1::2]
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), np.zeros(len(offsets), np.int64)
    lens = ends - starts
    kept = data[is_word]
    first = np.zeros(len(lens), np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    pos = np.arange(len(kept)) - np.repeat(first, lens)
    value = kept.astype(np.uint64)
    value += np.uint64(1)
    value *= powers(int(lens.max()) + 1)[pos]
    return splitmix(np.add.reduceat(value, first)), np.searchsorted(starts, offsets)
