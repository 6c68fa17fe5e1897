"""Vectorised text kernels that work on Arrow buffers, and session helpers.

A word is a maximal run of bytes that are not ASCII white space (``\\t \\n \\v \\f
\\r`` and space). Nothing here builds Python strings for words: a slice of a few
MB of UTF-8 is hashed with prefix sums, so memory stays bounded whatever the
batch size, and long documents are never truncated.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Lower-cases ASCII letters and turns ASCII punctuation and control bytes into spaces.
NORMAL = np.arange(256, dtype=np.uint8)
NORMAL[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that checkpoints have a folder: the session's, or in local mode a temporary one, removed at the end of the process."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="synapta-")
        atexit.register(shutil.rmtree, shared, True)
    sc.setCheckpointDir(shared)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through files that outlive any executor."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write as Parquet to the folder of checkpoints, and read it again: (the table, its path)."""
    spark = df.sparkSession
    checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    while len(_pow[0]) < n:
        k = len(_pow[0])
        for j, b in enumerate((_BASE, _INV)):
            step = np.uint64(pow(int(b), k, 1 << 64))
            _pow[j] = np.concatenate([_pow[j], _pow[j] * step])
    return _pow[0], _pow[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An identifier of the ordered pair (a, b)."""
    x = (a * np.uint64(0xD6E8FEB86659FD93) + b) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def slices(column: pa.Array, limit: int = SLICE_BYTES):
    """Yield (first row, bytes, offsets) over runs of rows of about ``limit`` bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def normalised(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with ASCII and Latin-1 letters in lower case and ASCII punctuation as spaces."""
    low = NORMAL[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    low[at] += 0x20
    return low


def words(data: np.ndarray, offs: np.ndarray, normal: bool = False):
    """Return (start byte, end byte, document, hash) of every word; with ``normal`` case and punctuation are dropped."""
    if normal:
        data = normalised(data)
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    p, q = powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
    h = (total[ends] - total[starts]) * q[starts]
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(np.searchsorted(starts, offs)))
    return starts, ends, doc, mix(h ^ (ends - starts).astype(np.uint64))


def first_words(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each document's words begin; one more entry for the end."""
    return np.searchsorted(doc, np.arange(n + 1))


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs in document order, and how often each occurs."""
    if not len(h):
        return doc, h, np.zeros(0, np.int64)
    order = np.argsort(h, kind="stable")
    order = order[np.argsort(doc[order].astype(np.int32), kind="stable")]
    d, x = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (x[1:] != x[:-1])]))
    return d[new], x[new], np.diff(np.append(new, len(d)))


def long_ids(column: pa.Array) -> pa.Array:
    """Identifiers as 64-bit integers; null stays null."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64())
