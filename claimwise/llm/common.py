"""Helpers shared by the operators: the shared folder, written intermediate
tables, flat numpy views of Arrow text, words and hashes.

Text is handled as the UTF-8 buffer of an Arrow column plus offsets, so a
batch of documents costs a few vector operations and no Python strings.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20  # text handled at once inside a task (or one longer document)
TEXT_BYTES = 1 << 18   # the same where some 150 bytes are held for each byte of it


BATCH_ROWS = 1000        # rows that a Python task gets at once


def by_value() -> None:
    """Ship this package's functions with the tasks, so that executors need no
    copy of it, and keep their batches of whole texts small where the session
    has Spark's own setting."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__])
    spark, name = SparkSession.getActiveSession(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark is not None and spark.conf.get(name) == "10000":
        spark.conf.set(name, str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only in local mode with none set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: cuts
    lineage, survives lost executors and fixes what was computed."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SMALL_ROWS = 250_000     # rows of a few numbers that are broadcast at most (some 20 MB)


def if_small(df: DataFrame) -> DataFrame:
    """A written table, marked for a broadcast join when its counted rows are
    few; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def own_names(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns under numbered names that meet no name of an
    operator's own, and the new name of each; ``toDF(*docs.columns)`` gives the old ones back."""
    names = [f"document_column_{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


# ---- flat text -----------------------------------------------------------------

def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_binary(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) else b"")
    _, offs, data = col.buffers()
    if len(col) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offs, np.int32, len(col) + 1, col.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES,
           col: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with at most ``limit`` bytes of text (or one row), with their flat text."""
    for b in batches:
        data, off = flat(b.column(col))
        i, n = 0, b.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
            j = min(j, n)
            yield b.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
            i = j


WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, per
    document, the offsets into them (n + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~WHITE[data]
    first = np.empty(n + 1, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:n])
    first[off] = True            # a document starts anew
    last = np.empty(n, bool)     # position after which a word ends
    np.logical_not(inside[1:], out=last[:-1])
    last[off[off > 0] - 1] = True
    starts = np.flatnonzero(first[:n] & inside)
    ends = np.flatnonzero(last & inside) + 1
    return starts, ends, np.searchsorted(starts, off)


# ---- hashes --------------------------------------------------------------------

_M1, _M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64's), one value to one value."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_KEYS = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
LOWER = np.arange(256)
LOWER[65:91] += 32
LOWER_KEYS = BYTE_KEYS[LOWER]
_BASES = [np.uint64(0x9E6C63D0876A9A35), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)]


class Powers:
    """Powers of an odd base mod 2^64 and of its inverse, grown as needed."""

    def __init__(self, which: int):
        b = int(_BASES[which])
        self.base, self.inverse = np.uint64(b), np.uint64(pow(b, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n + 1:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                a = np.full(n + 1, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.multiply.accumulate(a))
        return self.up, self.down


_POWERS: dict[int, Powers] = {}


def powers(which: int) -> Powers:
    if which not in _POWERS:
        _POWERS[which] = Powers(which)
    return _POWERS[which]


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    """P with P[j] - P[i] the polynomial of values[i:j], shifted by i."""
    up, _ = powers(which).of(len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=out[1:])
    return out


def range_hash(p: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    _, down = powers(which).of(len(p))
    return mix((p[ends] - p[starts]) * down[starts] + (ends - starts).astype(np.uint64) * GOLD)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    return range_hash(prefix((LOWER_KEYS if lower else BYTE_KEYS)[data], 0), starts, ends, 0)


def windows(hashes: np.ndarray, bounds: np.ndarray, k: int, which: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k consecutive words inside a document, at each word
    position that starts one: (positions, hashes)."""
    n = len(hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    full = np.ones(n - k + 1, bool)
    for cut in bounds[1:-1]:
        full[max(0, cut - k + 1):cut] = False
    at = np.flatnonzero(full)
    return at, range_hash(prefix(hashes, which), at, at + k, which)


# ---- sorted integers as Golomb-Rice codes -----------------------------------------

def golomb(values: np.ndarray, universe: int) -> bytes:
    """Strictly increasing integers below ``universe`` as Golomb-Rice codes of
    their gaps: the unary quotients of all, then the remainders of all."""
    n = len(values)
    if n == 0:
        return b""
    v = values.astype(np.uint64)
    gaps = np.empty(n, np.uint64)
    gaps[0] = v[0]
    gaps[1:] = v[1:] - v[:-1] - np.uint64(1)
    k = rice_bits(n, universe)
    q = (gaps >> np.uint64(k)).astype(np.int64)
    stop = np.cumsum(q + 1) - 1
    unary = np.zeros(int(stop[-1]) + 1, np.uint8)
    unary[stop] = 1
    low = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)[None, :]) & np.uint64(1)).astype(np.uint8)
    u = np.packbits(unary).tobytes()
    return len(u).to_bytes(4, "little") + u + np.packbits(low.ravel()).tobytes()


def rice_bits(n: int, universe: int) -> int:
    return max(0, (max(1, universe) // max(1, n)).bit_length() - 1)


def ungolomb(code: bytes, n: int, universe: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint64)
    k = rice_bits(n, universe)
    size = int.from_bytes(code[:4], "little")
    stop = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, 4)))[:n]
    q = np.diff(stop, prepend=-1) - 1
    gaps = q.astype(np.uint64) << np.uint64(k)
    if k:
        low = np.unpackbits(np.frombuffer(code, np.uint8, -1, 4 + size), count=n * k).reshape(n, k)
        gaps |= (low.astype(np.uint64) << np.arange(k, dtype=np.uint64)[None, :]).sum(1, dtype=np.uint64)
    return np.cumsum(gaps + np.uint64(1)) - np.uint64(1)
