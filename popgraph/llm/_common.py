"""Helpers that several operators of this subpackage share: written tables, vectorised words and shingles, hashes.

Words are maximal runs of bytes outside 0x20 and 0x09-0x0D, with A-Z lower-cased. Hashes are 64 bits wide and
the same in every process. Everything here works on one Arrow batch at a time, in pieces of a few MB.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE_WORDS = 5
#: Bytes of text that are hashed at once; a longer document makes a piece of its own.
PIECE_BYTES = 1 << 20
#: Bytes of one Arrow batch, but for a row that is longer by itself.
BATCH_BYTES = 4 << 20


# -- written tables --------------------------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from the session; one of our own only in local mode, where there is one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def sweep(spark: SparkSession) -> None:
    """Deletes all that this application's operators wrote to the shared folder; for when their results are stored elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")


def small_batches(spark: SparkSession) -> None:
    """Holds the Arrow batches that tasks hand to Python to BATCH_BYTES, for the session, where they may be larger."""
    now = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64m").lower()
    n, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", now).groups()
    if not 0 < int(n) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Written:
    """A table in the shared folder. df reads it; drop() deletes it, once nothing that is still to run reads it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        small_batches(self.spark)
        self.path = shared_path(self.spark, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        _delete(self.spark, self.path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lost executors can't take it away, and its lineage is cut."""
    return Written(df, name).df


# -- held-out rows ---------------------------------------------------------------------------------


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text is divisible by 5: these rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fold_of(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


# -- words and shingles ----------------------------------------------------------------------------

_U = np.uint64
_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RNG = np.random.Generator(np.random.PCG64(20260101))
_BYTE_KEY = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_KEY_LOWER = _BYTE_KEY[_LOWER]
_PLACE = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C13
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power(base: int, n: int) -> np.ndarray:
    """The first n powers; those for a piece of the usual size are kept."""
    if n <= PIECE_BYTES and base in _powers:
        return _powers[base][:n]
    p = np.full(max(n, PIECE_BYTES), base, np.uint64)
    p[0] = 1
    p = np.multiply.accumulate(p)
    if n <= PIECE_BYTES:
        _powers[base] = p
    return p[:n]


@dataclass
class Words:
    """Words of the texts rows[0]:rows[1]: byte ranges in data, hashes, and where each text's words begin."""

    rows: tuple[int, int]
    data: np.ndarray
    text_at: np.ndarray  #: bytes; one more than texts
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  #: words; one more than texts


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def pieces(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row range, bytes and offsets of runs of whole texts of about PIECE_BYTES."""
    at, data = text_buffers(texts)
    n, a = len(at) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(at, at[a] + PIECE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def words(texts: pa.Array, lower: bool = True, hashed: bool = True) -> Iterator[Words]:
    """Words of runs of whole texts; without hashes (0 each) where only their places are asked for."""
    for a, b, data, at in pieces(texts):
        n = len(data)
        inside = _WORD[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = at[1:-1]
        edge = edge[(edge > 0) & (edge < n)]
        begins[edge] |= inside[edge]
        ends[edge - 1] |= inside[edge - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if not hashed:
            yield Words((a, b), data, at, start, end, np.zeros(len(start), np.uint64), np.searchsorted(start, at))
            continue
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_KEY_LOWER if lower else _BYTE_KEY)[data] * _power(_BASE, n), out=total[1:])
        h = (total[end] - total[start]) * _power(_BASE_INVERSE, n)[start] if n else np.zeros(0, np.uint64)
        yield Words((a, b), data, at, start, end, mix(h + (end - start).astype(np.uint64)), np.searchsorted(start, at))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words of h; those that cross from one text to the next are the caller's to skip."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    if k <= len(_PLACE):
        s = h[: len(h) - k + 1] * _PLACE[0]
        for j in range(1, k):
            s = s + h[j : len(h) - k + 1 + j] * _PLACE[j]
        return mix(s + _U(k))
    raise ValueError(f"at most {len(_PLACE)} words")


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """As grams(), for long runs: one pass, whatever k is."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _power(_BASE, n), out=total[1:])
    return mix((total[k:] - total[:-k]) * _power(_BASE_INVERSE, n)[: n - k + 1] + _U(k))


def spans(h: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each run of words begin:end."""
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _power(_BASE, len(h)), out=total[1:])
    return mix((total[end] - total[begin]) * _power(_BASE_INVERSE, len(h) + 1)[begin] + (end - begin).astype(np.uint64))


def shingle_runs(w: Words, k: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text the hashes of its k-word shingles in order; fewer words make one shingle, no word makes none."""
    s = grams(w.hash, k)
    for i in range(len(w.first) - 1):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= k:
            yield s[a : b - k + 1]
        elif b > a:
            yield grams(w.hash[a:b], int(b - a))
        else:
            yield s[:0]
