"""Token files: one concatenated id array with Elias-Fano document boundaries, in segments.

A token file is a Parquet folder of segments, each a row: a run of whole documents in ascending doc_id order
with their ids in one array (16 bits each where they fit, else 32), and two Elias-Fano sequences, the documents'
end offsets in that array and their ids. part and segment order the segments. Spark's writer commits whole
tasks, so a lost executor leaves no half segment.

An Elias-Fano sequence of n values up to u keeps the low log2(u/n) bits of each as they are and the rest in
unary, about 2 + log2(u/n) bits a value. The position of every SAMPLE-th one bit is stored: select_() finds the i-th
value from there by popcounts, select_range() a run of values, which is how documents are read back, some at a time.
"""

from __future__ import annotations

import math
import struct
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _common as C
from .token_ids import ids_of

END_ID = 0
SAMPLE = 256
SEGMENT_BYTES = 4 << 20
#: Bytes of text of one part, at most on average: a part is one task.
PART_BYTES = 128 << 20
#: Segments up to which the table of their starts is broadcast (24 bytes each).
BROADCAST_SEGMENTS = 1_000_000
#: Documents of a segment that are read back at once.
READ = 256
_HEAD = struct.Struct("<4sBxxxqqqq")  # magic, low bits, values, least, bytes of low bits, bytes of high bits


def elias_fano(values: np.ndarray) -> bytes:
    """Bytes of a non-decreasing sequence of 64-bit integers."""
    v = np.asarray(values, np.int64)
    n = len(v)
    base = int(v[0]) if n else 0
    off = v.view(np.uint64) - np.uint64(base & (2**64 - 1))
    top = int(off[-1]) if n else 0
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    bits = ((off[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    ones = (off >> np.uint64(low)).astype(np.int64) + np.arange(n)
    unary = np.zeros(-(-(int(ones[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
    unary[ones] = 1
    high = np.packbits(unary, bitorder="little").tobytes()
    return _HEAD.pack(b"EF01", low, n, base, len(lows), len(high)) + lows + high + ones[::SAMPLE].astype("<i8").tobytes()


class EliasFano:
    def __init__(self, data: bytes):
        magic, self.low, self.n, self.base, lows, high = _HEAD.unpack_from(data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano sequence")
        at = _HEAD.size
        self.lows = np.frombuffer(data, np.uint8, lows, at)
        self.high = np.frombuffer(data, "<u8", high // 8, at + lows)
        self.ones = np.frombuffer(data, "<i8", -(-self.n // SAMPLE), at + lows + high)

    def select_(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.ones[i // SAMPLE]), i % SAMPLE
        word, bits = at // 64, int(self.high[at // 64]) >> at % 64 << at % 64
        while left >= (c := bits.bit_count()):
            left -= c
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        place = word * 64 + (bits & -bits).bit_length() - 1
        low = 0
        for b in range(self.low):
            p = i * self.low + b
            low |= (int(self.lows[p >> 3]) >> (p & 7) & 1) << b
        return self.base + ((place - i) << self.low | low)

    def select_range(self, a: int, b: int) -> np.ndarray:
        """Values a to b - 1, from the words of bits that hold them."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        from_, to = int(self.ones[a // SAMPLE]) // 64, -(-b // SAMPLE)
        words = self.high[from_ : int(self.ones[to]) // 64 + 1 if to < len(self.ones) else None]
        at = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")) + 64 * from_
        skip = int(np.searchsorted(at, self.ones[a // SAMPLE])) + a % SAMPLE
        off = (at[skip : skip + b - a] - np.arange(a, b)).astype(np.uint64) << np.uint64(self.low)
        if self.low:
            first = a * self.low
            bits = np.unpackbits(self.lows[first // 8 : -(-(b * self.low) // 8)], bitorder="little")[first % 8 :][: (b - a) * self.low]
            off |= bits.reshape(b - a, self.low).astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return (off + np.uint64(self.base & (2**64 - 1))).view(np.int64)


_SEGMENT_DDL = "part int, segment int, n_docs long, n_ids long, n_null long, width int, ids binary, ends binary, doc_ids binary"


def _segment(part: int, segment: int, doc_ids: list, ids: list[bytes]) -> tuple:
    flat = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(flat) or flat.max() < 1 << 16 else 4
    known = [d for d in doc_ids if d is not None]
    ends = np.cumsum([len(x) // 4 for x in ids])
    return part, segment, len(ids), len(flat), len(doc_ids) - len(known), width, flat.astype(f"<u{width}").tobytes(), elias_fano(ends), elias_fano(np.array(known, np.int64))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, segment_bytes: int = SEGMENT_BYTES, part_bytes: int = PART_BYTES) -> None:
    """Writes the ids of all documents, end_id after each, in ascending doc_id order (nulls first; ties by text).

    A null or empty text is its end_id alone. A document is never split; one longer than a segment is its own.
    Other columns are not looked at. An empty table makes a folder without segments.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    end, job = np.array([end_id], "<u4").tobytes(), uuid.uuid4().hex

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, segment, size, doc_ids, ids = TaskContext.get().partitionId(), 0, 0, [], []

        def full() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(_segment(part, segment, doc_ids, ids), _TYPES, strict=True)], _NAMES)

        known = ids_of(tokenizer, job)
        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), known.encode(batch.column(1).to_pylist()), strict=True):
                if ids and size + len(x) > 2 * segment_bytes:
                    yield full()
                    segment, size, doc_ids, ids = segment + 1, 0, [], []
                doc_ids.append(d)
                ids.append(x + end)
                size += len(x) + 4
        if ids:
            yield full()

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / part_bytes))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    ordered.mapInArrow(encode, _SEGMENT_DDL).write.parquet(path)


_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _SEGMENT_DDL.split(", ")]


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ends, known, none = EliasFano(row["ends"]), EliasFano(row["doc_ids"]), row["n_null"]
            flat = np.frombuffer(row["ids"], f"<u{row['width']}")
            before = 0
            for a in range(0, ends.n, READ):
                b = min(a + READ, ends.n)
                to = ends.select_range(a, b)
                starts = np.concatenate([[before], to[:-1]])
                before = int(to[-1])
                ids = [None] * (min(none, b) - min(none, a)) + known.select_range(max(a - none, 0), max(b - none, 0)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(starts + row["start"]), pa.array(to - starts), pa.array([flat[i:j].astype("<u4").tobytes() for i, j in zip(starts, to, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )


def _find(doc_ids: list[int]):
    """A function for mapInArrow: the rows of these documents, by select_ alone."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ends, known = EliasFano(row["ends"]), EliasFano(row["doc_ids"])
                flat, found = np.frombuffer(row["ids"], f"<u{row['width']}"), []
                for doc_id in doc_ids:
                    k = bisect_left(range(known.n), doc_id, key=known.select_)
                    while k < known.n and known.select_(k) == doc_id:
                        at = k + row["n_null"]
                        lo, hi = ends.select_(at - 1) if at else 0, ends.select_(at)
                        found.append((doc_id, row["start"] + lo, hi - lo, flat[lo:hi].astype("<u4").tobytes()))
                        k += 1
                columns = list(zip(*found)) if found else [[]] * 4
                types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "start", "n_tokens", "ids"])

    return find


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a token file: doc_id, start (ids before it), n_tokens, ids (unsigned 32-bit, little-endian)."""
    return _segments(spark, path).mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids binary")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The rows of read_token_files() of a few documents: sequences are not expanded, only the places asked for."""
    return _segments(spark, path).mapInArrow(_find(sorted(set(doc_ids))), "doc_id long, start long, n_tokens long, ids binary")


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments of a token file, with the ids before each."""
    segments = spark.read.schema(_SEGMENT_DDL).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"), F.count("*").alias("segments"))
    # one row per part: a few numbers for each partition that was written
    base = totals.select("part", "segments", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    own = segments.select("part", "segment", "n_ids").join(base, "part")
    start = own.select("part", "segment", (F.col("base") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment")) - F.col("n_ids")).alias("start"))
    count = segments.agg(F.count("*")).first()[0]
    start = F.broadcast(start) if count <= BROADCAST_SEGMENTS else start
    return segments.join(start, ["part", "segment"])
