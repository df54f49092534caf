"""Packing of tokenised documents into sequences by first-fit decreasing in randomised groups.

Documents are dealt by a hash of their id into groups of about GROUP_BYTES of text; a group is one partition. There each
document is tokenised and cut into full sequences and a remainder, and the remainders, longest first, go each
to the first open sequence with room, found by descending a tournament tree of the sequences' capacities. What
the last, least filled sequences hold is then cut once more to fill what is left open elsewhere.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .token_ids import ids_of

LENGTH = 2048
#: Bytes of text of a group, on average: some four times that is what a task holds.
GROUP_BYTES = 8 << 20
#: Bytes of ids of one batch of pieces, but for the last piece.
OUT_BYTES = 2 << 20
END_ID = 1


class Tournament:
    """Capacities of bins in a complete binary tree; a node holds the largest capacity below it."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """The first bin with room for size, which is taken from it."""
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        best[k] -= size
        bin_ = k - self.leaves
        k //= 2
        while k:
            m = best[2 * k] if best[2 * k] > best[2 * k + 1] else best[2 * k + 1]
            if best[k] == m:
                break
            best[k] = m
            k //= 2
        return bin_


def pack(sizes: list[int], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(bin, offset, piece) of pieces of 1 to length tokens given longest first; bins are numbered as opened."""
    tree, used, out = Tournament(len(sizes), length), {}, []
    for piece, size in enumerate(sizes):
        b = tree.first_fit(size)
        out.append((b, used.get(b, 0), piece))
        used[b] = used.get(b, 0) + size
    return out


def padded(used: int, length: int = LENGTH) -> int:
    """What a sequence of used tokens is stored as: used itself where that is a power of two, else length."""
    return used if used & (used - 1) == 0 else length


def plan(sizes: list[tuple[int, int]], length: int = LENGTH) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece of documents (place, tokens), whatever their order.

    Sequences are numbered from 0. Longest remainders go first, ties by place.
    """
    sequence, rest = 0, []
    for place, n in sizes:
        for start in range(0, n - n % length, length):
            yield place, start, length, sequence, 0
            sequence += 1
        if n % length:
            rest.append((-(n % length), place, n - n % length))
    rest.sort()
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for b, _, piece in pack([-r[0] for r in rest], length):
        size, place, start = rest[piece]
        bins.setdefault(b, []).append((place, start, -size))
    order = sorted(bins.values(), key=lambda own: -sum(p[2] for p in own))
    used = [sum(p[2] for p in own) for own in order]
    # cut the least filled sequences' pieces to fill the others, as long as that empties them
    lo, hi = 0, len(order) - 1
    while lo < hi:
        if used[lo] == length:
            lo += 1
        elif not order[hi]:
            hi -= 1
        else:
            room = length - used[lo]
            place, start, n = order[hi].pop()
            take = min(room, n)
            order[lo].append((place, start, take))
            used[lo] += take
            used[hi] -= take
            if n > take:
                order[hi].append((place, start + take, n - take))
    for own in order:
        offset, left = 0, sum(p[2] for p in own)
        # a last sequence that is not full is cut at powers of two, which need no padding
        room = length if left == length else 1 << max(0, left.bit_length() - 1)
        for place, start, n in own:
            while n:
                take = min(room - offset, n)
                yield place, start, take, sequence, offset
                start, n, offset, left = start + take, n - take, offset + take, left - take
                if offset == room:
                    sequence, offset = sequence + 1, 0
                    room = 1 << max(0, left.bit_length() - 1)


_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group_bytes: int = GROUP_BYTES, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit, little-endian).

    Each document's ids, end_id last, lie in exactly one piece each; the pieces of a sequence follow each other
    from offset 0 without gaps and hold at most length ids. A null or empty text is its end_id alone. Rows that
    repeat a doc_id (or have none) are packed each. Other columns are not looked at. An empty table gives no
    rows. sequence_id is unique over all groups. A group is one partition, of group_bytes of text on average; a
    text is never split over groups.
    """
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    groups = max(1, math.ceil(size / group_bytes))
    end, job = np.array([end_id], "<u4").tobytes(), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, known = TaskContext.get().partitionId(), ids_of(tokenizer, job)
        ids, all_ids = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            all_ids += [x + end for x in known.encode(batch.column(1).fill_null("").to_pylist())]
        # the order in which rows arrive may differ when a task is run again
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is not None, ids[k] or 0, len(all_ids[k]), all_ids[k]))
        rows, size = [], 0
        for p, start, n, sequence, offset in plan([(p, len(all_ids[k]) // 4) for p, k in enumerate(order)], length):
            own = all_ids[order[p]]
            rows.append((ids[order[p]], start, n, len(own) // 4, (group << 40) + sequence, offset, own[4 * start : 4 * (start + n)]))
            size += 4 * n
            if size >= OUT_BYTES:
                yield _pieces(rows)
                rows, size = [], 0
        if rows:
            yield _pieces(rows)

    return docs.repartition(groups, F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")))).mapInArrow(run, _DDL)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)], [x.split()[0] for x in _DDL.split(", ")])
