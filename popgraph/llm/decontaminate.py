"""Benchmark decontamination by SimHash windows.

A document is read in windows as long (in words) as a benchmark item. Each window's 5-word shingles make a
64-bit SimHash. The items' fingerprints of that length lie in a multi-index: the 64 bits in seven blocks, each
block under every value within two bit flips, so that any fingerprint within RADIUS bits (three times seven,
less one) shares a block entry with the window's. Candidates within RADIUS are verified by the exact weighted
similarity of the two multisets of shingles, sum of minima over sum of maxima. Windows that hold too few
shingles of any item to reach the threshold are not fingerprinted; they can't verify. The multi-index keeps items
sorted by each block's value, once, and windows look up every value within the flips: 36 bytes an item.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

RADIUS = 20
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
FLIPS = RADIUS // len(BLOCKS)
#: Bytes of benchmark text in one broadcast index, which is about three times that; a larger benchmark is matched in
#: parts, one pass each.
PART_BYTES = 16 << 20
#: Places of a text whose windows are fingerprinted at once.
AT_ONCE = 4096
_U = np.uint64
_AT = np.cumsum([0, *BLOCKS])[:-1]
_FLIPPED = [np.array([sum(1 << i for i in c) for k in range(FLIPS + 1) for c in combinations(range(width), k)]) for width in BLOCKS]


def planes(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each shingle's hash."""
    bits = np.unpackbits(C.mix(shingles ^ _U(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def simhash(totals: np.ndarray) -> np.ndarray:
    """64-bit fingerprints of rows of bit totals; a total of 0 counts as 1."""
    return np.packbits(totals >= 0, axis=1, bitorder="little").view(np.uint64).ravel()


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sum of minima and of maxima of two multisets."""
    x, y = Counter(a.tolist()), Counter(b.tolist())
    low = sum(min(n, y[k]) for k, n in x.items())
    return low, len(a) + len(b) - low


def _fingerprints(s: np.ndarray, starts: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(starts, SimHashes) of windows of width shingles; starts ascend, and only shingles near them are looked at, some at a time."""
    k = 0
    while k < len(starts):
        at = starts[k : np.searchsorted(starts, starts[k] + AT_ONCE)]
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(planes(s[at[0] : at[-1] + width]), axis=0, dtype=np.int32)])
        own = at - at[0]
        yield at, simhash(sums[own + width] - sums[own])
        k += len(at)


class Near:
    """Fingerprints of items of one length, by blocks: for each block the items in order of its value, and where each value begins."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints = fingerprints
        self.order, self.begin = [], []
        for at, width in zip(_AT.tolist(), BLOCKS, strict=True):
            value = ((fingerprints >> _U(at)) & _U((1 << width) - 1)).astype(np.int64)
            self.order.append(np.argsort(value, kind="stable").astype(np.int32))
            self.begin.append(np.searchsorted(value[self.order[-1]], np.arange((1 << width) + 1)).astype(np.int32))

    def within(self, fingerprints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place in fingerprints, item) of all that are at most RADIUS bits apart."""
        items = len(self.fingerprints)
        step = max(1, AT_ONCE * 64 // items)
        for k in range(0, len(fingerprints), step):
            f, near = fingerprints[k : k + step], []
            for at, width, order, begin, flipped in zip(_AT.tolist(), BLOCKS, self.order, self.begin, _FLIPPED, strict=True):
                values = ((f >> _U(at)) & _U((1 << width) - 1)).astype(np.int64)[:, None] ^ flipped
                lo = begin[values]
                n = (begin[values + 1] - lo).ravel()
                total = int(n.sum())
                if total:
                    item = order[np.repeat(lo.ravel() - np.cumsum(n) + n, n) + np.arange(total)]
                    window = np.repeat(np.arange(len(f)), n.reshape(len(f), -1).sum(axis=1))
                    ok = np.bitwise_count(self.fingerprints[item] ^ f[window]) <= RADIUS
                    near.append(window[ok] * items + item[ok])
            if near:
                for pair in np.unique(np.concatenate(near)).tolist():
                    yield k + pair // items, pair % items


class Index:
    """Benchmark items by their length in words: ids, shingles, and fingerprints in a multi-index."""

    def __init__(self, ids: list[int], texts: pa.Array):
        own: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)  # length: (item_id, fingerprint, shingles)
        for w in C.words(texts):
            for k, run in enumerate(C.shingle_runs(w)):
                if len(run):
                    own[int(w.first[k + 1] - w.first[k])].append((ids[w.rows[0] + k], int(simhash(planes(run).sum(axis=0)[None])[0]), run.copy()))
        self.items = {size: [(i, run) for i, _, run in x] for size, x in own.items()}
        self.near = {size: Near(np.array([f for _, f, _ in x], _U)) for size, x in own.items()}
        self.shingles = np.unique(np.concatenate([run for x in self.items.values() for _, run in x])) if self.items else np.zeros(0, np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.shingles >> _U(44)).astype(np.int64)] = True

    def holds(self, s: np.ndarray) -> np.ndarray:
        hit = self.seen[(s >> _U(44)).astype(np.int64)]
        at = np.flatnonzero(hit)
        if len(at):
            found = np.minimum(np.searchsorted(self.shingles, s[at]), len(self.shingles) - 1)
            hit[at] = self.shingles[found] == s[at]
        return hit

    def match(self, w: C.Words, s: np.ndarray, hit: np.ndarray, a: int, b: int, threshold: int) -> dict[int, list]:
        """item_id: [best shared, of, first word, words, windows] for the text whose words are a:b."""
        found: dict[int, list] = {}
        long_enough = max(0, b - a - C.SHINGLE_WORDS + 1)
        totals = np.concatenate([[0], np.cumsum(hit[a : a + long_enough])])
        for size in self.items:
            n = b - a
            if n < size:
                continue
            if size >= C.SHINGLE_WORDS:
                width = size - C.SHINGLE_WORDS + 1
                own, total = s[a : b - C.SHINGLE_WORDS + 1], totals
            else:
                width, own = 1, C.grams(w.hash[a:b], size)
                total = np.concatenate([[0], np.cumsum(self.holds(own))])
            starts = np.flatnonzero(total[width:] - total[:-width] >= math.ceil(threshold * width / 100))
            if not len(starts):
                continue
            for at, fingerprints in _fingerprints(own, starts, width):
                for window, i in self.near[size].within(fingerprints):
                    start = int(at[window])
                    item, run = self.items[size][i]
                    low, high = similarity(own[start : start + width], run)
                    if 100 * low >= threshold * high:
                        best = found.setdefault(item, [0, 1, start, size, 0])
                        best[4] += 1
                        if low * best[1] > best[0] * high:
                            best[:4] = [low, high, start, size]
        return found


def _matches(index, threshold: int, batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, dict[int, list]]]:
    """(row, matches) of the rows that match."""
    x = index.value
    for w in C.words(batch.column(text)):
        s = C.grams(w.hash, C.SHINGLE_WORDS)
        hit = x.holds(s)
        per_text = np.concatenate([[0], np.cumsum(hit)])
        short = min(x.items, default=0) < C.SHINGLE_WORDS
        first = w.first
        ends = np.maximum(first[1:] - C.SHINGLE_WORDS + 1, first[:-1])
        some = per_text[np.minimum(ends, len(hit))] > per_text[np.minimum(first[:-1], len(hit))]
        for k in range(len(some)) if short else np.flatnonzero(some):
            if found := x.match(w, s, hit, int(first[k]), int(first[k + 1]), threshold):
                yield w.rows[0] + int(k), found


def _parts(benchmark: DataFrame, item_id: str, text: str, part_bytes: int) -> Iterator[Index]:
    bench = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("item_id is not null and text is not null").distinct()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    for p in range(parts):
        table = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).toArrow()  # part_bytes of text
        yield Index(table.column("item_id").to_pylist(), table.column("text"))


_DDL = "doc_id long, item_id long, similarity double, first_word long, n_words long, n_windows long"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_windows", pa.int64())])


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: int = 75, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document and benchmark item that some window of the document matches.

    Columns: doc_id, item_id, similarity (the best window's), first_word and n_words of that window (the first
    of equals), n_windows that reach the threshold. Null and wordless texts and items match nothing, as do
    texts shorter than the item. An item of fewer than five words is one shingle. Rows that repeat a document
    are each reported; items that repeat count once. Extra columns are not looked at; empty tables give no rows.
    """
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for x in _parts(benchmark, item_id, item_text, part_bytes):
        index = docs.sparkSession.sparkContext.broadcast(x)

        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(row, item, low / high, *rest) for row, found in _matches(index, threshold, batch, "text") for item, (low, high, *rest) in sorted(found.items())]
                if rows:
                    at, *columns = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

        part = docs.mapInArrow(find, _DDL)
        out = part if out is None else out.union(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: int = 75, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, whose text matches no benchmark item.

    Null and wordless texts and items match nothing; repeated rows are judged each; columns may have any names; an
    empty table gives no rows, an empty benchmark all.
    """
    C.small_batches(docs.sparkSession)
    place = docs.columns.index(text)
    for x in _parts(benchmark, item_id, item_text, part_bytes):
        index = docs.sparkSession.sparkContext.broadcast(x)

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[[row for row, _ in _matches(index, threshold, batch, place)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
