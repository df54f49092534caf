"""Removal of repeated lines and runs of text by winnowing.

What occurs earlier (in a document of lower id, or further up in the same one) is deleted; the first occurrence
stays. Fingerprints are the minima of windows of hashes, and windows are measured in words. A line of LINE words or
more fills a window by itself, so its hash is a fingerprint. Passages that lie within lines or across them have their
own windows over the lines' words, GRAM at a time: of every RUN - GRAM + 1 consecutive hashes the least is selected,
so that two equal runs of RUN words have the same one.

Fingerprints that occur once rule out their surroundings. Where one repeats, its positions are joined and matches are
extended both ways: from a line over the shorter lines before it and after it, as far as the run of lines from it to
there occurs earlier; from a gram to every RUN-word stretch that it stands for. What is matched to an earlier place
goes. Documents that are equal word for word are settled by one hash before.

Every group is reduced to its least document id by a pre-aggregated minimum, so a line or passage that a third of
all documents share costs one row per occurrence and no pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

RUN, GRAM = 50, 25
#: Words of a line that is a fingerprint by itself.
LINE = 4
#: Rows that a task hands on at once.
OUT_ROWS = 50_000
_LINE_KEY, _BEFORE, _AFTER = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _sliding(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum or maximum of every width neighbours, by doubling."""
    f, n, y = (np.minimum if least else np.maximum), 1, x
    while 2 * n <= width:
        y = f(y[:-n], y[n:])
        n *= 2
    return f(y[: len(y) - (width - n)], y[width - n :]) if width > n else y


def winnow(g: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints: of a text's hashes those that are the least of some width neighbours."""
    pad = np.zeros(width - 1, np.uint64)
    reach = _sliding(np.concatenate([pad, _sliding(g, width, True), pad]), width, False)
    return g[reach == g]


_MARK_DDL = "doc_id long, n_words long, whole long, prints array<long>, again array<long>"


class _Lines:
    """Lines with words of a piece's texts: where their words begin and end, and their hashes. A line ends at a line feed."""

    def __init__(self, w: C.Words, line: int):
        self.line = line
        number = np.searchsorted(np.flatnonzero(w.data == 10), w.start)
        first = np.ones(len(number), bool)
        first[1:] = number[1:] != number[:-1]
        first[w.first[:-1][w.first[:-1] < len(first)]] = True
        self.begin = np.flatnonzero(first)
        self.end = np.append(self.begin[1:], len(number))[: len(self.begin)]
        self.hash = C.spans(w.hash, self.begin, self.end) ^ _LINE_KEY
        self.first = np.searchsorted(self.begin, w.first)  # lines; one more than texts

    def runs(self, k: int, seeds: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of text k: hashes of runs of lines, and the words of the line at the run's far end, counted from base.

        A run is a seed alone, or a seed with the lines on to one after it or back to one before it, of which none is long.
        """
        lo, hi = int(self.first[k]), int(self.first[k + 1])
        at = lo + np.flatnonzero(seeds)
        hashes, ends = [self.hash[at]], [at]
        for step, key in ((1, _AFTER), (-1, _BEFORE)):
            far, g = at, self.hash[at]
            while len(far):
                far = far + step
                ok = (far >= lo) & (far < hi)
                far, g = far[ok], g[ok]
                short = self.end[far] - self.begin[far] < self.line
                far, g = far[short], g[short]
                g = C.mix(g * key + self.hash[far])
                hashes.append(g)
                ends.append(far)
        far = np.concatenate(ends)
        return np.concatenate(hashes), self.begin[far] - base, self.end[far] - base


def _pieces(batch: pa.RecordBatch, column: int, line: int) -> Iterator[tuple[C.Words, _Lines]]:
    for w in C.words(batch.column(column), lower=False):
        yield w, _Lines(w, line)


def _lists(x: list[np.ndarray]) -> pa.Array:
    at = np.cumsum([0, *map(len, x)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(x).view(np.int64)))


def _mark(run: int, gram: int, line: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, whole, prints, again = [], [], [], []
            for w, lines in _pieces(batch, 1, line):
                size, grams = np.diff(w.first), C.rolling(w.hash, gram)
                n += size.tolist()
                whole += [x if m else None for x, m in zip(C.spans(w.hash, w.first[:-1], w.first[1:]).view(np.int64).tolist(), size.tolist(), strict=True)]
                long = lines.end - lines.begin >= line
                for k, m in enumerate(size.tolist()):
                    own = slice(lines.first[k], lines.first[k + 1])
                    found = lines.hash[own][long[own]]
                    if m >= run:
                        found = np.concatenate([found, winnow(grams[w.first[k] : w.first[k + 1] - gram + 1], run - gram + 1)])
                    found = np.sort(found)
                    same = found[1:] == found[:-1]
                    prints.append(found[np.append(True, ~same)] if len(found) else found)
                    again.append(np.unique(found[1:][same]))
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(whole, pa.int64()), _lists(prints), _lists(again)], ["doc_id", "n_words", "whole", "prints", "again"])

    return mark


def _parts(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column without nulls inside its lists."""
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def _stretch(run: int, gram: int, line: int):
    def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hot = _parts(batch.column(2))
            gs, rows, cuts, owns = [], [], [], []

            def full() -> pa.RecordBatch:
                where = batch.column(0).take(pa.array(np.concatenate(rows)))
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(gs).view(np.int64)), where, pa.array(np.concatenate(cuts)), pa.array(np.concatenate(owns))], ["g", "doc_id", "cut", "own"])

            size = 0
            for w, lines in _pieces(batch, 1, line):
                long, grams, runs = lines.end - lines.begin >= line, C.rolling(w.hash, gram), C.rolling(w.hash, run)
                for k in range(len(w.first) - 1):
                    row, base, stop = w.rows[0] + k, int(w.first[k]), int(w.first[k + 1])
                    known = np.sort(hot[at[row] : at[row + 1]].view(np.uint64))

                    def is_hot(x: np.ndarray, known=known) -> np.ndarray:
                        return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x

                    own = slice(lines.first[k], lines.first[k + 1])
                    g, s, e = lines.runs(k, long[own] & is_hot(lines.hash[own]), base)
                    if stop - base >= run:
                        t = np.flatnonzero(is_hot(_sliding(grams[base : stop - gram + 1], run - gram + 1, True)))
                        g, s, e = np.concatenate([g, runs[base + t]]), np.concatenate([s, t]), np.concatenate([e, t + run])
                    if not len(g):
                        continue
                    # what repeats within the text is later there but at its first place, by the place in it
                    order = np.argsort(s, kind="stable")
                    g, s, e = g[order], s[order], e[order]
                    own = np.ones(len(g), bool)
                    own[np.unique(g, return_index=True)[1]] = False
                    for x, y in zip((gs, rows, cuts, owns), (g, np.full(len(g), row), s << 32 | e, own), strict=True):
                        x.append(y)
                    size += len(g)
                    if size >= OUT_ROWS:
                        yield full()
                        size = 0
                        for x in (gs, rows, cuts, owns):
                            x.clear()
            if gs:
                yield full()

    return stretch


_HEAD = re.compile(r"[\x20\x09-\x0D]*")


def _cut(n_columns: int, text: int):
    """Input: the documents' columns, then where stretches begin and end, and the number of words where all go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts, column = batch.column(n_columns), batch.column(text)
            removed = batch.column(n_columns + 1).fill_null(0).to_numpy(zero_copy_only=False).copy()
            all_gone = np.flatnonzero(removed > 0)
            new = {int(k): _HEAD.match(column[int(k)].as_py())[0] for k in all_gone}
            some = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            at, places = _parts(cuts.take(pa.array(some)))
            for w in C.words(column.take(pa.array(some)), lower=False, hashed=False):
                for k in range(len(w.first) - 1):
                    i = w.rows[0] + k
                    first, last, begin, stop = w.first[k], w.first[k + 1], w.text_at[k], w.text_at[k + 1]
                    edge = np.zeros(last - first + 1, np.int64)
                    own = places[at[i] : at[i + 1]]
                    np.add.at(edge, own >> 32, 1)
                    np.add.at(edge, own & 0xFFFFFFFF, -1)
                    keep = np.cumsum(edge)[:-1] == 0
                    removed[some[i]] = len(keep) - keep.sum()
                    # a word goes with the white space after it; that before the first word stays
                    to = np.append(w.start[first:last], stop)
                    turn = np.flatnonzero(np.diff(np.concatenate([[False], keep, [False]]).astype(np.int8)))
                    parts = [w.data[begin : to[0]].tobytes(), *(w.data[to[a] : to[b]].tobytes() for a, b in turn.reshape(-1, 2))]
                    new[int(some[i])] = b"".join(parts).decode()
            if new:
                mask = np.zeros(batch.num_rows, bool)
                order = sorted(new)
                mask[order] = True
                column = pc.replace_with_mask(column, pa.array(mask), pa.array([new[k] for k in order], column.type))
            yield pa.RecordBatch.from_arrays([*(column if i == text else batch.column(i) for i in range(n_columns)), pa.array(removed)], [f"c{i}" for i in range(n_columns + 1)])

    return cut


def repeated_stretches(docs: DataFrame, run: int = RUN, gram: int = GRAM, line: int = LINE) -> DataFrame:
    """docs (doc_id, text) to (doc_id, cuts, whole): where later repeats begin (times 2**32) and end, in words, or how many words there are if all is one."""
    marks = C.materialise(docs.where("doc_id is not null and text is not null").mapInArrow(_mark(run, gram, line), _MARK_DDL), "marks").where("whole is not null")
    long = marks.where(F.col("n_words") >= run)
    firsts = long.groupBy("whole", "n_words").agg(F.min("doc_id").alias("first"))
    placed = marks.join(firsts, ["whole", "n_words"], "left")
    whole = placed.where("doc_id > first").groupBy("doc_id").agg(F.max("n_words").alias("n_words"))
    ahead = placed.where("first is null or doc_id = first")
    prints = ahead.select("doc_id", "again", F.explode("prints").alias("f")).select("doc_id", "f", F.when(F.array_contains("again", F.col("f")), 2).otherwise(1).alias("n"))
    common = prints.groupBy("f").agg(F.sum("n").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi or n > 1").select("f")
    hot = prints.select("doc_id", "f").join(common, "f").groupBy("doc_id").agg(F.collect_set("f").alias("hot"))
    grams = docs.where("text is not null").join(hot, "doc_id").select("doc_id", "text", "hot")
    grams = C.materialise(grams.mapInArrow(_stretch(run, gram, line), "g long, doc_id long, cut long, own boolean"), "stretches")
    least = grams.groupBy("g").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("g", "lo")
    later = grams.where("not own").join(least, "g").where("doc_id > lo").select("doc_id", "cut").union(grams.where("own").select("doc_id", "cut"))
    cuts = later.groupBy("doc_id").agg(F.collect_list("cut").alias("cuts")).join(whole, "doc_id", "left_anti")
    return cuts.withColumn("whole", F.lit(None).cast("long")).union(whole.select("doc_id", F.lit(None).cast("array<long>"), "n_words"))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, gram: int = GRAM, line: int = LINE, removed: str = "removed_words") -> DataFrame:
    """The rows of docs with text less its later repeats, and one more last column: removed (long), the words that went.

    A word (bytes outside white space, case kept) is removed if it lies in a stretch of run consecutive words that
    occurs earlier, by (doc_id, place), or in a line that does and has line words or more. So is a shorter line, if
    it and the nearest long line after or before it, with what is between, occur earlier as a run of lines. Lines end at
    line feeds; only their words count, and those without words are not there. A word goes with the white space
    after it, so a text may end up empty. Null texts and rows without doc_id stay as they are. doc_id is the key: rows
    that repeat one are one document, not later than each other. Further columns are passed on; removed must be a name
    that none of them has. An empty table gives no rows.
    """
    if removed in docs.columns:
        raise ValueError(f"docs has a column {removed} of its own: give another name in removed")
    C.small_batches(docs.sparkSession)
    found = repeated_stretches(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run, gram, line)
    # internal names, so that no column of docs can clash
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    joined = plain.join(found.select(F.col("doc_id").alias("k"), "cuts", "whole"), F.col(f"c{docs.columns.index(doc_id)}").cast("long") == F.col("k"), "left").drop("k")
    n = len(docs.columns)
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema)] + [T.StructField(f"c{n}", T.LongType())])
    return joined.mapInArrow(_cut(n, docs.columns.index(text)), schema).toDF(*docs.columns, removed)
