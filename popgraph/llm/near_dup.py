"""MinHash near-duplicate groups with Odd sketches.

Each text's set of 5-word shingles is sampled by one-permutation MinHash with optimal densification. Bands of
the samples propose pairs; the samples folded into a parity bitmap (an Odd sketch) estimate a proposed pair's
similarity from the population count of the bitmaps' XOR; pairs that may reach the threshold are confirmed on
the full sets. Groups are the connected components of the confirmed links.

Two further facts are certain and cost no link: sizes bound the similarity, and so does a second bitmap, of all
of a set, since two bitmaps never differ in more bits than their sets do in elements.

Work per group of copies stays linear: equal sets are one class, a bucket links its members to one pivot, and
only members that are still outside a bucket's main component meet others. In a bucket of up to SMALL members they
meet all of these; larger buckets' members are dealt anew by their rarest shingles: a set that reaches the
threshold with another no larger shares one of its rarest n - ceil(t n) + 1 shingles (t the threshold) with one of the
rarest n - ceil(2 t n / (1 + t)) + 1 of the other, so what a family of texts has in common brings none of them together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

BANDS, ROWS = 51, 5
#: Bands whose buckets link each member to a pivot at once; later steps take all bands.
FIRST_BANDS = 6
#: Pivots of its main component that those of a bucket outside it are held against, one after another.
DRAWS = 1
#: Members of a bucket up to which those outside its main component meet all others at once.
SMALL = 64
#: Classes of shingles that are counted to tell rare ones from common ones.
CLASSES = 1 << 20
#: The least threshold, in hundredths, that these bands find with certainty enough.
LEAST_THRESHOLD = 75
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
SKETCH_LONGS = SKETCH_BITS // 64
_U = np.uint64
_EDGES = np.array([(k << 64) // SAMPLES + (k > 0) for k in range(SAMPLES)], np.uint64)
_RNG = np.random.Generator(np.random.PCG64(7))
_PROBES = _RNG.integers(0, SAMPLES, (64, SAMPLES))
_ROW_KEY = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) * _U(2) + _U(1)
_BAND_KEY = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)
_BIN_KEY = _RNG.integers(1, 2**63, SAMPLES, dtype=np.uint64)


def samples(u: np.ndarray) -> np.ndarray:
    """SAMPLES MinHash values of a non-empty sorted set: each bin's least hash, empty bins filled from others.

    An empty bin takes the first filled bin of a fixed random sequence of its own, so that two sets fill it
    from the same bin with the probability of their similarity.
    """
    at = np.searchsorted(u, _EDGES)
    filled = at < np.append(at[1:], len(u))
    donor = np.arange(SAMPLES)
    empty = np.flatnonzero(~filled)
    for probe in _PROBES:
        if not len(empty):
            break
        to = probe[empty]
        ok = filled[to]
        donor[empty[ok]] = to[ok]
        empty = empty[~ok]
    if len(empty):
        full = np.flatnonzero(filled)
        order = C.mix(_BIN_KEY[empty][:, None] ^ (_BIN_KEY[full] * _U(3))[None, :])
        donor[empty] = full[np.argmin(order, axis=1)]
    return u[at[donor]]


def sketch(v: np.ndarray) -> np.ndarray:
    """The samples, each with its bin, folded into a bitmap: a bit is the parity of what falls on it."""
    place = (C.mix(v ^ _BIN_KEY) & _U(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def parity(u: np.ndarray) -> np.ndarray:
    """The whole set folded into a bitmap."""
    place = (C.mix(u ^ _U(0xA5A5A5A5A5A5A5A5)) & _U(SKETCH_BITS - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=SKETCH_BITS) & 1).astype(np.uint8)).view(np.int64)


def bands(v: np.ndarray) -> np.ndarray:
    return C.mix((v.reshape(BANDS, ROWS) * _ROW_KEY).sum(axis=1, dtype=np.uint64) ^ _BAND_KEY).view(np.int64)


#: Columns of the two bitmaps: of the samples, and of the whole set.
_BITS = [f"{x}{i}" for x in "sf" for i in range(SKETCH_LONGS)]
_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64())), *((x, pa.int64()) for x in _BITS)]
)
_SIGNED_DDL = "doc_id long, n_shingles long, set_id binary, bands array<long>, " + ", ".join(f"{x} long" for x in _BITS)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, set_id, band, bits = [], [], [], []
        for w in C.words(batch.column(1)):
            for run in C.shingle_runs(w):
                u = np.unique(run)
                n.append(len(u))
                set_id.append(xxhash.xxh3_128_digest(u.tobytes()))
                if len(u):
                    v = samples(u)
                    band.append(bands(v))
                    bits.append(np.concatenate([sketch(v), parity(u)]))
                else:
                    band.append(np.zeros(0, np.int64))
                    bits.append(np.zeros(2 * SKETCH_LONGS, np.int64))
        if n:
            at = np.concatenate([[0], np.cumsum([len(x) for x in band])]).astype(np.int32)
            rows = np.ascontiguousarray(np.stack(bits).T)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(set_id, pa.binary()), pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(band))), *map(pa.array, rows)],
                schema=_SIGNED,
            )


def _confirm(threshold: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (2, 3):
                column = batch.column(c).dictionary_encode()  # a pivot's text comes with each of its pairs
                sets = [np.unique(run) for w in C.words(column.dictionary) for run in C.shingle_runs(w)]
                sides.append([sets[i] for i in column.indices.to_pylist()])
            keep = []
            for a, b in zip(*sides, strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _near_enough(threshold: int, x: str, y: str):
    """Whether the bitmaps leave room for the threshold.

    Of the samples' bitmaps, five standard deviations below it still pass. Sets that reach it differ in at most
    (1 - j) / (1 + j) of their elements, taken together, and so do their own bitmaps.
    """

    def differ(kind: str):
        return reduce(lambda p, q: p + q, (F.bit_count(F.col(f"{x}.{kind}{i}").bitwiseXOR(F.col(f"{y}.{kind}{i}"))) for i in range(SKETCH_LONGS)))

    least, most = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    j = threshold / 100
    low = F.lit(j - 0.06) - 5 * F.sqrt(F.lit(j * (1 - j)) / F.least(least, F.lit(SAMPLES)))
    bits = SKETCH_BITS / 2 * (1 - F.exp(-(1 - F.greatest(low, F.lit(0.0))) * (4 * SAMPLES / SKETCH_BITS)))
    return (100 * least >= threshold * most) & ((100 + threshold) * differ("f") <= (100 - threshold) * (least + most)) & ((low <= 0) | (differ("s") <= bits))


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of all nodes of links (a, b): component is the least node that is reachable.

    Alternating large-star and small-star steps; each is a grouped minimum and a join, so that a node with very
    many neighbours is pre-aggregated and split. The edges of each round are a written table. With rounds,
    that many: components may then be in parts yet, each with the name of one of its nodes.
    """
    table = C.Written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "links")
    edges = table.df
    measure = F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    state, done = (edges.agg(*measure).first() if rounds is None else None), 0
    while rounds is None or done < rounds:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        m = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(m, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b")).union(m.select("u", "m")).where("a > b").distinct().toDF("u", "v")
        last, table = table, C.Written(small, "links")
        last.drop()
        edges = table.df
        done += 1
        if rounds is None:
            new = edges.agg(*measure).first()
            if new == state:
                break
            state = new
    label = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    if rounds is not None:
        return label
    return label.union(edges.select("v", "v").distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= threshold * |A or B| on their sets of 5-word shingles.
    A null or wordless text has an empty set and is linked with nothing. doc_id is the key: rows that repeat
    one are one document, with the links of all its texts, and all are returned. A row without doc_id is its
    own, with component_id null and kept true. Other columns are not looked at. An empty table gives no rows.
    The bands are made for thresholds of LEAST_THRESHOLD or more; a lower one is an error.
    """
    if not LEAST_THRESHOLD <= threshold <= 100:
        raise ValueError(f"threshold must be {LEAST_THRESHOLD} to 100")
    C.small_batches(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed = C.materialise(docs.mapInArrow(_sign, _SIGNED_DDL), "signed")
    full = signed.where("n_shingles > 0 and doc_id is not null")
    classes = full.groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    reps = full.join(classes, (F.col("doc_id") == F.col("rep")) & (full.set_id == classes.set_id), "left_semi").dropDuplicates(["doc_id", "set_id"])
    reps = reps.select(F.col("doc_id").alias("id"), "set_id", F.col("n_shingles").alias("n"), *_BITS, "bands")

    spread = reps.select("id", F.posexplode("bands").alias("pos", "band"))
    pivots = spread.groupBy("band").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("band", "id"), "id"))["id"].alias("pivot")).where("size > 1")
    members = C.materialise(spread.join(pivots, "band").select("band", "pos", "id", "pivot"), "members")
    sketches = reps.drop("bands")

    def confirm(pairs: DataFrame) -> DataFrame:
        return C.materialise(_confirmed(pairs, docs, threshold), "confirmed")

    def estimated(pairs: DataFrame) -> DataFrame:
        near = pairs.join(sketches.alias("x"), F.col("a") == F.col("x.id")).join(sketches.alias("y"), F.col("b") == F.col("y.id"))
        return C.materialise(near.where(_near_enough(threshold, "x", "y")).select("a", "b").distinct(), "tried")

    def torn(label: DataFrame, draw: int = 0) -> DataFrame:
        """Members of buckets that more than one component has part in, with the largest part and a pivot of it, another for each draw."""
        placed = members.join(label, F.col("id") == F.col("node"), "left").select("band", "id", F.coalesce("component", "id").alias("comp"))
        part = placed.groupBy("band", "comp").agg(F.count("*").alias("size"), F.min(F.struct(F.xxhash64("band", "id", F.lit(draw)), "id"))["id"].alias("pivot"))
        most = part.groupBy("band").agg(F.count("*").alias("parts"), F.sum("size").alias("members"), F.max(F.struct("size", "comp", "pivot")).alias("m")).where("parts > 1")
        return placed.join(most.select("band", "members", F.col("m.comp").alias("main"), F.col("m.pivot").alias("pivot")), "band")

    pair = [F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")]
    # first, a few bands' members with their bucket's pivot
    tried = estimated(members.where(F.col("pos") < FIRST_BANDS).where("id != pivot").select(*pair).distinct())
    links = confirm(tried)
    # then, over all bands, who is not in the component of most of a bucket, with a pivot of that; and again with others
    for draw in range(DRAWS):
        more = estimated(torn(C.materialise(components(links, 2), "labels"), draw).where("comp != main").select(*pair).distinct().join(tried, ["a", "b"], "left_anti"))
        links, tried = links.union(confirm(more)), tried.union(more)
    # last, who is still outside, with others of the bucket
    label = C.materialise(components(links), "labels")
    open_ = C.materialise(torn(label).select("band", "id", "comp", "main", "members"), "open")
    few = C.materialise(open_.where(F.col("members") <= SMALL).join(reps, "id"), "few")
    x, y = few.where("comp != main").alias("x"), few.alias("y")
    met = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.main")) | (F.col("x.id") < F.col("y.id"))) & _near_enough(threshold, "x", "y") & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.band")))  # a pair counts in one of its bands
    met = met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
    many = open_.where(F.col("members") > SMALL).groupBy("id").agg(F.first("comp").alias("comp"), F.max(F.col("comp") != F.col("main")).alias("outside"))
    many = C.materialise(many, "many")
    rest = met if many.isEmpty() else met.union(_share_rare(many, docs, sketches, threshold))
    rest = rest.distinct().join(tried, ["a", "b"], "left_anti")
    links = confirm(C.materialise(rest, "tried"))
    if not links.isEmpty():
        label = C.materialise(components(label.where("node != component").toDF("a", "b").union(links)), "labels")

    own = classes.join(label, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("comp"))
    placed = signed.drop("bands", *_BITS).join(own, "set_id", "left")
    out = placed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (.., text): how many of this task's sets have a shingle in each class."""
    seen = np.zeros(CLASSES, np.int64)
    for batch in batches:
        for w in C.words(batch.column(3)):
            for run in C.shingle_runs(w):
                np.add.at(seen, (np.unique(run) & _U(CLASSES - 1)).astype(np.int64), 1)
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["class", "n"])


_PREFIX_DDL = "id long, comp long, outside boolean, n long, narrow int, whole binary, place int, g long"


def _prefixes(often, threshold: int):
    """Rows (id, comp, outside, text) to the rarest n - ceil(t n) + 1 shingles of each set; narrow is how many of them a smaller set needs."""

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = often.value
        for batch in batches:
            for w in C.words(batch.column(3)):
                rows, n, narrow, whole, gs = [], [], [], [], []
                for k, run in enumerate(C.shingle_runs(w)):
                    u = np.unique(run)
                    if len(u):
                        order = np.lexsort((u, counts[(u & _U(CLASSES - 1)).astype(np.int64)]))
                        gs.append(u[order[: len(u) + 1 + -threshold * len(u) // 100]].view(np.int64))
                        rows.append(w.rows[0] + k)
                        n.append(len(u))
                        narrow.append(len(u) + 1 + -2 * threshold * len(u) // (100 + threshold))
                        whole.append(xxhash.xxh3_128_digest(u.tobytes()))
                if gs:
                    size = np.array([len(x) for x in gs])
                    at = pa.array(np.repeat(np.arange(len(gs)), size))
                    columns = [batch.column(i).take(pa.array(rows)).take(at) for i in range(3)]
                    columns += [pa.array(n, pa.int64()).take(at), pa.array(narrow, pa.int32()).take(at), pa.array(whole, pa.binary()).take(at)]
                    places = np.concatenate([np.arange(x) for x in size]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(places), pa.array(np.concatenate(gs))], [x.split()[0] for x in _PREFIX_DDL.split(", ")])

    return prefixes


def _share_rare(ids: DataFrame, docs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Pairs (a, b) of ids (id, comp, outside) of two components, one of them outside, that share a shingle rare enough in both sets.

    Shingles are ordered by how many sets have one of their class (CLASSES numbers are counted and broadcast), then by hash: any
    order loses no pair, and this one puts what many share last. A pair also needs room for the overlap it must have after the
    shingle's place in either set (its first shared one has it), and bitmaps that leave room for the threshold. Shingles of one
    component alone go before the join, and in it only those outside meet all, so a large component never meets itself.
    """
    spark = docs.sparkSession
    texts = C.materialise(docs.toDF("id", "text").join(ids, "id").select("id", "comp", "outside", "text"), "rest")
    table = texts.mapInArrow(_tally, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toArrow()  # CLASSES rows at most
    counts = np.zeros(CLASSES, np.int64)
    counts[table.column("class").to_numpy()] = table.column("n").to_numpy()
    own = texts.mapInArrow(_prefixes(spark.sparkContext.broadcast(counts), threshold), _PREFIX_DDL).dropDuplicates(["id", "whole", "g"])
    own = C.materialise(own, "prefixes")
    shared = own.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("outside").alias("met")).where("lo < hi and met")
    bits = sketches.select("id", F.col("set_id").alias("whole"), *_BITS)
    own = C.materialise(own.join(shared, "g", "left_semi").join(bits, ["id", "whole"]), "rare")
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    apart = (F.col("x.comp") != F.col("y.comp")) & (F.col("x.n") >= F.col("y.n"))
    on = (F.col("x.g") == F.col("y.g")) & apart & ((100 + threshold) * room >= threshold * (F.col("x.n") + F.col("y.n"))) & _near_enough(threshold, "x", "y")
    small = own.where("place < narrow")
    sides = (own.where("outside"), small), (own.where("not outside"), small.where("outside"))
    pairs = reduce(DataFrame.union, (x.alias("x").join(y.alias("y"), on).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")) for x, y in sides))
    return pairs.distinct()


def _confirmed(pairs: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    a, b = docs.toDF("a", "text_a"), docs.toDF("b", "text_b")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_confirm(threshold), "a long, b long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = 75) -> DataFrame:
    """The rows of docs, with all their columns, less those that near-duplicate an earlier one (a lower doc_id).

    Null and wordless texts and rows without doc_id stay; rows that repeat the id of a document that stays do so too;
    columns may have any names; an empty table gives no rows.
    """
    found = near_duplicates(docs, doc_id, text, threshold)
    gone = found.where("not kept").select(F.col("doc_id").alias(doc_id)).distinct()
    return docs.join(gone, doc_id, "left_anti").select(*docs.columns)
