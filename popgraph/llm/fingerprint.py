"""Document fingerprints by one-permutation MinHash, in DataFrame functions alone.

Each 5-word shingle is hashed once to 64 bits. The top bits name one of BINS bins, and a bin keeps its least
hash: the hashes are sorted together with one mark per bin that is greater than all its hashes, so the first
entry of each bin is its minimum or the mark of an empty bin. Empty bins are filled by optimal densification:
bin k looks at bins h(k, 1), h(k, 2), ... of a fixed hash h until one is filled. BITS low-order bits of
each bin's hash are stored, a hexadecimal digit a bin. Unrelated bins agree once in 2**BITS, which likeness() takes out.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

BINS, BITS = 256, 4
_SHIFT = 64 - 8
#: Bins that an empty bin looks at in turn; where all are empty, the filled bin with the least hash for it is taken.
PROBES = 6
#: Documents of one range of ids that are brought together to find each one's neighbour.
RANGE_DOCS = 2048
#: Ranges or cells up to which their table is broadcast (some 100 bytes each).
BROADCAST_RANGES = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _marks() -> Column:
    """The greatest 64-bit integer of each bin, by signed order of the top bits."""
    return F.array(*[F.lit(((k - BINS // 2 + 1) << _SHIFT) - 1) for k in range(BINS)])


def _probe_table(j: int) -> Column:
    draw = random.Random(1000 + j)
    return F.array(*[F.lit(draw.randrange(BINS)) for _ in range(BINS)])


def with_fingerprint(df: DataFrame, text: str, name: str, shingle_words: int = C.SHINGLE_WORDS) -> DataFrame:
    """df and a column name: the fingerprint of column text, BINS hexadecimal digits.

    Words are runs of other than white space, A-Z lower-cased. Fewer than shingle_words words are one shingle;
    null and wordless texts have the fingerprint "". Equal texts have equal fingerprints.
    """
    w, h, m, s = (f"__{name}_{x}" for x in "whms")
    columns = df.columns
    k = shingle_words
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    df = df.withColumn(w, F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda x: x != ""))
    df = df.withColumn(w, F.transform(w, lambda x: F.xxhash64(x)))
    n = F.size(w)
    several = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(F.col(w), i + j) for j in range(k)]))
    one = F.array(F.xxhash64(F.col(w), n))
    df = df.withColumn(h, F.when(n >= k, several).when(n > 0, one))
    df = df.withColumn(s, F.sort_array(F.concat(F.col(h), _marks())))
    same = lambda x, y: F.shiftright(x, _SHIFT) == F.shiftright(y, _SHIFT)
    df = df.withColumn(m, F.filter(s, lambda x, i: (i == 0) | ~same(x, F.get(F.col(s), i - 1))))
    below = F.lit((1 << _SHIFT) - 1)
    df = df.withColumn(m, F.transform(m, lambda x: F.when(x.bitwiseAND(below) != below, x)))
    tables = [_probe_table(j) for j in range(PROBES)]
    filled = lambda i: F.array_min(  # noqa: E731  for the few bins whose probes all fail
        F.transform(F.filter(F.col(m), lambda y: y.isNotNull()), lambda y: F.struct(F.xxhash64(i, F.shiftright(y, _SHIFT)).alias("a"), y.alias("b")))
    )["b"]
    dense = F.transform(m, lambda x, i: F.coalesce(x, *[F.get(F.col(m), F.get(t, i)) for t in tables], filled(i)))
    # a bin's digit is one of 14 by its number: bins that were filled from the same one don't all agree by chance
    low = lambda x, i: F.call_function("shiftright", x, (i % (_SHIFT // BITS)) * BITS).bitwiseAND(F.lit((1 << BITS) - 1))
    digits = F.transform(dense, lambda x, i: F.lower(F.hex(low(x, i))))
    df = df.withColumn(name, F.when(n > 0, F.array_join(digits, "")).otherwise(F.lit("")))
    return df.select(*columns, name)


def likeness(a: str | Column, b: str | Column) -> Column:
    """Estimated similarity of the shingle sets behind two fingerprints, 0 to 1: two empty ones are alike, one is not."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    chance = 2.0**-BITS
    x, y = F.split(a, ""), F.split(b, "")
    agree = F.aggregate(F.zip_with(x, y, lambda p, q: F.when(p == q, 1).otherwise(0)), F.lit(0), lambda t, v: t + v)
    estimate = (agree / BINS - chance) / (1 - chance)
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def _ranged(docs: DataFrame, doc_id: str, range_docs: int, levels: int = 6) -> DataFrame:
    """docs with __range, an array of numbers that ascends with doc_id: ranges of about range_docs rows, whatever the ids.

    Ids are cut into cells of equal width, as many as give range_docs rows each if ids were even; cells that hold
    over four times that are cut in the same way by what they hold, and so on. Only ids are read for that, and
    counts per cell are what is shuffled. After levels cuts (each divides by the number of rows) a cell stays as it is.
    """
    start = F.array(F.when(F.col(doc_id).isNull(), F.lit(-1)).otherwise(F.lit(0)).cast("long"))
    docs = docs.withColumn("__range", start)
    ids = docs.select(F.col(doc_id).alias("__id"), "__range").where("__id is not null")
    for depth in range(1, levels + 1):
        cells = ids.where(F.size("__range") == depth).groupBy("__range").agg(F.min("__id").alias("__lo"), F.max("__id").alias("__hi"), F.count("*").alias("__n"))
        dense = C.materialise(cells.where((F.col("__n") > 4 * range_docs) & (F.col("__hi") > F.col("__lo"))), "cells")
        count = dense.count()
        if not count:
            break
        width = F.ceil((F.col("__hi").cast("decimal(20,0)") - F.col("__lo") + 1) * range_docs / F.col("__n"))
        dense = dense.select(F.col("__range").alias("__cell"), "__lo", width.cast("decimal(20,0)").alias("__width"))
        dense = F.broadcast(dense) if count < BROADCAST_RANGES else dense
        docs, ids = _cut(docs, doc_id, dense), _cut(ids, "__id", dense)
    return docs


def _cut(rows: DataFrame, doc_id: str, dense: DataFrame) -> DataFrame:
    """rows whose __range is a cell of dense with a further number in it: which part of the cell they are in."""
    columns = rows.columns
    part = F.floor((F.col(doc_id).cast("decimal(20,0)") - F.col("__lo")) / F.col("__width")).cast("long")
    longer = F.when(F.col("__cell").isNull(), F.col("__range")).otherwise(F.concat("__range", F.array(part)))
    return rows.join(dense, F.col("__range") == F.col("__cell"), "left").withColumn("__range", longer).select(*columns)


def with_next(docs: DataFrame, doc_id: str, columns: list[str], range_docs: int = RANGE_DOCS, add=None) -> DataFrame:
    """docs (doc_id and columns) with next_<column> of the row that follows by ascending doc_id; the first follows the last.

    Ids are cut into ranges of about range_docs rows. The first row of a range also goes to the range before,
    so that each range finds all its neighbours by a window of its own; nothing is sorted as a whole.
    Rows that repeat an id follow each other in the order of columns; nulls come first. add(df) may append
    columns once rows are where they belong and before they are shuffled; they get their next_ as well.
    """
    ranged = _ranged(docs.select(doc_id, *columns), doc_id, range_docs)
    # one row for each range: its least id, and the range before, by windows over the ranges of one cell of the first cut
    heads = ranged.groupBy("__range").agg(F.min(doc_id).alias("__first")).withColumn("__cell", F.slice("__range", 1, 2))
    own = Window.partitionBy("__cell")
    heads = heads.withColumn("__before", F.lag("__range").over(own.orderBy("__range")))
    # one row for each such cell: the cell before ends with its last range
    cells = heads.groupBy("__cell").agg(F.max("__range").alias("__end"))
    first = Window.orderBy("__cell")
    cells = cells.select("__cell", F.lag("__end").over(first).alias("__lead"), F.last("__end").over(first.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__last"))
    heads = heads.join(cells, "__cell")
    heads = heads.select("__range", "__first", F.coalesce("__before", "__lead", "__last").alias("__to"), F.coalesce("__before", "__lead").isNull().alias("__wrap"))
    heads = C.materialise(heads, "heads")
    if heads.count() < BROADCAST_RANGES:
        heads = F.broadcast(heads)
    halo = ranged.join(heads, ["__range"]).where(F.col(doc_id).eqNullSafe(F.col("__first")))
    halo = halo.select(doc_id, *columns, F.col("__to").alias("__range"), F.when(F.col("__wrap"), 2).otherwise(1).alias("__extra"))
    both = ranged.select(doc_id, *columns, "__range", F.lit(0).alias("__extra")).union(halo)
    if add is not None:
        both = add(both)
        columns = [c for c in both.columns if c not in (doc_id, "__range", "__extra")]
    by = Window.partitionBy("__range").orderBy("__extra", F.col(doc_id).asc_nulls_first(), *columns)
    out = both.select(doc_id, *columns, "__extra", *[F.lead(c).over(by).alias(f"next_{c}") for c in columns])
    return out.where("__extra = 0").drop("__extra")


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose last floor(n_chars / 2) code points are replaced by the first as many (or
    all) of the next document's, by ascending doc_id, after the last the first. Null texts count as empty.
    Other columns are not looked at; an empty table gives no rows; a lone document is its own next.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", ["text"], add=lambda df: with_fingerprint(df, "text", "fingerprint"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    docs = docs.select("doc_id", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)).alias("edited"), "fingerprint", "next_fingerprint")
    docs = with_fingerprint(docs, "edited", "edited_fingerprint")
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"),
    )
