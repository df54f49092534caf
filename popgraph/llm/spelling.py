"""Grouping of spelling variants by PartEnum signatures.

A word's letters are a binary vector: its k-th copy of a letter is one dimension. One inserted, deleted or replaced
code point changes two dimensions at most. Dimensions are dealt into three parts by a hash, so two such words agree in
all of one part at least: every choice of a part is enumerated, and the letters in it are a signature.

Anagrams share signatures, so a signature goes with what an edit leaves of the order: of two words of T code points or
of T and T - 1, either what stands before the middle is equal or what stands after it. Words are equi-joined on (T, known
ends, signature) and verified by their edit distance. A key that more than BUCKET words have is cut again: its
unknown middle is halved in the same way, until one code point is unknown and all words of a key are near each other. So no key makes
pairs with the square of its words, and none is dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

LEAST = 7
PARTS = 3
#: Words of one key that are compared with each other; larger keys are cut again.
BUCKET = 32
RATIO = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, word): each maximal run of A-Z, a-z and U+00C0 to U+00FF of least code points or more, A-Z lower-cased.

    Null and empty texts have none. Repeated rows and rows without doc_id count like all others.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1))
    return docs.select(F.col(doc_id).alias("doc_id"), F.explode(found).alias("word")).withColumn("word", F.translate("word", _UPPER, _LOWER))


def count_words(found: DataFrame, least: int = LEAST, at_least: int = 2) -> DataFrame:
    """(word, n): the distinct words of least code points or more that occur at_least times or more over all rows of found."""
    return found.where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _signatures(words: DataFrame) -> DataFrame:
    """(word, n, t, part, sig, a, b): for each length of pair and part the letters in it; nothing of the order is known yet."""
    letters = F.array_sort(F.regexp_extract_all("word", F.lit("(?s)(.)"), F.lit(1)))
    w = words.withColumn("letters", letters)
    dims = F.transform("letters", lambda c, i: F.concat(c, (i - F.array_position("letters", c)).cast("string")))
    w = w.withColumn("dims", dims).drop("letters")

    def letters_of(part: int) -> Column:
        return F.xxhash64(F.lit(part), F.array_join(F.filter("dims", lambda x: F.pmod(F.xxhash64(x), F.lit(PARTS)) == part), ","))

    parts = [letters_of(p) for p in range(PARTS)]
    size = F.length("word")
    w = w.withColumn("sig", F.explode(F.array(*parts))).drop("dims")
    return w.withColumn("t", F.explode(F.array(size, size + 1))).withColumns({"a": F.lit(0), "b": F.lit(0)})


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: with the first half of its unknown middle known, and with the second."""
    middle = F.col("t") - F.col("a") - F.col("b")
    half = F.floor(middle / 2).cast("int")
    ends = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + middle - half).alias("b")))
    return rows.withColumn("end", F.explode(ends)).withColumns({"a": F.col("end.a"), "b": F.col("end.b")}).drop("end")


def _keyed(rows: DataFrame) -> DataFrame:
    known = F.xxhash64("t", "a", "b", "sig", F.substr("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.substr("word", F.length("word") - F.col("b") + 1)).otherwise(""))
    rows = rows.withColumn("key", known)
    return rows.withColumn("c", F.count("*").over(Window.partitionBy("key")))


def _met(rows: DataFrame) -> DataFrame:
    """(x, nx, y, ny) of the near words among those that share a key; of two shorter ones another key has charge."""
    size = F.length("word") == F.col("t")
    x = rows.select("key", F.col("word").alias("x"), F.col("n").alias("nx"), size.alias("fx"))
    y = rows.select("key", F.col("word").alias("y"), F.col("n").alias("ny"), size.alias("fy"))
    return x.join(y, "key").where("fx and (x < y or not fy)").where(F.levenshtein("x", "y", 1) == 1).select("x", "nx", "y", "ny")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(x, nx, y, ny): each pair of words that differ by exactly one inserted, deleted or replaced code point, once.

    words is (word, n), a row a word; a null word is near to none. Any bucket gives the same pairs.
    """
    rows, kept, found = _halved(_signatures(words.where("word is not null").select("word", "n"))), [], None
    while True:
        table = C.Written(_keyed(rows), "spelling-keys")
        kept.append(table)
        small = (F.col("c") <= bucket) | (F.col("t") - F.col("a") - F.col("b") <= 1)
        met = _met(table.df.where(small))
        found = met if found is None else found.union(met)
        large = table.df.where(~small).drop("key", "c")
        if large.isEmpty():
            break
        rows = _halved(large)
    pairs = C.materialise(found.distinct(), "spelling-pairs")
    for table in kept:
        table.drop()
    return pairs


def group_variants(words: DataFrame, ratio: int = RATIO, bucket: int = BUCKET) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n).

    form is the near word of largest n (of equals the first by code points) if that n is ratio times the word's n or
    more, else null; root is what forms lead to, the word itself where there is none. Counts along forms grow ratio-fold, so
    they form no circle, and a few doublings find the root. An empty table gives no rows; further columns are not passed on.
    """
    if ratio < 2:
        raise ValueError("ratio must be two at least")
    words = C.materialise(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_words(words, bucket)
    both = pairs.select(F.col("x").alias("word"), F.col("y").alias("near"), F.col("ny").alias("m")).union(pairs.select("y", "x", "nx"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    out = words.join(best, "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    out = out.select("word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, -F.col("best.m")).alias("form_n"))
    out = C.materialise(out, "spelling-forms")
    most = words.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.floor(math.log(most, ratio)) + 1)
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        onward = roots.select(F.col("word").alias("root"), F.col("root").alias("to"))
        roots = C.materialise(roots.join(onward, "root", "left").select("word", F.coalesce("to", "root").alias("root")), "spelling-roots")
    out = out.join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def crc32_of(*parts: Column) -> Column:
    """Unsigned crc32 of the UTF-8 bytes of the parts' texts joined by colons; a null is empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.crc32(F.concat_ws(":", *texts).cast("binary"))
