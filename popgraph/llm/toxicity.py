"""Toxicity by a weighted lexicon, matched by an Aho-Corasick automaton on folded text.

Folding lower-cases, undoes homoglyphs and digit substitutions, and turns punctuation and white space into
single boundaries. The lexicon is learnt: words and beginnings of words that documents labelled toxic hold far
more often than others, weighted by the log of that ratio. Exception phrases (a word of the lexicon with the
word before or after it) that clean documents hold are found in the same way and take the word's weight back.
A document's weight, alone and relative to its length, goes through a fitted logistic function.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

#: Labelled documents that the lexicon is learnt from, at most, by the least hashes of their ids.
FIT_DOCS = 20_000
#: Evidence for an entry: different toxic texts that hold it, its weight, and the share of toxic texts that hold it
#: (an edited copy of a text is a different text, so a large group of copies must not make entries).
LEAST_DOCS, LEAST_WEIGHT, LEAST_SHARE = 5, 2.5, 0.01
#: Letters of the beginnings of words that are tried beside the whole words.
PREFIXES = (4, 5, 6, 7)
#: Terms counted in a task before they are handed on.
TERMS = 100_000
REJECT = 0.5

#: What stands for a Latin letter, by the letter.
HOMOGLYPHS = {
    "a": "аαɑ@4", "b": "Ьβ8", "c": "сϲ", "d": "ԁ", "e": "еε3", "g": "ɡ9", "h": "һ", "i": "іιı1", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοσ0", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ5$", "t": "тτ7", "u": "υս", "v": "ν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ2",
}
def _table() -> dict[int, str]:
    table = {c: " " for c in range(128) if not chr(c).isalnum()}
    table |= {ord(other): letter for letter, others in HOMOGLYPHS.items() for other in others}
    return table | {c: unicodedata.normalize("NFKC", chr(c)).lower() for c in range(0xFF21, 0xFF5B) if chr(c).isalpha()}


_FOLD = _table()


def fold(text: str) -> str:
    """Words of folded text, each with a space before and after it."""
    return f" {' '.join(text.lower().translate(_FOLD).split())} "


def _terms(words: set[str], prefixes: tuple[int, ...] = PREFIXES) -> set[str]:
    """Whole words as " word ", beginnings as " begin"."""
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in prefixes if len(w) > k}


def _count(terms_of):
    """(term, in toxic documents, in others) of this task's rows (text, toxic)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[toxic == 1].update(terms_of(fold(text or "")))
                if len(seen[0]) + len(seen[1]) > TERMS:
                    yield _counted(seen)
                    seen = Counter(), Counter()
        yield _counted(seen)

    return count


def _counted(seen: tuple[Counter, Counter]) -> pa.RecordBatch:
    terms = list(seen[0].keys() | seen[1].keys())
    return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([seen[1][t] for t in terms], pa.int64()), pa.array([seen[0][t] for t in terms], pa.int64())], ["term", "bad", "good"])


@dataclass
class Model:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    logistic: tuple[float, ...] = (-4.0, 1.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for term, w in self.weights.items():
            a.add_word(term, (len(term), w, None))
        for phrase in self.exceptions:
            a.add_word(f" {phrase} ", (len(phrase) + 2, 0.0, phrase))
        a.make_automaton()
        return a

    def features(self, automaton, text: str) -> tuple[float, float]:
        """Log of the matched weight, and the weight per word. A word counts its heaviest entry once."""
        if automaton is None or not text:
            return 0.0, 0.0
        folded = fold(text)
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        for end, (size, weight, phrase) in automaton.iter(folded):
            start = end - size + 1
            if phrase is not None:
                excused.append((start, end))
            elif weight > found.get(start, 0.0):
                found[start] = weight
        for a, b in excused:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        total = sum(found.values())
        return float(np.log1p(total)), total / max(1, folded.count(" ") - 1) * 10

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.logistic[0] + x @ np.array(self.logistic[1:])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> tuple[float, ...]:
    """Coefficients by Newton's method."""
    design = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(w)), design.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, label) of at most most labelled documents, those whose ids have the least hashes: one row for each id.

    Of labels that repeat an id the greatest counts, of documents that do the one whose text sorts first.
    """
    ids = labels.select(F.col(doc_id).cast("long").alias("k"), F.col(label).alias("y")).where("k is not null and y is not null").groupBy("k").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("k"), "k").limit(most)
    # at most `most` rows of two numbers
    rows = docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("text")).join(F.broadcast(ids), "k")
    return rows.groupBy("k").agg(F.min("text").alias("text"), F.first("y").cast("int").alias(label)).select("text", label)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", fit_docs: int = FIT_DOCS,
    least_docs: int = LEAST_DOCS, least_weight: float = LEAST_WEIGHT, least_share: float = LEAST_SHARE, prefixes: tuple[int, ...] = PREFIXES, exceptions: tuple[str, ...] = (),
) -> Model:
    """Learns from the documents that labels (doc_id, label 0/1) names, at most fit_docs of them.

    All terms with enough evidence become entries, however many they are; texts that repeat count once. exceptions
    are phrases known beforehand to be harmless. Null texts are empty; other columns are not looked at. Without
    labelled rows of both kinds the lexicon is empty and every score is low.
    """
    C.small_batches(docs.sparkSession)
    rows = C.materialise(sample(docs, labels, label, fit_docs, doc_id, text), "labelled")
    once = rows.dropDuplicates(["text", label])
    n_bad, n_good = once.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) != 1)).first()
    if not n_bad or not n_good:
        return Model({})
    ddl = "term string, bad long, good long"
    ratio = F.log((F.col("bad") + 0.5) / (n_bad + 1)) - F.log((F.col("good") + 0.5) / (n_good + 1))
    counts = once.mapInArrow(_count(lambda f: _terms(set(f.split()), prefixes)), ddl).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    sure = (F.col("bad") >= max(least_docs, least_share * n_bad)) & (F.col("w") >= least_weight)
    # an entry takes least_docs of the distinct terms of at most fit_docs texts, so their number is bounded
    best = counts.withColumn("w", ratio).where(sure).orderBy(F.desc(F.col("w") * F.col("bad")), "term")
    weights: dict[str, float] = {}
    for term, _, _, w in best.collect():
        # an entry whose beginning is there with no less weight adds nothing
        if not any(weights.get(term[:k], -1.0) >= w for k in range(2, len(term))):
            weights[term] = w
    model = Model(weights)
    longest = max(map(len, weights), default=0)

    def phrases(folded: str) -> set[str]:
        words = folded.split()
        hit = [any(f" {w} "[:k] in weights for k in range(2, min(len(w) + 2, longest) + 1)) for w in words]
        return {f"{a} {b}" for a, b, p, q in zip(words, words[1:], hit, hit[1:], strict=False) if p or q}

    around = once.mapInArrow(_count(phrases), ddl).groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    excuses = around.withColumn("w", ratio).where((F.col("good") >= least_docs) & (F.col("w") < 0)).select("term")
    model.exceptions = sorted({*(fold(x).strip() for x in exceptions), *(r["term"] for r in excuses.collect())})
    seen = _scored(rows.withColumn("k", F.lit(0).cast("long")).select("k", "text", label), model, raw=True).toArrow()  # three numbers a labelled row
    x = np.column_stack([seen.column(1).to_numpy(), seen.column(2).to_numpy()])
    y = seen.column(3).to_numpy()
    model.logistic = _logistic(x, (y == 1).astype(float))
    return model


def _scored(rows: DataFrame, model: Model, raw: bool = False) -> DataFrame:
    """rows (k, text, ...) to (k, score), or with raw to (k, x1, x2, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([model.features(automaton, t) for t in batch.column(1).to_pylist()]).reshape(-1, 2)
            if raw:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1]), batch.column(2)], ["k", "x1", "x2", "y"])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], ["k", "score"])

    return rows.mapInArrow(run, "k long, x1 double, x2 double, y int" if raw else "k long, score double")


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1). Null and empty texts match nothing and score low.

    Other columns are not looked at; repeated rows are scored each; an empty table gives no rows.
    """
    C.small_batches(docs.sparkSession)
    return _scored(docs.select(F.col(doc_id).cast("long").alias("k"), F.col(text).alias("text")), model).withColumnRenamed("k", "doc_id")


def drop_toxic(docs: DataFrame, model: Model, text: str = "text", reject: float = REJECT) -> DataFrame:
    """The rows of docs, with all their columns, that score below reject.

    Null and empty texts score low and stay; repeated rows are judged each; columns may have any names; an empty
    table gives no rows.
    """
    C.small_batches(docs.sparkSession)
    place = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            x = np.array([model.features(automaton, t) for t in batch.column(place).to_pylist()]).reshape(-1, 2)
            yield batch.filter(pa.array(model.score(x) < reject))

    return docs.mapInArrow(keep, docs.schema)
