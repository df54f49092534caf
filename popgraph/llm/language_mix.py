"""Languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

Byte trigrams of lower-cased text fall into a fixed number of hashed classes; each language's class
probabilities are counted over all learning documents, in tasks first and then summed. A document is a mixture
of languages. Its set of languages grows from the single likeliest one by the language that would raise the
likelihood fastest; EM finds each set's proportions, and a document's set grows as long as the penalised likelihood
gained by one of the last two steps. The set with the best penalised likelihood is kept, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C

CLASSES = 1 << 15
SMOOTHING = 0.1
ROUNDS = 12
#: Trigrams overlap and repeat within words, so a document tells less than that many independent draws.
DRAWS_PER_TRIGRAM = 0.2
#: Numbers of one table of classes by languages that is worked on at once; a document's is CLASSES by languages at most.
TABLE = 1 << 21
_U = np.uint32
_LETTER = r"\p{L}"


def _classes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Trigram classes of a piece's texts, and where each text's begin; ASCII other than letters is one class of byte."""
    low = _FOLD[data].astype(np.uint32)
    n = len(low)
    if n < 3:
        return np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    code = (low[:-2] << _U(16)) | (low[1:-1] << _U(8)) | low[2:]
    code = (code * _U(2654435761)) >> _U(32 - 15)
    lo, hi = np.minimum(at[:-1], n - 2), np.minimum(np.maximum(at[1:] - 2, at[:-1]), n - 2)
    inside = np.zeros(n - 1, np.int32)
    some = hi > lo
    np.add.at(inside, lo[some], 1)
    np.add.at(inside, hi[some], -1)
    keep = np.cumsum(inside)[: n - 2] > 0
    return code[keep].astype(np.int64), np.concatenate([[0], np.cumsum(np.where(some, hi - lo, 0))])


_FOLD = C._LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalpha()]] = 32


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language and trigram class the number in this task's rows (lang, text)."""
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for a, b, data, at in C.pieces(batch.column(1)):
            code, first = _classes(data, at)
            names = sorted(set(langs[a:b]))
            which = np.repeat(np.array([names.index(x) for x in langs[a:b]]), np.diff(first))
            seen = np.bincount(which * CLASSES + code, minlength=len(names) * CLASSES).reshape(len(names), CLASSES)
            for name, row in zip(names, seen, strict=True):
                totals[name] = totals[name] + row if name in totals else row
    for name, row in totals.items():
        some = np.flatnonzero(row)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(some.astype(np.int32)), pa.array(row[some])], ["lang", "class", "n"])


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        self.names = sorted(counts)
        table = np.array([counts[x] for x in self.names]).reshape(len(self.names), CLASSES) + SMOOTHING
        self.p = np.ascontiguousarray((table / table.sum(axis=1, keepdims=True)).T)  # class by language

    def _em(self, p, n, row, first, allowed, rounds):
        """Proportions (documents by languages) and log likelihoods, with the languages that allowed has.

        A document's distinct classes are one run of rows of p, so that sums over documents are sums over runs.
        """
        share = allowed / allowed.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            part = p * share[row]
            part *= (n / part.sum(axis=1))[:, None]
            share = np.add.reduceat(part, first, axis=0)
            share /= share.sum(axis=1, keepdims=True)
        like = np.add.reduceat(n * np.log((p * share[row]).sum(axis=1)), first)
        return share, like

    def predict(self, code: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, proportion) of each text from its trigram classes; -1 and 0 where it has none."""
        size = np.diff(at)
        lang, score = np.full(len(size), -1), np.zeros(len(size))
        docs = np.flatnonzero(size)
        if not len(docs) or not self.names:
            return lang, score
        key, n = np.unique(np.repeat(np.arange(len(docs)), size[docs]) * CLASSES + code, return_counts=True)
        row = key // CLASSES
        first = np.append(np.searchsorted(row, np.arange(len(docs))), len(row))
        a, most = 0, max(1, TABLE // len(self.names))
        while a < len(docs):
            b = max(a + 1, int(np.searchsorted(first, first[a] + most, "right")) - 1)
            own = slice(first[a], first[b])
            share = self._mixtures(self.p[key[own] % CLASSES], n[own], row[own] - a, first[a:b] - first[a], size[docs[a:b]])
            lang[docs[a:b]], score[docs[a:b]] = share.argmax(axis=1), share.max(axis=1)
            a = b
        return lang, score

    def _mixtures(self, p, n, row, first, size) -> np.ndarray:
        """Proportions (documents by languages) of the sets with the best penalised likelihood."""
        docs, languages = len(first), len(self.names)
        like = np.add.reduceat(n[:, None] * np.log(p), first, axis=0)
        allowed = np.zeros((docs, languages))
        allowed[np.arange(docs), like.argmax(axis=1)] = 1.0
        best = allowed.copy()
        best_cost = -2 * DRAWS_PER_TRIGRAM * like.max(axis=1)
        share, left, found = best.copy(), np.arange(docs), np.ones(docs, int)  # found: the size of the best set so far
        for k in range(2, languages + 1):
            # the slope of the likelihood in each language's proportion
            slope = np.add.reduceat(p * (n / (p * share[row]).sum(axis=1))[:, None], first, axis=0)
            slope[allowed > 0] = -1.0
            allowed[np.arange(len(left)), slope.argmax(axis=1)] = 1.0
            share, like = self._em(p, n, row, first, allowed, ROUNDS)
            draws = DRAWS_PER_TRIGRAM * size[left]
            cost = -2 * DRAWS_PER_TRIGRAM * like + (k - 1) * np.log(np.maximum(draws, 2))
            better = cost < best_cost[left]
            best_cost[left[better]], best[left[better]], found[left[better]] = cost[better], share[better], k
            go = k - found[left] < 2
            if not go.any():
                break
            keep = go[row]
            p, n, row = p[keep], n[keep], (np.cumsum(go) - 1)[row[keep]]
            left, share, allowed = left[go], share[go], allowed[go]
            first = np.searchsorted(row, np.arange(len(left)))
        return best


def fit(docs: DataFrame, lang: str = "lang", text: str = "text") -> Model:
    """Counts trigrams of all rows with a language. What comes back is CLASSES numbers a language at most.

    Null texts and rows without a language are left out, repeated rows count each; an empty table gives a model without languages.
    """
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    table = rows.mapInArrow(_count, "lang string, class int, n long").groupBy("lang", "class").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, np.ndarray] = {}
    names, at, n = table.column(0).to_pylist(), table.column(1).to_numpy(), table.column(2).to_numpy()
    which = np.array(names)
    for name in dict.fromkeys(names):
        counts[name] = np.zeros(CLASSES)
        counts[name][at[which == name]] = n[which == name]
    return Model(counts)


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score.

    lang_pred is the language with the largest proportion and score that proportion. A null text or one without
    a letter is "und" with score 0, as is any text if no language was learnt; a text too short for a trigram is
    the language learnt first by name, with score 0. Other columns are not looked at; an empty table gives no rows.
    """
    C.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(1)
            letters = pc.match_substring_regex(pc.fill_null(texts, ""), _LETTER).to_pylist()
            lang, score = [], []
            for a, b, data, at in C.pieces(texts):
                code, first = _classes(data, at)
                which, share = m.predict(code, first)
                for i in range(b - a):
                    known = bool(letters[a + i]) and bool(m.names)
                    lang.append(m.names[max(which[i], 0)] if known else "und")
                    score.append(float(min(1.0, share[i])) if known else 0.0)
            if lang:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
