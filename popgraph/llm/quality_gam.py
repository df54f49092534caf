"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is binned; the score is the sum of one number per feature's bin and per pair of bins of
some pairs of features, through a logistic function. The tables are learnt by cyclic boosting: round after round
each feature in turn gets a shallow tree over its bins, fitted to the gradient and added at a small rate; then
the pairs that explain most of what is left get trees over two features in the same way. Scoring adds table
entries, a whole batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as C
from .toxicity import sample

#: Labelled documents to fit on, at most, by the least hashes of their ids; their features, not texts, are brought together.
FIT_DOCS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 150, 60, 0.15, 4

_ASCII_KINDS = {
    "upper": [*range(65, 91)],
    "digit": [*range(48, 58)],
    "stop": [*b".,;:?"],
    "bang": [*b"!"],
    "bar": [*b"|"],
    "mark": [*b"#$%&*@^~+=<>_\\/"],
    "quote": [*b"\"'`()[]{}-"],
    "line": [10],
    "space": [32, 9, 13],
    "control": [*range(0, 9), 11, 12, *range(14, 32), 127],
}
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "word_bytes_sd", "distinct", "repeat_next", "repeat_second", "top_word", "repeat_gram",
    "words_a_line", "long_words", "one_byte_words", *_ASCII_KINDS, "other_bytes", "upper_words", "mark_words", "upper_run", "mark_run",
)
_KIND = np.zeros(256, np.uint8)
for _i, _k in enumerate(_ASCII_KINDS.values()):
    _KIND[_k] = _i + 1
_KIND[128:] = len(_ASCII_KINDS) + 1
_KINDS = len(_ASCII_KINDS) + 2


def _window_max(x: np.ndarray, width: int) -> float:
    """Largest mean of width neighbours."""
    if not len(x):
        return 0.0
    t = np.concatenate([[0], np.cumsum(x)])
    w = min(width, len(x))
    return float((t[w:] - t[:-w]).max()) / w


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; nulls are empty."""
    out = []
    for w in C.words(texts, lower=False):
        kind = _KIND[w.data]
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        mark = np.concatenate([[0], np.cumsum((kind >= 4) & (kind <= 6))])
        size = (w.end - w.start).astype(float)
        upper_word = (upper[w.end] - upper[w.start]) > 0.6 * size
        mark_word = (mark[w.end] - mark[w.start]) > 0
        grams = C.grams(w.hash, 3)
        for i in range(len(w.first) - 1):
            a, b, lo, hi = w.first[i], w.first[i + 1], w.text_at[i], w.text_at[i + 1]
            h, n, length = w.hash[a:b], int(b - a), int(hi - lo)
            share = np.bincount(kind[lo:hi], minlength=_KINDS)[1:] / max(1, length)
            if n:
                _, times = np.unique(h, return_counts=True)
                g = np.unique(grams[a : b - 2]) if n > 2 else h[:1]
                s = size[a:b]
                own = [
                    s.mean(), s.std(), len(times) / n, (h[1:] == h[:-1]).mean() if n > 1 else 0.0, (h[2:] == h[:-2]).mean() if n > 2 else 0.0, times.max() / n,
                    1 - len(g) / max(1, n - 2), n / (1 + np.count_nonzero(w.data[lo:hi] == 10)), (s > 15).mean(), (s == 1).mean(),
                ]
                runs = [upper_word[a:b].mean(), mark_word[a:b].mean(), _window_max(upper_word[a:b], 20), _window_max(mark_word[a:b], 20)]
            else:
                own, runs = [0.0] * 10, [0.0] * 4
            out.append([np.log1p(length), np.log1p(n), *own, *share, *runs])
    return np.array(out, float).reshape(-1, len(FEATURES))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float = 1.0) -> np.ndarray:
    """Values per bin of a tree of few leaves over ordered bins, from sums of gradients g and Hessians h."""
    cuts, gt, ht = [0, len(g)], np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gt[b] - gt[a]) ** 2 / (ht[b] - ht[a] + smooth)
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gains = gain(a, m) + gain(m, b) - gain(a, b)
                k = int(gains.argmax())
                best = max(best, (float(gains[k]), int(m[k])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (gt[b] - gt[a]) / (ht[b] - ht[a] + smooth)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, smooth: float = 1.0) -> tuple[np.ndarray, float]:
    """Values of a tree over two features' bins: one cut of one, then one of the other on either side; and its gain."""
    best = (np.zeros_like(g), 0.0)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                gs, hs = gg[part].sum(axis=0), hh[part].sum(axis=0)
                v = _tree(gs, hs, 2, smooth)
                out[part] = v
                gain += float((v * gs).sum())
            if gain > best[1]:
                best = (out.T if flip else out, gain)
    return best


@dataclass
class Model:
    edges: list[np.ndarray]
    coarse: list[np.ndarray]  #: of each fine bin, the bin that pairs use
    base: float
    tables: np.ndarray  #: features by bins
    pairs: list[tuple[int, int, np.ndarray]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def raw(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for j, table in enumerate(self.tables):
            z += table[b[:, j]]
        for i, j, table in self.pairs:
            z += table[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(self.bins(x)), -30, 30)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, pairs: int = PAIRS, rate: float = RATE) -> Model:
    """Fits features x and labels y (0 or 1) on one machine; x is bounded by the size of the sample."""
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    coarse = [np.minimum(np.arange(len(e) + 1) * PAIR_BINS // (len(e) + 1), PAIR_BINS - 1) for e in edges]
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(edges, coarse, float(np.log(p / (1 - p))), np.zeros((len(edges), BINS)), [])
    if not len(y) or y.min() == y.max():
        return model
    b = model.bins(x)
    z = np.full(len(y), model.base)
    sums = lambda at, n: (np.bincount(at, grad, n), np.bincount(at, weight, n))
    for _ in range(rounds):
        for j in range(len(edges)):
            q = 1 / (1 + np.exp(-z))
            grad, weight = y - q, q * (1 - q)
            step = rate * _tree(*sums(b[:, j], BINS), LEAVES)
            model.tables[j] += step
            z += step[b[:, j]]
    c = np.stack([coarse[j][b[:, j]] for j in range(len(edges))], axis=1)
    at = lambda i, j: c[:, i] * PAIR_BINS + c[:, j]
    grid = lambda i, j: [s.reshape(PAIR_BINS, PAIR_BINS) for s in sums(at(i, j), PAIR_BINS**2)]
    q = 1 / (1 + np.exp(-z))
    grad, weight = y - q, q * (1 - q)
    # first by the plain gain of the grid, then trees for the best
    quick = sorted(combinations(range(len(edges)), 2), key=lambda ij: -float(np.sum(grid(*ij)[0] ** 2 / (grid(*ij)[1] + 5))))
    chosen = sorted(quick[: 4 * pairs], key=lambda ij: -_pair_tree(*grid(*ij))[1])[:pairs]
    tables = {ij: np.zeros((PAIR_BINS, PAIR_BINS)) for ij in chosen}
    for _ in range(pair_rounds):
        for ij in chosen:
            q = 1 / (1 + np.exp(-z))
            grad, weight = y - q, q * (1 - q)
            step = rate * _pair_tree(*grid(*ij))[0]
            tables[ij] += step
            z += step.ravel()[at(*ij)]
    model.pairs = [(i, j, t) for (i, j), t in tables.items()]
    return model


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", fit_docs: int = FIT_DOCS) -> Model:
    """Learns from the documents that labels (doc_id, label 0/1) names, at most fit_docs of them. Without rows every score is 1/2."""
    rows = sample(docs, labels, label, fit_docs, doc_id, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(0))
            if len(x):
                yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, np.ascontiguousarray(x.T))], ["y", *FEATURES])

    table = rows.mapInArrow(run, "y int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()  # fit_docs rows of numbers at most
    x = np.column_stack([table.column(f).to_numpy() for f in FEATURES])
    y = (table.column("y").to_numpy() == 1).astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order tasks end in
    return boost(x[order], y[order])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score (0 to 1). A null text is scored as an empty one.

    Other columns are not looked at; repeated rows are scored each; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(features(batch.column(1))))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, score double")
