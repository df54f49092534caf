"""Operators 6, 7 and 8 against plain Python, one text at a time."""

import os
import random
import re
import struct
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from popgraph.llm import _common as C
from popgraph.llm import fingerprint, language_mix, quality_gam

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TEXTS = ["", "  \n ", "One", "a b", "THE CAT! sat|on the mat.\n\nTHE CAT! sat", "x\ty z " * 40, "éà 12 (three) #4 &amp; naïve\x07", "word " * 30 + "END OF LINE\n" * 7, "aa bb aa bb aa bb cc"]


# -- quality -----------------------------------------------------------------------------------------


def plain_features(text):
    data = text.encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    n, sizes = len(words), [len(w) for w in words]
    kinds = [next((k for k, own in enumerate(quality_gam._ASCII_KINDS.values()) if b in own), None) for b in data]
    other = len(quality_gam._ASCII_KINDS)
    share = [sum(x == k for x in kinds) / max(1, len(data)) for k in range(other)] + [sum(b >= 128 for b in data) / max(1, len(data))]
    if not n:
        return [np.log1p(len(data)), 0.0, *[0.0] * 10, *share, *[0.0] * 4]
    grams = [tuple(words[i : i + 3]) for i in range(n - 2)]
    most = lambda flags: max(sum(flags[i : i + 20]) / min(20, n) for i in range(max(1, n - 19)))
    upper = [sum(65 <= b <= 90 for b in w) > 0.6 * len(w) for w in words]
    mark = [any(b in b"!|#$%&*@^~+=<>_\\/" for b in w) for w in words]
    own = [
        np.mean(sizes), np.std(sizes), len(set(words)) / n, sum(a == b for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0.0,
        sum(a == b for a, b in zip(words, words[2:])) / (n - 2) if n > 2 else 0.0, max(words.count(w) for w in set(words)) / n,
        1 - (len(set(grams)) if grams else 1) / max(1, n - 2), n / (1 + data.count(b"\n")), sum(s > 15 for s in sizes) / n, sum(s == 1 for s in sizes) / n,
    ]
    return [np.log1p(len(data)), np.log1p(n), *own, *share, sum(upper) / n, sum(mark) / n, most(upper), most(mark)]


def test_features_equal_plain_counts():
    rng = random.Random(0)
    texts = [*TEXTS, *(" ".join(rng.choice(["a", "Bc", "DEF", "x|y", "#1", "hello", "\n", "é"]) for _ in range(rng.randint(0, 90))) for _ in range(60))]
    np.testing.assert_allclose(quality_gam.features(pa.array(texts)), [plain_features(t) for t in texts], atol=1e-12)
    np.testing.assert_allclose(quality_gam.features(pa.array([None, "a"])), [plain_features(""), plain_features("a")], atol=1e-12)


def test_trees_take_the_best_of_all_cuts():
    rng = np.random.RandomState(1)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1.0)
    for _ in range(40):
        g, h = rng.randn(9), rng.rand(9)
        best = max(range(1, 9), key=lambda c: gain(g[:c], h[:c]) + gain(g[c:], h[c:]))
        want = np.concatenate([[g[:best].sum() / (h[:best].sum() + 1)] * best, [g[best:].sum() / (h[best:].sum() + 1)] * (9 - best)])
        if gain(g[:best], h[:best]) + gain(g[best:], h[best:]) > gain(g, h) + 1e-9:
            np.testing.assert_allclose(quality_gam._tree(g, h, 2), want)
    for _ in range(15):
        g, h = rng.randn(5, 5), rng.rand(5, 5)
        _, found = quality_gam._pair_tree(g, h)
        totals = [0.0]
        for a, b in ((g, h), (g.T, h.T)):
            for cut in range(1, 5):
                # each side has its own cut of the other feature, or none if that is no worse
                side = lambda s: max([gain(a[s], b[s]), *(gain(a[s][:, :c], b[s][:, :c]) + gain(a[s][:, c:], b[s][:, c:]) for c in range(1, 5))])  # noqa: B023, E731
                totals.append(side(slice(0, cut)) + side(slice(cut, None)))
        assert found == pytest.approx(max(totals))


@tables
def test_op6_scores_are_sums_of_table_entries(spark):
    from popgraph.llm import queries

    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_gam.fit(docs, labels.where(~C.held_out()))
    got = {r["doc_id"]: r["score"] for r in queries.op6_additive_quality(spark, DATA).collect()}
    for r in docs.collect():
        x = plain_features(r["text"] or "")
        # the library's own value of a feature, which equals the plain one but for its last bits, names the bin
        own = quality_gam.features(pa.array([r["text"]]))[0]
        np.testing.assert_allclose(own, x, atol=1e-12)
        bins = [sum(bool(e <= v) for e in edges) for edges, v in zip(model.edges, own)]
        z = model.base + sum(table[b] for table, b in zip(model.tables, bins)) + sum(t[model.coarse[i][bins[i]], model.coarse[j][bins[j]]] for i, j, t in model.pairs)
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)))


# -- fingerprints ------------------------------------------------------------------------------------


def plain_fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    hashed = lambda data, seed: xxhash.xxh64_intdigest(data, seed % 2**64)
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    long, small = lambda x, seed: hashed(struct.pack("<q", x), seed), lambda x, seed: hashed(struct.pack("<i", x), seed)
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = [signed(hashed(w.encode(), 42)) for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return ""
    shingles = []
    for i in range(max(1, len(words) - 4)):
        h = 42
        for w in words[i : i + 5]:
            h = long(w, h)
        shingles.append(signed(small(len(words), h) if len(words) < 5 else h))
    least = [min((x for x in shingles if (x >> 56) + 128 == k), default=None) for k in range(256)]
    tables = [[draw.randrange(256) for _ in range(256)] for draw in (random.Random(1000 + j) for j in range(6))]
    full = [x for x in least if x is not None]
    out = []
    for k in range(256):
        tried = [least[k], *(least[t[k]] for t in tables), min(full, key=lambda y: (signed(long(y >> 56, small(k, 42))), y))]
        x = next(v for v in tried if v is not None)
        out.append(f"{(x >> (k % 14 * 4)) & 15:x}")
    return "".join(out)


def test_digits_equal_plain_python(spark):
    rng = random.Random(3)
    texts = [*TEXTS, *(" ".join(rng.choice("abcdEFé") + str(rng.randint(0, 30)) for _ in range(n)) for n in (3, 4, 5, 6, 7, 12, 60, 300, 900, 3000) for _ in range(4))]
    df = fingerprint.with_fingerprint(spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4), "t", "f")
    assert {r["i"]: r["f"] for r in df.collect()} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


# -- languages ---------------------------------------------------------------------------------------

LETTERS = {"aa": "abcde", "bb": "bcdfg", "cc": "hijkl", "dd": "klmno"}


def speak(rng, lang, words):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(3, 7))) for _ in range(words))


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(4)
    rows = [(lang, speak(rng, lang, 60)) for lang in LETTERS for _ in range(25)]
    return language_mix.fit(spark.createDataFrame(rows, "lang string, text string")), rows


def plain_counts(text):
    """Numbers of the trigram classes of a text, byte by byte."""
    low = [b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalpha() else 32 for b in text.encode()]
    out = {}
    for a, b, c in zip(low, low[1:], low[2:]):
        code = ((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> 17
        out[code] = out.get(code, 0) + 1
    return out


def test_model_counts_equal_plain_counts(spoken):
    model, rows = spoken
    assert model.names == sorted(LETTERS)
    for j, lang in enumerate(model.names):
        total = np.full(language_mix.CLASSES, language_mix.SMOOTHING)
        for own, text in rows:
            if own == lang:
                for k, n in plain_counts(text).items():
                    total[k] += n
        np.testing.assert_allclose(model.p[:, j], total / total.sum())


def plain_mixture(model, text):
    """All sets of languages, EM in each, and the one of least penalised cost: (cost, shares by language)."""
    counts = plain_counts(text)
    size, best = sum(counts.values()), None
    for k in range(1, len(model.names) + 1):
        for own in combinations(range(len(model.names)), k):
            share = {j: 1 / k for j in own}
            for _ in range(language_mix.ROUNDS):
                new = dict.fromkeys(own, 0.0)
                for c, n in counts.items():
                    whole = sum(share[j] * model.p[c, j] for j in own)
                    for j in own:
                        new[j] += n * share[j] * model.p[c, j] / whole
                share = {j: v / size for j, v in new.items()}
            like = sum(n * np.log(sum(share[j] * model.p[c, j] for j in own)) for c, n in counts.items())
            cost = -2 * language_mix.DRAWS_PER_TRIGRAM * like + (k - 1) * np.log(max(language_mix.DRAWS_PER_TRIGRAM * size, 2))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, share)
    return best


def test_mixtures_equal_the_best_of_all_sets(spark, spoken):
    """Texts of one to four languages: the set that grows step by step is the best of all sets."""
    model, _ = spoken
    rng, texts = random.Random(5), []
    for own in [c for k in (1, 2, 3, 4) for c in combinations(sorted(LETTERS), k)]:
        for words in (12, 40):
            texts.append(" ".join(speak(rng, lang, words + 9 * place) for place, lang in enumerate(own)))
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (900, None), (901, "12 !")], "doc_id long, text string")
    found = language_mix.predict(rows, model).collect()
    assert len(found) == len(texts) + 3 and len([r for r in found if r["doc_id"] == 0]) == 2
    got = {r["doc_id"]: r for r in found}
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    sizes = set()
    for i, t in enumerate(texts):
        _, share = plain_mixture(model, t)
        top = max(share, key=share.get)
        sizes.add(sum(v > 0.02 for v in share.values()))
        assert got[i]["lang_pred"] == model.names[top] and got[i]["score"] == pytest.approx(share[top], abs=1e-6)
    assert {1, 2, 3, 4} <= sizes
