"""The registered queries against their contracts, over the smallest tables."""

import os
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from popgraph.llm import decontaminate, toxicity

pytest.importorskip("public_tokenizers")
DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def got(spark, name):
    from popgraph.llm import queries

    return queries.QUERIES[name](spark, DATA).toPandas()


@tables
def test_op5_and_op10_have_the_ids_of_whole_texts(spark, texts):
    from tokenizers import Tokenizer

    from popgraph.llm.queries import TOKENIZER

    library = Tokenizer.from_file(TOKENIZER)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    files, start = got(spark, "op10_elias_fano_tokens").set_index("doc_id"), 0
    for i in sorted(ids):
        own = np.array([*ids[i], 0], "<u4")
        assert tuple(files.loc[i, ["start", "n_tokens", "ids_crc32"]]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    for i, own in got(spark, "op5_first_fit_packing").groupby("doc_id"):
        whole = np.array([*ids[i], 1], "<u4")
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(whole[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(whole)
        assert own["length"].sum() == len(whole)


@tables
@pytest.mark.parametrize(("name", "columns", "least"), [("op6_additive_quality", ["doc_id", "held_out", "score", "predicted"], 0.3), ("op9_lexicon_toxicity", ["doc_id", "held_out", "score", "predicted"], 0.5), ("op8_language_mixture", ["doc_id", "held_out", "lang_pred", "score"], None)])
def test_learnt_queries(spark, texts, name, columns, least):
    out = got(spark, name)
    assert out.columns.tolist() == columns and sorted(out["doc_id"]) == sorted(texts)
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all() and out["score"].between(0, 1).all()
    if least is not None:
        assert (out["predicted"] == (out["score"] >= least)).all()


@tables
def test_op2_reports_documents_of_the_table(spark, texts):
    out = got(spark, "op2_simhash_decontamination")
    assert set(out["doc_id"]) <= set(texts) and len(out) and (out["similarity"] >= 0.75).all()


def test_the_multi_index_finds_all_within_the_radius():
    rng = np.random.RandomState(0)
    items = rng.randint(0, 2**63, 300, dtype=np.int64).astype(np.uint64)
    near = [int(items[k]) ^ sum(1 << int(b) for b in rng.choice(64, k % 24, replace=False)) for k in range(300)]
    f = np.array(near, np.uint64)
    want = {(i, j) for i in range(300) for j in np.flatnonzero(np.bitwise_count(items ^ f[i]) <= decontaminate.RADIUS).tolist()}
    assert set(decontaminate.Near(items).within(f)) == want and len(want) > 200


def test_recall_at_the_threshold():
    """Windows of 40 words with a run of three or four words edited: just at 0.75 or above."""
    rng = random.Random(4)
    found = total = 0
    for _ in range(400):
        item = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        window = list(item)
        at = rng.randrange(5, 50)
        window[at : at + 4] = [f"e{rng.randrange(10**6)}" for _ in range(4)]
        x = decontaminate.Index([1], pa.array([" ".join(item)]))
        w = next(iter(decontaminate.C.words(pa.array([" ".join(window)]))))
        s = decontaminate.C.grams(w.hash, 5)
        total += 1
        found += bool(x.match(w, s, x.holds(s), 0, 60, 75))
    assert found >= 0.97 * total


def test_weights_equal_naive_matching():
    rng = random.Random(3)
    model = toxicity.Model({" bad ": 3.0, " badder ": 4.0, " fool": 2.0, " foo ": 2.5}, ["bad luck", "a fool"])
    automaton = model.automaton()
    vocabulary = ["bad", "B4D", "badder", "fools", "foo", "luck", "a", "good", "fool"]
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(9))))
        total = 0.0
        words = folded.split()
        for k, word in enumerate(words):
            weight = max([w for t, w in model.weights.items() if f" {word} ".startswith(t)], default=0.0)
            around = {tuple(words[max(0, k - 1) : k + 1]), tuple(words[k : k + 2])}
            total += 0.0 if around & {("bad", "luck"), ("a", "fool")} else weight
        assert model.features(automaton, folded)[0] == pytest.approx(np.log1p(total))


def test_blocks_guarantee_the_radius():
    assert sum(decontaminate.BLOCKS) == 64 and decontaminate.RADIUS < len(decontaminate.BLOCKS) * (decontaminate.FLIPS + 1)
    for width, flipped in zip(decontaminate.BLOCKS, decontaminate._FLIPPED, strict=True):
        assert len(set(flipped.tolist())) == 1 + width + len(list(combinations(range(width), 2)))


def test_op3_takes_columns_of_any_name(spark, tmp_path):
    from popgraph.llm import queries

    rows = [(1, "the same long line of words\nand more", 7, 1), (2, "the same long line of words\nand other", 8, 2)]
    spark.createDataFrame(rows, "doc_id long, text string, removed_words int, _removed_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["removed_words"] for r in queries.op3_winnowing_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: 0, 2: 6}
