"""The whole pipeline against its stages in plain Python, over a table with nulls, repeated rows and clashing names."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.llm import _common as C
from popgraph.llm import toxicity

from test_operators import TOKENIZER, brute_components, brute_contaminated, brute_removed, lower, sentence, words_of

DATA = "/root/testdata/sf0.001"


def is_toxic(model, text):
    words = toxicity.fold(text or "").split()
    excused = {x for k, pair in enumerate(zip(words, words[1:])) if " ".join(pair) in model.exceptions for x in (k, k + 1)}
    weights = [max([model.weights.get(f" {w} "[:k], 0.0) for k in range(2, len(w) + 3)]) for w in words]
    total = sum(x for k, x in enumerate(weights) if k not in excused)
    z = model.logistic[0] + model.logistic[1] * math.log1p(total) + model.logistic[2] * total / max(1, len(words)) * 10
    return 1 / (1 + math.exp(-z)) >= 0.5


def shingle_counts(text):
    w = words_of(lower(text))
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def has_item(text, bench):
    """Some item of bench in a text; items too few of whose shingles it holds can't be in it."""
    own = set(shingle_counts(text)) if words_of(text) else set()
    few = [(i, t) for i, t, want in bench if sum(want.values()) < 5 or 100 * sum(n for g, n in want.items() if g in own) >= 75 * sum(want.values())]
    return bool(brute_contaminated([(0, text)], few))


def plain(docs, bench, model):
    """(rows left, rows that each stage took)."""
    taken = []
    left = [d for d in docs if not is_toxic(model, d[1])]
    taken.append(len(docs) - len(left))
    cut = {i: (t, n) for i, t, n in brute_removed([d for d in dict.fromkeys(left) if d[0] is not None], 50)}
    after = [(i, *cut.get(i, (t, 0))) for i, t in left]
    kept = [(i, t) for i, t, n in after if not (n and not words_of(t))]
    taken.append(sum(n > 0 for _, _, n in after))
    firsts = {i for i, _, _, k in brute_components([d for d in dict.fromkeys(kept) if d[0] is not None]) if k}
    single = [(i, t) for i, t in kept if i is None or i in firsts]
    taken.append(len(kept) - len(single))
    clean = [d for d in single if not has_item(d[1], bench)]
    return clean, [*taken, len(single) - len(clean)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_equals_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline as cp

    tables = {t: spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    docs = tables["documents"]
    again = docs.where("doc_id in (3, 50)")
    odd = [(10**6, None), (10**6 + 1, ""), (10**6 + 2, " \n "), (None, "a text of no document id that nothing else is like"), (10**6 + 3, "ends with these few words")]
    rng = random.Random(4)
    toxic = [(2 * 10**6 + i, f"{sentence(rng, 5)} you gr0lk {sentence(rng, 3)} grolk zzblat {sentence(rng, 6)}") for i in range(30)]
    tables["labels"] = tables["labels"].unionByName(spark.createDataFrame([(i, 1) for i, _ in toxic], "doc_id long, toxic int"), allowMissingColumns=True)
    odd = spark.createDataFrame([*odd, *toxic], "doc_id long, text string")
    docs = docs.union(again).unionByName(odd, allowMissingColumns=True)
    for name in ("removed_words", "_removed_words", "score", "component_id", "kept", "whole", "cuts", "k", "item_id", "ids", "sequence_id"):
        docs = docs.withColumn(name, F.lit("x"))
    for name, df in (tables | {"documents": docs}).items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = toxicity.fit(docs, tables["labels"].where(~C.held_out()))
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    bench = [(r["item_id"], r["text"], shingle_counts(r["text"])) for r in tables["benchmark"].collect() if words_of(r["text"])]
    want, taken = plain(rows, bench, model)
    assert min(taken) > 0 and taken[0] >= 30 and not {i for i, _ in toxic} & {i for i, _ in want}
    encode = Tokenizer.from_file(TOKENIZER)
    want = sorted((str(i), [*encode.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in want)

    got = cp.run(spark, str(tmp_path)).toPandas()
    # pieces of equal ids of rows that repeat one doc_id can stand for each other
    ids, open_rows = [], {}
    for r in got.sort_values(["doc_id", "start", "sequence_id", "offset"]).to_dict("records"):
        key = "None" if math.isnan(r["doc_id"]) else str(int(r["doc_id"]))
        x = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(x) == r["length"] > 0
        if r["start"] == 0:
            open_rows.setdefault(key, []).append(row := [])
        else:
            row = next(o for o in open_rows[key] if len(o) == r["start"])
        row += x
    ids = sorted((key, row) for key, own in open_rows.items() for row in own)
    assert ids == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]] and own["length"].sum() <= 2048


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as cp

    ddl = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, columns in ddl.items():
        spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
