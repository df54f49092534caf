"""Spelling variants, sharding and the repair of conversations, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from popgraph.llm import queries, sharding, spelling, turn_repair

# -- spelling variants -------------------------------------------------------------------------------


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return out - {word}


def variants(n, ratio=10):
    letters, rows, form = set("".join(n)), {}, {}
    for w in n:
        near = [x for x in edits(w, letters) if x in n]
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        form[w] = best if best and n[best] >= ratio * n[w] else None
        rows[w] = [form[w], w, n[w], len(near), n[best] if form[w] else None]
    for w in n:
        while form[rows[w][1]]:
            rows[w][1] = form[rows[w][1]]
    return {w: tuple(r) for w, r in rows.items()}


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_variants_equal_brute_force_whatever_the_bucket(spark, bucket):
    rng = random.Random(bucket)
    words = {"".join(rng.choice("abcéß") for _ in range(rng.randint(7, 10))) for _ in range(250)}
    words |= {"a" * k for k in range(7, 12)} | {"aaaaaaa" + c for c in "bcdefghé"} | {c + "aaaaaaa" for c in "bcd"}
    words |= {w[:i] + rng.choice("abé") + w[i + 1 :] for w in list(words)[:120] for i in [rng.randrange(len(w))]}
    words |= {w + "x" for w in list(words)[:40]} | {w[1:] for w in list(words) if len(w) > 7}
    n = {w: rng.choice([2, 3, 25, 40, 300, 4000, 50000]) for w in words}
    got = spelling.group_variants(spark.createDataFrame([*n.items(), (None, 9)], "word string, n long"), bucket=bucket).collect()
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got}
    assert got.pop(None) == (None, None, 9, 0, None)
    assert got == variants(n)
    assert any(r[0] and r[0] != r[1] for r in got.values())  # a chain of forms


def test_runs_and_counts(spark):
    docs = [(1, "Straßen-Über äbcdefg ÄBCDEFG1abcdefgh"), (1, "Straßen"), (None, "straßen"), (2, None), (3, "")]
    found = spelling.runs(spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "text as word", "1 as n"))
    # only A-Z is lower-cased
    assert Counter(r["word"] for r in found.collect()) == {"straßen": 3, "äbcdefg": 1, "Äbcdefg": 1, "abcdefgh": 1}
    assert [tuple(r) for r in spelling.count_words(found).collect()] == [("straßen", 3)]
    assert spelling.group_variants(spelling.count_words(found.limit(0))).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spelling.count_words(found), ratio=1)


def test_op11_against_plain_python(spark, tmp_path):
    rng = random.Random(5)
    base = ["".join(rng.choice("aeioué") for _ in range(8)) for _ in range(40)]
    rows = [(i if i % 17 else None, " ".join(rng.choice(base).title() for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(7, None), (7, "x" * 100_000 + " " + "x" * 100_000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = Counter()
    for doc_id, text in rows:
        for run in "".join(c if c.isascii() and c.isalpha() or "À" <= c <= "ÿ" else " " for c in text or "").split():
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in queries.op11_partenum_spelling(spark, str(tmp_path)).collect()}
    long = {w: got.pop(w) for w in list(got) if len(w) > 1000}
    assert {w: (None, w, n.pop(w), 0, None) for w in list(n) if len(w) > 1000} == long
    assert got == variants(n) and len(got) > 40


# -- sharding ----------------------------------------------------------------------------------------


def naive_best_fit(sizes, capacity):
    left, out = [], np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable"):
        fits = [(r, b) for b, r in enumerate(left) if r >= sizes[i] and r > 0]
        if fits:
            b = min(fits)[1]
        else:
            b = len(left)
            left.append(max(capacity, sizes[i]))
        left[b] -= sizes[i]
        out[i] = b
    return out


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_what_a_search_of_all_bins_finds(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, [5, 1000, 120, 60, 999, 30][seed], [3000, 900, 700, 1, 50, 400][seed])
    capacity = [7, 1000, 100, 100, 400, 10_000][seed]
    assert (sharding.best_fit_decreasing(sizes, capacity) == naive_best_fit(sizes, capacity)).all()


def test_even_packing():
    rng = np.random.default_rng(1)
    for n, shards in [(0, 3), (1, 3), (2, 5), (50, 8), (3000, 8), (5, 1)]:
        sizes = rng.integers(1, 10_000, n)
        bins = sharding.pack_evenly(sizes, shards)
        load = np.bincount(bins, sizes, shards)
        assert len(bins) == n and len(load) == shards
        if n >= 3000:
            assert load.max() - load.min() <= sizes.sum() / shards / 100
        if n:
            assert load.max() <= -(-sizes.sum() // shards) + sizes.max()
    load = np.bincount(sharding.pack_evenly(np.array([1000, *[1] * 700]), 8), [1000, *[1] * 700], 8)
    assert load.max() == 1000 and sorted(load)[:7] == [100] * 7  # a group of over an even share leaves the rest even


def shards_of(spark, rows, **how):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "doc_id as shard", "text as item", "1 as own", "2 as part", "3 as at").repartition(5)
    return sharding.shard_documents(docs, **how).toPandas()


def test_shards_are_whole_groups_with_gapless_slots(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 400) + str(i)) for i in range(1500)] + [(5000 + i, f"copy {i % 7} é") for i in range(900)]
    rows += [(9000 + i, None) for i in range(300)] + [(None, ""), (1, "again"), (1, "again"), (9999, "y" * 300_000)]
    out = shards_of(spark, rows, shards=8)
    assert Counter(out["doc_id"].fillna(-1)) == Counter(-1 if i is None else i for i, _ in rows)
    text = {(i, zlib.crc32((t or "").encode())): t or "" for i, t in rows}
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 1 for _, t in rows)
    crc = Counter(zlib.crc32((t or "").encode()) for _, t in rows)
    assert Counter(out["text_crc32"]) == crc and len(text) > 2000
    assert (out.groupby("text_crc32")["shard"].nunique() == 1).all()
    for _, own in out.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    load = out.groupby("shard")["size"].sum().sort_values()
    assert len(load) == 8 and load.iloc[-1] == 300_001 and load.iloc[-2] - load.iloc[0] <= load.iloc[0] / 100


def test_capacity_makes_few_shards(spark):
    rows = [(i, "z" * (i % 97) + str(i)) for i in range(2000)] + [(9000, "w" * 6000)]
    for fine in (1024, 16):
        out = shards_of(spark, rows, capacity=4096, fine=fine)
        load = out.groupby("shard")["size"].sum()
        assert load.max() == 6001 and (load > 4096).sum() == 1
        least = -(-(load.sum() - 6001) // 4096)
        assert len(load) <= 11 / 9 * least + 2 and set(load.index) == set(range(len(load)))
    assert len(shards_of(spark, [], shards=3)) == len(shards_of(spark, [], capacity=3)) == 0
    with pytest.raises(ValueError):
        shards_of(spark, rows, shards=3, capacity=3)


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i % 50}", i * 2) for i in range(300)], "doc_id long, text string, own long")
    sharding.write_shards(docs, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(back.columns) == ["doc_id", "own", "shard", "text"] and back.count() == 300
    assert back.groupBy("text").agg({"shard": "min"}).join(back.groupBy("text").agg({"shard": "max"}), "text").where("`min(shard)` <> `max(shard)`").isEmpty()
    assert sorted(r["doc_id"] for r in back.where("own = 2 * doc_id").collect()) == list(range(300))


# -- conversations -----------------------------------------------------------------------------------

FOLLOWS = {0: 2, 1: 2, 3: 2, 2: 3}


def with_inserts(best):
    """Costs, letters and rows of each state, once rows were inserted too."""
    best, todo = dict(best), list(best)
    while todo:
        s = todo.pop()
        cost, audit, rows = best[s]
        new = (cost + 3, audit + "I", [*rows, "assistant:" if s == 2 else "user:"])
        if FOLLOWS[s] not in best or new[:2] < best[FOLLOWS[s]][:2]:
            best[FOLLOWS[s]] = new
            todo.append(FOLLOWS[s])
    return best


def repaired(rows):
    """Forward search over whole audits; of equal costs none of two is a beginning of the other, so the least prefix wins."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults, best = set(), [], {0: (0, "", [])}
    for _, role, text in rows:
        words = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    for (_, role, text), fault in zip(rows, faults, strict=True):
        options = defaultdict(list)
        for s, (cost, audit, kept) in with_inserts(best).items():
            options[s].append((cost + 4, audit + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            cost += 3 * (fault == "truncated")
            options[FOLLOWS[s]].append((cost + 3, audit + "R", [*kept, f"{'assistant' if s == 2 else 'user'}:{text}"]))
            to = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(role[:1])
            if to:
                options[to].append((cost, audit + "K", [*kept, f"{role}:{text}"]))
        best = {s: min(found, key=lambda x: x[:2]) for s, found in options.items()}
    best = with_inserts(best)
    cost, audit, kept = min((best[s] for s in (0, 3) if s in best), key=lambda x: x[:2])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    n = Counter(faults)
    return gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()


def random_turns(seed, n, length):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.choice(length)):
            role = rng.choice(["user", "assistant", "system", "tool", "", "user", "assistant"]) if conv % 3 else ["user", "assistant"][turn % 2] if rng.random() < 0.9 else "user"
            text = rng.choice(["", " \n", "a.", "b", "c!", f"{turn}?", f"{turn}? ", f"{turn}"])
            rows.append((conv if conv else None, turn + rng.choice([0, 0, 0, 1]) if rng.random() < 0.95 else None, role, text))
    return rows


@pytest.mark.parametrize(("records", "length"), [("10000", [0, 1, 2, 3, 9]), ("1", [1, 5, 40]), ("3", [2, 30, 300]), ("50", [1000])])
def test_repairs_equal_a_search_over_whole_audits(spark, records, length):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)  # so many rows a chunk
    try:
        rows = random_turns(len(length), 12, length)
        turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as at", "2 as kind", "role as edit").repartition(3)
        got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.digest(turn_repair.repair(turns)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = defaultdict(list)
    for conv, *row in rows:
        own[conv].append(tuple(row))
    assert got == {conv: repaired(r) for conv, r in own.items()}


@pytest.mark.parametrize("roles", [["user"], ["system"], ["assistant"], ["tool"], ["user", "assistant", "assistant"]])
def test_runs_without_convergence_are_fixed_up(spark, roles):
    """Of one role all along, which row keeps it hangs on the end of the conversation, however far it is."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(conv, t, roles[t % len(roles)], f"{t}.") for conv, n in ((1, 61), (2, 62), (3, 200)) for t in range(n)]
        got = turn_repair.digest(turn_repair.repair(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: repaired([r[1:] for r in rows if r[0] == c]) for c in (1, 2, 3)}


def test_speculative_vectors_make_all_others():
    """Each vector that rows make lies within the bounds, so it is a minimum over the speculative ones."""
    rng = random.Random(2)
    for _ in range(300):
        v = turn_repair._END
        for _ in range(rng.randint(0, 30)):
            v = turn_repair._before(rng.randrange(8), v)
            assert all(v[s] == min(v[j] + turn_repair._MORE[s][j] for j in range(4)) for s in range(4))


def test_repair_rows_and_edge_cases(spark):
    long = "x" * 3_000_000 + "."
    rows = [(1, 0, "system", "s."), (1, 1, "user", long), (1, 3, "user", long), (1, 3, None, None), (2, None, "assistant", "a")]
    edits = turn_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "at", "nth").collect()
    assert [(r["conv_id"], r["edit"], r["role"], r["fault"]) for r in edits] == [
        (1, "K", "system", None), (1, "K", "user", None), (1, "D", None, "blank"), (1, "D", None, "duplicate"), (1, "I", "assistant", None), (2, "D", None, "truncated"),
    ]
    assert turn_repair.digest(turn_repair.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_op13_keeps_every_conversation(spark, tmp_path):
    rows = [(c, t, r, x) for c, t, r, x in random_turns(9, 60, [1, 2, 6])] + [(None, None, None, None), (500, None, "user", "Hi."), (500, 2, None, "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    own, gone = defaultdict(list), 0
    for conv, turn, role, text in rows:
        own[conv]
        role, text = " " if role is None else role, " " if text is None else text
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        gone += h == 0
        row = (turn, "user" if h == 4 else role, "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text)
        own[conv] += [row] * (0 if h == 0 else 2 if h == 3 else 1)
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_viterbi_turn_repair(spark, str(tmp_path)).collect()}
    assert got == {conv: repaired(r) for conv, r in own.items()} and gone
