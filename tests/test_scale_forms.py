"""Forms for large inputs against plain ones: ranks, quantiles of groups, runs, parcels and matches."""

import time
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.functions import tables
from popgraph.operators import graph, matching, selection, sequence, spatial


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_ranks_equal_sorted_places(spark, keys):
    rng = np.random.RandomState(0)
    rows = [(int(i % 3) if keys else 0, int(v), int(t)) for i, (v, t) in enumerate(zip(rng.randint(0, 5, 400), rng.permutation(400) * 10**12, strict=True))]
    df = spark.createDataFrame([*rows, (7, None, 5)] if keys else rows, "k int, v int, tie long")
    got = {(r["k"], r["tie"]): r["rank"] for r in sequence.stable_rank(df, F.col("v"), "tie", keys=keys).collect()}
    for k in {r[0] for r in rows}:
        for place, (_, _, tie) in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))):
            assert got[k, tie] == place
    assert sequence.stable_rank(df.limit(0), F.col("v"), "tie", keys=keys).count() == 0


def test_samples_of_clustered_ids(spark):
    """A block of ids and one far away: ranges are of rows, not of numbers."""
    nodes = spark.createDataFrame([(i, None) for i in [*range(3000), 10**15]], "node_id long, active boolean")
    drawn = sorted(np.random.RandomState(4).choice(3001, 50, replace=False))
    assert sorted(r["node_id"] for r in selection.sampled_nodes(nodes, 50, 4).collect()) == [int(k) if k < 3000 else 10**15 for k in drawn]


def test_giant_component_starts_apart(spark):
    labelled = spark.createDataFrame([("a", n, n % 2) for n in range(9)] + [("b", n, 0) for n in range(4)], "g string, node_id long, component long")
    got = {(r["g"], r["node_id"]): r["module"] for r in graph.giant_start(labelled, ["g"]).collect()}
    assert [got["a", n] for n in range(9)] == [2, 1, 3, 1, 4, 1, 5, 1, 6] and [got["b", n] for n in range(4)] == [1, 2, 3, 4]


@pytest.mark.parametrize("most", [0, 30, 10**6])
def test_quantiles_of_groups(spark, most):
    rng = np.random.RandomState(1)
    own = {0: rng.randn(500), 1: np.array([2.0]), 2: rng.randint(0, 4, 300).astype(float), 3: np.array([1e-300, 1.0, 1e300, -1e300]), 4: np.array([1.0, np.nextafter(1, 2)] * 40), 5: rng.rand(31) * 1e-9 + 5}
    rows = [(k, float(v)) for k, x in own.items() for v in x] + [(0, None), (1, float("nan")), (9, None)]
    shares = [0.0, 0.02, 0.5, 0.995, 1.0]
    got = {r["k"]: list(r)[1:] for r in tables.grouped_quantiles(spark.createDataFrame(rows, "k int, v double").repartition(4), ["k"], "v", shares, most).collect()}
    assert set(got) == set(own)
    for k, x in own.items():
        assert got[k] == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)


def shortest_first(labels, least):
    """The rule, with all runs found anew at each step."""
    while True:
        runs = []
        for x in labels:
            if runs and runs[-1][0] == x:
                runs[-1][1] += 1
            else:
                runs.append([x, 1])
        k = min(range(len(runs)), key=lambda i: (runs[i][1], i), default=None)
        if k is None or len(runs) == 1 or runs[k][1] >= least:
            return labels
        sides = [runs[i] for i in (k - 1, k + 1) if 0 <= i < len(runs)]
        runs[k][0] = max(sides, key=lambda r: r[1])[0]  # of equals the first
        labels = [x for x, n in runs for _ in range(n)]


def test_merged_runs_equal_the_rule(spark):
    rng = np.random.RandomState(3)
    rows, want = [], {}
    for k in range(40):
        labels = rng.choice(list("abc")[: 1 + k % 3], rng.randint(1, 60)).tolist()
        labels = [x for x in labels for _ in range(rng.randint(1, 4))]
        rows += [(k, f, x, 2 * f) for f, x in enumerate(labels)]
        want |= {(k, f): x for f, x in enumerate(shortest_first(labels, 4))}
        for least in (1, 2, 9, 100):
            assert sequence.merge_short(labels, least) == shortest_first(labels, least)
    df = spark.createDataFrame(rows, "recording int, frame long, state string, more long").repartition(3)
    out = sequence.merge_short_runs(df, 4, ["recording"])
    assert out.columns == df.columns and out.where("more <> 2 * frame").isEmpty()
    assert {(r["recording"], r["frame"]): r["state"] for r in out.collect()} == want
    assert sequence.merge_short([], 3) == []


def test_a_million_frames_merge_in_seconds():
    labels, began = np.random.RandomState(0).randint(0, 3, 1_000_000).tolist(), time.time()
    assert len(sequence.merge_short(labels, 30)) == 1_000_000 and time.time() - began < 60


def nearest_free_by_sorting(x, y, size):
    free, out, made = np.ones(len(x), bool), np.full(len(x), -1), 0
    for seed in np.argsort(x + y, kind="stable"):
        if free[seed]:
            free[seed] = False
            rest = np.flatnonzero(free)
            own = [seed, *rest[np.argsort(np.hypot(x[rest] - x[seed], y[rest] - y[seed]), kind="stable")[: size - 1]]]
            free[own], out[own], made = False, made, made + 1
    return out


@pytest.mark.parametrize("kind", ["even", "grid", "line", "point", "clusters"])
def test_parcels_in_cells_equal_those_by_sorting(kind):
    rng = np.random.RandomState(5)
    for n in (1, 7, 700, 2500):
        x, y = rng.rand(n) * 100, rng.rand(n) * 100
        x, y = {"even": (x, y), "grid": (x // 5, y // 5), "line": (x, 0 * y), "point": (0 * x, 0 * y), "clusters": (x // 50 * 1e4 + x % 3, y // 50 * 1e4 + y % 3)}[kind]
        for size in (2, 9, 60):
            assert (spatial.parcel(x, y, size) == nearest_free_by_sorting(x, y, size)).all()


def test_many_parcels_in_seconds():
    rng, began = np.random.RandomState(6), time.time()
    found = spatial.parcel(rng.rand(200_000) * 3000, rng.rand(200_000) * 3000, 40)
    assert (np.bincount(found) == 40).all() and time.time() - began < 60


def test_matches_gain_most():
    rng = np.random.RandomState(7)
    for _ in range(150):
        n, m = rng.randint(1, 6, 2).tolist()
        gain = np.where(rng.rand(n, m) < rng.choice([0.3, 0.8, 1.0]), rng.rand(n, m).round(rng.choice([1, 6])), 0.0)
        rows, cols = np.nonzero(gain > 0)
        got = matching.assign_entries(rows, cols, gain[rows, cols])
        assert len({a for a, _ in got}) == len({b for _, b in got}) == len(got) and all(gain[a, b] > 0 for a, b in got)
        wide = np.hstack([gain, np.zeros((n, n))])
        best = max(sum(wide[i, p[i]] for i in range(n)) for p in permutations(range(n + m), n)) if n + m < 9 else None
        assert best is None or abs(sum(gain[a, b] for a, b in got) - best) < 1e-12


def test_matched_modules_of_several_components(spark):
    a = spark.createDataFrame([(n, n // 10) for n in range(60)], "node_id long, module long")
    b = spark.createDataFrame([(n, -1 - (n + 4) // 10) for n in range(60)], "node_id long, module long")
    got = matching.match_modules(a, b).collect()
    assert {(r["module_a"], r["module_b"]) for r in got} == {*((k, -1 - k) for k in range(5)), (5, -7)}  # 4 nodes of 4 and 10 outweigh 6 of 10 and 10
    assert matching.match_modules(a.limit(0), b).count() == 0


def test_fifty_thousand_modules_match_in_seconds():
    rng, n = np.random.RandomState(8), 50_000
    key = np.unique(np.repeat(np.arange(n), 4) * n + np.clip(np.repeat(np.arange(n), 4) + rng.randint(-3, 4, 4 * n), 0, n - 1))
    began = time.time()
    assert len(matching.assign_entries(key // n, key % n, rng.rand(len(key)))) > 0.9 * n and time.time() - began < 60


def test_sampled_traces_equal_numpy(spark):
    rng = np.random.RandomState(2)
    values = rng.rand(30, 40)
    rows = [(3 * n, f, float(values[n, f])) for n in range(30) for f in range(40)]
    got = {(r["trace"], r["frame"]): r for r in selection.sampled_traces(spark.createDataFrame(rows, "node_id long, frame long, v double"), 7, 5).collect()}
    drawn = np.sort(np.random.default_rng(5).choice(30, size=7, replace=False))
    centred = values[drawn] - np.median(values[drawn], axis=1, keepdims=True)
    low, high = np.percentile(centred, (1, 99))
    assert len(got) == 7 * 40
    for (k, f), r in got.items():
        assert r["node_id"] == 3 * drawn[k] and r["shown"] == pytest.approx(centred[k, f] - k * 1.15 * (high - low))


def test_recordings_follow_manifests(spark):
    """Bouts and ends as the manifest says; sizes as released; others take the next bout that is long enough."""
    from popgraph.operators import physiology

    rows = [(name, 1000 * bout + 10 * k, bout, 10.0) for name, sizes in (("m", (2, 6, 5)), ("free", (2, 6, 5))) for bout, n in enumerate(sizes) for k in range(n)]
    groups = spark.createDataFrame(rows, "recording string, sample long, bout long, period double")
    segments = spark.createDataFrame([(name, k, 4 * k, 4 * k + 4) for name in ("m", "free") for k in (0, 1)], "recording string, segment int, frame_start long, frame_stop long")
    manifest = spark.createDataFrame([("m", 0, 2, "end"), ("m", 1, 1, "start"), ("other", 0, 0, "end")], "recording string, segment int, bout int, anchor string")
    sizes = spark.createDataFrame([("m", [2, 6, 5]), ("other", [1])], "recording string, sizes array<long>")
    how = {"fs": 100.0, "imaging_fs": 10.0, "n_samples": 10**6, "manifest": manifest}
    got = {(r["recording"], r["segment"]): (r["bout"], r["offset"], r["triggers"], r["sample_stop"]) for r in physiology.align_recordings(groups, segments, exact_sizes=sizes, **how).collect()}
    assert got == {
        ("m", 0): (2, 1, [2010, 2020, 2030, 2040], 2050), ("m", 1): (1, 0, [1000, 1010, 1020, 1030], 1040),
        ("free", 0): (1, 0, [1000, 1010, 1020, 1030], 1040), ("free", 1): (2, 0, [2000, 2010, 2020, 2030], 2040),
    }
    one = segments.where("recording = 'm'")
    wrong = spark.createDataFrame([("m", [2, 6, 6])], sizes.schema)
    twice = spark.createDataFrame([("m", 0, 1, "end"), ("m", 1, 1, "start")], manifest.schema)
    for bad, text in (({"exact_sizes": wrong}, "release"), ({"manifest": twice}, "twice"), ({"manifest": manifest.limit(1)}, "manifest has 1")):
        with pytest.raises(Exception, match=text):
            physiology.align_recordings(groups, one, **{**how, **bad}).collect()


def test_released_files(spark):
    from popgraph.functions import dims

    sums = {r["kind"]: (r["n"], r["b"]) for r in dims.released_files(spark).groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()}
    assert sums == {"calcium": (10, 11_222_804_736), "physiology": (12, 4_058_616_353)}
    assert dims.bout_sizes(spark).count() == 10
