"""Exact quantiles, moving averages of long sequences, and nearest nodes and pair counts by blocks."""

import numpy as np
import pytest

from popgraph.functions import tables
from popgraph.operators import correlate, sequence, spatial


@pytest.mark.parametrize("values", [[], [3.0], [2.0, 2.0, 2.0, 7.0], [1e-300, 1.0, 1e300, -1e300], np.random.RandomState(0).randn(5000).tolist(), [float(k % 7) for k in range(999)]])
def test_quantiles_equal_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x double")
    shares = [0.0, 0.02, 0.5, 0.995, 1.0]
    got = tables.quantiles(df, "x", shares)
    assert got == (pytest.approx(np.quantile(values, shares).tolist(), rel=1e-9) if values else [None] * 5)


def test_moving_average_of_short_and_long_sequences(spark):
    rng = np.random.RandomState(1)
    own = {0: rng.rand(500), 1: rng.rand(4), 2: rng.rand(5), 3: rng.rand(1)}
    rows = [(k, f, float(v)) for k, x in own.items() for f, v in enumerate(x)]
    got = {(r["k"], r["frame"]): r["smoothed"] for r in sequence.moving_average(spark.createDataFrame(rows, "k int, frame long, v double"), 6, keys=["k"]).collect()}
    for k, x in own.items():
        w = min(6, len(x))
        for f in range(len(x)):
            assert got[k, f] == pytest.approx(np.mean(x[max(0, f - w // 2) : f + (w - 1) // 2 + 1]))


def test_nearest_and_pair_counts_of_clusters_and_outliers(spark):
    rng = np.random.RandomState(2)
    at = np.concatenate([rng.rand(60, 2), rng.rand(60, 2) + 500, [[1e5, 3.0], [-4e4, -4e4]]])
    module = rng.randint(0, 3, len(at))
    rows = [(i, float(x), float(y), int(m)) for i, ((x, y), m) in enumerate(zip(at, module, strict=True))]
    nodes = spark.createDataFrame(rows, "node_id long, x double, y double, module int")
    d = np.hypot(at[:, None, 0] - at[None, :, 0], at[:, None, 1] - at[None, :, 1])
    np.fill_diagonal(d, np.inf)
    got = {r["node_id"]: r["neighbour"] for r in spatial.nearest(nodes).collect()}
    assert got == dict(enumerate(d.argmin(axis=1).tolist()))
    i, j = np.triu_indices(len(at), 1)
    bins = np.searchsorted([0.5, 10.0, 800.0], d[i, j], "right")
    for block in (2048, 20):
        out = spatial.same_module_by_distance(nodes, [0.5, 10.0, 800.0], block=block).collect()
        for r in out:
            own = bins == r["bin"]
            assert r["n_pairs"] == own.sum() and r["same"] == (pytest.approx((module[i] == module[j])[own].mean()) if own.any() else None)


def test_threshold_with_ties(spark):
    values = [0.0] * 50 + [0.5001] * 10 + [0.5004] * 3 + [0.9]
    pairs = spark.createDataFrame([(k, k + 1, v) for k, v in enumerate(values)], "i long, j long, r double")
    for density in (0.01, 0.05, 0.1, 0.5, 1.0):
        m = max(1, int(density * len(values)))
        limit = sorted(values, reverse=True)[m - 1]
        kept = correlate.density_graphs(pairs, [density]).collect()
        assert len(kept) == sum(v >= limit for v in values) and {r["threshold"] for r in kept} == {limit}


def test_distance_profile_equals_all_pairs(spark):
    """Two recordings; one in a line with a crowd in one place, nodes without a place or a module."""
    rng, rows = np.random.RandomState(9), []
    for k in (0, 1):
        for n in range(300):
            x = None if n == 7 else float("nan") if n == 8 else 40.0 if n % 5 == 0 else float(rng.rand() * 200)
            rows.append((k, n, x, float(rng.rand() * 200) * k, None if n % 11 == 0 else int(rng.randint(3))))
    df = spark.createDataFrame(rows, "k int, node_id long, x double, y double, module long")
    edges = [10.0, 25.0, 60.0]
    want = {}
    for k in (0, 1):
        own = [r for r in rows if r[0] == k]
        for a in range(300):
            for b in range(a):
                p, q = own[a], own[b]
                lost = any(v is None or v != v for v in (p[2], q[2]))
                t = want.setdefault((k, 3 if lost else int(np.searchsorted(edges, np.hypot(p[2] - q[2], p[3] - q[3]), "right"))), [0, 0, 0])
                known = p[4] is not None and q[4] is not None
                t[0], t[1], t[2] = t[0] + 1, t[1] + known, t[2] + (known and p[4] == q[4])
    for block in (2048, 40, 7):
        got = {(r["k"], r["bin"]): (r["n_pairs"], r["same"]) for r in spatial.same_module_by_distance(df, edges, ["k"], block).collect()}
        assert got == {at: (n, pytest.approx(same / known)) for at, (n, known, same) in want.items()}
    one = {r["bin"]: r["n_pairs"] for r in spatial.same_module_by_distance(df.where("k = 0"), [1000.0], block=50).collect()}
    assert one == {0: 298 * 297 // 2, 1: 300 * 299 // 2 - 298 * 297 // 2}
    assert [r["n_pairs"] for r in spatial.same_module_by_distance(df.limit(0).drop("k"), edges).orderBy("bin").collect()] == [0] * 4


def test_distance_profile_of_many_nodes(spark):
    import time

    n = 30_000
    df = spark.range(n).selectExpr("id AS node_id", "rand(1) * 3000 AS x", "rand(2) * 3000 AS y", "id % 20 AS module")
    began = time.time()
    got = spatial.same_module_by_distance(df, [50.0, 100.0, 200.0]).orderBy("bin").collect()
    assert sum(r["n_pairs"] for r in got) == n * (n - 1) // 2 and time.time() - began < 120
    assert all(abs(r["same"] - 0.05) < 2e-3 for r in got)
