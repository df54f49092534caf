"""Large graphs by rows of bands: codes of edges, resolutions together, Q from tiles, and vectors without a row a frame; rows of pairs in runs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popgraph import queries
from popgraph.functions import tables
from popgraph.operators import correlate, graph, louvain, tiles
from popgraph.plans import studies
from popgraph.sources import adapters as A

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark):
    """Tiles and edges of a graph of planted modules, with two nodes that are in none."""
    rng = np.random.RandomState(3)
    centre = rng.randn(5, 24)
    rows = [("g", 2 * i, (centre[i % 5] + 0.9 * rng.randn(24)).tolist() if i < 148 else [1.0] * 24) for i in range(150)]
    vectors = spark.createDataFrame(rows, "g string, node_id long, v array<double>")
    found = louvain.cut(correlate.density_tiles_of(vectors, [0.15], keys=["g"], block=24), "tiles").drop("density")
    return found, tiles.edges_of(found, ["g"])


@pytest.mark.parametrize("size", [0, 1, 9, 70_000])
def test_codes_give_the_places_back(size):
    rng = np.random.RandomState(size)
    for share in (0.0, 0.0005, 0.02, 0.1, 0.6, 1.0):
        at = np.flatnonzero(rng.rand(size) < share)
        code = correlate.coded(at, size)
        assert correlate.places(code, size).tolist() == at.tolist() and len(code) <= -(-size // 8)


def test_resolutions_together_come_near_those_apart(spark, planted):
    found, edges = planted
    small = tiles.sweep_louvain(found, ["g"], [0.5, 1.5], 2).toPandas()
    for gamma in (0.5, 1.5):
        apart = tiles.repeat_louvain(found, ["g"], 2, gamma).toPandas().sort_values(["run", "node_id"])
        own = small[small["gamma"] == gamma].sort_values(["run", "node_id"])
        assert own[["run", "seed", "q", "module"]].values.tolist() == apart[["run", "seed", "q", "module"]].values.tolist()
    large = tiles.sweep_louvain(found, ["g"], [0.5, 1.5], 2, kernel_edges=300).toPandas()
    assert len(large) == len(small) == 4 * 150 and not large.duplicated(["gamma", "run", "node_id"]).any()
    for gamma, rows in large.groupby("gamma"):
        again = graph.modularity_value(edges, spark.createDataFrame(rows[["g", "run", "node_id", "module"]]), gamma, ["g", "run"]).toPandas().set_index("run")["q"].sort_index()
        assert np.allclose(rows.groupby("run")["q"].max().sort_index(), again, atol=1e-9)
        assert rows["q"].max() >= 0.97 * small[small["gamma"] == gamma]["q"].max()


def test_bands_whose_modules_are_too_many_at_once(planted, monkeypatch):
    """Links of a few nodes at a time, and module pairs that no table holds, count the same."""
    row = {"band": 7, "others": np.array([7, 9]), "bands": np.array([7, 9]), "sizes": np.array([5, 4])}
    rng = np.random.RandomState(0)
    own = [np.flatnonzero(rng.rand(5 * tiles.TILE) < 0.1) for _ in range(2)]
    own = [x[x % tiles.TILE < n] for x, n in zip(own, (5, 4), strict=True)]
    row["codes"] = [correlate.coded(x, tiles.TILE**2) for x in own]
    labels = rng.randint(0, 3, (2, 9))
    want = [np.zeros((5, 3), int) for _ in range(2)]
    for begin, at in zip((0, 5), own, strict=True):
        for x in at:
            for run in range(2):
                want[run][x // tiles.TILE, labels[run][begin + x % tiles.TILE]] += 1
    band = tiles._Band(row, labels)
    for counted in (tiles.COUNTED, 1):
        monkeypatch.setattr(tiles, "COUNTED", counted)
        got = band.links([0, 1], [3, 3], 0, 5)
        assert [x.tolist() for x in got] == [x.tolist() for x in want]
        assert band.links([1], [3], 2, 4)[0].tolist() == want[1][2:4].tolist()


def test_modularity_of_tiles_is_that_of_edges(spark, planted):
    found, edges = planted
    rng = np.random.RandomState(1)
    runs = spark.createDataFrame(pd.DataFrame([("g", run, 2 * i, int(rng.randint(6))) for run in range(3) for i in range(150)], columns=["g", "run", "node_id", "module"]), "g string, run int, node_id long, module long")
    want = {r["run"]: r["q"] for r in graph.modularity_value(edges, runs, keys=["g", "run"]).collect()}
    got = {r["run"]: r["q"] for r in tiles.modularity_of(found, runs, ["g"]).collect()}
    assert got == pytest.approx(want, abs=1e-12) and len(got) == 3


def test_consistency_of_runs_makes_no_rows_of_edges(spark, monkeypatch):
    monkeypatch.setattr(tiles, "edges_of", None)
    rows = queries.QUERIES["g5_modularity_is_consistent"](spark, D).collect()
    assert rows and all(r["q_agrees"] and r["best_is_max"] and r["n_runs"] == 6 for r in rows)


def test_sweep_goes_through_the_edges_once(spark, monkeypatch):
    """All resolutions are one call."""
    calls, sweep = [], tiles.sweep_louvain
    monkeypatch.setattr(tiles, "sweep_louvain", lambda *a, **k: calls.append(a[2]) or sweep(*a, **k))
    rows = queries.QUERIES["g7_resolution_sweep"](spark, D).collect()
    assert calls == [[0.5, 1.0, 1.5, 2.0]] and [r["gamma"] for r in sorted(rows)] == calls[0]


def test_vectors_of_windows_are_those_of_the_activity(spark, monkeypatch):
    monkeypatch.setattr(A, "NODES_AT_ONCE", 4)
    w, keys = studies.windows(spark, D), ["state", "window"]
    for only, by in ((w, keys), (None, [])):
        cells = A.activity(spark, D) if only is None else A.activity(spark, D).join(only, "frame")
        want = correlate.as_vectors(cells, by).toPandas().sort_values([*by, "node_id"])
        got = A.activity_vectors(spark, D, only, by).toPandas().sort_values([*by, "node_id"])
        assert got[[*by, "node_id"]].values.tolist() == want[[*by, "node_id"]].values.tolist() and len(got) > 10
        assert [list(x) for x in got["v"]] == [list(x) for x in want["v"]]


def test_rows_in_runs_are_the_same(spark, tmp_path):
    n = 400_000
    pairs = spark.range(n, numPartitions=1).select((F.col("id") / 700).cast("long").alias("i"), (F.col("id") % 700).alias("j"), F.round(F.rand(1), 4).alias("r"))
    pairs.write.parquet(f"{tmp_path}/plain")
    pairs = spark.read.parquet(f"{tmp_path}/plain")
    tables.in_runs(pairs, "r", 150_000).write.parquet(f"{tmp_path}/runs")
    got = spark.read.parquet(f"{tmp_path}/runs")
    assert got.schema == pairs.schema and got.count() == n and got.exceptAll(pairs).isEmpty()

    order = np.array([r["r"] for r in got.select("r").collect()])
    assert (np.diff(order) < 0).sum() <= 3
    assert tables.in_runs(pairs.where("i < 0"), "r").count() == 0
