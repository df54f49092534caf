"""Products screened in single precision give the exact thresholds and edges; study_scale_maps does no work that nobody asked for."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popgraph import queries
from popgraph.operators import correlate, matching
from popgraph.sources import adapters as A


@pytest.mark.parametrize("width", [3, 100, correlate.SINGLE, correlate.SINGLE + 1])
def test_screened_products_are_within_slack(width):
    """Random rows, copies, opposite ones, a constant one and large offsets; a tile that is not whole."""
    rng = np.random.RandomState(1)
    v = rng.randn(60, width) * 10.0 ** rng.randint(-3, 4, (60, 1)) + 10.0 ** rng.randint(-3, 3, (60, 1))
    v = np.vstack([v, v[:20], -v[:20], np.ones((1, width))])
    tiles = correlate._Tiles(pd.DataFrame({"node_id": np.arange(len(v)), "v": list(v), "__b": np.arange(len(v)) % 2}), 0, 1)
    for (a, b, r, _), (a2, b2, near, _) in zip(tiles, tiles.screened(), strict=True):
        assert (a == a2).all() and (b == b2).all() and np.abs(r - near).max() < tiles.slack
        for share in (0.0, 0.02, 1.0):  # none, few one by one, and many by a product
            which = rng.rand(*r.shape) < share
            assert np.abs(tiles.exact(a, b, which) - r[which]).max(initial=0) <= 1.01e-9


def test_a_threshold_among_near_values(spark):
    """Values of |r| that single precision can't tell apart are still ranked; most pairs tie in the second key."""
    rng = np.random.RandomState(4)
    base = rng.randn(2, 50)
    rows = [("a", i, (base[0] + 1e-6 * i * base[1]).tolist()) for i in range(40)] + [("b", i, base[i % 2].tolist()) for i in range(40)]
    vectors = spark.createDataFrame(rows, "g string, node_id long, v array<double>")
    edges = correlate.density_graphs(correlate.correlations(vectors, ["g"]), [0.1, 0.6], keys=["g"])
    want = {(r["g"], r["density"]): (r["n"], r["t"]) for r in edges.groupBy("g", "density").agg(F.count("*").alias("n"), F.min("threshold").alias("t")).collect()}
    got = correlate.density_tiles_of(vectors, [0.1, 0.6], keys=["g"], block=16).groupBy("g", "density").agg(F.sum("n").alias("n"), F.min("threshold").alias("t")).collect()
    assert {(r["g"], r["density"]): (r["n"], r["t"]) for r in got} == want and len(want) == 4


def test_scale_maps_summary_aligns_nothing(spark, monkeypatch):
    monkeypatch.setattr(matching, "align_scales", None)
    per = queries.QUERIES["study_scale_maps"](spark, "/root/testdata/sf0.001").collect()
    assert [r["n_parcels"] for r in sorted(per)] == [15, 14]  # the users lie in 14 parcels of five


def test_activity_of_some_frames(spark):
    d = "/root/testdata/sf0.001"
    only = A.frames(spark, d).where("frame % 50 = 3").select("frame")
    got = A.activity(spark, d, only)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, A.activity(spark, d).join(only, "frame").select("node_id", "frame", "v").collect()))
