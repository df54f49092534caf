"""The Louvain kernel on packed graphs, and Q of many runs of one graph."""

import numpy as np
from pyspark.sql import functions as F

from popgraph.operators import graph, louvain


def test_places_of_sorted_edges_are_those_of_sorting_both_ways():
    rng = np.random.RandomState(0)
    i, j = np.triu_indices(40, 1)
    kept = rng.rand(len(i)) < 0.2
    i, j = i[kept], j[kept]
    for w in (np.ones(len(i)), rng.rand(len(i))):
        mixed = rng.permutation(len(i))
        want, got = louvain._csr(40, i[mixed], j[mixed], w[mixed]), louvain._csr(40, i, j, w)
        assert (want[0] == got[0]).all() and (want[1] == got[1]).all()
        assert got[2] is None and (want[2] == 1).all() if (w == 1).all() else (want[2] == got[2]).all()


def test_a_graph_is_a_few_rows_for_each_run(spark):
    edges = spark.range(0, 5000, 1, 2).select(F.lit("a").alias("g"), F.col("id").alias("i"), (F.col("id") + 1).alias("j"), F.lit(1.0).alias("w"))
    packed = louvain._packed(edges, ["g"]).collect()
    assert len(packed) <= 4 and sorted(x for r in packed for x in np.frombuffer(r["i"], np.int64)) == list(range(5000))


def test_q_of_runs_is_that_of_each_run(spark):
    rng = np.random.RandomState(3)
    edges = spark.createDataFrame([(g, int(i), int(j), float(rng.rand())) for g in "ab" for i in range(12) for j in range(i + 1, 12) if rng.rand() < 0.4], "g string, i long, j long, w double")
    rows = [(g, run, i, int(rng.randint(3)) if rng.rand() < 0.9 else None) for g in "ab" for run in range(4) for i in range(12) if (run, i) != (2, 5)]
    runs = spark.createDataFrame(rows, "g string, run int, node_id long, module long")
    got = {(r["g"], r["run"]): r["q"] for r in graph.modularity_value(edges, runs, keys=["g", "run"]).collect()}
    assert len(got) == 8
    for run in range(4):
        for r in graph.modularity_value(edges, runs.where(F.col("run") == run).drop("run"), keys=["g"]).collect():
            assert abs(got[r["g"], run] - r["q"]) < 1e-12
    plan = graph.modularity_value(edges, runs, keys=["g", "run"])._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan  # an edge is not repeated for each run
