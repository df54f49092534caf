"""Graphs from vectors, Louvain in rounds of Spark jobs, and consensus without pairs of nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.operators import correlate, graph, louvain


@pytest.fixture(scope="module")
def planted(spark):
    """Two graphs of planted modules, and isolated nodes in the first."""
    rng, rows = np.random.RandomState(0), []
    for g, n, k, inside, outside in (("a", 90, 3, 0.5, 0.03), ("b", 200, 8, 0.4, 0.02)):
        i, j = np.triu_indices(n, 1)
        kept = rng.rand(len(i)) < np.where(i % k == j % k, inside, outside)
        rows += [(g, int(x), int(y), 1.0) for x, y in zip(i[kept], j[kept], strict=True)]
    nodes = [("a", i) for i in range(92)] + [("b", i) for i in range(200)]
    return spark.createDataFrame(rows, "g string, i long, j long, w double"), spark.createDataFrame(nodes, "g string, node_id long")


@pytest.mark.parametrize("warm_start", [True, False])
def test_rounds_find_what_the_kernel_finds(spark, planted, warm_start):
    edges, nodes = planted
    best = {}
    for most in (louvain.KERNEL_EDGES, 150):
        runs = louvain.repeat_louvain(edges, nodes, ["g"], 2, kernel_edges=most, warm_start=warm_start)
        assert runs.columns == ["g", "run", "seed", "q", "node_id", "module"]
        runs = runs.toPandas()
        assert runs.groupby(["g", "run"])["node_id"].nunique().to_dict() == {("a", 0): 92, ("a", 1): 92, ("b", 0): 200, ("b", 1): 200}
        assert len(runs) == 2 * 292
        again = graph.modularity_value(edges, spark.createDataFrame(runs[["g", "run", "node_id", "module"]]), keys=["g", "run"]).toPandas().set_index(["g", "run"])["q"]
        assert np.allclose(runs.groupby(["g", "run"])["q"].max().sort_index(), again.sort_index(), atol=1e-9)
        best[most] = runs.groupby("g")["q"].max()
    assert (best[150] >= 0.99 * best[louvain.KERNEL_EDGES]).all()


def test_loops_and_weights_count_in_rounds(spark):
    """Two pairs that hold together, one by a loop's weight."""
    rows = [("x", 0, 0, 3.0), ("x", 0, 1, 5.0), ("x", 2, 3, 4.0), ("x", 1, 2, 0.5)]
    edges, nodes = spark.createDataFrame(rows, "g string, i long, j long, w double"), spark.createDataFrame([("x", k) for k in range(4)], "g string, node_id long")
    for most in (100, 0):
        runs = louvain.repeat_louvain(edges, nodes, ["g"], 1, kernel_edges=most).toPandas()
        m = runs.set_index("node_id")["module"]
        assert m[0] == m[1] != m[2] == m[3]
        want = (3 + 5 + 4) / 12.5 - ((2 * 3 + 5 * 2 + 0.5) / 25) ** 2 - ((4 * 2 + 0.5) / 25) ** 2
        assert abs(runs["q"].iloc[0] - want) < 1e-12


def test_graphs_of_vectors_equal_those_of_pairs(spark):
    rng = np.random.RandomState(4)
    rows = [(k, i, np.round(rng.randn(12), 1).tolist() if i else [1.0] * 12) for k, n in ((0, 40), (1, 25), (2, 2)) for i in range(n)]
    vectors = spark.createDataFrame(rows, "k int, node_id long, v array<double>")
    for keys, rows in ((["k"], vectors), ([], vectors.where("k = 0").drop("k"))):
        for negative in (True, False):
            how = {"negative": negative, "weighted": True, "keys": keys}
            want = correlate.density_graphs(correlate.correlations(rows, keys), [0.01, 0.1, 1.0], **how).toPandas()
            got = correlate.density_graphs_of(rows, [0.01, 0.1, 1.0], block=7, **how).toPandas()
            order = [*keys, "density", "i", "j"]
            assert len(got) > 800 and got.sort_values(order).round(9).values.tolist() == want.sort_values(order).round(9).values.tolist()
    pairs = correlate.correlations(vectors.where("k = 0").drop("k"))
    grid = [0.0, 0.1, 0.5, 1.0]
    assert sorted(map(tuple, correlate.survival_of(vectors.where("k = 0").drop("k"), grid, block=9).collect())) == sorted(map(tuple, correlate.survival(pairs, grid).collect()))
    with pytest.raises(ValueError):
        correlate.density_graphs_of(vectors, [0.0])


def partition(rows):
    own = {}
    for node, module in rows:
        own.setdefault(module, set()).add(node)
    return {frozenset(s) for s in own.values()}


@pytest.mark.parametrize("tau", [0.0, 0.4])
def test_consensus_of_classes_equals_that_of_all_pairs(spark, tau):
    rng = np.random.RandomState(7)
    rows = []
    for g, n, k in (("a", 30, 3), ("b", 24, 4)):
        for run in range(8):
            label = np.arange(n) % k
            for node in rng.choice(n // 3, 2, replace=False):  # two thirds always go together
                label[node] = rng.randint(k)
            rows += [(g, run, node, int(label[node]) + 10 * run) for node in range(n)]
    runs = spark.createDataFrame(rows, "g string, run int, node_id long, module long")
    nodes = runs.select("g", "node_id").distinct()
    classes = louvain.signatures(runs, ["g"])
    assert classes.select("g", "class").distinct().count() < nodes.count()
    got = louvain.consensus_of_runs(runs, ["g"], tau=tau, reps=4, seed=3).collect()
    want = louvain.consensus(graph.agreement(runs, ["g"]), nodes, ["g"], tau=tau, reps=4, seed=3).collect()
    for g in "ab":
        assert partition((r["node_id"], r["module"]) for r in got if r["g"] == g) == partition((r["node_id"], r["module"]) for r in want if r["g"] == g)
        assert sorted({r["module"] for r in got if r["g"] == g}) == list(range(1, 1 + len({r["module"] for r in got if r["g"] == g})))


def test_votes_of_classes_are_those_of_their_pairs(spark):
    rng = np.random.RandomState(1)
    label = rng.randint(0, 3, (4, 6))
    runs = spark.createDataFrame([("a", run, node, int(label[run, node % 6])) for run in range(4) for node in range(15)], "g string, run int, node_id long, module long")
    classes = louvain.signatures(runs, ["g"])
    votes = louvain.class_votes(runs.join(classes.where("node_id = class").select("g", "node_id"), ["g", "node_id"]), classes, ["g"])
    total = votes.agg(F.sum(F.col("n") * F.col("agreement"))).first()[0]
    assert abs(total - graph.agreement(runs, ["g"]).agg(F.sum("agreement")).first()[0]) < 1e-9


def test_components_of_several_graphs(spark):
    edges = spark.createDataFrame([("a", 1, 2), ("a", 2, 3), ("b", 1, 5), ("b", 2, 3), ("b", 3, 5)], "g string, i long, j long")
    nodes = spark.createDataFrame([("a", k) for k in range(5)] + [("b", k) for k in (1, 2, 3, 5)], "g string, node_id long")
    got = {(r["g"], r["node_id"]): r["component"] for r in graph.components(edges, nodes, lambda df: louvain.cut(df, "components"), ["g"]).collect()}
    assert got == {("a", 0): 0, ("a", 1): 1, ("a", 2): 1, ("a", 3): 1, ("a", 4): 4, ("b", 1): 1, ("b", 2): 1, ("b", 3): 1, ("b", 5): 1}
