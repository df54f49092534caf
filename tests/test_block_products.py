"""Products of blocks: a bounded number of them, and what comes of them without any pair being written."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from popgraph.operators import correlate, graph


@pytest.fixture(scope="module")
def nodes(spark):
    """Vectors with ties, copies and a constant one; labels, some of them null."""
    rng = np.random.RandomState(2)
    rows = [(i, np.round(rng.randn(8), 1).tolist() if i % 9 else [0.5] * 8, int(rng.randint(4)) if i % 7 else None) for i in range(60)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(20)]
    return spark.createDataFrame(rows, "node_id long, v array<double>, module long")


def test_blocks_are_few_however_many_nodes(spark):
    rows = [(i, np.random.RandomState(i).randn(4).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "node_id long, v array<double>")

    def one(*_):
        yield pd.DataFrame({"n": [1]})

    assert correlate._products(vectors, [], 2, one, "n long").count() <= correlate.BLOCKS * (correlate.BLOCKS + 1) // 2
    assert correlate.correlations(vectors, block=2).select("i", "j").distinct().count() == 300 * 299 // 2


def test_several_tiles_of_a_block(spark):
    v = np.random.RandomState(5).randn(2 * correlate.TILE + 100, 6)
    vectors = spark.createDataFrame(list(enumerate(v.tolist())), "node_id long, v array<double>")
    r = np.abs(np.round(np.corrcoef(v)[np.triu_indices(len(v), 1)], correlate.DECIMALS))
    for block in (len(v), 700):
        got = correlate.density_counts_of(vectors, [0.001, 0.3], block=block).collect()
        for row in got:
            least = np.sort(r)[-int(row["density"] * r.size)]
            assert abs(row["threshold"] - least) < 2e-9 and abs(row["n_edges"] - int(row["density"] * r.size)) <= 2 and row["n_pairs"] == r.size
        assert len(got) == 2


@pytest.mark.parametrize("negative", [True, False])
def test_counts_and_modularity_are_those_of_the_edges(nodes, negative):
    pairs = correlate.correlations(nodes)
    for density in (0.01, 0.2, 1.0):
        edges = correlate.density_graphs(pairs, [density], negative)
        want = edges.agg(F.count("*").alias("n"), F.min("threshold").alias("t")).first()
        counts = correlate.density_counts_of(nodes, [density], negative, block=11).first()
        assert (counts["n_edges"], counts["threshold"], counts["n_pairs"]) == (want["n"], want["t"], 80 * 79 // 2)
        got = correlate.label_modularity_of(nodes, density, negative, block=11).first()
        q = graph.modularity_value(edges, nodes.select("node_id", "module")).first()["q"]
        assert (got["n_edges"], got["threshold"]) == (want["n"], want["t"]) and abs(got["q"] - q) < 1e-12


def test_links_have_the_components_of_the_edges(nodes, tmp_path):
    paths = iter(range(1000))

    def written(df):
        path = f"file://{tmp_path}/{next(paths)}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    for density in (0.005, 0.02):
        edges = correlate.density_graphs(correlate.correlations(nodes), [density]).select("i", "j")
        links = correlate.density_links_of(nodes, density, block=11)
        want, got = (sorted(map(tuple, graph.components(e, nodes.select("node_id"), written).collect())) for e in (edges, links))
        assert got == want and len({c for _, c in got}) > 1
    assert correlate.density_links_of(nodes, 1.0, block=40).count() <= 2 * 3 * 80


def test_quantiles_of_all_pairs(spark, nodes):
    r = np.array([x["r"] for x in correlate.correlations(nodes).collect()])
    shares = [0.0, 0.02, 0.5, 0.995, 1.0]
    for absolute in (True, False):
        got = correlate.quantiles_of(nodes, shares, absolute, block=11).first()
        assert np.allclose(list(got), np.quantile(np.abs(r) if absolute else r, shares), atol=1e-12)
    assert list(correlate.quantiles_of(nodes.where("node_id = 1"), [0.5]).first()) == [None]


def plain_agreement(rows, n_runs):
    """{(i, j): runs in which both are in one module, over the runs} of (run, node, module)."""
    out = {}
    for run, i, m in rows:
        for other, j, k in rows:
            if run == other and None not in (run, m) and m == k and i < j:
                out[i, j] = out.get((i, j), 0) + 1 / n_runs
    return out


@pytest.mark.parametrize("kind", ["long", "double", "string"])
def test_agreement_of_blocks_equals_the_join(spark, kind):
    """Nodes without a module or a run, with two modules in a run, and runs of two keys."""
    rng = np.random.RandomState(3)
    name = {"long": int, "double": lambda m: -0.0 if m == 0 and rng.rand() < 0.5 else float(m), "string": lambda m: f"m{m}"}[kind]
    own = {g: [(f"r{run}", node, None if rng.rand() < 0.1 else name(rng.randint(4))) for run in range(n_runs) for node in range(40) if rng.rand() < 0.9] for g, n_runs in (("a", 3), ("b", 5))}
    own["a"] += [("r0", 7, name(1)), ("r0", 7, name(2)), ("r9", 50, None), (None, 3, name(1)), (None, 4, name(1))]
    runs = spark.createDataFrame([(g, *r) for g, rows in own.items() for r in rows] + [(None, "r0", 1, name(1)), (None, "r0", 2, name(1))], f"g string, run string, node_id long, module {kind}")
    for block in (graph.BLOCK, 9):
        got = graph.agreement(runs, ["g"], block=block).collect()
        assert len(got) == len({(r["g"], r["i"], r["j"]) for r in got})
        for g, n_runs in (("a", 4), ("b", 5)):
            assert {(r["i"], r["j"]): r["agreement"] for r in got if r["g"] == g} == pytest.approx(plain_agreement(own[g], n_runs))
        assert {r["g"] for r in got} == {"a", "b"}
    assert {(r["i"], r["j"]): r["agreement"] for r in graph.agreement(runs.where("g = 'b'").drop("g"), decimals=1).collect()} == pytest.approx({k: round(v, 1) for k, v in plain_agreement(own["b"], 5).items()})
    assert graph.agreement(runs.where("module is null")).count() == 0


def test_agreement_shuffles_no_pairs(spark):
    """Two runs of one module each: every pair of nodes is a row, and none is shuffled."""
    n = 1500
    runs = spark.range(n).selectExpr("id as node_id", "explode(array(0, 1)) as run", "0L as module")
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark._jvm.double, 0)

    def shuffled():
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))

    before = shuffled()
    got = graph.agreement(runs).agg(F.count("*").alias("n"), F.min("agreement").alias("least")).first()
    assert (got["n"], got["least"]) == (n * (n - 1) // 2, 1.0)
    assert shuffled() - before < 40 * n
