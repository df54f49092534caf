"""Fixed small inputs with known results."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from popgraph.functions import dims, signal, stats
from popgraph.operators import cohort, correlate, graph, louvain, matching, physiology, selection, sequence, spatial
from popgraph.sources import recordings


def frames_of(spark, values, name="frame"):
    return spark.createDataFrame(list(enumerate(values)), f"pos long, {name} long")


def test_windows_go_across_gaps(spark):
    f = frames_of(spark, [0, 1, 10, 11, 12, 20, 21])
    got = selection.frame_windows(f, 3).groupBy("window").agg(F.sort_array(F.collect_list("frame")).alias("x")).orderBy("window").collect()
    assert [list(r["x"]) for r in got] == [[0, 1, 10], [11, 12, 20]]
    f = frames_of(spark, range(12))
    assert sorted(r["frame"] for r in selection.frame_windows(f, 3, 2).where("window = 1").collect()) == [3, 4, 5]
    assert selection.frame_windows(f, 3, 0).count() == 0
    with pytest.raises(TypeError):
        selection.frame_windows(f, True)
    with pytest.raises(ValueError):
        selection.frame_windows(f, 0)


def test_contiguous_runs(spark):
    got = sequence.contiguous_runs(frames_of(spark, [10, 11, 20, 21, 22, 40])).orderBy("pos").collect()
    assert [r["run"] for r in got] == [0, 0, 1, 1, 1, 2]


def test_circular_shuffle(spark):
    frames = [0, 1, 2, 10, 11, 20]
    cells = [(n, f, float(100 * n + f)) for n in (0, 1) for f in frames]
    act = spark.createDataFrame(cells, "node_id long, frame long, v double")
    got = sequence.circular_shuffle(act, frames_of(spark, frames), 7).orderBy("node_id", "pos").collect()
    assert [r["v"] for r in got] == [1, 2, 0, 11, 10, 20, 102, 100, 101, 111, 110, 120]
    with pytest.raises(ValueError):
        sequence.circular_shuffle(act.where("frame != 2"), frames_of(spark, frames), 7)


def test_segments_and_state_runs(spark):
    n = spark.createDataFrame([(10,)], "n_frames long")
    b = spark.createDataFrame([(2,), (7,)], "frame long")
    e = spark.createDataFrame([(5,), (0,), (11,)], "stop long")
    got = sequence.acquisition_segments(n, b, e).orderBy("start").collect()
    assert [tuple(r) for r in got] == [(0, 3), (3, 5), (5, 8), (8, 10)]
    assert sequence.acquisition_segments(spark.createDataFrame([(0,)], "n_frames long"), b).count() == 0
    f = spark.createDataFrame(list(enumerate([0.0, 0.0, 1.0, 1.0, 0.5])), "frame long, state_code double")
    assert [tuple(r) for r in sequence.state_runs(f).orderBy("start").collect()] == [(0, 2, 0.0), (2, 4, 1.0), (4, 5, 0.5)]


@pytest.mark.parametrize("width", [1, 2, 3, 4, 5, 8, 50])
def test_moving_average_is_an_edge_normalised_convolution(spark, width):
    x = np.random.RandomState(0).rand(20)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "frame long, v double")
    got = [r["smoothed"] for r in sequence.moving_average(df, width).orderBy("frame").collect()]
    w = min(width, len(x))
    want = np.convolve(x, np.ones(w), "same") / np.convolve(np.ones(len(x)), np.ones(w), "same")
    np.testing.assert_allclose(got, want[: len(x)])


def test_short_and_segmented_averages(spark):
    df = spark.createDataFrame([(0, 2.0), (1, 4.0)], "frame long, v double")
    assert [r["smoothed"] for r in sequence.moving_average(df, 5).orderBy("frame").collect()] == [2.0, 3.0]
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, 1.0), (2, 1, 9.0), (3, 1, 9.0)], "frame long, segment int, v double")
    assert [r["smoothed"] for r in sequence.moving_average(df, 5, keys=["segment"]).orderBy("frame").collect()] == [1, 1, 9, 9]


def test_merge_short_runs():
    a, r, n = "awake", "rem", "nrem"
    assert sequence.merge_short([a] * 3 + [r] + [a] * 3, 2) == [a] * 7
    assert sequence.merge_short([a] * 2 + [r] + [n] * 4, 2) == [a] * 2 + [n] * 5
    assert sequence.merge_short([a] * 3 + [r] * 2 + [n] * 3, 2) == [a] * 3 + [r] * 2 + [n] * 3
    assert sequence.merge_short([], 2) == [] and sequence.merge_short([a], 5) == [a]


def test_binned_raster(spark):
    spikes = {0: [0, 1, 4], 1: [1, 2, 6, 9], 2: [3, 8]}
    act = spark.createDataFrame([(n, f, float(f in s)) for n, s in spikes.items() for f in range(10)], "node_id long, frame long, v double")
    frames = spark.createDataFrame([(f, float(f >= 7)) for f in range(10)], "frame long, state_code double")
    raster, active = sequence.binned_raster(act, frames, spark.createDataFrame([(3,)], "frame long"), 3.0, 1.0)
    rows = raster.orderBy("rank", "bin").collect()
    assert [r["node_id"] for r in rows[::4]] == [1, 0, 2]
    assert [r["centre"] for r in rows[:4]] == [1, 3, 5, 8]
    assert np.array([r["fired"] for r in rows]).reshape(3, 4).tolist() == [[1, 0, 1, 1], [1, 0, 1, 0], [0, 1, 0, 1]]
    assert [r["n_active"] for r in active.orderBy("frame").collect()] == [1, 2, 1, 1, 1, 0, 1, 0, 1, 1]
    assert sequence.occupied(raster).count() == 7


def test_node_selection(spark):
    nodes = spark.createDataFrame([(i, a) for i, a in enumerate([True, False, True, True, False, True, True])], "node_id long, active boolean")
    ids = lambda df: sorted(r["node_id"] for r in df.collect())
    assert ids(selection.active_nodes(nodes)) == [0, 2, 3, 5, 6]
    assert ids(selection.sampled_nodes(nodes, 3, 0)) == [0, 2, 3]
    assert ids(selection.active_nodes(nodes.withColumn("active", F.lit(None).cast("boolean")))) == list(range(7))
    for bad in (0, -1):
        with pytest.raises(ValueError):
            selection.sampled_nodes(nodes, bad)
    with pytest.raises(TypeError):
        selection.sampled_nodes(nodes, True)
    used = spark.createDataFrame([("awake", 0, 5)], "state string, pos long, frame long")
    with pytest.raises(KeyError, match="awake"):
        selection.state_frames(used, "rem")


def test_state_codes_and_regions(spark):
    assert len(dims.state_codes("sleep")) == 4 and len(dims.state_codes("ane")) == 2
    with pytest.raises(ValueError):
        dims.state_codes("other")
    labels = ["MOs2/3", "SSp-bfd2/3", "RSPd2/3", "VISp2/3", "root", " NaN ", None, "VISal2/3", "Unassigned", "unassigned", ""]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "i int, a string")
    got = [r[0] for r in df.orderBy("i").select(dims.region_category(F.col("a"))).collect()]
    assert got == ["MOs", "SSp-bfd", "RSPd", "VISp", "Unassigned", "Unknown", "Unknown", "Other", "Unassigned", "Unknown", "Unknown"]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "node_id long, v array<double>")


def test_three_node_pipeline(spark):
    v = vectors(spark, [[0, 1, 2, 3], [0, 1, 2, 3], [3, 2, 1, 0]])
    edges = correlate.density_graphs(correlate.correlations(v), [1 / 3], negative=False)
    assert [(r["i"], r["j"], r["threshold"]) for r in edges.collect()] == [(0, 1, 1.0)]
    nodes = v.select(F.lit(0).alias("g"), "node_id")
    runs = louvain.repeat_louvain(edges.withColumn("g", F.lit(0)), nodes, ["g"], 2, seed=5).collect()
    assert {r["q"] for r in runs} == {0.0}
    first = {r["node_id"]: r["module"] for r in runs if r["run"] == 0}
    assert first[0] == first[1] != first[2]


def test_ties_constant_nodes_and_blocks(spark):
    rows = np.random.RandomState(1).randint(0, 3, (40, 6)).astype(float)
    rows[7] = 2.0
    v = vectors(spark, rows)
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.nan_to_num(np.corrcoef(rows))
    for block in (4, 64):
        got = {(r["i"], r["j"]): r["r"] for r in correlate.correlations(v, block=block).collect()}
        assert len(got) == 40 * 39 // 2
        assert max(abs(got[i, j] - c[i, j]) for i, j in got) < 1e-8
    pairs = correlate.correlations(v)
    values = np.sort(np.abs(np.round([c[i, j] for i in range(40) for j in range(i + 1, 40)], 9)))[::-1]
    for density in (0.01, 0.05, 0.3):
        m = max(1, int(np.floor(density * len(values))))
        e = correlate.density_graphs(pairs, [density]).collect()
        assert len(e) == (values >= values[m - 1] - 1e-12).sum() >= m


def test_louvain_reaches_the_optimum_of_small_graphs():
    rng = np.random.RandomState(3)

    def partitions(n):
        def go(k, labels, most):
            if k == n:
                yield np.array(labels)
            else:
                for x in range(most + 1):
                    yield from go(k + 1, [*labels, x], max(most, x + 1))

        return go(0, [], 0)

    for _ in range(4):
        n = 6
        i, j = np.array([p for p in zip(*np.triu_indices(n, 1), strict=True) if rng.rand() < 0.5] or [(0, 1)]).T
        w = np.ones(len(i))
        best = max(louvain.quality(n, i, j, w, c, 1.0) for c in partitions(n))
        got = max(louvain.louvain(n, i, j, w, 1.0, s, None)[1] for s in range(20))
        assert abs(best - got) < 1e-9
    cliques = [(a + 5 * k, b + 5 * k) for k in range(4) for a in range(5) for b in range(a + 1, 5)] + [(4, 5), (9, 10), (14, 15)]
    i, j = np.array(cliques).T
    c, q = louvain.louvain(20, i, j, np.ones(len(i)), 1.0, 1)
    assert len({tuple(c[5 * k : 5 * k + 5]) for k in range(4)}) == 4 == len(set(c))
    assert (louvain.louvain(20, i, j, np.ones(len(i)), 1.0, 1)[0] == c).all()


def test_giant_start_and_components(spark):
    nodes = spark.createDataFrame([(i,) for i in range(7)], "node_id long")
    edges = spark.createDataFrame([(1, 2), (2, 4), (5, 6)], "i long, j long")
    comp = graph.components(edges, nodes, lambda df: spark.createDataFrame(df.toPandas(), df.schema))
    assert {r["node_id"]: r["component"] for r in comp.collect()} == {0: 0, 1: 1, 2: 1, 4: 1, 3: 3, 5: 5, 6: 5}
    got = {r["node_id"]: r["module"] for r in graph.giant_start(comp).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 1, 4: 4, 5: 1, 6: 1}
    start = louvain.start_of(7, np.array([1, 2, 5]), np.array([2, 4, 6]))
    assert (start + 1).tolist() == [got[i] for i in range(7)]


def test_localization_and_distance_bins(spark):
    xy = [(0, 0), (0, 1), (10, 0), (10, 1)]
    for modules, want in (([0, 0, 1, 1], 2.0), ([0, 1, 0, 1], 0.0)):
        n = spark.createDataFrame([(i, float(x), float(y), m) for i, ((x, y), m) in enumerate(zip(xy, modules, strict=True))], "node_id long, x double, y double, module long")
        assert spatial.localization_index(n).first()["localization"] == want
    got = spatial.same_module_by_distance(n, [2.0, 5.0]).orderBy("bin").collect()
    assert [(r["n_pairs"], r["same"]) for r in got] == [(2, 0.0), (0, None), (4, 0.5)]


def test_distances_stay_within_a_recording(spark):
    rows = [("a", 0, 0.0, 0.0, 1), ("a", 1, 3.0, 4.0, 1), ("b", 0, 0.0, 0.0, 1), ("b", 1, 0.0, 1.0, 2), ("b", 2, 0.0, 1.0, 2)]
    n = spark.createDataFrame(rows, "recording string, node_id long, x double, y double, module long")
    got = sorted((r["recording"], r["i"], r["j"], r["d"]) for r in spatial.pair_distances(n, ["recording"]).collect())
    assert got == [("a", 0, 1, 5.0), ("b", 0, 1, 1.0), ("b", 0, 2, 1.0), ("b", 1, 2, 0.0)]
    near = {(r["recording"], r["node_id"]): r["neighbour"] for r in spatial.nearest(n, ["recording"]).collect()}
    assert near == {("a", 0): 1, ("a", 1): 0, ("b", 0): 1, ("b", 1): 2, ("b", 2): 1}
    loc = {r["recording"]: r["localization"] for r in spatial.localization_index(n, ["recording"]).collect()}
    assert loc["a"] == 1.0 and abs(loc["b"] - (2 / 3) / (5 / 9)) < 1e-12
    bins = spatial.same_module_by_distance(n, [2.0], ["recording"]).orderBy("recording", "bin").collect()
    assert [(r["n_pairs"], r["same"]) for r in bins] == [(0, None), (1, 1.0), (3, 1 / 3), (0, None)]


def test_nearest_equals_brute_force(spark):
    rng = np.random.RandomState(5)
    xy = np.concatenate([rng.randint(0, 12, (60, 2)), [[500, 500], [500, -300]], rng.rand(30, 2) * 40]).astype(float)
    n = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "node_id long, x double, y double")
    d = np.hypot(xy[:, None, 0] - xy[None, :, 0], xy[:, None, 1] - xy[None, :, 1])
    np.fill_diagonal(d, np.inf)
    got = {r["node_id"]: r["neighbour"] for r in spatial.nearest(n).collect()}
    assert got == dict(enumerate(d.argmin(axis=1).tolist()))
    same = spark.createDataFrame([(i, 1.0, 1.0) for i in range(3)], "node_id long, x double, y double")
    assert {r["node_id"]: r["neighbour"] for r in spatial.nearest(same).collect()} == {0: 1, 1: 0, 2: 0}


def test_modularity_with_keys_and_runs(spark):
    edges = spark.createDataFrame([("g", 0, 1, 1.0), ("g", 2, 3, 1.0), ("h", 0, 1, 1.0)], "g string, i long, j long, w double")
    part = spark.createDataFrame([(g, run, n, (n // 2) if run else 0) for g in "gh" for run in (0, 1) for n in range(4)], "g string, run int, node_id long, module long")
    got = {(r["g"], r["run"]): r["q"] for r in graph.modularity_value(edges, part, keys=["g", "run"]).collect()}
    assert got == {("g", 0): 0.0, ("g", 1): 0.5, ("h", 0): 0.0, ("h", 1): 0.0}
    none = graph.modularity_value(edges.where("false"), part.where("run = 0 and g = 'g'").drop("g", "run"))
    assert none.first()["q"] == 0.0


def test_densities_per_graph(spark):
    rng = np.random.RandomState(0)
    v = spark.createDataFrame([(g, n, rng.rand(8).tolist()) for g in ("a", "b") for n in range(12 if g == "a" else 7)], "g string, node_id long, v array<double>")
    e = correlate.density_graphs(correlate.correlations(v, ["g"], block=5), [0.1, 0.5], keys=["g"])
    got = {(r["g"], r["density"]): r["count"] for r in e.groupBy("g", "density").count().collect()}
    assert got == {("a", 0.1): 6, ("a", 0.5): 33, ("b", 0.1): 2, ("b", 0.5): 10}
    for bad in ([], [0.0], [1.5], [True]):
        with pytest.raises(ValueError):
            correlate.density_graphs(e, bad)


def test_parcels():
    x, y = np.array([0.0, 1, 5, 6, 9]), np.zeros(5)
    assert spatial.parcel(x, y, 2).tolist() == [0, 0, 1, 1, 2]
    assert spatial.parcel(x, y, 1).tolist() == list(range(5))
    for n in (1, 7, 23):
        p = spatial.parcel(np.random.RandomState(n).rand(n), np.random.RandomState(n + 1).rand(n), 4)
        assert p.max() + 1 == math.ceil(n / 4) and np.bincount(p).max() <= 4


def test_confidence_intervals(spark):
    data = {0: [1, 2, 3], 1: [10, math.nan, 14], 2: [math.nan, math.nan, 9], 3: [math.nan] * 3}
    df = spark.createDataFrame([(k, float(v)) for k, own in data.items() for v in own], "k int, v double")
    got = stats.mean_confidence_interval(df, ["k"], "v").orderBy("k").collect()
    assert [r["mean"] for r in got] == [2, 12, 9, None]
    np.testing.assert_allclose([got[0]["lower"], got[1]["lower"], got[0]["upper"], got[1]["upper"]], [-0.4841377117503303, -13.41240947234939, 4.48413771175033, 37.41240947234939], rtol=1e-10)
    assert got[2]["lower"] is None and got[3]["upper"] is None
    for bad in (0, 1, -0.1, 1.1):
        with pytest.raises(ValueError):
            stats.mean_confidence_interval(df, ["k"], "v", bad)
    assert abs(stats.t_quantile(0.975, 500) - 1.9647198374673438) < 1e-9


def test_day_means_differ_from_pooled_windows(spark):
    rows = spark.createDataFrame([("m", "d1", "awake", 1.0), ("m", "d1", "awake", 3.0), ("m", "d2", "awake", 8.0)], "mouse string, recording string, state string, q double")
    assert cohort.mean_of_day_means(rows, "q", ["state"]).first()["value"] == 5.0
    assert cohort.pooled_means(rows, "q", ["state"]).first()["value"] == 4.0


def edges_table(spark, groups):
    return spark.createDataFrame([(s,) for g in groups for s in g], "sample long")


def test_trigger_groups_split_at_gaps_and_parts(spark):
    e = edges_table(spark, [range(10, 61, 10)])
    g = physiology.trigger_groups(e, spark.createDataFrame([(35,)], "sample long")).orderBy("sample").collect()
    assert [r["bout"] for r in g] == [0, 0, 0, 1, 1, 1] and g[0]["period"] == 10
    trace = spark.createDataFrame(list(enumerate([3.2, 3.2, 0.0, 0.0, 3.2, 0.0])), "sample long, v double")
    assert sorted(r["sample"] for r in physiology.rising_edges(trace, 1.0).collect()) == [0, 4]
    with pytest.raises(ValueError):
        physiology.check_edges(physiology.rising_edges(trace, 100.0))


def test_alignment_of_triggers(spark):
    a = physiology.trigger_groups(edges_table(spark, [[10, 20], range(100, 141, 10), range(250, 291, 10)]))
    table, counts = physiology.align_triggers(a, [(0, 5), (5, 8)], 100.0, 10.0, 300)
    got = table.orderBy("segment").select("frame_start", "frame_stop", "sample_start", "sample_stop", "bout_size").collect()
    assert [tuple(r) for r in got] == [(0, 5, 100, 150, 5), (5, 8, 250, 280, 5)]
    assert (counts["detected"], counts["mapped"], counts["ignored"]) == (12, 8, 4)
    b = physiology.trigger_groups(edges_table(spark, [[10, 20], range(100, 141, 10)]))
    table, _ = physiology.align_triggers(b, [(0, 3)], 100.0, 10.0, 300, "mouse01_sleep")
    r = table.first()
    assert (r["bout"], r["offset"], r["sample_start"], r["sample_stop"]) == (1, 2, 120, 150)
    with pytest.raises(ValueError):
        physiology.align_triggers(b, [(0, 3)], 100.0, 10.0, 300, "mouse01_sleep", exact_sizes=True)
    c = physiology.trigger_groups(edges_table(spark, [[10, 20, 30], [100, 110, 120], [200, 210, 220]]))
    table, _ = physiology.align_triggers(c, [(0, 3), (3, 6)], 100.0, 10.0, 300, "mouse07_ane")
    assert [(r["bout"], r["sample_start"]) for r in table.orderBy("segment").collect()] == [(0, 10), (2, 200)]
    with pytest.raises(ValueError):
        physiology.align_triggers(c, [(0, 9)], 100.0, 10.0, 300)


def aligned_of(spark, n_samples, triggers):
    return spark.createDataFrame([(0, 0, 0, n_samples, list(triggers))], "segment int, frame_start long, sample_start long, sample_stop long, triggers array<long>")


def samples_of(spark, eeg, emg):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"sample": np.arange(len(eeg)), "eeg": eeg, "emg": emg}))


def test_spectrogram_of_a_sine(spark):
    t = np.arange(20_000) / 1000
    s = samples_of(spark, np.sin(2 * np.pi * 10 * t), np.zeros(len(t)))
    got = physiology.eeg_spectrogram(s, aligned_of(spark, len(t), range(0, 20_000, 100)), 1000.0, 10.0).toPandas()
    mean = got.groupby("frequency")["power_db"].mean()
    assert abs(mean.idxmax() - 10) <= 0.6 and np.isfinite(got["power_db"]).all()
    assert got["minute"].min() >= 0 and got["minute"].max() <= 200 / 10 / 60


def test_envelope_of_a_burst(spark):
    t = np.arange(1000) / 1000
    s = samples_of(spark, np.zeros(1000), np.sin(2 * np.pi * 100 * t) * ((t >= 0.2) & (t < 0.5)))
    got = physiology.emg_envelope(s, aligned_of(spark, 1000, range(0, 1000, 100)), 1000.0, 10.0).toPandas()
    assert (got["amplitude"] >= 0).all() and got["amplitude"].max() > 0.25


def test_features_of_two_rhythms(spark):
    t = np.arange(12_000) / 1000
    eeg = np.where(t < 6, np.sin(2 * np.pi * 2 * t), np.sin(2 * np.pi * 7 * t))
    s = samples_of(spark, eeg, np.sin(2 * np.pi * 100 * t) * (t < 4))
    f = physiology.scoring_features(s, aligned_of(spark, 12_000, range(0, 12_000, 100)), 1000.0, 10.0, chunk=7).toPandas().sort_values("frame")
    assert f["frame"].tolist() == list(range(20, 101))
    early, late = f.iloc[0], f.iloc[-1]
    assert all(early[c] > late[c] for c in ("relative_delta", "delta_theta_ratio", "emg_rms"))
    np.testing.assert_allclose(f["delta_theta_ratio"], f["relative_delta"] * f["raw_ratio"], rtol=2e-6)


def test_emg_threshold_and_rule(spark):
    rows = [(5.0, "awake"), (4.0, "awake"), (2.0, "nrem"), (1.0, "rem"), (100.0, "quiet_awake")]
    r = physiology.fit_emg_threshold(spark.createDataFrame(rows, "emg_rms double, state string")).first()
    assert 2 < r["threshold"] < 4 and r["balanced_accuracy"] == 1 and (r["n_awake"], r["n_sleep"]) == (2, 2)
    w = spark.createDataFrame([(0, 2.0, 10.0), (1, 0.1, 1.0), (2, 0.1, 0.1), (3, 1.0, 0.1), (4, 0.1, 0.3)], "i int, emg_rms double, delta_theta_ratio double")
    assert [x["scored"] for x in physiology.classify_sleep(w, 1.0).orderBy("i").collect()] == ["awake", "nrem", "rem", "awake", "nrem"]


def test_interpolation_clamps(spark):
    p = spark.createDataFrame([("a", x) for x in (0, 5, 10, 15, 30)], "k string, x long")
    a = spark.createDataFrame([("a", 5, 1.0), ("a", 15, 3.0)], "k string, x long, y double")
    assert [r["y"] for r in physiology.interpolate(p, a, ["k"]).orderBy("x").collect()] == [1, 1, 2, 3, 3]


def test_filter_and_resampling():
    sos = signal.butter_bandpass(4, 20, 200, 1000)
    z = np.exp(2j * np.pi * np.array([60.0, 20, 200, 2, 450]) / 1000)
    h = np.prod([(s[0] + s[1] / z + s[2] / z**2) / (1 + s[4] / z + s[5] / z**2) for s in sos], axis=0)
    np.testing.assert_allclose(np.abs(h[:3]), [1, 2**-0.5, 2**-0.5], atol=2e-3)
    assert np.abs(h[3:]).max() < 0.01
    t = np.arange(5000) / 1000
    x = signal.resample(np.sin(2 * np.pi * 5 * t), 1000, 250)
    assert len(x) == 1250 and np.abs(x - np.sin(2 * np.pi * 5 * np.arange(1250) / 250))[50:-50].max() < 2e-3


def test_assignment_is_optimal():
    from itertools import permutations

    rng = np.random.RandomState(0)
    for n, m in ((3, 3), (3, 5), (5, 3), (1, 4)):
        c = rng.rand(n, m)
        got = matching.assign(c)
        k = min(n, m)
        a = c if n <= m else c.T
        best = min(sum(a[i, p[i]] for i in range(k)) for p in permutations(range(max(n, m)), k))
        assert len(got) == k and abs(sum(c[i, j] for i, j in got) - best) < 1e-12


def test_modules_keep_their_ids_over_scales(spark):
    rows = [(1, n, 1 if n < 6 else 2) for n in range(10)] + [(5, n, 9 if n < 5 else 4 if n < 9 else 7) for n in range(10)]
    got = {(r["scale"], r["module"]): r["id"] for r in matching.align_scales(spark.createDataFrame(rows, "scale int, node_id long, module long"), [1, 5]).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (5, 9): 0, (5, 4): 1, (5, 7): 2}


def packed(strings):
    units = b"".join(s.encode("utf-16-le") for s in strings)
    units += b"\0" * (-len(units) % 8)
    return [1, 2, len(strings), 1, *[len(s.encode("utf-16-le")) // 2 for s in strings], *[int.from_bytes(units[k : k + 8], "little") for k in range(0, len(units), 8)]]


def test_packed_strings():
    strings = ["MOs2/3", "SSp-bfd2/3", "RSPd2/3", "root", ""]
    assert recordings.decode_strings(packed(strings)) == strings
    for bad in ([1, 3, *packed(strings)[2:]], packed(strings)[:-1], [1, 2]):
        with pytest.raises(ValueError):
            recordings.decode_strings(bad)


def test_parts_follow_each_other(spark):
    rows = [("m6", 0, k, 1.0) for k in range(6)] + [("m6", 1, k, 2.0) for k in range(4)]
    got = recordings.concat_parts(spark.createDataFrame(rows, "recording string, part int, sample long, eeg double")).orderBy("sample").collect()
    assert [r["eeg"] for r in got] == [1.0] * 6 + [2.0] * 4 and [r["sample"] for r in got] == list(range(10))


def test_misaligned_tables_are_found(spark):
    one = lambda rows, ddl: spark.createDataFrame(rows, "recording string, " + ddl)
    nodes, frames = one([("r", 0)], "node_id long"), one([("r", 0), ("r", 1)], "frame long")
    used, act = one([("r", 5)], "frame long"), one([("r", 0, 0), ("r", 0, 1), ("r", 1, 0)], "node_id long, frame long")
    got = {r["problem"]: r["n"] for r in recordings.misaligned(nodes, frames, used, act).collect()}
    assert got == {"activity of unknown nodes": 1, "used frames that are not recorded": 1, "nodes with missing frames": 1}


def test_consensus_of_agreeing_runs(spark):
    rows = [(0, run, n, 1 if n < 3 else 2) for run in range(4) for n in range(6)]
    runs = spark.createDataFrame(rows, "g int, run int, node_id long, module long")
    nodes = runs.select("g", "node_id").distinct()
    got = {r["node_id"]: r["module"] for r in louvain.consensus(graph.agreement(runs, ["g"]), nodes, ["g"], 0.5, 3, 1).collect()}
    assert len({got[n] for n in range(3)}) == 1 and len({got[n] for n in range(3, 6)}) == 1 and got[0] != got[5]
