"""Signals in pieces: equal to those of whole segments, and apart for each recording."""

import numpy as np
import pytest

from popgraph.functions import signal
from popgraph.operators import physiology


@pytest.fixture(scope="module")
def two_recordings(spark):
    """Two recordings whose segments have the same numbers; gaps, one of them across pieces, and a repeated sample."""
    rng = np.random.RandomState(2)
    rows, aligned = [], []
    for recording, start, n in (("a", 130, 9000), ("b", 0, 6000)):
        x = rng.randn(n).cumsum() / 20 + np.sin(np.arange(n) / 3)
        for k in range(n):
            if not (2000 <= k < 2400 or 5100 <= k < 5110):
                rows.append((recording, start + k, float(x[k]), float(rng.randn())))
        rows.append((recording, start + 77, 3.0, 4.0))
        aligned.append((recording, 0, 10, start, start + n, list(range(start, start + n, 50))))
    aligned.append(("b", 1, 400, 6000, 6005, [6000]))
    aligned.append(("b", 2, 500, 7000, 9000, [7000]))
    samples = spark.createDataFrame(rows, "recording string, sample long, eeg double, emg double")
    return samples, spark.createDataFrame(aligned, "recording string, segment int, frame_start long, sample_start long, sample_stop long, triggers array<long>")


HOW = {
    "eeg_spectrogram": {"to": 80.0, "band": (2.0, 20.0), "filter_high": 30.0},
    "emg_envelope": {"to": 80.0, "band": (10.0, 30.0), "display_fs": 20.0},
    "scoring_features": {"analysis_fs": 50.0, "window_seconds": 4.0, "theta": (5.0, 8.0), "total": (1.0, 9.0), "display": (0.5, 8.0)},
}


def as_rows(df):
    df = df.toPandas()
    order = [c for c in ("recording", "segment", "minute", "frequency", "frame") if c in df]
    df = df.sort_values(order).reset_index(drop=True)
    return df[order], np.array([np.concatenate([np.atleast_1d(v).astype(float) for v in row]) for row in df.drop(columns=["recording", "segment"], errors="ignore").itertuples(index=False)])


@pytest.mark.parametrize("name", sorted(HOW))
def test_pieces_equal_the_whole(two_recordings, name):
    samples, aligned = two_recordings
    make = getattr(physiology, name)
    names, want = as_rows(make(samples, aligned, 100.0, 2.0, piece_seconds=1e6, **HOW[name]))
    for seconds in (7.3, 31.0):
        also, got = as_rows(make(samples, aligned, 100.0, 2.0, piece_seconds=seconds, **HOW[name]))
        assert names.equals(also)
        np.testing.assert_allclose(got, want, rtol=1e-7 if name == "scoring_features" else 1e-9, atol=1e-9)


@pytest.mark.parametrize("name", sorted(HOW))
def test_recordings_are_apart(spark, two_recordings, name):
    samples, aligned = two_recordings
    make = getattr(physiology, name)
    names, both = as_rows(make(samples, aligned, 100.0, 2.0, **HOW[name]))
    for recording in "ab":
        own = [df.where(f"recording = '{recording}'").drop("recording") for df in (samples, aligned)]
        _, alone = as_rows(make(*own, 100.0, 2.0, **HOW[name]))
        np.testing.assert_allclose(both[(names["recording"] == recording).to_numpy()], alone, rtol=1e-12)
    short = names[(names["recording"] == "b") & (names["segment"] > 0)]
    assert len(short) == {"eeg_spectrogram": 2, "scoring_features": 0}.get(name, len(short))
    if name == "emg_envelope":
        assert (short["segment"] == 2).sum() == 1 and (short["segment"] == 1).sum() >= 1


def test_whole_segment_against_plain_numpy(two_recordings):
    samples, aligned = two_recordings
    own = samples.where("recording = 'b'").toPandas().groupby("sample")["emg"].mean()
    x = signal.resample(np.interp(np.arange(6000), own.index, own.to_numpy()), 100.0, 80.0)
    power = signal.moving_power(signal.zero_phase(signal.butter_bandpass(4, 10.0, 30.0, 80.0), x), 20)
    got = physiology.emg_envelope(samples, aligned.where("segment = 0"), 100.0, 2.0, piece_seconds=9.0, **HOW["emg_envelope"]).toPandas()
    got = got[got["recording"] == "b"].sort_values("minute")["amplitude"].to_numpy()
    np.testing.assert_allclose(got, np.sqrt(np.maximum(power, 0))[::4], rtol=1e-9, atol=1e-9)


def test_a_filter_forgets():
    sos = signal.butter_bandpass(4, 0.5, 50.0, 250.0)
    n = signal.memory(sos)
    x = np.random.RandomState(0).randn(3 * n + 500)
    whole, cut = signal.zero_phase(sos, x), signal.zero_phase(sos, x[: 2 * n + 400])
    np.testing.assert_allclose(cut[: n + 400], whole[: n + 400], atol=1e-9)
    assert n < 250 * 60


def test_emg_threshold_from_ranges_of_values(spark, monkeypatch):
    """No task reads all values of a recording, and ranges, few values each, give what the rule gives; also without keys, and for a null key."""
    n = 20_000
    monkeypatch.setattr(physiology, "RANGE_BITS", 9, raising=False)
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    top, none = gateway.new_array(spark._jvm.double, 1), gateway.new_array(spark._jvm.double, 0)
    top[0] = 1.0
    stages = lambda: {x.stageId(): x for x in (lambda s: [s.apply(k) for k in range(s.size())])(store.stageList(None, False, False, none, None))}
    windows = spark.range(n).selectExpr("id % 2 as recording", "id div 2 + 1.0 as emg_rms", "if(id div 2 > 6000 or id div 2 % 7 = 3, 'awake', 'nrem') as state")
    windows = windows.union(spark.sql("select null, 2.0D, 'awake' union all select null, 8.0D, 'rem' union all select null, 8.0D, 'awake' union all select 9, 1.0D, 'nrem'"))
    keep = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = set(stages())
        got = {r["recording"]: r for r in physiology.fit_emg_threshold(windows, ["recording"]).collect()}
        read = [store.taskSummary(k, x.attemptId(), top) for k, x in stages().items() if k not in before]
        assert max(o.get().shuffleReadMetrics().readRecords().apply(0) for o in read if o.isDefined()) < n // 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", keep)
    assert set(got) == {0, 1, None}
    x = np.arange(n // 2) + 1.0
    awake = (x - 1 > 6000) | ((x - 1) % 7 == 3)
    q = np.concatenate([[0.5], 0.5 * ((awake.sum() - np.cumsum(awake)) / awake.sum() + np.cumsum(~awake) / (~awake).sum())])
    at = np.concatenate([[x[0]], np.sqrt(x[:-1] * x[1:]), [x[-1]]])
    best = np.flatnonzero(np.abs(q - q.max()) <= 1e-12)
    for k in (0, 1):
        assert got[k]["threshold"] == pytest.approx(at[best[len(best) // 2]], rel=1e-12) and got[k]["balanced_accuracy"] == pytest.approx(q.max())
        assert (got[k]["n_awake"], got[k]["n_sleep"]) == (awake.sum(), (~awake).sum())
    assert (got[None]["n_awake"], got[None]["n_sleep"], got[None]["balanced_accuracy"]) == (2, 1, 0.5)
    assert physiology.fit_emg_threshold(windows.where("recording = 1").drop("recording")).first()["threshold"] == got[1]["threshold"]
