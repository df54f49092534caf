"""Frame triggers, their alignment with imaging segments, EEG and EMG features, and scoring of sleep.

A signal is (recording, sample, v). Where it is filtered, a segment is cut into pieces that know what lies around them, so
recordings, segments and long segments' pieces spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import dims, signal, tables
from ..functions.checks import positive, positive_int

TINY = float(np.finfo(np.float32).tiny)


def rising_edges(trace: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """(keys, sample) at which v comes to lie above threshold; a first sample above it counts."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("sample")
    high = F.col("v") > threshold
    marked = trace.withColumn("__high", high).withColumn("__before", F.coalesce(F.lag("__high").over(w), F.lit(False)))
    return marked.where(F.col("__high") & ~F.col("__before")).drop("__high", "__before", "v")


def check_edges(edges: DataFrame) -> None:
    """Raises ValueError unless there are two edges at least."""
    if len(edges.limit(2).collect()) < 2:
        raise ValueError("the trigger has fewer than two rising edges")


def trigger_groups(edges: DataFrame, boundaries: DataFrame | None = None, gap_factor: float = 2.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, sample, bout, period): bouts end where the gap exceeds gap_factor median gaps or a new part begins.

    edges may have column part; or boundaries (keys, sample) give the first sample of each part but the first.
    """
    if not np.isfinite(gap_factor) or gap_factor <= 1:
        raise ValueError("gap_factor must be finite and greater than one")
    keys = keys or []
    if boundaries is not None:
        starts = boundaries.groupBy(*keys).agg(F.sort_array(F.collect_list("sample")).alias("__starts"))  # a few per recording
        edges = edges.join(tables.small(starts, "starts"), keys, "left") if keys else edges.crossJoin(F.broadcast(starts))
        edges = edges.withColumn("part", F.size(F.filter(F.coalesce("__starts", F.array().cast("array<long>")), lambda b: b <= F.col("sample")))).drop("__starts")
    elif "part" not in edges.columns:
        edges = edges.withColumn("part", F.lit(0))
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("sample")
    gaps = edges.withColumn("__gap", F.col("sample") - F.lag("sample").over(w)).withColumn("__new", F.coalesce(F.col("part") != F.lag("part").over(w), F.lit(False)))
    if keys:
        median = tables.grouped_quantiles(gaps, keys, "__gap", [0.5]).withColumnRenamed("q0", "period")
        gaps = gaps.join(median, keys, "left")  # a single trigger has no period
    else:
        gaps = gaps.withColumn("period", F.lit(tables.quantiles(gaps, "__gap", [0.5])[0]).cast("double"))
    cut = (F.coalesce(F.col("__gap") > gap_factor * F.col("period"), F.lit(False)) | F.col("__new")).cast("int")
    return gaps.withColumn("__cut", cut).withColumn("bout", F.sum("__cut").over(w)).drop("__cut", "__gap", "__new")


def align_triggers(groups: DataFrame, segments: list[tuple[int, int]], fs: float, imaging_fs: float, n_samples: int, recording: str = "", exact_sizes: bool = False) -> tuple[DataFrame, dict]:
    """Pairs a recording's imaging segments with its bouts.

    Returns (segment, frame_start, frame_stop, sample_start, sample_stop, bout, bout_size, offset, triggers) and
    {detected, mapped, ignored, period}. Released recordings follow their manifest; others take the next bout
    that is long enough. Bouts are a few per recording: their sizes and periods decide on the driver.
    """
    positive(imaging_fs, "imaging_fs")
    bouts = groups.groupBy("bout").agg(F.count("*").alias("n"), F.min("sample").alias("lo"), F.max("sample").alias("hi"), F.first("period").alias("period"), F.sort_array(F.collect_list("sample")).alias("samples"))
    rows = bouts.drop("samples").orderBy("bout").collect()
    if not rows:
        raise ValueError("there are no triggers")
    period, wanted = float(rows[0]["period"]), positive(fs, "fs") / imaging_fs
    if abs(period - wanted) / wanted > 0.02:
        raise ValueError(f"a trigger period of {period:g} samples does not fit {fs:g} Hz and {imaging_fs:g} frames a second")
    sizes = [r["n"] for r in rows]
    if exact_sizes and dims.TRIGGER_GROUP_SIZES.get(recording, tuple(sizes)) != tuple(sizes):
        raise ValueError(f"{recording}: bouts of {sizes} triggers are not those of the release")
    chosen = dims.TRIGGER_SELECTIONS.get(recording)
    if chosen is not None and len(chosen) != len(segments):
        raise ValueError(f"{recording}: the manifest has {len(chosen)} segments, not {len(segments)}")
    plan, used, nxt = [], set(), 0
    for k, (lo, hi) in enumerate(segments):
        n = hi - lo
        if chosen is None:
            nxt = next((b for b in range(nxt, len(sizes)) if sizes[b] >= n), len(sizes))
            bout, anchor = nxt, "start"
            nxt += 1
        else:
            bout, anchor = chosen[k]
        if bout >= len(sizes) or sizes[bout] < n:
            raise ValueError(f"segment {k} needs {n} triggers of one bout; there are bouts of {sizes}")
        if bout in used:
            raise ValueError(f"bout {bout} is taken twice")
        used.add(bout)
        plan.append((k, lo, hi, bout, sizes[bout], sizes[bout] - n if anchor == "end" else 0))
    spark = groups.sparkSession
    table = spark.createDataFrame(plan, "segment int, frame_start long, frame_stop long, bout long, bout_size long, offset long")
    gaps = F.transform(F.sequence(F.lit(1), F.size("samples") - 1), lambda i: F.get("samples", i) - F.get("samples", i - 1))
    own_period = F.when(F.size("samples") > 1, _median(gaps)).otherwise(F.lit(period))
    out = table.join(bouts.select("bout", "samples"), "bout")
    out = out.withColumn("triggers", F.slice("samples", (F.col("offset") + 1).cast("int"), (F.col("frame_stop") - F.col("frame_start")).cast("int")))
    stop = F.least(F.lit(n_samples), F.rint(F.element_at("triggers", -1) + own_period)).cast("long")
    out = out.select("segment", "frame_start", "frame_stop", F.element_at("triggers", 1).alias("sample_start"), stop.alias("sample_stop"), "bout", "bout_size", "offset", "triggers")
    mapped = sum(hi - lo for lo, hi in segments)
    return out, {"detected": sum(sizes), "mapped": mapped, "ignored": sum(sizes) - mapped, "period": period}


def align_recordings(groups: DataFrame, segments: DataFrame, fs, imaging_fs: float, n_samples, key: str = "recording", manifest: DataFrame | None = None, exact_sizes: DataFrame | None = None) -> DataFrame:
    """align_triggers() for many recordings: each segment takes its recording's next bout that is long enough.

    segments is (key, segment, frame_start, frame_stop); fs and n_samples are numbers or columns of (key, period). A
    recording in manifest (key, segment, bout, anchor) takes those bouts, and of a longer one the triggers at its start or end;
    one in exact_sizes (key, sizes) must have bouts of just these sizes. Nothing comes to the driver: a recording's bout sizes and
    segment lengths are one row, and triggers are joined to their bouts. A recording whose period is unknown (a single trigger) has no sample_stop.
    """
    positive(imaging_fs, "imaging_fs")
    as_column = lambda x: F.lit(x) if isinstance(x, (int, float)) else x
    bouts = groups.groupBy(key, "bout").agg(F.count("*").alias("bout_size"), F.first("period").alias("period"), F.sort_array(F.collect_list("sample")).alias("samples"))
    sizes = groups.groupBy(key, "bout").agg(F.count("*").alias("n"), F.first("period").alias("period"))
    sizes = sizes.groupBy(key).agg(F.first("period").alias("period"), F.sort_array(F.collect_list(F.struct("bout", "n"))).alias("bouts"))
    wanted = segments.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment", "frame_start", "frame_stop"))).alias("segments"))
    rate = as_column(fs) / imaging_fs
    fits = F.col("period").isNull() | (F.abs(F.col("period") - rate) / rate <= 0.02)
    both = wanted.join(sizes, key, "left")
    both = both.withColumn("segments", F.when(F.coalesce(fits, F.lit(False)), F.col("segments")).otherwise(F.raise_error(F.concat(F.lit("a trigger period does not fit the rates in recording "), F.col(key).cast("string")))))
    if manifest is not None:
        both = both.join(manifest.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("segment", "bout", "anchor"))).alias("chosen")), key, "left")
    both = both.join(exact_sizes.select(key, "sizes"), key, "left") if exact_sizes is not None else both
    types = {f.name: f.dataType.simpleString() for f in both.schema}

    def of_one(name, own: list, found: list, chosen: list | None, exact: list | None) -> list[tuple]:
        sizes, rows, used, nxt = [b["n"] for b in found], [], set(), 0
        if exact is not None and exact != sizes:
            raise ValueError(f"recording {name}: bouts of {sizes} triggers are not those of the release")
        if chosen is not None and len(chosen) != len(own):
            raise ValueError(f"recording {name}: the manifest has {len(chosen)} segments, not {len(own)}")
        for k, x in enumerate(own):
            n = x["frame_stop"] - x["frame_start"]
            if chosen is None:
                bout, anchor = next((b for b in range(nxt, len(sizes)) if sizes[b] >= n), len(sizes)), "start"
                nxt = bout + 1
            else:
                bout, anchor = chosen[k]["bout"], chosen[k]["anchor"]
            if bout >= len(sizes) or sizes[bout] < n:
                raise ValueError(f"recording {name}: segment {x['segment']} needs {n} triggers of one bout; there are bouts of {sizes}")
            if bout in used:
                raise ValueError(f"recording {name}: bout {bout} is taken twice")
            used.add(bout)
            rows.append((name, x["segment"], x["frame_start"], x["frame_stop"], found[bout]["bout"], sizes[bout] - n if anchor == "end" else 0))
        return rows

    def plan(batches):
        for pdf in batches:
            rows = []
            listed = lambda r, c: None if c not in r or r[c] is None else list(r[c])
            for r in pdf.to_dict("records"):
                rows += of_one(r[key], list(r["segments"]), listed(r, "bouts") or [], listed(r, "chosen"), listed(r, "sizes"))
            yield pd.DataFrame(rows, columns=[key, "segment", "frame_start", "frame_stop", "bout", "offset"])

    table = both.drop("period").mapInPandas(plan, f"`{key}` {types[key]}, segment int, frame_start long, frame_stop long, bout long, offset long")
    gaps = F.transform(F.sequence(F.lit(1), F.size("samples") - 1), lambda i: F.get("samples", i) - F.get("samples", i - 1))
    own_period = F.when(F.size("samples") > 1, _median(gaps)).otherwise(F.col("period"))
    out = table.join(bouts, [key, "bout"])
    out = out.withColumn("triggers", F.slice("samples", (F.col("offset") + 1).cast("int"), (F.col("frame_stop") - F.col("frame_start")).cast("int")))
    stop = F.when(own_period.isNotNull(), F.least(as_column(n_samples), F.rint(F.element_at("triggers", -1) + own_period)).cast("long"))
    return out.select(key, "segment", "frame_start", "frame_stop", F.element_at("triggers", 1).alias("sample_start"), stop.alias("sample_stop"), "bout", "bout_size", "offset", "triggers")


def _median(values):
    s = F.sort_array(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def parts_before(edges: DataFrame, boundaries: DataFrame, keys: list[str]) -> DataFrame:
    """Adds part, how many boundaries are not after the sample: a running count over both, no pairs."""
    both = edges.select(*keys, "sample", F.lit(1).alias("__e")).union(boundaries.select(*keys, "sample", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("sample", "__e").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("part", F.sum(1 - F.col("__e")).over(w)).where("__e = 1").drop("__e")


def interpolate(points: DataFrame, anchors: DataFrame, keys: list[str]) -> DataFrame:
    """Adds y to points (keys, x), linear between anchors (keys, x, y) and constant beyond the outer ones."""
    both = points.select(*keys, "x", F.lit(None).cast("double").alias("y"), F.lit(1).alias("__p")).union(anchors.select(*keys, "x", F.col("y").cast("double"), F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("x", "__p")
    held = F.when(F.col("__p") == 0, F.struct("x", "y"))
    both = both.withColumn("__a", F.last(held, True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__b", F.first(held, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    slope = F.try_divide(F.col("__b.y") - F.col("__a.y"), (F.col("__b.x") - F.col("__a.x")).cast("double"))
    y = F.when(F.col("__a").isNull(), F.col("__b.y")).when(F.col("__b").isNull(), F.col("__a.y")).otherwise(F.col("__a.y") + F.coalesce(slope, F.lit(0.0)) * (F.col("x") - F.col("__a.x")))
    return both.where("__p = 1").select(*keys, "x", y.alias("y"))


#: Samples whose segment is looked up by one number.
SPAN = 512
#: Seconds of a segment that one task works out at a time, beside what its filters need on both sides.
PIECE_SECONDS = 600.0


def _per_piece(samples: DataFrame, aligned: DataFrame, columns: list[str], fs: float, to: float, halo: tuple[int, int], piece_seconds: float, make: Callable[..., pd.DataFrame], ddl: str) -> DataFrame:
    """What make(row, signals, at, core, n) gives for each piece of each segment, after (recording,) segment.

    A segment's samples are resampled from fs to to; its n values there are cut into pieces. core is where a piece begins and
    ends, signals has its values and up to halo more on either side, of which the first is the segment's at-th. Ends of segments
    are ends of signals; elsewhere the resampling filter has all the samples it needs, so that values do not hang on the cuts.
    Repeated samples are averaged, gaps filled between neighbours, in other pieces too, and held at a segment's ends.
    """
    keys = [k for k in ("recording",) if k in samples.columns and k in aligned.columns]
    own = [*keys, "segment"]
    up, down = signal.ratio(fs, to)
    size = -(-max(1, round(positive(piece_seconds, "piece_seconds") * to)) // up) * up
    before, after = (-(-h // up) * up for h in halo)
    reach = down * (signal.RESAMPLE_HALF * max(up, down) // (up * down) + 1) if up != down else 0  # samples, whole steps of the grid
    table = aligned.select(*keys, F.col("segment").cast("int").alias("segment"), "frame_start", "sample_start", "sample_stop", "triggers")
    length = F.col("sample_stop") - F.col("sample_start")
    table = table.where("sample_stop > sample_start").withColumn("n", F.ceil(length * up / down))
    span = lambda c: F.floor(c / SPAN)
    segments = table.select(*own, "sample_start", "sample_stop", F.explode(F.sequence(span(F.col("sample_start")), span(F.col("sample_stop") - 1))).alias("span"))
    values = samples.select(*keys, "sample", *[F.col(c).cast("double").alias(c) for c in columns]).dropna().withColumn("span", span(F.col("sample")))
    values = values.join(segments, [*keys, "span"]).where("sample >= sample_start and sample < sample_stop")
    values = tables.cut(values.groupBy(*own, "span", "sample").agg(*[F.avg(c).alias(c) for c in columns]), "segment-samples")

    pieces = table.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size))))
    pieces = pieces.withColumns({"c0": F.col("piece") * size, "c1": F.least("n", (F.col("piece") + 1) * size)})
    low = F.greatest(F.lit(0), F.floor(F.greatest(F.lit(0), F.col("c0") - before) / up) * down - reach)
    high = F.least(length, F.ceil((F.col("c1") + after) / up) * down + reach)
    pieces = pieces.withColumns({"x0": F.col("sample_start") + low, "x1": F.col("sample_start") + high})
    pieces = pieces.withColumns({"s0": span(F.col("x0")), "s1": span(F.col("x1") - 1)})
    # the triggers around a piece, one more on either side
    upto = lambda c: F.size(F.filter("triggers", lambda t: t < F.col(c)))
    pieces = pieces.withColumns({"t0": F.greatest(F.lit(0), upto("x0") - 1), "t1": upto("x1") + 1})
    pieces = pieces.withColumn("triggers", F.slice("triggers", F.col("t0") + 1, F.col("t1") - F.col("t0"))).withColumn("frame_start", F.col("frame_start") + F.col("t0")).drop("t0", "t1")
    if table.where(F.col("n") > size).isEmpty():  # nothing lies outside of whole segments
        no_point = F.lit(None).cast(T.StructType([T.StructField("sample", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]]))
        pieces = pieces.withColumns({"prev": no_point, "next": no_point})
    else:
        pieces = _with_outside(pieces, values, own, columns)
    wanted = pieces.select(*own, "piece", F.explode(F.sequence("s0", "s1")).alias("span"))
    dealt = values.join(wanted, [*own, "span"]).select(*[F.col(c).alias(c) for c in (*own, "piece", "sample", *columns)])  # columns of its own
    types = {f.name: f.dataType.simpleString() for f in pieces.schema}

    def run(pdf: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
        row, found = pieces.iloc[0], {}
        rest = [p for p in (row["prev"], row["next"]) if p is not None]
        known = len(pdf) + len(rest)
        at = np.concatenate([[p["sample"] for p in rest], pdf["sample"].to_numpy()]) if known else np.zeros(0)
        order = np.argsort(at, kind="stable")
        for c in columns:
            v = np.concatenate([[p[c] for p in rest], pdf[c].to_numpy()])[order] if known else np.zeros(0)
            whole = np.interp(np.arange(row["x0"], row["x1"]), at[order], v) if known else np.zeros(0)
            found[c] = signal.resample(whole, fs, to) if known else whole
        first = (row["x0"] - row["sample_start"]) // down * up  # the values' place in the segment
        lo, hi = max(first, row["c0"] - before if row["c0"] else 0), min(row["n"], row["c1"] + after)
        if known:
            found = {c: x[lo - first : hi - first] for c, x in found.items()}
        out = make(row, found, lo, (int(row["c0"]), int(row["c1"])), int(row["n"]) if known else 0)
        for k in reversed(own):
            out.insert(0, k, row[k])
        return out

    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in own), ddl])
    return dealt.groupBy(*own, "piece").cogroup(pieces.groupBy(*own, "piece")).applyInPandas(run, ddl)


def _with_outside(pieces: DataFrame, values: DataFrame, own: list[str], columns: list[str]) -> DataFrame:
    """Adds prev and next, a piece's nearest samples before s0 and after s1, from the first and last ones of each span."""
    point = F.struct("sample", *columns)
    edges = values.groupBy(*own, "span").agg(F.min(point).alias("first"), F.max(point).alias("last"))
    no_point, no_piece = F.lit(None).cast(edges.schema["first"].dataType), F.lit(None).cast("long")
    marks = edges.select(*own, "span", F.lit(1).alias("kind"), "first", "last", no_piece.alias("piece"))
    for kind, at in ((0, "s0"), (2, "s1")):
        marks = marks.union(pieces.select(*own, at, F.lit(kind), no_point, no_point, "piece"))
    along = Window.partitionBy(*own).orderBy("span", "kind")  # a row for each span and two for each piece
    marks = marks.withColumn("prev", F.last("last", True).over(along.rowsBetween(Window.unboundedPreceding, 0))).withColumn("next", F.first("first", True).over(along.rowsBetween(0, Window.unboundedFollowing)))
    outside = marks.where("kind <> 1").groupBy(*own, "piece").agg(F.first(F.when(F.col("kind") == 0, F.col("prev")), True).alias("prev"), F.first(F.when(F.col("kind") == 2, F.col("next")), True).alias("next"))
    return tables.cut(pieces.join(outside, [*own, "piece"]), "pieces")


def _minutes(row: pd.Series, seconds: np.ndarray, fs: float, imaging_fs: float) -> np.ndarray:
    """Recorded minutes of places in a segment, by interpolation between its frames' triggers."""
    triggers = np.asarray(row["triggers"]) - row["sample_start"]
    frames = row["frame_start"] + np.arange(len(triggers))
    return np.interp(seconds * fs, triggers, frames / imaging_fs / 60)


def eeg_spectrogram(samples: DataFrame, aligned: DataFrame, fs: float, imaging_fs: float, to: float = 250.0, band: tuple[float, float] = (0.5, 30.0), filter_high: float = 50.0, window_seconds: float = 4.0, overlap: float = 0.75, piece_seconds: float = PIECE_SECONDS) -> DataFrame:
    """((recording,) segment, minute, frequency, power_db) of the EEG (column eeg), band-passed without phase shift.

    samples and aligned may both have a column recording, whose segments are apart then. A long segment is many pieces; each has as much
    more on both sides as the filter remembers to 1e-15, so that values are those of the whole segment to about 1e-12 of its size. A segment of fewer than
    eight samples has no spectrum: one row with nulls.
    """
    lo, hi = band
    if not 0 < lo < hi or to <= 2 * max(hi, filter_high) or not 0 <= overlap < 1:
        raise ValueError("the band must be ordered and below the Nyquist frequency, and overlap in [0, 1)")
    sos = signal.butter_bandpass(4, lo, filter_high, to)
    wanted = round(positive(window_seconds, "window_seconds") * to)

    def make(row: pd.Series, x: dict[str, np.ndarray], at: int, core: tuple[int, int], n: int) -> pd.DataFrame:
        width = min(wanted, n)
        if width < 8:
            return pd.DataFrame({"minute": [None], "frequency": [None], "power_db": [None]} if not core[0] else {"minute": [], "frequency": [], "power_db": []})
        step = width - min(round(overlap * width), width - 1)
        begin = -(-core[0] // step) * step  # the first window that starts in the piece
        stop = min(core[1] - 1, n - width)
        if begin > stop:
            return pd.DataFrame({"minute": [], "frequency": [], "power_db": []})
        end = begin + (stop - begin) // step * step + width
        f, t, p = signal.spectrogram(signal.zero_phase(sos, x["eeg"])[begin - at : end - at], to, width, width - step)
        keep = (f >= lo) & (f <= hi)
        db = 10 * np.log10(np.maximum(p[keep], np.finfo(float).tiny))
        return pd.DataFrame({"minute": np.tile(_minutes(row, t + begin / to, fs, imaging_fs), keep.sum()), "frequency": np.repeat(f[keep], len(t)), "power_db": db.ravel()})

    halo = signal.memory(sos)
    return _per_piece(samples, aligned, ["eeg"], fs, to, (halo, halo + wanted), piece_seconds, make, "minute double, frequency double, power_db double")


def display_limits(df: DataFrame, column: str, low: float = 0.02, high: float = 0.99) -> DataFrame:
    """(lo, hi): percentiles of finite values; the range where they don't differ, and one more where that is a point."""
    x = df.select(F.when(~F.isnan(column) & (F.abs(column) < float("inf")), F.col(column)).cast("double").alias("x"))
    a, b, c, d = tables.quantiles(x, "x", [low, high, 0.0, 1.0])
    lo, hi = (None, None) if a is None else (a, b) if b > a else (c, d)
    hi = hi if lo is None or hi > lo else lo + 1
    return df.sparkSession.createDataFrame([(lo, hi)], "lo double, hi double")


def emg_envelope(samples: DataFrame, aligned: DataFrame, fs: float, imaging_fs: float, to: float = 500.0, band: tuple[float, float] = (20.0, 200.0), window_seconds: float = 0.25, display_fs: float = 20.0, piece_seconds: float = PIECE_SECONDS) -> DataFrame:
    """((recording,) segment, minute, amplitude): root mean square of the band-passed EMG (column emg), thinned to display_fs.

    Recordings and pieces are as in eeg_spectrogram(). A segment without samples has one row with nulls.
    """
    if not 0 < band[0] < band[1] or to <= 2 * band[1]:
        raise ValueError("the band must be ordered and below the Nyquist frequency")
    if display_fs > to:
        raise ValueError("display_fs must not exceed the rate it is taken from")
    sos = signal.butter_bandpass(4, *band, to)
    width, step = max(1, round(positive(window_seconds, "window_seconds") * to)), max(1, round(to / positive(display_fs, "display_fs")))

    def make(row: pd.Series, x: dict[str, np.ndarray], at: int, core: tuple[int, int], n: int) -> pd.DataFrame:
        if not n:
            return pd.DataFrame({"minute": [None], "amplitude": [None]} if not core[0] else {"minute": [], "amplitude": []})
        power = signal.moving_power(signal.zero_phase(sos, x["emg"]), width)
        places = np.arange(-(-core[0] // step) * step, core[1], step)
        rms = np.sqrt(np.maximum(power[places - at], 0))
        return pd.DataFrame({"minute": _minutes(row, places / to, fs, imaging_fs), "amplitude": rms})

    halo = signal.memory(sos) + width
    return _per_piece(samples, aligned, ["emg"], fs, to, (halo, halo), piece_seconds, make, "minute double, amplitude double")


def band_power(spectrum: DataFrame, low: float, high: float, keys: list[str], name: str = "power_in_band") -> DataFrame:
    """(keys, sum of power over low < frequency < high); a band with fewer than two frequencies is an error."""
    inside = spectrum.where((F.col("frequency") > low) & (F.col("frequency") < high))
    out = inside.groupBy(*keys).agg(F.sum("power").alias(name), F.countDistinct("frequency").alias("__n"))
    return out.select(*keys, F.when(F.col("__n") >= 2, F.col(name)).otherwise(F.raise_error(F.lit("fewer than two frequencies lie in the band"))).alias(name))


def scoring_features(samples: DataFrame, aligned: DataFrame, fs: float, imaging_fs: float, analysis_fs: float = 1000.0, window_seconds: float = 4.0, delta: tuple[float, float] = (1.0, 4.0), theta: tuple[float, float] = (6.0, 10.0), total: tuple[float, float] = (1.0, 20.0), display: tuple[float, float] = (0.5, 30.0), chunk: int = 512, piece_seconds: float = PIECE_SECONDS) -> DataFrame:
    """One row per frame: (recording,) segment, frame, trigger, minute, relative_delta, raw_ratio, delta_theta_ratio, emg_rms, power_db.

    Windows of window_seconds around each trigger; frames whose window leaves the segment have no row.
    relative_delta is delta over total, raw_ratio delta over theta, and delta_theta_ratio their product. Recordings and
    pieces are as in eeg_spectrogram(); a piece has half a window more on both sides.
    """
    half, chunk = round(positive(window_seconds, "window_seconds") * analysis_fs / 2), positive_int(chunk, "chunk")
    n_window = 2 * half
    hann = np.hanning(n_window)
    scale = analysis_fs * (hann**2).sum()
    f = np.fft.rfftfreq(n_window, 1 / analysis_fs)
    inside = lambda b: (f > b[0]) & (f < b[1])
    for b in (delta, theta, total):
        if inside(b).sum() < 2:
            raise ValueError(f"fewer than two frequencies lie in {b}")
    shown = (f >= display[0]) & (f <= display[1])
    names = ["frame", "trigger", "minute", "relative_delta", "raw_ratio", "delta_theta_ratio", "emg_rms", "power_db"]

    def make(row: pd.Series, x: dict[str, np.ndarray], at: int, core: tuple[int, int], n: int) -> pd.DataFrame:
        eeg, emg = x["eeg"].astype(np.float32), x["emg"].astype(np.float32)
        triggers = np.asarray(row["triggers"])
        centre = np.rint((triggers - row["sample_start"]) * analysis_fs / fs).astype(int)
        ok = (centre >= core[0]) & ((centre < core[1]) | (core[1] == n)) & (centre - half >= 0) & (centre + half <= n)
        frames, centre, out = row["frame_start"] + np.flatnonzero(ok), centre - at, []
        for lo in range(0, int(ok.sum()), chunk):
            places = centre[ok][lo : lo + chunk, None] + np.arange(-half, half)
            p = np.abs(np.fft.rfft(eeg[places] * hann, axis=1)) ** 2 / scale
            p[:, 1:-1] *= 2
            d, t, a = (p[:, inside(b)].sum(axis=1) for b in (delta, theta, total))
            rel, raw = d / np.maximum(a, TINY), d / np.maximum(t, TINY)
            own = frames[lo : lo + chunk]
            rms = np.sqrt(np.mean(np.square(emg[places], dtype=float), axis=1))
            out.append(pd.DataFrame(dict(zip(names, (own, triggers[ok][lo : lo + chunk], own / imaging_fs / 60, rel, raw, rel * raw, rms, list(10 * np.log10(np.maximum(p[:, shown], TINY)))), strict=True))))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in names}).astype({"power_db": object})

    ddl = "frame long, trigger long, minute double, relative_delta double, raw_ratio double, delta_theta_ratio double, emg_rms double, power_db array<double>"
    return _per_piece(samples, aligned, ["eeg", "emg"], fs, analysis_fs, (half, half), piece_seconds, make, ddl)


def frequency_normalised(spectrum: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds change: power_db less its frequency's median over the whole recording (keys)."""
    by = [*(keys or []), "frequency"]
    medians = tables.grouped_quantiles(spectrum, by, "power_db", [0.5]).withColumnRenamed("q0", "__m")
    return spectrum.join(medians, by, "left").withColumn("change", F.col("power_db") - F.col("__m")).drop("__m")


#: Distinct values of a range that are added up as one, at most: two to this power.
RANGE_BITS = 17


def fit_emg_threshold(windows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, threshold, balanced_accuracy, n_awake, n_sleep) that best tells awake from nrem and rem by emg_rms.

    Candidates lie below all values, between neighbouring ones (geometric mean if all are positive) and above
    all; of the equally good, the middle one. Counts per distinct value are added up in order of value: distinct values are dealt by
    ranges and added up there, and ranges (a row each) go on from one another, so no task sees all values of a key.
    """
    keys = keys or []
    ok = windows.where(F.col("emg_rms").isNotNull() & ~F.isnan("emg_rms") & (F.col("emg_rms") >= 0) & (F.col("emg_rms") < float("inf")) & F.col("state").isin("awake", "nrem", "rem"))
    awake = (F.col("state") == "awake").cast("long")
    key = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__all"))
    per = ok.groupBy(key.alias("__key"), F.col("emg_rms").alias("x")).agg(F.sum(awake).alias("a"), F.sum(1 - awake).alias("s"))
    per = tables.cut(per.repartitionByRange("__key", "x").sortWithinPartitions("__key", "x").withColumn("__part", F.shiftright(F.monotonically_increasing_id(), RANGE_BITS)), "values")
    whole = Window.partitionBy("__key")
    w = whole.orderBy("__part")  # a row a range
    ranges = per.groupBy("__key", "__part").agg(*[F.sum(c).alias(f"__{c}") for c in "as"], F.min("x").alias("__lo"), F.max("x").alias("__hi"), F.count("*").alias("__n"))
    ranges = ranges.select(
        "__key", "__part", *[(F.sum(f"__{c}").over(w) - F.col(f"__{c}")).alias(f"__{c}") for c in "as"], F.lag("__hi").over(w).alias("__hi"), F.lead("__lo").over(w).alias("__lo"),
        F.sum("__a").over(whole).alias("n_awake"), F.sum("__s").over(whole).alias("n_sleep"), F.min("__lo").over(whole).alias("least"), F.sum("__n").over(whole).alias("distinct"),
    )
    per = per.join(tables.small(ranges.where("n_awake > 0 and n_sleep > 0"), "ranges"), ["__key", "__part"])
    w = Window.partitionBy("__key", "__part").orderBy("x")
    below = w.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("a_below", F.col("__a") + F.coalesce(F.sum("a").over(below), F.lit(0))).withColumn("s_below", F.col("__s") + F.coalesce(F.sum("s").over(below), F.lit(0)))
    per = per.withColumn("before", F.coalesce(F.lag("x").over(w), "__hi")).withColumn("next", F.coalesce(F.lead("x").over(w), "__lo"))
    middle = F.when(F.col("least") > 0, F.sqrt(F.col("before") * F.col("x"))).otherwise((F.col("before") + F.col("x")) / 2)
    ulp = lambda x: F.greatest(F.abs(x) * 1.1102230246251565e-16, F.lit(5e-324))
    first = F.when(F.col("distinct") == 1, F.col("x")).when(F.col("before").isNull(), F.col("x") - ulp(F.col("x"))).otherwise(middle)
    score = lambda a, s: 0.5 * ((F.col("n_awake") - a) / F.col("n_awake") + s / F.col("n_sleep"))
    at = F.array(F.struct(first.alias("threshold"), score(F.col("a_below"), F.col("s_below")).alias("q")))
    top = F.array(F.struct((F.col("x") + ulp(F.col("x"))).alias("threshold"), score(F.col("a_below") + F.col("a"), F.col("s_below") + F.col("s")).alias("q")))
    both = F.when(F.col("next").isNull() & (F.col("distinct") > 1), F.concat(at, top)).otherwise(at)
    cand = per.select("__key", "__part", "n_awake", "n_sleep", F.inline(both))
    # what is not as good as its range's best is not as good as the best
    best = F.max("q").over(Window.partitionBy("__key", "__part"))
    cand = tables.cut(cand.withColumn("best", best).where("abs(q - best) <= 1e-12").drop("best", "__part"), "thresholds")
    cand = cand.join(tables.small(cand.groupBy("__key").agg(F.max("q").alias("best")), "best"), "__key").where("abs(q - best) <= 1e-12")
    cand = tables.ranked(cand, [F.col("threshold"), F.col("q")], "k", ["__key"])
    cand = cand.join(tables.small(cand.groupBy("__key").agg(F.count("*").alias("m")), "equals"), "__key").where("k = floor(m / 2)")
    return cand.select(*[F.col("__key")[k].alias(k) for k in keys], "threshold", F.col("q").alias("balanced_accuracy"), "n_awake", "n_sleep")


def classify_sleep(windows: DataFrame, threshold, ratio: float = 0.3) -> DataFrame:
    """Adds scored: awake from the EMG threshold on, else nrem from the delta-theta ratio on, else rem."""
    threshold = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return windows.withColumn("scored", F.when(F.col("emg_rms") >= threshold, "awake").when(F.col("delta_theta_ratio") >= ratio, "nrem").otherwise("rem"))
