"""Runs, segments, smoothing and rasters along frames. All windows are partitioned by keys where keys are given."""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.checks import positive, positive_int


def _by(keys: list[str] | None):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def contiguous_runs(positions: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adds run: it grows wherever a frame is not one more than the frame before, in the order of pos."""
    w = _by(keys).orderBy("pos")
    cut = F.coalesce((F.col("frame") - F.lag("frame").over(w) != 1).cast("int"), F.lit(0))
    return positions.withColumn("__cut", cut).withColumn("run", F.sum("__cut").over(w)).drop("__cut")


def state_runs(frames: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, stop, state_code) of runs of one code along frame, half open. NaN differs from NaN."""
    w = _by(keys).orderBy("frame")
    before = F.lag("state_code").over(w)
    same = (F.col("state_code") == before) & ~F.isnan("state_code")
    marked = frames.withColumn("__cut", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    marked = marked.withColumn("__run", F.sum("__cut").over(w))
    out = marked.groupBy(*(keys or []), "__run").agg(F.min("frame").alias("start"), (F.max("frame") + 1).alias("stop"), F.min("state_code").alias("state_code"))
    return out.drop("__run")


def acquisition_segments(lengths: DataFrame, boundaries: DataFrame, extra_splits: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, stop) of half-open segments of 0:n_frames. lengths has n_frames; boundaries a break's last frame.

    extra_splits has column stop, already one past. Stops outside (0, n_frames) are ignored; n_frames 0 has none.
    """
    keys = keys or []
    inner = boundaries.select(*keys, (F.col("frame") + 1).alias("stop"))
    if extra_splits is not None:
        inner = inner.union(extra_splits.select(*keys, "stop"))
    inner = inner.join(lengths, keys) if keys else inner.crossJoin(F.broadcast(lengths))
    stops = inner.where((F.col("stop") > 0) & (F.col("stop") < F.col("n_frames"))).select(*keys, "stop")
    stops = stops.union(lengths.where("n_frames > 0").select(*keys, F.col("n_frames").alias("stop"))).distinct()
    return stops.select(*keys, F.coalesce(F.lag("stop").over(_by(keys).orderBy("stop")), F.lit(0)).cast("long").alias("start"), F.col("stop").cast("long"))


def moving_average(df: DataFrame, width: int, value: str = "v", order: str = "frame", keys: list[str] | None = None) -> DataFrame:
    """Adds smoothed: the centred mean of width neighbours, of those there are at the edges.

    A sequence shorter than width is averaged with its own length as width, which an even and an odd frame tell apart.
    """
    width = max(1, positive_int(width, "width"))
    by = _by(keys)
    # one frame of rows for each possible width would not be a plan; a short sequence, and only that, takes slices of its own array
    full = F.avg(value).over(by.orderBy(order).rowsBetween(-(width // 2), (width - 1) // 2))
    out = df.withColumn("__n", F.count("*").over(by)).withColumn("__i", F.row_number().over(by.orderBy(order)) - 1).withColumn("__full", full)
    own = F.collect_list(F.when(F.col("__n") < width, F.col(value)))
    out = out.withColumn("__own", own.over(by.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    lo = F.greatest(F.lit(0), F.col("__i") - F.floor(F.col("__n") / 2)).cast("int")
    hi = F.least(F.col("__n"), F.col("__i") + F.floor((F.col("__n") - 1) / 2) + 1).cast("int")
    part = F.slice("__own", lo + 1, hi - lo)
    short = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / (hi - lo)
    return out.withColumn("smoothed", F.when(F.col("__n") < width, short).otherwise(F.col("__full"))).drop("__n", "__i", "__own", "__full")


def circular_lags(run_lengths: list[int], n_nodes: int, seed: int | np.random.RandomState | np.random.Generator) -> list[tuple[int, int, int]]:
    """(node rank, run, lag) drawn node by node and run by run; a run of one frame draws nothing."""
    rng = np.random.RandomState(seed) if isinstance(seed, int) else seed
    draw = rng.integers if isinstance(rng, np.random.Generator) else rng.randint
    return [(node, run, int(draw(1, n)) if n > 1 else 0) for node in range(n_nodes) for run, n in enumerate(run_lengths)]


def circular_shuffle(activity: DataFrame, positions: DataFrame, seed) -> DataFrame:
    """(node_id, pos, frame, v): each node's values moved round by a lag of its own within each run of frames.

    Lags are drawn in order of node and run, as one generator must; they are numbers per node and run, not per frame.
    """
    runs = contiguous_runs(positions)
    spans = runs.groupBy("run").agg(F.min("pos").alias("lo"), F.count("*").alias("n"))
    lengths = [r["n"] for r in spans.orderBy("run").collect()]
    nodes = activity.select("node_id").distinct()
    ids = [r[0] for r in nodes.orderBy("node_id").collect()]
    spark = activity.sparkSession
    lags = spark.createDataFrame([(ids[k], run, lag) for k, run, lag in circular_lags(lengths, len(ids), seed)], "node_id long, run long, lag long")
    cells = activity.join(runs, "frame").join(F.broadcast(spans), "run").join(lags, ["node_id", "run"])
    if cells.count() != len(ids) * sum(lengths):
        raise ValueError("activity and frames are not aligned")
    to = (F.col("lo") + F.pmod(F.col("pos") - F.col("lo") + F.col("lag"), F.col("n"))).alias("pos")
    return cells.select("node_id", to, "v").join(positions, "pos").select("node_id", "pos", "frame", "v")


def hashed_shuffle(activity: DataFrame, positions: DataFrame, seed: int) -> DataFrame:
    """circular_shuffle() with lags from a hash of (seed, node_id, run): nothing comes to the driver.

    A lag is 1 to n - 1 in a run of n frames, and 0 in a run of one.
    """
    runs = contiguous_runs(positions)
    spans = runs.groupBy("run").agg(F.min("pos").alias("lo"), F.count("*").alias("n"))
    cells = activity.join(runs, "frame").join(tables.small(spans, "spans"), "run")
    whole = activity.select("node_id").distinct().count() * positions.count()
    if cells.count() != whole:
        raise ValueError("activity and frames are not aligned")
    lag = F.when(F.col("n") > 1, 1 + F.pmod(F.xxhash64(F.lit(positive_int(seed, "seed", 0)), "node_id", "run"), F.greatest(F.col("n") - 1, F.lit(1)))).otherwise(0)
    to = (F.col("lo") + F.pmod(F.col("pos") - F.col("lo") + lag, F.col("n"))).alias("pos")
    return cells.select("node_id", to, "v").join(positions, "pos").select("node_id", "pos", "frame", "v")


def stable_rank(df: DataFrame, by: Column, tie: str, name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """Adds the place from 0 by descending value, ties by ascending tie."""
    return tables.ranked(df.withColumn("__by", by), [F.col("__by").desc(), F.col(tie)], name, keys).drop("__by")


def merge_runs(labels: list, lengths: list[int], least: int) -> list:
    """The label of each run after runs shorter than least have been merged, the shortest (first of equals) first.

    A run between equal neighbours joins them; else it joins the longer, the one before if both are as long. Runs are a linked
    list and wait in a heap by length and place; a merged run keeps its first one's place.
    """
    n = len(labels)
    labels, lengths = list(labels), list(lengths)
    before, after, first = list(range(-1, n - 1)), [*range(1, n), -1], list(range(n))
    heap = [(length, k) for k, length in enumerate(lengths)]
    heapq.heapify(heap)
    alone = n
    while heap and alone > 1:
        length, k = heapq.heappop(heap)
        if first[k] != k or lengths[k] != length:
            continue  # merged since
        if length >= least:
            break
        a, b = before[k], after[k]
        labels[k] = labels[a] if b < 0 or (a >= 0 and lengths[a] >= lengths[b]) else labels[b]
        for left, right in ((k, b), (a, k)):
            if left >= 0 and right >= 0 and labels[left] == labels[right]:
                lengths[left] += lengths[right]
                first[right], alone = left, alone - 1
                after[left] = after[right]
                if after[right] >= 0:
                    before[after[right]] = left
                k = left
        heapq.heappush(heap, (lengths[k], k))
    out = []
    for k in range(n):
        out.append(labels[k] if first[k] == k else out[first[k]])
    return out


def merge_short(labels: list, least: int) -> list:
    """merge_runs() of a list of labels, one a frame."""
    runs = [[x, len(list(own))] for x, own in itertools.groupby(labels)]
    merged = merge_runs([x for x, _ in runs], [n for _, n in runs], least)
    return [x for x, (_, n) in zip(merged, runs, strict=True) for _ in range(n)]


def merge_short_runs(df: DataFrame, least: int, keys: list[str], label: str = "state", order: str = "frame") -> DataFrame:
    """Replaces label by that of merge_short(), for each recording (keys) along order.

    Spark finds the runs; a recording's runs, not its frames, come together, and merged labels are joined back.
    """
    least = positive_int(least, "least")
    w = _by(keys).orderBy(order)
    changes = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | (F.row_number().over(w) == 1)
    marked = tables.cut(df.withColumn("__new", changes.cast("long")).withColumn("__run", F.sum("__new").over(w)).drop("__new"), "runs")
    runs = marked.groupBy(*keys, "__run").agg(F.first(label).alias("__label"), F.count("*").alias("__n"))
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__run")
        return pdf.assign(__label=merge_runs(pdf["__label"].tolist(), pdf["__n"].tolist(), least))[[*keys, "__run", "__label"]]

    ddl = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"__run long, __label {types[label]}"])
    merged = runs.groupBy(*keys).applyInPandas(merge, ddl)
    return marked.join(merged, [*keys, "__run"]).select(*[F.col("__label").alias(c) if c == label else c for c in df.columns])


def binned_raster(activity: DataFrame, frames: DataFrame, boundaries: DataFrame, bin_seconds: float, fs: float) -> tuple[DataFrame, DataFrame]:
    """Whether each node fires in each bin of frames, and how many nodes fire at each frame.

    Bins of round(bin_seconds * fs) frames begin anew at every break and change of state. The first table is
    (rank, node_id, bin, centre, fired), nodes ranked by descending number of active frames; the second (frame, n_active).
    """
    bin_frames = max(1, round(positive(bin_seconds, "bin_seconds") * positive(fs, "fs")))
    lengths = frames.agg((F.max("frame") + 1).alias("n_frames"))
    changes = state_runs(frames).select("stop")
    segments = acquisition_segments(lengths, boundaries, changes)
    bins = segments.select(F.explode(F.sequence("start", F.col("stop") - 1, F.lit(bin_frames).cast("long"))).alias("lo"), "stop")
    bins = bins.select("lo", F.least(F.col("lo") + bin_frames, "stop").alias("hi"))
    bins = bins.withColumn("bin", F.row_number().over(_by(None).orderBy("lo")) - 1)  # as many rows as bins
    place = bins.select("bin", ((F.col("lo") + F.col("hi") - 1) / 2).alias("centre"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("frame"))
    fired = activity.select("node_id", "frame", (F.col("v") > 0).cast("int").alias("on"))
    counts = fired.groupBy("node_id").agg(F.sum("on").alias("n"))
    ranks = stable_rank(counts, F.col("n"), "node_id").drop("n")
    raster = fired.join(tables.small(place, "bins"), "frame").groupBy("node_id", "bin", "centre").agg(F.max("on").alias("fired"))
    return raster.join(ranks, "node_id").select("rank", "node_id", "bin", "centre", "fired"), fired.groupBy("frame").agg(F.sum("on").alias("n_active"))


def occupied(raster: DataFrame) -> DataFrame:
    """(rank, bin) of the cells of a raster in which a node fired."""
    return raster.where("fired = 1").select("rank", "bin")


def part_offsets(parts: DataFrame) -> DataFrame:
    """(keys..., part, offset) of parts (recording, part, n): where each begins when they follow each other."""
    w = Window.partitionBy("recording").orderBy("part")
    return parts.select("recording", "part", "n", (F.sum("n").over(w) - F.col("n")).alias("offset"))
