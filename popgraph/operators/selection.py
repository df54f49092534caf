"""Choosing frames, nodes and windows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.checks import positive, positive_int


def state_frames(used_frames: DataFrame, state: str) -> DataFrame:
    """(pos, frame) of one state label, in recorded order; an unknown label is a KeyError that names the known ones."""
    out = used_frames.where(F.col("state") == state)
    if out.isEmpty():
        known = sorted(r[0] for r in used_frames.select("state").distinct().limit(50).collect())
        raise KeyError(f"no state {state!r}; there are {known}")
    return out.drop("state")


def frame_windows(positions: DataFrame, width: int, max_windows: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Adds window, the number of the run of width positions (column pos, from 0); an incomplete last window goes.

    Windows follow the order of pos, across gaps in the frames. The cap is pushed below whatever joins follow.
    """
    width = positive_int(width, "width")
    if max_windows is not None:
        max_windows = positive_int(max_windows, "max_windows", 0)
    keys = keys or []
    n = positions.groupBy(*keys).agg((F.max("pos") + 1).alias("__n"))
    n = positions.crossJoin(F.broadcast(n)) if not keys else positions.join(n, keys)  # without keys n is one row
    out = n.withColumn("window", F.floor(F.col("pos") / width)).where(F.col("window") < F.floor(F.col("__n") / width))
    return (out if max_windows is None else out.where(F.col("window") < max_windows)).drop("__n")


def active_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes whose mask is true, or all where no mask is given (column active null throughout)."""
    return nodes.where(F.coalesce("active", F.lit(True)))


def sampled_nodes(nodes: DataFrame, max_nodes: int | None = None, seed: int = 0) -> DataFrame:
    """active_nodes(), or a seeded sample of max_nodes of them without replacement, by ascending node_id.

    Only the number of nodes comes to the driver, which draws ranks; nodes are then taken by rank, counted in
    ranges of ids so that no single task numbers them all.
    """
    out = active_nodes(nodes)
    if max_nodes is None:
        return out
    max_nodes = positive_int(max_nodes, "max_nodes")
    n = out.count()
    if n <= max_nodes:
        return out
    drawn = np.sort(np.random.RandomState(seed).choice(n, max_nodes, replace=False))
    ranks = out.sparkSession.createDataFrame([(int(r),) for r in drawn], "rank long")
    return tables.ranked(out, [F.col("node_id")]).join(F.broadcast(ranks), "rank", "left_semi").drop("rank")


def activity_at(activity: DataFrame, positions: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """The activity at chosen frames (pos, frame, ...), of chosen nodes: columns of both, ordered by pos."""
    out = activity.join(positions, "frame")
    return out if nodes is None else out.join(nodes.select("node_id"), "node_id", "left_semi")


def micrometres(nodes: DataFrame, px_to_um: float = 1.465) -> DataFrame:
    return nodes.withColumn("x_um", F.col("x_px") * positive(px_to_um, "px_to_um")).withColumn("y_um", F.col("y_px") * px_to_um)


def zero_based(index: Column) -> Column:
    """A 1-based index from 0; below 1 is an error."""
    return F.when(index >= 1, index - 1).otherwise(F.raise_error(F.lit("a 1-based index is below 1")))


def boundary_minutes(boundaries: DataFrame, n_frames: int, fs: float) -> DataFrame:
    """(frame, minute) where a recording breaks; the last frame is no break."""
    n, fs = positive_int(n_frames, "n_frames"), positive(fs, "fs")
    return boundaries.where((F.col("frame") >= 0) & (F.col("frame") < n - 1)).select("frame", ((F.col("frame") + 1) / fs / 60).alias("minute"))


def visible_frames(frames: DataFrame, limits: tuple[float, float], fs: float) -> DataFrame:
    """Frames between two minutes: from the floor of the first to before the ceiling of the second."""
    lo, hi = (positive(fs, "fs") * 60 * x for x in limits)
    return frames.where((F.col("frame") >= F.floor(F.lit(lo))) & (F.col("frame") < F.ceil(F.lit(hi))))


def median_centred(activity: DataFrame) -> DataFrame:
    """Adds centred: v less the node's median over its frames; NaN does not count."""
    medians = tables.grouped_quantiles(activity, ["node_id"], "v", [0.5]).withColumnRenamed("q0", "__m")
    return activity.join(medians, "node_id", "left").withColumn("centred", F.col("v") - F.col("__m")).drop("__m")


def sampled_traces(activity: DataFrame, n_traces: int, seed: int) -> DataFrame:
    """(trace, node_id, frame, centred, shown): a seeded sample of nodes by ascending id, less their medians, one above the other.

    shown is lower by a step from trace to trace: 1.15 times what lies between the 1st and 99th percentile of all sampled
    values. Only the number of nodes comes to the driver, which draws their ranks; activity must have as many nodes.
    """
    nodes = activity.select("node_id").distinct()
    drawn = np.sort(np.random.default_rng(seed).choice(nodes.count(), size=positive_int(n_traces, "n_traces"), replace=False))
    ranks = activity.sparkSession.createDataFrame([(int(r), k) for k, r in enumerate(drawn)], "rank long, trace int")
    chosen = tables.ranked(nodes, [F.col("node_id")]).join(F.broadcast(ranks), "rank").select("node_id", "trace")
    own = tables.cut(median_centred(activity.join(F.broadcast(chosen), "node_id")), "traces")
    low, high = tables.quantiles(own, "centred", [0.01, 0.99])
    step = 1.15 * max((high or 0.0) - (low or 0.0), 1e-6)
    return own.select("trace", "node_id", "frame", "centred", (F.col("centred") - F.col("trace") * step).alias("shown"))
