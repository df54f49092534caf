"""Statistics over windows, days, mice and states. The mouse is the replicate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import mean_confidence_interval


def recording_summary(rows: DataFrame, measure: str, keys: list[str], max_windows: int | None = None, density: float | None = None) -> DataFrame:
    """(keys, value): the mean over densities of the mean over windows of rows (keys, density, window, measure)."""
    if max_windows is not None:
        rows = rows.where(F.col("window") < max_windows)
    if density is not None:
        rows = rows.where(F.col("density") == density)
    return rows.groupBy(*keys, "density").agg(F.avg(measure).alias("m")).groupBy(*keys).agg(F.avg("m").alias("value"))


def mean_of_day_means(rows: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """(mouse, keys, value): each day's mean first, then the mean of days, however many windows a day has."""
    days = rows.groupBy("mouse", "recording", *keys).agg(F.avg(measure).alias("m"))
    return days.groupBy("mouse", *keys).agg(F.avg("m").alias("value"))


def pooled_means(rows: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """(mouse, keys, value): the mean over all windows of all days at once; NaN is left out."""
    v = F.when(~F.isnan(measure), F.col(measure))
    return rows.groupBy("mouse", *keys).agg(F.avg(v).alias("value"))


def curve(values: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys, n, mean, se) over mice; se is null for one mouse."""
    return values.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("se"))


def paired_effects(values: DataFrame, other: str, reference: str = "awake", keys: list[str] | None = None, reverse: bool = False) -> DataFrame:
    """(mouse, keys, reference, other, delta) of mice that have both states; delta is other - reference, or reverse."""
    keys = keys or []
    side = lambda s, name: values.where(F.col("state") == s).select("mouse", *keys, F.col("value").alias(name))
    both = side(reference, "reference").join(side(other, "other"), ["mouse", *keys])
    delta = F.col("other") - F.col("reference")
    return both.withColumn("delta", -delta if reverse else delta)


def effect_summary(effects: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return curve(effects, keys or [], "delta")


def spread(rows: DataFrame, measure: str, keys: list[str]) -> DataFrame:
    """(keys, mean, sd) over windows; sd is 0 for one."""
    return rows.groupBy(*keys).agg(F.avg(measure).alias("mean"), F.coalesce(F.stddev_samp(measure), F.lit(0.0)).alias("sd"))


def first_overlap(intervals: DataFrame, order: str) -> DataFrame:
    """(order): the first place at which an interval (lower, upper) holds 0."""
    return intervals.where("lower <= 0 and upper >= 0").agg(F.min(order).alias(order))


def contrast_interval(effects: DataFrame, keys: list[str], confidence: float = 0.95) -> DataFrame:
    return mean_confidence_interval(effects, keys, "delta", confidence)


def state_summary(frames: DataFrame, state: str, fs: float) -> DataFrame:
    """(state, n_frames, minutes)."""
    return frames.groupBy(state).agg(F.count("*").alias("n_frames"), (F.count("*") / fs / 60).alias("minutes"))


def q_spread(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_runs, mean_q, sd_q, max_q) with the population's standard deviation."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), F.avg("q").alias("mean_q"), F.stddev_pop("q").alias("sd_q"), F.max("q").alias("max_q"))


def histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """(bin, n) over bins of equal width from least to greatest, the last one closed. Only filled bins are rows."""
    ends = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).alias("bin")).agg(F.count("*").alias("n"))
