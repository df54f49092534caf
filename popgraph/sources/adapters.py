"""The data model over plain tables: events become activity, embeddings become nodes with vectors and places.

frames(frame, state_code, segment)   activity(node_id, frame, v)   vectors(node_id, v, x, y, module, atlas)
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Frame 0 of the events' activity; a frame is an hour, an acquisition segment a day.
ORIGIN = "2024-01-01"
SEGMENT_FRAMES = 24
#: Nodes whose vectors are made at once.
NODES_AT_ONCE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, frame, v): the summed value of a user's events in an hour; hours without events are not rows."""
    events = table(spark, sf_dir, "events")
    frame = F.timestamp_diff("HOUR", F.lit(ORIGIN).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return events.groupBy(F.col("user_id").alias("node_id"), frame.alias("frame")).agg(F.sum("value").alias("v"))


def state_of(frame) -> F:
    """State code by the hour of the day."""
    hour = frame % 24
    return F.when(hour < 5, 1.0).when(hour < 7, 2.0).when(hour == 7, 0.5).otherwise(0.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, state_code, segment) of all hours in which something happened."""
    events = table(spark, sf_dir, "events")
    frame = F.timestamp_diff("HOUR", F.lit(ORIGIN).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    f = F.col("frame")
    return events.select(frame.alias("frame")).distinct().select("frame", state_of(f).alias("state_code"), F.floor(f / SEGMENT_FRAMES).alias("segment"))


def activity(spark: SparkSession, sf_dir: str, only: DataFrame | None = None) -> DataFrame:
    """(node_id, frame, v), dense: every node at every frame (or at those of only), 0 where nothing happened. The frames are a short list."""
    cells = event_cells(spark, sf_dir)
    spine = (frames(spark, sf_dir) if only is None else only).agg(F.sort_array(F.collect_list("frame")).alias("all_frames"))  # hours, not events
    nodes = cells.groupBy("node_id").agg(F.map_from_entries(F.collect_list(F.struct("frame", "v"))).alias("m"))
    dense = nodes.join(F.broadcast(spine)).select("node_id", "m", F.explode("all_frames").alias("frame"))
    return dense.select("node_id", "frame", F.coalesce(F.try_element_at("m", F.col("frame")), F.lit(0.0)).alias("v"))


def activity_vectors(spark: SparkSession, sf_dir: str, only: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, node_id, v): activity() of each node as a vector in order of frames, at all frames or for each key at those of only (keys, frame).

    A node's events meet the few lists of frames at once; no row a node and frame is made.
    """
    keys = keys or []
    lists = (frames(spark, sf_dir) if only is None else only).groupBy(*keys).agg(F.sort_array(F.collect_list("frame")).alias("frames"))  # hours, not events
    lists = lists.agg(F.collect_list(F.struct(*keys, "frames")).alias("__w"))
    told = event_cells(spark, sf_dir).groupBy("node_id").agg(F.collect_list(F.struct("frame", "v")).alias("__c"))
    told = told.select("node_id", F.col("__c.frame").alias("at"), F.col("__c.v").alias("v")).join(F.broadcast(lists)).select("node_id", "at", "v", "__w")

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for lo in range(0, len(whole), NODES_AT_ONCE):
                pdf = whole.iloc[lo : lo + NODES_AT_ONCE]
                windows = [w if isinstance(w, dict) else w.asDict() for w in pdf["__w"].iloc[0]]
                known = np.unique(np.concatenate([np.empty(0, np.int64), *(np.asarray(w["frames"], np.int64) for w in windows)]))
                n, at, v = pdf["at"].map(len).to_numpy(), np.concatenate(pdf["at"].to_numpy()).astype(np.int64), np.concatenate(pdf["v"].to_numpy())
                node, place = np.repeat(np.arange(len(pdf)), n), np.minimum(np.searchsorted(known, at), max(len(known) - 1, 0))
                seen = known[place] == at if len(known) else np.zeros(len(at), bool)
                m = np.zeros((len(pdf), len(known)))
                m[node[seen], place[seen]] = v[seen]
                for w in windows:
                    out = pd.DataFrame({"node_id": pdf["node_id"].to_numpy(), "v": list(m[:, np.searchsorted(known, np.asarray(w["frames"], np.int64))])})
                    for k in reversed(keys):
                        out.insert(0, k, w[k])
                    yield out

    types = {} if only is None else {f.name: f.dataType.simpleString() for f in only.schema}
    return told.mapInPandas(dense, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "node_id long, v array<double>"]))


#: Raw atlas labels that nodes are given in turn, by their number.
ATLAS = ("MOs2/3", "SSp-bfd2/3", "RSPd2/3", "VISp2/3", "root", " nan ", "VISal2/3", "Unassigned", "n/a", "MOp", None)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node_id, v, x, y, module, atlas, active) of embeddings: places in micrometres from the first two components."""
    e = table(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    atlas = F.get(F.array(*[F.lit(a) for a in ATLAS]), (F.col("vec_id") % len(ATLAS)).cast("int"))
    return e.select(
        F.col("vec_id").alias("node_id"), v.alias("v"), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"),
        F.col("label").cast("long").alias("module"), atlas.alias("atlas"), (F.col("vec_id") % 7 != 3).alias("active"),
    )


def trigger_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(recording, part, sample, v): the events' values as a sampled signal; a recording a day."""
    events = table(spark, sf_dir, "events")
    day = F.timestamp_diff("DAY", F.lit(ORIGIN).cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz"))
    return events.select(day.alias("recording"), (F.hour(F.col("ts")) >= 12).cast("int").alias("part"), F.col("event_id").alias("sample"), F.col("value").alias("v"))
