"""Graphs as edge lists (i < j, w) and partitions as (node_id, module)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tables
from ..functions.checks import positive_int
from .correlate import in_blocks


def _by(keys):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def modularity_value(edges: DataFrame, partition: DataFrame, gamma: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """(keys, q): modularity of a partition, from weights inside modules and degrees; 0 without edges.

    partition may have more keys than edges (runs of the same graph): keys are those of partition, and edges are
    joined on those of them that they have.
    """
    keys = keys or []
    shared = [k for k in keys if k in edges.columns]
    ends = edges.select(*shared, F.col("i").alias("node_id"), "w").union(edges.select(*shared, F.col("j").alias("node_id"), "w"))
    degree = ends.groupBy(*shared, "node_id").agg(F.sum("w").alias("k"))
    per = partition.join(degree, [*shared, "node_id"], "left").groupBy(*keys, "module").agg(F.sum(F.coalesce("k", F.lit(0.0))).alias("deg"))
    a = partition.select(*keys, F.col("node_id").alias("i"), F.col("module").alias("mi"))
    b = partition.select(*keys, F.col("node_id").alias("j"), F.col("module").alias("mj"))
    if len(shared) == len(keys):
        inside = edges.join(a, [*shared, "i"]).join(b, [*keys, "j"]).where("mi = mj").groupBy(*keys, F.col("mi").alias("module")).agg(F.sum("w").alias("w_in"))
    else:
        inside = _inside_of_runs(edges, partition, keys, shared)
    total = per.groupBy(*keys).agg(F.sum("deg").alias("two_m"))
    joined = per.join(inside, [*keys, "module"], "left")
    joined = joined.join(total, keys) if keys else joined.crossJoin(F.broadcast(total))
    share = F.try_divide(2 * F.coalesce("w_in", F.lit(0.0)), F.col("two_m")) - gamma * F.pow(F.try_divide(F.col("deg"), F.col("two_m")), F.lit(2.0))
    return joined.groupBy(*keys).agg(F.sum(F.coalesce(share, F.lit(0.0))).alias("q"))


def _inside_of_runs(edges: DataFrame, partition: DataFrame, keys: list[str], shared: list[str]) -> DataFrame:
    """(keys, module, w_in): an edge meets its ends' modules of all runs at once, as lists of numbers, not once for each run."""
    known = partition.where("module is not null")
    numbers = tables.small(known.select(*keys, "module").distinct().withColumn("__m", F.monotonically_increasing_id()), "modules")
    lists = known.join(numbers, [*keys, "module"]).groupBy(*shared, "node_id").agg(F.collect_list("__m").alias("__l"))
    a = lists.select(*shared, F.col("node_id").alias("i"), F.col("__l").alias("__a"))
    b = lists.select(*shared, F.col("node_id").alias("j"), F.col("__l").alias("__b"))
    both = edges.select(*shared, "i", "j", "w").join(a, [*shared, "i"]).join(b, [*shared, "j"])
    w_in = both.select("w", F.explode(F.array_intersect("__a", "__b")).alias("__m")).groupBy("__m").agg(F.sum("w").alias("w_in"))
    return w_in.join(numbers, "__m").select(*keys, "module", "w_in")


def n_modules(partition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return partition.groupBy(*(keys or [])).agg(F.countDistinct("module").alias("n_modules"))


def components(edges: DataFrame, nodes: DataFrame, checkpoint, keys: list[str] | None = None) -> DataFrame:
    """(keys, node_id, component): the least node that each can reach. checkpoint(df) cuts the lineage of each round.

    Each round a node takes the least label of its neighbours, and then what that label's node had itself: labels are
    looked up in the table of those that are one, so a component of all nodes makes no long list for one key.
    """
    keys = keys or []
    links = edges.select(*keys, F.col("i").alias("u"), F.col("j").alias("v"))
    links = links.union(links.select(*keys, "v", "u"))
    label = nodes.select(*keys, "node_id", F.col("node_id").alias("component"))
    while True:
        near = links.join(label.withColumnRenamed("node_id", "v"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node_id")).agg(F.min("component").alias("m"))
        new = label.join(near, [*keys, "node_id"], "left").select(*keys, "node_id", F.least("component", "m").alias("to"), "component")
        hop = label.join(label.select(*keys, F.col("component").alias("node_id")).distinct(), [*keys, "node_id"], "left_semi").select(*keys, F.col("node_id").alias("to"), F.col("component").alias("hop"))
        new = checkpoint(new.join(hop, [*keys, "to"]).select(*keys, "node_id", F.least("to", "hop").alias("next"), "component"))
        if new.where("next < component").isEmpty():
            return new.select(*keys, "node_id", F.col("next").alias("component"))
        label = new.select(*keys, "node_id", F.col("next").alias("component"))


def giant_start(labelled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, node_id, module): each node of the largest component alone, all others together as module 1.

    labelled is (keys, node_id, component). Of equally large components that with the least node counts. A
    connected graph starts as 1..N by node.
    """
    keys = keys or []
    sizes = labelled.groupBy(*keys, "component").agg(F.count("*").alias("n"))
    top = sizes.groupBy(*keys).agg(F.max(F.struct("n", -F.col("component"))).alias("t"), F.count("*").alias("parts"))
    top = top.select(*keys, (-F.col("t.col2")).alias("giant"), "parts")
    out = labelled.join(top, keys) if keys else labelled.crossJoin(F.broadcast(top))
    out = out.select(*keys, "node_id", (F.col("component") == F.col("giant")).alias("inside"), (F.col("parts") > 1).cast("long").alias("more"))
    inside = tables.ranked(out.where("inside"), [F.col("node_id")], "place", keys)
    inside = inside.select(*keys, "node_id", (F.col("place") + 1 + F.col("more")).cast("long").alias("module"))
    return inside.union(out.where("not inside").select(*keys, "node_id", F.lit(1).cast("long")))


def display_layout(partition: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, module, shown, n, start, stop): modules renumbered by descending size (ties by label), with their blocks."""
    keys = keys or []
    sizes = partition.groupBy(*keys, "module").agg(F.count("*").alias("n"))
    w = _by(keys).orderBy(F.desc("n"), "module")
    stop = F.sum("n").over(w)
    return sizes.select(*keys, "module", F.row_number().over(w).cast("long").alias("shown"), "n", (stop - F.col("n")).alias("start"), stop.alias("stop"))


#: Nodes of a block of agreement() at least, and labels of a block at most, which is what a task's memory goes with.
BLOCK, BLOCK_LABELS = 512, 4_000_000
#: Nodes by nodes that are compared at once, and tasks that pairs of blocks are dealt to.
TILE, TASKS = 1024, 96


def agreement(runs: DataFrame, keys: list[str] | None = None, decimals: int | None = None, block: int = BLOCK) -> DataFrame:
    """(keys, i, j, agreement): share of runs in which two nodes are in one module. Pairs that never are, are not rows.

    Nodes meet in pairs of blocks, a pair a task's, with their modules of all runs, so that each pair of nodes is counted where it
    is made: what is shuffled grows with the nodes' labels, not with pairs. decimals rounds the shares.
    """
    keys = keys or []
    types = {f.name: f.dataType for f in runs.schema}
    # equal modules have equal names, and -0 is 0
    kind = types["module"].simpleString()
    module = F.col("module").cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else (F.col("module") + 0.0 if kind in ("float", "double") else F.col("module")).cast("string")
    n = runs.groupBy(*keys).agg(F.countDistinct("run").alias("__runs"))
    known = runs.where(" and ".join(f"`{c}` is not null" for c in (*keys, "run", "module", "node_id")))
    of_run = known.select(*keys, "node_id", "run", module.alias("module"))
    numbers = of_run.select(*keys, "run").distinct().withColumn("__r", F.dense_rank().over(_by(keys).orderBy("run")) - 1)  # a row a run
    own = of_run.join(tables.small(numbers, "runs"), [*keys, "run"]).groupBy(*keys, "node_id").agg(F.collect_list("__r").alias("__r"), F.collect_list("module").alias("__m"))
    met = in_blocks(own, keys, positive_int(block, "block", 2), F.ceil(F.sum(F.size("__r")) / BLOCK_LABELS), n)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("node_id", ignore_index=True)
        first, ids, b = pdf.iloc[0], pdf["node_id"].to_numpy(), pdf["__b"].to_numpy()
        left, right = np.flatnonzero(b == first["__lo"]), np.flatnonzero(b == first["__hi"])
        slots = _slots(pdf["__r"], pdf["__m"])
        shares = np.arange(1 + sum(x.shape[1] * x.shape[1] for x in slots)) / int(first["__runs"])
        shares = shares if decimals is None else np.round(shares, decimals)
        same = first["__lo"] == first["__hi"]
        for p in range(0, len(left), TILE):
            for q in range(p if same else 0, len(right), TILE):
                u, v = left[p : p + TILE], right[q : q + TILE]
                c = np.zeros((len(u), len(v)), np.int16 if len(shares) < 1 << 15 else np.int32)
                for x in slots:
                    mine, others = x[u], np.where(x[v] < 0, -2, x[v])
                    for s in mine.T:
                        for t in others.T:
                            c += s[:, None] == t
                at = np.nonzero(np.triu(c, 1) if same and p == q else c)
                if len(at[0]):
                    iu, jv = ids[u][at[0]], ids[v][at[1]]
                    out = pd.DataFrame({"i": np.minimum(iu, jv), "j": np.maximum(iu, jv), "agreement": shares[c[at]]})
                    for k in reversed(keys):
                        out.insert(0, k, first[k])
                    yield out

    ddl = ", ".join([*(f"`{k}` {types[k].simpleString()}" for k in keys), "i long, j long, agreement double"])
    met = met.select(*keys, "node_id", "__r", "__m", "__b", "__lo", "__hi", "__runs").repartition(TASKS, *keys, "__lo", "__hi")
    return met.groupBy(*keys, "__lo", "__hi").applyInPandas(count, ddl)


def _slots(runs: pd.Series, modules: pd.Series) -> list[np.ndarray]:
    """For each run, the modules of each node in it, by number, with -1 where it has no more: one column, unless a node has several in a run."""
    node = np.repeat(np.arange(len(runs)), runs.str.len())
    run, module = np.concatenate(runs.to_list()), pd.factorize(np.concatenate(modules.to_list()))[0]
    order = np.lexsort((node, run))
    out = []
    for own in np.split(order, np.flatnonzero(np.diff(run[order])) + 1):
        begin = np.concatenate([[True], np.diff(node[own]) > 0])
        nth = np.arange(len(own)) - np.flatnonzero(begin)[np.cumsum(begin) - 1]
        x = np.full((len(runs), int(nth.max()) + 1), -1, np.int32)
        x[node[own], nth] = module[own]
        out.append(x)
    return out


def contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(module_a, module_b, overlap, size_a, size_b, cosine) of two partitions of the same nodes."""
    both = a.select("node_id", F.col("module").alias("module_a")).join(b.select("node_id", F.col("module").alias("module_b")), "node_id")
    cells = both.groupBy("module_a", "module_b").agg(F.count("*").alias("overlap"))
    na = both.groupBy("module_a").agg(F.count("*").alias("size_a"))
    nb = both.groupBy("module_b").agg(F.count("*").alias("size_b"))
    out = cells.join(na, "module_a").join(nb, "module_b")
    return out.withColumn("cosine", F.col("overlap") / F.sqrt(F.col("size_a").cast("double") * F.col("size_b")))


def first_seen(partition: DataFrame, value: str) -> DataFrame:
    """(module, value) of each module's first node that has one."""
    return partition.where(F.col(value).isNotNull()).groupBy("module").agg(F.min_by(value, "node_id").alias(value))
