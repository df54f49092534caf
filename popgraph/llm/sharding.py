"""Sharding by best-fit-decreasing bin packing of indivisible groups.

A group is all rows of equal text. Groups of more than a small share of a shard are packed each; smaller ones go in
bundles, dealt by a hash of the group, so that what is packed is bounded by a parameter and not by the table. Items
sorted by size, largest first, enter the bin with the least remaining capacity that takes them, which a B+ tree over the remaining
capacities finds. Where the capacity is given, the bins are as few as that gives; where the number of shards is, the
capacity is the smallest at which best-fit-decreasing needs no more bins than that.

A bin is chosen for items; each row finds its item by its group's hash. Rows are numbered within their shard by
counts per input partition, so no task holds a shard.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _common as C

#: Items are packed each where they are larger than this share of a shard; so many bundles a shard take the others.
FINE = 1024
#: Items that one task packs, where a capacity makes many bins.
SLICE = 1 << 16
#: Keys of a leaf of the tree, at most.
LEAF = 256
#: Halvings of the range of capacities that are looked at.
HALVINGS = 40


class _Capacities:
    """Remaining capacities of bins, (capacity, bin), in a B+ tree of two levels: leaves of at most LEAF keys under one root."""

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.most: list[tuple[int, int]] = [(-1, -1)]  # the largest key of each leaf

    def add(self, key: tuple[int, int]) -> None:
        k = min(bisect_left(self.most, key), len(self.leaves) - 1)
        leaf = self.leaves[k]
        insort(leaf, key)
        self.most[k] = leaf[-1]
        if len(leaf) > LEAF:
            self.leaves[k : k + 1] = [leaf[: LEAF // 2], leaf[LEAF // 2 :]]
            self.most[k : k + 1] = [leaf[LEAF // 2 - 1], leaf[-1]]

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns the smallest key of at least that capacity."""
        k = bisect_left(self.most, (least, -1))
        if k == len(self.leaves):
            return None
        leaf = self.leaves[k]
        key = leaf.pop(bisect_left(leaf, (least, -1)))
        if leaf:
            self.most[k] = leaf[-1]
        elif len(self.leaves) > 1:
            del self.leaves[k], self.most[k]
        else:
            self.most[k] = (-1, -1)
        return key


def best_fit_decreasing(sizes: np.ndarray, capacity: int, most: int | None = None) -> np.ndarray | None:
    """The bin, from 0, of each item; an item larger than the capacity has a bin to itself. None if over most bins were needed."""
    tree, bins, out = _Capacities(), 0, np.zeros(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        found = tree.take(size)
        if found is None:
            if most is not None and bins == most:
                return None
            found, bins = (capacity, bins), bins + 1
        out[i] = found[1]
        if found[0] > size:
            tree.add((found[0] - size, found[1]))
    return out


def pack_evenly(sizes: np.ndarray, shards: int) -> np.ndarray:
    """The bin, 0 to shards - 1, of each item, with the largest bin as small as best-fit-decreasing makes it.

    Items that are larger than an even share of what is left get a shard to themselves first, the largest before the others.
    """
    out, order, own = np.zeros(len(sizes), np.int64), np.argsort(-sizes, kind="stable"), 0
    rest = int(sizes.sum())
    while own < min(shards - 1, len(order)) and int(sizes[order[own]]) * (shards - own) > rest:
        out[order[own]] = own
        rest -= int(sizes[order[own]])
        own += 1
    left = order[own:]
    if not len(left):
        return out
    sizes, shards = sizes[left], shards - own
    low, best = -(-rest // shards), None
    high = low + int(sizes[0])  # no bin opens at that while all others hold more than an even share
    for _ in range(HALVINGS):
        capacity = (low + high) // 2
        found = best_fit_decreasing(sizes, capacity, shards)
        if found is None:
            low = capacity + 1
        else:
            high, best = capacity, found
        if low >= high:
            break
    best = best_fit_decreasing(sizes, high, shards) if best is None else best
    out[left] = own + best
    return out


def _items(groups: DataFrame, small: int, bundles: int) -> DataFrame:
    """(item, size): large groups each by their hash, the others in bundles, numbered from -1 down."""
    item = item_of(F.col("size") >= small, bundles)
    return groups.withColumn("lone", F.col("size") >= small).groupBy(item.alias("item"), "lone").agg(F.sum("size").alias("size"))


def item_of(lone: Column, bundles: int) -> Column:
    return F.when(lone, F.col("group")).otherwise(-1 - F.pmod(F.xxhash64("group"), F.lit(bundles)))


def _assigned(groups: DataFrame, shards: int | None, capacity: int | None, fine: int) -> tuple[DataFrame, int]:
    """((item, lone, shard), number of bundles) of groups (group, size)."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    bundles = fine * shards if shards is not None else max(1, -(-total * fine // capacity))
    small = max(1, total // (fine * shards) if shards is not None else capacity // fine)
    items = C.materialise(_items(groups, small, bundles), "shard-items")
    if shards is not None:  # at most fine * shards bundles and as many large groups

        def even(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "lone", "item"], ascending=[False, False, True])
            return pd.DataFrame({"item": pdf["item"], "lone": pdf["lone"], "shard": pack_evenly(pdf["size"].to_numpy(np.int64), shards)})

        return items.groupBy(F.lit(0).alias("all")).applyInPandas(even, "item long, lone boolean, shard long"), bundles
    slices = max(1, -(-items.count() // SLICE))

    def tight(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "lone", "item"], ascending=[False, False, True])
        bins = best_fit_decreasing(pdf["size"].to_numpy(np.int64), capacity)
        return pd.DataFrame({"item": pdf["item"], "lone": pdf["lone"], "slice": pdf["slice"], "bin": bins})

    packed = items.withColumn("slice", F.pmod(F.xxhash64("item", "lone"), F.lit(slices)).cast("long"))
    packed = C.materialise(packed.groupBy("slice").applyInPandas(tight, "item long, lone boolean, slice long, bin long"), "shard-bins")
    per = packed.groupBy("slice").agg((F.max("bin") + 1).alias("bins"))  # a row a slice
    first = per.select("slice", (F.sum("bins").over(Window.orderBy("slice")) - F.col("bins")).alias("first"))
    return packed.join(first, "slice").select("item", "lone", (F.col("first") + F.col("bin")).alias("shard")), bundles


def _bytes(text: str) -> Column:
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def _with_shard(rows: DataFrame, groups: DataFrame, shards: int | None, capacity: int | None, fine: int) -> DataFrame:
    """Adds shard (int) to rows that have group; groups is (group, size). Takes the names item, own and shared."""
    assigned, bundles = _assigned(groups, shards, capacity, fine)
    assigned = C.materialise(assigned, "shard-of-items")
    lone = assigned.where("lone").select(F.col("item").alias("group"), F.col("shard").alias("own"))
    bundled = assigned.where("not lone").select("item", F.col("shard").alias("shared"))
    if shards is not None:  # both have at most fine * shards rows
        lone, bundled = F.broadcast(lone), F.broadcast(bundled)
    placed = rows.join(lone, "group", "left").withColumn("item", item_of(F.lit(False), bundles)).join(bundled, "item", "left")
    return placed.withColumn("shard", F.coalesce("own", "shared").cast("int")).drop("item", "own", "shared", "group")


def shard_documents(docs: DataFrame, shards: int | None = None, capacity: int | None = None, doc_id: str = "doc_id", text: str = "text", fine: int = FINE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row: give either shards, their number, or capacity, their bytes.

    size is the UTF-8 bytes of the text and one more. Equal texts are in one shard, null and empty ones together; so are
    texts of equal 64-bit hash. With shards, sizes of shards are near equal, as far as groups allow: a group of more than
    an even share has a shard to itself, and shards may stay empty where groups are few. With capacity, a shard is larger
    only if it holds a single group that is. slot counts from 0 in each shard without gaps, in no stated order. Null ids
    and repeated rows are rows like all others; an empty table gives no rows; further columns are not passed on.
    """
    if (shards is None) == (capacity is None) or (shards or capacity or 0) < 1:
        raise ValueError("give either shards or capacity, one at least")
    # by its partition and place there each row is known: written once, they stay the same whatever is lost
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(_bytes(text)) + 1).cast("long").alias("size"),
        F.crc32(_bytes(text)).alias("text_crc32"),
        F.xxhash64(_bytes(text)).alias("group"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
    )
    rows = C.materialise(rows, "shard-rows")
    groups = C.materialise(rows.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    placed = C.materialise(_with_shard(rows, groups, shards, capacity, fine), "shard-placed")
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))  # a row for each shard in an input partition
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    nth = F.row_number().over(Window.partitionBy("part", "shard").orderBy("at")) - 1
    placed = placed.withColumn("nth", nth).join(before, ["shard", "part"])
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).cast("long").alias("slot"))


def shard_sizes(sharded: DataFrame) -> DataFrame:
    """(shard, n_rows, bytes) of what shard_documents() gives."""
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("bytes"))


def write_shards(docs: DataFrame, path: str, shards: int | None = None, capacity: int | None = None, text: str = "text", fine: int = FINE) -> None:
    """Writes the rows of docs, all columns, as Parquet folders shard=0, shard=1, ... under path, dealt as shard_documents() does.

    docs must not have a column shard. Its texts are read twice: once for the sizes of groups, once to be written; rows are not
    shuffled where shards are few, so a shard's files are as many as tasks that hold its rows.
    """
    if "shard" in docs.columns:
        raise ValueError("docs has a column shard of its own")
    groups = docs.select(F.xxhash64(_bytes(text)).alias("group"), (F.octet_length(_bytes(text)) + 1).cast("long").alias("size"))
    groups = C.materialise(groups.groupBy("group").agg(F.sum("size").alias("size")), "shard-groups")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # so that no column of docs can clash
    plain = plain.withColumn("group", F.xxhash64(_bytes(f"c{docs.columns.index(text)}")))
    _with_shard(plain, groups, shards, capacity, fine).toDF(*docs.columns, "shard").write.partitionBy("shard").parquet(path)
