"""Written tables, and ranks and exact quantiles without sorting a column in one task."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = 2048


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; one of our own only in local mode, where there is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes a written table, once nothing that is still to run reads it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """df as a written table."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a table that is handed to every task, at most.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, name: str = "small") -> DataFrame:
    """df as a written table; marked for broadcast if it has BROADCAST_ROWS rows or fewer, else joined like any other."""
    df = cut(df, name)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows that are put in order at once.
RUN_ROWS = 4_000_000


def in_runs(df: DataFrame, column: str, rows: int = RUN_ROWS) -> DataFrame:
    """df's rows, each so many of a task in order of a column of numbers: like values lie together, and a stored table of correlations takes less disk.

    Nothing is shuffled or written; a task holds two copies of that many rows at most.
    """

    def ordered(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield from whole.take(np.argsort(whole[column].to_numpy())).to_batches(max_chunksize=100_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from ordered(held)
                held, n = [], 0
        if n:
            yield from ordered(held)

    return df.mapInArrow(run, df.schema)


@contextmanager
def spread(spark: SparkSession, tasks: int = 4) -> Iterator[None]:
    """Tables that are read within are dealt to tasks for each core, not by their bytes: for rows whose work is much more than their reading."""
    name = "spark.sql.files.minPartitionNum"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(tasks * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def ranked(df: DataFrame, order: list[Column], name: str = "rank", keys: list[str] | None = None) -> DataFrame:
    """Adds the place of each row by order, from 0 (within its keys); order has no two equal rows.

    Rows are dealt by ranges of their order and sorted there; places come from counts per range, so no task sees all rows,
    and it makes no difference how values or ids are spread.
    """
    keys = keys or []
    own = df.repartitionByRange(*[F.col(k) for k in keys], *order).sortWithinPartitions(*[F.col(k) for k in keys], *order)
    own = cut(own.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    counts = own.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__part")  # a row a range
    before = counts.withColumn("__before", F.sum("__n").over(w) - F.col("__n")).select(*keys, "__part", "__from", "__before")
    out = own.join(before, [*keys, "__part"])
    return out.withColumn(name, F.col("__before") + F.col("__at") - F.col("__from")).drop("__part", "__at", "__from", "__before")


#: Values of a group that one task's buffer may hold.
GROUP_VALUES = 100_000


def grouped_quantiles(df: DataFrame, keys: list[str], column: str, shares: list[float], most: int = GROUP_VALUES) -> DataFrame:
    """(keys, q0, q1, ...): exact quantiles of each group, linear between neighbours; nulls and NaN are left out.

    Groups of up to most values are one aggregate. For the ranks of all larger groups together, each pass counts values by cells of the
    range that a rank lies in and goes on with its cell, until that is one value: no buffer holds a group, and what is read again is
    what lies in those cells.
    """
    x = df.select(*keys, F.col(column).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    sizes = x.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    names = [f"q{k}" for k in range(len(shares))]
    large = sizes.where(F.col("__n") > most)
    if not large.isEmpty():
        large = small(large, "large-groups")
    else:
        return x.groupBy(*keys).agg(*[F.percentile("__x", F.lit(s)).alias(c) for s, c in zip(shares, names, strict=True)])
    few = x.join(large, keys, "left_anti").groupBy(*keys).agg(*[F.percentile("__x", F.lit(s)).alias(c) for s, c in zip(shares, names, strict=True)])
    # two ranks for each share; they lie __rest places after the first value from __lo on
    wanted = F.array(*[F.struct(F.lit(k).alias("__share"), F.lit(up).alias("__up"), (F.ceil if up else F.floor)((F.col("__n") - 1) * F.lit(float(s))).alias("__rest")) for k, s in enumerate(shares) for up in (0, 1)])
    rest, found, rows = large.select(*keys, "__lo", "__hi", F.inline(wanted)), None, x.join(large.select(*keys), keys, "left_semi")
    while True:
        rest = cut(rest, "ranks")
        ended = rest.where("__lo = __hi").select(*keys, "__share", "__up", F.col("__lo").alias("__v"))
        found = ended if found is None else found.union(ended)
        rest = rest.where("__lo < __hi")
        if rest.isEmpty():
            break
        # rows that lie in a range that is still open, once for each range
        ranges = small(rest.select(*keys, "__lo", "__hi").distinct(), "open-ranges")
        rows = cut(rows.select(*keys, "__x").join(ranges, keys).where("__x between __lo and __hi"), "open-rows")
        cell = F.least(F.floor((F.col("__x") - F.col("__lo")) * (F.lit(float(CELLS)) / (F.col("__hi") - F.col("__lo")))), F.lit(CELLS - 1))
        # a range that is too narrow to divide is its two ends
        cell = F.when(F.col("__x") == F.col("__lo"), -1).when(F.col("__x") == F.col("__hi"), CELLS).otherwise(cell)
        cells = rows.groupBy(*keys, "__lo", "__hi", cell.alias("__c")).agg(F.count("*").alias("__n"), F.min("__x").alias("__a"), F.max("__x").alias("__b"))
        upto = F.sum("__n").over(Window.partitionBy(*keys, "__lo", "__hi").orderBy("__c"))  # CELLS + 2 rows at most
        cells = small(cells.withColumn("__upto", upto), "cells")
        rest = rest.join(cells, [*keys, "__lo", "__hi"]).where("__rest >= __upto - __n and __rest < __upto")
        rest = rest.select(*keys, F.col("__a").alias("__lo"), F.col("__b").alias("__hi"), "__share", "__up", (F.col("__rest") - F.col("__upto") + F.col("__n")).alias("__rest"))
    at = lambda k, up: F.max(F.when((F.col("__share") == k) & (F.col("__up") == up), F.col("__v")))
    wide = found.groupBy(*keys).agg(*[x for k in range(len(shares)) for x in (at(k, 0).alias(f"__{k}a"), at(k, 1).alias(f"__{k}b"))]).join(large.select(*keys, "__n"), keys)
    part = lambda s: (F.col("__n") - 1) * F.lit(float(s)) - F.floor((F.col("__n") - 1) * F.lit(float(s)))
    return few.union(wide.select(*keys, *[(F.col(f"__{k}a") + (F.col(f"__{k}b") - F.col(f"__{k}a")) * part(s)).alias(c) for k, (s, c) in enumerate(zip(shares, names, strict=True))]))


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles of a column, linear between neighbours; nulls and NaN are left out, and of no values they are null.

    Each pass counts values by cells of a range (CELLS numbers come to the driver) and goes on with the cell that holds
    the rank, until that has one value. No task sorts or keeps the column.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    whole = x.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    if not whole["n"]:
        return [None] * len(shares)
    places = [(whole["n"] - 1) * s for s in shares]
    found = {rank: _ranked(x, rank, whole["n"], whole["lo"], whole["hi"]) for rank in {f(p) for p in places for f in (math.floor, math.ceil)}}
    return [found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for p in places]


def _ranked(x: DataFrame, rank: int, n: int, lo: float, hi: float) -> float:
    """The value of a rank, from 0, among n values from lo to hi."""
    before = 0
    while lo < hi:
        cell = F.least(F.floor((F.col("x") - lo) * (CELLS / (hi - lo))), F.lit(CELLS - 1))
        cells = x.where(F.col("x").between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("cell").collect()
        for c in cells:
            if before + c["n"] > rank:
                if (c["lo"], c["hi"]) == (lo, hi):  # a range too narrow to divide: its values are its ends
                    low = x.where(F.col("x") == lo).count()
                    return lo if rank < before + low else hi
                lo, hi = c["lo"], c["hi"]
                break
            before += c["n"]
    return lo
