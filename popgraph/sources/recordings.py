"""Recordings as folders of tables, text payloads of the MATLAB containers, and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import cut, small

TABLES = ("recordings", "nodes", "frames", "used_frames", "activity")


def resolve(spark: SparkSession, root: str, name: str, suffix: str = ".parquet") -> str:
    """A full path as it is, else the name below root, else that with suffix; FileNotFoundError if none is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in (name, f"{root}/{name}", f"{root}/{name}{suffix}"):
        p = hadoop.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(f"no {name} below {root}")


def load(spark: SparkSession, root: str, recording: str | None = None) -> dict[str, DataFrame]:
    """The tables of all recordings, or of one: a filter on recording, which prunes partitions."""
    out = {t: spark.read.parquet(f"{root}/{t}") for t in TABLES}
    return out if recording is None else {t: df.where(F.col("recording") == recording) for t, df in out.items()}


def save(tables: dict[str, DataFrame], root: str) -> None:
    for name, df in tables.items():
        df.write.partitionBy("recording").parquet(f"{root}/{name}")


def atlas_labels(spark: SparkSession, root: str) -> DataFrame:
    """(recording, node_id, atlas): only these columns are read."""
    return spark.read.parquet(f"{root}/nodes").select("recording", "node_id", "atlas")


def list_recordings(names: DataFrame) -> DataFrame:
    """Names that hold _sleep or end in _ane, sorted."""
    return names.where(F.col("name").contains("_sleep") | F.col("name").endswith("_ane")).orderBy("name")


def misaligned(nodes: DataFrame, frames: DataFrame, used_frames: DataFrame, activity: DataFrame) -> DataFrame:
    """(problem, n) of rows that no other table has a partner for; no rows if all is well.

    activity is read once: its rows are counted by node with what is wrong with them, and all problems come from those counts.
    """
    known_nodes = nodes.select("recording", "node_id").distinct().withColumn("node_known", F.lit(True))
    known_frames = cut(frames.select("recording", "frame").distinct().withColumn("frame_known", F.lit(True)), "known-frames")
    cells = activity.join(small(known_frames, "frames"), ["recording", "frame"], "left")
    per = cells.groupBy("recording", "node_id").agg(F.count("*").alias("n"), F.count_if(F.col("frame_known").isNull()).alias("odd"))
    per = per.join(known_nodes, ["recording", "node_id"], "left").join(known_frames.groupBy("recording").agg(F.count("*").alias("m")), "recording", "left")
    counts = per.agg(
        F.sum(F.when(F.col("node_known").isNull(), F.col("n"))).alias("activity of unknown nodes"),
        F.sum("odd").alias("activity at unknown frames"),
        F.count_if(F.col("n") != F.col("m")).alias("nodes with missing frames"),
    )
    unused = used_frames.join(known_frames, ["recording", "frame"], "left_anti").agg(F.count("*").alias("used frames that are not recorded"))
    both = counts.crossJoin(unused)  # a row each
    return both.select(F.inline(F.array(*[F.struct(F.lit(c).alias("problem"), F.coalesce(F.col(f"`{c}`"), F.lit(0)).alias("n")) for c in both.columns]))).where("n > 0")


def decode_strings(words: list[int]) -> list[str]:
    """Strings of a packed payload of 64-bit words: 1, 2, count, 1, then lengths, then UTF-16 units, four a word."""
    if len(words) < 4 or words[0] != 1 or words[1] != 2 or words[3] != 1:
        raise ValueError("not a string payload")
    count = words[2]
    lengths = words[4 : 4 + count]
    if len(lengths) != count or any(n < 0 or n >= 1 << 63 for n in lengths):
        raise ValueError("bad lengths in a string payload")
    data = b"".join(int(w).to_bytes(8, "little") for w in words[4 + count :])
    if len(data) // 8 != -(-sum(lengths) // 4):
        raise ValueError("a string payload of the wrong size")
    out, at = [], 0
    for n in lengths:
        out.append(data[2 * at : 2 * (at + n)].decode("utf-16-le"))
        at += n
    return out


def locate_strings(payloads: DataFrame) -> DataFrame:
    """payloads (container, name, words array<long>) to (container, name, strings): of each container the one that decodes as strings.

    Only words that begin like such a payload are handed to Python. None or several in a container is an error that names it;
    words hold unsigned numbers, so those that read as negative are taken as such. An empty table gives no rows.
    """
    w = F.col("words")
    likely = (F.size(w) >= 4) & (F.get(w, F.lit(0)) == 1) & (F.get(w, F.lit(1)) == 2) & (F.get(w, F.lit(3)) == 1)

    def decode(batches):
        for pdf in batches:
            strings = []
            for words in pdf["words"]:
                try:
                    strings.append(decode_strings([int(x) & (1 << 64) - 1 for x in words]))
                except ValueError:
                    strings.append(None)
            yield pdf[["container", "name"]].assign(strings=strings)

    kind = payloads.schema["container"].dataType.simpleString()
    found = payloads.where(likely).select("container", "name", "words").mapInPandas(decode, f"container {kind}, name string, strings array<string>").where("strings is not null")
    found = found.withColumn("found", F.lit(1)).unionByName(payloads.select("container").distinct(), allowMissingColumns=True)
    per = found.groupBy("container").agg(F.count("found").alias("n"), F.first("name", True).alias("name"), F.first("strings", True).alias("strings"))
    told = F.concat(F.coalesce(F.col("container").cast("string"), F.lit("null")), F.lit(" has "), F.col("n").cast("string"), F.lit(" payloads of strings"))
    checked = lambda c: F.when(F.col("n") == 1, F.col(c)).otherwise(F.raise_error(told)).alias(c)
    return per.select("container", checked("name"), checked("strings"))


def concat_parts(parts: DataFrame) -> DataFrame:
    """Samples of parts (recording, part, sample, ...) numbered through: sample counts on from part to part."""
    from pyspark.sql import Window

    lengths = parts.groupBy("recording", "part").agg((F.max("sample") + 1).alias("n"))
    w = Window.partitionBy("recording").orderBy("part")
    offsets = lengths.select("recording", "part", (F.sum("n").over(w) - F.col("n")).alias("__offset"))
    return parts.join(small(offsets, "offsets"), ["recording", "part"]).withColumn("sample", F.col("sample") + F.col("__offset")).drop("__offset")


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """Rows with a header; one_file for small results."""
    (df.coalesce(1) if one_file else df).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)
