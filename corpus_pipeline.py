"""A corpus pipeline of five stages over documents: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as
the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from popgraph.llm import _common, decontaminate, near_dup, packing, run_dedup, toxicity
from popgraph.llm.queries import TOKENIZER

#: SQL can't express the learnt lexicon of the first stage or the tokenizer of the last.
ORACLE_SQL = None


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5; the lexicon is learnt from labels of rows that are not held out.

    Null and empty texts stay, repeated rows are judged each, an empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~_common.held_out())
    return toxicity.drop_toxic(docs, toxicity.fit(docs, labels))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents less lines and passages that occur earlier; one that held nothing else goes.

    n_chars, where it is a number, is set anew where text went. Null and wordless texts stay; rows that repeat a
    doc_id are cut alike; further columns may have any names; an empty table gives no rows.
    """
    removed = "removed_words"
    while removed in docs.columns:
        removed = f"_{removed}"
    out = run_dedup.remove_repeats(docs, removed=removed)
    emptied = (F.col(removed) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    out = out.where(~F.coalesce(emptied, F.lit(False)))
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    if isinstance(kind, T.NumericType):
        out = out.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates; wordless texts and rows without doc_id stay."""
    return near_dup.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item; null and wordless texts hold none, repeated rows are judged each."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids, packed into sequences of at most 2048; an empty or null text is its end id alone."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", dedup_near),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = _common.materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
