"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept, and what it decides takes effect: documents
of low quality go, lines that repeat go (and documents that consist of nothing else),
one document of each group of near copies stays, contaminated documents go, and the
rest is packed. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulframe.llm import decontaminate, line_dedup, mil, near_dedup
from haulframe.llm.queries import pack, table
from haulframe.llm.storage import remove_stored, stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return mil.accepted(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat; those that lost all their lines go.

    ``n_chars`` follows the text.
    """
    left = line_dedup.dedup_lines(docs).where(~F.col("emptied")).select(*docs.columns)
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.one_of_each(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("line dedup", line_stage),
    ("near dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: A fitted classifier cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        remove_stored(before)  # the tables of the input are not ours and stay
    return STAGES[-1][1](spark, docs, sf_dir)
