"""A corpus pipeline over the documents table: filter, deduplicate, decontaminate, mix.

Each stage is written as Parquet and read again before the next one runs, so a lost
executor costs no more than the stage it is in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from backtrail.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from backtrail.llm.common import remainder, table
from backtrail.session import drop, scratch, scratch_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of runs of lines and of long lines go, and documents that consisted of them."""
    return line_dedup.dedup_lines(docs, min_words=line_dedup.MIN_WORDS).select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, as often as the mix takes them."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("near dedup", dedup_near),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

# The toxicity model is not SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage keeps. A stage's own tables, and its input, go when it is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        drop(spark, *before)
        docs, before = spark.read.parquet(path), [path]
    return docs
