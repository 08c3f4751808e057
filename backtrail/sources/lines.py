"""Text lines in and out, and record identities that stay the same between jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.session import stored

LID = "__lid"


def read_lines(spark: SparkSession, path: str, min_partitions: int | None = None) -> DataFrame:
    """One `value` row per text line."""
    lines = spark.read.text(path)
    return lines if min_partitions is None else lines.repartition(min_partitions)


def text_lines(df: DataFrame, text: str = "text", line_no: str = "line_no") -> DataFrame:
    """One row per newline-separated line of a text column, numbered from 0 in its text."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.split(text, "\n")).alias(line_no, "value"))


def trace_source(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Give every record an identity made of its own key columns."""
    return df.withColumn(LID, F.struct(*id_cols))


def trace_files(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Read files whose records have no key: the identity is file path and row position.

    Text files carry no row position, so they are written to Parquet once first.
    """
    if kind == "text":
        rows = stored(read_lines(spark, path), "traced-text")
    else:
        rows = spark.read.parquet(path)
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return rows.select("*", place.alias(LID))


def write_text(df: DataFrame, path: str, sep: str = "\t") -> None:
    """Write each row as one text line, its columns joined by `sep`."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    df.select(F.concat_ws(sep, *cells).alias("value")).write.text(path)
