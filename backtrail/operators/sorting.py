"""Global sort by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from backtrail.plans.groups import number_rows
from backtrail.session import stored


def terasort(kv: DataFrame, key: str = "key", tiebreak: Sequence[str] = ()) -> DataFrame:
    """All rows in key order, and rows of one key in the order of the other columns.

    Ranges are cut at sampled rows. Rows that compare equal could not be told apart, so each
    carries a salt, a hash of its place in the scan, as its last sort key: copies of one row,
    however many, spread over ranges, and nothing is aggregated first. Columns in `tiebreak`
    that identify a row come before the others and make a salt needless.
    """
    others = [c for c in kv.columns if c != key and c not in tiebreak]
    if tiebreak:
        return kv.orderBy(key, *tiebreak, *others)
    salted = kv.withColumn("__salt", F.xxhash64(F.monotonically_increasing_id()))
    return salted.orderBy(key, *others, "__salt").select(*kv.columns)


def order_check(ordered: DataFrame, key: str) -> DataFrame:
    """(rows, violations, largest) of a sorted frame: rows whose key is below the one before.

    Neighbours are compared within each partition, and the last key of a partition with the
    first of the next; `largest` is the largest partition's number of rows.
    """
    rows = stored(ordered.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("at")), "ordered")
    rows = rows.withColumn("part", F.shiftright("at", 33))
    before = F.lag("key").over(Window.partitionBy("part").orderBy("at"))
    inside = rows.select("part", "at", "key", (F.col("key") < before).alias("wrong")).groupBy("part").agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("wrong"), 1)).alias("wrong"),
        F.min_by("key", "at").alias("first"), F.max_by("key", "at").alias("last"))
    # One row per partition.
    border = F.col("first") < F.lag("last").over(Window.orderBy("part"))
    joined = inside.withColumn("border", F.when(border, 1).otherwise(0))
    return joined.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
                      F.coalesce(F.sum(F.col("wrong") + F.col("border")), F.lit(0)).alias("violations"),
                      F.coalesce(F.max("rows"), F.lit(0)).alias("largest"))


def sort_positions(kv: DataFrame, order: Sequence[str], name: str = "position") -> DataFrame:
    """Each row's place from 1 in the global order; `order` must be a total order."""
    return number_rows(kv, [], order, name)
