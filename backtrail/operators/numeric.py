"""Range filters, buckets and range statistics over one numeric column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The default buckets and the bounds between them.
SIZE_BOUNDS = (100.0, 1000.0)
SIZE_LABELS = ("Small", "Medium", "Large")


def filter_range(df: DataFrame, col: str, lo: float, hi: float, closed: str = "neither") -> DataFrame:
    """Rows whose value lies between the bounds; `closed`: neither, left, right or both."""
    c = F.col(col)
    low = c >= lo if closed in ("left", "both") else c > lo
    high = c <= hi if closed in ("right", "both") else c < hi
    return df.filter(low & high)


def bucket(col: str, bounds: Sequence[float] = SIZE_BOUNDS,
           labels: Sequence[str] = SIZE_LABELS) -> Column:
    """The label of the first bound above the value, else the last label."""
    if len(labels) != len(bounds) + 1:
        raise ValueError("one label more than bounds is needed")
    label = F
    for bound, text in zip(bounds, labels):
        label = label.when(F.col(col) < bound, text)
    return label.otherwise(labels[-1])


def bucketize(df: DataFrame, col: str, bounds: Sequence[float] = SIZE_BOUNDS,
              labels: Sequence[str] = SIZE_LABELS, out: str = "category") -> DataFrame:
    return df.withColumn(out, bucket(col, bounds, labels))


def category_stats(df: DataFrame, col: str, bounds: Sequence[float] = SIZE_BOUNDS,
                   labels: Sequence[str] = SIZE_LABELS, by: Sequence[str] = ()) -> DataFrame:
    """(category, count, total)."""
    return bucketize(df, col, bounds, labels).groupBy(*by, "category").agg(
        F.count(F.lit(1)).alias("count"), F.sum(col).alias("total")
    )


def range_stats(df: DataFrame, col: str, lo: float, hi: float, by: Sequence[str] = (),
                closed: str = "neither") -> DataFrame:
    """(count, total, mean, stddev) within a range; the deviation is the population's."""
    return filter_range(df, col, lo, hi, closed).groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(col).alias("total"),
        F.avg(col).alias("mean"),
        F.stddev_pop(col).alias("stddev"),
    )
