"""Set operations and splits of record sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from backtrail.plans.groups import expand_copies, number_rows


def _by_value(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides counted per distinct row in one aggregation; nulls compare equal."""
    cols = a.columns
    left = a.select(*cols, F.lit(1).alias("__a"), F.lit(0).alias("__b"))
    right = b.select(*cols, F.lit(0).alias("__a"), F.lit(1).alias("__b"))
    return left.unionAll(right).groupBy(*cols).agg(
        F.sum("__a").alias("__a"), F.max("__b").alias("__b")
    )


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of `a` whose value is absent from `b`, with their repetitions."""
    only = _by_value(a, b).filter((F.col("__a") > 0) & (F.col("__b") == 0))
    return expand_copies(only.select(*a.columns, "__a"), "__a")


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct values present on both sides."""
    both = _by_value(a, b).filter((F.col("__a") > 0) & (F.col("__b") > 0))
    return both.select(*a.columns)


def split(df: DataFrame, n: int, order: Sequence[str] = (), seed: int | None = None,
          name: str = "part") -> DataFrame:
    """Number the rows' parts 0..n-1, equal in size to within one row.

    Parts are runs of the given total order. With `seed` the order is first shuffled by a
    hash of the ordering columns, which gives a repeatable random split.
    """
    by = list(order)
    if seed is not None:
        df = df.withColumn("__mix", F.xxhash64(F.lit(seed), *order))
        by = ["__mix", *by]
    numbered = number_rows(df, [], by)
    total = numbered.count()
    part = F.floor((F.col("__rn") - 1) * n / F.lit(max(total, 1))).cast("int")
    return numbered.withColumn(name, part).drop("__rn", "__mix")
