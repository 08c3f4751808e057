"""Groups of rows compared pair by pair, in tasks of bounded size.

A group too large for a task is dealt into blocks, and each pair of blocks is a group of its
own that one task compares.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.plans.groups import measure


def block_pairs(block: Column, first: Column, last: Column) -> Column:
    """(lo, hi) for the pairs of a block with each of the blocks from `first` to `last`."""
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda j: F.struct(
        F.least(block, j).alias("lo"), F.greatest(block, j).alias("hi")))).otherwise(
            F.array().cast("array<struct<lo:int,hi:int>>"))


def gathered(rows: DataFrame, keys: Sequence[str], *order: str) -> DataFrame:
    """The rows of a group and block pair in one partition, next to each other and in order."""
    by = [*keys, "lo", "hi"]
    return rows.repartition(*by).sortWithinPartitions(*by, *order)


def dealt(rows: DataFrame, keys: Sequence[str], spread: str, max_rows: int, *order: str,
          counted: DataFrame | None = None) -> DataFrame:
    """`rows` with (block, lo, hi), gathered by group and block pair.

    The rows of a group of more than `max_rows` are dealt into blocks by the column `spread`,
    and sent to every pair of blocks that theirs is part of; other groups stay together.
    `counted` holds the keys of the rows if those are cheaper to read than the rows.
    """
    counts = (rows if counted is None else counted).groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"))
    large = measure(counts.filter(F.col("entries") > max_rows).select(*[F.col(c).alias(f"_{c}") for c in keys], "entries"))
    zero = F.lit(0)
    if large.empty:
        return gathered(rows.withColumns({"block": zero, "lo": zero, "hi": zero}), keys, *order)
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = rows.join(large.frame(), same, "left")
    blocks = F.ceil(F.coalesce("entries", F.lit(1)) / F.lit(max_rows)).cast("int")
    joined = joined.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64(spread, F.lit(11)), blocks).cast("int")})
    pairs = block_pairs(F.col("block"), zero, F.col("blocks") - 1)
    out = joined.withColumn("pair", F.explode(pairs)).select(*rows.columns, "block", "pair.lo", "pair.hi")
    return gathered(out, keys, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups from a sorted stream, and the group number of their rows."""
    rest: pa.Table | None = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
        if rest is None or not rest.num_rows:
            continue
        keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in names], 1)
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        number = np.cumsum(new) - 1
        end = rest.num_rows if batch is None else int(np.flatnonzero(new)[-1])
        if end:
            yield rest.slice(0, end).combine_chunks(), number[:end]
            rest = rest.slice(end)
