"""Comparisons of actual with expected outputs.

Both sides are reduced per key by one aggregation with map-side partial results, so
repeated keys never multiply into pairs and null keys meet.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.operators.faults import FAULTY
from backtrail.plans.groups import keep_matching, measure, same_keys

EXTRA, MISSING, CHANGED, REPEATED = "extra", "missing", "changed", "repeated"


def _sides(actual: DataFrame, expected: DataFrame, cols: Sequence[str]) -> DataFrame:
    a = actual.select(*cols, F.lit(True).alias("__actual"))
    e = expected.select(*cols, F.lit(False).alias("__actual"))
    return a.unionByName(e)


def diff_inner(actual: DataFrame, expected: DataFrame, on: Sequence[str], value: str = "count") -> DataFrame:
    """Rows of `actual` that differ from an expected value of the same key.

    Keys missing on either side are not reported. Adds the column `expected`, one value
    that differs. The expected side comes down to its least and greatest value per key,
    which is enough to know whether some value differs.
    """
    v = F.col(value)
    bounds = expected.groupBy(*on).agg(
        F.min(v).alias("__lo"), F.max(v).alias("__hi"),
        (F.count(F.lit(1)) > F.count(v)).alias("__null"),
    ).select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], "__lo", "__hi", "__null")
    same = same_keys({c: f"__k{i}" for i, c in enumerate(on)})
    below, above = ~v.eqNullSafe(F.col("__lo")), ~v.eqNullSafe(F.col("__hi"))
    joined = actual.join(bounds, same)
    differing = joined.filter(below | above | (v.isNotNull() & F.col("__null")))
    other = F.when(below, F.col("__lo")).when(above, F.col("__hi"))
    return differing.select(*actual.columns, other.alias("expected"))


def _bounds(value: Sequence[str], side: Column, name: str) -> tuple[list[Column], list[str]]:
    """Aggregates that tell one side's values of a key, and their names.

    A single value column is kept as it is, which leaves the aggregation hashed; several
    are compared together as a struct.
    """
    if not value:
        return [], []
    v = F.col(value[0]) if len(value) == 1 else F.struct(*value)
    mine = F.when(side, v)
    names = [f"{name}_lo", f"{name}_hi", f"{name}_set"]
    found = [F.min(mine), F.max(mine), F.count(mine)]
    return [f.alias(n) for f, n in zip(found, names)], names


def diff_full(actual: DataFrame, expected: DataFrame, on: Sequence[str],
              value: Sequence[str] = (), mode: str = "exact", direction: str = "both",
              by: Sequence[str] = ()) -> DataFrame:
    """Keys or rows that differ, with `status` extra, missing or changed.

    exact: one row per key, the values must be equal; gives `by`, `on`, `status`.
    set:   whole rows by presence; gives `by`, `on`, `value`, `status`.
    bag:   whole rows by number of copies; adds `n_actual` and `n_expected`.
    `direction='actual'` leaves out what only the expected side has, and the other way
    round.
    """
    keys = [*by, *on]
    if mode == "exact":
        both = _sides(actual, expected, [*keys, *value])
        is_actual = F.col("__actual")
        mine, my_names = _bounds(value, is_actual, "__a")
        theirs, their_names = _bounds(value, ~is_actual, "__e")
        seen = both.groupBy(*keys).agg(
            F.count(F.when(is_actual, 1)).alias("n_actual"),
            F.count(F.when(~is_actual, 1)).alias("n_expected"),
            *mine, *theirs,
        )
        equal = (F.col("n_actual") == F.col("n_expected")) & same_keys(dict(zip(my_names, their_names)))
        shown = [*keys]
    elif mode in ("set", "bag"):
        both = _sides(actual, expected, [*keys, *value])
        shown = [*keys, *value]
        seen = both.groupBy(*shown).agg(
            F.count(F.when(F.col("__actual"), 1)).alias("n_actual"),
            F.count(F.when(~F.col("__actual"), 1)).alias("n_expected"),
        )
        equal = (F.col("n_actual") > 0) & (F.col("n_expected") > 0)
        if mode == "bag":
            equal = F.col("n_actual") == F.col("n_expected")
            shown_counts = ["n_actual", "n_expected"]
    else:
        raise ValueError(f"mode: {mode}")
    status = (
        F.when(equal, F.lit(None).cast("string"))
        .when(F.col("n_expected") == 0, EXTRA)
        .when(F.col("n_actual") == 0, MISSING)
        .otherwise(CHANGED)
    )
    differing = seen.withColumn("status", status).filter(F.col("status").isNotNull())
    if direction == "actual":
        differing = differing.filter(F.col("status") != MISSING)
    elif direction == "expected":
        differing = differing.filter(F.col("status") != EXTRA)
    extra = shown_counts if mode == "bag" else []
    return differing.select(*shown, *extra, "status")


def diff_lists(actual: DataFrame, expected: DataFrame, on: Sequence[str], item: str,
               by: Sequence[str] = ()) -> DataFrame:
    """Items of key -> list outputs, one row per item, that do not match one to one.

    An item repeated under a key fails even when both sides repeat it. One aggregation
    tells all of it.
    """
    shown = [*by, *on, item]
    counts = _sides(actual, expected, shown).groupBy(*shown).agg(
        F.count(F.when(F.col("__actual"), 1)).alias("__a"), F.count(F.when(~F.col("__actual"), 1)).alias("__e"))
    status = (
        F.when(F.col("__e") == 0, EXTRA)
        .when(F.col("__a") == 0, MISSING)
        .when(F.col("__a") != F.col("__e"), CHANGED)
        .when(F.col("__a") > 1, REPEATED)
    )
    return counts.select(*shown, status.alias("status")).filter(F.col("status").isNotNull())


def diff_adjacency(actual: DataFrame, expected: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Vertices of `actual` whose neighbour sets differ from the expected ones.

    A vertex's lists are compared as a whole, however they are cut into segments on either
    side. The items' hashes are added up, those of the expected side with the other sign, so
    equal lists come to nothing; sums of halves of hashes cannot overflow. Items are looked at
    only for vertices whose sums differ, where a repeated neighbour alone makes no difference.
    A null list is an empty one.
    """
    keys, lists = [*by, "vertex"], ("from", "to")
    both = _sides(actual, expected, [*keys, *lists])
    ends = F.array(*[F.struct(F.lit(c).alias("side"), F.coalesce(
        F.col(c), F.array().cast("array<string>")).alias("items")) for c in lists])
    split = both.select(*keys, "__actual", F.explode(ends).alias("end"))
    hashed = split.select(*keys, "__actual", "end.side", F.posexplode_outer("end.items").alias("at", "item")).select(
        *keys, "__actual", "at", *[F.xxhash64(F.lit(salt), "side", "item").alias(f"__h{salt}") for salt in (1, 2)])
    counted = F.when(F.col("at").isNull(), 0).when(F.col("__actual"), 1).otherwise(-1).cast("bigint")
    sums = {"__n": F.lit(1)}
    for salt in (1, 2):
        sums[f"__lo{salt}"] = F.col(f"__h{salt}").bitwiseAND(F.lit(0xFFFFFFFF))
        sums[f"__hi{salt}"] = F.shiftright(f"__h{salt}", 32)
    seen = hashed.groupBy(*keys).agg(
        F.count(F.when(F.col("__actual"), 1)).alias("__rows"), F.count(F.when(~F.col("__actual"), 1)).alias("__theirs"),
        *[F.sum(counted * part).alias(name) for name, part in sums.items()])
    differ = F.lit(False)
    for name in sums:
        differ = differ | (F.col(name) != 0)
    seen = seen.filter((F.col("__rows") > 0) & ((F.col("__theirs") == 0) | differ))
    suspects = measure(seen.select(*keys, (F.col("__theirs") == 0).alias("__extra")))
    extra = suspects.rows.filter("__extra").select(*keys, F.lit(EXTRA).alias("status"))
    items = keep_matching(split, suspects.rows.filter(~F.col("__extra")).select(*keys), keys)
    items = items.select(*keys, "__actual", "end.side", F.explode("end.items").alias("item"))
    told = items.groupBy(*keys, "side", "item").agg(
        F.bool_or("__actual").alias("a"), F.bool_or(~F.col("__actual")).alias("e")).filter(~(F.col("a") & F.col("e")))
    return extra.unionByName(told.select(*keys).distinct().withColumn("status", F.lit(CHANGED)))


def any_faulty(marked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., failed): whether some output row of a group is marked."""
    return marked.groupBy(*by).agg(F.coalesce(F.bool_or(FAULTY), F.lit(False)).alias("failed"))
