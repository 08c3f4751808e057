"""Plans that stay safe when one key holds a large share of the rows.

A group is gathered into one array only when its size is known to be bounded. Larger
groups are sorted across the cluster by range, numbered, and cut into segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.session import durable, stored

SMALL_ROWS = 1_000_000          # a broadcast side stays within both limits
SMALL_BYTES = 64 * 1024 * 1024
MAX_GROUP = 200_000
TASK_CHARS = 4_000_000          # text whose words or phrases one task counts
TASK_ROWS = 1_000_000           # rows that one task gathers
BUCKETS = 65_536                # hash values by which groups are first measured


@dataclass(frozen=True)
class KeySet:
    """Rows computed once into the checkpoint folder, and whether they may be broadcast."""

    rows: DataFrame
    small: bool
    empty: bool

    def frame(self, names: dict[str, str] | None = None) -> DataFrame:
        """The rows, under other names if given, hinted for broadcast when small."""
        df = self.rows
        if names is not None:
            df = df.select(*[F.col(old).alias(new) for old, new in names.items()])
        return F.broadcast(df) if self.small else df


def measure(df: DataFrame) -> KeySet:
    """Compute the rows once, and count them and their bytes where they were written.

    Nothing but the two totals reaches the driver.
    """
    rows = durable(df)
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields), F.lit(0))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes")).first()
    small = total["n"] <= SMALL_ROWS and (total["bytes"] or 0) <= SMALL_BYTES
    return KeySet(rows, small, total["n"] == 0)


def _width(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes: those of its texts, and eight for anything else."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 8
    if isinstance(kind, T.StructType):
        return sum((_width(value[f.name], f.dataType) for f in kind.fields), F.lit(8))
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0)) + 8
    return F.lit(8)


def same_keys(pairs: dict[str, str]) -> Column:
    """Null-safe equality of each pair of columns."""
    same = F.lit(True)
    for left, right in pairs.items():
        same = same & F.col(left).eqNullSafe(F.col(right))
    return same


def keep_matching(df: DataFrame, keys: DataFrame | KeySet, on: Sequence[str],
                  anti: bool = False) -> DataFrame:
    """Rows of `df` whose `on` columns are among `keys`; nulls match nulls.

    A key set measured small is broadcast. Otherwise the join shuffles, and adaptive
    execution splits partitions that one key makes too large.
    """
    if isinstance(keys, DataFrame):
        keys = measure(keys.select(*on))
    names = {c: f"__k{i}" for i, c in enumerate(on)}
    return df.join(keys.frame(names), same_keys(names), "left_anti" if anti else "left_semi")


def frequent_keys(df: DataFrame, on: Sequence[str]) -> KeySet | None:
    """The most frequent keys of the rows, as many as may be broadcast; None if they are
    those of less than half of the rows.

    Keys are taken by powers of two of their counts, so one row for each power is looked at.
    """
    sizes = durable(df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")))
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in sizes.schema.fields), F.lit(0))
    power = F.floor(F.log2("__n")).cast("int")
    powers = sizes.groupBy(power.alias("power")).agg(
        F.count(F.lit(1)).alias("keys"), F.sum("__n").alias("rows"), F.sum(width).alias("bytes")).collect()
    keys = covered = size = 0
    least = None
    for p in sorted(powers, key=lambda r: -r["power"]):
        keys, size = keys + p["keys"], size + p["bytes"]
        if keys > SMALL_ROWS or size > SMALL_BYTES:
            break
        covered, least = covered + p["rows"], 1 << p["power"]
    if least is None or 2 * covered < sum(p["rows"] for p in powers):
        return None
    return KeySet(sizes.filter(F.col("__n") >= least).select(*on), True, False)


def meeting(df: DataFrame, keys: KeySet, on: Sequence[str], some: DataFrame) -> list[tuple[DataFrame, KeySet]]:
    """Pairs of rows and keys, so that a row meets a key in one pair at most, and in the pairs
    together it meets all it meets in `keys`.

    Of a key set too large for a broadcast the keys that most rows hold are taken out and
    broadcast, so that only the rows of other keys have to be exchanged. `some` are some of
    the rows, by which it is guessed which keys are frequent; the result does not depend on it.
    """
    common = None if keys.small else frequent_keys(some, on)
    if common is None:
        return [(df, keys)]
    chosen = measure(keep_matching(keys.rows, common, on))
    if not chosen.small:
        return [(df, keys)]
    others = measure(keep_matching(keys.rows, common, on, anti=True))
    pairs = [(df, chosen), (keep_matching(df, common, on, anti=True), others)]
    return [(rows, held) for rows, held in pairs if not held.empty] or [(df, keys)]


def large_groups(df: DataFrame, keys: Sequence[str], max_group: int,
                 weight: str | None = None) -> DataFrame:
    """The keys of groups with more than `max_group` rows (map-side partial counts)."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    sizes = df.groupBy(*keys).agg(size.alias("__n"))
    return sizes.filter(F.col("__n") > max_group).select(*keys)


def suspects(df: DataFrame, keys: Sequence[str], max_group: int,
             weight: str | None = None) -> tuple[DataFrame | None, DataFrame, int]:
    """(rows of the groups that may exceed `max_group`, or None, the others, and how many all are).

    Rows are counted by a hash of their key in BUCKETS values, which takes map-side partial
    counts only. A group is no larger than its bucket.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    weights = [] if weight is None else [weight]
    sizes = df.select(bucket.alias("__bucket"), *weights).groupBy("__bucket").agg(
        F.count(F.lit(1)).alias("__rows"), size.alias("__n"))
    full = F.when(F.col("__n") > max_group, F.col("__bucket"))
    total = sizes.agg(F.sum("__rows").alias("n"), F.collect_list(full).alias("full")).first()  # BUCKETS numbers at most
    if not total["full"]:
        return None, df, total["n"] or 0
    held = df.sparkSession.createDataFrame([(b,) for b in total["full"]], "__b int")
    few, same = F.broadcast(held), bucket == F.col("__b")
    return df.join(few, same, "left_semi"), df.join(few, same, "left_anti"), total["n"]


def in_groups_of(df: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Rows of the groups that have `least` rows or more; of smaller groups, only a few by chance.

    Instead of the rows, four bytes of a hash of each key are exchanged. Hashes that come `least`
    times set two bits of a bitmap, which is broadcast in pieces, and rows whose bits are set
    stay. The bitmap has 64 MiB at most, and no more with larger inputs: the more bits are set,
    the more small groups stay.
    """
    def bits(value: Column, first: int, n: int) -> Column:
        return F.shiftright(value, first).bitwiseAND(F.lit((1 << n) - 1)).cast("int")

    # Of the hash, from the top: 14 bits for the piece, 9 for a word in it, twice 6 for a bit in that, and 11
    # more that are only compared. A list has the 32 bits behind those of its piece.
    h, rest = F.xxhash64(*keys), F.col("__rest")
    hashes = df.select(h.alias("__h")).select(
        bits(F.col("__h"), 50, 14).alias("__piece"), F.shiftright(F.shiftleft("__h", 14), 32).cast("int").alias("__rest"))
    lists = hashes.groupBy("__piece").agg(F.sort_array(F.collect_list("__rest")).alias("__rests"))
    often = F.filter("__rests", lambda x, i: x == F.get("__rests", i + (least - 1)))

    def at(bit: Column) -> Column:
        """A bit's place: the first byte of a binary is the highest of a word, its bits count from the lowest."""
        return (bits(rest, 23, 9) * 64 + F.lit(56) - F.shiftright(bit, 3) * 8 + bit.bitwiseAND(F.lit(7))).cast("bigint")

    places = F.explode(F.array(at(bits(rest, 17, 6)), at(bits(rest, 11, 6)))).alias("__at")
    pieces = lists.select("__piece", F.explode(often).alias("__rest")).select("__piece", places).groupBy("__piece").agg(
        F.bitmap_construct_agg("__at").alias("__bits"))
    words = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.conv(
        F.hex(F.substring("__bits", i * 8 + 1, F.lit(8))), 16, -10).cast("bigint"))
    # With an exchange of their own, which one by the same column would not be, the pieces are
    # made before the time for a broadcast starts.
    bitmap = pieces.select("__piece", words.alias("__words")).repartition(F.shiftright("__piece", 4))
    word = F.get("__words", bits(h, 41, 9))
    are_set = (F.getbit(word, bits(h, 35, 6)) == 1) & (F.getbit(word, bits(h, 29, 6)) == 1)
    return df.join(F.broadcast(bitmap), (bits(h, 50, 14) == F.col("__piece")) & are_set, "left_semi")


def spread_tasks(df: DataFrame, size: int, task: int) -> int:
    """How many partitions hold `size` in shares of `task`, at least one for every core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-size // task))


def by_unit(df: DataFrame, unit: Sequence[str], text: str,
            most: int = TASK_CHARS) -> tuple[DataFrame, DataFrame | None]:
    """Rows with all of a unit in one partition, and those of units too large for that.

    What is made of the text can then be grouped by the unit and more without another
    exchange. A unit with more than `most` characters stays where it is, in the second frame.
    """
    sizes = df.groupBy(*unit).agg(F.sum(F.length(text)).alias("__n"))
    ends = sizes.agg(F.sum("__n").alias("all"), F.max("__n").alias("most")).first()
    parts = spread_tasks(df, ends["all"] or 0, TASK_CHARS)
    if (ends["most"] or 0) <= most:
        return df.repartition(parts, *unit), None
    large = measure(sizes.filter(F.col("__n") > most).select(*unit))
    rest = keep_matching(df, large, unit, anti=True)
    return rest.repartition(parts, *unit), keep_matching(df, large, unit)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                name: str = "__rn", weight: str | None = None) -> DataFrame:
    """Row numbers from 1 within each key, in the given order, without gathering a key.

    Rows are range-partitioned by key and order, so a large key spreads over partitions.
    A row's number is its place in its partition plus the key's rows in the partitions
    before. Those counts are one row per key and partition. With `weight` a row counts
    that many times, and its number is that of its first copy.
    """
    cols = [*keys, *order]
    placed = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = durable(placed).withColumn("__part", F.shiftright("__at", 33))
    each = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    runs = placed.groupBy(*keys, "__part").agg(
        F.min("__at").alias("__first"), F.sum(each).alias("__n")
    )
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    runs = runs.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__part").alias("__p"),
        "__first",
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
    )
    same = (F.col("__part") == F.col("__p")) & same_keys({k: f"__k{i}" for i, k in enumerate(keys)})
    joined = placed.join(measure(runs).frame(), same)
    if weight is None:
        inside = F.col("__at") - F.col("__first")
    else:
        ahead = Window.partitionBy(*keys, "__part").orderBy("__at").rowsBetween(
            Window.unboundedPreceding, -1
        )
        inside = F.coalesce(F.sum(weight).over(ahead), F.lit(0))
    number = F.col("__before") + inside + 1
    return joined.select(*df.columns, number.cast("bigint").alias(name))


def gather(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str,
           item: Callable[[Column], Column] | None = None, carry: Sequence[str] = (),
           max_group: int | None = MAX_GROUP, weight: str | None = None) -> DataFrame:
    """One sorted array per key and segment: `keys`, `segment`, `out`.

    `order` columns must order the rows of a key totally. An array item is the one order
    column, or the struct of `order` and `carry` columns, or what `item` makes of it. A
    key with up to `max_group` rows gives segment 0 only; a larger one gives consecutive
    segments of `max_group` items each, and no item is lost. With `weight` an item counts
    that many times, at most `max_group`, towards the size of a segment. `max_group=None`
    is for groups known to be bounded.

    The rows are made twice: once to measure the groups, by partial counts of a hash of the
    key, and once for the arrays, which take one exchange. Only rows that may belong to a
    large group are written: they are read to measure the groups, which takes the key columns
    only, and again for the small and the large groups.
    """
    fields = [*order, *carry]
    entry = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)

    def arrays(rows: DataFrame, by: Sequence[str]) -> DataFrame:
        packed = rows.groupBy(*by).agg(F.sort_array(F.collect_list(entry)).alias("__all"))
        items = F.col("__all") if item is None else F.transform("__all", item)
        return packed.select(*by, items.alias(out))

    def whole(rows: DataFrame) -> DataFrame:
        return arrays(rows, keys).select(*keys, F.lit(0).cast("bigint").alias("segment"), out)

    if max_group is None:
        return whole(df)
    needed = [*keys, *fields, *([] if weight is None else [weight])]
    full, others, total = suspects(df.select(*dict.fromkeys(needed)), keys, max_group, weight)
    small = whole(others.repartition(spread_tasks(df, total, TASK_ROWS), *keys))
    if full is None:
        return small
    df = stored(full, "groups")
    large = measure(large_groups(df, keys, max_group, weight))
    if large.empty:
        return small.unionByName(whole(df))
    small = small.unionByName(whole(keep_matching(df, large, keys, anti=True)))
    hot = keep_matching(df, large, keys)
    return small.unionByName(in_segments(hot, keys, order, out, max_group, item, carry, weight))


def in_segments(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, max_group: int,
                item: Callable[[Column], Column] | None = None, carry: Sequence[str] = (),
                weight: str | None = None) -> DataFrame:
    """Arrays of `max_group` items each, as `gather` makes of large groups."""
    fields = [*order, *carry]
    entry = F.col(fields[0]) if len(fields) == 1 else F.struct(*fields)
    segment = F.floor((F.col("__rn") - 1) / F.lit(max_group)).cast("bigint")
    numbered = number_rows(df, keys, order, weight=weight).withColumn("segment", segment)
    packed = numbered.groupBy(*keys, "segment").agg(F.sort_array(F.collect_list(entry)).alias("__all"))
    items = F.col("__all") if item is None else F.transform("__all", item)
    return packed.select(*keys, "segment", items.alias(out))


def expand_copies(counted: DataFrame, copies: str, number: str | None = None,
                  run: int = 100_000) -> DataFrame:
    """Each row as many times as its `copies` column says, without that column.

    Rows with more than `run` copies are cut into runs that are shuffled before they are
    written out, so that the copies of one row do not all come from one task. `number`
    names a column for the copy's number from 1.
    """
    others = [c for c in counted.columns if c != copies]
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")

    def written(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        numbers = F.explode(F.sequence(first, last)).alias(number or "__copy")
        return rows.select(*others, numbers)

    few = counted.filter(F.col(copies).between(1, run))
    last_run = F.floor((F.col(copies) - 1) / F.lit(run)).cast("bigint")
    many = counted.filter(F.col(copies) > run)
    runs = many.withColumn("__run", F.explode(F.sequence(zero, last_run)))
    # A fixed number of partitions: merged by their bytes they would grow too many copies.
    partitions = int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = runs.repartition(partitions, *others, "__run")
    start = F.col("__run") * run
    rows = written(few, one, F.col(copies)).unionByName(
        written(runs, start + 1, F.least(start + run, F.col(copies)))
    )
    return rows if number else rows.drop("__copy")
