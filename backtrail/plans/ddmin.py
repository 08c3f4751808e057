"""Delta debugging: reduce failing inputs to minimal failing sets.

Candidates are numbered once in a total order and written to the shared folder. From then
on a set of candidates is a table and at most MAX_RANGES ranges of its numbers; a set that
falls into more pieces is written out and numbered anew. Parts are arithmetic on those
ranges and complements are made one wave at a time, so plans do not grow, scans of small
sets skip row groups, and what the driver holds does not depend on how many candidates
there are or how many of them a failure needs: one wave of sets, a bounded cache of
outcomes, and bounded ends of the lists of branches, solutions and log entries, which go on
in the shared folder.

A test is given many sets at once: every row carries the trials it belongs to, and the
program under test groups by `__trial`. Only (trial, failed) rows come back, one wave of
them. A round that splits into n parts takes one job for every PART_WAVE parts, and one for
every COPY_WAVE complements if no part fails. Sets of later rounds are tested along. In a search
for one set they are only while JOB_ROWS rows hold all sets of a job, since beyond that a test
costs more than a job; and of a larger set the second half waits for the outcome of the first.
A search for a set of k needed rows among N
takes some log2(N) rounds for k = 1, and for more about k * log2(N / k) rounds of up to 2k
parts. An exhaustive search tests all parts of up to BRANCH_WAVE branches together, EVERY_WAVE
in a job, so k faults of one row take some log2(N) * k / BRANCH_WAVE rounds.
"""

from __future__ import annotations

import time
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.operators.checks import any_faulty, diff_full
from backtrail.operators.faults import mark
from backtrail.plans.groups import measure, number_rows
from backtrail.session import scratch_path, stored

TRIAL, RANK, PLACE = "__trial", "__rank", "__place"
PART_WAVE = 256       # disjoint parts tested in one job
COPY_WAVE = 32        # overlapping sets tested in one job
EVERY_WAVE = 8192     # parts tested in one job where all of them are wanted
PIECES = 65536        # ranges that are told apart in one job
BRANCH_WAVE = 4096    # branches that an exhaustive round follows together
TABLES = 64           # tables of candidates that one job reads
TREE = 512            # interval ends up to which places are looked up by an expression
RIDE = 8              # parts of a split up to which its complements are tested along with them
JOB_ROWS = 500_000    # rows up to which a search for one set tests more than the next step needs
MAX_RANGES = 64       # pieces of a set before it is numbered anew
MEMORY = 4096         # entries of a list that stay on the driver

Ranges = tuple[tuple[int, int], ...]


# --- sets of candidates -------------------------------------------------------------

def size_of(ranges: Ranges) -> int:
    return sum(hi - lo for lo, hi in ranges)


def _slice(ranges: Ranges, start: int, stop: int) -> Ranges:
    """The members from position `start` up to `stop`."""
    cut, passed = [], 0
    for lo, hi in ranges:
        a, b = max(lo, lo + start - passed), min(hi, lo + stop - passed)
        if a < b:
            cut.append((a, b))
        passed += hi - lo
    return tuple(cut)


def part_of(ranges: Ranges, n: int, i: int) -> Ranges:
    """Part i of `n` consecutive parts, equal in size to within one."""
    total = size_of(ranges)
    return _slice(ranges, i * total // n, (i + 1) * total // n)


def without(ranges: Ranges, part: Ranges) -> Ranges:
    left = []
    for lo, hi in ranges:
        for a, b in part:
            if b <= lo or a >= hi:
                continue
            if lo < a:
                left.append((lo, a))
            lo = b
        if lo < hi:
            left.append((lo, hi))
    return tuple(left)


@dataclass(frozen=True)
class Set:
    """Rows of a table whose places lie in the ranges, and how many they are."""

    table: int
    ranges: Ranges
    size: int

    def without(self, part: Set) -> Set:
        return Set(self.table, without(self.ranges, part.ranges), self.size - part.size)


@dataclass(frozen=True)
class Parts:
    """The parts of a set, numbered below `n`: `wave(a, b, width)` gives the first `width`
    of the non-empty ones numbered a to b-1. `few` says that there are two at most, `single`
    that all are one row.
    """

    whole: Set
    n: int
    few: bool
    single: bool
    wave: Callable[[int, int, int], list[tuple[int, Set]]]

    def waves(self, width: int, start: int = 0) -> Iterator[list[tuple[int, Set]]]:
        """All non-empty parts, from number `start` round."""
        for a, b in ((start, self.n), (0, start)):
            while a < b and (wave := self.wave(a, b, width)):
                yield wave
                a = wave[-1][0] + 1


# --- trials as rows -----------------------------------------------------------------

def _lookup(bounds: Sequence[int], values: Sequence[str]) -> str:
    """SQL for the value of the interval that holds the place: a balanced tree of ifs."""
    if len(values) == 1:
        return values[0]
    mid = len(values) // 2
    below = _lookup(bounds[: mid - 1], values[:mid])
    above = _lookup(bounds[mid:], values[mid:])
    return f"if({PLACE} < {bounds[mid - 1]}L, {below}, {above})"


def _in_bins(rows: DataFrame, pieces: DataFrame, width: int) -> DataFrame:
    """Rows once for every piece (`__lo` to `__hi`) that holds their place, with its other
    columns. Both sides meet in bins of `width` places."""
    bins = F.explode(F.sequence(F.expr(f"__lo div {width}L"), F.expr(f"(__hi - 1L) div {width}L")))
    met = rows.withColumn("__bin", F.expr(f"{PLACE} div {width}L")).join(
        pieces.withColumn("__bin", bins), "__bin")
    return met.filter((F.col(PLACE) >= F.col("__lo")) & (F.col(PLACE) < F.col("__hi"))).drop("__bin", "__lo", "__hi")


def with_trials(rows: DataFrame, trials: dict[int, Ranges]) -> DataFrame:
    """Rows with `__trial`, one per trial that holds them.

    Few intervals are looked up by an expression; many are a table that is broadcast.
    """
    cuts = sorted({edge for ranges in trials.values() for pair in ranges for edge in pair})
    if len(cuts) > TREE:
        held = [(lo, hi, t) for t, ranges in trials.items() for lo, hi in ranges]
        pieces = rows.sparkSession.createDataFrame(held, f"__lo long, __hi long, {TRIAL} int")
        width = max(1, sum(hi - lo for lo, hi, _ in held) // len(held))
        inside = (F.col(PLACE) >= cuts[0]) & (F.col(PLACE) < cuts[-1])
        return _in_bins(rows.filter(inside), F.broadcast(pieces), width)
    member: list[list[int]] = [[] for _ in range(len(cuts) - 1)]
    for trial, ranges in trials.items():
        for lo, hi in ranges:
            for i in range(bisect_right(cuts, lo) - 1, bisect_right(cuts, hi) - 1):
                member[i].append(trial)
    leaves = [f"array({','.join(map(str, m))})" if m else "cast(array() AS array<int>)" for m in member]
    inside = (F.col(PLACE) >= cuts[0]) & (F.col(PLACE) < cuts[-1])
    found = F.expr(_lookup(cuts[1:-1], leaves))
    return rows.filter(inside).withColumn(TRIAL, F.explode(found))


class Sets:
    """Tables of candidates with places, and the parts of their sets.

    Table 0 holds all candidates in their order; parts are runs of that order.
    """

    @property
    def branches(self) -> int:
        """How many branches a round follows together."""
        return BRANCH_WAVE

    def __init__(self, candidates: DataFrame):
        self.tables = [candidates.withColumn(PLACE, F.col(RANK))]
        self.total = candidates.count()
        self.whole = Set(0, ((0, self.total),) if self.total else (), self.total)

    def rows(self, one: Set) -> DataFrame:
        """The set's candidates, with rank and place."""
        if not one.size:
            return self.tables[one.table].filter("false")
        return with_trials(self.tables[one.table], {0: one.ranges}).drop(TRIAL)

    def keep(self, rows: DataFrame) -> int:
        """Write rows with their places as a new table."""
        self.tables.append(stored(rows, "subset"))
        return len(self.tables) - 1

    def compact(self, one: Set) -> Set:
        """The same set in MAX_RANGES pieces at most."""
        if len(one.ranges) <= MAX_RANGES:
            return one
        lows = [lo for lo, _ in one.ranges]
        moved, passed = [], 0
        for lo, hi in one.ranges:
            moved.append(f"{PLACE} - {lo - passed}L")
            passed += hi - lo
        rows = self.rows(one).withColumn(PLACE, F.expr(_lookup(lows[1:], moved)))
        return Set(self.keep(rows.sortWithinPartitions(PLACE)), ((0, one.size),), one.size)

    def parts(self, one: Set, n: int) -> Parts:
        n = min(n, one.size)

        def wave(a: int, b: int, width: int) -> list[tuple[int, Set]]:
            pieces = ((i, part_of(one.ranges, n, i)) for i in range(a, min(b, a + width)))
            return [(i, Set(one.table, r, size_of(r))) for i, r in pieces]

        return Parts(one, n, n <= 2, n == one.size, wave)

    def finest(self, one: Set) -> int:
        """The number of parts beyond which splitting tells nothing new."""
        return one.size

    def assign(self, trials: dict[int, Set]) -> DataFrame:
        by_table: dict[int, dict[int, Ranges]] = {}
        for t, one in trials.items():
            by_table.setdefault(one.table, {})[t] = one.ranges
        frames = [with_trials(self.tables[i], held) for i, held in by_table.items()]
        out = frames[0]
        for frame in frames[1:]:
            out = out.unionByName(frame)
        return out.drop(RANK, PLACE)


class SplitSets(Sets):
    """Sets under the caller's own split: `split(n)` is a column that numbers the parts
    0 to n-1.

    A set that is split is written with its part numbers as places, so that parts are ranges
    again and no condition outlives its round. Rows that the split never tells apart stay
    together in the result.
    """

    def __init__(self, candidates: DataFrame, split: Callable[[int], Column]):
        super().__init__(candidates)
        self.split = split

    @property
    def branches(self) -> int:
        return min(BRANCH_WAVE, TABLES)  # every set that is split is a table

    def compact(self, one: Set) -> Set:
        if len(one.ranges) <= MAX_RANGES:
            return one
        return Set(self.keep(self.rows(one)), ((one.ranges[0][0], one.ranges[-1][1]),), one.size)

    def parts(self, one: Set, n: int) -> Parts:
        part = F.coalesce(self.split(n).cast("bigint"), F.lit(0))
        table = self.keep(self.rows(one).withColumn(PLACE, part))
        counts = self.tables[table].groupBy(PLACE).agg(F.count(F.lit(1)).alias("n"))

        def first(rows: DataFrame, width: int) -> list[tuple[int, Set]]:
            found = rows.orderBy(PLACE).limit(width).collect()
            return [(r[PLACE], Set(table, ((r[PLACE], r[PLACE] + 1),), r["n"])) for r in found]

        held = first(counts, MEMORY + 1)
        if len(held) > MEMORY:
            counts = stored(counts, "parts")

        def wave(a: int, b: int, width: int) -> list[tuple[int, Set]]:
            if len(held) > MEMORY:  # read in turn
                return first(counts.filter((F.col(PLACE) >= a) & (F.col(PLACE) < b)), width)
            lo = bisect_left(held, a, key=lambda p: p[0])
            return [p for p in held[lo:lo + width] if p[0] < b]

        single = len(held) == one.size or len(held) > MEMORY and counts.filter("n > 1").isEmpty()
        return Parts(Set(table, ((0, n),), one.size), n, len(held) <= 2, single, wave)

    def finest(self, one: Set) -> int:
        return self.total


# --- tests --------------------------------------------------------------------------

class BatchTest:
    """A test of many sets in one job.

    `fn` maps rows with `__trial` to (`__trial`, failed). A trial it gives no row for has
    passed, unless `fails_when_silent` says that no output is a failure.
    """

    def __init__(self, fn: Callable[[DataFrame], DataFrame], fails_when_silent: bool = False):
        self.fn, self.fails_when_silent = fn, fails_when_silent

    def outcomes(self, sets: Sets, trials: dict[int, Set]) -> dict[int, bool]:
        rows = self.fn(sets.assign(trials)).select(TRIAL, "failed").collect()
        told = {r[TRIAL]: bool(r["failed"]) for r in rows}
        return {t: told.get(t, self.fails_when_silent) for t in trials}


class SingleTest:
    """A test of one set: a function from its rows to true when it fails."""

    def __init__(self, fn: Callable[[DataFrame], bool]):
        self.fn = fn

    def outcomes(self, sets: Sets, trials: dict[int, Set]) -> dict[int, bool]:
        return {t: bool(self.fn(sets.assign({t: one}).drop(TRIAL))) for t, one in trials.items()}


Program = Callable[[DataFrame, Sequence[str]], DataFrame]


def predicate_test(program: Program, predicate: Column) -> BatchTest:
    """Fails when some output of `program(rows, by)` satisfies the predicate."""
    return BatchTest(lambda rows: any_faulty(mark(program(rows, [TRIAL]), predicate), [TRIAL]))


def truth_test(program: Program, truth: Program, on: Sequence[str],
               value: Sequence[str] = ("count",), direction: str = "both") -> BatchTest:
    """Fails when `program` and `truth` differ on the same rows."""

    def fn(rows: DataFrame) -> DataFrame:
        differing = diff_full(
            program(rows, [TRIAL]), truth(rows, [TRIAL]), on, value, direction=direction, by=[TRIAL]
        )
        return differing.groupBy(TRIAL).agg(F.lit(True).alias("failed"))

    return BatchTest(fn)


# --- what outgrows the driver --------------------------------------------------------

class Log:
    """Rows in the order they were added. Older ones go to a table in the shared folder."""

    def __init__(self, spark, schema: T.StructType, label: str):
        self.spark, self.schema = spark, schema
        self.path = scratch_path(spark, label)
        self.rows: list[tuple] = []
        self.written = False

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        if len(self.rows) >= MEMORY:
            self.spark.createDataFrame(self.rows, self.schema).write.mode("append").parquet(self.path)
            self.rows, self.written = [], True

    def frame(self) -> DataFrame:
        held = self.spark.createDataFrame(self.rows, self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path).unionByName(held) if self.written else held


@dataclass(frozen=True)
class Branch:
    """One failing set, how finely to split it, and where to start with complements."""

    one: Set
    parts: int = 2
    offset: int = 0


_BRANCH = T.StructType([
    T.StructField("table", T.IntegerType()),
    T.StructField("ranges", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("size", T.LongType()), T.StructField("parts", T.LongType()),
    T.StructField("offset", T.LongType()),
])


class Pending:
    """Branches still to follow, first come first; those in the middle wait in tables."""

    def __init__(self, spark):
        self.spark = spark
        self.front: list[Branch] = []
        self.back: list[Branch] = []
        self.blocks: list[str] = []

    def __bool__(self) -> bool:
        return bool(self.front or self.back or self.blocks)

    def add(self, b: Branch) -> None:
        self.back.append(b)
        if len(self.back) >= MEMORY:
            path = scratch_path(self.spark, "branches")
            rows = [(b.one.table, [list(r) for r in b.one.ranges], b.one.size, b.parts, b.offset) for b in self.back]
            self.spark.createDataFrame(rows, _BRANCH).coalesce(1).write.parquet(path)
            self.blocks.append(path)
            self.back = []

    def take(self, n: int) -> list[Branch]:
        if not self.front and self.blocks:
            rows = self.spark.read.schema(_BRANCH).parquet(self.blocks.pop(0)).collect()  # MEMORY rows
            self.front = [Branch(Set(r["table"], tuple(map(tuple, r["ranges"])), r["size"]), r["parts"], r["offset"])
                          for r in rows]
        if not self.front:
            self.front, self.back = self.back, []
        taken, self.front = self.front[:n], self.front[n:]
        return taken


_PIECE = "of string, __lo long, __hi long"


class Solutions:
    """Minimal sets. Few are kept as ranges of the candidates' order; others as tables.

    Ranges of the candidates' order go to tables of ranges, MEMORY sets at a time; the rows of
    sets in other tables are written, those of TABLES sets at a time.
    """

    def __init__(self, sets: Sets):
        self.sets, self.held, self.n = sets, OrderedDict(), 0
        self.moved: list[Set] = []
        self.paths: list[str] = []
        self.blocks: list[str] = []
        self.covered = self.pieces = 0

    def add(self, one: Set) -> None:
        if one.table == 0:
            self.held[one] = None
            if len(self.held) > MEMORY:
                self._flush_ranges()
        else:
            self.moved.append(one)
            if len(self.moved) >= TABLES:
                self._flush_rows()

    def _name(self) -> str:
        self.n += 1
        return str(self.n)

    def _flush_ranges(self) -> None:
        spark = self.sets.tables[0].sparkSession
        rows = [(name, lo, hi) for s in self.held for name in [self._name()] for lo, hi in s.ranges]
        path = scratch_path(spark, "solutions")
        spark.createDataFrame(rows, _PIECE).coalesce(1).write.parquet(path)
        self.blocks.append(path)
        self.covered, self.pieces = self.covered + sum(s.size for s in self.held), self.pieces + len(rows)
        self.held = OrderedDict()

    def _flush_rows(self) -> None:
        path = scratch_path(self.sets.tables[0].sparkSession, "solution")
        frames = [self.sets.rows(one).select(F.lit(self._name()).alias("of"), RANK) for one in self.moved]
        reduce(DataFrame.unionByName, frames).write.parquet(path)
        self.paths.append(path)
        self.moved = []

    def rows(self) -> DataFrame:
        """The candidates of every solution, once each, numbered by their first members."""
        table = self.sets.tables[0]
        if not (self.held or self.moved or self.paths or self.blocks):
            return table.filter("false").withColumn("solution_id", F.lit(0)).drop(RANK, PLACE)
        if not (self.moved or self.paths or self.blocks):
            held = sorted(self.held, key=lambda s: (s.ranges, s.size))
            trials = {i: s.ranges for i, s in enumerate(held)}
            return with_trials(table, trials).withColumnRenamed(TRIAL, "solution_id").drop(RANK, PLACE)
        if self.held:
            self._flush_ranges()
        if self.moved:
            self._flush_rows()
        spark, found = table.sparkSession, []
        if self.paths:
            found.append(spark.read.parquet(*self.paths).select("of", RANK))
        if self.blocks:
            pieces = measure(spark.read.schema(_PIECE).parquet(*self.blocks)).frame()
            width = max(1, self.covered // self.pieces)
            found.append(_in_bins(table, pieces, width).select("of", RANK))
        found = reduce(DataFrame.unionByName, found)
        digest = [F.count(F.lit(1)).alias("size"), F.min(RANK).alias("first"),
                  F.sum(F.xxhash64(RANK).cast("decimal(38,0)")).alias("hash")]
        kept = found.groupBy("of").agg(*digest).groupBy("first", "size", "hash").agg(F.min("of").alias("chosen"))
        numbered = number_rows(kept, [], ["first", "size", "hash"], "solution_id")
        chosen = measure(numbered.select("chosen", (F.col("solution_id") - 1).cast("int").alias("solution_id")))
        ranks = found.join(chosen.frame(), F.col("of") == F.col("chosen")).select("solution_id", F.col(RANK).alias("__r"))
        return table.join(ranks, F.col(RANK) == F.col("__r")).drop("__r", RANK, PLACE)


# --- the search ---------------------------------------------------------------------

@dataclass
class Minimised:
    """Minimal failing sets and how they were found.

    `rows` has `solution_id` and the candidate columns; solutions are numbered by their
    first members. `complete` is false when `max_rounds` ended the search: `unfinished` then
    has the sets, in the same form, that fail but may not be minimal.
    """

    rows: DataFrame
    unfinished: DataFrame
    history: DataFrame
    rounds: int
    jobs: int
    complete: bool


_HISTORY = T.StructType([
    T.StructField("run", T.IntegerType()), T.StructField("size", T.LongType()),
    T.StructField("granularity", T.IntegerType()), T.StructField("kind", T.StringType()),
    T.StructField("index", T.IntegerType()), T.StructField("failed", T.BooleanType()),
    T.StructField("ms", T.LongType()),
])


def _chunks(items: Iterable, n: int) -> Iterator[list]:
    it = iter(items)
    while chunk := list(islice(it, n)):
        yield chunk


def _jobs(sets: Iterable[Set], n: int) -> Iterator[list[Set]]:
    """The sets, at most `n` of them, PIECES ranges and TABLES tables at a time."""
    chunk: list[Set] = []
    pieces, tables = 0, set()
    for one in sets:
        if chunk and (len(chunk) >= n or pieces + len(one.ranges) > PIECES or len(tables | {one.table}) > TABLES):
            yield chunk
            chunk, pieces, tables = [], 0, set()
        chunk.append(one)
        pieces += len(one.ranges)
        tables.add(one.table)
    if chunk:
        yield chunk


@dataclass
class _Search:
    sets: Sets
    test: BatchTest | SingleTest
    lookahead: int
    log: Log
    known: OrderedDict = field(default_factory=OrderedDict)
    split_up: OrderedDict = field(default_factory=OrderedDict)
    run: int = 0
    jobs: int = 0
    spent: int = 0

    def parts(self, one: Set, n: int) -> Parts:
        """The parts of a set, remembered for as long as a round takes."""
        if (one, n) not in self.split_up:
            self.split_up[one, n] = self.sets.parts(one, n)
            if len(self.split_up) > 2 * self.sets.branches:
                self.split_up.popitem(last=False)
        return self.split_up[one, n]

    def ask(self, wanted: Iterable[Set], wave: int) -> list[bool]:
        """Whether each set fails; those not tested yet are, `wave` per job. An empty set passes."""
        wanted = list(wanted)
        fresh = [s for s in dict.fromkeys(wanted) if s.size and s not in self.known]
        found: dict[Set, bool] = {s: self.known[s] for s in wanted if s in self.known}
        batched = isinstance(self.test, BatchTest)
        for batch in _jobs(fresh, wave):
            begun = time.monotonic()
            for t, failed in self.test.outcomes(self.sets, dict(enumerate(batch))).items():
                found[batch[t]] = self.known[batch[t]] = failed
            self.jobs += 1 if batched else len(batch)
            self.spent = int((time.monotonic() - begun) * 1000)
        while len(self.known) > MEMORY:
            self.known.popitem(last=False)
        return [found.get(s, False) for s in wanted]

    def note(self, branch: Branch, kind: str, index: int, one: Set, failed: bool) -> bool:
        """Log a test; true when the set fails and is smaller than its branch."""
        self.log.add((self.run, one.size, branch.parts, kind, index, failed, self.spent))
        return failed and one.size < branch.one.size

    def ahead(self, one: Set, depth: int) -> list[Set]:
        """Halves of halves that the next rounds would ask for if this set fails."""
        if depth == 0 or one.size < 2:
            return []
        halves = [p for _, p in self.sets.parts(one, 2).wave(0, 2, 2)]
        return halves + [s for h in halves for s in self.ahead(h, depth - 1)]

    def complements(self, b: Branch) -> Iterator[list[tuple[int, Set]]]:
        """Waves of (part number, complement) from the branch's offset round; halves need none."""
        parts = self.parts(b.one, b.parts)
        if not parts.few:
            for wave in parts.waves(COPY_WAVE, b.offset % parts.n):
                yield [(i, parts.whole.without(part)) for i, part in wave]

    def ride_along(self, branches: Sequence[Branch], asked: list[Set], most: int | None = None) -> list[Set]:
        """Sets of later rounds that the first wave of parts takes along while it has room.

        Which they are follows from the splits alone, unless `most` limits the rows of all sets
        of the job.
        """
        if not (self.lookahead and isinstance(self.test, BatchTest)) or all(p in self.known for p in asked):
            return []
        extra = [s for b in branches[:COPY_WAVE // RIDE] if b.parts <= RIDE
                 for wave in self.complements(b) for _, s in wave]
        level = sum(s.size for s in asked)
        taken = level + sum(s.size for s in extra)
        if len(asked) + len(extra) > PART_WAVE or most is not None and taken > most:
            return []
        depth = 0
        while (depth < self.lookahead and len(asked) * (2 ** (depth + 2) - 1) + len(extra) <= PART_WAVE
               and (most is None or taken + (depth + 1) * level <= most)):
            depth += 1
        return extra + [s for p in asked for s in self.ahead(p, depth)]

    def finer(self, b: Branch) -> Branch | None:
        """The branch split twice as finely, or None when every part is one row."""
        most = self.sets.finest(b.one)
        if b.parts >= most or self.parts(b.one, b.parts).single:
            return None
        return Branch(b.one, min(most, 2 * b.parts), b.offset)

    def first_failing(self, b: Branch) -> Branch | None:
        """The next set of the one-solution search."""
        parts = self.parts(b.one, b.parts)
        for wave in parts.waves(1 if parts.few and b.one.size > JOB_ROWS else PART_WAVE):
            asked = [p for _, p in wave]
            failed = self.ask([*asked, *self.ride_along([b], asked, JOB_ROWS)], PART_WAVE)
            for (i, part), bad in zip(wave, failed):
                if self.note(b, "part", i, part, bad):
                    return Branch(part)
        for wave in self.complements(b):
            for (i, rest), bad in zip(wave, self.ask([r for _, r in wave], COPY_WAVE)):
                if self.note(b, "complement", i, rest, bad):
                    return Branch(self.sets.compact(rest), max(b.parts - 1, 2), i)
        return self.finer(b)

    def all_failing(self, branches: Sequence[Branch]) -> Iterator[tuple[Branch, Branch | None]]:
        """(branch, next) for every next set of the exhaustive search; None when it is minimal."""
        open_branches = dict.fromkeys(branches)
        split = ((b, i, p) for b in branches for wave in self.parts(b.one, b.parts).waves(EVERY_WAVE) for i, p in wave)
        for chunk in _chunks(split, EVERY_WAVE):
            asked = [p for _, _, p in chunk]
            failed = self.ask([*asked, *self.ride_along(list(dict.fromkeys(b for b, _, _ in chunk)), asked)], EVERY_WAVE)
            for (b, i, part), bad in zip(chunk, failed):
                if self.note(b, "part", i, part, bad):
                    open_branches.pop(b, None)
                    yield b, Branch(part)
        rest = {b: b.one for b in open_branches}
        left = {b: b.parts for b in open_branches}
        others = ((b, i, r) for b in list(open_branches) for wave in self.complements(b) for i, r in wave)
        for chunk in _chunks(others, COPY_WAVE):
            following: list[tuple[Branch, Branch]] = []
            for (b, i, one), bad in zip(chunk, self.ask([r for _, _, r in chunk], COPY_WAVE)):
                if self.note(b, "complement", i, one, bad):
                    open_branches.pop(b, None)
                    # What all failing complements so far have in common.
                    whole = self.parts(b.one, b.parts).whole
                    kept = whole if rest[b].table != whole.table else rest[b]
                    rest[b], left[b] = kept.without(whole.without(one)), left[b] - 1
                    following.append((b, Branch(rest[b], max(left[b], 2), i)))
            for (b, step), bad in zip(following, self.ask([s.one for _, s in following], COPY_WAVE)):
                if bad:
                    yield b, Branch(self.sets.compact(step.one), step.parts, step.offset)
        for b in open_branches:
            yield b, self.finer(b)


def ranked_candidates(candidates: DataFrame, order: Sequence[str], seed: int | None = None) -> DataFrame:
    """Number the candidates from 0 in a total order, or in a seeded shuffle of it, and
    write them sorted by that number."""
    by = list(order)
    if seed is not None:
        candidates = candidates.withColumn("__mix", F.xxhash64(F.lit(seed), *order))
        by = ["__mix", *by]
    numbered = number_rows(candidates, [], by, RANK).withColumn(RANK, F.col(RANK) - 1)
    numbered = numbered.drop("__mix")
    return stored(numbered.sortWithinPartitions(RANK), "candidates")


def ddmin(candidates: DataFrame, test, order: Sequence[str], exhaustive: bool = False,
          seed: int | None = None, max_rounds: int | None = None, lookahead: int = 3,
          split: Callable[[int], Column] | None = None) -> Minimised:
    """Minimal failing sets of candidates.

    `test` is a BatchTest, or a function from a set's rows to true when it fails. `order`
    names columns that order the candidates totally; parts are runs of that order, or of
    a seeded shuffle of it, or what `split(n)` says. One search follows the first failing
    part, else the first failing complement. With `exhaustive` every failing branch is
    followed, the branches of a round sharing jobs. The search goes on until every set is
    minimal, unless the caller gives `max_rounds`.
    """
    spark = candidates.sparkSession
    ranked = ranked_candidates(candidates, order, seed)
    sets = Sets(ranked) if split is None else SplitSets(ranked, split)
    if not isinstance(test, (BatchTest, SingleTest)):
        test = test if hasattr(test, "outcomes") else SingleTest(test)
    search = _Search(sets, test, lookahead if split is None else 0, Log(spark, _HISTORY, "history"))
    (failed,) = search.ask([sets.whole], 1)
    search.log.add((0, sets.total, 1, "whole", 0, failed, search.spent))
    pending, solutions = Pending(spark), Solutions(sets)
    seen: OrderedDict[Branch, None] = OrderedDict()

    def follow(b: Branch) -> None:
        if b.one.size <= 1:
            solutions.add(b.one)
        elif b not in seen:
            seen[b] = None
            if len(seen) > MEMORY:
                seen.popitem(last=False)
            pending.add(b)

    if failed:
        follow(Branch(sets.whole))
    while pending and (max_rounds is None or search.run < max_rounds):
        search.run += 1
        if exhaustive:
            steps = search.all_failing(pending.take(sets.branches))
        else:
            steps = [(b, search.first_failing(b)) for b in pending.take(1)]
        for b, step in steps:
            solutions.add(b.one) if step is None else follow(step)
    complete = not pending
    left = Solutions(sets)
    while pending:
        for b in pending.take(BRANCH_WAVE):
            left.add(b.one)
    return Minimised(solutions.rows(), left.rows(), search.log.frame(), search.run, search.jobs, complete)
