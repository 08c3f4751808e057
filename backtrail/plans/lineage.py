"""Record-level tracing over staged DataFrame programs.

A traced program is a list of stages. Each stage is a function from the rows of the stage
before to its own rows, and every row has an identity `__lid`:

* a source row is identified by its own key columns;
* a filter or projection keeps the identity of its input row;
* an exploded row has its input's identity and its position in it;
* a joined row has the identities of both its inputs;
* an aggregated row is identified by its group key.

Identities nest, so a step back from exploded or joined rows is a projection. Only a step
across an aggregation needs a join: the rows going in, against the chosen group keys.
Nothing is gathered per output, so an output made of very many inputs traces as well.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.operators.faults import mark
from backtrail.plans.groups import KeySet, in_groups_of, keep_matching, measure, meeting
from backtrail.session import stored
from backtrail.sources.lines import LID, trace_source

OUT = "__out"
NAMED_KEYS = 32      # keys up to which a scan of links asks for each
SOME = 16            # one record of so many is looked at to guess which keys are frequent
SIZES = 64           # sizes of groups up to which the least that a condition chooses is looked for


@dataclass(frozen=True)
class Stage:
    name: str
    kind: str  # source, same, nested, keyed
    apply: Callable[[DataFrame], DataFrame] | None = None
    keys: tuple[str, ...] = ()
    sides: dict[str, Traced] = field(default_factory=dict)
    links: DataFrame | None = None  # captured (group key, input identity) pairs
    every: bool = False  # an aggregation that gives a row for every key of its input
    size: str | None = None  # the column of an aggregation that counts the rows of its input


@dataclass(frozen=True)
class Traced:
    """A program over one source. Methods return extended copies."""

    origin: DataFrame
    stages: tuple[Stage, ...]

    @staticmethod
    def source(df: DataFrame, id_cols: Sequence[str] | None = None, name: str = "source") -> Traced:
        """Start from records with key columns, or from rows that carry `__lid` already."""
        origin = df if id_cols is None else trace_source(df, id_cols)
        return Traced(origin, (Stage(name, "source"),))

    def _plus(self, stage: Stage) -> Traced:
        return replace(self, stages=(*self.stages, stage))

    def map(self, name: str, fn: Callable[[DataFrame], DataFrame]) -> Traced:
        """A filter or row-wise projection; `fn` must keep `__lid`."""
        return self._plus(Stage(name, "same", fn))

    def explode(self, name: str, items: Column, out: str, keep: Sequence[str] = ()) -> Traced:
        """One row per array item, with the `keep` columns of its input."""

        def apply(rows: DataFrame) -> DataFrame:
            found = rows.select(LID, *keep, F.posexplode(items).alias("__pos", out))
            lid = F.struct(F.col(LID).alias("main"), F.col("__pos").alias("pos"))
            return found.withColumn(LID, lid).drop("__pos")

        return self._plus(Stage(name, "nested", apply))

    def join(self, name: str, other: Traced, on: Sequence[str], side: str,
             how: str = "inner") -> Traced:
        """Join with the last stage of another program; `side` names it in traces.

        The other side is computed and measured once, here.
        """
        theirs = other.rows()
        names = {c: "__right" if c == LID else c for c in theirs.columns}
        right = measure(theirs).frame(names)

        def apply(rows: DataFrame) -> DataFrame:
            joined = rows.join(right, list(on), how)
            lid = F.struct(F.col(LID).alias("main"), F.col("__right").alias(side))
            return joined.withColumn(LID, lid).drop("__right")

        return self._plus(Stage(name, "nested", apply, sides={side: other}))

    def group(self, name: str, keys: Sequence[str], fn: Callable[[DataFrame], DataFrame],
              every: bool = False, size: str | None = None) -> Traced:
        """An aggregation; its rows are identified by `keys`, columns of both ends.

        `every` says that it loses no key, so whether a key is one of its rows shows in its
        input already. `size` names a column that counts the rows of each group, where none is
        lost: a step back from groups chosen by it alone counts the rows where they meet.
        """

        def apply(rows: DataFrame) -> DataFrame:
            return fn(rows.drop(LID)).withColumn(LID, F.struct(*keys))

        return self._plus(Stage(name, "keyed", apply, keys=tuple(keys), every=every, size=size))

    def rows(self, upto: int | None = None) -> DataFrame:
        """Rows of a stage (the last by default) with their identities."""
        last = len(self.stages) - 1 if upto is None else upto
        df = self.origin
        for stage in self.stages[1 : last + 1]:
            df = stage.apply(df)
        return df

    def with_id(self) -> DataFrame:
        return self.rows()

    def result(self) -> DataFrame:
        return self.rows().drop(LID)

    def marked(self, predicate: Column) -> DataFrame:
        return mark(self.rows(), predicate)

    def captured(self) -> Traced:
        """Write the links of every aggregation once, so that later traces read them.

        They are written in ranges of the group key, sorted by it, and a trace from few
        outputs asks for their keys when it reads them: files, row groups and pages that
        cannot hold one are left out.
        """
        kept = []
        for i, stage in enumerate(self.stages):
            if stage.kind == "keyed" and stage.links is None:
                by = [F.col(OUT)[k] for k in stage.keys]
                parts = int(self.origin.sparkSession.conf.get("spark.sql.shuffle.partitions"))
                links = self._links(i).repartitionByRange(parts, *by).sortWithinPartitions(*by)
                stage = replace(stage, links=stored(links, "links"))
            kept.append(stage)
        return replace(self, stages=tuple(kept))

    def _links(self, at: int) -> DataFrame:
        """(group key, input identity) of an aggregation; no other columns."""
        stage = self.stages[at]
        if stage.links is not None:
            return stage.links
        rows = self.rows(at - 1)
        return rows.select(F.struct(*stage.keys).alias(OUT), F.col(LID))

    def _some(self) -> Traced:
        """The program over some of its source records."""
        return replace(self, origin=self.origin.filter(_chance()))

    def index(self, name: str) -> int:
        return [s.name for s in self.stages].index(name)

    def lineage(self) -> Cursor:
        """A cursor on all rows of the last stage."""
        return Cursor(self, len(self.stages) - 1, None)

    def inputs(self) -> Cursor:
        """A cursor on all source rows."""
        return Cursor(self, 0, None)

    def rerun_from(self, stage: int | str, rows: DataFrame) -> DataFrame:
        """Run only the stages after `stage`, on the given rows of it."""
        at = self.index(stage) if isinstance(stage, str) else stage
        for later in self.stages[at + 1 :]:
            rows = later.apply(rows)
        return rows


def _all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _chance() -> Column:
    return F.pmod(F.xxhash64(LID), F.lit(SOME)) == 0


def _least_size(chosen: Column, size: str, sizes: DataFrame) -> int | None:
    """The least size of a group that a condition chooses, or a bound below it; None if the
    condition looks at more than the size."""
    try:
        met = sizes.select(F.col("id").alias(size)).filter(chosen)
        if not met._jdf.queryExecution().analyzed().deterministic():
            return None
        return met.agg(F.min(size).alias("least")).first()["least"] or SIZES + 1
    except PySparkException:
        return None


def _around(keys: KeySet, lid: str, first: str) -> Column:
    """A condition on links that the chosen keys meet, of the kind that a scan can use.

    A few keys are named; of more, the least and the greatest are.
    """
    key, of = F.col(lid)[first], F.col(OUT)[first]
    if not keys.small:
        return F.lit(True)
    few = keys.rows.select(key.alias("k")).distinct().limit(NAMED_KEYS + 1).collect()
    if len(few) <= NAMED_KEYS:
        named = [of.isNull() if r["k"] is None else of == F.lit(r["k"]) for r in few]
        return reduce(Column.__or__, named, F.lit(False))
    ends = keys.rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.bool_or(key.isNull()).alias("null")).first()
    inside = (of >= F.lit(ends["lo"])) & (of <= F.lit(ends["hi"]))
    return inside | of.isNull() if ends["null"] else inside


@dataclass(frozen=True)
class Cursor:
    """A set of records of one stage. `ids` holds `__lid`, and `__out` when outputs are
    kept apart; None stands for every record. `found` holds the records themselves where
    the last step met them, so that they are not looked up by their identities again. `named`
    holds identities as they were given, where a step back needs no look whether they are those
    of records. `by_size` holds the condition that chose among all groups by their size alone,
    and the least size that can meet it."""

    traced: Traced
    at: int
    ids: DataFrame | None
    per_output: bool = False
    found: DataFrame | None = None
    named: KeySet | None = None
    by_size: tuple[Column, int] | None = None

    @property
    def stage(self) -> Stage:
        return self.traced.stages[self.at]

    def _all_ids(self) -> DataFrame:
        return self.traced.rows(self.at).select(LID) if self.ids is None else self.ids

    def where(self, chosen: DataFrame | Column) -> Cursor:
        """Keep records by a predicate on their columns, or by a frame of identities.

        Identities that are repeated count once, those of no record of the stage not at all.
        """
        named = by_size = None
        if isinstance(chosen, Column):
            ids = self.rows().filter(chosen)
            ids = ids.select(*([OUT] if self.per_output else []), LID)
            if self.stage.size is not None and self.ids is None:
                by_size = self._by_size(chosen)
        else:
            asked = measure(chosen.select(LID).filter(F.col(LID).isNotNull()))
            ids = keep_matching(self._all_ids(), asked, [LID])
            named = asked if self.stage.every and self.ids is None else None
        return replace(self, ids=ids, found=None, named=named, by_size=by_size)

    def where_id(self, *values) -> Cursor:
        """Keep the one record with the given identity fields, in their order."""
        lid_type = self.traced.rows(self.at).schema[LID].dataType
        if len(values) != len(lid_type.fields):
            raise ValueError(f"{len(lid_type.fields)} identity fields are needed")
        same = F.lit(True)
        for f, value in zip(lid_type.fields, values):
            same = same & F.col(LID)[f.name].eqNullSafe(F.lit(value).cast(f.dataType))
        return replace(self, ids=self._all_ids().filter(same), found=None, named=None, by_size=None)

    def _distinct(self, ids: DataFrame, lid: Column) -> DataFrame:
        kept = [OUT] if self.per_output else []
        return ids.select(*kept, lid.alias(LID)).filter(F.col(LID).isNotNull()).distinct()

    def _keys(self, names: dict[str, Column]) -> KeySet:
        """The identities, or fields of them, as a key set."""
        fields = [field.alias(name) for name, field in names.items()]
        if self.named is not None:
            return replace(self.named, rows=self.named.rows.select(*fields))
        return measure(self.ids.select(*fields))

    def _by_size(self, chosen: Column) -> tuple[Column, int] | None:
        rows, size = self.traced.rows(self.at - 1), self.stage.size
        if size.lower() in map(str.lower, rows.columns):
            return None
        least = _least_size(chosen, size, rows.sparkSession.range(1, SIZES + 1))
        return None if least is None else (chosen, least)

    def _sized(self) -> DataFrame:
        """The inputs of the groups that were chosen by their size, in one exchange of the rows
        that may belong to them. Rows are sorted before it, as they take less room then."""
        (chosen, least), keys, size = self.by_size, self.stage.keys, self.stage.size
        rows = self.traced.rows(self.at - 1)
        may = rows if least == 1 else in_groups_of(rows, keys, least)
        met = may.sortWithinPartitions(*keys).repartition(*keys)
        counted = met.withColumn(size, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
        return counted.filter(chosen).drop(size)

    def _step_back(self, side: str) -> Cursor:
        stage, prior = self.stage, replace(self, at=self.at - 1, found=None, named=None, by_size=None)
        if stage.kind == "source":
            raise ValueError("already at the source")
        if side != "main":
            other = stage.sides[side]
            ids = self._distinct(self._all_ids(), F.col(LID)[side])
            return Cursor(other, len(other.stages) - 1, ids, self.per_output)
        if stage.kind == "same":
            return replace(prior, ids=self._all_ids())
        if stage.kind == "nested":
            return replace(prior, ids=self._distinct(self._all_ids(), F.col(LID)["main"]))
        links = self.traced._links(self.at)
        if self.ids is None:
            return replace(prior, ids=links.select(LID))
        captured = stage.links is not None
        if self.by_size is not None and not captured:
            found = self._sized()
            return replace(prior, ids=found.select(LID), found=found)
        if not self.per_output and not captured:
            keys = self._keys({k: F.col(LID)[k] for k in stage.keys})
            met = meeting(self.traced.rows(self.at - 1), keys, stage.keys, self.traced._some().rows(self.at - 1))
            found = _all([keep_matching(rows, held, stage.keys) for rows, held in met])
            return replace(prior, ids=found.select(LID), found=found)
        some = links.filter(_chance()) if captured else self.traced._some()._links(self.at)
        if not self.per_output:
            keys = self._keys({OUT: F.col(LID)})
            met = meeting(links.filter(_around(keys, OUT, stage.keys[0])), keys, [OUT], some)
            return replace(prior, ids=_all([keep_matching(rows, held, [OUT]).select(LID) for rows, held in met]))
        outs = measure(self.ids)
        if captured:
            links = links.filter(_around(outs, LID, stage.keys[0]))
        keys = replace(outs, rows=outs.rows.withColumnRenamed(LID, "__link"))
        met = meeting(links.withColumnRenamed(OUT, "__link"), keys, ["__link"], some.withColumnRenamed(OUT, "__link"))
        joined = _all([
            rows.join(held.frame({OUT: OUT, "__link": "__key"}), F.col("__link") == F.col("__key")).select(OUT, LID)
            for rows, held in met])
        return replace(prior, ids=joined.distinct())

    def back(self, steps: int = 1, side: str = "main") -> Cursor:
        """Step towards the source; `side` picks the other input at the first join that has it."""
        cursor, crossed = self, side == "main"
        for _ in range(steps):
            here = not crossed and side in cursor.stage.sides
            cursor = cursor._step_back(side if here else "main")
            crossed = crossed or here
        if not crossed:
            raise ValueError(f"no join with the side {side} within {steps} steps")
        return cursor

    def back_all(self) -> Cursor:
        return self.back(self.at)

    def back_all_per_output(self) -> DataFrame:
        """(__out, source columns): the source records of each output, kept apart."""
        ids = self._all_ids().select(F.col(LID).alias(OUT), LID)
        return replace(self, ids=ids, per_output=True, found=None, named=None, by_size=None).back_all().rows()

    def _step_forward(self) -> Cursor:
        if self.at + 1 == len(self.traced.stages):
            raise ValueError("already at the output")
        after = self.traced.stages[self.at + 1]
        later = replace(self, at=self.at + 1, found=None, named=None, by_size=None)
        if self.ids is None:
            return later
        if after.kind == "keyed":
            links = keep_matching(self.traced._links(later.at), self.ids, [LID])
            return replace(later, ids=links.select(F.col(OUT).alias(LID)).distinct())
        own = self.traced.rows(later.at).select(LID)
        if after.kind == "same":
            return replace(later, ids=keep_matching(own, self.ids, [LID]))
        tagged = own.select(F.col(LID).alias("__own"), F.col(LID)["main"].alias(LID))
        found = keep_matching(tagged, self.ids, [LID])
        return replace(later, ids=found.select(F.col("__own").alias(LID)))

    def forward(self, steps: int = 1) -> Cursor:
        """Step towards the output."""
        cursor = self
        for _ in range(steps):
            cursor = cursor._step_forward()
        return cursor

    def forward_into(self, program: Traced, stage: int | str, side: str) -> Cursor:
        """From the last stage of a joined program to the join's records of `program`."""
        at = program.index(stage) if isinstance(stage, str) else stage
        if side not in program.stages[at].sides:
            raise ValueError(f"the stage has no side {side}")
        if self.at + 1 != len(self.traced.stages):
            raise ValueError("only the last stage of a program is joined")
        own = program.rows(at).select(F.col(LID).alias("__own"), F.col(LID)[side].alias(LID))
        found = keep_matching(own, self._all_ids(), [LID])
        return Cursor(program, at, found.select(F.col("__own").alias(LID)))

    def forward_all(self) -> Cursor:
        return self.forward(len(self.traced.stages) - 1 - self.at)

    def rows(self) -> DataFrame:
        """The records themselves, with `__lid` (and `__out`)."""
        if self.found is not None:
            return self.found
        rows = self.traced.rows(self.at)
        if self.ids is None:
            return rows
        if not self.per_output:
            return keep_matching(rows, self.ids, [LID])
        ids = measure(self.ids).frame({OUT: OUT, LID: "__id"})
        return rows.join(ids, F.col(LID) == F.col("__id")).drop("__id")

    def counted(self) -> DataFrame:
        """(records): how many records the cursor holds, as a frame of one row."""
        return self._all_ids().agg(F.count(F.lit(1)).alias("records"))

    def count(self) -> int:
        return self.counted().first()["records"]
