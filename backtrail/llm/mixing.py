"""Mixing sources to target weights along a time-varying curriculum.

Each source's target is its weighted share of the words the mix takes, at most `most`
times the source's own words; what such a cap frees is shared again by weight. A source is
laid out in a fixed hashed order of its documents, pass after pass, until its target is
met: every document is taken as often as whole passes go in, and once more if its middle
lies within the rest. So a source misses its target by less than one document.

The curriculum gives each source a weight over training time, linear between knots. Its
integral is the demand for the source's words up to a time; a document that starts at some
offset of the source's words is trained at the time when the demand reaches that offset.
The documents are then range-sorted by time.

Sizes are running sums over range partitions, so a source with a third of all rows spreads
over the cluster; the sources' own table has one row each. All of it is DataFrame
functions, and the order comes from hashes of the ids, so that reruns agree.

Null text has size 0 and null source is a source, last by name. Repeated rows are documents
of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import distinct_docs, fresh
from backtrail.llm.line_dedup import fingerprint
from backtrail.plans.groups import measure, number_rows
from backtrail.session import durable

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
# Per weight class: (time, relative weight) knots. Heavy sources lead, light ones follow.
CURRICULUM = (((0.0, 1.4), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, source, size): the words between white space of each document."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    return docs.select("doc_id", fingerprint().alias("fp"), "source", size.alias("size"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
            most: float = MOST) -> DataFrame:
    """(source, source_size, turn, target): `turn` is the place of the source's weight.

    The common price of a word per weight rises until the capped targets add up: each
    round sums two numbers over the sources and ends when no further source is capped.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    totals = totals.withColumn("last", F.col("source").isNull())
    ranked = number_rows(totals, [], ["last", "source"], name="place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    rows = durable(ranked.select("source", "source_size", turn.alias("turn"), weight.alias("weight")))
    cap = F.col("source_size") * float(most)
    demand = (rows.agg(F.sum("source_size")).first()[0] or 0) * float(share)
    price = 0.0
    while True:
        capped = cap <= F.lit(price) * F.col("weight")
        got = rows.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        next_price = (demand - (got[0] or 0.0)) / got[1] if got[1] else price
        if next_price <= price:
            break
        price = next_price
    return rows.select("source", "source_size", "turn",
                       F.least(cap, F.lit(price) * F.col("weight")).alias("target"))


def when_reached(part: Column, turn: Column, curriculum: Sequence = CURRICULUM) -> Column:
    """The time at which the demand of a source reaches a part (0 to 1) of its target."""
    out = F.lit(0.0)
    for k, knots in enumerate(curriculum):
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:])]
        whole, done, time = sum(areas), 0.0, F.lit(1.0)
        branches = []
        for ((t0, w0), (t1, w1)), area in zip(zip(knots, knots[1:]), areas):
            slope = (w1 - w0) / (t1 - t0)
            rest = F.greatest(part * whole - done, F.lit(0.0))
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
            step = F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(0.0)
            branches.append(((done + area) / whole, F.least(t0 + step, F.lit(t1))))
            done += area
        for end, value in reversed(branches):
            time = F.when(part < end, value).otherwise(time)
        out = F.when(turn == k % len(curriculum), time).otherwise(out)
    return out


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
         most: float = MOST) -> DataFrame:
    """(doc_id, fp, source, size, source_size, target, turn, offset, copies): one row per document."""
    sized = durable(sizes(docs).withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    by_source = targets(sized, weights, share, most)
    placed = number_rows(sized, ["source"], ["order", "doc_id", "fp"], name="first", weight="size")
    wanted = measure(by_source).frame({"source": "__source", "source_size": "source_size",
                                       "turn": "turn", "target": "target"})
    rows = placed.join(wanted, F.col("source").eqNullSafe(F.col("__source")))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    offset = F.col("first") - 1
    rest = F.col("target") - passes * F.col("source_size")
    more = F.when((F.col("size") > 0) & (offset + F.col("size") / 2 <= rest), 1).otherwise(0)
    copies = F.least(passes + more, F.floor(F.lit(most)))
    return rows.select("doc_id", "fp", "source", "size", "source_size", "target", "turn",
                       offset.alias("offset"), copies.cast("int").alias("copies"))


def position_of(copy: Column, curriculum: Sequence = CURRICULUM) -> Column:
    """When a copy of a planned document is trained: where its first word meets the demand for its source."""
    reached = (copy - 1) * F.col("source_size") + F.col("offset")
    part = F.when(F.col("target") > 0, F.least(reached / F.col("target"), F.lit(1.0))).otherwise(0.0)
    return when_reached(part, F.col("turn"), curriculum)


def schedule(planned: DataFrame, curriculum: Sequence = CURRICULUM) -> DataFrame:
    """(doc_id, fp, copy, position): one row per copy taken; positions run from 0 to 1."""
    rows = planned.filter(F.col("copies") > 0).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return rows.select("doc_id", "fp", "copy", position_of(F.col("copy"), curriculum).alias("position"))


def positions(planned: DataFrame, curriculum: Sequence = CURRICULUM) -> DataFrame:
    """`planned` with first_position and last_position of a document's copies, in training order.

    Documents that are not taken have no position and come first.
    """
    taken = F.col("copies") > 0
    rows = planned.withColumns({
        "first_position": F.when(taken, position_of(F.lit(1), curriculum)),
        "last_position": F.when(taken, position_of(F.col("copies"), curriculum))})
    return rows.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE,
        most: float = MOST, curriculum: Sequence = CURRICULUM) -> DataFrame:
    """The documents in training order, each as often as it is taken.

    Added columns: `copy` (from 1) and `position` (0 to 1); columns of these names are
    replaced. Documents that are not taken go.
    """
    docs = docs.drop("copy", "position")
    fp, own_doc, own_fp = fresh(docs, "fp", "__doc", "__fp")
    order = schedule(plan(docs, weights, share, most), curriculum).select(
        F.col("doc_id").alias(own_doc), F.col("fp").alias(own_fp), "copy", "position")
    same = F.col("doc_id").eqNullSafe(F.col(own_doc)) & (F.col(fp) == F.col(own_fp))
    rows = distinct_docs(docs, fp).join(order, same).select(*docs.columns, "copy", "position")
    return rows.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
