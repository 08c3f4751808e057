"""Adjacency lists and degrees of a directed edge list (`src`, `dst`)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.plans.groups import MAX_GROUP, keep_matching, large_groups, measure, number_rows

def edge_facts(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Two facts per edge: (vertex, side, neighbour), side `from` or `to`.

    One pass over the edges, each exploded into its two ends.
    """
    ends = F.array(
        F.struct(F.col("dst").alias("vertex"), F.lit("from").alias("side"), F.col("src").alias("neighbour")),
        F.struct(F.col("src").alias("vertex"), F.lit("to").alias("side"), F.col("dst").alias("neighbour")),
    )
    return edges.select(*by, F.explode(ends).alias("end")).select(*by, "end.*")


def adjacency_list(edges: DataFrame, limit: int | None = None, by: Sequence[str] = (),
                   max_group: int = MAX_GROUP, held: int = MAX_GROUP) -> DataFrame:
    """(vertex, segment, from, to): distinct sorted neighbours.

    A vertex with at most `max_group` edge facts has the one segment 0. A busier one
    continues in further segments of `max_group` neighbours on each side. With more than
    `held` facts it is ranked across the cluster for that; with fewer its lists are cut where
    they are. Only with `limit` are neighbours left out: the first `limit` on each side stay.
    """
    facts = edge_facts(edges, by)
    keys = [*by, "vertex"]

    def lists(rows: DataFrame) -> DataFrame:
        def side(name: str) -> Column:
            kept = F.collect_set(F.when(F.col("side") == name, F.col("neighbour")))
            kept = F.sort_array(kept)
            return (kept if limit is None else F.slice(kept, 1, limit)).alias(name)

        return rows.groupBy(*keys, "segment").agg(side("from"), side("to"))

    def cut(rows: DataFrame) -> DataFrame:
        """Whole lists in pieces of `max_group`; a side that ends before the other goes on empty."""
        last = F.floor((F.greatest(F.size("from"), F.size("to"), F.lit(1)) - 1) / F.lit(max_group)).cast("bigint")
        pieces = rows.drop("segment").withColumn("segment", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
        at = (F.col("segment") * max_group + 1).cast("int")
        return pieces.select(*keys, "segment", *[F.slice(c, at, F.lit(max_group)).alias(c) for c in ("from", "to")])

    def whole(rows: DataFrame) -> DataFrame:
        found = lists(rows.withColumn("segment", first))
        return cut(found) if max_group < held else found

    first = F.lit(0).cast("bigint")
    large = measure(large_groups(facts, keys, max(held, max_group)))
    if large.empty:
        return whole(facts)
    cold = whole(keep_matching(facts, large, keys, anti=True))
    hot = keep_matching(facts, large, keys).dropDuplicates()
    ranked = number_rows(hot, [*keys, "side"], ["neighbour"])
    if limit is not None:
        ranked = ranked.filter(F.col("__rn") <= limit)
    segment = F.floor((F.col("__rn") - 1) / F.lit(max_group)).cast("bigint")
    return cold.unionByName(lists(ranked.withColumn("segment", segment).drop("__rn")))


def degrees(edges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(vertex, in_degree, out_degree) over distinct edges, without building lists."""
    return fact_degrees(edge_facts(edges.select(*by, "src", "dst").dropDuplicates(), by), by)


def fact_degrees(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from edge facts, which must be distinct."""

    def side(name: str) -> Column:
        return F.count(F.when(F.col("side") == name, 1))

    return facts.groupBy(*by, "vertex").agg(
        side("from").alias("in_degree"), side("to").alias("out_degree")
    )


def adjacency_text() -> Column:
    """`from{a,b}:to{c}`."""
    return F.concat(
        F.lit("from{"), F.array_join("from", ","), F.lit("}:to{"), F.array_join("to", ","), F.lit("}")
    )
