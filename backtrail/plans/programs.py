"""The analytics programs as traced stages, and the whole localisation flow.

Where an operator gathers items into arrays, its traced form ends in the counts that the
output predicates need; the arrays themselves come from the plain operator.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.functions import strings as S
from backtrail.operators import numeric, ratings, text
from backtrail.plans.ddmin import Minimised, ddmin
from backtrail.plans.groups import by_unit
from backtrail.plans.lineage import Traced
from backtrail.sources.lines import LID

Ids = Sequence[str] | None


def word_count(lines: DataFrame, ids: Ids, weight: Column | None = None) -> Traced:
    """lines -> words -> counts. `weight` of a word may seed a fault."""
    return (
        Traced.source(lines, ids, "lines")
        .explode("words", S.split_words(F.col("value")), "word")
        .group("counts", ["word"], lambda w: text.count_words(w, weight=weight), every=True)
    )


def grep_count(lines: DataFrame, ids: Ids, pattern: str) -> Traced:
    """lines -> matches -> counts."""
    found = F.regexp_extract_all(F.col("value"), F.lit(pattern), F.lit(0))
    return (
        Traced.source(lines, ids, "lines")
        .explode("matches", found, "match")
        .group("counts", ["match"], lambda m: m.groupBy("match").agg(F.count(F.lit(1)).alias("count")), every=True)
    )


def _by_doc(docs: DataFrame) -> DataFrame:
    """Records dealt by document, so that counts within one need no exchange; as they are if
    some document is too large for one task."""
    together, apart = by_unit(docs, ["doc"], "content")
    return together if apart is None else docs


def sequence_count(docs: DataFrame, ids: Ids, n: int = 3) -> Traced:
    """records -> phrases -> counts per phrase and document."""
    return (
        Traced.source(_by_doc(docs), ids, "records")
        .explode("phrases", S.ngrams(S.tokenize(F.col("content")), n), "phrase", ["doc"])
        .group("counts", ["phrase", "doc"],
               lambda p: p.groupBy("phrase", "doc").agg(F.count(F.lit(1)).alias("count")), every=True)
    )


def inverted_index(docs: DataFrame, ids: Ids) -> Traced:
    """records -> words -> (word, n_docs, n_postings)."""

    def sizes(words: DataFrame) -> DataFrame:
        per_doc = words.groupBy("word", "doc").agg(F.count(F.lit(1)).alias("n"))
        return per_doc.groupBy("word").agg(
            F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_postings")
        )

    return (
        Traced.source(docs, ids, "records")
        .explode("words", S.split_words(F.col("content")), "word", ["doc"])
        .group("index", ["word"], sizes)
    )


def ranked_inverted_index(phrase_counts: DataFrame, ids: Ids) -> Traced:
    """phrase counts -> (phrase, n_docs, top_count)."""

    def sizes(rows: DataFrame) -> DataFrame:
        return rows.groupBy("phrase").agg(
            F.count(F.lit(1)).alias("n_docs"), F.max("count").alias("top_count")
        )

    return Traced.source(phrase_counts, ids, "phrase_counts").group("index", ["phrase"], sizes, size="n_docs")


def term_vector(docs: DataFrame, ids: Ids, min_count: int = 2) -> Traced:
    """records -> terms -> counts -> frequent -> (doc, n_terms, top_count)."""

    def counted(terms: DataFrame) -> DataFrame:
        return terms.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("count"))

    def vector(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc").agg(
            F.count(F.lit(1)).alias("n_terms"), F.max("count").alias("top_count")
        )

    return (
        Traced.source(_by_doc(docs), ids, "records")
        .explode("terms", S.split_words(F.col("content")), "term", ["doc"])
        .group("counts", ["doc", "term"], counted)
        .map("frequent", lambda rows: rows.filter(F.col("count") >= min_count))
        .group("vectors", ["doc"], vector)
    )


def adjacency(edges: DataFrame, ids: Ids) -> Traced:
    """edges -> facts -> (vertex, in_degree, out_degree)."""
    ends = F.array(
        F.struct(F.col("dst").alias("vertex"), F.lit("from").alias("side"), F.col("src").alias("other")),
        F.struct(F.col("src").alias("vertex"), F.lit("to").alias("side"), F.col("dst").alias("other")),
    )

    def sides(facts: DataFrame) -> DataFrame:
        distinct = facts.select("vertex", "side", "other").dropDuplicates()
        return distinct.groupBy("vertex").agg(
            F.count(F.when(F.col("side") == "from", 1)).alias("in_degree"),
            F.count(F.when(F.col("side") == "to", 1)).alias("out_degree"),
        )

    return (
        Traced.source(edges, ids, "edges")
        .explode("facts", ends, "end")
        .map("ends", lambda rows: rows.select(LID, "end.*"))
        .group("vertices", ["vertex"], sides)
    )


def histogram(reviews: DataFrame, ids: Ids) -> Traced:
    """reviews -> counts per rating."""
    return Traced.source(reviews, ids, "reviews").group(
        "counts", ["rating"], ratings.ratings_histogram
    )


def classification(reviews: DataFrame, ids: Ids, centroids: DataFrame) -> Traced:
    """reviews -> matches with centroid reviews -> movies -> clusters.

    Traces reach the centroid reviews with `back(side='centroids')` from the matches.
    """
    model = Traced.source(
        ratings.centroid_reviews(centroids), ["cluster_id", "rater_id"], "centroid_reviews"
    )
    return (
        Traced.source(reviews, ids, "reviews")
        .join("matches", model, ["rater_id"], "centroids", how="left")
        .group("movies", ["movie_id"], ratings.score)
        .group("clusters", ["cluster_id"], ratings.cluster_sizes)
    )


def recentring(assigned: DataFrame, reviews: DataFrame) -> Traced:
    """assigned movies -> new centroids; a centroid depends on every member's similarity."""
    return Traced.source(assigned, ["movie_id"], "movies").group(
        "centroids", ["cluster_id"], lambda members: ratings.recenter(members, reviews)
    )


def categories(numbers: DataFrame, ids: Ids, col: str, lo: float, hi: float) -> Traced:
    """numbers -> in range -> (category, count, total)."""
    return (
        Traced.source(numbers, ids, "numbers")
        .map("in_range", lambda rows: numeric.filter_range(rows, col, lo, hi))
        .map("labelled", lambda rows: numeric.bucketize(rows, col))
        .group("categories", ["category"],
               lambda rows: rows.groupBy("category").agg(
                   F.count(F.lit(1)).alias("count"), F.sum(col).alias("total")))
    )


@dataclass
class Localised:
    traced: DataFrame
    minimised: Minimised


def localize(program: Traced, faults: DataFrame | Column, test, order: Sequence[str],
             direction: str = "extra", clean: Traced | None = None, **search) -> Localised:
    """Run, detect, trace and minimise.

    `faults` picks the bad outputs: identities (`__lid`) or a predicate. Extra and
    overcounted outputs are traced through the program itself. A record that the program
    lost has no link to any output, so `direction='missing'` traces the same keys through
    `clean`, a fault-free program over the same source; without one all inputs are kept.
    """
    if direction == "extra":
        traced = program.lineage().where(faults).back_all().rows()
    elif clean is not None:
        traced = clean.lineage().where(faults).back_all().rows()
    else:
        traced = program.inputs().rows()
    return Localised(traced, ddmin(traced, test, order, **search))
