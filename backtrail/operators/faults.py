"""Output marks, and deliberate faults for evaluating localisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAULTY = "__faulty"


def mark(df: DataFrame, predicate: Column) -> DataFrame:
    """Add the boolean `__faulty`; an undecided predicate counts as sound."""
    return df.withColumn(FAULTY, F.coalesce(predicate, F.lit(False)))


# The output predicates and their thresholds.

def count_at_least(n: int = 3) -> Column:
    """Word counted n times or more."""
    return F.col("count") >= n


def postings_over(n: int = 3) -> Column:
    """Word with more than n postings, repeats counted."""
    return F.col("postings") > n


def documents_over(n: int = 1) -> Column:
    """Phrase found in more than n documents."""
    return F.col("documents") > n


def count_over(n: int = 3) -> Column:
    return F.col("count") > n


def busy_terms(count: int = 2, terms: int = 2) -> Column:
    """Some term above `count`, and more than `terms` terms."""
    return (F.col("top_count") > count) & (F.col("n_terms") > terms)


def out_degree_over(n: int = 438) -> Column:
    return F.col("out_degree") > n


def smaller_than(n: int = 60) -> Column:
    """Cluster with fewer than n members."""
    return F.col("size") < n


# The seeded faults.

def double_prefix(prefix: str) -> Column:
    """Weight of a word: 2 when it starts with the prefix."""
    return F.when(F.col("word").startswith(prefix), 2).otherwise(1)


def double_counts(df: DataFrame) -> DataFrame:
    return df.withColumn("count", F.col("count") * 2)


def drop_low_ratings(ratings: DataFrame) -> DataFrame:
    """Lose ratings 1 and 2 of raters divisible by 13."""
    lost = F.col("rating").isin(1, 2) & (F.col("rater_id") % 13 == 0)
    return ratings.filter(~lost)


def drop_lowest_ratings(ratings: DataFrame) -> DataFrame:
    """Lose rating 1 of movies divisible by 13 and raters by all of 13, 7, 24 and 16."""
    rater = F.lit(True)
    for divisor in (13, 7, 24, 16):
        rater = rater & (F.col("rater_id") % divisor == 0)
    lost = (F.col("rating") == 1) & (F.col("movie_id") % 13 == 0) & rater
    return ratings.filter(~lost)


def drop_edge_lines(lines: DataFrame, slice_text: str = "10642", at: int = 14) -> DataFrame:
    """Lose edge lines holding the given text at the given offset."""
    return lines.filter(F.substring("value", at + 1, len(slice_text)) != slice_text)


def rewrite_destination(facts: DataFrame, src: str = "VertexID00006510642_31",
                        dst: str = "VertexIDA") -> DataFrame:
    """Edge facts with the `to` neighbours of one vertex replaced; the other ends stay."""
    wrong = (F.col("vertex") == src) & (F.col("side") == "to")
    return facts.withColumn("neighbour", F.when(wrong, F.lit(dst)).otherwise(F.col("neighbour")))


def shift_cluster(assigned: DataFrame, movie_id: int = 1) -> DataFrame:
    """Put one movie into the next cluster."""
    moved = F.when(F.col("movie_id") == movie_id, F.col("cluster_id") + 1)
    return assigned.withColumn("cluster_id", moved.otherwise(F.col("cluster_id")))


def drop_movie(ratings: DataFrame, movie_id: int = 1) -> DataFrame:
    return ratings.filter(F.col("movie_id") != movie_id)


def double_file_counts(ranked: DataFrame, part: str = "12345") -> DataFrame:
    """Double the counts of matching files after ranking, which leaves them out of order."""
    changed = F.transform(
        "postings",
        lambda p: F.when(
            p["file"].contains(part),
            F.struct((p["count"] * 2).alias("count"), p["file"].alias("file")),
        ).otherwise(p),
    )
    return ranked.withColumn("postings", changed)
