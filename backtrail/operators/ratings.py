"""Rating histograms, nearest-centroid classification and one k-means step.

Ratings are rows (movie_id, pos, rater_id, rating); `pos` orders the reviews of a movie.
Centroids are rows (cluster_id, movie_id, similarity, total, reviews), or one row per
review (cluster_id, pos, rater_id, rating), which no cluster's size limits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.functions import strings as S
from backtrail.plans.groups import MAX_GROUP, gather, measure, number_rows
from backtrail.session import durable

# Fixed value: reviews are cut at the first comma at or after this offset of a line.
REVIEW_OFFSET = 1000
# Similarities are compared in steps of 1e-9, in the bits above those of a cluster id, an int.
SIMILARITY_STEPS, ID_BITS = 1_000_000_000, 31
LAST_ID = (1 << ID_BITS) - 1


def ratings_histogram(ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ratings.groupBy(*by, "rating").agg(F.count(F.lit(1)).alias("count"))


def centroid_reviews(centroids: DataFrame) -> DataFrame:
    """(cluster_id, rater_id, c_rating): each rater's first review within `total`."""
    if "reviews" not in centroids.columns:
        return centroids.groupBy("cluster_id", "rater_id").agg(F.min_by("rating", "pos").alias("c_rating"))
    flat = centroids.select("cluster_id", "total", F.posexplode("reviews").alias("c_pos", "r"))
    within = flat.filter(F.col("c_pos") < F.col("total"))
    return within.groupBy("cluster_id", F.col("r.rater_id").alias("rater_id")).agg(
        F.min_by(F.col("r.rating"), "c_pos").alias("c_rating")
    )


def match_centroids(ratings: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each rating with the centroid reviews of its rater; unmatched ratings stay.

    A rating meets one review per cluster at most.
    """
    reviews = measure(centroid_reviews(centroids))
    return ratings.join(reviews.frame(), "rater_id", "left")


def score(matched: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(movie_id, cluster_id, similarity) of the best cluster from matched ratings.

    The sums are exact integers and similarity is rounded to nine places before clusters
    are compared. Ties and movies without a match go to the lowest cluster id.
    """
    r, c = F.col("rating").cast("bigint"), F.col("c_rating").cast("bigint")
    sums = matched.groupBy(*by, "movie_id", "cluster_id").agg(
        F.sum(r * c).alias("numer"),
        F.sum(F.when(c.isNotNull(), r * r)).alias("sq_r"),
        F.sum(c * c).alias("sq_c"),
    )
    denom = F.sqrt("sq_r") * F.sqrt("sq_c")
    sim = F.round(F.when(denom > 0, F.col("numer") / denom), 9)
    # One number holds both: similarity first, then the lower cluster id. Its greatest
    # value needs no sort, unlike that of a struct.
    rank = F.shiftleft(F.round(sim * SIMILARITY_STEPS).cast("bigint"), ID_BITS) + (
        F.lit(LAST_ID).cast("bigint") - F.col("cluster_id"))
    fits = F.col("cluster_id") >= 0
    rank = F.when(fits, rank).otherwise(F.raise_error(F.lit("cluster ids must not be negative")).cast("bigint"))
    ranked = sums.withColumn("rank", F.when(sim > 0, rank))
    best = ranked.groupBy(*by, "movie_id").agg(F.max("rank").alias("rank"))
    cluster = F.lit(LAST_ID) - F.col("rank").bitwiseAND(F.lit(LAST_ID))
    similarity = F.shiftright("rank", ID_BITS) / F.lit(float(SIMILARITY_STEPS))
    return best.select(
        *by, "movie_id",
        F.coalesce(cluster, F.lit(0)).cast("int").alias("cluster_id"),
        F.coalesce(similarity, F.lit(0.0)).alias("similarity"),
    )


def classify(ratings: DataFrame, centroids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(movie_id, cluster_id, similarity): the most similar centroid of each movie."""
    needed = ratings.select(*by, "movie_id", "rater_id", "rating")
    return score(match_centroids(needed, centroids), by)


def cluster_members(assigned: DataFrame, by: Sequence[str] = (),
                    max_group: int | None = MAX_GROUP) -> DataFrame:
    """(cluster_id, segment, movie_ids): sorted members, in bounded segments."""
    return gather(assigned, [*by, "cluster_id"], ["movie_id"], "movie_ids", max_group=max_group)


def cluster_sizes(assigned: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return assigned.groupBy(*by, "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def truncate_reviews(line: Column, offset: int = REVIEW_OFFSET) -> Column:
    """Cut a ratings line at the first comma at or after `offset`."""
    return S.cut_after(line, offset)


def centre_reviews(assigned: DataFrame, ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(cluster_id, similarity, movie_id, pos, rater_id, rating): the reviews of the new centroids.

    The member whose similarity is nearest the cluster's mean becomes its centroid; ties
    go to the lowest movie id. Means come from exact decimal sums with map-side partial
    aggregation, so no cluster is gathered. Of a winner's reviews those stay that start
    before the cut of its line; since a review takes a character at least, its comma, each
    task first keeps as many as could, and a movie with very many reviews is not gathered.
    """
    keys = [*by, "cluster_id"]
    means = assigned.groupBy(*keys).agg(
        F.sum(F.col("similarity").cast("decimal(20,9)")).alias("__sum"),
        F.count(F.lit(1)).alias("__n"),
    ).select(*keys, (F.col("__sum").cast("double") / F.col("__n")).alias("__mean"))
    with_mean = assigned.join(measure(means).frame(), keys)
    gap = F.round(F.abs(F.col("__mean") - F.col("similarity")), 9)
    winners = with_mean.groupBy(*keys).agg(
        F.min_by(F.struct("movie_id", "similarity"), F.struct(gap, F.col("movie_id"))).alias("w")
    ).select(*keys, "w.movie_id", "w.similarity")
    place = Window.partitionBy(*keys, "movie_id").orderBy("pos")
    rows = ratings.join(measure(winners).frame(), [*by, "movie_id"]).select(
        *keys, "similarity", "movie_id", "pos", "rater_id", "rating")
    rows = rows.withColumn("__place", F.row_number().over(place)).filter(
        F.col("__place") < REVIEW_OFFSET)
    # A review counts with the comma behind it; `movie:` stands before the first.
    width = F.length(review_text()) + 1
    start = F.length(F.col("movie_id").cast("string")) + 1 + F.coalesce(
        F.sum(width).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("__start", start).filter((F.col("__place") == 1) | (F.col("__start") <= REVIEW_OFFSET))
    return rows.drop("__place", "__start")


def review_text() -> Column:
    """`rater_rating`."""
    return F.concat_ws("_", F.col("rater_id").cast("string"), F.col("rating").cast("string"))


def centre_lines(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(cluster_id, similarity, movie_id, n_reviews, reviews): one row per new centroid."""
    keys = [*by, "cluster_id", "similarity", "movie_id"]
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", review_text().alias("t")))),
                                    lambda r: r["t"]), ",")
    return rows.groupBy(*keys).agg(
        F.count(F.when(review_text() != "", 1)).alias("n_reviews"), text.alias("reviews"))


def recenter(assigned: DataFrame, ratings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(cluster_id, similarity, movie_id, n_reviews, reviews): the new centroids."""
    return centre_lines(centre_reviews(assigned, ratings, by), by)


def next_model(rows: DataFrame) -> DataFrame:
    """(cluster_id, pos, rater_id, rating) from new centroids' reviews: a model that `classify` reads.

    As when a model is read from its lines, clusters are renumbered by falling movie id.
    """
    centres = rows.select("cluster_id", (-F.col("movie_id")).alias("__down")).distinct()
    slots = number_rows(centres, [], ["__down", "cluster_id"], "__slot")
    slots = measure(slots.select(F.col("cluster_id").alias("__old"), (F.col("__slot") - 1).cast("int").alias("__new")))
    joined = rows.join(slots.frame(), F.col("cluster_id") == F.col("__old"))
    return joined.select(F.col("__new").alias("cluster_id"), "pos", F.col("rater_id").cast("bigint").alias("rater_id"), "rating")


def kmeans_step(ratings: DataFrame, centroids: DataFrame,
                by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """One iteration: the members with their clusters, and the new centroid rows.

    The members are used three times, so they are computed once and kept.
    """
    assigned = durable(classify(ratings, centroids, by))
    return assigned, recenter(assigned, ratings, by)


def kmeans(ratings: DataFrame, centroids: DataFrame, steps: int) -> tuple[DataFrame, DataFrame]:
    """As many steps, each on the centroids of the one before: the last members and centroids.

    Members and centroids of a step are cut from what made them, so a plan holds one step
    and lost executors cost no more than one.
    """
    model = centroids
    for _ in range(steps):
        assigned = durable(classify(ratings, model))
        rows = durable(centre_reviews(assigned, ratings))
        model = next_model(rows)
    return assigned, centre_lines(rows)
