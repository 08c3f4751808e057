"""The operators' inputs, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backtrail.functions import strings as S
from backtrail.sources import parsers as P
from backtrail.sources.lines import text_lines

# The model: this many parts, with all their reviews.
CENTROIDS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of a few small files as many partitions as there are cores.

    A scan that has enough splits already, as any large table, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, value)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_lines(spread(docs, "doc_id"))


def turn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, line_no, value)."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return text_lines(turns)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, doc, content): one record per line of a document."""
    return doc_lines(spark, sf_dir).select(
        "doc_id", "line_no", F.col("doc_id").cast("string").alias("doc"),
        S.trim_control(F.col("value")).alias("content"),
    )


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem"), "l_orderkey")


def edges(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(src, dst): part to supplier."""
    part = F.concat(F.lit("P"), F.col("l_partkey").cast("string"))
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return lineitem(spark, sf_dir).select(*keep, part.alias("src"), supplier.alias("dst"))


def edge_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as text: part ids padded to eleven digits, `VertexID...,S...`."""
    part = F.concat(F.lit("VertexID"), F.lpad(F.col("l_partkey").cast("string"), 11, "0"))
    supplier = F.concat(F.lit("S"), F.col("l_suppkey").cast("string"))
    return lineitem(spark, sf_dir).select(F.concat_ws(",", part, supplier).alias("value"))


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): page to each link in its text."""
    links = F.regexp_extract_all(F.col("html"), F.lit('href="([^"]*)"'), F.lit(1))
    pages = table(spark, sf_dir, "pages").select("url", "html")
    return spread(pages, "url").select(F.col("url").alias("src"), F.explode(links).alias("dst"))


def reviews(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """(movie_id, pos, rater_id, rating): parts reviewed by suppliers."""
    return lineitem(spark, sf_dir).select(
        *keep,
        F.col("l_partkey").alias("movie_id"),
        F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice").alias("pos"),
        F.col("l_suppkey").alias("rater_id"),
        (F.lit(1) + F.col("l_linenumber") % 5).cast("int").alias("rating"),
    )


def rating_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reviews per line: `part:supplier_rating,order_rating`."""
    rating = (F.lit(1) + F.col("l_linenumber") % 5).cast("string")
    first = F.concat_ws("_", F.col("l_suppkey").cast("string"), rating)
    second = F.concat_ws("_", F.col("l_orderkey").cast("string"), rating)
    line = F.concat(F.col("l_partkey").cast("string"), F.lit(":"), first, F.lit(","), second)
    return lineitem(spark, sf_dir).select(line.alias("value"))


def centroid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in text: the most reviewed parts, each with its reviews."""
    all_reviews = reviews(spark, sf_dir)
    top = (
        all_reviews.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("movie_id")).limit(CENTROIDS)
    )
    slots = top.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("movie_id"))) - 1)
    first = Window.partitionBy("slot", "movie_id").orderBy("pos")
    kept = (
        all_reviews.join(F.broadcast(slots.select("slot", "movie_id")), "movie_id")
        .withColumn("rn", F.row_number().over(first))
    )
    packed = kept.groupBy("slot", "movie_id").agg(
        F.sort_array(F.collect_list(F.struct("rn", "rater_id", "rating"))).alias("r")
    )
    items = F.transform("r", lambda x: F.concat_ws("_", x["rater_id"].cast("string"), x["rating"].cast("string")))
    cells = [F.col("slot").cast("string"), F.lit("0.0"), F.col("movie_id").cast("string"),
             F.size("r").cast("string"), F.array_join(items, ",")]
    return packed.select(F.concat_ws(" ", *cells).alias("value"))


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_centroids(centroid_lines(spark, sf_dir))


def centroid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cluster_id, pos, rater_id, rating, movie_id): the same model, one row per review."""
    all_reviews = reviews(spark, sf_dir)
    top = (
        all_reviews.groupBy("movie_id").agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.desc("movie_id")).limit(CENTROIDS)
    )
    order = Window.orderBy(F.desc("movie_id"))
    slots = top.select("movie_id", (F.row_number().over(order) - 1).alias("cluster_id"))
    return all_reviews.join(F.broadcast(slots), "movie_id").select(
        "cluster_id", "pos", F.col("rater_id").cast("bigint").alias("rater_id"), "rating", "movie_id"
    )


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
