"""The registered query of each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from backtrail.llm import (alignment, collisions, decontaminate, html_text, language_id, line_dedup, mixing, near_dedup,
                           neighbours, quality, spelling, substring_dedup, toxicity)
from backtrail.llm.common import remainder, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    LLM_QUERIES[f.__name__] = f
    return f


def held_out(modulus: int, value: int) -> F.Column:
    return F.coalesce(remainder("doc_id", modulus) == value, F.lit(False))


@query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = decontaminate.report(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                       F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
                       "contaminated")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, drop_emptied=False, min_words=line_dedup.MIN_WORDS).select(
        "doc_id", "n_lines", "n_lines_removed", "n_runs", "longest_run", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query
def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "kept")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.positions(mixing.plan(docs))
    return rows.select("doc_id", "size", "source_size", "target",
                       (F.col("size") * F.col("copies")).cast("bigint").alias("taken"),
                       F.round("first_position", 9).alias("first_position"),
                       F.round("last_position", 9).alias("last_position"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder("doc_id", 5) != 0)
    return toxicity.score(docs, model).select(
        "doc_id", held_out(5, 0).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query
def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours.search(vectors, F.col("vec_id") % 50 == 0, 5)


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs, remainder("doc_id", 3) != 1)
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score", "accepted")


@query
def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality.measure(table(spark, sf_dir, "documents").select("doc_id", "text"))
    model = quality.fit(measured, table(spark, sf_dir, "labels"), remainder("doc_id", 4) != 2)
    return quality.score(measured, model).select(
        "doc_id", held_out(4, 2).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


@query
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collisions.near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
