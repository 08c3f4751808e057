"""Parsers from text lines to typed columns.

Each takes a frame with a `value` column and keeps its other columns, so that record
identities pass through. `on_error` says what becomes of a malformed line: `fail` raises,
`drop` leaves it out, `null` keeps it with empty fields.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from backtrail.functions import strings as S
from backtrail.sources.lines import read_lines


def _others(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != "value"]


def _check(df: DataFrame, ok: Column, on_error: str) -> DataFrame:
    """Leave out or refuse rows that are not `ok`, unless they are to become empty."""
    if on_error not in ("fail", "drop", "null"):
        raise ValueError(f"on_error: {on_error}")
    kept = F.coalesce(ok, F.lit(False))
    if on_error == "drop":
        return df.filter(kept)
    if on_error == "fail":
        message = F.concat(F.lit("malformed line: "), F.substring("value", 1, 200))
        return df.filter(F.when(kept, True).otherwise(F.raise_error(message).cast("boolean")))
    return df


def _settle(df: DataFrame, fields: dict[str, Column], ok: Column, on_error: str) -> DataFrame:
    """Project to the parsed fields, treating rows that are not `ok` as asked."""
    if on_error == "null":
        fields = {name: F.when(ok, field) for name, field in fields.items()}
    checked = _check(df, ok, on_error)
    return checked.select(*_others(df), *[field.alias(name) for name, field in fields.items()])


def parse_edges(df: DataFrame, on_error: str = "drop") -> DataFrame:
    """`src,dst`, split at the last comma."""
    value = F.col("value")
    fields = {"src": S.before_last(value, ","), "dst": S.after_last(value, ",")}
    return _settle(df, fields, F.instr(value, ",") > 0, on_error)


def parse_documents(df: DataFrame, on_error: str = "fail") -> DataFrame:
    """`doc:content`, split at the last colon; a document name may hold colons."""
    value = F.col("value")
    fields = {
        "doc": S.before_last(value, ":"),
        "content": S.trim_control(S.after_last(value, ":")),
    }
    return _settle(df, fields, F.instr(value, ":") > 0, on_error)


def parse_ratings(df: DataFrame, on_error: str = "drop") -> DataFrame:
    """`movie:rater_rating,rater_rating,...`, one row per review."""
    value = F.col("value")
    movie = F.expr("try_cast(substring_index(value, ':', 1) AS BIGINT)")
    ok = S.has_key(value) & movie.isNotNull()
    items = S.split_nonempty(S.after_first(value, ":"), ",")
    if on_error == "null":
        found = F.posexplode_outer(F.when(ok, items))
        movie = F.when(ok, movie)
    else:
        found = F.posexplode(items)
    lines = _check(df, ok, on_error).withColumn("movie_id", movie)
    reviews = lines.select(*_others(lines), found.alias("pos", "value"))
    review = F.col("value")
    fields = {
        "rater_id": F.expr("try_cast(substring_index(value, '_', 1) AS BIGINT)"),
        "rating": S.after_first(review, "_").try_cast("int"),
    }
    ok = fields["rater_id"].isNotNull() & fields["rating"].isNotNull()
    return _settle(reviews, fields, ok, on_error)


def parse_phrase_counts(df: DataFrame, on_error: str = "drop") -> DataFrame:
    """`phrase|doc<TAB>count`: the last tab, then the last bar before it."""
    value = F.col("value")
    keyed = S.before_last(value, "\t")
    fields = {
        "phrase": S.before_last(keyed, "|"),
        "doc": S.after_last(keyed, "|"),
        "count": S.after_last(value, "\t").try_cast("bigint"),
    }
    ok = (F.instr(keyed, "|") > 0) & fields["count"].isNotNull()
    return _settle(df, fields, ok, on_error)


def parse_key_value(df: DataFrame, on_error: str = "drop") -> DataFrame:
    """The first two whitespace-separated tokens."""
    tokens = S.tokenize(F.col("value"))
    fields = {"key": F.get(tokens, F.lit(0)), "value": F.get(tokens, F.lit(1))}
    return _settle(df, fields, F.size(tokens) >= 2, on_error)


def parse_numbers(df: DataFrame, on_error: str = "fail") -> DataFrame:
    """One number per line."""
    number = S.trim_control(F.col("value")).try_cast("double")
    return _settle(df, {"n": number}, number.isNotNull(), on_error)


def parse_centroids(df: DataFrame, max_clusters: int | None = None) -> DataFrame:
    """`slot similarity movie total r_r,r_r,...`: the centroid model.

    Slots are renumbered by falling movie id; a movie id of -1 marks an unused slot.
    A repeated slot, or one at or above `max_clusters` if that is given, is an error.
    """
    tokens = S.tokenize(F.col("value"))
    review = "named_struct('rater_id', cast(substring_index(r, '_', 1) AS BIGINT)," \
             " 'rating', cast(substring_index(r, '_', -1) AS INT))"
    rows = df.select(
        F.get(tokens, F.lit(0)).cast("int").alias("slot"),
        F.get(tokens, F.lit(1)).cast("double").alias("similarity"),
        F.get(tokens, F.lit(2)).cast("bigint").alias("movie_id"),
        F.get(tokens, F.lit(3)).cast("int").alias("total"),
        S.split_nonempty(F.get(tokens, F.lit(4)), ",").alias("__reviews"),
    ).filter((F.col("slot") >= 0) & (F.col("movie_id") != -1))
    rows = rows.withColumn("reviews", F.expr(f"transform(__reviews, r -> {review})"))
    record = F.struct("movie_id", "similarity", "total", "reviews")
    slots = rows.groupBy("slot").agg(F.max(record).alias("c"), F.count(F.lit(1)).alias("n"))
    wrong = F.col("n") > 1
    if max_clusters is not None:
        wrong = wrong | (F.col("slot") >= max_clusters)
    text = F.concat(F.lit("slot is repeated or too large: "), F.col("slot").cast("string"))
    one_per_slot = slots.withColumn("c", F.when(wrong, F.raise_error(text)).otherwise(F.col("c")))
    order = Window.orderBy(F.desc("c.movie_id"), "slot")
    return one_per_slot.select(
        (F.row_number().over(order) - 1).alias("cluster_id"),
        "c.movie_id", "c.similarity", "c.total", "c.reviews",
    )


def read_centroids(spark: SparkSession, path: str, max_clusters: int | None = None) -> DataFrame:
    return parse_centroids(read_lines(spark, path), max_clusters)


def parse_expected(df: DataFrame, shape: str) -> DataFrame:
    """Typed rows of an expected-output text; list-valued outputs stay one row per item.

    Shapes (fixed values): counts `key count`, int_counts `rating count`, postings `word doc`,
    ranked `phrase count|doc`, terms `doc word:count`, members `cluster movie`, rest `cluster
    rest-of-line`, adjacency `vertex from{a,b}:to{c}`, tuple_counts `(key count)`.
    """
    value = F.col("value")
    tokens = S.tokenize(value)
    first, second = F.get(tokens, F.lit(0)), F.get(tokens, F.lit(1))
    if shape == "counts":
        fields = {"key": first, "count": second.cast("bigint")}
    elif shape == "int_counts":
        fields = {"rating": first.cast("int"), "count": second.cast("bigint")}
    elif shape == "postings":
        fields = {"word": first, "doc": second}
    elif shape == "ranked":
        fields = {"phrase": first, "posting": second}
    elif shape == "terms":
        fields = {
            "doc": first,
            "word": S.before_last(second, ":"),
            "count": S.after_last(second, ":").cast("bigint"),
        }
    elif shape == "members":
        fields = {"cluster_id": first.cast("int"), "movie_id": second.cast("bigint")}
    elif shape == "rest":
        rest = F.regexp_extract(value, r"(?s)^\s*\S+\s*(.*)$", 1)
        fields = {"cluster_id": first.cast("int"), "value": rest}
    elif shape == "adjacency":
        lists = r"^from\{(.*)\}:to\{(.*)\}$"
        fields = {"vertex": first}
        for group, name in ((1, "from"), (2, "to")):
            fields[name] = S.split_nonempty(F.regexp_extract(second, lists, group), ",")
    elif shape == "tuple_counts":
        inner = S.tokenize(F.regexp_replace(value, r"^\(|\)$", ""))
        fields = {"key": F.get(inner, F.lit(0)), "count": F.get(inner, F.lit(1)).cast("bigint")}
    else:
        raise ValueError(f"shape: {shape}")
    return df.select(*_others(df), *[field.alias(name) for name, field in fields.items()])


def read_expected(spark: SparkSession, path: str, shape: str) -> DataFrame:
    return parse_expected(read_lines(spark, path), shape)


@dataclass(frozen=True)
class Truth:
    """Expected rows read by the caller's own parser, and the lines it could not read."""

    rows: DataFrame
    unreadable: DataFrame


def parse_truth(lines: DataFrame, parser: Callable[[Column], Mapping[str, Column]],
                optional: Sequence[str] = ()) -> Truth:
    """Expected rows of any text layout.

    `parser` makes the fields from the line column; with `try_cast` and `regexp_extract` it
    gives null or an empty text where a line does not fit. A line of which a field that is
    not `optional` comes out null is unreadable: it is given back as it is, not dropped.
    """
    fields = dict(parser(F.col("value")))
    fits = F.lit(True)
    for name, field in fields.items():
        if name not in optional:
            fits = fits & field.isNotNull()
    marked = lines.select("value", *[f.alias(n) for n, f in fields.items()], fits.alias("__fits"))
    return Truth(marked.filter("__fits").select(*fields), marked.filter(~F.col("__fits")).select("value"))


def read_truth(spark: SparkSession, path: str, parser: Callable[[Column], Mapping[str, Column]],
               optional: Sequence[str] = ()) -> Truth:
    return parse_truth(read_lines(spark, path), parser, optional)
