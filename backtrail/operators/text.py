"""Word, phrase and pattern counts, document indexes and term vectors.

Every operator takes `by`, extra grouping columns, so that many trials or sources can
share one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.functions import strings as S
from backtrail.plans.groups import MAX_GROUP, TASK_CHARS, by_unit, gather, in_segments, keep_matching, large_groups, measure


def words(lines: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """One row per space-separated word of each line, empty words included."""
    return lines.select(*by, F.explode(S.split_words(F.col(value))).alias("word"))


def count_words(words_df: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return words_df.groupBy(*by, "word").agg(n.cast("bigint").alias("count"))


def word_count(lines: DataFrame, by: Sequence[str] = (), trimmed: bool = False) -> DataFrame:
    """(word, count). `trimmed` strips the line before splitting and each word after."""
    if trimmed:
        lines = lines.withColumn("value", S.trim_control(F.col("value")))
    found = words(lines, by)
    if trimmed:
        found = found.withColumn("word", S.trim_control(F.col("word")))
    return count_words(found, by)


def matches(lines: DataFrame, pattern: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per non-overlapping match, holding the whole matched text."""
    found = F.regexp_extract_all(F.col("value"), F.lit(pattern), F.lit(0))
    return lines.select(*by, F.explode(found).alias("match"))


def grep_count(lines: DataFrame, pattern: str, by: Sequence[str] = ()) -> DataFrame:
    """(match, count) over all matches of a regular expression."""
    found = matches(lines, pattern, by)
    return found.groupBy(*by, "match").agg(F.count(F.lit(1)).alias("count"))


def phrases(docs: DataFrame, n: int = 3, by: Sequence[str] = ()) -> DataFrame:
    """One row per n-word window of each record; shorter records give none."""
    worded = docs.select(*by, "doc", S.tokenize(F.col("content")).alias("__w"))
    starts = F.explode_outer(F.sequence(F.lit(0), F.size("__w") - n))
    windows = worded.filter(F.size("__w") >= n).select(*by, "doc", "__w", starts.alias("__i"))
    window = F.concat_ws("|", *[F.get("__w", F.col("__i") + k) for k in range(n)])
    return windows.select(*by, "doc", window.alias("phrase"))


def sequence_count(docs: DataFrame, n: int = 3, by: Sequence[str] = (), most: int = TASK_CHARS) -> DataFrame:
    """(phrase, doc, count) of n-word windows that stay inside one record.

    The records of a document meet in one exchange of their texts, and its windows are
    counted where they are made. Of a document with more than `most` characters the windows
    are exchanged instead.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return phrases(rows, n, by).groupBy(*by, "phrase", "doc").agg(F.count(F.lit(1)).alias("count"))

    together, apart = by_unit(docs.select(*by, "doc", "content"), [*by, "doc"], "content", most)
    return counted(together) if apart is None else counted(together).unionByName(counted(apart))


def doc_words(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per token and record: (word, doc)."""
    return docs.select(*by, "doc", F.explode(S.split_words(F.col("content"))).alias("word"))


def postings(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The index in long form: (word, doc, count), one row per word and document.

    Like phrases, words are counted where the records of their document meet, unless it is
    too large for that.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return doc_words(rows, by).groupBy(*by, "word", "doc").agg(F.count(F.lit(1)).alias("count"))

    together, apart = by_unit(docs.select(*by, "doc", "content"), [*by, "doc"], "content")
    return counted(together) if apart is None else counted(together).unionByName(counted(apart))


def posting_counts(docs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(word, postings): occurrences of each word in all records."""
    return doc_words(docs, by).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("postings"))


def document_counts(phrase_counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(phrase, documents): in how many documents each phrase stands."""
    return phrase_counts.groupBy(*by, "phrase").agg(F.count(F.lit(1)).alias("documents"))


def term_counts(docs: DataFrame, min_count: int = 2, per: Sequence[str] = ("doc",),
                by: Sequence[str] = ()) -> DataFrame:
    """(per..., n_terms, top_count): of the terms seen at least `min_count` times."""
    unit = [*by, *dict.fromkeys(per)]
    terms = docs.select(*unit, F.explode(S.split_words(F.col("content"))).alias("term"))
    counts = terms.groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("count"))
    return counts.filter(F.col("count") >= min_count).groupBy(*unit).agg(
        F.count(F.lit(1)).alias("n_terms"), F.max("count").alias("top_count"))


def inverted_index(docs: DataFrame, distinct: bool = True, by: Sequence[str] = (),
                   max_group: int | None = MAX_GROUP) -> DataFrame:
    """(word, segment, docs): the sorted documents of each word.

    With `distinct=False` a document stands once per occurrence. A word with more than
    `max_group` postings continues in further segments.

    Words are counted first, with partial counts in every task. Those that can have no more
    than `max_group` postings are gathered in one exchange, sets of documents being built in
    the tasks before it; only the others are numbered across the cluster.
    """
    keys = [*by, "word"]
    if distinct:
        found = doc_words(docs, by)
        if max_group is None:
            return _sets(found, keys)
        large = measure(large_groups(found, keys, max_group))
        if large.empty:
            return _sets(found, keys)
        cold = _sets(keep_matching(found, large, keys, anti=True), keys)
        hot = keep_matching(found, large, keys).dropDuplicates()
        return cold.unionByName(in_segments(hot, keys, ["doc"], "docs", max_group))
    found = postings(docs, by)
    run = max_group or MAX_GROUP
    last = F.floor((F.col("count") - 1) / F.lit(run)).cast("bigint")
    pieces = F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    copies = F.least(F.lit(run).cast("bigint"), F.col("count") - F.col("piece") * run)
    runs = found.select("*", pieces.alias("piece")).withColumn("copies", copies)
    packed = gather(runs, keys, ["doc", "piece"], "runs", carry=["copies"], max_group=max_group,
                    weight="copies")
    repeated = F.flatten(
        F.transform("runs", lambda r: F.array_repeat(r["doc"], r["copies"].cast("int")))
    )
    return packed.select(*keys, "segment", repeated.alias("docs"))


def _sets(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    docs = F.sort_array(F.collect_set("doc")).alias("docs")
    return found.groupBy(*keys).agg(docs).select(*keys, F.lit(0).cast("bigint").alias("segment"), "docs")


def by_word(index: DataFrame) -> DataFrame:
    """The index in the order of its words, and within a word of its segments."""
    return index.orderBy("word", "segment")


def ranked_inverted_index(phrase_counts: DataFrame, by: Sequence[str] = (),
                          max_group: int | None = MAX_GROUP, top: int | None = None) -> DataFrame:
    """(phrase, segment, postings): documents by falling count, then by name.

    Segments follow the ranking, so segment 0 holds the leading postings of a phrase. With
    `top` only that many postings of a phrase stay: each task keeps its own leaders before
    the rows are shuffled, so a phrase in very many documents is not gathered either.
    """
    ranked = phrase_counts.select(
        *by, "phrase", (-F.col("count")).alias("__down"), F.col("doc").alias("file")
    )
    if top is not None:
        place = F.row_number().over(Window.partitionBy(*by, "phrase").orderBy("__down", "file"))
        ranked = ranked.withColumn("__place", place).filter(F.col("__place") <= top).drop("__place")
        max_group = None if top <= MAX_GROUP else max_group
    return gather(
        ranked, [*by, "phrase"], ["__down", "file"], "postings",
        lambda e: F.struct((-e["__down"]).alias("count"), e["file"].alias("file")),
        max_group=max_group,
    )


def term_vector(docs: DataFrame, min_count: int = 2, per: Sequence[str] = ("doc",),
                by: Sequence[str] = (), max_group: int | None = MAX_GROUP) -> DataFrame:
    """(per..., segment, terms): terms seen at least `min_count` times, most frequent first.

    `per` names the columns of a unit: the document, or a record within it. Units without
    such a term give no row.

    The terms of a unit are counted and gathered in one exchange by unit. Units that could
    have more than `max_group` such terms, by the number of their words, which is summed
    first, are counted by unit and term instead and numbered across the cluster.
    """
    unit = [*by, *dict.fromkeys(per)]
    words = docs.select(*unit, S.split_words(F.col("content")).alias("__words"))

    def frequent(rows: DataFrame) -> DataFrame:
        counts = rows.groupBy(*unit, "term").agg(F.count(F.lit(1)).alias("count"))
        return counts.filter(F.col("count") >= min_count).select(*unit, (-F.col("count")).alias("__down"), "term")

    def exploded(rows: DataFrame) -> DataFrame:
        return rows.select(*unit, F.explode("__words").alias("term"))

    def item(e: Column) -> Column:
        return F.struct(e["term"].alias("term"), (-e["__down"]).alias("count"))

    def together(rows: DataFrame) -> DataFrame:
        # The partitioning by unit serves the counts and the arrays.
        return gather(frequent(exploded(rows.repartition(*unit))), unit, ["__down", "term"], "terms", item, max_group=None)

    if max_group is None:
        return together(words)
    most = words.groupBy(*unit).agg(F.sum(F.size("__words")).alias("__n")).filter(
        F.col("__n") > max_group * min_count).select(*unit)
    large = measure(most)
    if large.empty:
        return together(words)
    hot = frequent(exploded(keep_matching(words, large, unit)))
    return together(keep_matching(words, large, unit, anti=True)).unionByName(
        in_segments(hot, unit, ["__down", "term"], "terms", max_group, item))


def docs_text(column: str = "docs") -> Column:
    """`d1,d2`."""
    return F.array_join(column, ",")


def postings_text(column: str = "postings") -> Column:
    """`count|file` items joined by commas."""
    items = F.transform(column, lambda p: F.concat_ws("|", p["count"].cast("string"), p["file"]))
    return F.array_join(items, ",")


def terms_text(column: str = "terms") -> Column:
    """`term-count` items joined by commas."""
    items = F.transform(column, lambda t: F.concat_ws("-", t["term"], t["count"].cast("string")))
    return F.array_join(items, ",")
