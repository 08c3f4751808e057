"""Line dedup: repeated runs of lines, found in a suffix array over line ids.

The suffix array is built by prefix doubling, distributed: a suffix's rank among all
suffixes by their first line comes from a range sort of the distinct line ids, its rank by
2, 4, ... lines from a sort of the distinct pairs (rank here, rank that many lines on).
Suffixes that share their first `min_lines` lines lie next to each other in that order:
they are an interval whose longest common prefix is at least `min_lines`. The first of an
interval, by document and line, stays; lines of the later copies are deleted. A maximal
repeated run is the union of its windows of `min_lines` lines, so sorting deeper than
`min_lines` lines could not change what is deleted, and doubling stops there. A suffix
whose rank is its own alone has no repeat and leaves the next rounds.

Longer runs come out of those windows: consecutive windows of a document whose first
occurrences are consecutive in one other document are one maximal run. So the number and
the length of the maximal runs are known without deeper ranks.

With `min_words`, a repeated run of fewer lines is deleted too if it holds that many words.
Ranks then grow line by line, and each length below `min_lines` is looked at. Shorter runs
of fewer words count as clean.

Only DataFrame functions are used. Groups are counted before they are joined, so a line or
run that a third of the documents hold is one row of the sorted side.

Null text stays null. Blank lines are neither matched nor deleted, and runs are judged
across them. Rows that repeat a doc_id and its text count as one document. A null doc_id
sorts first. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from backtrail.llm.common import fresh
from backtrail.session import durable, stored

MIN_LINES = 3
MIN_WORDS = 20
_BLANK_FREE = r"[^\x20\x09-\x0D]"
_WORD = r"[^\x20\x09-\x0D]+"
_DOC = ["doc_id", "fp"]


def fingerprint(text: str = "text") -> Column:
    """With doc_id, it tells documents apart."""
    return F.xxhash64(text)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_ids(docs: DataFrame, words: bool = False) -> DataFrame:
    """(doc_id, fp, pos, id1, id2): the non-blank lines, numbered from 0 in their document.

    A line id is two 64-bit hashes of the line. With `words`, their number is added.
    """
    held = F.filter(_lines(F.col("text")), lambda x: x.rlike(_BLANK_FREE))
    # The outer form: for the other, Spark would split each text twice to test for lines.
    rows = docs.select("doc_id", fingerprint().alias("fp"), F.posexplode_outer(held).alias("pos", "line"))
    n_words = [F.regexp_count("line", F.lit(_WORD)).alias("words")] if words else []
    return rows.filter(F.col("pos").isNotNull()).select(*_DOC, "pos", F.xxhash64("line").alias("id1"),
                       F.xxhash64(F.lit(7), "line", F.lit(11)).alias("id2"), *n_words)


def _ranked(suffixes: DataFrame, by: list[str], label: str, *keep: str) -> DataFrame:
    """(doc_id, fp, pos, rank, first, *keep): suffixes of which another has the same `by`.

    The rank orders the distinct values of `by`; `first` is the earliest place of each.
    """
    place = F.struct(*_DOC, "pos")
    groups = suffixes.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    groups = groups.filter(F.col("n") > 1).repartitionByRange(*by).sortWithinPartitions(*by)
    ranks = durable(groups.select(*by, "first", F.monotonically_increasing_id().alias("rank")))
    joined = suffixes.join(ranks, by).select(*_DOC, "pos", "rank", "first", *keep)
    return stored(joined, label)


def repeated_suffixes(lines: DataFrame, depth: int) -> DataFrame:
    """(doc_id, fp, pos, rank, first): suffixes that share their first `depth` lines."""
    if depth < 1:
        raise ValueError("depth must be at least 1")
    suffixes, length = _ranked(lines, ["id1", "id2"], "line-ranks"), 1
    while length < depth:
        step = min(length, depth - length)
        ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(step, step)
        pairs = suffixes.select(*_DOC, "pos", F.col("rank").alias("here"),
                                F.max("rank").over(ahead).alias("next"))
        pairs = pairs.filter(F.col("next").isNotNull())
        suffixes, length = _ranked(pairs, ["here", "next"], "run-ranks"), length + step
    return suffixes


def repeated_runs(lines: DataFrame, depth: int) -> list[DataFrame]:
    """For 1 to `depth` lines: (doc_id, fp, pos, rank, first, words, run_words) of repeated runs.

    `lines` has the words of each line.
    """
    if depth < 1:
        raise ValueError("depth must be at least 1")
    lines = lines.withColumn("run_words", F.col("words"))
    runs = [_ranked(lines, ["id1", "id2"], "line-ranks", "words", "run_words")]
    ahead = Window.partitionBy(*_DOC).orderBy("pos").rangeBetween(1, 1)
    while len(runs) < depth:
        pairs = runs[-1].select(*_DOC, "pos", "words", F.col("rank").alias("here"), F.max("rank").over(ahead).alias("next"),
                                (F.col("words") + F.max("run_words").over(ahead)).alias("run_words"))
        pairs = pairs.filter(F.col("next").isNotNull())
        runs.append(_ranked(pairs, ["here", "next"], "run-ranks", "words", "run_words"))
    return runs


def maximal_runs(found: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, fp, pos, lines, first): the later copies of maximal repeated runs of lines.

    `found` has the repeated windows of `min_lines` lines and the first place of each. `first`
    is the place of the run's first occurrence.
    """
    later = found.filter(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first")))
    same = [*_DOC, F.col("first.doc_id"), F.col("first.fp"), F.col("first.pos") - F.col("pos")]
    number = F.row_number().over(Window.partitionBy(*same).orderBy("pos"))
    rows = later.select(*_DOC, "pos", "first", (F.col("first.pos") - F.col("pos")).alias("shift"),
                        (F.col("pos") - number).alias("island"))
    return rows.groupBy(*_DOC, F.col("first.doc_id").alias("first_doc"), F.col("first.fp").alias("first_fp"), "shift", "island").agg(
        F.min("pos").alias("pos"), (F.count(F.lit(1)) + (min_lines - 1)).alias("lines"), F.min("first").alias("first")).select(
            *_DOC, "pos", "lines", "first")


def repeated_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """(doc_id, fp, removed, n_runs, longest_run): the numbers of the non-blank lines that later
    copies hold, and the maximal runs of `min_lines` lines or more among them.
    """
    last = F.lit(min_lines - 1)
    if min_words is None:
        windows = repeated_suffixes(line_ids(docs), min_lines)
        found = windows.withColumn("last", last)
    else:
        *short, windows = repeated_runs(line_ids(docs, words=True), min_lines)
        found = windows.withColumn("last", last)
        for i, runs in enumerate(short):
            found = found.unionByName(runs.filter(F.col("run_words") >= min_words).withColumn("last", F.lit(i)))
    later = found.filter(~F.struct(*_DOC, "pos").eqNullSafe(F.col("first")))
    starts = later.groupBy(*_DOC).agg(F.collect_set(F.struct("pos", "last")).alias("starts"))
    covered = F.flatten(F.transform("starts", lambda p: F.sequence(p["pos"], p["pos"] + p["last"])))
    removed = starts.select(*_DOC, F.array_distinct(covered).alias("removed"))
    runs = maximal_runs(windows, min_lines).groupBy(*_DOC).agg(
        F.count(F.lit(1)).alias("n_runs"), F.max("lines").alias("longest_run")).select(
            F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"), "n_runs", "longest_run")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp"))
    return removed.join(runs, same, "left").select(*_DOC, "removed", "n_runs", "longest_run")


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, drop_emptied: bool = True,
                min_words: int | None = None) -> DataFrame:
    """`docs` with the later copies of repeated runs of lines deleted from `text`.

    A run has `min_lines` lines, or `min_words` words if that is given.

    Added are n_lines and n_lines_removed (non-blank lines; 0 for null text), and n_runs and
    longest_run, the number of maximal repeated runs of `min_lines` lines or more that the
    document has as a later copy, and the lines of the longest (0 without one).
    Columns of these names are replaced. With `drop_emptied`, documents of which no line
    was left go; documents that had no line before stay.
    """
    docs = docs.drop("n_lines", "n_lines_removed", "n_runs", "longest_run")
    fp, gone, lines, held, keep, own_doc, own_fp, runs, longest = fresh(
        docs, "fp", "removed", "lines", "held", "keep", "__doc", "__fp", "n_runs", "longest_run")
    removed = repeated_lines(docs, min_lines, min_words).select(
        F.col("doc_id").alias(own_doc), F.col("fp").alias(own_fp), F.col("removed").alias(gone),
        F.col("n_runs").alias(runs), F.col("longest_run").alias(longest))
    same = F.col("doc_id").eqNullSafe(F.col(own_doc)) & (F.col(fp) == F.col(own_fp))
    joined = docs.withColumn(fp, fingerprint()).join(removed, same, "left")
    numbered = F.transform(_lines(F.col("text")), lambda x, i: F.when(x.rlike(_BLANK_FREE), i))
    rows = joined.withColumn(lines, _lines(F.col("text")))
    rows = rows.withColumn(held, F.filter(numbered, lambda i: i.isNotNull()))
    at = F.transform(F.col(gone), lambda p: F.get(F.col(held), p))
    rows = rows.withColumn(keep, F.when(F.size(lines) > 0, F.array_except(
        F.sequence(F.lit(0), F.size(lines) - 1), at)))
    text = F.array_join(F.transform(F.col(keep), lambda i: F.get(F.col(lines), i)), "\n")
    n_lines = F.coalesce(F.size(held), F.lit(0)).cast("bigint")
    n_removed = F.coalesce(F.size(gone), F.lit(0)).cast("bigint")
    hit = F.col(gone).isNotNull()
    rows = rows.select(
        *[F.when(hit, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
          for c in docs.columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.when(hit, n_removed).otherwise(F.lit(0)).cast("bigint").alias("n_lines_removed"),
        F.coalesce(F.col(runs), F.lit(0)).cast("bigint").alias("n_runs"),
        F.coalesce(F.col(longest), F.lit(0)).cast("bigint").alias("longest_run"))
    if drop_emptied:
        emptied = (F.col("n_lines") > 0) & (F.col("n_lines") == F.col("n_lines_removed"))
        rows = rows.filter(~emptied)
    return rows
