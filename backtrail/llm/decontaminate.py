"""Benchmark decontamination: a broadcast set of test n-grams probed by every window.

Words are the runs of digits, letters and non-ASCII characters after A-Z are lower-cased.
A test window is 10 consecutive words of an item; an item of fewer words, but not none, is
one window. Window hashes of a document are built from arrays of word hashes by doubling
(1, 2, 4, 8 words), so each takes a few steps whatever its length. They are exploded
and joined with the set of test windows; the documents with hits are looked at again, and a
hit counts when the words themselves agree.

The set is broadcast when it is counted at no more than BROADCAST_WINDOWS; a larger one is
joined by a shuffle on the hash. Only hits are shuffled by document. All of it is DataFrame
functions.

Null texts have no words. A null item_id marks words but is not listed. Rows that repeat a
doc_id and its text get the same answer; a null doc_id is an id like others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import fresh
from backtrail.llm.line_dedup import fingerprint
from backtrail.plans.groups import measure
from backtrail.session import durable, stored

WINDOW = 10
BROADCAST_WINDOWS = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PIECES = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_DOC = ["doc_id", "fp"]


def words(text: Column) -> Column:
    """The array of words; empty for null."""
    # For ASCII texts `lower` does the same as `translate`, faster.
    lowered = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    parts = F.array_remove(F.split(lowered, SEPARATORS), "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def with_windows(df: DataFrame, words_col: str, lengths: Iterable[int], out: str) -> DataFrame:
    """`df` and an array column of all window hashes, for each length in turn, by position."""
    lengths = sorted(set(lengths), reverse=True)
    kept = df.columns
    df = df.withColumn("__p1", F.transform(words_col, lambda w: F.xxhash64(w)))

    def paired(frame: DataFrame, name: str, left: str, right: str, shift: int, size: int) -> DataFrame:
        count = F.greatest(F.size("__p1") - (size - 1), F.lit(0))
        pair = F.zip_with(F.slice(F.col(left), F.lit(1), count),
                          F.slice(F.col(right), F.lit(shift + 1), count), lambda x, y: F.xxhash64(x, y))
        return frame.withColumn(name, pair)

    power = 2
    while lengths and power <= lengths[0]:
        df = paired(df, f"__p{power}", f"__p{power // 2}", f"__p{power // 2}", power // 2, power)
        power *= 2
    arrays = []
    for length in lengths:
        bits = [1 << b for b in range(length.bit_length()) if length >> b & 1][::-1]
        name, done = f"__p{bits[0]}", bits[0]
        for bit in bits[1:]:
            df = paired(df, f"__w{length}_{done + bit}", name, f"__p{bit}", done, done + bit)
            name, done = f"__w{length}_{done + bit}", done + bit
        of_length = F.lit(length)
        salted = F.transform(F.col(name), lambda h: F.xxhash64(h, of_length))  # noqa: B023
        df = df.withColumn(f"__h{length}", salted)
        arrays.append(f"__h{length}")
    joined = F.concat(*arrays) if arrays else F.array().cast("array<bigint>")
    return df.select(*kept, joined.alias(out))


def test_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, size, hash, window): the distinct windows of each item, as their words joined."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    slices = F.transform(starts, lambda s: F.slice("words", s, size))
    return items.select("item_id", size.alias("size"), F.explode(slices).alias("words")).select(
        "item_id", "size", "words", F.array_join("words", " ").alias("window")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, fp, start, size, window): each place where a test window occurs."""
    tests = test_windows(benchmark, window).select("size", "words", "window").distinct()
    tests = durable(tests)
    sizes = sorted((r["size"] for r in tests.select("size").distinct().collect()), reverse=True)
    rows = docs.select("doc_id", fingerprint().alias("fp"), words(F.col("text")).alias("words"))
    if not sizes:
        return rows.select(*_DOC, F.lit(0).alias("start"), F.lit(0).alias("size"),
                           F.lit("").alias("window")).filter(F.lit(False))
    # A test window is hashed like a document of just its words.
    hashed = with_windows(tests, "words", sizes, "hashes")

    def place_of(n: str) -> Column:
        """Where the hashes of a size begin, among those of a document of n words."""
        before, place = F.lit(0), F.lit(0)
        for size in sizes:
            place = F.when(F.col("size") == size, before).otherwise(place)
            before = before + F.greatest(F.col(n) - (size - 1), F.lit(0))
        return place

    hashed = hashed.withColumn("n", F.size("words"))
    hashed = hashed.select(F.get("hashes", place_of("n")).alias("hash"), "size", "window")
    few = tests.count() <= BROADCAST_WINDOWS
    hashed = F.broadcast(hashed) if few else hashed
    # The outer form: for the other, Spark would test the size of the hashes before it makes
    # them, which makes them many times over.
    probes = with_windows(rows.withColumn("n", F.size("words")), "words", sizes, "hashes").select(
        *_DOC, "n", F.posexplode_outer("hashes").alias("at", "hash"))
    found = probes.join(hashed, "hash")
    found = found.select(*_DOC, (F.col("at") - place_of("n")).alias("start"), "size", "window")
    # Words are looked at again in documents with a hit only.
    by_doc = found.groupBy(*_DOC).agg(F.collect_set(F.struct("start", "size", "window")).alias("hits"))
    keys = measure(by_doc).frame({"doc_id": "__doc", "fp": "__fp", "hits": "hits"})
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp"))
    hit_docs = docs.select("doc_id", fingerprint().alias("fp"), "text").join(keys, same)
    checked = hit_docs.select(*_DOC, words(F.col("text")).alias("words"), "hits").select(
        *_DOC, F.filter("hits", lambda h: F.array_join(F.slice(
            "words", h["start"] + 1, h["size"]), " ") == h["window"]).alias("hits"))
    return checked.select(*_DOC, F.inline("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, fp, n_hit, spans, items): for documents with a hit.

    `spans` holds the places (start, end) of the hits, in order; they may overlap. `items`
    holds the ids, as text, of the items that occur.
    """
    found = stored(hits(docs, benchmark, window).distinct(), "hits")  # rows may repeat
    spans = found.groupBy(*_DOC).agg(F.sort_array(F.collect_set(
        F.struct("start", (F.col("start") + F.col("size")).alias("end")))).alias("spans"))
    # In order of their starts, a span adds the words beyond the furthest end so far.
    ends = F.aggregate("spans", F.struct(F.lit(0).alias("to"), F.lit(0).alias("n")), lambda s, x: F.struct(
        F.greatest(s["to"], x["end"]).alias("to"),
        (s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(s["to"], x["start"]))).alias("n")))
    by_doc = spans.select(*_DOC, ends["n"].cast("bigint").alias("n_hit"), "spans")
    items = test_windows(benchmark, window).filter(F.col("item_id").isNotNull()).select("window", "item_id")
    listed = found.select(*_DOC, "window").distinct().join(items.distinct(), "window").groupBy(*_DOC).agg(
        F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    listed = listed.select(F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"), "items")
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp"))
    return by_doc.join(listed, same, "left").select(
        *_DOC, "n_hit", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated): one row per document."""
    found = contamination(docs, benchmark, window).select(
        F.col("doc_id").alias("__doc"), F.col("fp").alias("__fp"), "n_hit", "items")
    sized = docs.select("doc_id", fingerprint().alias("fp"),
                        F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("bigint")
    return sized.join(found, same, "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (n_hit > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  remove: str = "documents") -> DataFrame:
    """`docs` without contaminated documents, or (`remove="spans"`) without the hit words.

    The separators around a removed word stay. Columns are kept.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    fp, spans, own_doc, own_fp = fresh(docs, "fp", "spans", "__doc", "__fp")
    found = contamination(docs, benchmark, window).select(
        F.col("doc_id").alias(own_doc), F.col("fp").alias(own_fp), F.col("spans").alias(spans))
    same = F.col("doc_id").eqNullSafe(F.col(own_doc)) & (F.col(fp) == F.col(own_fp))
    marked = docs.withColumn(fp, fingerprint())
    if remove == "documents":
        return marked.join(found.drop(spans), same, "left_anti").select(*docs.columns)
    pieces, gone = fresh(docs, "pieces", "gone")
    cut = marked.join(found, same, "left").withColumn(pieces, F.regexp_extract_all("text", F.lit(_PIECES), F.lit(0)))
    # Pieces take turns: the first word is piece 0 or 1.
    first = F.when(F.get(F.col(pieces), F.lit(0)).rlike(r"^[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), 0).otherwise(1)
    hit = F.flatten(F.transform(F.col(spans), lambda s: F.sequence(s["start"], s["end"] - 1)))
    cut = cut.withColumn(gone, F.transform(hit, lambda w: 2 * w + first))
    kept = F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col(gone))
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col(pieces), i)), "")
    return cut.select(*[F.when(F.col(spans).isNotNull(), text).otherwise(F.col("text")).alias("text")
                        if c == "text" else F.col(c) for c in docs.columns])
