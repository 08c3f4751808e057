"""Substring dedup: repeated passages found by fixed-block anchors.

Words are runs of non-white-space, unchanged. A window is 50 consecutive words; a word goes
when a window that covers it also starts in a document with a smaller doc_id.

The index holds the non-overlapping blocks of BLOCK words of every document; the probes are
rolling windows of BLOCK words at every STRIDE-th word. BLOCK and STRIDE have no common
divisor, so of any BLOCK * STRIDE consecutive places one is both a block of the one
document and a probe of the other: a shared run of BLOCK * STRIDE + BLOCK - 1 words
(47) always has an anchor, and so has every window of 50. An anchor is a probe whose block
another document has too; that is seen from the smallest and largest document of a block,
so a block which a third of the documents hold stays one row, and no pairs are made.

Documents whose whole text an earlier one has go whole. In the others, each anchor extends
to the windows that contain it. Of these, hashes alone are grouped to
find the first document, and windows whose first document is an earlier one mark their
words: consecutive ones add up to the maximal repeat. Hashes of windows
have 95 bits.

Null and empty texts have no words. A null doc_id is smaller than any other. Rows that
repeat a doc_id and its text count as one document; texts that share a doc_id are told
apart by a 64-bit hash. Ids that are not integers are ordered as text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.llm.line_dedup import fingerprint
from backtrail.llm.textbytes import Chunk, Hashes, chunks, whitespace, windows

WINDOW, BLOCK, STRIDE = 50, 8, 5
_DOC = ["doc", "fp"]
NO_ID = -(1 << 63)
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words, and their bounds by document."""
    starts, ends = chunk.spans(~whitespace(chunk.data))
    return starts, ends, Hashes(chunk.data).of(starts, ends), chunk.bounds(starts)


def _places(bounds: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, place) of every `step`-th run of `size` words within one document."""
    n = np.diff(bounds)
    count = np.maximum((n - size) // step + 1, 0)
    doc = np.repeat(np.arange(len(n)), count)
    first = np.cumsum(count) - count
    return doc, (np.arange(count.sum()) - first[doc]) * step


def _anchors(step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(2)):
                _, _, words, bounds = _words(chunk)
                doc, place = _places(bounds, BLOCK, step)
                runs = windows(words, BLOCK)
                rows = pa.array(chunk.lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows),
                     pa.array(place.astype(np.int32)), pa.array(runs[bounds[doc] + place].view(np.int64))],
                    ["doc", "fp", "pos", "hash"])
    return run


def _candidates(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchors = batch.column(3).to_pylist()
            for chunk in chunks(batch.column(2)):
                _, _, words, bounds = _words(chunk)
                near, far = windows(words, window), windows(words, window, salt=9)
                for row in range(chunk.n):
                    n = int(bounds[row + 1] - bounds[row])
                    if n < window:
                        continue
                    marks = np.zeros(n + 2, np.int32)
                    at = np.array(anchors[chunk.lo + row])
                    np.add.at(marks, np.maximum(at - (window - BLOCK), 0), 1)
                    np.add.at(marks, at + 1, -1)
                    place = np.flatnonzero(np.cumsum(marks)[:n - window + 1] > 0)
                    where = bounds[row] + place
                    rows = pa.array(np.full(len(place), chunk.lo + row))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(rows), batch.column(1).take(rows),
                         pa.array(place.astype(np.int32)), pa.array(near[where].view(np.int64)),
                         pa.array((far[where] >> np.uint64(33)).astype(np.int32))], ["doc", "fp", "pos", "h1", "h2"])
    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            later, copies = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for chunk in chunks(batch.column(1)):
                starts, ends, _, bounds = _words(chunk)
                sizes, removed, kept = [], [], []
                data = chunk.data.tobytes()
                for row in range(chunk.n):
                    lo, hi = bounds[row], bounds[row + 1]
                    stay = np.full(hi - lo, not copies[chunk.lo + row] or hi - lo < window)
                    places = later[chunk.lo + row]
                    if places:
                        marks = np.zeros(hi - lo + 1, np.int32)
                        np.add.at(marks, np.array(places), 1)
                        np.add.at(marks, np.array(places) + window, -1)
                        stay &= np.cumsum(marks)[:-1] == 0
                    words = [data[s:e] for s, e in zip(starts[lo:hi][stay], ends[lo:hi][stay])]
                    sizes.append(hi - lo)
                    removed.append(int((~stay).sum()))
                    kept.append(b" ".join(words))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, chunk.n), pa.array(sizes, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string()),
                     pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                    ["doc", "n_words", "n_removed", "kept", "kept_sha256"])
    return run


def _narrow(docs: DataFrame) -> tuple[DataFrame, Column]:
    """(doc, fp, text), and the column that makes a doc_id of `doc`.

    `doc` orders documents: an integer as a long, any other id as a text with a letter
    before it, and a null id as the least value. `fp` tells texts that share an id apart; it
    is 0 where every id has one row.
    """
    kind = docs.schema["doc_id"].dataType
    if isinstance(kind, _INTEGERS):
        doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
        back = F.when(F.col("doc") != NO_ID, F.col("doc"))
    else:
        doc = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("")).alias("doc")
        back = F.when(F.col("doc") != "", F.substr("doc", F.lit(2)).cast(kind))
    unique = docs.groupBy(doc).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).isEmpty()
    fp = F.lit(0).cast("bigint") if unique else fingerprint()
    return docs.select(doc, fp.alias("fp"), "text"), back.alias("doc_id")


def exact_copies(rows: DataFrame) -> DataFrame:
    """(doc, fp): documents whose whole text an earlier document has."""
    whole = rows.filter(F.col("text").isNotNull()).select(
        "doc", "fp", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(3), "text", F.lit(5)).alias("t2"))
    first = whole.groupBy("t1", "t2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    first = first.filter(F.col("first") < F.col("last"))
    return whole.join(first, ["t1", "t2"]).filter(F.col("first") < F.col("doc")).select("doc", "fp").distinct()


def later_windows(rows: DataFrame, copies: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, fp, pos): windows whose words also start in an earlier document.

    Exact copies are left out: the first of them stands for all.
    """
    if window < BLOCK * STRIDE + BLOCK - 1:
        raise ValueError(f"a window must have {BLOCK * STRIDE + BLOCK - 1} words at least")
    doc = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {doc}, fp long, pos int, hash long"
    index = rows.mapInArrow(_anchors(BLOCK), schema).groupBy("hash").agg(
        F.min("doc").alias("lo"), F.max("doc").alias("hi"))
    probes = rows.mapInArrow(_anchors(STRIDE), schema)
    # A document is looked at as a later one near anchors that an earlier document has, and
    # as a first one near anchors that a later document has.
    late, early = F.col("lo") < F.col("doc"), F.col("hi") > F.col("doc")
    anchors = probes.join(index, "hash").filter(late | early).groupBy(*_DOC).agg(
        F.collect_set(F.when(late, F.col("pos"))).alias("late"),
        F.collect_set(F.when(early, F.col("pos"))).alias("early"))
    anchors = anchors.join(copies, _DOC, "left_anti")
    places = rows.repartition("doc").join(anchors, _DOC)

    def found(side: str) -> DataFrame:
        return places.filter(F.size(side) > 0).select("doc", "fp", "text", side).mapInArrow(
            _candidates(window), f"doc {doc}, fp long, pos int, h1 long, h2 int")

    first = found("early").groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    return found("late").join(first, ["h1", "h2"]).filter(F.col("first") < F.col("doc")).select("doc", "fp", "pos")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, kept_sha256): one row per document row.

    `kept` is what is left of the words, joined by single spaces.
    """
    rows, doc_id = _narrow(docs)
    kind = rows.schema["doc"].dataType.simpleString()
    copies = exact_copies(rows)
    later = later_windows(rows, copies, window).groupBy(*_DOC).agg(F.collect_set("pos").alias("later"))
    # The same exchange of the texts serves here and where windows are made.
    judged = rows.repartition("doc").join(later, _DOC, "left").join(copies.withColumn("copy", F.lit(True)), _DOC, "left")
    cut = judged.select("doc", "text", "later", F.coalesce("copy", F.lit(False)).alias("copy")).mapInArrow(
        _cut(window), f"doc {kind}, n_words long, n_removed long, kept string, kept_sha256 string")
    return cut.select(doc_id, "n_words", "n_removed", "kept", "kept_sha256")
