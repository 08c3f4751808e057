"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

A document becomes some twenty statistics (word and line shapes, signs, capitals, digits,
repetition, spread of words), standardized. FEATURES random cosines of them approximate a
Gaussian kernel. Ridge regression on the labels needs only the normal equations: each
partition adds up its own and Spark sums them, so every labelled document is used and the
driver solves one small system. Isotonic regression on binned scores makes probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm import isotonic
from backtrail.llm.common import fresh, with_doubles
from backtrail.llm.textbytes import Chunk, Hashes, per_doc, whitespace
from backtrail.session import stored

FEATURES, WIDTH, RIDGE = 192, 3.0, 1e-3
THRESHOLD = 0.7

STATISTICS = """words bytes word_bytes word_spread short_words long_words signs trailing_signs
sign_words capitals shouted titled digits pipes marks stops commas lines line_words short_lines
distinct doubled repeated_grams entropy wide_letters""".split()
_COLUMNS = [f"q_{name}" for name in STATISTICS]


def statistics(chunk: Chunk) -> np.ndarray:
    """One row of STATISTICS per document; a document without words has zeros."""
    data, lowered, offsets = chunk.data, chunk.lowered(), chunk.offsets
    blank = whitespace(data)
    letter = ((lowered >= 97) & (lowered <= 122)) | (data >= 128)
    capital = (data >= 65) & (data <= 90)
    digit = (data >= 48) & (data <= 57)
    sign = ~letter & ~digit & ~blank
    starts, ends = chunk.spans(~blank)
    bounds = chunk.bounds(starts)
    n = np.diff(bounds).astype(float)
    words = np.maximum(n, 1)
    size = np.maximum(np.diff(offsets) - 1, 1).astype(float)
    length = (ends - starts).astype(float)
    upto = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    signs, capitals, letters = upto(sign), upto(capital), upto(letter)
    of_words = lambda values: per_doc(values, bounds) / words
    of_bytes = lambda mask: per_doc(mask, offsets) / size
    mean = of_words(length)
    docs = np.repeat(np.arange(chunk.n), np.diff(bounds))
    n_letters, n_capitals = letters[ends] - letters[starts], capitals[ends] - capitals[starts]
    last_two = np.maximum(ends - 2, starts)
    hashes = Hashes(lowered).of(starts, ends)
    new = np.ones(len(hashes), bool)
    order = np.lexsort((hashes, docs))
    same = (hashes[order][1:] == hashes[order][:-1]) & (docs[order][1:] == docs[order][:-1])
    new[order[1:]] = ~same
    first = np.flatnonzero(np.concatenate([[True], ~same])) if len(order) else np.empty(0, int)
    counts = np.diff(np.concatenate([first, [len(order)]])).astype(float)
    at = docs[order][first] if len(order) else first
    share = counts / words[at]
    entropy = np.bincount(at, -share * np.log(share), chunk.n)
    doubled = np.zeros(len(hashes))
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    inside = np.flatnonzero(docs[1:] == docs[:-1])  # pairs within one document
    pair = hashes[inside] * np.uint64(3) + hashes[inside + 1]
    order2 = np.lexsort((pair, docs[inside]))
    again = (pair[order2][1:] == pair[order2][:-1]) & (docs[inside][order2][1:] == docs[inside][order2][:-1])
    repeated = np.zeros(len(hashes))
    repeated[inside[order2[1:]]] = again
    breaks = per_doc(data == 10, offsets)
    lines = breaks + 1
    in_line = data != 10
    in_line[offsets[1:] - 1] = False  # a document's last line ends with it
    line_start, line_end = chunk.spans(in_line)
    line_bounds = chunk.bounds(line_start)
    short_lines = per_doc(line_end - line_start < 30, line_bounds) / lines
    empty = n == 0
    columns = [
        np.log1p(n), np.log1p(size), mean, np.sqrt(np.maximum(of_words(length**2) - mean**2, 0)),
        of_words(length <= 2), of_words(length >= 15), of_bytes(sign),
        of_words(signs[ends] - signs[last_two] >= 2), of_words(signs[ends] > signs[starts]),
        of_bytes(capital), of_words((n_capitals >= 2) & (n_capitals >= n_letters - 1)),
        of_words(capital[starts] if len(starts) else length), of_bytes(digit), of_bytes(data == 124),
        of_bytes((data == 33) | (data == 63)), of_bytes(data == 46), of_bytes(data == 44),
        np.log1p(lines), np.log1p(n / lines), short_lines, of_words(new), of_words(doubled),
        of_words(repeated), entropy / np.log(words + 1), of_bytes(data >= 128)]
    out = np.stack(columns, axis=1)
    out[empty] = 0.0
    return out


@dataclass(frozen=True)
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray         # one per cosine, and the constant
    knots: np.ndarray
    rates: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return cosines(rows, self.center, self.scale) @ self.weights

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.knots, self.rates)


def cosines(rows: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The random features of rows of statistics, and a constant."""
    rng = np.random.default_rng(41)
    omega = rng.normal(0, 1 / WIDTH, (rows.shape[1], FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((rows - center) / scale, -6, 6) @ omega + phase
    return np.concatenate([np.cos(z) * np.sqrt(2 / FEATURES), np.ones((len(rows), 1))], axis=1)


def fit(measured: DataFrame, labels: DataFrame, wanted: Column | None = None) -> Model:
    """A model from statistics (doc_id and _COLUMNS) and labels (doc_id, quality).

    A fifth of the labelled documents, chosen by a hash of the id, only calibrates; where it
    holds one class only, all of them do. With no labels every score is 0.5. Labels other
    than 0 and 1 are left out.
    """
    rows = labels.select("doc_id", F.col("quality").cast("double").alias("label")).filter(
        F.col("label").isin(0.0, 1.0) & (F.lit(True) if wanted is None else wanted)).distinct()
    late = (F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(5)) == 0).alias("late")
    rows = stored(measured.select("doc_id", *_COLUMNS).join(rows, "doc_id").select(*_COLUMNS, "label", late), "quality-train")
    classes = rows.groupBy("late").agg(F.count_distinct("label").alias("n")).filter("n > 1").count()
    train, check = (rows.filter(~F.col("late")), rows.filter("late")) if classes == 2 else (rows, rows)
    ends = train.agg(F.count(F.lit(1)), *[f(c) for c in _COLUMNS for f in (F.avg, F.stddev_pop)]).first()
    if not ends[0]:
        ones = np.ones(len(_COLUMNS))
        return Model(0 * ones, ones, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    center, scale = np.array(ends[1::2]), np.maximum(np.array(ends[2::2]), 1e-6)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            z = cosines(x[:, :-1], center, scale)
            total += z.T @ np.concatenate([z, x[:, -1:]], axis=1)
        i, j = np.indices(total.shape)
        keep = (j >= i) & (total != 0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i[keep].astype(np.int32)), pa.array(j[keep].astype(np.int32)), pa.array(total[keep])],
            ["i", "j", "v"])

    parts = train.select(*_COLUMNS, "label").mapInArrow(sums, "i int, j int, v double")
    normal = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    full = np.zeros((FEATURES + 1, FEATURES + 2))
    full[normal["i"], normal["j"]] = normal["v"]
    square, right = full[:, :-1], full[:, -1]
    square = np.triu(square) + np.triu(square, 1).T
    weights = np.linalg.solve(square + RIDGE * ends[0] / FEATURES * np.eye(FEATURES + 1), right)
    model = Model(center, scale, weights, np.array([0.0]), np.array([0.5]))
    knots, rates = isotonic.fit_frame(_applied(check.drop("late"), _COLUMNS, model.raw, "raw"), "raw", "label")
    return Model(center, scale, weights, knots, rates)


def _applied(df: DataFrame, columns: list[str], values, name: str) -> DataFrame:
    """`df` and a double column computed from rows of the given columns."""
    at, names = [df.columns.index(c) for c in columns], [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in at], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values(x))], names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, `{name}` double")


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, _COLUMNS): the statistics of each document, written once in the shared folder.

    A null text is an empty one. One row per row of `docs`.
    """
    return stored(with_doubles(docs.select("doc_id", "text"), "text", _COLUMNS, statistics).drop("text"), "statistics")


def score(measured: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """(doc_id, score): how likely each document is of label 1, from its statistics."""
    (own,) = fresh(measured, name)
    return _applied(measured, _COLUMNS, model.scores, own).select("doc_id", F.col(own).alias(name))
