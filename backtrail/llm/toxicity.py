"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features are densities of a lexicon, how near its words stand to a second person,
capitals, punctuation and obfuscation. The lexicon itself is learned from the labelled
documents: words, and openings of words, that far more toxic documents hold than others.
Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm import isotonic
from backtrail.llm.boosting import Trees, grow
from backtrail.llm.common import fresh, labelled_sample, with_doubles
from backtrail.llm.textbytes import Chunk, Hashes, chunks, per_doc, whitespace, word_hash

PER_CLASS = 6000        # labelled documents of each class that are learned from, at most
LEXICON = 3000          # words and word openings kept, at most
OPENINGS = range(3, 9)  # characters of a word opening
NEAR = 5                # words between a lexicon word and a second person
THRESHOLD = 0.5

# Second-person words, in lower case.
SECOND_PERSON = """you your yours yourself youre u ya thou du dich dir dein deine deinen
ihr euch euer sie tu te toi ton ta tes vous votre vos tú ti tuyo tus usted ustedes vosotros
vos su""".split()
# Characters that stand for letters.
LOOKALIKES = str.maketrans("013457@$!|+", "oieastasiit")

FEATURES = """density hits weight_density weight distinct opening_density openings near_density
near disguised_hits disguised spaced capitals exclamations punctuation digits length""".split()
_COLUMNS = [f"f_{name}" for name in FEATURES]


@dataclass(frozen=True)
class Lexicon:
    """Hashes of words and of word openings, sorted, with their weights."""

    words: np.ndarray
    word_weights: np.ndarray
    openings: np.ndarray
    opening_weights: np.ndarray
    opening_bytes: tuple[int, ...]

    @staticmethod
    def of(entries: list[tuple[str, bool, float]]) -> Lexicon:
        """From (text, is an opening, weight)."""
        def part(opening: bool) -> tuple[np.ndarray, np.ndarray]:
            found = {word_hash(t): w for t, o, w in entries if o == opening}
            keys = np.array(sorted(found), np.uint64)
            return keys, np.array([found[int(k)] for k in keys])

        lengths = tuple(sorted({len(t.encode()) for t, o, _ in entries if o}))
        return Lexicon(*part(False), *part(True), lengths)


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The value of each wanted key, 0 where it is not among the sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def letters_of(lowered: np.ndarray) -> np.ndarray:
    """The bytes that words are made of: letters in lower case, and all of longer characters."""
    return ((lowered >= 97) & (lowered <= 122)) | (lowered >= 128)


def words_of(chunk: Chunk) -> list[set[str]]:
    """The different words of each document, by the rule that scoring uses."""
    lowered = chunk.lowered()
    starts, ends = chunk.spans(letters_of(lowered))
    bounds, data = chunk.bounds(starts), lowered.tobytes()
    return [{data[s:e].decode() for s, e in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist())}
            for lo, hi in zip(bounds[:-1], bounds[1:])]


def learn_lexicon(sample: DataFrame, size: int = LEXICON) -> list[tuple[str, bool, float]]:
    """Words and openings of the sample (text, label) with their log lift in toxic texts.

    Document counts are summed by Spark. An entry needs half a percent of the toxic
    documents, five at least, and eight times the share that it has in the others.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            held = (words for chunk in chunks(batch.column(0)) for words in words_of(chunk))
            for words, label in zip(held, batch.column(1).to_pylist()):
                tokens = {"w" + w for w in words}
                for w in words:
                    tokens.update("p" + w[:k] for k in OPENINGS if k < len(w))
                seen[label].update(tokens)
            keys = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()),
                 pa.array([seen[0][k] for k in keys], pa.int64())], ["token", "pos", "neg"])

    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = totals.get(1, 0), totals.get(0, 0)
    if not n_pos or not n_neg:
        return []
    counts = sample.select("text", "label").mapInArrow(count, "token string, pos long, neg long")
    counts = counts.groupBy("token").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lift = (F.col("pos") / n_pos) / ((F.col("neg") + 0.5) / n_neg)
    kept = counts.filter((F.col("pos") >= max(5, 0.005 * n_pos)) & (lift >= 8))
    kept = kept.withColumn("weight", F.log(lift)).orderBy(
        F.desc(F.col("weight") * F.col("pos")), "token").limit(size)
    return [(r["token"][1:], r["token"][0] == "p", r["weight"]) for r in kept.collect()]


def features(chunk: Chunk, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per document."""
    data, lowered = chunk.data, chunk.lowered()
    letter = letters_of(lowered)
    starts, ends = chunk.spans(letter)
    bounds = chunk.bounds(starts)
    n = np.diff(bounds).astype(float)
    hashes = Hashes(lowered)
    words = hashes.of(starts, ends)
    weight = look_up(lexicon.words, lexicon.word_weights, words)
    opening = np.zeros(len(words))
    for k in lexicon.opening_bytes:
        long = np.flatnonzero(ends - starts > k)
        found = look_up(lexicon.openings, lexicon.opening_weights,
                        hashes.of(starts[long], starts[long] + k))
        opening[long] = np.maximum(opening[long], found)
    best = np.maximum(weight, opening)
    hit = best > 0
    docs = np.repeat(np.arange(chunk.n), np.diff(bounds))
    pairs = np.unique(np.stack([docs[hit], words[hit].view(np.int64)]), axis=1)[0]
    distinct = np.bincount(pairs, minlength=chunk.n)
    second = np.isin(words, _second_person()).astype(float)
    run = np.concatenate([[0], np.cumsum(second)])
    first = np.maximum(np.arange(len(words)) - NEAR, bounds[docs])
    last = np.minimum(np.arange(len(words)) + NEAR + 1, bounds[docs + 1])
    near = hit & (run[last] - run[first] > 0)
    hits, nears = per_doc(hit, bounds), per_doc(near, bounds)
    openings, total = per_doc(opening > 0, bounds), per_doc(best, bounds)

    blank = whitespace(data)
    t0, t1 = chunk.spans(~blank)
    t_bounds = chunk.bounds(t0)
    tokens = np.diff(t_bounds).astype(float)
    letters = np.concatenate([[0], np.cumsum(letter)])
    alone = (t1 - t0 == 1) & (letters[t1] - letters[t0] == 1)
    token_doc = np.repeat(np.arange(chunk.n), np.diff(t_bounds))
    together = alone[:-1] & alone[1:] & (token_doc[:-1] == token_doc[1:])
    spaced = np.bincount(token_doc[:-1][together], minlength=chunk.n)
    # Tokens that hold a sign or digit between letters.
    turns = np.concatenate([[0], np.cumsum(~letter[:-1] & letter[1:] & ~blank[:-1]), [0]])
    inner = (letters[t1] > letters[t0]) & (turns[np.maximum(t1 - 1, t0)] > turns[t0])
    odd = np.flatnonzero(inner)
    disguised = np.bincount(token_doc[odd], minlength=chunk.n)
    disguised_hits = np.zeros(chunk.n)
    for i in odd:
        plain = lowered[t0[i]:t1[i]].tobytes().decode("utf-8", "ignore").translate(LOOKALIKES)
        plain = "".join(c for c in plain if c.isalpha())
        if plain and look_up(lexicon.words, lexicon.word_weights,
                             np.array([word_hash(plain)], np.uint64))[0] > 0:
            disguised_hits[token_doc[i]] += 1

    size = np.maximum(np.diff(chunk.offsets) - 1, 0).astype(float)
    share = size + 20
    capital = per_doc((data >= 65) & (data <= 90), chunk.offsets)
    shout = per_doc(data == 33, chunk.offsets)
    digit = per_doc((data >= 48) & (data <= 57), chunk.offsets)
    signs = per_doc(~letter & ~blank, chunk.offsets) - digit
    return np.stack([
        hits / (n + 5), np.log1p(hits), total / (n + 5), np.log1p(total), np.log1p(distinct),
        openings / (n + 5), np.log1p(openings), nears / (n + 5), np.log1p(nears),
        np.log1p(disguised_hits), disguised / (tokens + 5), spaced / (tokens + 5),
        capital / share, shout / share, signs / share, digit / share, np.log1p(n)], axis=1)


def _second_person() -> np.ndarray:
    return np.array(sorted(word_hash(w) for w in SECOND_PERSON), np.uint64)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: Trees
    knots: np.ndarray
    rates: np.ndarray

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margins(rows), self.knots, self.rates)


def fit(docs: DataFrame, labels: DataFrame, wanted: Column | None = None,
        per_class: int = PER_CLASS) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic).

    It learns from a bounded sample: `per_class` documents of each class, fewer when texts
    repeat. Their feature rows, of fixed width, are all that reaches the driver. Three
    quarters grow the trees and one quarter calibrates them. With labels of one class only,
    or none, every score is that class's rate (0 without labels).
    """
    wanted = F.lit(True) if wanted is None else wanted
    sample = labelled_sample(docs, labels, "toxic", per_class, wanted, "toxicity-sample")
    lexicon = Lexicon.of(learn_lexicon(sample))
    rows = with_doubles(sample, "text", _COLUMNS, lambda c: features(c, lexicon)).select(
        "label", "weight", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) == 0).alias("late"),
        *_COLUMNS).orderBy("doc_id", "label").toPandas()
    x = rows[_COLUMNS].to_numpy(float)
    y, w = rows["label"].to_numpy(float), rows["weight"].to_numpy(float)
    late = rows["late"].to_numpy(bool)
    if len(set(y)) < 2:
        rate = float(y[0]) if len(y) else 0.0
        return Model(lexicon, Trees.empty(), np.array([0.0]), np.array([rate]))
    if len(set(y[late])) < 2 or len(set(y[~late])) < 2:
        late = np.zeros(len(y), bool)
    trees = grow(x[~late], y[~late], w[~late])
    held = late if late.any() else ~late
    knots, rates = isotonic.fit(trees.margins(x[held]), y[held], w[held])
    return Model(lexicon, trees, knots, rates)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """`docs` and a double column: how likely the whole text is toxic (0 to 1).

    Null and empty texts are scored like a text without words; every row is kept. A column
    of the same name in `docs` is replaced.
    """
    docs = docs.drop(name)
    return with_doubles(docs, "text", [name],
                        lambda c: model.scores(features(c, model.lexicon)))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with their columns."""
    (name,) = fresh(docs, "toxicity")
    return score(docs, model, name).filter(F.col(name) < threshold).select(*docs.columns)
