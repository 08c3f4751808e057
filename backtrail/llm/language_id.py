"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its hashed byte 2-, 3- and 4-grams (lower case,
signs and digits as breaks, with word borders); a linear layer and a softmax give the
language. Embeddings and layer are trained by stochastic gradient descent in numpy on a
bounded, stratified sample of all languages, in a fixed number of passes. A held-back part of the sample sets the softmax's temperature and
the score under which an answer is rejected. Since the layer is linear, scoring uses the
products of embeddings and layer: one table lookup per n-gram, over whole texts, without a
shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import fresh
from backtrail.llm.textbytes import Chunk, chunks, mix
from backtrail.plans.groups import measure
from backtrail.session import durable, stored

PER_LANGUAGE = 800      # sampled texts of each language, at most
TEXTS = 160_000         # sampled texts in all; of many languages fewer texts each
BUCKETS, WIDTH = 1 << 13, 16
EPOCHS, BATCH, RATE = 30, 32, 0.5
PRECISION = 0.99        # wanted of the accepted answers
UNKNOWN = "und"
_LETTER = r"\p{L}"


def grams(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram; documents ascend for each n.

    An n-gram lies within its document and the one blank after it, so that neither the
    document before nor the one behind has a say.
    """
    data = chunk.lowered()
    letter = ((data >= 97) & (data <= 122)) | (data >= 128)
    codes = np.where(letter, data, 32).astype(np.uint32)
    docs, buckets = [], []
    for n in (2, 3, 4):
        if len(codes) < n:
            continue
        count = len(codes) - n + 1
        code = np.zeros(count, np.uint32)
        inner = letter[:count].copy()
        for i in range(n):
            code = code << np.uint32(8) | codes[i:i + count]
            if i < n - 1:
                inner |= letter[i:i + count]
        # At least one letter before the last byte; a trailing blank marks the word's end.
        at = np.flatnonzero(inner & (letter[n - 2:n - 2 + count] if n > 2 else inner))
        doc = chunk.docs_of(at)
        inside = at + n <= chunk.offsets[doc + 1]
        at, doc = at[inside], doc[inside]
        docs.append(doc)
        buckets.append((mix(code[at].astype(np.uint64), n) % np.uint64(BUCKETS)).astype(np.int64))
    if not docs:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(docs), np.concatenate(buckets)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    table: np.ndarray           # (BUCKETS, languages): embedding times layer
    bias: np.ndarray
    temperature: float
    least: float                # scores below are rejected

    def probabilities(self, chunk: Chunk) -> np.ndarray:
        docs, buckets = grams(chunk)
        count = np.maximum(np.bincount(docs, minlength=chunk.n), 1)
        logits = np.stack([np.bincount(docs, self.table[buckets, k], chunk.n) / count + b
                           for k, b in enumerate(self.bias)], axis=1)
        return _softmax(logits / self.temperature)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sample(docs: DataFrame, wanted: Column | None = None, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, grams): texts with a letter and a language, as packed (bucket, count) pairs.

    About `per_language` texts of each language are chosen by a hash of their id, or as many
    fewer of each as TEXTS in all allow; no language is left out for being rare.
    """
    rows = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & F.col("text").rlike(_LETTER) & (F.lit(True) if wanted is None else wanted))
    # A language's first text by place is always chosen.
    place = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sizes = durable(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")))
    each = min(per_language, max(1, TEXTS // max(sizes.count(), 1)))
    shares = measure(sizes.select(F.col("lang").alias("of"), F.greatest(
        F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")), F.col("first") + 1e-9).alias("share")))
    chosen = rows.withColumn("place", place).join(shares.frame(), F.col("lang") == F.col("of"))
    chosen = chosen.filter(F.col("place") < F.col("share"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                doc, bucket = grams(chunk)
                keys, counts = np.unique(doc * BUCKETS + bucket, return_counts=True)
                bounds = np.searchsorted(keys // BUCKETS, np.arange(chunk.n + 1))
                pairs = np.stack([keys % BUCKETS, counts], axis=1).astype(np.int32)
                packed = [pairs[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(chunk.lo, chunk.n), pa.array(packed, pa.binary()),
                     batch.column(2).slice(chunk.lo, chunk.n)], ["lang", "grams", "place"])

    packed = chosen.select("lang", "text", "place").mapInArrow(run, "lang string, grams binary, place double")
    return packed.orderBy("place", "lang").select("lang", "grams")


def fit(docs: DataFrame, wanted: Column | None = None, per_language: int = PER_LANGUAGE,
        epochs: int = EPOCHS) -> Model:
    """A model from documents (doc_id, text, lang). Every fifth sampled text calibrates."""
    rows = stored(sample(docs, wanted, per_language), "languages").toPandas()
    languages = tuple(sorted(set(rows["lang"])))
    if not languages:
        return Model((UNKNOWN,), np.zeros((BUCKETS, 1)), np.zeros(1), 1.0, 1.0)
    texts = [np.frombuffer(g, np.int32).reshape(-1, 2) for g in rows["grams"]]
    y = np.searchsorted(np.array(languages), rows["lang"].to_numpy(str))
    texts = [(t[:, 0], (t[:, 1] / max(t[:, 1].sum(), 1)).astype(np.float32)) for t in texts]
    rng = np.random.default_rng(11)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer = rng.normal(0, 0.1, (WIDTH, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), np.float32)
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    weight = (len(train) / np.maximum(np.bincount(y[train], minlength=len(languages)), 1) / len(languages))[y]
    for epoch in range(epochs):
        step = RATE * (1 - epoch / epochs) * 10
        order = rng.permutation(train)
        for lo in range(0, len(order), BATCH):
            part = order[lo:lo + BATCH]
            mean = np.stack([v @ emb[b] for b, v in (texts[i] for i in part)])
            grad = _softmax(mean @ layer + bias)
            grad[np.arange(len(part)), y[part]] -= 1
            grad *= (weight[part] / len(part))[:, None]
            back = grad @ layer.T
            layer -= step * (mean.T @ grad)
            bias -= step * grad.sum(0)
            for j, i in enumerate(part):
                emb[texts[i][0]] -= step * texts[i][1][:, None] * back[j] * 20
    table = (emb @ layer).astype(np.float64)
    check = np.flatnonzero(held) if held.any() else train
    logits = np.stack([texts[i][1] @ table[texts[i][0]] + bias for i in check])
    temperature, least = _calibrate(logits, y[check])
    return Model(languages, table, bias.astype(np.float64), temperature, least)


def _calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The temperature of least log loss, and the least score at which PRECISION holds."""
    def loss(t: float) -> float:
        return -np.log(_softmax(logits / t)[np.arange(len(y)), y] + 1e-12).mean()

    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    p = _softmax(logits / temperature)
    top, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-top)
    precision = np.cumsum(right[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    return float(temperature), float(top[order][good[-1]]) if len(good) else 1.0


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with lang_pred, score (its probability) and accepted (score not rejected).

    Null texts, and texts without a letter, get `und` with score 0, not accepted. A text
    with letters gets one of the learned languages. Columns of these names are replaced.
    """
    docs = docs.drop("lang_pred", "score", "accepted")
    (best,) = fresh(docs, "best")
    at, columns = docs.columns.index("text"), [*docs.columns, best, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [model.probabilities(c) for c in chunks(batch.column(at))]
            p = np.concatenate(parts) if parts else np.empty((0, len(model.languages)))
            names = pa.array(model.languages).take(pa.array(p.argmax(1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(p.max(1))], columns)

    known = F.coalesce(F.col("text").rlike(_LETTER), F.lit(False))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    rows = docs.mapInArrow(run, f"{fields}, `{best}` string, score double")
    score = F.when(known, F.col("score")).otherwise(0.0)
    return rows.select(*docs.columns, F.when(known, F.col(best)).otherwise(UNKNOWN).alias("lang_pred"),
                       score.alias("score"), (score >= model.least).alias("accepted"))
