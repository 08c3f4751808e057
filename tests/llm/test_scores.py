"""What classifiers see of a text: plain versions per text, whatever stands beside it."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from backtrail.llm import language_id, quality, toxicity
from backtrail.llm.common import remainder
from backtrail.llm.textbytes import chunks, mix

TEXTS = ["", " ", "o", "ab", "the cat", "zzz qqq", "a b c d", "YOU are an IDIOT!! you idiot", "i d i o t", "id1ot you", None,
         "Été ÀÉ élan", "Жуть ЖУТЬ жуть", "“quoted idiot” — you", "one two one two one two", "two", "x\ny\n\nlong line " + "w" * 40,
         "a", "b", "s p a c e d  out", "|pipe|, stop. what?! 12 345", "idiotic", "idiot", "\n", "tail ", "word\tword word"]


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×" else c for c in text or "")


def is_letter(b):
    return 97 <= b <= 122 or b >= 128


def plain_grams(text):
    data = lowered(text).encode() + b" "
    codes = bytes(b if is_letter(b) else 32 for b in data)
    found = Counter()
    for n in (2, 3, 4):
        for i in range(len(data) - n + 1):
            part = data[i:i + n]
            if any(map(is_letter, part[:n - 1])) and (n == 2 or is_letter(part[n - 2])):
                code = int.from_bytes(codes[i:i + n], "big")
                found[int(mix(np.array([code], np.uint64), n)[0] % np.uint64(language_id.BUCKETS))] += 1
    return found


def words(text):
    return (text or "").encode().split()


def plain_statistics(text):
    raw = (text or "").encode()
    data, low = raw + b" ", lowered(text).encode() + b" "
    blank = lambda b: b == 32 or 9 <= b <= 13
    spans = [m.span() for m in re.finditer(rb"[^ \t\n\v\f\r]+", data)]
    if not spans:
        return [0.0] * 25
    n, size = len(spans), max(len(raw), 1)
    letter = [97 <= b <= 122 or c >= 128 for b, c in zip(low, data)]
    capital, digit = [65 <= b <= 90 for b in data], [48 <= b <= 57 for b in data]
    sign = [not (x or d or blank(b)) for x, d, b in zip(letter, digit, data)]
    length = [e - s for s, e in spans]
    mean = sum(length) / n
    of = [low[s:e] for s, e in spans]
    counts = Counter(of)
    pairs, repeated = Counter(), 0
    for p in zip(of, of[1:]):
        repeated += pairs[p] > 0
        pairs[p] += 1
    lines = data.count(b"\n") + 1
    short = sum(len(x) < 30 for x in re.findall(rb"[^\n]+", raw))
    over = lambda mask: sum(mask) / size
    shouted = sum(sum(capital[s:e]) >= 2 and sum(capital[s:e]) >= sum(letter[s:e]) - 1 for s, e in spans)
    return [math.log1p(n), math.log1p(size), mean, math.sqrt(max(sum(x * x for x in length) / n - mean**2, 0)),
            sum(x <= 2 for x in length) / n, sum(x >= 15 for x in length) / n, over(sign),
            sum(sum(sign[max(e - 2, s):e]) >= 2 for s, e in spans) / n, sum(any(sign[s:e]) for s, e in spans) / n,
            over(capital), shouted / n, sum(capital[s] for s, _ in spans) / n, over(digit), over(b == 124 for b in data),
            over(b in b"!?" for b in data), over(b == 46 for b in data), over(b == 44 for b in data),
            math.log1p(lines), math.log1p(n / lines), short / lines, len(counts) / n,
            sum(a == b for a, b in zip(of, of[1:])) / n, repeated / n,
            sum(-c / n * math.log(c / n) for c in counts.values()) / math.log(n + 1), over(b >= 128 for b in data)]


def plain_features(text, entries):
    """The counts among toxicity's features: words, hits, distinct hits, openings, near hits, spaced letters."""
    low = lowered(text).encode() + b" "
    of = [m.group().decode() for m in re.finditer(rb"[a-z\x80-\xff]+", low)]
    whole = {t: w for t, o, w in entries if not o}
    start = {t: w for t, o, w in entries if o}
    best = [max([whole.get(x, 0.0)] + [w for t, w in start.items() if x != t and x.startswith(t)]) for x in of]
    opened = [any(x != t and x.startswith(t) for t in start) for x in of]
    second = [x in toxicity.SECOND_PERSON for x in of]
    near = [b > 0 and any(second[max(i - 5, 0):i + 6]) for i, b in enumerate(best)]
    tokens = re.findall(rb"[^ \t\n\v\f\r]+", low)
    alone = [len(t) == 1 and is_letter(t[0]) for t in tokens]
    spaced = sum(a and b for a, b in zip(alone, alone[1:]))
    n, k = len(of), len(tokens)
    hits = sum(b > 0 for b in best)
    return [hits / (n + 5), math.log1p(hits), sum(best) / (n + 5), math.log1p(sum(best)),
            math.log1p(len({x for x, b in zip(of, best) if b > 0})), sum(opened) / (n + 5), math.log1p(sum(opened)),
            sum(near) / (n + 5), math.log1p(sum(near))], spaced / (k + 5), math.log1p(n)


def chunk_of(texts):
    (chunk,) = chunks(pa.array(texts, pa.string()))
    return chunk


def orders():
    rng = random.Random(1)
    yield TEXTS
    yield TEXTS[::-1]
    for _ in range(10):
        yield rng.choices(TEXTS, k=30)
    for t in TEXTS:
        yield [t]


@pytest.mark.parametrize("texts", list(orders()))
def test_grams(texts):
    docs, buckets = language_id.grams(chunk_of(texts))
    for i, text in enumerate(texts):
        assert Counter(buckets[docs == i].tolist()) == plain_grams(text), text


@pytest.mark.parametrize("texts", list(orders()))
def test_statistics(texts):
    got = quality.statistics(chunk_of(texts))
    for i, text in enumerate(texts):
        assert got[i] == pytest.approx(plain_statistics(text), abs=1e-9), text


@pytest.mark.parametrize("texts", list(orders()))
def test_toxicity_features(texts):
    entries = [("idiot", False, 2.0), ("жуть", False, 1.5), ("idi", True, 1.0), ("él", True, 1.0)]
    entries = [(t if t != "жуть" else "Жуть", o, w) for t, o, w in entries]  # as scoring writes it
    got = toxicity.features(chunk_of(texts), toxicity.Lexicon.of(entries))
    for i, text in enumerate(texts):
        first, spaced, n = plain_features(text, entries)
        assert got[i][:9] == pytest.approx(first), text
        assert got[i][[11, 16]] == pytest.approx([spaced, n]), text


def test_words_of_the_lexicon_are_words_of_scoring():
    for i, found in enumerate(toxicity.words_of(chunk_of(TEXTS))):
        low = lowered(TEXTS[i]).encode()
        assert found == {m.decode() for m in re.findall(rb"[a-z\x80-\xff]+", low)}


@pytest.fixture(scope="module")
def tables():
    return "/root/testdata/sf0.01"


def test_scores_do_not_follow_partitions(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").filter("doc_id % 5 = 0")
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    lang = language_id.fit(docs, epochs=2)
    tox = toxicity.fit(docs, labels, per_class=50)
    qual = quality.fit(quality.measure(docs), labels)
    results = []
    for frame in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id"))):
        rows = toxicity.score(language_id.predict(frame, lang), tox, "t").select("doc_id", "lang_pred", "score", "t")
        rows = rows.join(quality.score(quality.measure(frame), qual, "q"), "doc_id")
        results.append(sorted(tuple(r) for r in rows.collect()))
    for other in results[1:]:
        for a, b in zip(results[0], other):
            assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=1e-12)


def test_held_out_accuracy(spark, tables):
    docs, labels = (spark.read.parquet(f"{tables}/{t}.parquet") for t in ("documents", "labels"))
    held = lambda m, v: remainder("doc_id", m) == v
    tox = toxicity.fit(docs, labels, ~held(5, 0))
    rows = toxicity.score(docs.select("doc_id", "text"), tox).join(labels, "doc_id").filter(held(5, 0)).collect()
    assert len(rows) > 50 and np.mean([(r["score"] >= 0.5) == bool(r["toxic"]) for r in rows]) > 0.95
    measured = quality.measure(docs)
    rows = quality.score(measured, quality.fit(measured, labels, ~held(4, 2))).join(labels, "doc_id").filter(held(4, 2)).collect()
    assert len(rows) > 50 and np.mean([(r["score"] >= 0.7) == bool(r["quality"]) for r in rows]) > 0.95
    model = language_id.fit(docs, ~held(3, 1))
    rows = language_id.predict(docs, model).filter(held(3, 1) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).collect()
    assert len(rows) > 200 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(language_id, "TEXTS", 300)
    rng = random.Random(3)
    docs = []
    for k in range(100):
        for i in range(1 if k == 77 else 8):
            docs.append((k * 10 + i, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}{rng.choice('xyz')}" for _ in range(20)), f"l{k:03d}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    chosen = language_id.sample(frame).groupBy("lang").count().collect()
    assert len(chosen) == 100 and sum(r["count"] for r in chosen) < 500
    assert len(language_id.fit(frame, epochs=1).languages) == 100
