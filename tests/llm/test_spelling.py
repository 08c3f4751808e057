"""Spelling variants against brute force, and on awkward tables."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from backtrail.llm import spelling


def expected(docs, ratio=10, cut=31):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if cut and h % cut == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if a == b or len(b) - len(a) > 1:
            return False
        p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[p + (len(a) == len(b)):] == b[p + 1:]

    out, form = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
        out[w] = (n, len(others))
    rows = {}
    for w, (n, k) in out.items():
        end = w
        while form[end] is not None:
            end = form[end]
        rows[w] = (form[w], end, n, k, words.get(form[w]))
    return rows


def rows_of(frame):
    got = [tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: r[1:] for r in got}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    stems = ["abcabca", "aaaaaaa", "éclairée", "Straßen", "xyxyxyxy", "÷oddone×"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(40):
            w = list(rng.choice(stems))
            for _ in range(rng.choice([0, 0, 0, 1, 2])):
                at, kind = rng.randrange(len(w)), rng.randrange(3)
                w[at:at + (kind > 0)] = [rng.choice("abcxyéÀ")] * (kind < 2)
            words.append("".join(w) if rng.random() < 0.8 else "".join(w).upper())
        rows.append((i if i % 9 else None, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    return rows + [(200, None), (201, ""), (202, "short one"), (203, "q" * 3000 + " " + "q" * 2999), rows[0],
                   (204, "q" * 3000 + " " + "q" * 2999)]


@pytest.mark.parametrize("max_group", [10_000, 12])
def test_variants_brute_force(spark, docs, max_group):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for name in ("word", "n", "form", "root", "m", "shared"):
        frame = frame.withColumn(name, F.lit(1))
    want = expected(docs)
    assert sum(r[0] is not None for r in want.values()) > 10
    assert any(r[0] is not None and r[1] != r[0] for r in expected(docs, ratio=2).values())
    assert rows_of(spelling.variants(frame, max_group=max_group)) == want
    assert rows_of(spelling.variants(frame, ratio=2, max_group=max_group)) == expected(docs, ratio=2)
    assert rows_of(spelling.variants(frame, cut=None)) == expected(docs, cut=None)


def test_acceptor_is_minimal_and_complete():
    a = spelling.Acceptor()
    start = a.build(sorted(["aab", "abb", "bab", "bbb"]))
    assert len(a.arcs) == 4 and a.count[start] == 4  # two states after one symbol are the same
    assert sorted(a.replaced(start)) == [(0, 1), (0, 2), (1, 3), (2, 3)]


def test_no_words(spark):
    for rows in ([], [(1, None)], [(1, "")], [(1, "singular wordings")]):
        frame = spark.createDataFrame(rows, "doc_id long, text string")
        assert spelling.variants(frame).count() == 0
    one = spark.createDataFrame([(1, "alonely alonely")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(one, cut=None).collect()] == [("alonely", None, "alonely", 2, 0, None)]
