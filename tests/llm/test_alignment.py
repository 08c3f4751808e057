"""Cross-tokenizer alignment against whole-text encoding, and on awkward tables."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from backtrail.llm import alignment


@pytest.fixture(scope="module")
def pair():
    return alignment.Pair()


def expected(pair, docs):
    """Rows by encoding each text whole and comparing all token ends."""
    parts, links = [], []
    for doc, text in docs:
        row, own = (doc, 0, 0, 0, ""), []
        if text:
            a = pair.a.encode(" " + text, add_special_tokens=False).ids
            b = pair.b.encode(text)
            left, right = [pair.a_bytes[i] for i in a], [pair.b_bytes[i] for i in b]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                ends = [{int(e): i for i, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (left, right)]
                groups, lo, lo2 = [], 0, 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    i, j = ends[0][e], ends[1][e]
                    groups.append(",".join(map(str, a[lo:i + 1])) + "|" + ",".join(map(str, b[lo2:j + 1])))
                    own.append((a[i], b[j]))
                    lo, lo2 = i + 1, j + 1
                row = (doc, len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest())
        parts.append(row)
        links.append(own)
    count = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    rows = [(d, na, nb, ng, len(own), sum(count[p] == top[p[1]] for p in own), sum(count[p] for p in own), sha)
            for (d, na, nb, ng, sha), own in zip(parts, links)]
    return rows, count, links


def got(frame):
    rows = alignment.report(frame).collect()
    return [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
            for r in rows]


@pytest.fixture(scope="module")
def docs(sf):
    rng = random.Random(4)
    chars = ["a", "The", "don't", " ", "  ", "\n", "\t", "\r", " ", "　", "é", "Ж", "字", "🙂", "'s", "123", "▁", "\x85",
             "<|endoftext|>", "<s>", "<0x41>", "—", "ﬁ", "é", "\x00", "ß", "￼"]
    rows = [(i, "".join(rng.choice(chars if i % 3 else chars[:16]) for _ in range(rng.randrange(1, 60)))) for i in range(250)]
    rows += [(300, None), (301, ""), (302, " "), (303, "   "), (304, "word "), (305, "word  \n "), (None, "the null id"),
             (306, "x" * 20_000), (307, "long text of words " * 20_000), (308, " lead"), rows[0], rows[0]]
    rows += [(1000 + i, "the same words, words") for i in range(2000)]  # enough for bit fields
    return rows + [(309, f" {w} end{w}  {w}\n {w}") for w in ("a\xa0", "字", "é", "​")]


def test_units_are_encoded_as_in_the_whole_text(pair, docs):
    for _, text in docs:
        if not text:
            continue
        data = np.frombuffer((" " + text).encode(), np.uint8)
        bounds = [*alignment.cut_units(data, np.array([0])).tolist(), len(data)]
        units = [bytes(data[x:y]).decode() for x, y in zip(bounds, bounds[1:])]
        assert "".join(units) == " " + text
        assert [i for u in units for i in pair.a.encode(u, add_special_tokens=False).ids] == \
            pair.a.encode(" " + text, add_special_tokens=False).ids
        assert [i for u in units for i in pair.b.encode(u[1:])] == pair.b.encode(text)


def test_report_brute_force(spark, pair, docs, monkeypatch):
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for name in ("block", "at", "pair", "n_a", "best"):
        frame = frame.withColumn(name, F.lit("own"))
    want, count, links = expected(pair, docs)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sum(r[3] for r in want) > 1000 and any(r[1] == 0 and t for r, (_, t) in zip(want, docs))
    assert sorted(got(frame), key=key) == sorted(want, key=key)
    aligned = alignment.encode(frame)
    rows = alignment.pair_counts(aligned).collect()
    documents = Counter(p for own in links for p in set(own))
    assert {(r["a"], r["b"]): (r["n_links"], r["n_docs"]) for r in rows} == {p: (n, documents[p]) for p, n in count.items()}
    monkeypatch.setattr("backtrail.plans.groups.SMALL_ROWS", 1)  # scores too many for a broadcast
    assert sorted(got(frame), key=key) == sorted(want, key=key)


def test_report_on_documents(spark, pair, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    want, _, _ = expected(pair, [tuple(r) for r in docs.collect()])
    assert sorted(got(docs)) == sorted(want)


def test_bitmaps_round_trip():
    rng = np.random.default_rng(5)
    sets = [np.sort(rng.choice(alignment.BLOCK_DOCS, n, replace=False)) for n in (1, 7, 511, 512, 513, 8192, 3)]
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    for chosen in (sets, sets[:3]):
        places = np.concatenate(chosen).astype("<u2")
        bitmaps = alignment.compressed(places, bounds[:len(chosen) + 1])
        rows, found = alignment.places_of(bitmaps.slice(1))
        for i, s in enumerate(chosen[1:]):
            assert (np.sort(found[rows == i]) == s).all()
        assert max(len(b.as_py()) for b in bitmaps) <= alignment.FIELD


def test_block_planes():
    block = alignment.Block()
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2, 3])], ["doc_id"])
    block.add(docs, np.array([5 << 13 | 0, 5 << 13 | 2, 9 << 13 | 1]), np.array([1, 6, 2]))
    block.add(docs, np.array([5 << 13 | 2]), np.array([2]))
    pairs, planes, bitmaps = block.postings()
    rows, places = alignment.places_of(bitmaps)
    found = [(int(p), int(q), places[rows == i].tolist()) for i, (p, q) in enumerate(zip(pairs, planes))]
    assert found == [(5, 0, [0, 2]), (5, 1, [2]), (5, 2, [2]), (5, 3, [2]), (9, 0, [1]), (9, 1, [1])]


def test_no_documents(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.report(frame).count() == 0
    assert got(spark.createDataFrame([(1, None)], "doc_id long, text string")) == [(1, 0, 0, 0, 0, 0, 0, "")]
