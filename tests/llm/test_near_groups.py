"""Near dedup on large groups: thousands of near copies, and unlike documents that share a passage."""

import random

import numpy as np
import pyarrow as pa
import pytest

from backtrail.llm import near_dedup, textbytes


def prose(rng, n, vocabulary=10**6):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("tile", [256, 8])
def test_hot_groups(spark, monkeypatch, tile):
    """Near copies of one text are one class; documents that only share a passage stay apart."""
    monkeypatch.setattr(near_dedup, "TILE_ROWS", tile)
    rng = random.Random(3)
    base, passage = prose(rng, 150), prose(rng, 100)
    texts = [edited(rng, base, rng.randrange(2)) for _ in range(1200)]
    texts += [" ".join([*prose(rng, 40), *passage, *prose(rng, 40)]) for _ in range(300)]
    texts += [edited(rng, passage + prose(rng, 10, 5), 1) for _ in range(60)]
    docs = [(i, t) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(6)).collect()}
    assert {got[i] for i in range(1200)} == {0}
    assert all(got[i] == i for i in range(1200, 1500))
    seqs = [near_dedup.kmers(next(textbytes.chunks(pa.array([t], pa.string()))))[0] for t in texts[1500:]]
    parent = list(range(60))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(60):
        for j in range(i):
            if near_dedup.similar(seqs[i], seqs[j]):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert [got[1500 + i] - 1500 for i in range(60)] == [root(i) for i in range(60)]


def test_few_pairs_are_aligned(spark, monkeypatch):
    """Documents that share half their words are told apart by bounds; near copies join once."""
    rng = random.Random(5)
    passage = prose(rng, 100)
    unlike = [" ".join([*prose(rng, 50), *passage, *prose(rng, 50)]) for _ in range(80)]
    base = prose(rng, 200)
    texts = unlike + [edited(rng, base, 1) for _ in range(80)]
    aligned = []
    plain = near_dedup.similar
    monkeypatch.setattr(near_dedup, "similar", lambda a, b, *x: aligned.append(1) or plain(a, b, *x))
    seqs = [near_dedup.kmers(next(textbytes.chunks(pa.array([t], pa.string()))))[0] for t in texts]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, 7)), pa.array(np.zeros(n, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(np.arange(n)),
         pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32)), pa.array(texts)],
        ["bucket", "lo", "hi", "node", "component", "block", "text"])
    links = [p for out in near_dedup._bridging(iter([batch])) for p in zip(*(c.to_pylist() for c in out.columns))]
    assert len(links) == 79 and all(a >= 80 and b >= 80 for a, b in links)
    assert len(aligned) < 100 and len(seqs) == n
