"""The pipeline against plain versions of its stages, and recall on the given table."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from backtrail.llm import line_dedup, near_dedup, textbytes, toxicity
from backtrail.llm.common import remainder
from tests.llm.test_llm import lcs, prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def signature(value):
    """A doc_id's place in the hashed order of its source."""
    return hashlib.md5(str(value).encode()).hexdigest()


def plain_lines(docs):
    """Later copies of runs of three lines, or of one or two lines with twenty words, go."""
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        if text is None:
            out[i] = None
            continue
        lines = text.split("\n")
        held = [j for j, x in enumerate(lines) if x.split()]
        gone = set()
        for s in range(len(held)):
            for n in (1, 2, 3):
                run = tuple(lines[j] for j in held[s:s + n])
                if len(run) == n:
                    if run in seen and (n == 3 or sum(len(x.split()) for x in run) >= line_dedup.MIN_WORDS):
                        gone.update(held[s:s + n])
                    seen.add(run)
        if not held or len(gone) < len(held):
            out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


def kmers_of(texts):
    return [s for c in textbytes.chunks(pa.array(texts, pa.string())) for s in near_dedup.kmers(c)]


def plain_near(docs):
    ids = sorted(docs)
    seqs = [s.tolist() for s in kmers_of([docs[i] for i in ids])]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if seqs[i] and seqs[j]:
                m = lcs(seqs[i], seqs[j])
                if m / (len(seqs[i]) + len(seqs[j]) - m) >= 0.8:
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    return {ids[i]: docs[ids[i]] for i in range(len(ids)) if root(i) == i}


def plain_clean(docs, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    tests = {tuple(w[s:s + min(10, len(w))]) for w in map(words, items) for s in range(len(w) - min(10, len(w)) + 1) if w}
    sizes = {len(t) for t in tests}
    return {i: t for i, t in docs.items()
            if not any(tuple(words(t)[s:s + n]) in tests for n in sizes for s in range(len(words(t)) - n + 1))}


def plain_copies(docs, source):
    """How often the mix takes each document."""
    size = {i: len((t or "").split()) for i, t in docs.items()}
    total = defaultdict(int)
    for i in docs:
        total[source[i]] += size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped: set = set()
    while True:
        rest = 1.5 * sum(total.values()) - sum(2 * total[s] for s in capped)
        price = rest / sum(weight[s] for s in order if s not in capped)
        more = {s for s in order if s not in capped and 2 * total[s] <= price * weight[s]}
        if not more or len(capped | more) == len(order):
            break
        capped |= more
    out = {}
    for s in order:
        target = 2 * total[s] if s in capped else min(2 * total[s], price * weight[s])
        offset = 0
        for i in sorted((i for i in docs if source[i] == s), key=lambda i: (signature(i), i)):
            passes = int(target // total[s]) if total[s] else 0
            extra = size[i] > 0 and offset + size[i] / 2 <= target - passes * total[s]
            out[i] = min(2, passes + extra)
            offset += size[i]
    return out


def test_pipeline_brute_force(spark, tmp_path):
    rng = random.Random(31)
    shared = [" ".join(prose(rng, n, 10**6)) for n in (25, 12, 6, 5, 4)]
    items = [" ".join(prose(rng, 12, 10**6)) for _ in range(4)]
    bases = [prose(rng, 80, 10**6) for _ in range(6)]
    docs, toxic = [], {}
    for i in range(140):
        kind = i % 7
        lines = [" ".join(prose(rng, rng.randrange(5, 25), 10**6)) for _ in range(rng.randrange(1, 5))]
        if kind == 0:
            lines[0:0] = rng.sample(shared, 3) if i % 2 else shared[2:5]
        elif kind == 1:
            words = list(bases[rng.randrange(6)])
            words[rng.randrange(80)] = "changed"
            lines = [" ".join(words)]
        elif kind == 2 and i % 4 == 0:
            lines.append("so " + rng.choice(items) + " then")
        if kind == 3:
            lines = [" ".join(rng.choice(["you", "vile", "scum", "idiot", "are", *prose(rng, 3)]) for _ in range(30))]
        toxic[i] = int(kind == 3)
        docs.append((i, "\n".join(lines), "en", rng.choice(["a", "b", "c", None]), 0))
    docs += [(140, None, None, "a", 0), (141, "", "en", "b", 0)]
    folder = str(tmp_path)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    labels = spark.createDataFrame([(i, 1 - t, t) for i, t in toxic.items()], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()

    table = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.fit(table, labels, remainder("doc_id", 5) != 0)
    texts = pa.array([t for _, t, *_ in docs], pa.string())
    scores = np.concatenate([model.scores(toxicity.features(c, model.lexicon)) for c in textbytes.chunks(texts)])
    kept = {d[0]: d[1] for d, s in zip(docs, scores) if s < 0.5}
    assert 0 < len(docs) - len(kept) < 40 and sum(toxic[i] for i in kept if i in toxic) < 5
    stages = [kept, plain_lines(kept)]
    stages.append(plain_near(stages[-1]))
    stages.append(plain_clean(stages[-1], items))
    sizes = list(map(len, stages))
    assert all(a > b for a, b in zip(sizes[1:], sizes[2:])), sizes
    copies = plain_copies(stages[-1], {d[0]: d[3] for d in docs})
    want = sorted((i, stages[-1][i], k + 1) for i, n in copies.items() for k in range(n))
    assert sorted((r["doc_id"], r["text"], r["copy"]) for r in out) == want and len(want) > 40


def test_recall_of_near_dedup_on_documents(spark):
    """Every pair of sf0.01 with a similarity of 0.8 or more stands in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    seqs = kmers_of([r["text"] for r in rows])
    holders = defaultdict(list)
    for i, s in enumerate(seqs):
        for h in np.unique(s).tolist():
            holders[h].append(i)
    common = defaultdict(int)
    for held in holders.values():
        for a, i in enumerate(held):
            for j in held[:a]:
                common[j, i] += 1
    near = [(i, j) for (i, j), n in common.items()
            if 1.8 * n >= 0.8 * (len(np.unique(seqs[i])) + len(np.unique(seqs[j]))) and near_dedup.similar(seqs[i], seqs[j])
            or n >= 1 and len(np.unique(seqs[i])) < len(seqs[i]) and near_dedup.similar(seqs[i], seqs[j])]
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    found = sum(got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in near)
    assert len(near) >= 100 and found == len(near)


@pytest.mark.parametrize("name", ["check_s"])
def test_recall_of_embedding_dedup(spark, name):
    """Links of a table with groups of near copies, against all pairs."""
    from backtrail.llm import collisions

    vectors = spark.read.parquet(f"/root/testdata/{name}/embeddings.parquet").select("vec_id", "embedding")
    rows = vectors.orderBy("vec_id").collect()
    unit = np.array([r["embedding"] for r in rows], float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    links = {}
    for lo in range(0, len(unit), 2000):
        for r, n in zip(rows[lo:lo + 2000], (unit[lo:lo + 2000] @ unit.T >= 0.9).sum(1) - 1):
            links[r["vec_id"]] = int(n)
    got = {r["vec_id"]: r["n_links"] for r in collisions.near_vectors(vectors).collect()}
    total = sum(links.values())
    assert total > 20_000 and all(got[i] <= n for i, n in links.items())
    assert sum(got.values()) >= 0.999 * total
