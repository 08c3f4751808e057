"""Embedding near-dedup against brute force, and on awkward tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from backtrail.llm import collisions


def expected(rows, similarity=0.9):
    """(n_links, component) of each row by all pairs."""
    good = {}
    for i, (_, v) in enumerate(rows):
        if v is None or not len(v) or any(x is None for x in v):
            continue
        v = np.array(v, float)
        if np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            good.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for held in good.values():
        at, unit = [i for i, _ in held], np.stack([v for _, v in held])
        for a, b in zip(*np.nonzero(np.triu(unit @ unit.T >= similarity - 1e-12, 1))):
            degree[at[a]] += 1
            degree[at[b]] += 1
            parent[max(root(at[a]), root(at[b]))] = min(root(at[a]), root(at[b]))
    members = {}
    for i in range(len(rows)):
        members.setdefault(root(i), []).append(i)
    name = {r: min((rows[i][0] for i in m if rows[i][0] is not None), default=None) for r, m in members.items()}
    return [(degree[i], name[root(i)]) for i in range(len(rows))]


def compare(spark, rows, kind="float", **options):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    for name in ("node", "links", "first", "size", "list"):
        frame = frame.withColumn(name, F.lit("own"))
    got = [tuple(r) for r in collisions.near_vectors(frame, **options).collect()]
    want = [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, expected(rows))]
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(got, key=key), sorted(want, key=key)


def near(rng, base, cosine, n):
    base = base / np.linalg.norm(base)
    z = rng.normal(size=(n, len(base)))
    z -= (z @ base)[:, None] * base
    z /= np.linalg.norm(z, axis=1)[:, None]
    return cosine * base + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("max_list", [2048, 40])
def test_brute_force(spark, max_list):
    rng = np.random.default_rng(13)
    vectors = [*rng.normal(size=(900, 24))]
    for k, (cosine, n) in enumerate(((0.99, 150), (0.97, 40), (0.955, 30), (0.93, 20))):
        vectors += [*near(rng, vectors[k], cosine, n)]
    vectors += [vectors[5] * 3, vectors[5] * 3, vectors[5] * 3, -vectors[6]]
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(vectors)), vectors)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 24), (5003, [float("nan")] * 24), (5004, [1.0, None]),
             (None, vectors[0].tolist()), (None, [1.0, 2.0]), (5005, [2.0, 4.0]), (5006, [float("inf")] * 24),
             rows[3], (None, None), (5007, [1.0]), (5008, [3.0]), (5009, [-1.0])]
    got, want = compare(spark, rows, "double", max_list=max_list)
    assert sum(n for _, n, _, _ in want) > 10_000
    assert got == want


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(1500):
        base = rng.normal(size=64)
        rows += [(2 * i, base.tolist()), (2 * i + 1, near(rng, base, 0.9005, 1)[0].tolist())]
    got, want = compare(spark, rows, "float")
    found = sum(n for _, n, _, _ in got)
    assert found >= 0.995 * sum(n for _, n, _, _ in want) and all(a[1] <= b[1] for a, b in zip(got, want))


def test_extremes(spark):
    rows = [(1, [1e300, 2e300]), (2, [1e-300, 2e-300]), (3, [1e300, -2e300]), (4, [5e-324, 0.0]), (5, [1.0, 0.0])]
    got, want = compare(spark, rows, "double")
    assert got == want and want[0][1] == 1
    assert compare(spark, []) == ([], [])
    assert compare(spark, [(1, None), (None, None)])[0] == [(1, 0, 1, True), (None, 0, None, True)]


def test_plans_follow_the_table():
    small, large = collisions.plan(64, 1000), collisions.plan(64, 10**9)
    assert small.depth == 1 and large.depth == 4 and large.lists > small.lists
    assert small.least == large.least > 10
    for size in (1, 2, 3, 300):
        assert collisions.plan(size, 10**5).lists >= 1


def test_window_pairs():
    number, value = np.array([0, 0, 0, 1, 1]), np.array([-5, 0, 4, 4, 9], np.int32)
    got = [p for i, j in collisions.window_pairs(number, value, np.full(5, 5)) for p in zip(i.tolist(), j.tolist())]
    assert got == [(0, 1), (1, 2), (3, 4)]
