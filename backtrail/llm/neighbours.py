"""Approximate nearest neighbours by a block matrix join with int8 tiles.

Vectors are dealt into blocks of about BLOCK candidates and QUERY_BLOCK queries by a hash of
their ids, and each pair of blocks is one tile. A tile holds the products of vectors
rounded to int8; with the rounding errors' norms they bound every cosine from both sides.
Pairs whose upper bound reaches the k-th best lower bound of their query survive and are
computed again in double precision from the original vectors. Each tile keeps the k best
of a query in a heap; a task merges the heaps of its tiles before the last merge. Since the
bounds hold, nothing is missed: the result is exact.

Every query meets every candidate, which is what a stated query set asks for; blocks keep
memory bounded. Vectors that are null, zero, or hold a null or non-finite component take
no part, nor do rows of a null id. Vectors of other lengths than the query's are not
compared with it. Repeated rows of an id are candidates of their own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK, QUERY_BLOCK = 4096, 1024


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector): the rows that take part, in doubles."""
    vector = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector"))
    big = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False))
                       & F.exists("vector", lambda x: x != 0))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors whose squares could overflow or vanish, divided by a power of two near their largest component.

    That changes no digit, so that the others keep their cosines as they are.
    """
    most = np.abs(vectors).max(1)
    wild = (most > 2.0**400) | (most < 2.0**-400)
    if not wild.any():
        return vectors
    out = vectors.copy()
    out[wild] = np.ldexp(out[wild], -np.frexp(most[wild])[1][:, None])
    return out


def quantized(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 units, scales, error norms): unit vectors are units * scale, off by the error."""
    unit = scaled(vectors)
    unit = unit / np.sqrt((unit**2).sum(1))[:, None]
    scale = np.abs(unit).max(1) / 127
    cells = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - cells * scale[:, None])**2).sum(1))
    return cells, scale, error


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of pairs of rows; sums run in the order of the components."""
    a, b = scaled(a), scaled(b)
    dot, aa, bb = np.zeros(len(a)), np.zeros(len(a)), np.zeros(len(a))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return np.clip(dot / np.sqrt(aa * bb), -1.0, 1.0)


def tile(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray,
         k: int) -> list[tuple[int, int, float]]:
    """(query, neighbour, cosine): the k best of each query within one tile."""
    q, q_scale, q_error = quantized(queries)
    c, c_scale, c_error = quantized(vectors)
    # Products of int8 are whole numbers, which float32 sums exactly up to 2^24.
    kind = np.float32 if q.shape[1] * 127 * 127 < 2**24 else np.float64
    near = (q.astype(kind) @ c.T.astype(kind)).astype(np.float64) * q_scale[:, None] * c_scale[None, :]
    # |q.c - q'.c'| <= |q - q'| |c| + |q'| |c - c'|, and |q'| <= 1 + |q - q'|.
    slack = q_error[:, None] + (1 + q_error[:, None]) * c_error[None, :] + 1e-9
    own = query_ids[:, None] == ids[None, :]
    lower = np.where(own, -np.inf, near - slack)
    if len(ids) > k:
        bar = -np.partition(-lower, k - 1, axis=1)[:, k - 1]
    else:
        bar = np.full(len(query_ids), -np.inf)
    rows, cols = np.nonzero((near + slack >= bar[:, None]) & ~own)
    out: list[tuple[int, int, float]] = []
    for lo in range(0, len(rows), 1 << 16):
        r, c_at = rows[lo:lo + (1 << 16)], cols[lo:lo + (1 << 16)]
        exact = cosine(queries[r], vectors[c_at])
        out.extend(zip(query_ids[r].tolist(), ids[c_at].tolist(), exact.tolist()))
    return best(out, k)


def best(found: list[tuple[int, int, float]], k: int) -> list[tuple[int, int, float]]:
    """The k nearest of each query, ties to the smaller id."""
    by_query: dict[int, list[tuple[float, int]]] = {}
    for query, other, score in found:
        heap = by_query.setdefault(query, [])
        entry = (score, -other)
        if len(heap) < k:
            heapq.heappush(heap, entry)
        elif entry > heap[0]:
            heapq.heapreplace(heap, entry)
    return [(query, -other, score) for query, heap in by_query.items() for score, other in heap]


def _frame(rows: list[tuple[int, int, float]]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype(
        {"query_id": "int64", "vec_id": "int64", "score": "float64"})


def search(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each query.

    `is_query` is a condition on vec_id. Fewer candidates give fewer rows; a query that
    takes no part gives none.
    """
    rows = usable(vectors)
    queries = rows.filter(is_query).dropDuplicates(["vec_id", "vector"])
    n, n_queries = rows.count(), queries.count()
    blocks, query_blocks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(n_queries / QUERY_BLOCK))
    size = F.size("vector").alias("size")
    # Identical rows of one id go to the same block; vectors that differ are spread.
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int")
    query_block = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(query_blocks)).cast("int")
    left = queries.select("vec_id", "vector", size, query_block.alias("qb"),
                          F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("cb"))
    right = rows.select(F.col("vec_id").alias("other_id"), F.col("vector").alias("other"), size, block.alias("cb"),
                        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"))

    def tiles(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return _frame([])
        out = tile(a["vec_id"].to_numpy(), np.stack(a["vector"]), b["other_id"].to_numpy(),
                   np.stack(b["other"]), k)
        return _frame(out)

    by = ["size", "qb", "cb"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(
        tiles, "query_id long, vec_id long, score double")
    def merged(groups: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, int, float]] = []
        for g in groups:
            held = best(held + list(zip(g["query_id"], g["vec_id"], g["score"])), k)
        yield _frame(held)

    # Each task first merges the heaps of its own tiles; what is left is k rows per query and task.
    found = found.select("query_id", "vec_id", "score").mapInPandas(
        merged, "query_id long, vec_id long, score double")

    def top(g: pd.DataFrame) -> pd.DataFrame:
        rows = best(list(zip(g["query_id"], g["vec_id"], g["score"])), k)
        rows.sort(key=lambda r: (-r[2], r[1]))
        out = _frame(rows)
        out.insert(1, "rank", np.arange(1, len(out) + 1, dtype=np.int32))
        return out

    return found.groupBy("query_id").applyInPandas(
        top, "query_id long, rank int, vec_id long, score double")
