"""Embedding near-dedup by collision counting on sorted one-dimensional projections.

A rotation is a set of up to 64 orthonormal directions. A vector is entered in one sorted
list per rotation: that of the direction on which it lies furthest out, and of the side. Two
vectors collide on a rotation if they are entered in the same list. At a cosine of 0.9 in
64 dimensions they do with a chance of 0.46, at a cosine of 0 in 1 of 128.

Search lists are sorted by the entries of `depth` rotations at once and then by the
projection, so that they stay short however large the table is: depth is the least for which
unrelated vectors fill a list with CROWD entries. In each, every vector is compared with
those in a window around its own projection. Of each such pair the collisions on COUNTED
rotations are counted; pairs below the calibrated count are given up. The others are verified
with the cosine of the original vectors in double precision. The number of search lists, the
width of windows and the count are calibrated on pairs simulated at the similarity itself, so
that a pair there is missed with a chance of some MISS, and closer ones hardly ever.

First, only entries and counts are dealt out, and nodes that pass no pair fall away. Vectors
are then sent to the lists where they are needed. A pair is taken in the first search list
that both vectors meet in, and a task adds it up at once: links per node, and a forest of its
links. No pairs are written or shuffled. A list of more than MAX_LIST entries is dealt into
blocks, and each pair of blocks is compared on its own.

Identical vectors are one node with a number of copies. Vectors that are null, empty, zero
or hold a null or non-finite component link with nothing, nor do vectors of different
lengths. Repeated rows and rows without an id are vectors of their own; a component without
any id has the id null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.components import components
from backtrail.llm.tiles import dealt, whole_groups
from backtrail.session import stored

SIMILARITY = 0.9
DIRECTIONS, COUNTED, CROWD, MISS = 64, 64, 32, 5e-4
MAX_LIST = 2048
PAIRS = 1 << 15                  # compared at once
_GRID = 1 << 14                  # steps of a projection, so that its last bits don't matter

_LIST = ["size", "list", "cell"]


@lru_cache(maxsize=4096)
def rotation(size: int, number: int) -> np.ndarray:
    """Orthonormal directions as columns."""
    rng = np.random.default_rng((size, number))
    q, r = np.linalg.qr(rng.normal(size=(size, min(size, DIRECTIONS))))
    return q * np.sign(np.diag(r))


def entered(unit: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(list, projection in steps) of each unit vector on a rotation; the list holds the side."""
    on = np.rint(unit @ rotation(unit.shape[1], number) * _GRID).astype(np.int32)
    far = np.abs(on).argmax(1)
    value = on[np.arange(len(on)), far]
    return (far * 2 + (value < 0)).astype(np.uint8), value


@dataclass(frozen=True)
class Plan:
    depth: int      # rotations that a search list is sorted by
    lists: int      # search lists
    window: int     # half width, in steps
    least: int      # collisions of COUNTED

    @property
    def rotations(self) -> int:
        return max(COUNTED, self.depth * self.lists)


@lru_cache(maxsize=256)
def plan(size: int, n: int, similarity: float = SIMILARITY, miss: float = MISS) -> Plan:
    """The calibrated plan for vectors of `size` components among `n`."""
    rng = np.random.default_rng(size)
    pairs, rotations = 2000, 24
    a, b = rng.normal(size=(2, pairs, size))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b -= (a * b).sum(1)[:, None] * a
    norm = np.linalg.norm(b, axis=1)[:, None]
    b = similarity * a + np.sqrt(1 - similarity**2) * b / np.where(norm > 1e-9, norm, 1)
    b /= np.linalg.norm(b, axis=1)[:, None]
    met, apart = [], []
    for i in range(rotations):
        (x, u), (y, v) = entered(a, i), entered(b, i)
        met.append(x == y)
        apart.append(np.abs(u - v)[x == y])
    chance = max(np.concatenate(met).mean(), 0.01)
    chance = min(chance - 2 * np.sqrt(chance * (1 - chance) / (pairs * rotations)), 0.999)
    window = int(np.quantile(np.concatenate(apart), 1 - miss)) + 1 if chance < 0.999 else 2 * _GRID
    depth = 1
    while depth < 8 and n > CROWD * (2 * min(size, DIRECTIONS)) ** depth:
        depth += 1
    lists = int(np.ceil(np.log(miss) / np.log1p(-min(chance**depth * (1 - miss), 0.999))))
    below, least = 0.0, 0
    while least < COUNTED:
        below += comb(COUNTED, least) * chance**least * (1 - chance) ** (COUNTED - least)
        if below > miss:
            break
        least += 1
    return Plan(depth, lists, window, least)


def usable(vector: Column) -> Column:
    big = F.lit(float("inf"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors in doubles) for each length that occurs."""
    sizes = np.asarray(column.value_lengths())
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, values[starts[rows][:, None] + np.arange(size)]


def units(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(1)[:, None]
    return scaled / np.sqrt((scaled**2).sum(1))[:, None]


def cells(found: list[tuple[np.ndarray, np.ndarray]], at: Plan) -> tuple[np.ndarray, np.ndarray]:
    """(cell, projection) of each vector in each search list, from its entries by rotation."""
    cell = np.zeros((len(found[0][0]), at.lists), np.int64)
    value = np.empty((len(cell), at.lists), np.int32)
    for j in range(at.lists):
        value[:, j] = found[j * at.depth][1]
        for i in range(at.depth):
            cell[:, j] = cell[:, j] << 7 | found[j * at.depth + i][0]
    return cell, value


def _entries(n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, vectors in matrices(batch.column(1)):
                for lo in range(0, len(rows), 2048):
                    part = rows[lo:lo + 2048]
                    at = plan(vectors.shape[1], n, similarity)
                    unit = units(vectors[lo:lo + 2048])
                    found = [entered(unit, i) for i in range(at.rotations)]
                    codes = np.stack([c for c, _ in found[:COUNTED]], 1)
                    cell, value = cells(found, at)
                    codes = pa.array([c.tobytes() for c in codes], pa.binary())
                    node = batch.column(0).take(pa.array(part))
                    for j in range(at.lists):
                        k = len(part)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(k, vectors.shape[1], np.int32)), pa.array(np.full(k, j, np.int32)),
                             pa.array(np.ascontiguousarray(cell[:, j])), pa.array(np.ascontiguousarray(value[:, j])),
                             node, codes], [*_LIST, "value", "node", "codes"])
    return run


def window_pairs(number: np.ndarray, value: np.ndarray, window: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of one list whose projections are at most their window apart."""
    place = number.astype(np.int64) * (8 * _GRID) + value
    last = np.searchsorted(place, place + window, side="right")
    take = last - np.arange(len(place)) - 1
    total = np.cumsum(take)
    lo = 0
    while lo < len(place):
        done = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS, side="right")))
        width = take[lo:hi]
        left = np.repeat(np.arange(lo, hi), width)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(width) - width, width)
        lo = hi


def _candidates(batches, n: int, similarity: float):
    """(table, pairs) of dealt lists; the two rows of a pair are of the two blocks compared."""
    for table, number in whole_groups(batches, [*_LIST, "lo", "hi"]):
        size = table.column("size").to_numpy()
        plans = {s: plan(s, n, similarity) for s in np.unique(size).tolist()}
        window = np.array([plans[s].window for s in size.tolist()])
        block, across = table.column("block").to_numpy(), table.column("lo").to_numpy() != table.column("hi").to_numpy()

        def pairs():
            for left, right in window_pairs(number, table.column("value").to_numpy(), window):
                wanted = ~across[left] | (block[left] != block[right])
                yield left[wanted], right[wanted]

        yield table, plans, size, pairs()


def _live(n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, plans, size, pairs in _candidates(batches, n, similarity):
            codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(-1, COUNTED)
            least = np.array([plans[s].least for s in size.tolist()])
            live = np.zeros(len(codes), bool)
            for left, right in pairs:
                passed = (codes[left] == codes[right]).sum(1) >= least[left]
                live[left[passed]] = True
                live[right[passed]] = True
            kept = table.select([*_LIST, "value", "node"]).filter(pa.array(live))
            yield from kept.to_batches()
    return run


def join_up(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the smallest index joined to each) after the links (a, b) are added."""
    while True:
        x, y = labels[a], labels[b]
        if (x == y).all():
            return labels
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _verified(n: int, similarity: float):
    names = ["node", "links", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, plans, size, pairs in _candidates(batches, n, similarity):
            rows = table.num_rows
            node, times = table.column("node").to_numpy(), table.column("times").to_numpy()
            at_list = table.column("list").to_numpy()
            links, labels = np.zeros(rows, np.int64), np.arange(rows)
            # The rows of one node stand under one index.
            _, first, same = np.unique(node, return_index=True, return_inverse=True)
            own = first[same]
            held = {}
            where = np.zeros(rows, np.int64)
            for of, vectors in matrices(table.column("embedding").combine_chunks()):
                at = plans[vectors.shape[1]]
                unit = units(vectors)
                found = [entered(unit, i) for i in range(at.rotations)]
                held[vectors.shape[1]] = (unit, np.stack([c for c, _ in found[:COUNTED]], 1), *cells(found, at))
                where[of] = np.arange(len(of))
            for left, right in pairs:
                for s in np.unique(size[left]).tolist():
                    at, (unit, codes, cell, value) = plans[s], held[s]
                    mine = size[left] == s
                    i, j = left[mine], right[mine]
                    x, y = where[i], where[j]
                    good = (codes[x] == codes[y]).sum(1) >= at.least
                    i, j, x, y = i[good], j[good], x[good], y[good]
                    good = np.einsum("ij,ij->i", unit[x], unit[y]) >= similarity
                    i, j, x, y = i[good], j[good], x[good], y[good]
                    meet = (cell[x] == cell[y]) & (np.abs(value[x] - value[y]) <= at.window)
                    good = meet.argmax(1) == at_list[i]  # taken in the first list that both meet in
                    i, j = i[good], j[good]
                    np.add.at(links, i, times[j])
                    np.add.at(links, j, times[i])
                    labels = join_up(labels, own[i], own[j])
            linked = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(node[linked]), pa.array(links[linked]), pa.array(node[labels[own[linked]]])], names)
    return run


def links(vectors: DataFrame, similarity: float = SIMILARITY, max_list: int = MAX_LIST) -> tuple[DataFrame, DataFrame]:
    """(nodes, found): nodes (node, embedding, times, first) are the different usable vectors with their
    copies and smallest id; found (node, links, root) has a part of a node's links, and a node it is joined to.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(usable(F.col("embedding")))
    nodes = stored(rows.groupBy("embedding").agg(
        F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("first")).withColumn(
            "node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    schema = "size int, list int, cell long, value int, node long"
    entries = nodes.select("node", "embedding").mapInArrow(_entries(n, similarity), schema + ", codes binary")
    entries = stored(entries, "entries")
    live = dealt(entries, _LIST, "node", max_list, "value", "node").mapInArrow(_live(n, similarity), schema)
    live = stored(live.dropDuplicates(["list", "node"]), "live")
    full = live.join(nodes.select("node", "times", "embedding"), "node")
    found = dealt(full, _LIST, "node", max_list, "value", "node", counted=live).mapInArrow(_verified(n, similarity), "node long, links long, root long")
    return nodes, stored(found, "found")


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, max_list: int = MAX_LIST) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors` (vec_id, embedding)."""
    nodes, found = links(vectors, similarity, max_list)
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.filter(F.col("node") != F.col("root")).select(
        F.col("node").alias("a"), F.col("root").alias("b")))
    named = joined.join(nodes.select("node", "first"), "node")
    named = named.join(named.groupBy("component").agg(F.min("first").alias("component_id")), "component").select(
        "node", "component_id")
    known = nodes.join(counts, "node", "left").join(named, "node", "left").select(
        "embedding", (F.col("times") - 1 + F.coalesce("links", F.lit(0).cast("bigint"))).alias("n_links"),
        F.coalesce("component_id", "first").alias("component_id"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = rows.withColumn("embedding", F.when(usable(F.col("embedding")), F.col("embedding")))
    out = rows.join(known, "embedding", "left")
    name = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                      name.alias("component_id"), F.col("vec_id").eqNullSafe(name).alias("kept"))
