"""MinHash near-dedup by order MinHash, verified by banded alignment.

A document is the sequence of its 5-word k-mers (lower-cased words between white space; a
shorter document has one k-mer). Each of SKETCHES samples takes the ORDER k-mers with the
smallest hashes, equal k-mers being told apart by their occurrence number, and puts them
back in text order: documents with an equal sample are candidates. Two documents are near
copies when m / (n1 + n2 - m) >= 0.8, where m is the length of the longest common
subsequence of their k-mers. That is found by an alignment that stays within the band
which the threshold allows.

At 0.8, a sample agrees with a chance of about 0.4, so all of 24 miss with about 5 in a
million; a pair that only shares a passage (0.25) agrees in 1 of 250 samples.

Documents of equal words are one node. In each bucket, members are first compared with the
bucket's first node only, which takes a group of thousands of copies in a linear number of
comparisons. Then the members of buckets that still hold several components are brought
together, in blocks of bounded size, and compared across components: first by bounds on the
k-mers that they can have in common (lengths, and counts in 256 ranges of hashes), and only
where these admit a near copy by alignment, unless they have been joined meanwhile. A task
passes on the links that join components, so no pairs are written or shuffled. No link is
lost and no bucket is capped.

Documents without words, and null texts, are classes of their own. Rows that repeat a
doc_id and its text count as one document. A null doc_id sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.llm.common import distinct_docs, fresh
from backtrail.llm.components import components
from backtrail.llm.line_dedup import fingerprint
from backtrail.llm.textbytes import Chunk, Hashes, chunks, mix, whitespace, windows
from backtrail.llm.tiles import block_pairs, gathered, whole_groups
from backtrail.session import stored

WORDS, SIMILARITY, SKETCHES, ORDER = 5, 0.8, 24, 4
TILE_ROWS, TILE_WORDS = 256, 1_000_000

_rng = np.random.default_rng(20240607)
_XOR = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64)
_ODD = _rng.integers(0, 2**63, SKETCHES, dtype=np.uint64) | np.uint64(1)


def kmers(chunk: Chunk, size: int = WORDS) -> list[np.ndarray]:
    """The k-mer hashes of each document of the chunk."""
    data = chunk.lowered()
    starts, ends = chunk.spans(~whitespace(data))
    words = Hashes(data).of(starts, ends)
    bounds = chunk.bounds(starts)
    runs = windows(words, size)
    out = []
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        if hi - lo >= size:
            out.append(runs[lo:hi - size + 1])
        elif hi > lo:
            out.append(windows(words[lo:hi], int(hi - lo), salt=1))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def labelled(seq: np.ndarray) -> np.ndarray:
    """Each k-mer's hash with its occurrence number mixed in."""
    order = np.argsort(seq, kind="stable")
    ranked = seq[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return seq
    first = np.maximum.accumulate(np.where(new, np.arange(len(seq)), 0))
    number = np.empty(len(seq), np.uint64)
    number[order] = np.arange(len(seq)) - first
    return np.where(number > 0, mix(seq ^ mix(number, 3), 2), seq)


def sketch(seq: np.ndarray) -> np.ndarray:
    """One hash per sample: the ORDER smallest k-mers in text order."""
    marked = labelled(seq)
    take = min(ORDER, len(marked))
    with np.errstate(over="ignore"):
        hashed = (marked[None, :] ^ _XOR[:, None]) * _ODD[:, None]
    if take < len(marked):
        at = np.sort(np.argpartition(hashed, take - 1, axis=1)[:, :take], axis=1)
    else:
        at = np.tile(np.arange(take), (SKETCHES, 1))
    key = np.arange(SKETCHES, dtype=np.uint64)
    for j in range(take):
        key = mix(key ^ marked[at[:, j]], j)
    return key


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch.column(2)):
            content, sizes, keys = [], [], []
            for seq in kmers(chunk):
                sizes.append(len(seq))
                if len(seq):
                    whole = windows(seq, len(seq)), windows(seq, len(seq), salt=5)
                    content.append(whole[0].tobytes() + whole[1].tobytes())
                    keys.append(sketch(seq).view(np.int64))
                else:
                    content.append(None)
                    keys.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(chunk.lo, chunk.n), batch.column(1).slice(chunk.lo, chunk.n),
                 pa.array(content, pa.binary()), pa.array(sizes, pa.int32()),
                 pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "content", "n", "sketch"])


def common(a: np.ndarray, b: np.ndarray, needed: int) -> int:
    """Length of the longest common subsequence, or -1 if it is under `needed`.

    Greedy furthest-reaching paths on the diagonals of a band: with m common items there
    are n1 + n2 - 2 m unmatched ones, and no path strays further than that.
    """
    total = len(a) + len(b)
    shorter = min(len(a), len(b))
    same = a[:shorter] == b[:shorter]
    head = shorter if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    shorter = min(len(a), len(b))
    same = a[::-1][:shorter] == b[::-1][:shorter]
    tail = shorter if same.all() else int(same.argmin())
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    n, m = len(a), len(b)
    width = total - 2 * needed
    if n == 0 or m == 0:
        found = head + tail
        return found if found >= needed else -1
    left, right = a.tolist(), b.tolist()
    reach = {1: 0}
    for d in range(0, width + 1):
        for k in range(-d, d + 1, 2):
            if k < -m or k > n:
                continue
            down = reach.get(k + 1, -1)
            over = reach.get(k - 1, -2) + 1
            x = down if k == -d or (k != d and over <= down) else over
            if x < 0:
                continue
            y = x - k
            while x < n and y < m and left[x] == right[y]:
                x += 1
                y += 1
            reach[k] = x
            if x >= n and y >= m:
                return head + tail + (n + m - d) // 2
    return -1


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the aligned share of k-mers is at least `least`."""
    if not len(a) or not len(b):
        return False
    total = len(a) + len(b)
    needed = int(np.ceil(least * total / (1 + least) - 1e-9))
    if min(len(a), len(b)) < needed:
        return False
    # No alignment matches more than the k-mers have in common, counted with repeats.
    if len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) < needed:
        return False
    return common(a, b, needed) >= needed


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left = [s for c in chunks(batch.column(2)) for s in kmers(c)]
        right = [s for c in chunks(batch.column(3)) for s in kmers(c)]
        good = pa.array([similar(x, y) for x, y in zip(left, right)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(good)


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are near copies."""
    one = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    two = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    rows = pairs.join(one, "b").join(two, "a").select("a", "b", "text_a", "text_b")
    return rows.mapInArrow(_verified, "a long, b long")


def _bridging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join different components of a group; a pair already joined is not compared."""
    for table, number in whole_groups(batches, ["bucket", "lo", "hi"]):
        edges = np.flatnonzero(np.diff(number)) + 1
        for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
            if hi - lo < 2:
                continue
            part = table.slice(lo, hi - lo).combine_chunks()
            node, component, block = (part.column(c).to_numpy() for c in ("node", "component", "block"))
            across = part.column("lo")[0].as_py() != part.column("hi")[0].as_py()
            seqs = [s for c in chunks(part.column("text").combine_chunks()) for s in kmers(c)]
            size = np.array([len(s) for s in seqs])
            profile = np.stack([np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256) for s in seqs])
            _, label = np.unique(component, return_inverse=True)
            found: list[tuple[int, int]] = []
            for i in range(len(seqs) - 1):
                others = np.flatnonzero((label[i + 1:] != label[i]) & ((block[i + 1:] != block[i]) | (not across))) + i + 1
                needed = np.ceil(SIMILARITY * (size[i] + size[others]) / (1 + SIMILARITY) - 1e-9)
                fit = np.minimum(size[i], size[others]) >= needed
                others, needed = others[fit], needed[fit]
                # Not more k-mers in common than by the counts of each range of hashes.
                most = np.minimum(profile[others], profile[i]).sum(1)
                for j in others[most >= needed].tolist():
                    if label[i] != label[j] and similar(seqs[i], seqs[j]):
                        found.append((node[i], node[j]))
                        label[label == label[j]] = label[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["a", "b"])


def _bridges(members: DataFrame, labels: DataFrame, texts: DataFrame) -> DataFrame:
    """Links across components, from every bucket that still holds several.

    Members of a bucket's largest component are compared with the others only, and the others
    with all. Buckets of more than TILE_ROWS members or TILE_WORDS words are dealt into blocks.
    """
    placed = members.select("bucket", "node", "n").join(labels, "node", "left").withColumn(
        "component", F.coalesce("component", "node"))
    held = placed.groupBy("bucket", "component").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.col("n").cast("bigint")).alias("words"))
    most = F.struct("rows", "component")
    mixed = held.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("several"), F.max(most).alias("most"), F.max_by("words", most).alias("main_words"),
        F.sum("rows").alias("rows"), F.sum("words").alias("words")).filter(F.col("several") > 1)

    def blocks(rows: Column, words: Column) -> Column:
        return F.ceil(F.greatest(rows / F.lit(TILE_ROWS), words / F.lit(TILE_WORDS))).cast("int")

    others = blocks(F.col("rows") - F.col("most.rows"), F.col("words") - F.col("main_words"))
    whole = blocks(F.col("rows"), F.col("words")) <= 1
    mixed = stored(mixed.select(
        "bucket", F.col("most.component").alias("main"), whole.alias("whole"),
        blocks(F.col("most.rows"), F.col("main_words")).alias("n_main"), others.alias("n_others")), "mixed")
    rows = placed.join(mixed, "bucket")
    is_main, hashed = F.col("component") == F.col("main"), F.xxhash64("node", F.lit(11))
    zero, after = F.lit(0), F.col("n_main")
    block = F.when(F.col("whole"), zero).when(is_main, F.pmod(hashed, F.col("n_main"))).otherwise(
        after + F.pmod(hashed, F.col("n_others"))).cast("int")
    rows = rows.withColumn("block", block)
    last = after + F.col("n_others") - 1
    pairs = F.when(F.col("whole"), block_pairs(F.col("block"), zero, zero)).otherwise(
        block_pairs(F.col("block"), F.when(is_main, after).otherwise(zero), last))
    rows = rows.withColumn("pair", F.explode(pairs)).select("bucket", "node", "component", "block", "pair.lo", "pair.hi")
    rows = gathered(rows.join(texts, "node"), ["bucket"], "node")
    return rows.mapInArrow(_bridging, "a long, b long")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, class_id, class_fp, kept): one row per distinct document.

    The class is named by its smallest (doc_id, fp), which is the one document kept.
    """
    docs = docs.select("doc_id", fingerprint().alias("fp"), "text")
    rows = stored(docs.mapInArrow(
        _sketches, "doc_id long, fp long, content binary, n int, sketch array<long>"), "sketches")
    first = F.min(F.struct("doc_id", "fp"))
    nodes = stored(rows.filter(F.col("content").isNotNull()).groupBy("content").agg(
        first.alias("rep"), F.max("n").alias("n"), F.any_value("sketch").alias("sketch"),
    ).withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", "n", F.posexplode("sketch").alias("sample", "key")).select(
        "node", "n", F.xxhash64("sample", "key").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead"),
                                            F.min_by("n", "node").alias("lead_n"))
    buckets = buckets.filter(F.col("size") > 1)
    members = stored(members.join(buckets, "bucket").drop("size"), "members")

    close = lambda x, y: F.least(x, y) >= F.greatest(x, y) * (SIMILARITY - 1e-9)
    starred = members.filter((F.col("node") != F.col("lead")) & close(F.col("n"), F.col("lead_n")))
    starred = starred.select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    active = members.select("node").distinct().join(nodes.select("node", "rep"), "node").select(
        "node", F.col("rep.doc_id").alias("__doc"), F.col("rep.fp").alias("__fp"))
    same = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("fp") == F.col("__fp"))
    texts = docs.join(active, same).select("node", "text")
    texts = stored(texts, "candidate-texts")
    first_links = stored(_links(starred, texts), "links")
    labels = components(first_links)

    more = stored(_bridges(members, labels, texts), "links")
    labels = components(first_links.union(more))

    classed = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = classed.groupBy("component").agg(F.min("rep").alias("class"))
    by_content = classed.join(named, "component").select("content", "class")
    own = F.struct("doc_id", "fp")
    out = rows.select("doc_id", "fp", "content").distinct().join(by_content, "content", "left")
    out = out.withColumn("class", F.coalesce("class", own))
    return out.select("doc_id", "fp", F.col("class.doc_id").alias("class_id"),
                      F.col("class.fp").alias("class_fp"), own.eqNullSafe(F.col("class")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class of near copies, with its columns.

    Of rows that repeat a doc_id and its text, one stays.
    """
    fp, own_doc, own_fp = fresh(docs, "fp", "__doc", "__fp")
    decided = stored(classes(docs).filter("kept").select(
        F.col("doc_id").alias(own_doc), F.col("fp").alias(own_fp)), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(own_doc)) & (F.col(fp) == F.col(own_fp))
    return distinct_docs(docs, fp).join(decided, same, "left_semi").select(*docs.columns)
