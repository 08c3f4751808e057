"""Cross-tokenizer alignment by inverted pair bitmaps.

Every text is encoded by two tokenizers, A (byte-level) and B (pieces that add a space in
front). Byte offsets where tokens of both end cut the text into groups; the two tokens that
end there are linked. How often an id pair is linked in the corpus says how well the two ids
match.

A task cuts texts into units in front of a space that follows a visible character: no token
of either vocabulary reaches over such a place, so units are encoded on their own and each
distinct unit of a chunk only once. A text with a unit that does not give back its bytes is
encoded again as a whole, and has no tokens if that does not give back its bytes either.

Links are counted in an inverted index. Documents are dealt into blocks in the order of
their partition. For each block and id pair there is one compressed bitmap of the documents
that hold the pair (the bitmaps of a block's chunks merged by OR), and one for each bit of
their further links, so that a document with m links is in plane 0 and in the planes of
m - 1. A bitmap is a sorted array of 16-bit places, or a bit field where that is smaller.
Set bits, weighed by their plane, add up to the links of a pair, those of plane 0 to its
documents. Then the postings return the scores: each adds its pair's count to the documents
of its bitmap. Blocks end at BLOCK_DOCS documents or BLOCK_LINKS distinct links, so neither a
frequent pair nor a long text makes a row or a task grow.

Null and empty texts have no tokens: zeros and an empty digest. Rows that repeat a document
count again. Other columns are left aside. Special tokens' strings are plain text.
"""

from __future__ import annotations

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from backtrail.plans.groups import measure
from backtrail.session import stored

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
BLOCK_DOCS, BLOCK_LINKS = 8192, 2_000_000
CHUNK_BYTES = 1 << 22
FIELD = BLOCK_DOCS // 8          # bytes of a bit field; arrays are shorter

_SHIFT = 13                      # BLOCK_DOCS is 2 ** _SHIFT


def byte_level() -> dict[str, int]:
    """The byte of each character in a byte-level vocabulary: visible bytes stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The lengths of lists of ids, and all ids."""
    return (np.fromiter(map(len, lists), np.int64, len(lists)),
            np.fromiter(itertools.chain.from_iterable(lists), np.int64))


class Pair:
    """Both tokenizers, and how units align. One is held per Python worker."""

    def __init__(self, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(os.path.join(folder, a_file))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=os.path.join(folder, b_file))
        self.size_b = self.b.get_piece_size()
        of = byte_level()
        self.a_bytes: dict[int, bytes] = {}
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.a_bytes[i] = bytes(of[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p)
                        else p.replace("▁", " ").encode() for p in pieces]
        # Units may be encoded alone only if no piece holds a space behind another character.
        probe = "".join(self.b.encode("  a  b ", out_type=str))
        self.cuts = probe == "▁▁▁a▁▁b▁" and not any(
            re.search("[^▁]▁", p) for p in pieces)
        self.held_a = np.array([self.a_bytes.get(i, b"") for i in range(max(self.a_bytes) + 1)], object)
        self.held_b = np.array(self.b_bytes, object)
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in held], np.int64) for held in (self.held_a, self.held_b))
        # Ids as text with what follows them: another of the group, the other side, another group.
        self.texts = {sep: np.array([f"{i}{sep}" for i in range(max(len(self.sizes_a), self.size_b))], object)
                      for sep in ",|;"}

    def align(self, units: pa.Array) -> Aligned:
        """How the two tokenizers align on each unit, an array of bytes that begin with a space.

        A unit that either side does not give back has no tokens.
        """
        texts = pc.cast(units, pa.large_string()).to_pylist()
        left = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        right = self.b.encode([t[1:] for t in texts], num_threads=1)
        ok = np.ones(len(texts), bool)
        (n_a, a), (n_b, b) = flat(left), flat(right)
        if not b"".join(self.held_a[a]) == "".join(texts).encode() == b"".join(self.held_b[b]):
            ok = np.array([b"".join(self.held_a[x]) == t.encode() == b"".join(self.held_b[y])
                           for t, x, y in zip(texts, left, right)], bool)
            n_a, a = flat([x if k else [] for x, k in zip(left, ok)])
            n_b, b = flat([x if k else [] for x, k in zip(right, ok)])
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        at = np.searchsorted(ends_b, ends_a)
        joint = np.append(ends_b, -1)[at] == ends_a
        last_a = np.flatnonzero(joint)              # of each group
        last_b = at[last_a]
        closes = np.zeros(len(b), bool)
        closes[last_b] = True
        # The text of all groups in order: A's tokens of a group stand behind B's of the groups before.
        group_a = np.cumsum(joint) - joint
        group_b = np.cumsum(closes) - closes
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + np.concatenate([[0], last_b + 1])[group_a]] = np.where(
            joint, self.texts["|"][a], self.texts[","][a])
        out[np.arange(len(b)) + (last_a + 1)[group_b]] = np.where(closes, self.texts[";"][b], self.texts[","][b])
        bounds = np.concatenate([[0], np.cumsum(n_a + n_b)])
        width = np.concatenate([[0], np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))])[bounds].tolist()
        whole = "".join(out)
        n_groups = np.bincount(np.repeat(np.arange(len(texts)), n_a)[last_a], minlength=len(texts))
        return Aligned(ok, n_a, n_b, n_groups, [whole[x:y] for x, y in itertools.pairwise(width)],
                       a[last_a] * self.size_b + b[last_b])


@dataclass(frozen=True)
class Aligned:
    """Of each unit: whether it was given back, tokens of A and B, groups, and their text; all links."""

    ok: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    texts: list[str]
    links: np.ndarray

    def __add__(self, other: Aligned) -> Aligned:
        return Aligned(*(x + y if isinstance(x, list) else np.concatenate([x, y])
                         for x, y in ((getattr(self, f.name), getattr(other, f.name)) for f in fields(self))))


_PAIRS: dict[tuple[str, str, str], Pair] = {}


def pair_of(files: tuple[str, str, str]) -> Pair:
    if files not in _PAIRS:
        _PAIRS[files] = Pair(*files)
    return _PAIRS[files]


def cut_units(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Starts of units in texts that lie end to end and begin at `starts` with a space.

    A unit begins at a text, or at a space behind a visible character (ASCII, or one of two
    bytes from U+00C0 on, none of which is white space) that is not one of the closing spaces.
    """
    before, second = data[:-1], np.concatenate([[0], data[:-2]])
    visible = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & (before < 0xC0)
                                                     & (second >= 0xC3) & (second < 0xE0))
    at = np.flatnonzero((data[1:] == 32) & visible) + 1
    solid = np.append(np.flatnonzero(data != 32), len(data))
    ends = np.append(starts[1:], len(data))
    end = ends[np.searchsorted(starts, at, side="right") - 1]
    begins = np.zeros(len(data), bool)
    begins[starts] = True
    begins[at[solid[np.searchsorted(solid, at)] < end]] = True
    return np.flatnonzero(begins)


class Block:
    """Documents and links that wait to be written."""

    def __init__(self) -> None:
        self.docs: list[pa.RecordBatch] = []
        self.n = 0
        self.links: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_links = 0

    def add(self, docs: pa.RecordBatch, keys: np.ndarray, times: np.ndarray) -> None:
        self.docs.append(docs)
        self.n += docs.num_rows
        self.links.append((keys, times))
        self.n_links += len(keys)

    def postings(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """(pairs, planes, bitmaps), by pair and plane."""
        keys, times = (np.concatenate(x) for x in zip(*self.links))
        keys, where = np.unique(keys, return_inverse=True)  # the chunks' bitmaps, merged by OR
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, where, times)
        further = total - 1
        pairs, planes, docs = [keys >> _SHIFT], [np.zeros(len(keys), np.int32)], [keys & (BLOCK_DOCS - 1)]
        for bit in range(int(further.max(initial=0)).bit_length()):
            held = (further >> bit) & 1 == 1
            pairs.append(pairs[0][held])
            planes.append(np.full(int(held.sum()), bit + 1, np.int32))
            docs.append(docs[0][held])
        pair, plane, doc = (np.concatenate(x) for x in (pairs, planes, docs))
        order = np.lexsort((doc, plane, pair))
        pair, plane, doc = pair[order], plane[order], doc[order].astype("<u2")
        first = np.flatnonzero(np.concatenate([[True], (np.diff(pair) != 0) | (np.diff(plane) != 0)])[:len(pair)])
        return pair[first], plane[first], compressed(doc, np.append(first, len(doc)))


def compressed(places: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One bitmap for each range of ascending 16-bit places: an array of them, or a bit field."""
    sizes = np.diff(bounds) * 2
    dense = np.flatnonzero(sizes >= FIELD)
    if not len(dense):
        return pa.Array.from_buffers(pa.large_binary(), len(sizes), [
            None, pa.py_buffer((bounds * 2).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(places))])
    out = [places[lo:hi].tobytes() for lo, hi in itertools.pairwise(bounds.tolist())]
    for i in dense.tolist():
        bits = np.zeros(FIELD * 8, np.uint8)
        bits[places[bounds[i]:bounds[i + 1]]] = 1
        out[i] = np.packbits(bits, bitorder="little").tobytes()
    return pa.array(out, pa.large_binary())


def places_of(bitmaps: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of every set bit of an array of bitmaps."""
    bitmaps = pc.cast(bitmaps, pa.large_binary())
    buffers = bitmaps.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[bitmaps.offset:bitmaps.offset + len(bitmaps) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    sizes = np.diff(bounds)
    dense = sizes == FIELD
    plain = data[~np.repeat(dense, sizes)].view("<u2").astype(np.int64)
    rows = [np.repeat(np.flatnonzero(~dense), sizes[~dense] // 2)]
    places = [plain]
    for i in np.flatnonzero(dense).tolist():
        lo = bounds[i] - bounds[0]
        places.append(np.flatnonzero(np.unpackbits(data[lo:lo + FIELD], bitorder="little")))
        rows.append(np.full(len(places[-1]), i))
    return np.concatenate(rows), np.concatenate(places)


def set_bits(bitmap: str) -> Column:
    """Number of set bits of a bitmap column."""
    size = F.octet_length(bitmap)
    return F.when(size == FIELD, F.bitmap_count(bitmap)).otherwise(F.shiftright(size, 1)).cast("bigint")


def _encoded(pair: Pair, ids: pa.Array, texts: pa.Array) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Chunks of (documents, links by document and pair, their numbers)."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    empty = pa.scalar("", pa.large_string())
    spaced = pc.binary_join_element_wise(empty, texts, pa.scalar(" ", pa.large_string()))
    buffers = spaced.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[spaced.offset:spaced.offset + len(spaced) + 1]
    everything = np.frombuffer(buffers[2], np.uint8)
    lo = 0
    while lo < len(spaced):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + CHUNK_BYTES, side="right")) - 1)
        hi = min(hi, lo + BLOCK_DOCS, len(spaced))
        data, starts, n = everything[bounds[lo]:bounds[hi]], bounds[lo:hi] - bounds[lo], hi - lo
        units = cut_units(data, starts) if pair.cuts else starts
        ends = np.append(units, len(data))
        array = pa.Array.from_buffers(pa.large_binary(), len(units), [
            None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = array.dictionary_encode()
        codes = coded.indices.to_numpy()
        doc = np.searchsorted(starts, units, side="right") - 1
        found = pair.align(coded.dictionary)
        # A text that its units do not give back is tried as a whole; such a text is one unit.
        lost = ~found.ok[codes]
        if lost.any():
            again = np.unique(doc[lost])
            whole = [data[starts[i]:(starts[i + 1] if i + 1 < n else len(data))].tobytes() for i in again]
            keep = ~np.isin(doc, again)
            codes = np.concatenate([codes[keep], len(found.ok) + np.arange(len(again))])
            doc = np.concatenate([doc[keep], again])
            found += pair.align(pa.array(whole, pa.large_binary()))
            order = np.argsort(doc, kind="stable")
            codes, doc = codes[order], doc[order]
        size = np.diff(np.append(starts, len(data)))
        has = size[doc] > 1  # the others are null or empty
        codes, doc = codes[has], doc[has]
        counts = [np.bincount(doc, weights=x[codes], minlength=n).astype(np.int64)
                  for x in (found.n_a, found.n_b, found.n_groups)]
        frags = np.array(found.texts, object)[codes]
        at = np.searchsorted(doc, np.arange(n + 1))
        digests = [hashlib.sha256("".join(frags[x:y])[:-1].encode()).hexdigest() if counts[0][i] else ""
                   for i, (x, y) in enumerate(itertools.pairwise(at.tolist()))]
        once, times = np.unique(doc * len(found.ok) + codes, return_counts=True)
        code, of = once % len(found.ok), once // len(found.ok)
        begin, take = (np.cumsum(found.n_groups) - found.n_groups)[code], found.n_groups[code]
        inside = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
        keys = found.links[np.repeat(begin, take) + inside] << _SHIFT | np.repeat(of, take)
        keys, where = np.unique(keys, return_inverse=True)
        held = np.zeros(len(keys), np.int64)
        np.add.at(held, where, np.repeat(times, take))
        batch = pa.RecordBatch.from_arrays([ids.slice(lo, n), *map(pa.array, counts), pa.array(digests, pa.string())],
                                           ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"])
        yield batch, keys, held
        lo = hi


def encode(docs: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """Rows of documents (block, at, doc_id, n_a, n_b, n_groups, groups_sha256; pair is null) and of
    postings (block, pair, plane, bitmap; at is null), written once.

    `pair` is A's id times the size of B's vocabulary plus B's id.
    """
    docs = docs.select("doc_id", "text")
    columns = [("block", T.LongType()), ("at", T.IntegerType()), ("doc_id", docs.schema["doc_id"].dataType),
               ("n_a", T.LongType()), ("n_b", T.LongType()), ("n_groups", T.LongType()),
               ("groups_sha256", T.StringType()), ("pair", T.LongType()), ("plane", T.IntegerType()),
               ("bitmap", T.BinaryType())]
    names = [c for c, _ in columns]
    files = (folder, a_file, b_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pair, block = pair_of(files), Block()

        def written() -> Iterator[pa.RecordBatch]:
            at = 0
            for part in block.docs:
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.array(np.arange(at, at + n, dtype=np.int32)), *part.columns,
                     pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
                at += n
            pairs, planes, bitmaps = block.postings()
            for lo in range(0, len(pairs), 1 << 16):
                p = pairs[lo:lo + (1 << 16)]
                n = len(p)
                empty = [pa.nulls(n, c.type) for c in block.docs[0].columns]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, number)), pa.nulls(n, pa.int32()), *empty, pa.array(p),
                     pa.array(planes[lo:lo + n]), pc.cast(bitmaps.slice(lo, n), pa.binary())], names)

        for batch in batches:
            for found, keys, times in _encoded(pair, batch.column(0), batch.column(1)):
                if block.n and (block.n + found.num_rows > BLOCK_DOCS or block.n_links + len(keys) > BLOCK_LINKS):
                    yield from written()
                    block, number = Block(), number + 1
                block.add(found, keys + block.n, times)
        if block.n:
            yield from written()

    schema = T.StructType([T.StructField(*c) for c in columns])
    return stored(docs.mapInArrow(run, schema), "aligned")


def pair_counts(aligned: DataFrame, folder: str = TOKENIZERS, b_file: str = B_FILE) -> DataFrame:
    """(a, b, pair, n_docs, n_links, best): documents and links of each id pair of an encoded table.

    `best` says that no other id of A is linked more often with this id of B.
    """
    from sentencepiece import SentencePieceProcessor

    size_b = SentencePieceProcessor(model_file=os.path.join(folder, b_file)).get_piece_size()
    bits, plane = set_bits("bitmap"), F.col("plane")
    weight = F.when(plane > 1, F.expr("shiftleft(1L, plane - 1)")).otherwise(F.lit(1))
    counts = aligned.filter(F.col("pair").isNotNull()).select("pair", "plane", bits.alias("n"), weight.alias("weight"))
    counts = stored(counts.groupBy("pair").agg(
        F.sum(F.when(plane == 0, F.col("n")).otherwise(0)).alias("n_docs"),
        F.sum(F.col("n") * F.col("weight")).alias("n_links")), "pairs")
    counts = counts.withColumn("a", F.floor(F.col("pair") / size_b)).withColumn("b", F.col("pair") % size_b)
    # One row for each id of B: no more than its vocabulary holds.
    top = counts.groupBy(F.col("b").alias("of")).agg(F.max("n_links").alias("most"))
    joined = counts.join(F.broadcast(top), F.col("b") == F.col("of"))
    return joined.select("a", "b", "pair", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and document of a task's postings: links that are best, and the sum of counts."""
    sums: dict[int, np.ndarray] = {}

    def given(blocks: list[int]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            held = sums.pop(b)
            at = np.flatnonzero(held[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), b)), pa.array(at.astype(np.int32)), pa.array(held[0][at]), pa.array(held[1][at])],
                ["block", "at", "n_best", "count_sum"])

    for batch in batches:
        block, plane, links = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
        best = batch.column(4).to_numpy(zero_copy_only=False).astype(np.int64)
        weight = np.left_shift(np.int64(1), np.maximum(plane - 1, 0).astype(np.int64))
        row, place = places_of(batch.column(2))
        blocks, inverse = np.unique(block, return_inverse=True)
        for k, b in enumerate(blocks.tolist()):
            held = sums.setdefault(b, np.zeros((2, BLOCK_DOCS), np.int64))
            mine = slice(None) if len(blocks) == 1 else inverse[row] == k
            r, p = row[mine], place[mine]
            np.add.at(held[0], p, (weight * best)[r])
            np.add.at(held[1], p, (weight * links)[r])
        if len(sums) > 64:
            yield from given([b for b in sums if b not in set(blocks.tolist())])
    yield from given(list(sums))


def report(docs: DataFrame, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document."""
    aligned = encode(docs, folder, a_file, b_file)
    scored = measure(pair_counts(aligned, folder, b_file).select(F.col("pair").alias("of"), "n_links", "best"))
    postings = aligned.filter(F.col("pair").isNotNull()).select("block", "pair", "plane", "bitmap")
    joined = postings.join(scored.frame(), F.col("pair") == F.col("of"))
    if not scored.small:
        # The join dealt the postings by pair; a block's postings are brought together again.
        joined = joined.repartition("block")
    back = joined.select("block", "plane", "bitmap", "n_links", "best").mapInArrow(
        _returned, "block long, at int, n_best long, count_sum long")
    back = back.groupBy("block", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    rows = aligned.filter(F.col("pair").isNull()).drop("pair", "plane", "bitmap")
    zero = F.lit(0).cast("bigint")
    return rows.join(back, ["block", "at"], "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
        F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
