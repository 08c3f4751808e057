"""Spelling variants by finite-state composition over the vocabulary.

Words are the runs of letters of whole texts, counted over the corpus. Two words are near
if they differ by one inserted, deleted or replaced code point. Such pairs are accepted by
A o T o A, where A accepts the vocabulary and T is a transducer of one edit: it copies,
makes one edit at the first place where the two words part, and copies again.

The composition is cut by initial states. A pair whose shorter word has `m` code points and
that parts at place p of lo <= p < hi shares its first lo and its last m - hi code points.
So for each (m, lo, hi, shared parts) the words that agree on those are one group: the state
that A reaches by the shared beginning, with the shared end cut off. Every pair belongs to
exactly one group, the two halves of places 0..m being the first intervals. A task builds the
minimised acceptor of each of its groups, with the number of words behind every arc, and
enumerates the accepted pairs as ranks. It passes on only the number of near words and the
best one per word, so no pairs are shuffled.

A group of more than MAX_GROUP words is never gathered: its interval of places is halved
and its words are dealt anew. An interval of one place leaves at most two free code points,
which are some 8,000 words in this alphabet, so that halving always ends.

A text of null holds no words; a null doc_id is written as an empty string in the hash that
chooses which runs lose a code point. Words that no other is near, and those whose best near
word is not frequent enough, have no form and are their own root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backtrail.plans.groups import keep_matching, large_groups, measure
from backtrail.session import durable, stored

LETTERS = "[A-Za-zÀ-ÿ]"
MIN_LENGTH, MIN_COUNT, RATIO, CUT = 7, 2, 10, 31
MAX_GROUP = 10_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GROUP = ["m", "lo", "hi", "shared"]


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
               cut: int | None = CUT) -> DataFrame:
    """(word, n): the words of at least `min_length` code points and `min_count` occurrences.

    With `cut`, a run loses one code point where `cut` divides the checksum of its document
    and itself. Shorter runs cannot become words and are not even exploded.
    """
    pattern = f"{LETTERS}{{{min_length},}}"
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", _UPPER, _LOWER).alias("run"))
    word: Column = F.col("run")
    if cut:
        name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
        runs = runs.withColumn("h", F.crc32(name.cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        shorter = F.concat(F.left("run", at), F.substr("run", at + 2))
        word = F.when(F.col("h") % cut == 0, shorter).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).filter(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


class Acceptor:
    """Minimal acyclic acceptors that share their states; state 0 accepts the empty word.

    An arc holds the state it leads to and how many words its source accepts before it, so
    a walk adds up to the rank of a word. No step recurses, however long a word is.
    """

    def __init__(self) -> None:
        self.register: dict[tuple, int] = {(): 0}
        self.arcs: list[dict[str, tuple[int, int]]] = [{}]
        self.count: list[int] = [1]
        self.memo: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def state(self, arcs: list[tuple[str, int]]) -> int:
        key = tuple(arcs)
        found = self.register.get(key)
        if found is None:
            found = self.register[key] = len(self.arcs)
            held, total = {}, 0
            for symbol, target in arcs:
                held[symbol] = (target, total)
                total += self.count[target]
            self.arcs.append(held)
            self.count.append(total)
        return found

    def build(self, words: Sequence[str]) -> int | None:
        """The initial state for sorted, distinct words of one length; None for no words."""
        if not words:
            return None
        length, last = len(words[0]), words[0]
        path: list[list[tuple[str, int]]] = [[] for _ in range(length + 1)]

        def close(down_to: int) -> None:
            for depth in range(length, down_to, -1):
                path[depth - 1].append((last[depth - 1], self.state(path[depth])))
                path[depth] = []

        for word in words[1:]:
            same = next((i for i, (x, y) in enumerate(zip(last, word)) if x != y), length)
            close(same)
            last = word
        close(0)
        return self.state(path[0])

    def shared(self, s: int, t: int) -> list[tuple[int, int]]:
        """The words that both states accept, as pairs of ranks."""
        memo, stack = self.memo, [(s, t)]
        while stack:
            key = stack[-1]
            if key in memo:
                stack.pop()
                continue
            x, y = key
            if x == y:
                memo[key] = [(i, i) for i in range(self.count[x])]
                continue
            left, right = self.arcs[x], self.arcs[y]
            both = [(left[c], right[c]) for c in left if c in right]
            waiting = [(a, b) for (a, _), (b, _) in both if (a, b) not in memo]
            if waiting:
                stack.extend(waiting)
                continue
            memo[key] = [(i + p, j + q) for (a, p), (b, q) in both for i, j in memo[a, b]]
        return memo[s, t]

    def replaced(self, start: int) -> Iterator[tuple[int, int]]:
        """Rank pairs of words that part by one replaced symbol."""
        stack = [(start, 0)]
        while stack:
            state, rank = stack.pop()
            arcs = list(self.arcs[state].values())
            for i, (a, p) in enumerate(arcs):
                for b, q in arcs[i + 1:]:
                    for x, y in self.shared(a, b):
                        yield rank + p + x, rank + q + y
                stack.append((a, rank + p))

    def inserted(self, short: int, long: int, at_end: bool) -> Iterator[tuple[int, int]]:
        """Rank pairs of a word and one with a symbol inserted where the two part.

        `at_end` admits a symbol after the whole shorter word.
        """
        stack = [(short, long, 0, 0)]
        while stack:
            a, b, rank_a, rank_b = stack.pop()
            left, right = self.arcs[a], self.arcs[b]
            for symbol, (t, q) in right.items():
                if not left:
                    if at_end:
                        yield rank_a, rank_b + q
                    continue
                after = self.arcs[t]
                for c, (s, p) in left.items():
                    if c != symbol and c in after:
                        u, r = after[c]
                        for x, y in self.shared(s, u):
                            yield rank_a + p + x, rank_b + q + r + y
            for c, (s, p) in left.items():
                if c in right:
                    u, q = right[c]
                    stack.append((s, u, rank_a + p, rank_b + q))


def near_in_group(words: Sequence[tuple[str, int]], length: int, at_end: bool) -> Iterator[tuple[int, int]]:
    """Index pairs of near words among sorted (free part, n) of `length` or one more symbol."""
    short = [i for i, (w, _) in enumerate(words) if len(w) == length]
    if not short or len(words) < 2:
        return
    long = [i for i, (w, _) in enumerate(words) if len(w) != length]
    automaton = Acceptor()
    start = automaton.build([words[i][0] for i in short])
    for x, y in automaton.replaced(start):
        yield short[x], short[y]
    longer = automaton.build([words[i][0] for i in long])
    if longer is not None:
        for x, y in automaton.inserted(start, longer, at_end):
            yield short[x], long[y]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple[str, int]]]]:
    """The groups of a sorted stream, which may go on from one batch to the next."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for *now, free, n in zip(*columns):
            if now != key:
                if len(held) > 1:
                    yield key, held
                key, held = now, []
            held.append((free, n))
    if len(held) > 1:
        yield key, held


def _composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["word", "n_near", "best_n", "best"]
    rows: list[tuple[str, int, int, str]] = []
    for (m, lo, hi, shared), words in _groups(batches):
        length = min(hi, m) - lo
        before, after = shared[:lo], shared[lo:]
        near: dict[int, int] = {}
        best: dict[int, int] = {}
        for pair in near_in_group(words, length, hi > m):
            for own, other in (pair, pair[::-1]):
                near[own] = near.get(own, 0) + 1
                held = best.get(own)
                if held is None or (-words[other][1], words[other][0]) < (-words[held][1], words[held][0]):
                    best[own] = other
        rows += [(before + words[i][0] + after, n, words[best[i]][1], before + words[best[i]][0] + after)
                 for i, n in near.items()]
        if len(rows) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
            rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def _dealt(words: DataFrame) -> DataFrame:
    """(m, lo, hi, word, n): each word under both of its shorter lengths and both halves."""
    size = F.length("word")
    rows = words.withColumn("m", F.explode(F.array(size, size - 1))).filter(F.col("m") >= 1)
    half = F.shiftright(F.col("m") + 1, 1)
    zero = F.lit(0)
    intervals = F.array(F.struct(zero.alias("lo"), half.alias("hi")),
                        F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))
    return rows.withColumn("i", F.explode(intervals)).select("m", "i.lo", "i.hi", "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    middle = F.shiftright(F.col("lo") + F.col("hi"), 1)
    intervals = F.array(F.struct(F.col("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), F.col("hi")))
    return rows.withColumn("i", F.explode(intervals)).select("m", "i.lo", "i.hi", "word", "n")


def _with_parts(rows: DataFrame) -> DataFrame:
    """`rows` with what the words of a group share and the free part between."""
    end = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    free = F.substr("word", F.col("lo") + 1, F.length("word") - F.col("lo") - end)
    return rows.withColumn("shared", F.concat(F.left("word", "lo"), F.right("word", end))).withColumn("free", free)


def near_words(words: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(word, n_near, best_n, best): for each word with near words, how many and the most frequent.

    `words` holds distinct (word, n). Ties go to the word that is smallest in code-point order.
    """
    found = None
    rows = _with_parts(_dealt(words))
    while True:
        large = measure(large_groups(rows, _GROUP, max_group))
        parts = rows if large.empty else keep_matching(rows, large, _GROUP, anti=True)
        parts = parts.select(*_GROUP, "free", "n").repartition(*_GROUP).sortWithinPartitions(*_GROUP, "free")
        near = parts.mapInArrow(_composed, "word string, n_near long, best_n long, best string")
        found = near if found is None else found.unionByName(near)
        # An interval of one place cannot be halved, and holds a bounded number of words.
        if large.empty:
            break
        rest = stored(keep_matching(rows, large, _GROUP), "large-groups")
        single = F.col("hi") - F.col("lo") < 2
        last = rest.filter(single).select(*_GROUP, "free", "n")
        last = last.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "free")
        found = found.unionByName(last.mapInArrow(_composed, "word string, n_near long, best_n long, best string"))
        rows = _with_parts(_halved(rest.filter(~single)))
    order = F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best"))
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(order).alias("top"))
    return best.select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the end of each chain of forms.

    A form is more frequent than its word, so there are no rings. Pointers are doubled in
    each round; since a form has at least twice the count, a few rounds end every chain.
    """
    at = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        step = measure(at.select(F.col("word").alias("via"), F.col("root").alias("next")))
        joined = at.join(step.frame(), F.col("root") == F.col("via"), "left")
        at = durable(joined.select("word", F.coalesce("next", "root").alias("root"), "next"))
        if at.filter(F.col("next").isNotNull()).isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             ratio: int = RATIO, cut: int | None = CUT, max_group: int = MAX_GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of `docs` (doc_id, text).

    `form` is the most frequent near word if it has at least `ratio` times (2 or more) the
    word's count; `root` is the end of the chain of forms. Rows that repeat a document count
    again. Other columns are left aside.
    """
    words = stored(vocabulary(docs, min_length, min_count, cut), "vocabulary")
    near = words.join(near_words(words, max_group), "word", "left")
    accepted = F.col("best_n") >= ratio * F.col("n")
    near = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
                              F.when(accepted, F.col("best")).alias("form"),
                              F.when(accepted, F.col("best_n")).alias("form_n")), "forms")
    ends = measure(roots(near.filter(F.col("form").isNotNull())).withColumnRenamed("word", "of"))
    joined = near.join(ends.frame(), F.col("word") == F.col("of"), "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
