"""String expressions with the JVM library semantics the operators rely on.

All of them are built-in column expressions, so they stay in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NO_WORDS = "array<string>"


def split_words(text: Column) -> Column:
    """Split on single spaces: inner and leading empties stay, trailing ones go.

    An empty string gives one empty word, a string of spaces gives none.
    """
    kept = F.rtrim(text)
    only_spaces = (kept == "") & (text != "")
    return F.when(only_spaces, F.array().cast(_NO_WORDS)).otherwise(F.split(kept, " "))


def tokenize(text: Column) -> Column:
    """Tokens between runs of space, tab, newline, return or form feed; no empties."""
    spaced = F.translate(text, "\t\n\r\f", "    ")
    return F.array_remove(F.split(spaced, " "), "")


def split_nonempty(text: Column, delimiter: str) -> Column:
    """Split on a literal one-character delimiter, without empty items."""
    return F.array_remove(F.split(text, re.escape(delimiter)), "")


def trim_control(text: Column) -> Column:
    """Strip every character up to U+0020 from both ends."""
    return F.btrim(text, F.lit("".join(map(chr, range(0x21)))))


def before_last(text: Column, mark: str) -> Column:
    """Everything before the last `mark`; empty when there is none."""
    tail = F.length(F.substring_index(text, mark, -1))
    return F.substring(text, F.lit(1), F.length(text) - tail - 1)


def after_last(text: Column, mark: str) -> Column:
    """Everything after the last `mark`; the whole text when there is none."""
    return F.substring_index(text, mark, -1)


def after_first(text: Column, mark: str) -> Column:
    """Everything after the first `mark`; empty when there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + 1, F.length(text))).otherwise("")


def has_key(text: Column, mark: str = ":") -> Column:
    """True when `mark` occurs, but not as the first character."""
    return F.instr(text, mark) > 1


def ngrams(words: Column, n: int, sep: str = "|") -> Column:
    """The n-word windows of an array, each joined by `sep`; empty when it is shorter.

    The outer one-item transform names the array, which is then evaluated once per row
    and not once per window.
    """

    def windows(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (n - 1))
        return F.when(
            F.size(w) >= n,
            F.transform(starts, lambda start: F.concat_ws(sep, F.slice(w, start, n))),
        ).otherwise(F.array().cast(_NO_WORDS))

    return F.flatten(F.transform(F.array(words), windows))


def cut_after(text: Column, limit: int = 1000, mark: str = ",") -> Column:
    """Cut the text at the first `mark` found at or after offset `limit`."""
    at = F.locate(mark, text, limit + 1)
    return F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
