"""Vectorised words, hashes and counts of the texts in an Arrow batch.

A batch is cut into chunks of about one megabyte (a longer document is a chunk of its
own), so that memory is bounded by the longest document. All texts of a chunk are one
byte array; a word hash is a difference of prefix sums, so no Python loop runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ROOM = 1 << 16


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, _ROOM)
            with np.errstate(over="ignore"):
                up = np.full(size, _BASE, np.uint64)
                down = np.full(size, _BASE_INV, np.uint64)
                up[0] = down[0] = 1
                self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well-spread 64-bit hash of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x632BE59BD9B4E019 * (salt + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of `n` consecutive word hashes, across document borders too."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    up, down = _POWERS.upto(len(words) + 1)
    with np.errstate(over="ignore"):
        words = mix(words, salt + 7)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[:-1])])
        count = len(words) - n + 1
        return mix((sums[n:] - sums[:count]) * down[:count], salt)


class Chunk:
    """Rows `lo` to `hi` of a batch as one byte array; each text ends with one space."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray) -> None:
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets
        self.n = hi - lo

    def lowered(self) -> np.ndarray:
        """A-Z and the capital letters of Latin-1 in lower case."""
        data = self.data
        out = data | ((data >= 65) & (data <= 90)).view(np.uint8) << 5
        second = np.flatnonzero(data[:-1] == 0xC3) + 1
        code = data[second]
        out[second] |= ((code >= 0x80) & (code <= 0x9E) & (code != 0x97)).astype(np.uint8) << 5
        return out

    def spans(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of marked bytes. No run crosses a document."""
        edge = np.diff(np.concatenate([[0], is_word.view(np.int8), [0]]).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def docs_of(self, starts: np.ndarray) -> np.ndarray:
        """The document (0 to n-1) of each byte position."""
        return np.searchsorted(self.offsets, starts, side="right") - 1

    def bounds(self, starts: np.ndarray) -> np.ndarray:
        """n + 1 bounds into ascending byte positions, by document."""
        return np.searchsorted(starts, self.offsets)

    def text(self, row: int) -> bytes:
        return self.data[self.offsets[row]:self.offsets[row + 1] - 1].tobytes()


class Hashes:
    """Hashes of any byte range of an array."""

    def __init__(self, data: np.ndarray) -> None:
        up, self.down = _POWERS.upto(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            part = (self.sums[ends] - self.sums[starts]) * self.down[starts]
            return mix(part ^ (ends - starts).astype(np.uint64) << np.uint64(40))


def whitespace(data: np.ndarray) -> np.ndarray:
    """True for space and the controls 9 to 13."""
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hash(word: str) -> int:
    """The hash that `Hashes.of` gives a word of its own."""
    data = np.frombuffer(word.encode("utf-8"), np.uint8)
    return int(Hashes(data).of(np.array([0]), np.array([len(data)]))[0])


def chunks(texts: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of a batch, in order; a null text is an empty one."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    ended = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()),
                                        pa.scalar(" ", pa.large_string()))
    if isinstance(ended, pa.ChunkedArray):
        ended = ended.combine_chunks()
    n = len(ended)
    if n == 0:
        return
    buffers = ended.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[ended.offset:ended.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


def per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive bounds."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]
