"""Words, word hashes and shingle sets of a few texts at a time, as numpy arrays.

These helpers run inside tasks, on slices of an Arrow batch of about half a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer text is handled alone.
SLICE = 1 << 19

BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; short tables are remembered."""
    known = _powers.get(base)
    if known is not None and len(known) >= n:
        return known
    out = np.ones(max(n, SLICE + (SLICE >> 2)), np.uint64)
    if len(out) > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    if n <= 4 * SLICE:
        _powers[base] = out
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over each other."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Polynomial prefix sums: bytes s..e hash to ``(sums[e] - sums[s]) * inverse ** s``."""
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf))[: len(buf)], out=sums[1:])
    return sums


def hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, len(sums))[starts])


def _space_table() -> np.ndarray:
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words:
    """Words (runs without white space, ASCII sense) of several texts.

    ``starts``, ``ends``: byte ranges in ``buf``; ``doc``: the text of each word;
    ``first``: index of the first word of each text, with the total at the end.
    """

    #: Which bytes separate words.
    separates = _space_table()

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.texts = texts
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if lower:
            self.buf = _lower_table()[self.buf]
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        space = self.separates[self.buf]
        before = np.concatenate([[True], space[:-1]])
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(space & ~before)
        self.first = np.searchsorted(self.starts, self.at)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.sums = prefix_sums(self.buf)
        self.hash = hashes(self.sums, self.starts, self.ends)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of k words within a text, and the index of its first word."""
        if len(self.hash) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        n = len(self.hash) - k + 1
        total = np.zeros(n, np.uint64)
        for j in range(k):
            total = total * np.uint64(BASE) + self.hash[j : j + n]
        inside = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(total[inside]), inside

    def shingle_sets(self, k: int) -> list[np.ndarray]:
        """Sorted distinct hashes of the k-word shingles of each text.

        A text of fewer words has its whole word sequence as one shingle; a text
        without words has none.
        """
        window, at = self.windows(k)
        bound = np.searchsorted(at, self.first)
        out = []
        for d in range(len(self.texts)):
            count = self.first[d + 1] - self.first[d]
            if count >= k:
                out.append(np.unique(window[bound[d] : bound[d + 1]]))
            elif count:
                whole = np.uint64(count)
                for h in self.hash[self.first[d] : self.first[d + 1]]:
                    whole = mix(np.array([whole], np.uint64) * np.uint64(BASE) + h)[0]
                out.append(np.array([whole], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def slices(batch: pa.RecordBatch, text: int = 1) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a batch as UTF-8, about ``SLICE`` bytes at a time, with the row of the first."""
    column = batch.column(text).cast(pa.binary())
    held, size, row = [], 0, 0
    for i, value in enumerate(column):
        raw = value.as_py() or b""
        if held and size + len(raw) > SLICE:
            yield row, held
            held, size, row = [], 0, i
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield row, held


def planes(values: np.ndarray) -> bytes:
    """An integer array byte by byte, which compresses well where it is sorted."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()


def from_planes(raw: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)
