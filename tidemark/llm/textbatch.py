"""Vectorised views of a batch of texts for work inside tasks.

A :class:`TextBatch` holds the UTF-8 bytes of many texts in one buffer and finds
words, lines and hashes of byte ranges with array operations, so that no
character is handled by the interpreter. Memory is some 40 bytes per byte of
text; :func:`slices` bounds how many texts are held at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at a time; one longer text is handled alone and whole.
SLICE_BYTES = 2 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: np.uint64 = BASE) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64."""
    held = _powers.get(int(base))
    if held is None or len(held[0]) < n:
        steps = np.full((2, max(n, SLICE_BYTES + 1024)), base, np.uint64)
        steps[1] = pow(int(base), -1, 1 << 64)
        steps[:, 0] = 1
        held = _powers[int(base)] = tuple(np.multiply.accumulate(row) for row in steps)
    return held[0][:n], held[1][:n]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts together stay near ``limit`` bytes."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield start, stop
        start = stop


class TextBatch:
    """Texts of one batch; a null text counts as empty."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.n = len(texts)
        self.data = flat[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)

    @cached_property
    def prefix(self) -> np.ndarray:
        """Polynomial hashes of all prefixes of the buffer."""
        up, _ = powers(len(self.data))
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range, equal wherever the bytes are."""
        _, down = powers(len(self.data) + 1)
        return mix((self.prefix[ends] - self.prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def per_text(self, values: np.ndarray) -> np.ndarray:
        """Sum an array over the bytes of each text."""
        total = np.zeros(len(values) + 1, np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def blank(self) -> np.ndarray:
        return (self.data == 0x20) | ((self.data >= 0x09) & (self.data <= 0x0D))

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every word: a run of bytes other than ASCII white space."""
        inside = ~self.blank
        first, last = inside.copy(), inside.copy()
        first[1:] &= self.blank[:-1]
        last[:-1] &= self.blank[1:]
        cuts = self.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        first[cuts] |= inside[cuts]
        last[cuts - 1] |= inside[cuts - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.bincount(self.words[2], minlength=self.n).astype(np.int64)

    @cached_property
    def word_hashes(self) -> np.ndarray:
        starts, ends, _ = self.words
        return self.hashes(starts, ends)

    @cached_property
    def characters(self) -> np.ndarray:
        """True at the first byte of each code point."""
        return (self.data & 0xC0) != 0x80

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text of every piece between line feeds; an empty text has one empty line."""
        feeds = np.flatnonzero(self.data == 0x0A)
        owner = np.searchsorted(self.offsets, feeds, side="right") - 1
        starts = np.concatenate([self.offsets[:-1], feeds + 1])
        ends = np.concatenate([feeds, self.offsets[1:]])
        of_start = np.concatenate([np.arange(self.n), owner])
        of_end = np.concatenate([owner, np.arange(self.n)])
        start_order, end_order = np.lexsort((starts, of_start)), np.lexsort((ends, of_end))
        return starts[start_order], ends[end_order], of_start[start_order]

    def count_words(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """How many words begin in each byte range."""
        begin = self.words[0]
        return np.searchsorted(begin, ends) - np.searchsorted(begin, starts)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, text and first word of each window of k words; fewer words make no window."""
        h, of = self.word_hashes, self.words[2]
        n = len(h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = np.zeros(n, np.uint64)
        for i in range(k):
            out = out * BASE + h[i:i + n]
        at = np.flatnonzero(of[:n] == of[k - 1:])
        return mix(out[at]), of[at], at


def repeated(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """True where the same key occurs at least twice in the same text."""
    joint = mix(keys ^ mix(of.astype(np.uint64) + np.uint64(1)))
    _, inverse, counts = np.unique(joint, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def distinct_per_text(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct keys in ascending order, text by text."""
    order = np.lexsort((keys, of))
    keys, of = keys[order], of[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (of[1:] != of[:-1])
    return keys[new], of[new]
