"""Hashes of five-word shingles for many texts at once, in numpy.

Words are the stretches between ASCII white space of the lower-case text. A word's hash is a polynomial of its bytes
modulo 2^64, taken from running sums over a stretch of text; a shingle's hash mixes those of its words in order. A text
of n words has n - 4 shingles; one of fewer than five words has a single one, preceded by blanks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STRETCH = 250_000
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(odd: int) -> int:
    """Modulo 2^64."""
    x = odd
    for _ in range(6):
        x = x * (2 - odd * x) % (1 << 64)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts (not null), and how many each text has."""
    lower = pc.utf8_lower(texts.cast(pa.large_string()))
    offsets = np.frombuffer(lower.buffers()[1], np.int64, len(lower) + 1, 8 * lower.offset)
    data = np.frombuffer(lower.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]  # a word ends where its text does
    start = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[firsts[1:] - 1] = inside[firsts[1:] - 1]
    stop = np.flatnonzero(ends) + 1
    words = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):  # by stretches of whole words, so that a long text takes no more memory than many short ones
        upto = max(at + 1, int(np.searchsorted(stop, start[at] + _STRETCH, "right")))
        low, high = start[at], stop[upto - 1]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(int(_BASE), high - low), out=sums[1:])
        begin = start[at:upto] - low
        words[at:upto] = mix((sums[stop[at:upto] - low] - sums[begin]) * _powers(_inverse(int(_BASE)), high - low + 1)[begin])
        at = upto
    counts = np.searchsorted(start, offsets[1:], "left") - np.searchsorted(start, offsets[:-1], "left")
    return words, counts


def shingle_hashes(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles that end at each word, the first ones preceded by blanks, and how many each text has."""
    hashes, counts = word_hashes(texts)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = np.zeros(len(hashes), np.uint64)
    for back in range(words):
        part = np.zeros(len(hashes), np.uint64)
        if back < len(hashes):
            part[back:] = hashes[:len(hashes) - back]
        part[place < back] = 0
        out = mix(out ^ part) + np.uint64(back)
    return out, counts


def whole_shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all whole shingles and how many each text has; of a shorter text the one that ends at its last word."""
    hashes, counts = shingle_hashes(texts, words)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
    return hashes[place >= np.repeat(np.minimum(counts, words) - 1, counts)], np.maximum(counts - words + 1, np.minimum(counts, 1))
