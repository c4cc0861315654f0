"""Hashed word shingles of whole texts, vectorised over bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from orrery.llm.words import slices, split_words

GOLDEN, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


#: Bytes of text whose shingles are held at a time.
SHINGLE_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def word_hashes(words: pa.Array) -> np.ndarray:
    raw = [xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()]
    return np.array(raw, dtype=np.uint64)


def shingle_hashes(texts: pa.Array, size: int = 5, lower: bool = True) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, hashes, bounds) per slice: the hash of each run of `size` words of each text, in order.

    A-Z are lower-cased first. A text with fewer words has one hash, of all of them; one
    without words has none.
    """
    for first, part in slices(texts, SHINGLE_BYTES):
        words, codes, bounds = split_words(pc.ascii_lower(part) if lower else part)
        each = word_hashes(words)[codes]
        n = np.diff(bounds)
        out = np.where(n >= size, n - size + 1, np.minimum(n, 1))
        to = np.concatenate([[0], np.cumsum(out)])
        # row of `grams` g: the hash of the words g .. g + size - 1, were they all of one text
        grams = np.zeros(max(0, len(each) - size + 1), np.uint64)
        for k in range(size):
            grams = mix(grams * GOLDEN + each[k : k + len(grams)] + np.uint64(k + 1))
        hashes = np.zeros(int(to[-1]), np.uint64)
        long = n >= size
        inside = np.ones(len(each), bool)  # starts of whole shingles
        for back in range(1, size):
            at = bounds[1:][n >= back] - back
            inside[at] = False
        hashes[np.repeat(long, out)] = grams[np.flatnonzero(inside)] if len(grams) else hashes[:0]
        for i in np.flatnonzero((n > 0) & ~long):
            h = np.zeros(1, np.uint64)
            for k, w in enumerate(each[bounds[i] : bounds[i + 1]]):
                h = mix(h * GOLDEN + w + np.uint64(k + 1))
            hashes[to[i]] = mix(h + np.uint64(n[i]))[0]
        yield first, hashes, to


def distinct_sets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and their bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, row))
    h, row = hashes[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(bounds)))
