"""Vectorised splitting of whole texts into white-space separated words (Arrow, bounded slices)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # another C library
    TRIM = None
#: Texts are handled in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 8_000_000


def release() -> None:
    """Give memory that a slice needed back to the system: workers live on, and an executor's limit counts all of them."""
    pa.default_memory_pool().release_unused()
    if TRIM is not None:
        TRIM(0)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of `texts` as large_string without nulls, at most `most` bytes each unless one row is longer."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0, np.int64)
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, texts.slice(at, to - at)
        at, done = to, int(ends[to - 1])
        release()


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word in order, bounds of each text among the codes).

    Words are the maximal runs of characters other than U+0020 and U+0009 to U+000D.
    """
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes, words = np.asarray(coded.indices), coded.dictionary
    blank = pc.index(words, pa.scalar("", words.type)).as_py() if len(words) else -1
    if blank >= 0:  # a text that begins or ends with white space has an empty piece there
        keep = codes != blank
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        codes = codes[keep]
    return words, codes, bounds


def parts_of(words: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same with A-Z in lower case, and a single full stop or comma after a letter as a word of its own.

    For vocabularies that lower-case their input and cut marks from letters this changes no
    token and leaves fewer distinct words. Words with `<|` stay: special tokens are told by case.
    """
    low = pc.if_else(pc.match_substring(words, "<|"), words, pc.ascii_lower(words))
    marked = pc.match_substring_regex(low, "[a-z][.,]$")
    has = marked.to_numpy(zero_copy_only=False)
    coded = pc.if_else(marked, pc.utf8_slice_codeunits(low, 0, -1), low).dictionary_encode()
    n = len(coded.dictionary)
    stop, stem = pc.ends_with(low, ".").to_numpy(zero_copy_only=False), np.asarray(coded.indices, np.int64)
    units = 1 + has[codes]
    ends = np.cumsum(units)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int64)
    out[ends - units] = stem[codes]
    two = np.flatnonzero(units == 2)
    out[ends[two] - 1] = np.where(stop[codes[two]], n, n + 1)
    return pa.concat_arrays([coded.dictionary, pa.array([".", ","], coded.dictionary.type)]), out, np.concatenate([[0], ends])[bounds]


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges starts[i] .. starts[i] + lengths[i] - 1."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    shift += np.arange(total)
    return shift


class PieceCache:
    """Token ids of texts by way of their distinct words, which a worker remembers between slices.

    `encode` gives the ids of each word; the tokenizer's result for a text must be the
    concatenation over its words, as `parts_of` makes them. At most `most` words (about 200 bytes each) are kept:
    when they are full, those that fewer than two of the slices since used are forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = 600_000):
        self.encode, self.most = encode, most
        self.slot: dict[str, int] = {}
        self.ids, self.start, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int32)

    def forget(self) -> None:
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.most // 2:
            keep = keep[:0]
        to = dict(zip(keep.tolist(), range(len(keep)), strict=True))
        self.slot = {w: to[k] for w, k in self.slot.items() if k in to}
        self.ids = self.ids[gather(self.start[keep], self.size[keep])]
        self.size = self.size[keep]
        self.start = np.cumsum(self.size) - self.size
        self.used = np.zeros(len(keep), np.int32)

    def add(self, words: list[str]) -> None:
        found = self.encode(words)
        self.slot.update(zip(words, range(len(self.size), len(self.size) + len(words)), strict=True))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((i for f in found for i in f), np.int32, int(sizes.sum()))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids, self.size = np.concatenate([self.ids, flat]), np.concatenate([self.size, sizes])
        self.used = np.concatenate([self.used, np.zeros(len(words), np.int32)])

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text among them)."""
        words, codes, bounds = split_words(texts)
        words, codes, bounds = parts_of(words, codes, bounds)
        words = words.to_pylist()
        found = list(map(self.slot.get, words))
        new = [w for w, k in zip(words, found, strict=True) if k is None]
        if len(self.slot) + len(new) > self.most:
            self.forget()
            new = [w for w in words if w not in self.slot]
        if new:
            self.add(new)
            found = list(map(self.slot.__getitem__, words))
        slots = np.array(found, np.int64)
        self.used[slots] += 1
        sizes = self.size[slots][codes]
        ids = self.ids[gather(self.start[slots][codes], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[bounds]
