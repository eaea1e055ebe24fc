"""Hashed word n-grams of texts as sparse rows, computed with numpy over byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from reviewmill.llm.common import LOWER, cut_at_space, mix64, prefix_sums, slices, substring_hashes, word_spans

BITS = 18

# Character classes of word shapes: letters of a case fall together, other ASCII stays.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")


def _shape_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words with each row of equal character classes written once."""
    kinds = _CLASS[data]
    first = np.ones(len(data), bool)
    first[1:] = kinds[1:] != kinds[:-1]
    first[starts] = True
    place = np.append(0, np.cumsum(first))
    return substring_hashes(prefix_sums(kinds[first]), place[starts], place[ends])


def _hashed(data: np.ndarray, offsets: np.ndarray, shapes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, of its shape (empty without `shapes`), and its row."""
    starts, ends, rows = word_spans(data, offsets)
    words = substring_hashes(prefix_sums(LOWER[data]), starts, ends)
    return words, _shape_hashes(data, starts, ends) if shapes else words[:0], rows


def _grams(words: np.ndarray, kinds: np.ndarray, rows: np.ndarray, bits: int, shapes: bool,
           carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each n-gram; the first `carried` words only complete the pairs of those after them."""
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    pair = pair[pair + 1 >= carried]
    found = [words[carried:], mix64(words[pair] * np.uint64(3) + words[pair + 1])]
    at = [rows[carried:], rows[pair]]
    if shapes:
        # A word that repeats one of the two before it has a shape of its own.
        kind = kinds.copy()
        for back in (1, 2):
            same = np.flatnonzero((words[back:] == words[:-back]) & (rows[back:] == rows[:-back])) + back
            kind[same] = np.uint64(back)
        kind = mix64(kind ^ np.uint64(0x5A5A5A5A5A5A5A5A))
        found += [kind[carried:], mix64(kind[pair] * np.uint64(5) + kind[pair + 1])]
        at += [rows[carried:], rows[pair]]
    shift = np.uint64(64 - bits)
    return np.concatenate(at), (np.concatenate(found) >> shift).astype(np.int64)


def _long_grams(data: np.ndarray, bits: int, shapes: bool) -> Iterator[np.ndarray]:
    """Buckets of one text of any length, piece by piece; the last words of a piece go on into the next."""
    words, kinds = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for low, high in cut_at_space(data):
        more, shape, _ = _hashed(data[low:high], np.array([0, high - low]), shapes)
        carried = len(words)
        words, kinds = np.concatenate([words, more]), np.concatenate([kinds, shape])
        yield _grams(words, kinds, np.zeros(len(words), np.int64), bits, shapes, carried)[1]
        words, kinds = words[-3:], kinds[-3:]  # a pair's first word may repeat one two before it


def rows_of(data: np.ndarray, offsets: np.ndarray, bits: int = BITS, shapes: bool = False,
            ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """low, high, and row, bucket and count of each n-gram of the texts low to high - 1.

    Words are lower-cased (A-Z) runs without ASCII white space; n-grams are words and pairs
    of neighbours, and with `shapes` also both over word shapes. Texts longer than a slice
    are hashed in pieces that end at white space, with the same n-grams.
    """
    for low, high in slices(offsets):
        part, cut = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        if high - low == 1:
            bucket = np.concatenate([np.zeros(0, np.int64), *_long_grams(part, bits, shapes)])
            at = np.zeros(len(bucket), np.int64)
        else:
            words, kinds, rows = _hashed(part, cut, shapes)
            at, bucket = _grams(words, kinds, rows, bits, shapes)
        code, times = np.unique(at << bits | bucket, return_counts=True)
        yield low, high, code >> bits, code & ((1 << bits) - 1), times
