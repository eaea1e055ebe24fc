"""Helpers of the text operators: Arrow text columns, numpy word hashes, value guards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1

# ASCII white space, as in [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The needed columns only, a null text as an empty one.

    Extra columns, whatever their names, never reach an operator's result.
    """
    return docs.select(*columns, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is divisible by 5; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows, from 0) and bytes of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0]:offsets[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most `limit` bytes each, or one longer row alone."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def list_array(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the hash base and of its inverse modulo 2^64, grown on demand."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 4096)
            cls.up, cls.down = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
        return cls.up, cls.down


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * base^position, from which any substring's hash follows."""
    up, _ = _Powers.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=out[1:])
    return out


def substring_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings, equal for equal substrings wherever they stand."""
    _, down = _Powers.get(len(sums))
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not ASCII white space."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    starts = inside[1:-1] & ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(data)]
    starts[cut] = inside[1:-1][cut]
    starts = np.flatnonzero(starts)
    spaces = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    ends = spaces[np.searchsorted(spaces, starts, "right")] if len(starts) else starts
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, np.minimum(ends, offsets[rows + 1]) if len(starts) else ends, rows


def cut_at_space(data: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Pieces of one text of about `limit` bytes that end at white space where there is any."""
    low = 0
    while low < len(data):
        high = low + limit
        if high < len(data):
            gaps = np.flatnonzero(SPACE[data[low + 1:high]])
            if len(gaps):
                high = low + 1 + int(gaps[-1])
            else:  # one word longer than the limit: go on to its end
                rest = np.flatnonzero(SPACE[data[high:]])
                high = high + int(rest[0]) if len(rest) else len(data)
        yield low, min(high, len(data))
        low = min(high, len(data))
