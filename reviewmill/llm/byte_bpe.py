"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Pieces of the pre-tokenisation pattern are encoded one by one. A piece's bytes are the
leaves of a segment tree; a leaf holds the rank of the pair that starts there, and each
node the least (rank, position) below it, so the root is the leftmost pair of minimum
rank. A merge changes the pair at its own position, at its left live neighbour and at
the swallowed right one: three point updates of logarithmic cost. Trees of many pieces
stand side by side in one numpy array and take their next merge together. In the tree of
one long piece, all pairs of least rank are merged together from left to right, up to the
first merge that makes a pair of lower rank, so a piece of many MB takes seconds.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.common import list_array, slices, texts_of, utf8

CACHED_CHUNKS, CACHED_PIECES, CACHED_BYTES = 150_000, 200_000, 16_000_000
LONG_PIECE = 1024
_NONE = np.int64((1 << 62) - 1)
_NO_RANK = np.int32((1 << 31) - 1)
_CELLS = 1 << 19


class RankTable:
    """Rank of the token that two adjacent tokens make, by open addressing in numpy arrays."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    values.append(rank)
        self.bits = max(4, (2 * len(keys)).bit_length() + 1)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        keys, values = np.array(keys, np.int64), np.array(values, np.int64)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[left[free]]
            done = self.keys[at] == keys[left]
            self.values[at[done]] = values[left[done]]
            left = left[~done]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks, -1 where the two tokens make none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], -1)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBpe:
    """Encoder and decoder for one rank file; build it once per Python worker."""

    _made: dict[tuple[str, str], ByteBpe] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pairs = RankTable(self.ranks)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pieces = regex.compile(pattern).findall
        top = max(self.ranks.values()) + 1
        self.lengths, self.starts = np.zeros(top, np.int64), np.zeros(top, np.int64)
        held = bytearray()
        for token, rank in self.ranks.items():
            self.lengths[rank], self.starts[rank] = len(token), len(held)
            held += token
        self.held = np.frombuffer(bytes(held), np.uint8)
        # Chunks and pieces that were met lately; both live as long as the worker.
        self.cache: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.known: dict[str, bytes] = {}
        self.cached_bytes = self.known_bytes = 0

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Each piece's ids as 32-bit integers; a piece that is itself a token gets that id."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            rank = self.ranks.get(piece)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(piece) > LONG_PIECE:
                out[i] = self._merge_long(piece)
            elif piece:
                by_width.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(i)
        for width, members in by_width.items():
            step = max(1, _CELLS // width)
            for low in range(0, len(members), step):
                part = members[low:low + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], width)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        n, sizes = len(pieces), np.array([len(p) for p in pieces])
        data = np.zeros((n, width + 1), np.uint8)
        live = np.arange(width + 1) < sizes[:, None]
        data[live] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = np.where(live, self.byte_ids[data], -1)
        after = np.tile(np.arange(1, width + 2), (n, 1))
        before = np.tile(np.arange(-1, width), (n, 1))
        tree = np.full((n, 2 * width), _NONE, np.int64)
        row, at = np.nonzero(live[:, 1:])
        tree[row, width + at] = self._keys(ids[row, at], ids[row, at + 1], at)
        level = width
        while level > 1:
            half = level // 2
            tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level = half
        rows = np.flatnonzero(tree[:, 1] != _NONE)
        while len(rows):
            best = tree[rows, 1]
            at = best & 0xFFFFFFFF
            gone = after[rows, at]
            right, left = after[rows, gone], before[rows, at]
            ids[rows, at], ids[rows, gone] = best >> 32, -1
            after[rows, at] = right
            inside = right < sizes[rows]
            before[rows[inside], right[inside]] = at[inside]
            here = np.full(len(rows), _NONE, np.int64)
            here[inside] = self._keys(ids[rows[inside], at[inside]], ids[rows[inside], right[inside]], at[inside])
            tree[rows, width + at], tree[rows, width + gone] = here, _NONE
            with_left = np.flatnonzero(left >= 0)
            lr, ll, la = rows[with_left], left[with_left], at[with_left]
            tree[lr, width + ll] = self._keys(ids[lr, ll], ids[lr, la], ll)
            paths = [(rows, width + at), (rows, width + gone), (lr, width + ll)]
            for _ in range(width.bit_length() - 1):
                paths = [(r, node >> 1) for r, node in paths]
                for r, node in paths:
                    tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            rows = rows[tree[rows, 1] != _NONE]
        kept = ids >= 0
        flat, ends = ids[kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[low:high] for low, high in zip([0, *ends], ends)]

    def _merge_long(self, piece: bytes) -> bytes:
        """Ids of one long piece, from a tree of ranks over its bytes."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].astype(np.int32)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        tree = np.full(2 * width, _NO_RANK, np.int32)
        for low in range(0, n - 1, 1 << 20):
            high = min(n - 1, low + (1 << 20))
            tree[width + low:width + high] = self._ranks(ids[low:high], ids[low + 1:high + 1])
        level = width
        while level > 1:
            tree[level // 2:level] = np.minimum(tree[level:2 * level:2], tree[level + 1:2 * level:2])
            level //= 2
        while tree[1] != _NO_RANK:
            rank, at = tree[1], np.ones(1, np.int64)
            while at[0] < width:  # down to the leaves that hold the least rank, in order
                at = np.stack([2 * at, 2 * at + 1], axis=1).ravel()
                at = at[tree[at] == rank]
            at -= width
            # Of pairs that overlap, every second one is merged, from the left.
            place = np.arange(len(at))
            begins = np.append(True, at[1:] != after[at[:-1]])
            at = at[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
            gone = after[at]
            right = after[gone]
            # In turn, the left neighbour is merged already and the right one isn't.
            touching = np.append(False, at[1:] == right[:-1])
            left = np.where(before[at] >= 0, ids[before[at]], -1)
            left[touching] = rank
            inside = right < n
            lower = np.zeros(len(at), bool)
            lower[inside] = self._ranks(np.full(inside.sum(), rank), ids[right[inside]]) < rank
            lower[left >= 0] |= self._ranks(left[left >= 0], np.full((left >= 0).sum(), rank)) < rank
            if lower.any():
                stop = int(lower.argmax()) + 1
                at, gone, right = at[:stop], gone[:stop], right[:stop]
            ids[at], ids[gone] = rank, -1
            after[at] = right
            inside = right < n
            before[right[inside]] = at[inside]
            tree[width + gone] = tree[width + at] = _NO_RANK
            tree[width + at[inside]] = self._ranks(ids[at[inside]], ids[right[inside]])
            near = before[at]
            near = near[near >= 0]
            tree[width + near] = self._ranks(ids[near], ids[after[near]])
            nodes = np.concatenate([at, gone, near]) + width
            nodes.sort()
            while nodes[0] > 1:
                nodes = nodes >> 1
                nodes = nodes[np.append(True, nodes[1:] != nodes[:-1])]
                tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
        return ids[ids >= 0].astype("<i4").tobytes()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(left.astype(np.int64), right.astype(np.int64))
        return np.where(rank >= 0, rank, _NO_RANK).astype(np.int32)

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank = self.pairs.get(left, right)
        return np.where(rank >= 0, rank << 32 | at, _NONE)

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of all texts.

        No match of the pattern holds a space that stands between two other characters
        that are not white space, save as its first character, so a text is cut there and
        each distinct chunk is encoded once. Texts with other white space around a space
        are matched whole.
        """
        chunked = [self._chunks(t) for t in texts]
        if len(self.cache) > CACHED_CHUNKS or self.cached_bytes > CACHED_BYTES:
            self.cache, self.older, self.cached_bytes = {}, self.cache, 0  # chunks in use move on from the older half
        missing = set().union(*chunked).difference(self.cache)
        old = missing.intersection(self.older)
        self.cache.update((c, self.older[c]) for c in old)
        self._learn(missing - old)
        self.cached_bytes += sum(map(len, missing))
        coded = []
        for text, chunks in zip(texts, chunked):
            try:
                coded.append(b"".join(map(self.cache.__getitem__, chunks)))
            except TypeError:
                coded.append(self._whole(text))
        ends = np.cumsum([len(c) // 4 for c in coded])
        return np.append(0, ends), np.frombuffer(b"".join(coded), np.int32)

    @staticmethod
    def _chunks(text: str) -> list[str]:
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def _whole(self, text: str) -> bytes:
        pieces = self.pieces(text)
        return b"".join(map(self._ids(pieces).__getitem__, pieces))

    def _ids(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of the given pieces, and of others met before."""
        if len(self.known) > CACHED_PIECES or self.known_bytes > CACHED_BYTES:
            self.known, self.known_bytes = {}, 0
        new = list(set(pieces).difference(self.known))
        self.known.update(zip(new, self.encode_pieces([p.encode() for p in new])))
        self.known_bytes += sum(map(len, new))
        return self.known

    def _learn(self, chunks: set[str]) -> None:
        made = []
        for chunk in chunks:
            edge = chunk[1:] if chunk[:1] == " " else chunk
            if edge != edge.strip() or (chunk and not edge) or "\0" in chunk:
                self.cache[chunk] = None
            else:
                made.append((chunk, self.pieces(chunk)))
        ids = self._ids([p for _, parts in made for p in parts])
        for chunk, parts in made:
            self.cache[chunk] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[p] for p in parts])

    def decode(self, offsets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and bytes of the texts that the ids stand for."""
        sizes = self.lengths[ids]
        ends = np.append(0, np.cumsum(sizes))
        source = np.repeat(self.starts[ids] - ends[:-1], sizes) + np.arange(ends[-1])
        return ends[offsets], self.held[source]


CHUNK_BYTES = 1 << 20


def round_trip(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """What `decode(encode(...))` gives, in one pass: `keep` columns, `ids` and `decoded`."""
    return _encoded(docs, path, pattern, keep, True)


def encode(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns and `ids` (array of int) of every row's whole text.

    A null or empty text has no ids; every input row gives one row, repeated or not.
    """
    return _encoded(docs, path, pattern, keep, False)


def _encoded(docs: DataFrame, path: str, pattern: str, keep: tuple[str, ...], decoded: bool) -> DataFrame:
    rows = texts_of(docs, *keep)
    schema = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path, pattern)
        for batch in batches:
            offsets, _ = utf8(batch.column("text"))
            for low, high in slices(offsets, CHUNK_BYTES):
                part = batch.slice(low, high - low)
                bounds, ids = bpe.encode_texts(part.column("text").to_pylist())
                made = [list_array(bounds, pa.array(ids))]
                if decoded:
                    made.append(_binary(*bpe.decode(bounds, ids)))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in keep), *made], [*keep, *names])

    names = ["ids", "decoded"] if decoded else ["ids"]
    return rows.mapInArrow(run, f"{schema}, ids array<int>" + ", decoded binary" * decoded)


def _binary(ends: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [
        None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of `coded` and `decoded`, the bytes its `ids` stand for; null ids give none."""
    names = [n for n in coded.columns if n != "decoded"]
    rows = coded.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path, pattern)
        for batch in batches:
            ids = batch.column("ids")
            counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.append(0, np.cumsum(counts))
            values = ids.flatten().to_numpy(zero_copy_only=False)
            for low, high in slices(offsets, 1 << 18):
                ends, data = bpe.decode(
                    offsets[low:high + 1] - offsets[low], values[offsets[low]:offsets[high]])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, _binary(ends, data)], [*part.schema.names, "decoded"])

    return rows.mapInArrow(run, f"{schema}, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, and SHA-256 of its decimal ids and of its decoded bytes."""
    return round_trip(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
