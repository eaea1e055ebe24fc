"""Token ids in wavelet-matrix files: one compressed file row per shard of documents.

A shard keeps its ids as bit planes, highest bit first. Each plane lists one bit of every
id, in the order that the planes above leave: ids with a 0 bit first, then those with a 1,
both in their old order. With the running counts of ones per block of words this gives

- access: the id at a position, by following its bit through the planes,
- count: how often an id occurs before a position,
- locate: the positions of an id, by following its range back up,

from the planes alone, without unpacking the shard. Planes and counts are zstandard-compressed one
by one, so a query reads only its shard's row. Files are Parquet with one row per shard,
written and read by Spark, so they may lie in any store that Spark reaches.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewmill.llm.common import slices, texts_of, utf8
from reviewmill.llm.word_tokens import WordTokens
from reviewmill.session import shared_folder

END_ID = 1
SHARD_TOKENS = 2_000_000
SLICE = 1 << 22  # bytes of text encoded together
_BLOCK = 512
_STRETCH = 1 << 16
SCHEMA = (
    "part int, seq int, n bigint, n_docs bigint, bits int, zeros array<bigint>, "
    "planes array<binary>, ranks array<binary>, doc_ids {}, doc_lengths array<bigint>"
)


def _halves(ones: np.ndarray, zeros: int) -> Iterator[tuple[slice, np.ndarray, slice, np.ndarray, slice]]:
    """Stretches of a plane: the places of their clear bits and marked bits, and where these go in the next order."""
    low, high = 0, zeros
    for begin in range(0, len(ones), _STRETCH):
        at = slice(begin, begin + _STRETCH)
        clear, marked = np.flatnonzero(~ones[at]), np.flatnonzero(ones[at])
        yield at, clear, slice(low, low + len(clear)), marked, slice(high, high + len(marked))
        low, high = low + len(clear), high + len(marked)


class WaveletMatrix:
    """Succinct bit planes of an array of ids with rank and select support."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, zeros, ranks, rest = [], [], [], ids
        for level in range(bits - 1, -1, -1):
            ones = (rest & rest.dtype.type(1 << level)) != 0
            plane = np.packbits(ones, bitorder="little")
            padded = np.zeros(-(-max(1, len(plane)) // (_BLOCK // 8)) * (_BLOCK // 8), np.uint8)
            padded[:len(plane)] = plane
            planes.append(padded)
            sums = np.bitwise_count(padded.view(np.uint64)).reshape(-1, _BLOCK // 64).sum(1, dtype=np.uint32)
            ranks.append(np.append(np.uint32(0), np.cumsum(sums, dtype=np.uint32)))
            zeros.append(len(ids) - int(ranks[-1][-1]))
            below = np.empty_like(rest)
            for at, clear, low, marked, high in _halves(ones, zeros[-1]):
                below[low], below[high] = rest[at][clear], rest[at][marked]
            rest = below
        return cls(len(ids), planes, zeros, ranks)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3]) >> (at & 7) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones before position `at` of a plane."""
        block = at // _BLOCK
        out = int(self.ranks[level][block])
        if at % _BLOCK:
            low = block * (_BLOCK // 8)
            part = self.planes[level][low:low + (at % _BLOCK + 7) // 8].copy()
            if at & 7:
                part[-1] &= (1 << (at & 7)) - 1
            out += int(np.bitwise_count(part).sum())
        return out

    def _select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        low, high = 0, self.n
        while low < high:  # the first prefix that holds more than k of them
            mid = (low + high) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                high = mid
            else:
                low = mid + 1
        return low

    def access(self, at: int) -> int:
        out = 0
        for level in range(len(self.planes)):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the occurrences of `token` before `end` lie below the last plane."""
        if token >> len(self.planes):
            return 0, 0
        low, high = 0, end
        for level in range(len(self.planes)):
            a, b = self._ones(level, low), self._ones(level, high)
            if token >> (len(self.planes) - 1 - level) & 1:
                low, high = self.zeros[level] + a, self.zeros[level] + b
            else:
                low, high = low - a, high - b
        return low, high

    def count(self, token: int, end: int | None = None) -> int:
        low, high = self._range(token, self.n if end is None else end)
        return high - low

    def locate(self, token: int) -> list[int]:
        low, high = self._range(token, self.n)
        out = []
        for at in range(low, high):
            for level in range(len(self.planes) - 1, -1, -1):
                bit = token >> (len(self.planes) - 1 - level) & 1
                at = self._select(level, bit, at - self.zeros[level] if bit else at)
            out.append(at)
        return sorted(out)

    def all_ids(self) -> np.ndarray:
        """Every id in order: the planes are undone from the last to the first."""
        out = np.zeros(self.n, np.uint32)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            above = np.empty_like(out)
            bit = np.uint32(1 << (len(self.planes) - 1 - level))
            for at, clear, low, marked, high in _halves(ones, self.zeros[level]):
                part = above[at]
                part[clear] = out[low]
                part[marked] = out[high] | bit
            out = above
        return out


def _pack(matrix: WaveletMatrix) -> tuple[list[bytes], list[bytes]]:
    press = zstandard.ZstdCompressor(level=1).compress
    return [press(p.tobytes()) for p in matrix.planes], [press(r.tobytes()) for r in matrix.ranks]


def _unpack(n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]) -> WaveletMatrix:
    open_ = zstandard.ZstdDecompressor().decompress
    return WaveletMatrix(
        n, [np.frombuffer(open_(p), np.uint8) for p in planes], zeros,
        [np.frombuffer(open_(r), np.uint32) for r in ranks])


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID,
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode every row's whole text and write the ids in ascending doc_id order (null ids first).

    Rows of one doc_id follow in the order of their texts, and ranges are cut by the texts'
    beginnings, too, so an id that a third of the rows share, or null, is no single task's work.

    Each document ends with `end_id`; null and empty texts consist of it alone. Rows are
    dealt to ranges of doc_id; a range writes a shard whenever `shard_tokens` are together,
    so memory is bounded by a shard and one slice of texts or one document. Repeated rows are written as often as
    they occur.
    """
    rows = texts_of(docs, "doc_id")
    spark = rows.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.withColumn("head", F.substring("text", 1, 64))
    ranged = marked.repartitionByRange(n, "doc_id", "head").sortWithinPartitions("doc_id", "text")
    ranged = ranged.select("doc_id", "text", F.spark_partition_id().alias("__part"))
    doc_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([
        ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("n_docs", pa.int64()),
        ("bits", pa.int32()), ("zeros", pa.list_(pa.int64())), ("planes", pa.list_(pa.binary())),
        ("ranks", pa.list_(pa.binary())), ("doc_ids", pa.list_(doc_type)), ("doc_lengths", pa.list_(pa.int64()))])

    def shard(part: int, seq: int, ids: list, held: list[np.ndarray], lengths: list[int]) -> pa.RecordBatch:
        tokens = np.concatenate(held)
        bits = max(1, int(tokens.max()).bit_length())
        small = tokens.astype(np.uint16) if bits <= 16 else tokens
        matrix = WaveletMatrix.build(small, bits)
        planes, ranks = _pack(matrix)
        row = [part, seq, len(tokens), len(ids), bits, matrix.zeros, planes, ranks, ids, lengths]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokens.load(tokenizer)
        ids, held, lengths, size, seq, part = [], [], [], 0, 0, 0
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            part = batch.column("__part")[0].as_py() if batch.num_rows else part
            for low, high in slices(offsets, SLICE):
                coded, counts = words.joined(offsets[low:high + 1], data)
                counts = counts + 1
                ends = np.cumsum(counts)
                tokens = np.full(ends[-1], end_id, np.uint32)
                inner = np.ones(len(tokens), bool)
                inner[ends - 1] = False
                tokens[inner] = coded
                done, row = 0, 0  # ids and rows of this slice that are in a shard
                while row < len(ends):
                    stop = min(len(ends), int(np.searchsorted(ends, done + shard_tokens - size)) + 1)
                    ids += keys[low + row:low + stop]
                    held.append(tokens[done:ends[stop - 1]])
                    lengths += counts[row:stop].tolist()
                    size += int(ends[stop - 1]) - done
                    done, row = int(ends[stop - 1]), stop
                    if size >= shard_tokens:
                        yield shard(part, seq, ids, held, lengths)
                        ids, held, lengths, size, seq = [], [], [], 0, seq + 1
        if ids:
            yield shard(part, seq, ids, held, lengths)

    ranged.mapInArrow(run, SCHEMA.format(f"array<{kind}>")).write.option("compression", "none").parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part, seq and `first`, the ids in all shards before: sums per range, then over ranges."""
    sizes = shards.select("part", "seq", "n")
    before = (Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(*before)), zero)
        .alias("outer"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), zero)
    return sizes.withColumn("inner", inner).join(parts, "part").select(
        "part", "seq", (F.col("outer") + F.col("inner")).alias("first"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids (array of int) of every document in the files."""
    def ids_of(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(
            pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.astype(np.int32)))

    return _documents(spark, path, "ids array<int>", ids_of)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, and ids_crc32 over the ids of every document in the files.

    The ids are summed up where they are unpacked, as little-endian 32-bit integers.
    """
    def sums_of(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        data = memoryview(ids.astype("<u4")).cast("B")
        return pa.array(
            [zlib.crc32(data[4 * a:4 * b]) for a, b in zip([0, *ends.tolist()], ends.tolist())], pa.int64())

    return _documents(spark, path, "ids_crc32 bigint", sums_of)


def _documents(spark: SparkSession, path: str, column: str,
               made: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    """doc_id, start, n_tokens and what `made` gives from the ids of some documents and their ends."""
    shards = spark.read.parquet(path)
    with_start = shards.join(shard_starts(shards), ["part", "seq"])
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _unpack(row["n"], row["planes"], row["zeros"], row["ranks"]).all_ids()
                lengths = np.array(row["doc_lengths"], np.int64)
                ends = np.cumsum(lengths)
                names = pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type)
                for low, high in slices(np.append(0, ends), 1 << 18):
                    begin = ends[low] - lengths[low]
                    yield pa.RecordBatch.from_arrays([
                        names[low:high], pa.array(row["first"] + ends[low:high] - lengths[low:high]),
                        pa.array(lengths[low:high]), made(ids[begin:ends[high - 1]], ends[low:high] - begin),
                    ], ["doc_id", "start", "n_tokens", column.split()[0]])

    return with_start.mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, {column}")


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """part, seq, `n_found` and positions within the shard of one id, found in the planes alone."""
    shards = spark.read.parquet(path).select("part", "seq", "n", "zeros", "planes", "ranks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                at = _unpack(row["n"], row["planes"], row["zeros"], row["ranks"]).locate(token)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]], pa.int32()), pa.array([row["seq"]], pa.int32()),
                    pa.array([len(at)], pa.int64()), pa.array([at], pa.list_(pa.int64())),
                ], ["part", "seq", "n_found", "positions"])

    return shards.mapInArrow(run, "part int, seq int, n_found bigint, positions array<bigint>")


def written_and_read(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files (to a new folder under the checkpoint folder by default) and check-sum what they hold."""
    spark = docs.sparkSession
    path = path or shared_folder(spark)
    write(docs, tokenizer, path)
    return checksums(spark, path)
