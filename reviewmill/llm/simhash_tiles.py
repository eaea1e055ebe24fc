"""SimHash near-duplicates by exact comparison of fingerprint tiles.

A tile holds fingerprints with the same population counts in their two 32-bit halves. The
counts of two fingerprints differ by at most their Hamming distance, so a tile meets only
tiles whose counts differ by at most the radius in all; every other pair of tiles is
skipped unseen. Inside a pair of tiles numpy compares sub-tiles of equal counts in four
16-bit quarters, skipped by the same rule, with exclusive-or and bit counts. Equal
fingerprints are grouped beforehand, and a pair of tiles reports a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.common import texts_of
from reviewmill.operators.components import connected_components
from reviewmill.session import staged

RADIUS = 3
SEED = 42
CHUNK = 16_384
WORDS = 3


def _fingerprint(text: str, words: int = WORDS) -> int:
    tokens = text.encode().lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space
    if not tokens:
        return 0
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends.tolist()]
    stops = (ends[min(words, len(tokens)) - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for low in range(0, n, 65_536):
        part = range(low, min(n, low + 65_536))
        hashes = np.array([digest(joined[starts[i]:stops[i]], SEED) for i in part], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep` and `fp` (the 64 bits as a signed long) of every row's whole text; no words: 0."""
    rows = texts_of(docs, *keep)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([_fingerprint(t.as_py(), words) for t in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(made.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(run, f"{kinds}, fp bigint")


class _Forest:
    """Union-find over the fingerprints of one pair of tiles."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def _quarters(fp: np.ndarray) -> np.ndarray:
    parts = fp.view(np.uint16).reshape(-1, 4)
    return np.bitwise_count(parts).astype(np.int64)


def _sub_tiles(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by quarter counts, the bounds of equal counts, and those counts."""
    counts = _quarters(fp)
    code = counts @ np.array([17**3, 17**2, 17, 1])
    order = np.argsort(code, kind="stable")
    first = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, np.append(first, len(fp)), counts[order[first]]


def tile_links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """A spanning forest of the links between two arrays of distinct fingerprints.

    Pairs of arrays too small to repay the sub-tiles are compared as they stand.
    """
    shift = 0 if same else len(left)
    forest, links = _Forest(shift + len(right)), []
    if len(left) * len(right) <= 4_000_000:
        lo, lb, lc = np.arange(len(left)), np.array([0, len(left)]), np.zeros((1, 4), np.int64)
        ro, rb, rc = np.arange(len(right)), np.array([0, len(right)]), lc
    else:
        lo, lb, lc = _sub_tiles(left)
        ro, rb, rc = (lo, lb, lc) if same else _sub_tiles(right)
    for t in range(len(lc)):
        near = np.flatnonzero(np.abs(rc - lc[t]).sum(1) <= radius)
        near = near[near >= t] if same else near
        if not len(near):
            continue
        cols = ro[np.concatenate([np.arange(rb[u], rb[u + 1]) for u in near])]
        others, rows = right[cols], lo[lb[t]:lb[t + 1]]
        step = max(1, 262_144 // len(cols))
        for low in range(0, len(rows), step):
            part = rows[low:low + step]
            close = np.bitwise_count(left[part][:, None] ^ others[None, :]) <= radius
            for a, b in zip(*np.nonzero(close)):
                i, j = int(part[a]), int(cols[b])
                if (i != j or not same) and forest.join(i, j + shift):
                    links.append((i, j + shift))
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """`a`, `b`: links at `radius` or fewer bits that connect all linked distinct values of `fp`.

    Every two values within the radius are connected by rows of the result. A tile of more
    than `chunk` values is dealt to several chunks by hash, and chunks meet pairwise, so no
    task holds more than about two chunks at once. Tiles are at most 33 * 33, which bounds
    the table of chunks per tile.
    """
    spark = distinct.sparkSession
    high = F.bit_count(F.shiftrightunsigned("fp", 32))
    low = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    tiled = distinct.select("fp", (high * 64 + low).cast("long").alias("tile"))
    sizes = tiled.groupBy("tile").agg(F.ceil(F.count("*") / chunk).cast("long").alias("chunks"))
    spot = F.col("tile") * F.lit(1 << 32) + F.pmod(F.xxhash64("fp"), F.col("chunks"))
    chunks = staged(
        tiled.join(sizes, "tile").groupBy("tile", spot.alias("chunk")).agg(F.collect_list("fp").alias("fps")))
    steps = F.array(*[
        F.lit(i * 64 + j).cast("long")
        for i in range(-radius, radius + 1) for j in range(-radius, radius + 1)
        if abs(i) + abs(j) <= radius
    ])
    pairs = (
        chunks.select("chunk", F.explode(F.transform(steps, lambda d: F.col("tile") + d)).alias("tile"))
        .join(chunks.select("tile", F.col("chunk").alias("other")), "tile")
        .where("chunk <= other").select("chunk", "other")
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = (
        pairs.join(chunks.select("chunk", F.col("fps").alias("left")), "chunk")
        .join(chunks.select(F.col("chunk").alias("other"), F.col("fps").alias("right")), "other")
        .repartition(2 * n, "chunk", "other")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = (
                    np.sort(batch.column(c)[i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    for c in ("left", "right"))
                same = batch.column("chunk")[i].as_py() == batch.column("other")[i].as_py()
                links = np.array(tile_links(left, right, radius, same), np.int64).reshape(-1, 2)
                both = (left if same else np.concatenate([left, right])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[links[:, 0]]), pa.array(both[links[:, 1]])], ["a", "b"])

    return met.mapInArrow(compare, "a bigint, b bigint")


def _labelled(rows: DataFrame, radius: int) -> DataFrame:
    """Staged rows of (doc_id, fp, ..), with `label` (one value per group) and component_id."""
    distinct = staged(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    labels = connected_components(near_links(distinct, radius), []).withColumnRenamed("node", "fp")
    labelled = staged(distinct.join(labels, "fp", "left").withColumn("label", F.coalesce("label", "fp")))
    roots = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    names = labelled.join(roots, "label").select("fp", "label", "component_id")
    return rows.join(names, "fp")


def groups(docs: DataFrame, radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row.

    Documents with equal fingerprints belong together, those without words too. Repeated
    rows are kept; a null doc_id never names a component unless it has no other. An empty
    table gives no rows.
    """
    return _labelled(staged(fingerprints(docs, words)), radius).select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of `docs` that stay: exactly one of each group, whatever ids repeat or are null.

    It is the one with the smallest doc_id (nulls last), of several the one with the least text.
    Null and empty texts, having no words, are one group; an empty table gives no rows.
    Columns of any name go along packed, so none can clash.
    """
    # Rows of one key have one text, so one fingerprint and one group.
    key = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit(" "),
                   F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("key")
    made = _labelled(staged(fingerprints(docs.select("doc_id", "text", key), keep=("doc_id", "key"))), radius)
    first = made.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("key", "label").distinct()
    plain = [c for c, kind in docs.dtypes if c != "text" and not kind.startswith(("map", "array", "struct", "variant"))]
    order = [F.col("row").getField(c) for c in ("text", *plain)]
    turn = F.row_number().over(Window.partitionBy("label").orderBy(*order))
    packed = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.join(first, "key").withColumn("turn", turn).where("turn = 1").select("row.*")
