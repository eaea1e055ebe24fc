"""Document fingerprints: SimHash over weighted terms, and search by permuted block tables.

Terms are pairs of neighbouring words (the word itself where there is only one), by a
64-bit hash. A term that stands n times in a text votes with weight 1 + ln n on each of
its hash's 64 signed bits; the fingerprint holds the signs of the sums.

Search: the 64 bits are cut into five blocks. Two fingerprints within 3 bits agree on at
least two whole blocks, so in one of the ten tables that put two blocks in front and use
them as the key. Each pair is counted in the first table that finds it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.common import (
    cut_at_space, mix64, slices, substring_hashes, prefix_sums, utf8, word_spans,
)
from reviewmill.session import staged

RADIUS = 3
BLOCKS = 5
ROWS_PER_RANGE = 1_000
MOST_RANGES = 10_000
_ROW_BITS = 12
_LAST = (1 << 63) - 1


def _terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted keys of all terms: the row in the high 12 bits, the term's hash in the others."""
    starts, ends, rows = word_spans(data, offsets)
    words = substring_hashes(prefix_sums(data), starts, ends)
    pair = np.flatnonzero(rows[1:] == rows[:-1])
    alone = np.flatnonzero(np.bincount(rows, minlength=len(offsets) - 1)[rows] == 1)
    terms = np.concatenate([mix64(words[pair] * np.uint64(3) + words[pair + 1]), words[alone]])
    at = np.concatenate([rows[pair], rows[alone]]).astype(np.uint64)
    return np.sort(at << np.uint64(64 - _ROW_BITS) | terms >> np.uint64(_ROW_BITS))


def _long_terms(data: np.ndarray) -> np.ndarray:
    """`_terms` of one text of any length, whose words are hashed piece by piece."""
    held, last = [], np.zeros(0, np.uint64)
    for low, high in cut_at_space(data):
        part = data[low:high]
        starts, ends, _ = word_spans(part, np.array([0, len(part)]))
        words = np.concatenate([last, substring_hashes(prefix_sums(part), starts, ends)])
        held.append(mix64(words[:-1] * np.uint64(3) + words[1:]))
        last = words[-1:]
    terms = np.concatenate(held)
    return np.sort((terms if len(terms) else last) >> np.uint64(_ROW_BITS))


def _votes(keys: np.ndarray, rows: int) -> np.ndarray:
    """Fingerprints from sorted term keys; 0 for a row without terms."""
    out = np.zeros(rows, np.uint64)
    if not len(keys):
        return out
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] + np.uint64(1)))
    times = np.diff(np.append(first, len(keys)))
    weight = np.rint(1024 * (1 + np.log(times))).astype(np.int64)
    terms = mix64(keys[first] & np.uint64((1 << 64 - _ROW_BITS) - 1))
    at = (keys[first] >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
    sums = np.zeros((rows, 64), np.int64)
    for low in range(0, len(terms), 65_536):
        part = slice(low, low + 65_536)
        bits = np.unpackbits(terms[part].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        begin = np.flatnonzero(np.diff(at[part], prepend=-1))
        signed = (2 * bits.astype(np.int32) - 1) * weight[part, None].astype(np.int32)
        sums[at[part][begin]] += np.add.reduceat(signed, begin, axis=0, dtype=np.int64)
    found = np.unique(at)
    out[found] = np.packbits(sums[found] > 0, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def simhash(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A fingerprint per row of a UTF-8 column; equal texts have equal ones, no words give 0."""
    out = np.zeros(len(offsets) - 1, np.uint64)
    most = (1 << _ROW_BITS) - 1
    for low, high in slices(offsets):
        for begin in range(low, high, most):
            end = min(high, begin + most)
            part, cut = data[offsets[begin]:offsets[end]], offsets[begin:end + 1] - offsets[begin]
            keys = _long_terms(part) if end - begin == 1 and len(part) > 1 << 18 else _terms(part, cut)
            out[begin:end] = _votes(keys, end - begin)
    return out


def _simhash_texts(texts: list[str]) -> np.ndarray:
    offsets, data = utf8(pa.array(texts, pa.large_string()))
    return simhash(data, offsets)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and `fp` (64 bits as a signed long) of every row; null texts are empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(simhash(data, offsets).view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, fp bigint")


def within_radius(fps: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """fp and n_within: how many rows of `fps` lie within `radius` bits of each distinct query `fp`.

    A query that is itself among the rows counts itself. Equal fingerprints are grouped
    before the tables are made, so copies never meet in pairs. Only two blocks more than
    the radius are needed for keys of two blocks; other numbers trade tables for key width.
    """
    width, spare = 64 // blocks, 64 % blocks
    edges = [0]
    for b in range(blocks):
        edges.append(edges[-1] + width + (b < spare))
    whole = blocks - radius
    if whole < 1:
        raise ValueError("more blocks than the radius are needed")
    masks = []
    for chosen in combinations(range(blocks), whole):
        mask = sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)

    def tables(rows: DataFrame) -> DataFrame:
        keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])
        return rows.select("*", F.posexplode(keys).alias("table", "key"))

    sized = fps.groupBy("fp").agg(F.count("*").alias("n"))
    asked = tables(queries.select("fp").distinct()).withColumnRenamed("fp", "q")
    differ = F.col("q").bitwiseXOR(F.col("fp"))
    first = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(m).cast("long")) == 0, i) for i, m in enumerate(masks)])
    return (
        asked.join(tables(sized), ["table", "key"])
        .where((F.bit_count(differ) <= radius) & (F.col("table") == first))
        .groupBy(F.col("q").alias("fp")).agg(F.sum("n").alias("n_within"))
    )


def _ranges(rows: DataFrame) -> tuple[list[list[int]], int]:
    """Boundaries of id ranges with about `ROWS_PER_RANGE` rows, nested in two levels."""
    n = rows.count()
    if not n:
        return [], 0
    parts = min(MOST_RANGES, -(-n // ROWS_PER_RANGE))
    shares = [i / parts for i in range(1, parts)]
    least = rows.agg(F.min("__key")).first()[0]
    inner = rows.agg(F.percentile_approx("__key", shares, 10 * parts)).first()[0] if shares else []
    bounds = sorted({least, *inner})
    step = max(1, int(len(bounds) ** 0.5))
    return [bounds[i:i + step] for i in range(0, len(bounds), step)], len(bounds)


def _range_of(key, nested: list[list[int]]):
    """Number of the range a key is in: a step over the outer, then one over an inner level."""
    longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    step = len(nested[0])
    outer = F.size(F.filter(longs([b[0] for b in nested]), lambda x: x <= key)) - 1
    inner = F.element_at(F.array(*map(longs, nested)), outer + 1)
    return (outer * step + F.size(F.filter(inner, lambda x: x <= key)) - 1).cast("int")


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row, of its edited text and of the next row.

    doc_id, n_chars, edited_sha256, fp, edited_fp, next_fp. The edited text has its last
    floor(n_chars / 2) code points replaced by the first as many of the next row's text.
    Rows follow in ascending doc_id (null last), repeated ids in the order of their texts,
    and the first follows the last; a single row follows itself.

    Texts move once, to ranges of ids. The first row of each range also goes to the range
    before as a look-ahead, so every range is worked through as a stream on its own.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("__key"))
    nested, ranges = _ranges(rows.select("__key"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_chars bigint, edited_sha256 string, fp bigint, edited_fp bigint, next_fp bigint")
    if not ranges:
        return docs.sparkSession.createDataFrame([], schema)
    own = _range_of(F.col("__key"), nested)
    starts = F.array_contains(F.array(*[F.lit(v).cast("long") for b in nested for v in b]), F.col("__key"))
    ahead = F.pmod(F.col("__own") + ranges - 1, F.lit(ranges)).cast("int")
    where = F.array(F.struct(F.col("__own").alias("r"), F.lit(0).alias("ahead")))
    twice = F.array(
        F.struct(F.col("__own").alias("r"), F.lit(0).alias("ahead")), F.struct(ahead.alias("r"), F.lit(1).alias("ahead")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        rows.withColumn("__own", own).withColumn("__at", F.explode(F.when(starts, twice).otherwise(where)))
        .select("doc_id", "text", "__key", F.col("__at.r").alias("__range"), F.col("__at.ahead").alias("__ahead"))
        .repartition(n, "__range").sortWithinPartitions("__range", "__ahead", "__key", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, marks, prints = [], [], [], np.zeros(0, np.uint64)
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            for low, high in slices(offsets):
                part = batch.slice(low, high - low)
                ids += part.column("doc_id").to_pylist()
                texts += part.column("text").to_pylist()
                marks += list(zip(part.column("__range").to_pylist(), part.column("__ahead").to_pylist()))
                prints = np.append(prints, simhash(
                    data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]))
                yield made(ids, texts, marks, prints)
                ids, texts, marks, prints = ids[-1:], texts[-1:], marks[-1:], prints[-1:]

    def made(ids: list, texts: list, marks: list, prints: np.ndarray) -> pa.RecordBatch:
        """Results of all rows but the last, which waits for the row after it."""
        out = [i for i in range(len(ids) - 1) if not marks[i][1] and marks[i][0] == marks[i + 1][0]]
        edited = [texts[i][:len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][:len(texts[i]) // 2] for i in out]
        take = np.array(out, np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([ids[i] for i in out], batch_type), pa.array([len(texts[i]) for i in out], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(prints[take].view(np.int64)), pa.array(_simhash_texts(edited).view(np.int64)),
            pa.array(prints[take + 1].view(np.int64)),
        ], ["doc_id", "n_chars", "edited_sha256", "fp", "edited_fp", "next_fp"])

    batch_type = {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())
    return dealt.mapInArrow(run, schema)


def likeness(a: str, b: str):
    """Share of equal bits of two fingerprint columns."""
    return 1 - F.bit_count(F.col(a).bitwiseXOR(F.col(b))) / F.lit(64.0)


def compared(docs: DataFrame, every: int = 50, radius: int = RADIUS) -> DataFrame:
    """`with_edits` with likenesses, and n_within of the rows whose doc_id is divisible by `every`.

    n_within is the number of other rows within `radius` bits, found by the block tables;
    null for rows that aren't queries.
    """
    made = staged(with_edits(docs))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    near = within_radius(made.select("fp"), made.where(asks).select("fp"), radius)
    return made.join(near, "fp", "left").select(
        "doc_id", "n_chars", "edited_sha256",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.lower(F.lpad(F.hex("edited_fp"), 16, "0")).alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"),
        F.when(asks, F.col("n_within") - 1).alias("n_within"),
    )
