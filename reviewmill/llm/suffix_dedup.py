"""Suffix-array dedup of long repeated byte strings by external induced sorting.

Every `LENGTH`-byte window of a text has an anchor: its `GRAM`-byte substring of least
hash, the leftmost at ties. Equal windows have equal anchors at the same place, so windows
need comparing only where their anchors are equal and as far left of them. Consecutive
windows with one anchor form a run. Runs are counted by anchor; an anchor that occurs once
in the corpus proves its run unique, and equal runs are held once with their number.

What is left is dealt to shards by anchor, all texts aligned at it, and sorted by induction:
the order of the suffixes one byte further left follows from the order before, as each is a
byte and an already sorted suffix. The tuples (suffix, common prefix with its predecessor)
go through a priority queue keyed by (byte, old rank). Because tuples arrive in rank order
the queue is a row of first-in-first-out lists, one per byte, that are written to disk when
a shard exceeds its memory budget; common prefixes follow as one more than the least value
between two tuples of a list. The recursion runs from the last column of the runs to their
first. A window is repeated if its common prefix with a neighbour reaches `LENGTH`.

One sort can answer two lengths: windows then have the shorter one, runs hold the bytes that
the longer one needs to the right of them, and a common prefix is held against both.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.llm.common import prefix_sums, slices, substring_hashes, utf8
from reviewmill.session import staged

LENGTH = 400
GRAM = 250
# Passages of over 50 words have at least about this many bytes; their anchors are shorter, too.
PASSAGE, PASSAGE_GRAM = 200, 75
BOTH_GRAM = 50  # anchors where both lengths are asked for: as many as GRAM makes for LENGTH
SORT_ITEMS = 2_000_000
TEXT_BYTES = 256_000_000
_PIECE = 1 << 18
_DEAD = 300  # column left of a run's first byte


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by block-wise running minima."""
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, width)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - width + 1
    return np.minimum(after[:n], before[width - 1:width - 1 + n])


def _runs_of_piece(data: np.ndarray, ends: np.ndarray, length: int, gram: int,
                   reach: int) -> tuple[np.ndarray, ...]:
    """first window, last window, anchor and the two hashes of each run in a piece of texts.

    `ends` has for each byte the end of its text; windows begin in the first `_PIECE` bytes.
    """
    n = min(len(data) - length + 1, _PIECE)
    if n <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    sums = prefix_sums(data)
    at = np.arange(len(data) - gram + 1)
    hashes = substring_hashes(sums, at, at + gram)
    low_bits = np.uint64(_PIECE * 2 - 1)
    least = _sliding_min(hashes & ~low_bits | at.astype(np.uint64), length - gram + 1)
    anchor = (least[:n] & low_bits).astype(np.int64)
    valid = np.arange(n) + length <= ends[:n]
    starts = valid.copy()
    starts[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    stops = valid.copy()
    stops[:-1] &= (anchor[1:] != anchor[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(starts), np.flatnonzero(stops)
    whole = substring_hashes(sums, first, np.minimum(last + reach, ends[first]))
    return first, last, anchor[first], hashes[anchor[first]], whole


def runs(texts: DataFrame, length: int, gram: int, reach: int) -> DataFrame:
    """core, run (hashes of the anchor and of the whole run), k0, k1, first, more, back.

    `texts` has the row keys k0, k1 and `text`. A run's windows begin at bytes `first` to
    `first + more`; its anchor begins at `first + back`. The run holds `reach` bytes, at
    least `length`, from its last window on, or those that its text has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            k0, k1 = (batch.column(c).to_numpy() for c in ("k0", "k1"))
            for low, high in slices(offsets, _PIECE):
                begin, end = int(offsets[low]), int(offsets[high])
                for at in range(begin, max(begin + 1, end - length + 1), _PIECE):
                    part = data[at:min(end, at + _PIECE + reach - 1)]
                    bounds = np.clip(offsets[low:high + 1] - at, 0, len(part))
                    ends = np.repeat(bounds[1:], np.diff(bounds))
                    first, last, anchor, core, whole = _runs_of_piece(part, ends, length, gram, reach)
                    row = np.searchsorted(offsets, first + at, "right") - 1
                    yield pa.RecordBatch.from_arrays([
                        pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array(k0[row]), pa.array(k1[row]), pa.array(first + at - offsets[row]),
                        pa.array((last - first).astype(np.int16)), pa.array((anchor - first).astype(np.int16)),
                    ], ["core", "run", "k0", "k1", "first", "more", "back"])

    return texts.mapInArrow(
        run, "core bigint, run bigint, k0 bigint, k1 bigint, first bigint, more smallint, back smallint")


class _Lists:
    """First-in-first-out lists per symbol on disk: the priority queue of one column."""

    _kind = np.dtype([("item", "<i8"), ("common", "<i4")])

    def __init__(self, folder: str, name: str):
        self.path, self.files = os.path.join(folder, name), {}

    def push(self, symbol: int, items: np.ndarray, common: np.ndarray) -> None:
        rows = np.empty(len(items), self._kind)
        rows["item"], rows["common"] = items, common
        if symbol not in self.files:
            self.files[symbol] = open(f"{self.path}-{symbol}", "w+b")
        rows.tofile(self.files[symbol])

    def pop_all(self, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Tuples in order of (symbol, arrival), at most `most` at a time; the files go as they are read."""
        for symbol in sorted(self.files):
            file = self.files[symbol]
            file.seek(0)
            while len(rows := np.fromfile(file, self._kind, most)):
                yield rows["item"], rows["common"]
            file.close()
            os.remove(file.name)
        self.files = {}


class InducedSorter:
    """Sorts aligned runs column by column and reports the windows that occur twice."""

    def __init__(self, length: int, most_items: int = SORT_ITEMS, most_bytes: int = TEXT_BYTES,
                 longer: int | None = None):
        self.length, self.most_items, self.most_bytes = length, most_items, most_bytes
        self.lengths = [length] if longer in (None, length) else [length, longer]

    def repeated(self, chunks: Iterator[tuple[np.ndarray | bytes, ...]]) -> tuple[np.ndarray, np.ndarray]:
        """Item and window number of every repeated window; `chunks` as in `repeated_by_length`."""
        return self.repeated_by_length(chunks)[0]

    def repeated_by_length(self, chunks: Iterator[tuple[np.ndarray | bytes, ...]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length, item and number of every window that begins so many repeated bytes.

        `chunks` gives the runs' bytes joined, `more` and `back` of each run and, if runs
        hold more than their windows, their sizes.
        """
        with tempfile.TemporaryDirectory() as folder:  # scratch of this task alone, gone when it ends
            held, size, file = [], 0, None
            more, back, sizes = ([np.zeros(0, np.int64)] for _ in range(3))
            for text, m, b, *own in chunks:
                more.append(m.astype(np.int64))
                back.append(b.astype(np.int64))
                sizes.append(own[0].astype(np.int64) if own else more[-1] + self.length)
                size += len(text)
                held.append(text)
                if size > self.most_bytes:
                    file = file or open(os.path.join(folder, "texts"), "w+b")
                    file.write(b"".join(held))
                    held = []
            if file:
                file.write(b"".join(held))
                file.flush()
                data = np.memmap(file, np.uint8, "r")
            else:
                data = np.frombuffer(b"".join(held), np.uint8)
            return self._sort(data, *(np.concatenate(x) for x in (more, back, sizes)), folder)

    def _sort(self, data, more: np.ndarray, back: np.ndarray, sizes: np.ndarray,
              folder: str) -> list[tuple[np.ndarray, np.ndarray]]:
        found = [([np.zeros(0, np.int64)], [np.zeros(0, np.int64)]) for _ in self.lengths]
        if not len(more):
            return [(items[0], windows[0]) for items, windows in found]
        zero = np.cumsum(sizes) - sizes + back  # where column 0, the anchor, stands in `data`
        last = sizes - 1 - back
        enter = np.argsort(last, kind="stable")
        bounds = np.searchsorted(last[enter], np.arange(last.max() + 2))
        external = len(more) > self.most_items
        items, common = np.zeros(0, np.int64), np.zeros(0, np.int32)
        queue = _Lists(folder, "0")
        for column in range(int(last.max()), -int(back.max()) - 1, -1):
            new = enter[bounds[column]:bounds[column + 1]] if column >= 0 else enter[:0]
            fresh = (new, np.zeros(len(new), np.int32))
            if not external:
                items, common = np.concatenate([fresh[0], items]), np.concatenate([fresh[1], common])
                order, common, _ = self._induce(self._symbols(data, zero, back, items, column), common, None)
                items = items[order]
                stream = [(items, common)]
            else:
                old, queue = queue, _Lists(folder, str(column % 2))
                carry = np.full(_DEAD + 1, -1, np.int64)
                for part, near in self._with(fresh, old.pop_all(self.most_items)):
                    symbols = self._symbols(data, zero, back, part, column)
                    order, near, carry = self._induce(symbols, near, carry)
                    cuts = np.flatnonzero(np.diff(symbols[order], prepend=-1))
                    for low, high in zip(cuts, [*cuts[1:], len(part)]):
                        queue.push(int(symbols[order[low]]), part[order[low:high]], near[low:high])
                stream = self._kept(queue, folder, column) if column <= 0 else []
            if column <= 0:
                self._report(stream, -column, back, more, found)
        return [(np.concatenate(items), np.concatenate(windows)) for items, windows in found]

    def _with(self, fresh, old) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for low in range(0, len(fresh[0]), self.most_items):
            yield fresh[0][low:low + self.most_items], fresh[1][low:low + self.most_items]
        yield from old

    def _kept(self, queue: _Lists, folder: str, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The queue's tuples in order, without taking them out."""
        for symbol in sorted(queue.files):
            file = queue.files[symbol]
            file.flush()
            with open(file.name, "rb") as copy:
                while len(rows := np.fromfile(copy, queue._kind, self.most_items)):
                    yield rows["item"], rows["common"]

    @staticmethod
    def _symbols(data, zero: np.ndarray, back: np.ndarray, items: np.ndarray, column: int) -> np.ndarray:
        at = zero[items] + column
        if column >= 0:
            return data[at].astype(np.uint16)
        inside = column >= -back[items]
        return np.where(inside, data[np.where(inside, at, 0)].astype(np.uint16), np.uint16(_DEAD))

    @staticmethod
    def _induce(symbols: np.ndarray, common: np.ndarray, carry: np.ndarray | None):
        """Order by symbol, and common prefixes there.

        `carry` has per symbol the least common prefix since its last tuple in earlier
        chunks, -1 if it had none; without it the tuples are the whole column.
        """
        order = np.argsort(symbols, kind="stable")
        ranked = symbols[order]
        least = np.minimum.reduceat(np.append(common, common[-1:]), order + 1) if len(order) else common
        out = np.zeros(len(order), np.int32)
        if len(order):
            out[1:] = np.where(ranked[1:] == ranked[:-1], least[:-1] + 1, 0)
        if carry is not None and len(order):
            first = np.flatnonzero(np.diff(ranked.astype(np.int32), prepend=-1))
            final = np.append(first[1:], len(order)) - 1
            kinds = ranked[first]
            so_far = np.minimum.accumulate(common)
            known = carry[kinds]
            out[first] = np.where(known >= 0, np.minimum(known, so_far[order[first]]) + 1, 0)
            from_here = np.append(np.minimum.accumulate(common[::-1])[::-1], np.iinfo(np.int32).max)
            carry = np.where(carry >= 0, np.minimum(carry, so_far[-1]), -1)
            carry[kinds] = from_here[order[final] + 1]
        return order, out, carry

    def _report(self, stream, distance: int, back, more, found: list) -> None:
        """Items whose window `distance` bytes left of the anchor shares a length's bytes with a neighbour's."""
        before, pending = np.zeros(0, np.int64), [False] * len(self.lengths)
        for items, common in stream:
            for i, length in enumerate(self.lengths):
                long = common >= length
                twice = long.copy()
                twice[:-1] |= long[1:]
                if len(before) and long[0] and not pending[i]:
                    self._add(before, distance, back, more, *found[i])
                self._add(items[twice], distance, back, more, *found[i])
                pending[i] = bool(twice[-1])
            before = items[-1:]

    @staticmethod
    def _add(items, distance, back, more, found_item, found_window) -> None:
        window = back[items] - distance
        own = (window >= 0) & (window <= more[items])
        found_item.append(items[own])
        found_window.append(window[own])


def _intervals(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item, first and last window of each maximal row of repeated windows."""
    code = np.unique(items << 20 | windows)
    begin = np.flatnonzero(np.diff(code, prepend=-2) != 1)
    end = np.append(begin[1:], len(code)) - 1 if len(code) else begin
    return code[begin] >> 20, code[begin] & 0xFFFFF, code[end] & 0xFFFFF


def _cut_runs(asked: DataFrame, reach: int) -> DataFrame:
    """core, run, single, more, back and the run's bytes, for rows of `text` and the `runs` in it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            wanted = batch.column("runs")
            owner = np.repeat(np.arange(batch.num_rows), wanted.value_lengths().to_numpy(zero_copy_only=False))
            fields = wanted.flatten().flatten()
            first, more = (fields[i].to_numpy().astype(np.int64) for i in (3, 4))
            low = offsets[owner] + first
            high = np.minimum(low + more + reach, offsets[owner + 1])
            texts = [data[a:b].tobytes() for a, b in zip(low.tolist(), high.tolist())]
            for at in range(0, len(texts), 10_000):
                part = slice(at, at + 10_000)
                yield pa.RecordBatch.from_arrays(
                    [*(fields[i][part] for i in (0, 1, 2, 4, 5)), pa.array(texts[part], pa.binary())],
                    ["core", "run", "single", "more", "back", "bytes"])

    return asked.mapInArrow(
        run, "core bigint, run bigint, single boolean, more smallint, back smallint, bytes binary")


def _sorted_shards(cut: DataFrame, length: int, reach: int, most_items: int, most_bytes: int) -> DataFrame:
    """core, run, low, high, longer: rows of repeated windows of each single run, from one sort per partition.

    Those with `longer` begin `reach` repeated bytes each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, single = [np.zeros((0, 2), np.int64)], [np.zeros(0, bool)]

        def chunks():
            for batch in batches:
                names.append(np.stack([batch.column(c).to_numpy() for c in ("core", "run")], axis=1))
                single.append(batch.column("single").to_numpy(zero_copy_only=False))
                texts = batch.column("bytes").to_pylist()
                yield (b"".join(texts), batch.column("more").to_numpy(), batch.column("back").to_numpy(),
                       np.fromiter(map(len, texts), np.int64, len(texts)))

        sorter = InducedSorter(length, most_items, most_bytes, reach)
        found = sorter.repeated_by_length(chunks())
        keys, alone = np.concatenate(names), np.concatenate(single)
        for size, (items, windows) in zip(sorter.lengths, found):
            item, low, high = _intervals(items[alone[items]], windows[alone[items]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[item, 0]), pa.array(keys[item, 1]), pa.array(low), pa.array(high),
                 pa.array(np.full(len(item), size == reach))],
                ["core", "run", "low", "high", "longer"])

    return cut.mapInArrow(run, "core bigint, run bigint, low bigint, high bigint, longer boolean")


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with row keys and no null text; rows that agree in doc_id and text have the same result."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62)).cast("long"))
    filled = docs.withColumn("text", F.coalesce("text", F.lit("")))
    return filled.withColumn("k0", key).withColumn("k1", F.xxhash64("text"))


def repeated_spans(rows: DataFrame, length: int = LENGTH, gram: int = GRAM,
                   most_items: int = SORT_ITEMS, most_bytes: int = TEXT_BYTES,
                   passage: int | None = None) -> DataFrame:
    """k0, k1 and `spans`, an array of (start, stop, longer): windows of `_keyed` rows that begin elsewhere too.

    Windows beginning at bytes `start` to `stop` have `passage` bytes, `length` if that is
    None; with `longer`, `length` bytes from there are repeated too, where the text has them.
    One row per text with such windows; spans may overlap. Documents that are copies of one
    another, in rows or in texts, count as often as they occur.
    """
    reach, length = length, passage or length
    texts = rows.where(F.octet_length("text") >= length).select("k0", "k1", "text")
    found = staged(runs(texts, length, gram, reach))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Staged, so that both sides of the join come from a shuffle that AQE can split at a hot anchor.
    cores = staged(
        found.groupBy("core").agg(F.count("*").alias("n"), F.min("run").alias("a"), F.max("run").alias("b"))
        .where("n > 1").select("core", (F.col("a") != F.col("b")).alias("mixed"))
    )
    candidates = staged(found.join(cores, "core"))
    counted = staged(candidates.where("mixed").groupBy("core", "run").agg(
        F.count("*").alias("n"), F.min(F.struct("k0", "k1", "first", "more", "back")).alias("at")))
    # Anchors all of whose runs occur twice need no sort.
    single = counted.where("n = 1").select("core").distinct()
    asked = (
        counted.join(single, "core", "left_semi")
        .groupBy(F.col("at.k0").alias("k0"), F.col("at.k1").alias("k1"))
        .agg(F.collect_list(F.struct(
            "core", "run", (F.col("n") == 1).alias("single"), "at.first", "at.more", "at.back")).alias("runs"))
    )
    # All columns of all rows, so that the caller's join of rows and spans uses the same exchange again.
    cut = _cut_runs(rows.join(asked, ["k0", "k1"]), reach)
    sorted_ = _sorted_shards(cut.repartition(n, "core"), length, reach, most_items, most_bytes)
    whole = (F.lit(0).cast("long").alias("low"), F.col("more").cast("long").alias("high"), F.lit(True).alias("longer"))
    ranges = sorted_.unionByName(counted.where("n > 1").select("core", "run", *[
        whole[0], F.col("at.more").cast("long").alias("high"), whole[2]]))
    spans = (
        candidates.where("mixed").join(ranges, ["core", "run"])
        .unionByName(candidates.where("NOT mixed").select("*", *whole))
    )
    return spans.groupBy("k0", "k1").agg(F.collect_list(F.struct(
        (F.col("first") + F.col("low")).alias("start"),
        (F.col("first") + F.col("high")).alias("stop"), "longer")).alias("spans"))


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    begin = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
    return starts[begin], reach[np.append(begin[1:], len(starts)) - 1]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM,
                    most_items: int = SORT_ITEMS, most_bytes: int = TEXT_BYTES,
                    keep: tuple[str, ...] = ("doc_id",), as_text: bool = False,
                    passage: int | None = None) -> DataFrame:
    """`keep` columns, n_bytes, n_removed, n_spans and `kept`, the bytes that remain, of every row.

    With `passage`, a shorter length, also n_passage_bytes and n_passages: the bytes that
    strings of that length cover in the same way, and their maximal runs; they are not removed.
    With `as_text` the bytes are decoded; halves of characters at cut ends go.
    A byte goes if any `length`-byte string over it begins anywhere else too, in this row or
    another, as judged on the input. Null texts are empty; texts shorter than `length` lose
    nothing; a repeated row loses all its bytes if it has `length` of them.
    """
    if not 0 < gram < (passage or length) <= length:
        raise ValueError("the anchor must be shorter than the string, and a passage no longer")
    rows = _keyed(docs.select("doc_id", *[c for c in keep if c not in ("doc_id", "text")], "text"))
    spans = repeated_spans(rows, length, gram, most_items, most_bytes, passage)
    joined = rows.join(spans, ["k0", "k1"], "left").select(
        *[F.col(c) for c in keep if c != "text"], "text", "spans")
    extra = ("n_passage_bytes", "n_passages") if passage else ()
    numbers = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans", *extra)]
    kind = T.StructField("kept", T.StringType() if as_text else T.BinaryType())
    schema = T.StructType([*(rows.schema[c] for c in keep if c != "text"), *numbers, kind])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            spans = batch.column("spans")
            counts = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.append(0, np.cumsum(counts))
            starts, stops, longer = (f.to_numpy(zero_copy_only=False) for f in spans.flatten().flatten())
            kept, found = [], np.zeros((2 + len(extra), batch.num_rows), np.int64)
            for i in range(batch.num_rows):
                text = data[offsets[i]:offsets[i + 1]]
                if counts[i]:
                    start, stop = starts[cuts[i]:cuts[i + 1]], stops[cuts[i]:cuts[i + 1]]
                    if passage:
                        low, high = _merged(start, stop + passage)
                        found[2:, i] = (high - low).sum(), len(low)
                    stop = np.minimum(stop, len(text) - length)
                    own = longer[cuts[i]:cuts[i + 1]] & (start <= stop)
                    low, high = _merged(start[own], stop[own] + length)
                    found[:2, i] = (high - low).sum(), len(low)
                    text = np.concatenate([text[a:b] for a, b in zip([0, *high], [*low, len(text)])])
                kept.append(text.tobytes().decode(errors="ignore") if as_text else text.tobytes())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep if c != "text"), pa.array(np.diff(offsets)), *map(pa.array, found),
                 pa.array(kept, pa.string() if as_text else pa.binary())],
                [*(c for c in keep if c != "text"), "n_bytes", "n_removed", "n_spans", *extra, "kept"])

    return joined.mapInArrow(run, schema)


def deduplicated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` without the repeated bytes, with n_chars to match; every row stays.

    Null texts become empty, texts shorter than `length` stay as they are, a repeated row
    loses its text if that has `length` bytes, and an empty table gives none.
    """
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias("__row"))
    kept = without_repeats(packed, length, gram, keep=("doc_id", "__row"), as_text=True)
    made = {
        "text": F.col("kept"),
        "n_chars": F.length("kept").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return kept.select(*[
        (made[c] if c in made else F.col("__row").getField(c)).alias(c) for c in docs.columns])
