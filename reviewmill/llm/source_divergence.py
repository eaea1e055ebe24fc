"""Audit of how sources diverge from their language, by a minimal-perfect-hash recount.

1. First pass: every task tallies, per language, the documents that hold each term; the sums
   are exact, and terms in fewer than `LEAST_DOCS` documents of a language go.
2. The kept terms of a language are dealt by hash to shards of about `SHARD` terms. Each
   shard gets a minimal perfect hash (hash and displace): terms fall into small buckets, and
   each bucket takes the first pilot that sends its terms to free slots. The terms are
   stored in slot order, so that a lookup is verified against the stored bytes.
3. Second pass: the shards are broadcast in rounds of at most about `ROUND_BYTES`, whatever
   the vocabulary; each task looks up the terms of its tallies, once per term, and sends
   (slot, number) lists per (language, source, shard). Where these meet, they increment the
   shard's dense slots, one group after the other in a sorted stream.
4. Counts become integer shares. Sources are compared in tiles: a run of shards times two
   blocks of sources, so a task holds a bounded matrix however many sources there are.

Null text, language and source count as ''. A repeated row is a document of its own, and ties
in value are ranked by item. Groups without terms take part with counts of 0; an empty table
gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.common import mix64
from reviewmill.session import staged

LEAST_DOCS = 3
SCALE = 1_000_000_000
TOP_TERMS = 200
SHARD = 4096
ROUND_BYTES = 64_000_000
STRIP = 4
BLOCK = 256
_TALLIED = 300_000
_PIECE = 1 << 20
_PILOTS = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
# A term is a run of ASCII letters and of bytes of characters beyond ASCII.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^A-Za-z\x80-\xff]")


def _hash(terms: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, seed) for t in terms), np.uint64, len(terms))


def _slots(hashes: np.ndarray, pilots: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Slot of each hash among `size` slots: by its bucket's pilot, or the slot that a negative pilot names."""
    tried = mix64(hashes + pilots.astype(np.uint64) * _STEP) % size.astype(np.uint64)
    return np.where(pilots < 0, -1 - pilots.astype(np.int64), tried.astype(np.int64))


def _buckets(hashes: np.ndarray, number: np.ndarray) -> np.ndarray:
    return ((hashes >> np.uint64(32)) % number.astype(np.uint64)).astype(np.int64)


def perfect_hash(terms: list[bytes]) -> tuple[int, np.ndarray, np.ndarray]:
    """Seed, pilot of each bucket, and the slot of each of the distinct terms: all slots 0..n-1, once.

    Buckets of several terms are placed first, the largest ahead; a bucket of one term then
    names one of the free slots.
    """
    n, seed = len(terms), 0
    size, number = np.array(n), np.array(max(1, n // 2))
    while True:
        seed += 1
        hashes = _hash(terms, seed)
        if len(np.unique(hashes)) < n:
            continue
        order = np.argsort(_buckets(hashes, number), kind="stable")
        of, first, count = np.unique(_buckets(hashes, number)[order], return_index=True, return_counts=True)
        pilots, slot, free = np.zeros(int(number), np.int32), np.zeros(n, np.int64), [True] * n
        single = count == 1
        waiting = [k for k in np.argsort(-count, kind="stable").tolist() if count[k] > 1]
        for low in range(0, _PILOTS, 32):
            tried = np.arange(low, low + 32, dtype=np.int64)
            again = []
            for k, rows in zip(waiting, _tried_slots(hashes, order, first, count, waiting, tried, size)):
                for pilot, at in zip(tried.tolist(), rows):
                    if len(set(at)) == len(at) and all(free[s] for s in at):
                        pilots[of[k]], slot[order[first[k]:first[k] + count[k]]] = pilot, at
                        for s in at:
                            free[s] = False
                        break
                else:
                    again.append(k)
            waiting = again
            if not waiting:
                left = np.flatnonzero(free)
                slot[order[first[single]]] = left
                pilots[of[single]] = -1 - left
                return seed, pilots, slot


def _tried_slots(hashes, order, first, count, waiting, tried, size) -> Iterator[list[list[int]]]:
    """Per waiting bucket and tried pilot the slots of the bucket's terms."""
    if waiting:
        own = np.concatenate([order[first[k]:first[k] + count[k]] for k in waiting])
        grid = _slots(hashes[own][None, :], tried[:, None], size)
        at = 0
        for k in waiting:
            yield grid[:, at:at + count[k]].tolist()
            at += count[k]


class PerfectShards:
    """Lookup of the terms of some shards, each verified against the stored term."""

    def __init__(self, rows: list[dict], shards_of: dict[str, int]):
        self.shards_of = shards_of
        self.number = {(r["lang"], r["shard"]): i for i, r in enumerate(rows)}
        self.seed = [r["seed"] for r in rows]
        pilots = [np.frombuffer(r["pilots"], np.int32) for r in rows]
        ends = [np.frombuffer(r["ends"], np.int64) for r in rows]
        self.pilot_at = np.cumsum([0, *map(len, pilots)])
        self.size = np.array([len(e) for e in ends], np.int64)
        self.pilots = np.concatenate([np.zeros(0, np.int32), *pilots])
        self.keys, self.ends = [r["keys"] for r in rows], ends

    def find(self, lang: str, terms: list[bytes]) -> tuple[list[int], list[int]]:
        """Per term the number of its shard here and its slot, or -1 where the term is not kept."""
        shards = self.shards_of.get(lang, 0)
        if not shards or not terms:
            return [-1] * len(terms), [-1] * len(terms)
        shard = np.mod(_hash(terms, 42).view(np.int64), shards).tolist()
        where = [self.number.get((lang, s), -1) for s in shard]
        slot = np.full(len(terms), -1, np.int64)
        here = np.flatnonzero(np.array(where) >= 0)
        if len(here):
            at = np.array(where)[here]
            hashes = np.fromiter(
                (xxhash.xxh64_intdigest(terms[i], self.seed[w]) for i, w in zip(here.tolist(), at.tolist())), np.uint64, len(here))
            pilots = self.pilots[self.pilot_at[at] + _buckets(hashes, np.diff(self.pilot_at)[at])]
            slot[here] = _slots(hashes, pilots, self.size[at])
            for i, w, s in zip(here.tolist(), at.tolist(), slot[here].tolist()):
                ends = self.ends[w]
                if self.keys[w][ends[s - 1] if s else 0:ends[s]] != terms[i]:
                    slot[i] = -1
        return where, slot.tolist()


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of one text, in lists that stay small for long texts."""
    low = 0
    while low < len(text):
        gap = _GAP.search(text, min(low + _PIECE, len(text)))
        high = gap.start() if gap else len(text)
        yield _TERM.findall(text[low:high].lower())
        low = high


def document_groups(docs: DataFrame) -> DataFrame:
    """lang, source and text of every row, with '' for null."""
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """Rows as Python values, texts as bytes."""
    return zip(*(batch.column(c).cast(pa.binary()).to_pylist() if c == "text" else batch.column(c).to_pylist()
                 for c in names))


def kept_terms(groups: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """lang, term and `docs`, the documents of the language that hold it, at least `least`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Counter] = defaultdict(Counter)

        def made() -> pa.RecordBatch:
            langs = [lang for lang, t in tallies.items() for _ in range(len(t))]
            terms = [term.decode() for t in tallies.values() for term in t]
            numbers = [n for t in tallies.values() for n in t.values()]
            tallies.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(terms, pa.string()), pa.array(numbers, pa.int64())],
                ["lang", "term", "docs"])

        for batch in batches:
            for lang, text in _columns(batch, "lang", "text"):
                held = set()
                for terms in terms_of(text):
                    held.update(terms)
                tallies[lang].update(held)
                if len(tallies[lang]) > _TALLIED or len(tallies) > 64 and sum(map(len, tallies.values())) > _TALLIED:
                    yield made()
        yield made()

    return (
        groups.select("lang", "text").mapInArrow(run, "lang string, term string, docs bigint")
        .groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least)
    )


def perfect_shards(kept: DataFrame, per_shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """lang and `shards`; and lang, shard, seed, pilots, keys, ends: the perfect hash of each shard."""
    sizes = staged(kept.groupBy("lang").agg(
        F.count("*").alias("v"), F.ceil(F.count("*") / per_shard).cast("int").alias("shards")))
    dealt = kept.join(sizes, "lang").select(
        "lang", F.pmod(F.xxhash64("term"), F.col("shards")).cast("int").alias("shard"), "term")

    def build(table: pa.Table) -> pa.Table:
        terms = [t.encode() for t in table.column("term").to_pylist()]
        seed, pilots, slot = perfect_hash(terms)
        ordered = [terms[i] for i in np.argsort(slot).tolist()]
        ends = np.cumsum([len(t) for t in ordered])
        return pa.table({
            "lang": table.column("lang").slice(0, 1), "shard": table.column("shard").slice(0, 1),
            "seed": pa.array([seed], pa.int32()), "pilots": pa.array([pilots.tobytes()], pa.binary()),
            "keys": pa.array([b"".join(ordered)], pa.binary()), "ends": pa.array([ends.tobytes()], pa.binary())})

    return sizes, staged(dealt.groupBy("lang", "shard").applyInArrow(
        build, "lang string, shard int, seed int, pilots binary, keys binary, ends binary"))


_COUNTS = "lang string, source string, shard int, slots array<int>, counts array<bigint>"


def _tasks_counts(groups: DataFrame, broadcast) -> DataFrame:
    """lang, source, shard, slots and counts of the terms in one round's shards, summed up within each task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = PerfectShards(*broadcast.value)
        names = np.array([shard for _, shard in shards.number], np.int32)
        tallies: dict[tuple, Counter] = defaultdict(Counter)

        def made() -> Iterator[pa.RecordBatch]:
            codes: dict[str, dict[bytes, int]] = {}
            for lang in {lang for lang, _ in tallies}:
                terms = list(set().union(*(t for (own, _), t in tallies.items() if own == lang)))
                where, slot = shards.find(lang, terms)
                codes[lang] = {t: w << 32 | s if s >= 0 else -1 for t, w, s in zip(terms, where, slot)}
            for (lang, source), tally in tallies.items():
                code = np.fromiter(map(codes[lang].__getitem__, tally), np.int64, len(tally))
                count = np.fromiter(tally.values(), np.int64, len(tally))
                order = np.argsort(code, kind="stable")
                order = order[code[order] >= 0]
                code, count = code[order], count[order]
                of = code >> 32
                first = np.flatnonzero(np.diff(of, prepend=-1))
                ends = pa.array(np.append(first, len(code)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(first), pa.string()), pa.array([source] * len(first), pa.string()),
                    pa.array(names[of[first]]), pa.ListArray.from_arrays(ends, pa.array((code & 0xFFFFFFFF).astype(np.int32))),
                    pa.ListArray.from_arrays(ends, pa.array(count))], ["lang", "source", "shard", "slots", "counts"])
            tallies.clear()

        entries = 0
        for batch in batches:
            for lang, source, text in _columns(batch, "lang", "source", "text"):
                tally = tallies[lang, source]
                before = len(tally)
                for terms in terms_of(text):
                    tally.update(terms)
                entries += len(tally) - before
                if entries > _TALLIED:
                    yield from made()
                    entries = 0
        yield from made()

    return groups.mapInArrow(run, _COUNTS)


def _incremented(sent: DataFrame, per_shard: int) -> DataFrame:
    """Dense slots per (lang, source, shard) of rows sorted by these, as lists of the slots that are not 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, key, done = np.zeros(2 * per_shard, np.int64), None, []

        def close() -> None:
            held = np.flatnonzero(dense)
            done.append((*key, held.astype(np.int32), dense[held]))
            dense[held] = 0

        def made() -> pa.RecordBatch:
            kinds = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays = [pa.array(list(c), k) for c, k in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "shard", "slots", "counts"])

        for batch in batches:
            slots, counts = (batch.column(c) for c in ("slots", "counts"))
            ends = np.append(0, np.cumsum(slots.value_lengths().to_numpy())).tolist()
            slots, counts = slots.flatten().to_numpy(), counts.flatten().to_numpy()
            for i, own in enumerate(_columns(batch, "lang", "source", "shard")):
                if own != key:
                    if key is not None:
                        close()
                    key = own
                at = slots[ends[i]:ends[i + 1]]
                if len(at) and at.max() >= len(dense):
                    dense = np.append(dense, np.zeros(int(at.max()) + 1, np.int64))
                dense[at] += counts[ends[i]:ends[i + 1]]  # a row names a slot once
                if len(done) >= 200:
                    yield made()
        if key is not None:
            close()
        if done:
            yield made()

    return sent.mapInArrow(run, _COUNTS)


def recounted(groups: DataFrame, sizes: DataFrame, shards: DataFrame, round_bytes: int = ROUND_BYTES,
              per_shard: int = SHARD) -> DataFrame:
    """lang, source, shard, slots and counts > 0: how often the group holds the terms in these slots."""
    spark = groups.sparkSession
    stored = shards.agg(F.sum(F.octet_length("keys") + F.octet_length("ends") + F.octet_length("pilots"))).first()[0] or 0
    rounds = -(-stored // round_bytes)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("lang", "shard"), F.lit(max(1, rounds)))
    found = None
    for i in range(rounds):
        rows = [r.asDict() for r in shards.where(turn == i).collect()]  # about `round_bytes` at most
        langs = sizes.join(shards.where(turn == i).select("lang").distinct(), "lang", "left_semi")
        shards_of = {r["lang"]: r["shards"] for r in langs.collect()}
        sent = _tasks_counts(groups, spark.sparkContext.broadcast((rows, shards_of)))
        keys = ["lang", "source", "shard"]
        made = staged(_incremented(sent.repartition(parts, *keys).sortWithinPartitions(*keys), per_shard))
        found = made if found is None else found.unionByName(made)
    return spark.createDataFrame([], _COUNTS) if found is None else found


def _share(count: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (all + v)), exact beyond 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function(
        "div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(F.col("all") + F.col("v"))).cast("long")


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q): shares are at most SCALE + 1, so squares fit in 64 bits."""
    apart = p - q
    return apart * apart // q


def _pairs(cells: DataFrame) -> DataFrame:
    """lang, source, item and value of each ordered pair of sources of one tile.

    `cells` has a row per (lang, strip, i, j, shard, source): the source's block, its share of
    absent terms `p0`, the number of slots (`size`), and the slots and shares of the terms it holds.
    """
    def run(table: pa.Table) -> pa.Table:
        lang, i, j = (table.column(c)[0].as_py() for c in ("lang", "i", "j"))
        rows = table.select(["source", "block", "shard", "size", "p0"]).to_pylist()
        slots, shares = (table.column(c).combine_chunks() for c in ("at", "p"))
        ends = np.append(0, np.cumsum(slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))
        slots, shares = slots.flatten().to_numpy(), shares.flatten().to_numpy()
        for k, r in enumerate(rows):
            r["held"] = slice(int(ends[k]), int(ends[k + 1]))
        names = [sorted({r["source"] for r in rows if r["block"] == b}) for b in (i, j)]
        number = [{s: k for k, s in enumerate(n)} for n in names]
        by_shard = defaultdict(list)
        for r in rows:
            by_shard[r["shard"]].append(r)
        ahead = np.zeros((len(names[0]), len(names[1])), np.int64)
        back = np.zeros_like(ahead)
        for members in by_shard.values():
            sides = []
            for side, block in enumerate((i, j)):
                matrix = np.ones((len(names[side]), members[0]["size"]), np.int64)
                for r in members:
                    if r["block"] == block:
                        row = matrix[number[side][r["source"]]]
                        row[:] = r["p0"]
                        row[slots[r["held"]]] = shares[r["held"]]
                sides.append(matrix)
            for k in range(len(names[0])):
                ahead[k] += _divergence(sides[0][k], sides[1]).sum(1)
                if i != j:
                    back[k] += _divergence(sides[1], sides[0][k]).sum(1)
        a, b = np.indices(ahead.shape)
        a, b, ahead, back = a.ravel(), b.ravel(), ahead.ravel(), back.ravel()
        if i == j:
            other = a != b
            a, b, ahead, back = a[other], b[other], ahead[other], back[:0]
        left, right = (pa.array(n, pa.string()) for n in names)
        left, right = left.take(pa.array(a)), right.take(pa.array(b))
        turned = i != j
        return pa.table({
            "lang": pa.array([lang] * (len(a) * (1 + turned)), pa.string()),
            "source": pa.concat_arrays([left, right] if turned else [left]),
            "item": pa.concat_arrays([right, left] if turned else [right]),
            "value": pa.array(np.concatenate([ahead, back]))})

    return (
        cells.groupBy("lang", "strip", "i", "j").applyInArrow(run, "lang string, source string, item string, value bigint")
        .groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    )


def divergence(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP_TERMS, per_shard: int = SHARD,
               round_bytes: int = ROUND_BYTES, strip: int = STRIP, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value and rank.

    Part `pair`: every other source of the language with the summed divergence of the source's
    shares from that one's. Part `term`: the `top` terms whose share exceeds the language's.
    """
    groups = document_groups(docs)
    named = staged(groups.select("lang", "source").distinct())
    kept = staged(kept_terms(groups, least))
    sizes, shards = perfect_shards(kept, per_shard)
    counts = recounted(groups, sizes, shards, round_bytes, per_shard)
    group_sum = F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)
    totals = counts.groupBy("lang", "source").agg(F.sum(group_sum).alias("all"))
    # A row per group with its share of an absent term; block numbers are dealt by hash.
    blocks = named.groupBy("lang").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    known = staged(
        named.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").join(blocks, "lang")
        .withColumn("all", F.coalesce("all", F.lit(0).cast("long"))).withColumn("v", F.coalesce("v", F.lit(0).cast("long")))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")))
    # Of every group and shard, the slots it holds and its shares there; few rows, as a shard is one.
    slots = shards.select("lang", "shard", (F.octet_length("ends") / 8).cast("int").alias("size"))
    cells = staged(
        known.where("v > 0").join(slots, "lang").join(counts, ["lang", "source", "shard"], "left")
        .select("lang", "source", "shard", "size", "block", "blocks", "slots", "counts", "v",
                F.col("all"), _share(F.lit(0)).alias("p0"),
                F.transform("counts", lambda n: _share(n)).alias("shares")))
    tiles = (
        cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("lang", F.floor(F.col("shard") / strip).cast("int").alias("strip"),
                F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                "block", "shard", "source", "size", "p0", F.col("slots").alias("at"), F.col("shares").alias("p")))
    summed = _pairs(tiles)
    # Without kept terms every pair has 0.
    item = named.select("lang", F.col("source").alias("item"))
    empty = known.where("v = 0").select("lang", "source").join(item, "lang").where("source <> item").select(
        "lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = summed.unionByName(empty).withColumn("part", F.lit("pair"))

    above = _above_language(cells, shards, sizes, totals)
    rank = lambda: F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = above.withColumn("rank", rank()).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.withColumn("rank", rank()).unionByName(terms).select(
        "lang", "source", "part", "item", "value", "rank")


def _above_language(cells: DataFrame, shards: DataFrame, sizes: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, source, item and value of every term whose share in a group exceeds that in its language."""
    spread = cells.where("slots IS NOT NULL").select(
        "lang", "source", "shard", F.explode(F.arrays_zip("slots", "counts", "shares")).alias("x")).select(
        "lang", "source", "shard", F.col("x.slots").alias("slot"), F.col("x.counts").alias("n"), F.col("x.shares").alias("p"))
    of_lang = spread.groupBy("lang", "shard", "slot").agg(F.sum("n").alias("n"))
    lang_all = totals.groupBy("lang").agg(F.sum("all").alias("all"))
    base = of_lang.join(lang_all, "lang").join(sizes, "lang").select(
        "lang", "shard", "slot", _share(F.col("n")).alias("q"))
    apart = F.col("p") - F.col("q")
    return (
        spread.join(base.join(_names(shards), ["lang", "shard", "slot"]), ["lang", "shard", "slot"]).where("p > q")
        .select("lang", "source", "item", F.call_function("div", apart * apart, F.col("q")).alias("value"))
    )


def _names(shards: DataFrame) -> DataFrame:
    """lang, shard, slot and `item`, the stored term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, shard, keys, ends in _columns(batch, "lang", "shard", "keys", "ends"):
                ends = np.frombuffer(ends, np.int64).tolist()
                terms = [keys[a:b].decode() for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(ends), pa.string()), pa.array([shard] * len(ends), pa.int32()),
                    pa.array(range(len(ends)), pa.int32()), pa.array(terms, pa.string())],
                    ["lang", "shard", "slot", "item"])

    return shards.select("lang", "shard", "keys", "ends").mapInArrow(run, "lang string, shard int, slot int, item string")


ORACLE = """
WITH docs AS (
    SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
    FROM documents),
termed AS (
    SELECT lang, source, regexp_extract_all(text, '[a-z\\x{80}-\\x{10FFFF}]+') AS terms FROM docs),
kept AS (
    SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM termed)
    GROUP BY lang, term HAVING count(*) >= 3),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grouped AS (SELECT DISTINCT lang, source FROM docs),
counts AS (
    SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM termed)
    SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (
    SELECT lang, source, coalesce(sum(n), 0) AS "all" FROM grouped LEFT JOIN counts USING (lang, source)
    GROUP BY lang, source),
shares AS (
    SELECT lang, source, term, coalesce(n, 0) AS n,
           CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 1)) // ("all" + v) AS HUGEINT) AS p
    FROM totals JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
    SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY ALL
    UNION ALL
    SELECT a.lang, a.source, b.source, 0 FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
    WHERE a.lang NOT IN (SELECT lang FROM sizes)),
base AS (
    SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (n + 1)) // ("all" + v) AS HUGEINT) AS q
    FROM (SELECT lang, term, sum(n) AS n FROM counts GROUP BY lang, term)
    JOIN (SELECT lang, sum("all") AS "all" FROM totals GROUP BY lang) USING (lang) JOIN sizes USING (lang)),
terms AS (
    SELECT lang, source, term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value
    FROM shares JOIN base USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value,
       CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms
QUALIFY rank <= 200"""
