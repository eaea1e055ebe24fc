"""Topics: density clusters of each product's positive and negative reviews, with keywords.

Distances are read from random-hyperplane signatures (Charikar 2002): the
share of differing bits estimates the angle between two vectors. Reviews meet
in cells, which are leading bits of one of several signature keys, and never in
pairs, so the work grows with the number of reviews however they are spread
over products. A cell that mixes clusters is split by further bits of its key
until what it holds is coherent or too little.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.text import keyword_tokens, ngram_counts, ngrams
from reviewmill.operators.components import connected_components
from reviewmill.operators.skew import HOT_ROWS, hot_key_join, hot_keys, salted_join
from reviewmill.schema import MIN_CLUSTER_REVIEWS
from reviewmill.session import staged

SIGNATURE_BITS = 128  # of the part that distances are read from, two longs
KEYS = 8
KEY_BITS = 48
KEY_STEP = 24  # keys begin this many planes apart, and reach into the next one's
FIRST_BITS, MORE_BITS = 8, 4
FILTER_BITS = 27  # a filter of cells or words has at most 2 ** 27 bits, 16 MB
PIECE_TOKENS = 1 << 20  # Python counts the pairs of about so many tokens at a time
GROUP = ["product_id", "polarity"]
OTHER = "other"


@dataclass(frozen=True)
class ClusterSettings:
    """`eps` and `levels` are cosine distances; the first three are fixed values of the original model."""

    min_reviews: int = MIN_CLUSTER_REVIEWS
    min_cluster_size: int = 10
    min_samples: int = 5
    eps: float = 0.25
    levels: tuple[float, ...] = ()
    cohesion: float = 0.75  # a cell's mean distance to its centre, as a share of the radius
    seed: int = 42
    hot_rows: int = HOT_ROWS

    @property
    def radius(self) -> int:
        """Differing signature bits at an angle whose cosine is 1 - eps."""
        return int(SIGNATURE_BITS * math.acos(1 - self.eps) / math.pi)


def signature(vector: Column, seed: int = 42) -> Column:
    """Sides of random planes: 128 to read distances from, then the keys that cells are cut from.

    An array of longs, or null for a vector that is null, zero or not finite. The
    planes follow from seed and dimension, so vectors of different lengths, each
    signed by planes of its own, look unrelated.
    """
    planes: dict[int, np.ndarray] = {}

    def packed(bits: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(bits), 64), np.uint8)
        wide[:, :bits.shape[1]] = bits
        return np.packbits(wide, axis=1, bitorder="little").view("<i8").ravel()

    @F.pandas_udf("array<long>")
    def sides(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), dtype=object)
        held = [None if v is None else np.asarray(v, np.float64) for v in vectors]
        good = [i for i, v in enumerate(held) if v is not None and np.isfinite(v).all() and v.any()]
        for dim in {len(held[i]) for i in good}:
            rows = [i for i in good if len(held[i]) == dim]
            if dim not in planes:
                planes[dim] = np.random.default_rng(seed).standard_normal(
                    (dim, SIGNATURE_BITS + KEYS * KEY_STEP))
            bits = (np.stack([held[i] for i in rows]) @ planes[dim] > 0).astype(np.uint8)
            near, rest = bits[:, :SIGNATURE_BITS], bits[:, SIGNATURE_BITS:]
            keys = [packed(rest[:, (k * KEY_STEP + np.arange(KEY_BITS)) % rest.shape[1]]) for k in range(KEYS)]
            for i, row in zip(rows, np.stack([packed(near[:, :64]), packed(near[:, 64:]), *keys], axis=1)):
                out[i] = row
        return out

    return sides(vector)


def eligible(rows: DataFrame, min_reviews: int = MIN_CLUSTER_REVIEWS) -> DataFrame:
    """Rows of (product, polarity) groups with enough reviews, and the group size `n`."""
    sizes = rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where(F.col("n") >= min_reviews)
    return salted_join(rows, sizes, GROUP, ["review_key"])


def _keyed(points: DataFrame) -> DataFrame:
    """One row per point and signature key."""
    return points.select("*", F.posexplode("keys").alias("tree", "key")).drop("keys")


def _node(bits: int) -> Column:
    """Name of the cell that a key is in at a depth: depth, tree and leading bits."""
    head = F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    depth = (bits - FIRST_BITS) // MORE_BITS
    return (F.lit(depth * KEYS).cast("long") + F.col("tree")) * F.lit(1 << KEY_BITS) + head


def _full_cells(cells: DataFrame, min_samples: int, widest: float) -> DataFrame:
    """Cells with enough points and their centre: the majority side of every plane.

    A cell that two clusters share has a centre between them and a large mean
    distance to it. It is not `coherent`, as it would chain the clusters. A sum counts two
    planes, 32 bits apart, as Spark does not compile aggregates of over 100 columns; in a cell
    of over 2 ** 31 points it would fail by overflow.
    """
    two = F.lit(1 << 32 | 1).cast("long")
    counts = [F.sum(F.shiftright(f"sig{w}", i).bitwiseAND(two)).alias(f"b{w}_{i}") for w in (0, 1) for i in range(32)]
    sums = cells.groupBy(*GROUP, "node").agg(F.count("*").alias("size"), *counts)
    kept = [*GROUP, "node", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = _longs(batch.column("size"))[:, None]
            both = np.stack([_longs(c).view(np.uint64) for c in batch.columns[len(kept):]], axis=1)
            parts = [(both[:, w:w + 32] >> np.uint64(s)) & np.uint64(0xFFFFFFFF) for w in (0, 32) for s in (0, 32)]
            ones = np.concatenate(parts, axis=1).astype(np.int64)
            centres = np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<i8")
            coherent = np.minimum(ones, size - ones).sum(axis=1) <= size[:, 0] * widest
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, *(pa.array(np.ascontiguousarray(c)) for c in centres.T), pa.array(coherent)],
                [*kept, "centre0", "centre1", "coherent"])

    schema = sums.select(*kept).schema.add("centre0", "long").add("centre1", "long").add("coherent", "boolean")
    return sums.where(F.col("size") >= min_samples).mapInArrow(run, schema)


def _members(points: DataFrame, s: ClusterSettings) -> tuple[DataFrame, DataFrame, list[int]]:
    """Points in coherent cells with the cell's centre, those cells, and the depths they are at.

    Each depth takes one aggregate over the points whose cells were still mixed; cells
    under `min_samples` hold no cluster and go. Steps are staged, not checkpointed, as the size
    estimates that checkpoints keep multiply with every depth.
    """
    left, found, cells, depths = _keyed(points), [], [], []
    for bits in range(FIRST_BITS, KEY_BITS + 1, MORE_BITS):
        at = left.withColumn("node", _node(bits))
        full = staged(_full_cells(at, s.min_samples, s.cohesion * s.radius))
        hot = hot_keys(full, [*GROUP, "node"], "size", s.hot_rows)
        placed = staged(hot_key_join(at, full, [*GROUP, "node"], hot, ["review_key"]))
        inside = placed.where("coherent").withColumn("distance", _distance())
        found.append(inside.where(_within(s.radius)).drop("coherent", "key", "tree"))
        cells.append(full.where("coherent").drop("coherent"))
        depths.append(bits)
        left = placed.where("NOT coherent").drop("node", "size", "centre0", "centre1", "coherent")
        if left.isEmpty():
            break
    members, dense = found[0], cells[0]
    for more, further in zip(found[1:], cells[1:]):
        members, dense = members.unionByName(more), dense.unionByName(further)
    return staged(members), staged(dense), depths


def _distance() -> Column:
    return sum(F.bit_count(F.col(f"sig{i}").bitwiseXOR(F.col(f"centre{i}"))) for i in (0, 1))


def _within(radius: int, flipped: int = 0) -> Column:
    """Whether a point lies within the radius of its cell's centre.

    The leading key bits, of which all but `flipped` agree with the centre's, are evidence
    too: the share of differing bits is taken over them and the signature.
    """
    depth = F.shiftright("node", KEY_BITS + KEYS.bit_length() - 1)
    bits = SIGNATURE_BITS + FIRST_BITS + depth * MORE_BITS
    return (F.col("distance") + flipped) * SIGNATURE_BITS <= bits * radius


def _slots(home: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """The bit of a filter of 2 ** `bits` that a name in a group has; `home` is a hash of the group."""
    mixed = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + home.view(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return mixed >> np.uint64(64 - bits)


def _held(words: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (words[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1)).astype(bool)


def _longs(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _text_hashes(column: pa.Array) -> np.ndarray:
    return pd.util.hash_array(column.to_numpy(zero_copy_only=False), categorize=False).view(np.int64)


def _filter(rows: DataFrame, group: list[str], name: str, number: Callable[[pa.Array], np.ndarray]) -> tuple[np.ndarray, int]:
    """Words in which the `name` of every row has its bit set, and the logarithm of the number of bits, about 64 a row."""
    bits = min(FILTER_BITS, max(10, (64 * rows.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = _slots(_longs(batch.column(0)), number(batch.column(1)), bits)
            words, at = np.unique(slots >> np.uint64(6), return_inverse=True)
            made = np.zeros(len(words), np.uint64)
            np.bitwise_or.at(made, at, np.uint64(1) << (slots & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(made.view(np.int64))], ["word", "held"])

    found = rows.select(_home(group), name).mapInArrow(run, "word long, held long")
    table = found.groupBy("word").agg(F.bit_or("held").alias("held")).toArrow()  # at most 2 ** 21 words
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[table.column("word").to_numpy()] = table.column("held").to_numpy().view(np.uint64)
    return out, bits


def _home(group: list[str]) -> Column:
    return F.xxhash64(F.lit(0), *group).alias("home")


def _one_bit_away(points: DataFrame, cells: DataFrame, depths: list[int]) -> DataFrame:
    """`points` once per `node` that differs from a cell of theirs in one bit of a key and may be among `cells`.

    A point has over a thousand such names at a few depths, nearly all of cells that do not
    exist. Names are looked up in a filter of the existing ones first, which may let some more
    through but none fall, so only few are moved for the join.
    """
    words, bits = _filter(cells, GROUP, "node", _longs)
    shared = points.sparkSession.sparkContext.broadcast(words)
    kept = [*GROUP, "review_key", "sig0", "sig1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _longs(batch.column("keys").flatten()).reshape(-1, KEYS)
            home = _longs(batch.column("home"))[:, None]
            for depth in depths:
                flips = np.int64(1) << np.arange(depth, dtype=np.int64)
                for tree in range(KEYS):
                    name = np.int64(((depth - FIRST_BITS) // MORE_BITS * KEYS + tree) << KEY_BITS)
                    away = (name + (keys[:, tree] & np.int64((1 << depth) - 1)))[:, None] ^ flips
                    rows, places = np.nonzero(_held(shared.value, _slots(home, away, bits)))
                    if len(rows):
                        picked = batch.select(kept).take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(away[rows, places])], [*kept, "node"])

    schema = points.select(*kept).schema.add("node", "long")
    return points.select(*kept, "keys", _home(GROUP)).mapInArrow(run, schema)


def _nearest(found: DataFrame) -> DataFrame:
    """Per review the component of the closest cell centre, ties to the smallest label."""
    packed = F.min(F.col("distance").cast("long") * (1 << 56) + F.col("label"))
    return found.groupBy(*GROUP, "review_key").agg((packed % (1 << 56)).alias("label"))


def signed_points(rows: DataFrame, s: ClusterSettings) -> DataFrame:
    """Group, review_key, signature and keys of every review in a large enough group; written once for all levels."""
    vectors = rows.where(F.col("polarity").isNotNull()).select(*GROUP, "review_key", "embedding")
    signed = vectors.select(*GROUP, "review_key", signature(F.col("embedding"), s.seed).alias("sides"))
    return staged(eligible(signed, s.min_reviews).select(
        *GROUP, "review_key", F.element_at("sides", 1).alias("sig0"),
        F.element_at("sides", 2).alias("sig1"), F.slice("sides", 3, KEYS).alias("keys"),
    ))


def level_clusters(points: DataFrame, s: ClusterSettings) -> DataFrame:
    """Group, review_key and `label` of every review in a dense cluster at one `eps`, of at least `min_cluster_size`.

    A review belongs to a cell when it is within `eps` of the cell's centre. Two cells join
    when they share such a review and their centres are within half of that, and connected
    cells make a cluster. Reviews in no dense cell may still join through a cell one bit
    away, as border points.
    """
    members, dense, depths = _members(points, s)
    hot = hot_keys(dense, [*GROUP, "node"], "size", s.hot_rows)
    # A review has at most one cell per key, so its list and its cell pairs are few.
    together = members.groupBy(*GROUP, "review_key").agg(
        F.sort_array(F.collect_list(F.struct("node", "centre0", "centre1"))).alias("cells")
    )
    links = F.expr(f"""
        inline(filter(flatten(transform(cells, (x, i) ->
            transform(slice(cells, i + 2, size(cells)), y ->
                named_struct('a', x.node, 'b', y.node, 'apart',
                    bit_count(x.centre0 ^ y.centre0) + bit_count(x.centre1 ^ y.centre1))))),
            link -> link.apart <= {s.radius // 2}))""")
    edges = together.select(*GROUP, links).select(*GROUP, "a", "b").distinct()
    roots = connected_components(edges, GROUP)
    labelled = staged(dense.join(roots, [*GROUP, "node"], "left").select(
        *GROUP, "node", "centre0", "centre1", F.coalesce("label", "node").alias("label")
    ))

    named = staged(hot_key_join(
        members, labelled.drop("centre0", "centre1"), [*GROUP, "node"], hot, ["review_key"]
    ))
    sizes = _nearest(named).groupBy(*GROUP, "label").agg(F.count("*").alias("reviews"))
    kept = staged(sizes.where(F.col("reviews") >= s.min_cluster_size).drop("reviews"))
    # Reviews nearest to a component that is too small go to the nearest one that is not.
    core = staged(_nearest(named.join(kept, [*GROUP, "label"], "left_semi")))

    # Border points look into the cells that differ in one bit of a key.
    rest = points.join(core.select(*GROUP, "review_key"), [*GROUP, "review_key"], "left_anti")
    targets = staged(labelled.join(kept, [*GROUP, "label"], "left_semi"))
    border = _nearest(
        hot_key_join(_one_bit_away(rest, targets, depths), targets, [*GROUP, "node"], hot, ["review_key"])
        .withColumn("distance", _distance())
        .where(_within(s.radius, flipped=1))
    )
    return staged(core.unionByName(border))


def _cluster_tree(levels: list[DataFrame], s: ClusterSettings) -> DataFrame:
    """Group, level, label, n, and the `parent` label on the next wider level (null for a root) of every cluster.

    A cluster's parent is the one that holds most of its reviews.
    """
    nodes = []
    for i, own in enumerate(levels):
        sizes = own.groupBy(*GROUP, "label").agg(F.count("*").alias("n"))
        if i + 1 < len(levels):
            wider = levels[i + 1].withColumnRenamed("label", "parent")
            shared = own.join(wider, [*GROUP, "review_key"]).groupBy(*GROUP, "label", "parent").agg(
                F.count("*").alias("common"))
            best = shared.groupBy(*GROUP, "label").agg(
                F.min_by("parent", F.struct(-F.col("common"), "parent")).alias("parent"))
            sizes = sizes.join(best, [*GROUP, "label"], "left")
        else:
            sizes = sizes.withColumn("parent", F.lit(None).cast("long"))
        nodes.append(sizes.withColumn("level", F.lit(i)))
    tree = nodes[0]
    for more in nodes[1:]:
        tree = tree.unionByName(more)
    return staged(tree)


def selected_clusters(tree: DataFrame, eps: tuple[float, ...]) -> DataFrame:
    """Group, level and label of the clusters with most excess of mass.

    With density 1 / eps, a cluster lives from the level where it parts from others to the
    level where it falls apart into at least two, and its mass is the sum over the levels
    between of its reviews there times the rise in density. From the narrowest level up, a
    cluster is worth the greater of its own mass and the worth of those it falls apart into;
    from the widest down, the first ones whose own mass is not less are taken. Each step is
    one aggregate over the clusters of a level.
    """
    density = [1 / e for e in eps] + [1.0]
    key = [*GROUP, "label"]
    worth: list[DataFrame] = []
    for i in range(len(eps)):
        own = F.col("n") * F.lit(density[i] - density[i + 1])
        here = tree.where(F.col("level") == i)
        if i == 0:
            found = here.select(*key, "parent", own.alias("own"), F.lit(0.0).alias("parts"), F.lit(0).alias("children"))
        else:
            below = worth[-1].where("parent IS NOT NULL").groupBy(*GROUP, F.col("parent").alias("label")).agg(
                F.count("*").alias("children"), F.sum(F.greatest("own", "parts")).alias("best"),
                F.max("own").alias("only_own"), F.max("parts").alias("only_parts"))
            alone = F.col("children") == 1  # the same cluster, a little narrower
            found = here.join(below, key, "left").select(
                *key, "parent",
                (own + F.when(alone, F.col("only_own")).otherwise(0.0)).alias("own"),
                F.coalesce(F.when(alone, F.col("only_parts")).otherwise(F.col("best")), F.lit(0.0)).alias("parts"),
                F.coalesce("children", F.lit(0)).alias("children"))
        worth.append(staged(found))
    chosen, above = [], None
    for i in reversed(range(len(eps))):
        rows = worth[i]
        if above is not None:
            rows = rows.join(above, [*GROUP, "parent"], "left")
        else:
            rows = rows.withColumn("open", F.lit(None).cast("string"))
        # A root, or a part of one that fell apart, may be taken; what lives on within a passed-over one may not.
        rows = rows.withColumn("open", F.when(F.col("parent").isNull(), "whole").otherwise(F.coalesce("open", F.lit("closed"))))
        taken = (F.col("open") == "whole") & (F.col("own") >= F.col("parts"))
        chosen.append(rows.where(taken).select(*key, F.lit(i).alias("level")))
        state = F.when(taken | (F.col("open") == "closed"), "closed").when(F.col("children") >= 2, "whole").otherwise("passed")
        above = staged(rows.select(*GROUP, F.col("label").alias("parent"), state.alias("open")))
    out = chosen[0]
    for more in chosen[1:]:
        out = out.unionByName(more)
    return staged(out)


def _over_levels(points: DataFrame, s: ClusterSettings) -> DataFrame:
    """Group, review_key and label of the reviews of the clusters selected over all levels of `eps`."""
    eps = tuple(sorted(s.levels))
    levels = [level_clusters(points, replace(s, eps=e, levels=())) for e in eps]
    chosen = selected_clusters(_cluster_tree(levels, s), eps)
    # Cells of different levels may share a name, so the level goes into the label; at most 16 levels.
    named = F.col("label") * 16 + F.col("level")
    found = None
    for i, own in enumerate(levels):
        hits = salted_join(own, chosen.where(F.col("level") == i), [*GROUP, "label"], ["review_key"]).select(
            *GROUP, "review_key", "level", named.alias("label"))
        found = hits if found is None else found.unionByName(hits)
    # A review that parents by majority left in two selected clusters goes to the narrower one.
    return staged(found.groupBy(*GROUP, "review_key").agg(F.min_by("label", "level").alias("label")))


def cluster_reviews(rows: DataFrame, settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """Topic number of every review in a large enough (product, polarity) group.

    `rows` has product_id, polarity, review_key and embedding. Clusters are found on every
    level of `eps` and selected by excess of mass, so topics of different density stand
    side by side; without levels, `eps` alone is used. Topics under `min_cluster_size`,
    reviews whose vector is null, zero or not finite, and all else are -1. Nothing depends
    on the group's size. Topics are numbered from 0 by size.
    """
    s = settings
    all_points = signed_points(rows, s)
    points = all_points.where(F.col("sig0").isNotNull())
    assigned = _over_levels(points, s) if s.levels else level_clusters(points, s)
    final = assigned.groupBy(*GROUP, "label").agg(F.count("*").alias("reviews"))
    # A topic has at least `min_cluster_size` reviews, so one row here stands for as many.
    by_size = Window.partitionBy(*GROUP).orderBy(F.col("reviews").desc(), "label")
    numbers = final.where(F.col("reviews") >= s.min_cluster_size).select(
        *GROUP, "label", (F.row_number().over(by_size) - 1).alias("topic_no")
    )
    numbered = salted_join(assigned, numbers, [*GROUP, "label"], ["review_key"]).select(
        *GROUP, "review_key", "topic_no"
    )
    return all_points.select(*GROUP, "review_key").join(numbered, [*GROUP, "review_key"], "left").withColumn(
        "topic_no", F.coalesce("topic_no", F.lit(-1))
    )


def unusable(rows: DataFrame) -> DataFrame:
    """subject (product and polarity) and message of every group with vectors that can't be clustered."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))
    return rows.where(F.col("polarity").isNotNull() & ~usable).groupBy(*GROUP).agg(F.count("*").alias("n")).select(
        F.concat_ws("|", *GROUP).alias("subject"), F.concat("n", F.lit(" vectors are null, zero or not finite")).alias("message"))


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy(*GROUP, "topic_no").agg(F.count("*").alias("review_count"))


def term_counts(texts: DataFrame, key: str, text: str = "text_clean") -> DataFrame:
    """`key`, `term` and its number `n` in all texts of the key.

    Terms are counted inside each row. They are grouped over rows only for keys on several
    rows, which are found from the keys alone.
    """
    def counted(rows: DataFrame) -> DataFrame:
        return rows.select(key, F.inline(ngram_counts(F.col(text))))

    sizes = texts.groupBy(key).agg(F.count("*").alias("n"))
    repeated = staged(sizes.where(F.col("n") > 1).select(F.col(key).alias("__key"), F.lit(True).alias("__repeated")))
    if repeated.isEmpty():
        return counted(texts)
    marked = texts.join(repeated, F.col(key).eqNullSafe(F.col("__key")), "left")
    several = counted(marked.where(F.col("__repeated"))).groupBy(key, "term").agg(F.sum("n").alias("n"))
    return counted(marked.where(F.col("__repeated").isNull())).unionByName(several)


def term_weights(texts: DataFrame, group: list[str], topic: str, text: str = "text_clean") -> DataFrame:
    """Class-based TF-IDF (Grootendorst 2022) of every term of every topic, -1 included.

    weight = tf(term, topic) / terms(topic) * ln(1 + A / tf(term)), with A the
    mean number of terms per topic, all within one group. Texts are counted
    down to terms before anything is shuffled, and the counts are staged, as
    all three totals come from them.
    """
    classes = [*group, topic]
    terms = texts.select(*classes, F.explode(ngrams(F.col(text))).alias("term"))
    counted = staged(terms.groupBy(*classes, "term").agg(F.count("*").alias("tf")))
    per_class = counted.groupBy(*classes).agg(F.sum("tf").alias("class_terms"))
    return _weighted(counted, _scale(per_class, group), group, classes)


def _scale(per_class: DataFrame, group: list[str]) -> DataFrame:
    """`class_terms` of every topic and `mean_terms` of its group, staged."""
    if group:
        means = per_class.groupBy(*group).agg(F.avg("class_terms").alias("mean_terms"))
        return staged(per_class.join(means, group))
    return staged(per_class.withColumn("mean_terms", per_class.agg(F.avg("class_terms")).scalar()))


def _weighted(counted: DataFrame, scale: DataFrame, group: list[str], classes: list[str]) -> DataFrame:
    # One topic may hold most terms, so its scale row is spread; staged, as the few rows of most
    # scales then need no shuffle of the terms. A term is not hot, as it occurs once per topic here.
    joined = salted_join(counted, scale, classes, ["term"])
    # Rows are sorted by the term first: its first bytes decide, those of a group are all alike.
    term_tf = F.sum("tf").over(Window.partitionBy("term", *group))
    weight = F.col("tf") / F.col("class_terms") * F.log(1 + F.col("mean_terms") / term_tf)
    return joined.select(*classes, "term", weight.alias("weight"))


def _often(words: DataFrame, scale: DataFrame, group: list[str], classes: list[str], top: int) -> DataFrame:
    """Words of a group that alone or in a pair may be among the `top` heaviest terms of a topic.

    A weight grows with tf and falls with the term's number in the group, which lies between tf
    and the sum of the topics' most frequent words. So the `top` most frequent words weigh at
    least `floor`, and what would not reach it were it in this topic alone is left out; a pair is
    not more frequent than its words. Topics of fewer words than `top` keep all.
    """
    levels = words.groupBy(*classes, "tf").agg(F.count("*").alias("n"))
    falling = Window.partitionBy(*classes).orderBy(F.col("tf").desc()).rowsBetween(Window.unboundedPreceding, -1)
    first = levels.withColumn("before", F.coalesce(F.sum("n").over(falling), F.lit(0))).where(F.col("before") < top)
    ends = first.groupBy(*classes).agg(
        F.min("tf").alias("least"), F.max("tf").alias("most"), F.sum("n").alias("found"))
    most = ends.groupBy(*group).agg(F.sum("most").alias("term_most"))
    ends = (ends.join(most, group) if group else ends.crossJoin(most)).join(scale, classes)

    def weight(tf: Column, term_tf: Column) -> Column:
        return tf / F.col("class_terms") * F.log(1 + F.col("mean_terms") / term_tf)

    floor = F.when(F.col("found") >= top, weight(F.col("least"), F.col("term_most"))).otherwise(F.lit(0.0))
    floors = staged(ends.select(*classes, "class_terms", "mean_terms", floor.alias("floor")))
    best = weight(F.col("tf"), F.col("tf")) * (1 + 1e-9) + 1e-11  # weights are ranked to 12 digits
    return staged(salted_join(words, floors, classes, ["term"]).where(best >= F.col("floor")).select(
        *group, "term").distinct())


def _class_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's distinct values, and a row that has them for each number."""
    code = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        coded = column.dictionary_encode(null_encoding="encode")
        _, code = np.unique(code * len(coded.dictionary) + _longs(coded.indices), return_inverse=True)
    _, first, code = np.unique(code, return_index=True, return_inverse=True)
    return code, first


def _pair_counts(rows: DataFrame, often: DataFrame | None, group: list[str], classes: list[str],
                 most: int = PIECE_TOKENS) -> DataFrame:
    """`classes`, `a`, `b` and `tf` of neighbouring `tokens`, counted within pieces of a batch of rows.

    Pairs are counted as numbers, and what moves on is each distinct one of a piece. Words are
    looked up in a filter of those that are `often`, if given, which lets a few others through.
    """
    shared, bits = None, 0
    if often is not None:
        words, bits = _filter(often, group, "term", _text_hashes)
        shared = rows.sparkSession.sparkContext.broadcast(words)

    def counted(part: pa.RecordBatch, lengths: np.ndarray) -> pa.RecordBatch | None:
        coded = part.column("tokens").flatten().dictionary_encode()
        word, row = _longs(coded.indices).astype(np.int64), np.repeat(np.arange(part.num_rows), lengths)
        pair = row[:-1] == row[1:]
        if shared is not None and len(word):
            held = _held(shared.value, _slots(_longs(part.column("home"))[row], _text_hashes(coded.dictionary)[word], bits))
            pair &= held[:-1] & held[1:]
        if not pair.any():
            return None
        number, first = _class_of(part.select(classes))
        size = len(coded.dictionary)
        codes, tf = np.unique((number[row[:-1][pair]] * size + word[:-1][pair]) * size + word[1:][pair], return_counts=True)
        at, a, b = codes // (size * size), codes // size % size, codes % size
        return pa.RecordBatch.from_arrays(
            [*part.select(classes).take(pa.array(first[at])).columns, coded.dictionary.take(pa.array(a)),
             coded.dictionary.take(pa.array(b)), pa.array(tf.astype(np.int64))], [*classes, "a", "b", "tf"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = _longs(batch.column("tokens").value_lengths().fill_null(0))
            ends, low = np.cumsum(lengths), 0
            while low < len(lengths):
                high = max(low + 1, int(np.searchsorted(ends, ends[low] - lengths[low] + most, "right")))
                found = counted(batch.slice(low, high - low), lengths[low:high])
                low = high
                if found is not None:
                    yield found

    schema = rows.select(*classes).schema.add("a", "string").add("b", "string").add("tf", "long")
    return rows.select(*classes, "tokens", _home(group)).mapInArrow(run, schema)


def _leading_terms(texts: DataFrame, group: list[str], topic: str, text: str, top: int) -> tuple[DataFrame, DataFrame]:
    """Counts of all terms that may be among the `top` of a topic, in every topic, and the scale of all terms.

    Words are counted first. Pairs of words, of which there are many more, are only counted if
    both words are frequent enough, unless that leaves out little.
    """
    classes = [*group, topic]
    rows = staged(texts.select(*classes, keyword_tokens(F.col(text)).alias("tokens")))
    terms = F.size("tokens") + F.greatest(F.size("tokens") - 1, F.lit(0))
    per_class = rows.groupBy(*classes).agg(F.sum(terms).alias("class_terms")).where(F.col("class_terms") > 0)
    scale = _scale(per_class, group)
    words = staged(rows.select(*classes, F.explode("tokens").alias("term")).groupBy(*classes, "term").agg(
        F.count("*").alias("tf")))
    often = _often(words, scale, group, classes, top)
    few = often.count() * 4 < words.count()
    pairs = _pair_counts(rows, often if few else None, group, classes)
    if few:
        words = words.join(often, [*group, "term"], "left_semi")
        for side in ("a", "b"):
            pairs = pairs.join(often.withColumnRenamed("term", side), [*group, side], "left_semi")
    counted = pairs.groupBy(*classes, "a", "b").agg(F.sum("tf").alias("tf")).select(
        *classes, F.concat_ws(" ", "a", "b").alias("term"), "tf")
    return words.unionByName(counted), scale


def topic_keywords(texts: DataFrame, group: list[str], topic: str, text: str = "text_clean",
                   top: int = 10) -> DataFrame:
    """The `top` heaviest terms of every topic in one text, by `term_weights`; ties in term order."""
    classes = [*group, topic]
    counted, scale = _leading_terms(texts, group, topic, text, top)
    weights = _weighted(counted, scale, group, classes)
    order = Window.partitionBy(*classes).orderBy(F.round("weight", 12).desc(), "term")
    best = weights.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    listed = F.sort_array(F.collect_list(F.struct("rank", "term")))
    return best.groupBy(*classes).agg(
        F.array_join(F.transform(listed, lambda x: x["term"]), ", ").alias("keywords")
    )


def topic_id() -> Column:
    return F.concat_ws("|", "product_id", "polarity", F.col("topic_no").cast("string"))


def topic_table(assigned: DataFrame, texts: DataFrame) -> DataFrame:
    """Topic rows: size and keywords; outliers and topics without terms are "other"."""
    classes = [*GROUP, "topic_no"]
    labelled = texts.select("review_key", "text_clean").join(assigned, "review_key")
    words = topic_keywords(labelled, GROUP, "topic_no")
    keywords = F.when(F.col("topic_no") == -1, OTHER).otherwise(F.coalesce("keywords", F.lit(OTHER)))
    return topic_sizes(assigned).join(words, classes, "left").select(
        topic_id().alias("topic_id"), *GROUP, "topic_no", keywords.alias("keywords"), "review_count"
    )
