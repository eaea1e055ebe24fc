"""Embedding near-duplicates over a robust-pruned flat graph.

1. Equal vectors are grouped; the rest works on distinct ones with their numbers.
2. Each vector joins the shards of its `OVERLAP` nearest centres (a bounded sample of the
   vectors, thinned where it is dense, so that a large group of near copies shares a shard);
   a shard of more than `BLOCK` members is dealt to several blocks by hash.
3. In each block every vector gets out-edges by robust pruning of its nearest candidates,
   reverse edges, and edges that make all of the block reachable from its medoids, which
   are stored with it.
4. A vector's adjacency lists of all its blocks are united.
5. Every vector is searched in all blocks of its nearest shard, its home: greedy steps from
   the medoids, then the search range expands over everything within the threshold.
6. A pair that both of its vectors' searches can meet is decided by the vector with the
   smaller number, any other pair by the only search that can meet it. So each pair is
   decided once and counts for both ends, and no list of pairs is needed.
7. Cosines are verified in double precision, links become components, and a sample of
   vectors is audited by brute force. Below `LEAST_RECALL` the search is repeated with more
   shards per vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.components import connected_components
from reviewmill.session import staged

COSINE = 0.9
PER_CENTRE = 400
MOST_CENTRES = 4096
OVERLAP = 5
BLOCK = 2048
QUERIES = 1024
SLICES = 16
CANDIDATES = 40
DEGREE = 16
ALPHA = 1.2
MEDOIDS = 8
STEPS = 24
SLACK = 0.1
AUDITED = 256
LEAST_RECALL = 0.9
WIDER = (1, 4, 16)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows in double precision from a list column of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _medoids(near: np.ndarray, number: int) -> np.ndarray:
    """Positions of the most central row, then of rows farthest from those taken."""
    taken = [int(near.sum(1).argmax())]
    closest = near[taken[0]].copy()
    while len(taken) < min(number, len(near)):
        taken.append(int(closest.argmin()))
        closest = np.maximum(closest, near[taken[-1]])
    return np.array(taken)


def pruned_edges(vectors: np.ndarray, candidates: int = CANDIDATES, degree: int = DEGREE,
                 alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of the pruned graph of one block, both ways, and its medoids, from which all is reachable."""
    n = len(vectors)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(n)
    near = vectors @ vectors.T
    np.fill_diagonal(near, -2)
    width = min(candidates, n - 1)
    found = np.argpartition(-near, width - 1, axis=1)[:, :width]
    # A few strided strangers give long edges out of a tight group.
    strangers = (np.arange(n)[:, None] + np.linspace(1, n - 1, min(8, n - 1)).astype(np.int64)) % n
    found = np.concatenate([found, strangers], axis=1)
    order = np.argsort(-np.take_along_axis(near, found, 1), axis=1, kind="stable")
    found = np.take_along_axis(found, order, 1)
    own = 2 - 2 * np.take_along_axis(near, found, 1)
    alive, rows = np.ones(found.shape, bool), np.arange(n)
    sources, targets = [], []
    for _ in range(degree):
        left = alive.any(1)
        if not left.any():
            break
        r = rows[left]
        pick = found[r, alive[r].argmax(1)]
        sources.append(r)
        targets.append(pick)
        apart = 2 - 2 * near[pick[:, None], found[r]]
        alive[r] &= (alpha * alpha * apart > own[r]) & (found[r] != pick[:, None])
    source, target = np.concatenate(sources), np.concatenate(targets)
    code = np.unique(np.concatenate([source * n + target, target * n + source]))
    source, target = code // n, code % n
    seen, medoids = np.zeros(n, bool), _medoids(near, MEDOIDS)
    seen[medoids] = True
    while True:
        grown = seen.copy()
        grown[target[seen[source]]] = True
        if (grown == seen).all():
            break
        seen = grown
    lost = np.flatnonzero(~seen)
    if len(lost):
        reached = np.flatnonzero(seen)
        nearest = reached[near[lost][:, reached].argmax(1)]
        source, target = np.append(source, nearest), np.append(target, lost)
    return source, target, medoids


def range_search(vectors: np.ndarray, edges: tuple[np.ndarray, np.ndarray], starts: np.ndarray,
                 queries: np.ndarray, cosine: float, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Query and vector numbers of all pairs within the threshold that the search from `starts` meets."""
    n, q = len(vectors), len(queries)
    order = np.argsort(edges[0], kind="stable")
    targets = edges[1][order]
    bounds = np.searchsorted(edges[0][order], np.arange(n + 1))
    known = np.full((q, n), -2.0)
    open_ = np.zeros((q, n), bool)

    def visit(row: np.ndarray, at: np.ndarray) -> None:
        fresh = known[row, at] == -2.0
        code = np.unique(row[fresh] * n + at[fresh])
        row, at = code // n, code % n
        for low in range(0, len(row), 100_000):
            r, a = row[low:low + 100_000], at[low:low + 100_000]
            known[r, a] = (queries[r] * vectors[a]).sum(1)
        open_[row, at] = True

    def expand(row: np.ndarray, at: np.ndarray) -> None:
        open_[row, at] = False
        for low in range(0, len(row), 20_000):
            r, a = row[low:low + 20_000], at[low:low + 20_000]
            sizes = bounds[a + 1] - bounds[a]
            ends = np.cumsum(sizes)
            visit(np.repeat(r, sizes),
                  targets[np.arange(ends[-1]) - np.repeat(ends - sizes - bounds[a], sizes)])

    visit(np.repeat(np.arange(q), len(starts)), np.tile(starts, q))
    for _ in range(steps):
        best = np.where(open_, known, -3.0).argmax(1)
        live = np.flatnonzero(open_[np.arange(q), best])
        if not len(live):
            break
        expand(live, best[live])
    while True:
        row, at = np.nonzero(open_ & (known >= cosine - SLACK))
        if not len(row):
            break
        if len(row) > q * n // 32:
            return _wide_walk(vectors, edges, queries, cosine, known != -2.0, open_ & (known >= cosine - SLACK))
        expand(row, at)
    return np.nonzero(known >= cosine)


def _wide_walk(vectors: np.ndarray, edges: tuple[np.ndarray, np.ndarray], queries: np.ndarray, cosine: float,
               seen: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rest of the same walk where much is open: whole rows of the block take each step at once."""
    order = np.argsort(edges[1], kind="stable")
    source, target = edges[0][order], edges[1][order]
    reached = np.unique(target)
    begin = np.searchsorted(target, reached)
    rows, ats = [], []
    for low in range(0, len(queries), 256):
        near = queries[low:low + 256] @ vectors.T
        done, front = seen[low:low + 256].copy(), open_[low:low + 256]
        while front.any():
            fresh = np.zeros_like(done)
            fresh[:, reached] = np.logical_or.reduceat(front[:, source], begin, axis=1)
            fresh &= ~done
            done |= fresh
            front = fresh & (near >= cosine - SLACK)
        row, at = np.nonzero(done & (near >= cosine))
        rows.append(row + low)
        ats.append(at)
    return np.concatenate(rows), np.concatenate(ats)


def thinned(centres: np.ndarray, cosine: float, overlap: int) -> np.ndarray:
    """Centres without those that would part a group too large for `overlap` shards.

    A vector meets all partners while their centres are among its `overlap` nearest. Where a
    centre has that many others within the threshold, it takes the place of all about it, the
    densest first; the blocks and chunks of its shard then bear the size of the group.
    """
    near = centres @ centres.T
    degree = (near >= cosine).sum(1) - 1
    alive = np.ones(len(centres), bool)
    for i in np.argsort(-degree, kind="stable"):
        if degree[i] < overlap:
            break
        if alive[i]:
            alive[near[i] >= cosine - SLACK] = False
            alive[i] = True
    return centres[alive]


def _centres(distinct: DataFrame, per_centre: int, cosine: float, overlap: int) -> dict[int, np.ndarray]:
    """Unit centres per vector length: a thinned sample by hash of at most `MOST_CENTRES` in all."""
    sizes = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    total, out = sum(sizes.values()), {}
    for dim, n in sizes.items():
        k = max(1, min(-(-n // per_centre), MOST_CENTRES * n // total))
        rows = distinct.where(F.col("dim") == dim).orderBy(F.xxhash64("node"), "node").limit(k)
        values = np.array([r["embedding"] for r in rows.select("embedding").collect()], np.float64)
        values /= np.abs(values).max(1, keepdims=True)
        out[dim] = thinned(values / np.sqrt((values * values).sum(1, keepdims=True)), cosine, overlap)
    return out


def _usable(e: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(e, lambda x: x != 0), F.lit(False))


def distinct_vectors(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with a flag `valid`, and the distinct valid vectors as (node, embedding, dim, n, first_id)."""
    valid = _usable(F.col("embedding"))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), valid.alias("valid"))
    distinct = rows.where("valid").groupBy("embedding").agg(
        F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
    # Written once, so that the numbers stay what they are when a task is repeated.
    return rows, staged(distinct.select(
        F.monotonically_increasing_id().alias("node"), "embedding", F.size("embedding").alias("dim"), "n", "first_id"))


def members(distinct: DataFrame, per_centre: int = PER_CENTRE, overlap: int = OVERLAP,
            cosine: float = COSINE) -> DataFrame:
    """node, embedding, n, shard, `home` (whether it is the nearest) and all `shards` of the vector, nearest
    first; one row per shard of a vector."""
    centres = _centres(distinct, per_centre, cosine, overlap)
    base = dict(zip(centres, np.cumsum([0, *(len(c) for c in centres.values())])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                mine = np.flatnonzero(dims == dim)
                part = pa.record_batch(batch).take(pa.array(mine))
                near = _matrix(part.column("embedding")) @ centres[int(dim)].T
                width = min(overlap, near.shape[1])
                order = np.argsort(-near, axis=1, kind="stable")[:, :width]
                again = np.repeat(np.arange(len(mine)), width)
                wide = part.select(["node", "embedding", "n"]).take(pa.array(again))
                shards = (order + base[int(dim)]).astype(np.int64)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(len(again) + 1, dtype=np.int32) * width), pa.array(shards[again].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [*wide.columns, pa.array(shards.ravel()), pa.array(np.tile(np.arange(width) == 0, len(mine))), lists],
                    ["node", "embedding", "n", "shard", "home", "shards"])

    return distinct.mapInArrow(
        run, "node bigint, embedding array<double>, n bigint, shard bigint, home boolean, shards array<bigint>")


def found_links(ids: np.ndarray, counts: np.ndarray, homes: np.ndarray, mine: np.ndarray, own_counts: np.ndarray,
                shards: np.ndarray, row: np.ndarray, at: np.ndarray) -> pa.Table:
    """Rows linked with each vector by the pairs decided here, and edges that span what the pairs (row, at) connect.

    `homes` are the vectors' home shards, `shards` all shards of the queries `mine`.
    """
    other = ids[at] != mine[row]
    row, at = row[other], at[other]
    decided = np.zeros(len(row), bool)
    for low in range(0, len(row), 1_000_000):
        r, a = row[low:low + 1_000_000], at[low:low + 1_000_000]
        met_there = (shards[r] == homes[a][:, None]).any(1)
        decided[low:low + 1_000_000] = ~met_there | (mine[r] < ids[a])
    linked = np.bincount(row[decided], counts[at[decided]], len(mine)).astype(np.int64)
    back = np.bincount(at[decided], own_counts[row[decided]], len(ids)).astype(np.int64)
    # The least node that each can reach inside this tile, and so one edge per node.
    every, code = np.unique(np.concatenate([mine[row], ids[at]]), return_inverse=True)
    a, b = code[:len(row)], code[len(row):]
    label = np.arange(len(every))
    while len(row):
        low = np.minimum(label[a], label[b])
        next_ = label.copy()
        np.minimum.at(next_, a, low)
        np.minimum.at(next_, b, low)
        next_ = next_[next_]
        if (next_ == label).all():
            break
        label = next_
    return pa.table({
        "a": pa.array(np.concatenate([mine, ids, every])), "b": pa.array(np.concatenate([mine, ids, every[label]])),
        "linked": pa.array(np.concatenate([linked, back, np.zeros(len(every), np.int64)]))})


def links(distinct: DataFrame, cosine: float = COSINE, per_centre: int = PER_CENTRE, overlap: int = OVERLAP,
          block: int = BLOCK, queries: int = QUERIES) -> tuple[DataFrame, DataFrame]:
    """Per node `linked` (rows of other vectors within the threshold), and edges that span the components."""
    member = staged(members(distinct, per_centre, overlap, cosine))
    # At most MOST_CENTRES shards, so this table is small whatever the data.
    sizes = member.groupBy("shard").agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.col("home").cast("int")) / (queries * SLICES))).cast("int").alias("chunks"))
    dealt = staged(member.join(sizes, "shard").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        node = table.column("node").to_numpy()
        source, target, medoids = pruned_edges(_matrix(table.column("embedding").combine_chunks()))
        order = np.argsort(source, kind="stable")
        ends = np.searchsorted(source[order], np.arange(len(node) + 1))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(node[target[order]]))
        first = np.zeros(len(node), bool)
        first[medoids] = True
        return pa.table({
            "node": pa.array(node), "near": lists,
            "medoid_of": pc.if_else(pa.array(first), table.column("shard").combine_chunks(), pa.scalar(None, pa.int64()))})

    # A vector is in one block of a shard, so the shard names the block it is a medoid of.
    graph = (
        dealt.groupBy("shard", "block").applyInArrow(build, "node bigint, near array<bigint>, medoid_of bigint")
        .groupBy("node").agg(
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"), F.collect_list("medoid_of").alias("medoid_of"))
    )
    domain = dealt.join(graph, "node").select(
        "shard", "block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        "node", "embedding", "n", "shards", F.array_contains("medoid_of", F.col("shard")).alias("medoid"), "near")
    asked = dealt.where("home").select(
        "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"),
        "node", "embedding", "n", "shards", F.lit(False).alias("medoid"), F.lit(None).cast("array<bigint>").alias("near"))

    def search(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        query = table.column("near").is_null().to_numpy()
        if query.all() or not query.any():
            return pa.table({name: pa.array([], pa.int64()) for name in ("a", "b", "linked")})
        node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
        unit = _matrix(table.column("embedding").combine_chunks())
        order = np.argsort(node[~query])
        ids, counts, vectors = node[~query][order], n[~query][order], unit[~query][order]
        lists = table.column("near").combine_chunks().filter(pa.array(~query)).take(pa.array(order))
        source = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
        flat = lists.flatten().to_numpy()
        target = np.minimum(np.searchsorted(ids, flat), len(ids) - 1)
        inside = ids[target] == flat
        edges, mine, asked_for, own_counts = (source[inside], target[inside]), node[query], unit[query], n[query]
        shards = table.column("shards").combine_chunks()
        shards = shards.flatten().to_numpy().reshape(len(node), -1)
        homes, shards = shards[~query][order, 0], shards[query]
        starts = np.flatnonzero(table.column("medoid").combine_chunks().to_numpy(zero_copy_only=False)[~query][order])
        return pa.concat_tables([
            found_links(ids, counts, homes, mine[part], own_counts[part], shards[part],
                        *range_search(vectors, edges, starts, asked_for[part], cosine))
            for part in (slice(low, low + queries) for low in range(0, len(mine), queries))])

    found = staged(domain.unionByName(asked).groupBy("shard", "block", "chunk").applyInArrow(
        search, "a bigint, b bigint, linked bigint"))
    return (found.groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked")),
            found.where("a <> b").select("a", "b").distinct())


def groups(vectors: DataFrame, cosine: float = COSINE, overlap: int = OVERLAP) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding).

    Vectors that are null, zero, or hold null or non-finite components link with nothing and
    stand for themselves; vectors of different lengths don't link. Equal vectors link with
    one another. Repeated rows are vectors of their own. An empty table gives no rows.
    """
    rows, distinct = distinct_vectors(vectors)
    linked, edges = links(distinct, cosine, overlap=overlap)
    labels = connected_components(edges, [])
    named = staged(
        distinct.select("node", "embedding", "n", "first_id").join(linked, "node", "left")
        .join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        .withColumn("n_links", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).cast("long")))
    roots = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = named.join(roots, "label").select("embedding", "n_links", "component_id", F.lit(True).alias("valid"))
    return rows.join(known, ["embedding", "valid"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def audit(vectors: DataFrame, cosine: float = COSINE, sample: int = AUDITED) -> DataFrame:
    """vec_id and `true_links` of a sample of at most `sample` vectors, compared with every row.

    Ids that occur more than once are not sampled, as their rows may differ.
    """
    e = F.col("embedding")
    rows = vectors.where(_usable(e)).select("vec_id", e.cast("array<double>").alias("embedding"))
    once = vectors.groupBy("vec_id").agg(F.count("*").alias("n")).where("n = 1 AND vec_id IS NOT NULL")
    chosen = once.join(rows.select("vec_id"), "vec_id", "left_semi").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    asked = rows.join(F.broadcast(chosen.select("vec_id")), "vec_id").collect()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("embedding").value_lengths().to_numpy()
            hits = []
            for dim in np.unique(sizes):
                mine = [r for r in asked if len(r["embedding"]) == dim]
                if mine:
                    own = _matrix(batch.column("embedding").filter(pa.array(sizes == dim)))
                    query = _matrix(pa.array([r["embedding"] for r in mine], pa.list_(pa.float64())))
                    hits += list(zip((r["vec_id"] for r in mine), (query @ own.T >= cosine).sum(1).tolist()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], ["vec_id", "hits"])

    return rows.mapInArrow(run, "vec_id bigint, hits bigint").groupBy("vec_id").agg(
        (F.sum("hits") - 1).alias("true_links"))


def audited_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """`groups`, with `true_links` by brute force for the audited sample and null elsewhere.

    Where the sample has less than `LEAST_RECALL` of its true links, the search is widened; it
    is an error if the widest one still has less.
    """
    audited = staged(audit(vectors, cosine))
    for times in WIDER:
        made = staged(groups(vectors, cosine, OVERLAP * times).join(audited, "vec_id", "left"))
        found, true = made.where("true_links IS NOT NULL").agg(F.sum("n_links"), F.sum("true_links")).first()
        if not true or found >= LEAST_RECALL * true:
            return made
    raise RuntimeError(f"the audited vectors have {true} links, of which only {found} were found")
