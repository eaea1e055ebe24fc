"""Hard negatives of anchor vectors by angular triangle filtering.

1. Usable vectors become integer vectors. Their norms and their angles to a few reference
   directions (farthest-first among a bounded sample) are stored, and the rows are laid out
   by (length, label, nearest reference, angle to it), in as many ranges as there are tasks.
2. Anchors are broadcast in rounds of at most about `ROUND_BYTES`, whatever their number.
   Every task streams its rows once per round, so nothing else is shuffled.
3. For a segment of neighbouring rows, the triangle inequality of angles gives an interval of
   cosines with each anchor; times the norms, and widened by more than the rounding error, it
   bounds the scores. Only anchors whose wanted scores overlap it go on, and of the segment
   only the rows in the window of angles that can reach the score still wanted. These
   get exact integer scores. As better rows are found, the score still wanted rises.
4. The first search finds each anchor's positives, the second, given their scores, the
   negatives of every (anchor, positive). Each task returns its best rows only.

Rows with a null label, a null vector, or any null or non-finite component take no part; zero
vectors do, with score 0. Vectors of other lengths than the anchor's have no score with it.
A repeated row is a row of its own, ties go to the smaller vec_id, null ids last, and a null
id is never an anchor. Scores beyond 64 bits are an error. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.session import staged

ANCHORS = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
SCALE = 256
REFERENCES = 12
SAMPLE = 256
SEGMENT = 256
ROUND_BYTES = 16_000_000
_ANGLE_SLACK = 1e-6
_SCORE_SLACK = 1e-9
_EXACT = float(1 << 53)
_NO_ID = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """node, vec_id, label and `v`, the integer vector, of the rows that take part."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = lambda x: F.when(
        F.abs(x.cast("double")) < 2.0**54, F.floor(x.cast("double") * scale)).otherwise(
            F.raise_error(F.lit("vector component beyond 64 bits")).cast("long"))
    used = vectors.where(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    # Written once, so that the numbers stay what they are when a task is repeated.
    return staged(used.select(
        F.monotonically_increasing_id().alias("node"), F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("long").alias("label"), F.transform(e, whole).alias("v")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), len(flat) // len(column))


def _norms(v: np.ndarray) -> np.ndarray:
    wide = v.astype(np.float64)
    return np.sqrt((wide * wide).sum(1))


def _angles(v: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    """Angle of each row to each reference direction; a right angle for zero rows."""
    cosine = (v.astype(np.float64) / np.where(norm > 0, norm, 1)[:, None]) @ references.T
    return np.arccos(np.clip(cosine, -1, 1))


def reference_directions(rows: DataFrame, number: int = REFERENCES, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Unit directions per vector length, each as far as possible from those before, of a sample by hash."""
    held: dict[int, list] = {}
    for r in rows.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("node"), "node").limit(sample).collect():
        held.setdefault(len(r["v"]), []).append(r["v"])
    out = {}
    for dim, members in held.items():
        unit = np.array(members, np.float64)
        unit /= _norms(unit)[:, None]
        taken = [0]
        while len(taken) < min(number, len(unit)):
            taken.append(int((unit @ unit[taken].T).max(1).argmin()))
        out[dim] = unit[taken]
    return out


def stored_angles(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """`rows` with dim, norm, angles, cell (the nearest reference, -1 without one) and own (the angle to it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.take(pa.array(np.flatnonzero(dims == dim)))
                v = _matrix(part.column("v")) if dim else np.zeros((part.num_rows, 0), np.int64)
                norm, refs = _norms(v), references.get(dim, np.zeros((0, dim)))
                angles = _angles(v, norm, refs)
                cell = np.full(len(v), -1) if not len(refs) else np.where(norm > 0, angles.argmin(1), -1)
                own = np.zeros(len(v)) if not len(refs) else angles[np.arange(len(v)), np.maximum(cell, 0)]
                ends = np.arange(len(v) + 1, dtype=np.int32) * len(refs)
                yield pa.RecordBatch.from_arrays([
                    *part.columns, pa.array(np.full(len(v), dim), pa.int32()), pa.array(norm),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(angles.ravel())),
                    pa.array(cell, pa.int32()), pa.array(own)],
                    [*part.schema.names, "dim", "norm", "angles", "cell", "own"])

    made = rows.mapInArrow(run, (
        "node bigint, vec_id bigint, label bigint, v array<bigint>, dim int, norm double, angles array<double>, "
        "cell int, own double"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["dim", "label", "cell", "own", "node"]  # ends in the row itself, so equal vectors are split too
    return staged(made.repartitionByRange(parts, *keys).sortWithinPartitions(*keys))


class Anchors:
    """The anchors of one round and one vector length."""

    def __init__(self, table: pa.Table):
        self.node, self.label = (table.column(c).to_numpy() for c in ("node", "label"))
        self.vec_id = table.column("vec_id").to_numpy()
        self.norm = table.column("norm").to_numpy()
        self.v, self.angles = (_matrix(table.column(c).combine_chunks()) for c in ("v", "angles"))


class Search:
    """The best `k` rows of each target among streamed rows.

    A target is an anchor with a lowest and a highest score; rows have the anchor's label
    (`same`, the anchor itself left out) or another.
    """

    def __init__(self, anchors: Anchors, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchors, self.k, self.same = anchors, k, same
        order = np.argsort(anchor, kind="stable")
        self.number, self.anchor, self.high = order, anchor[order], high[order]
        self.need = low[order].copy()
        self.most = max(500, 4 * k * len(anchor))
        self.first = np.searchsorted(self.anchor, np.arange(len(anchors.node) + 1))
        self.held, self.size = [], 0
        self.scored = 0

    def _wanted(self) -> tuple[np.ndarray, np.ndarray]:
        """Per anchor the least and the highest score that any of its targets still wants."""
        low = np.full(len(self.anchors.node), np.inf)
        high = np.full(len(self.anchors.node), -np.inf)
        np.minimum.at(low, self.anchor, self.need)
        np.maximum.at(high, self.anchor, self.high)
        return low, high

    def rows(self, table: pa.RecordBatch) -> None:
        """Takes in rows of one vector length, laid out as `stored_angles` does."""
        label, cell = table.column("label").to_numpy(), table.column("cell").to_numpy()
        own, norm = table.column("own").to_numpy(), table.column("norm").to_numpy()
        v, angles = _matrix(table.column("v")), _matrix(table.column("angles"))
        node = table.column("node").to_numpy()
        ids = table.column("vec_id").fill_null(_NO_ID).to_numpy()
        new = (np.diff(label) != 0) | (np.diff(cell) != 0) | (np.diff(own) < 0)
        cuts = [0, *(np.flatnonzero(new) + 1).tolist(), len(label)]
        for begin, end in zip(cuts, cuts[1:]):
            for low in range(begin, end, SEGMENT):
                part = slice(low, min(end, low + SEGMENT))
                self._segment(label[low], cell[low], own[part], norm[part], angles[part], v[part], node[part], ids[part])

    def _segment(self, label, cell, own, norm, angles, v, node, ids) -> None:
        a = self.anchors
        low, high = self._wanted()
        wanted = ((a.label == label) if self.same else (a.label != label)) & (low <= high)
        at = np.flatnonzero(wanted)
        # Bounds of the angle between an anchor and any row of the segment.
        least, most = np.zeros(len(at)), np.full(len(at), np.pi)
        if cell >= 0 and angles.shape[1]:
            theta, near, far = a.angles[at], angles.min(0), angles.max(0)
            least = np.maximum(np.maximum(theta - far, near - theta).max(1) - _ANGLE_SLACK, 0)
            most = np.minimum(np.minimum(theta + far, 2 * np.pi - theta - near).min(1) + _ANGLE_SLACK, np.pi)
        small, large = a.norm[at] * norm.min(), a.norm[at] * norm.max()
        top, bottom = np.cos(least), np.cos(most)
        slack = _SCORE_SLACK * large + 1e-6
        above = np.where(top >= 0, large, small) * top + slack
        below = np.where(bottom >= 0, small, large) * bottom - slack
        overlap = (above >= low[at]) & (below <= high[at])
        at, large = at[overlap], large[overlap]
        # Of the segment, only angles to its reference from which the least wanted score can be reached.
        start, stop = np.zeros(len(at), np.int64), np.full(len(at), len(own))
        if cell >= 0 and len(at):
            cosine = np.divide(low[at], large, out=np.ones(len(at)), where=large > 0)
            reach = np.where(low[at] > 0, np.arccos(np.clip(cosine, -1, 1)), np.pi)
            start = np.searchsorted(own, a.angles[at, cell] - reach - _ANGLE_SLACK, "left")
            stop = np.searchsorted(own, a.angles[at, cell] + reach + _ANGLE_SLACK, "right")
            at, start, stop = at[start < stop], start[start < stop], stop[start < stop]
        for i in range(0, len(at), 2048):
            self._score(at[i:i + 2048], start[i:i + 2048], stop[i:i + 2048], v, node, ids)

    def _score(self, at, start, stop, v, node, ids) -> None:
        begin, end = int(start.min()), int(stop.max())
        v, node, ids = v[begin:end], node[begin:end], ids[begin:end]
        exact = exact_scores(self.anchors.v[at], v)
        place = np.arange(begin, end)
        inside = (place >= start[:, None]) & (place < stop[:, None])
        if self.same:
            inside &= self.anchors.node[at][:, None] != node
        self.scored += int(inside.sum())
        sizes = self.first[at + 1] - self.first[at]
        ends = np.cumsum(sizes)
        target = np.arange(ends[-1]) - np.repeat(ends - sizes - self.first[at], sizes)
        of = np.repeat(np.arange(len(at)), sizes)
        for i in range(0, len(target), 4096):
            t, o = target[i:i + 4096], of[i:i + 4096]
            good = inside[o] & (exact[o] >= self.need[t][:, None]) & (exact[o] <= self.high[t][:, None])
            row, col = np.nonzero(good)
            self.held.append((t[row], exact[o[row], col], ids[col]))
            self.size += len(row)
        if self.size > self.most:
            self._best()

    def _best(self) -> None:
        """Keeps the best rows of each target, and raises the score it wants to its last one's."""
        target, score, ids = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((ids, -score, target))
        target, score, ids = target[order], score[order], ids[order]
        first = np.searchsorted(target, target, "left")
        keep = np.arange(len(target)) - first < self.k
        last = np.flatnonzero(np.arange(len(target)) - first == self.k - 1)
        self.need[target[last]] = score[last]
        self.held, self.size = [(target[keep], score[keep], ids[keep])], int(keep.sum())
        self.most = max(self.most, 2 * self.size)

    def result(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Target number, score and vec_id of the best rows."""
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.int64())
        self._best()
        target, score, ids = self.held[0]
        return self.number[target], score, pa.array(ids, mask=ids == _NO_ID)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of `a` with all rows of `b`."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    # Floating sums of integers are exact below 2^53.
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    if max(abs(int(wide.max())), abs(int(wide.min()))) >= 1 << 56:
        raise OverflowError("scores beyond 64 bits")
    return wide.astype(np.int64)


def _searched(rows: DataFrame, broadcast, k: int, same: bool) -> DataFrame:
    """target, score and vec_id: the best rows of each task for each target.

    The broadcast has per vector length the anchors as a table, and the targets as arrays:
    number, anchor, low and high.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches, numbers = {}, {}
        for dim, (table, number, anchor, low, high) in broadcast.value.items():
            searches[dim], numbers[dim] = Search(Anchors(table), anchor, low, high, k, same), number
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                if dim in searches:
                    searches[dim].rows(batch.filter(pa.array(dims == dim)))
        for dim, search in searches.items():
            target, score, ids = search.result()
            for low in range(0, len(target), 50_000):
                part = slice(low, low + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[dim][target[part]]), pa.array(score[part]), ids[part]], ["target", "score", "vec_id"])

    columns = ["node", "vec_id", "label", "v", "dim", "norm", "angles", "cell", "own"]
    found = rows.select(*columns).mapInArrow(run, "target bigint, score bigint, vec_id bigint")
    turn = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return found.withColumn("rank", turn).where(F.col("rank") <= k)


def _round(rows: DataFrame, chosen: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of the anchors `chosen`, which the driver holds."""
    context = rows.sparkSession.sparkContext
    table = chosen.select("node", "vec_id", "label", "v", "dim", "norm", "angles").toArrow()
    dims, ids = table.column("dim").to_numpy(), table.column("vec_id").to_numpy()
    no_limit = np.iinfo(np.int64).max
    of = {int(d): np.flatnonzero(dims == d) for d in np.unique(dims)}
    tables = {d: table.take(pa.array(at)) for d, at in of.items()}
    asked = {d: (tables[d], at, np.arange(len(at)), np.full(len(at), -no_limit), np.full(len(at), no_limit))
             for d, at in of.items()}
    best = _searched(rows, context.broadcast(asked), positives, True).orderBy("target", "rank").toArrow()
    anchor, score = best.column("target").to_numpy(), best.column("score").to_numpy()
    asked, target = {}, np.arange(len(anchor))
    for d, at in of.items():
        own = target[dims[anchor] == d]
        asked[d] = (tables[d], own, np.searchsorted(at, anchor[own]),
                    -(-low * score[own] // 100), high * score[own] // 100)
    found = _searched(rows, context.broadcast(asked), negatives, False)
    named = rows.sparkSession.createDataFrame(pa.table({
        "target": target, "anchor_id": ids[anchor], "positive_id": best.column("vec_id"), "positive_score": score}))
    return staged(found.join(named, "target").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score")))


def hard_negatives(vectors: DataFrame, every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES,
                   low: int = LOW, high: int = HIGH, references: int = REFERENCES,
                   round_bytes: int = ROUND_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`; each has up to `positives` rows
    of its label, and each of these up to `negatives` rows of other labels that score between
    `low` and `high` percent of it.
    """
    rows = integer_vectors(vectors)
    stored = stored_angles(rows, reference_directions(rows, references))
    anchors = stored.where(F.col("vec_id") % every == 0)
    size = anchors.agg(F.sum(F.lit(8) * (F.size("v") + references + 4))).first()[0] or 0
    rounds = -(-size // round_bytes)
    out = None
    for i in range(rounds):
        made = _round(stored, anchors.where(F.pmod(F.xxhash64("node"), F.lit(rounds)) == i), positives, negatives, low, high)
        out = made if out is None else out.unionByName(made)
    if out is None:
        return vectors.sparkSession.createDataFrame([], (
            "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"))
    return out


ORACLE = """
WITH used AS (
    SELECT row_number() OVER () AS node, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchors AS (SELECT * FROM used WHERE vec_id % 100 = 0),
positives AS (
    SELECT a.node, a.vec_id AS anchor_id, a.label, a.v, r.vec_id AS positive_id,
           CAST(list_inner_product(a.v, r.v) AS BIGINT) AS positive_score,
           row_number() OVER (PARTITION BY a.node ORDER BY list_inner_product(a.v, r.v) DESC, r.vec_id NULLS LAST) AS turn
    FROM anchors a JOIN used r ON a.label = r.label AND a.node <> r.node AND len(a.v) = len(r.v)
    QUALIFY turn <= 5),
negatives AS (
    SELECT a.node, r.vec_id AS negative_id, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS negative_score
    FROM anchors a JOIN used r ON a.label <> r.label AND len(a.v) = len(r.v))
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY node, turn ORDER BY negative_score DESC, negative_id NULLS LAST) AS INTEGER) AS rank,
       negative_id, positive_score, negative_score
FROM positives JOIN negatives USING (node)
WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score
QUALIFY rank <= 10"""
