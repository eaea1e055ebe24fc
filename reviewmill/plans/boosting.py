"""Gradient-boosted symmetric trees on binned, grouped rows.

Features are cut into bins, and Spark reduces the rows to one per distinct vector of bins, a
cell, with the number of its rows and the sum of their labels. For squared loss that is all
a fit on the same bins needs, so every row counts and nothing is sampled. There are at most
as many cells as the bins allow (`cells_bound`), whatever the number of rows; the fit is one
small task over them. A tree asks the same question of all leaves of a level; leaf values
are shrunk means of the residuals.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: shrinkage of leaf values in the original booster.
L2 = 3.0
TREES = "tree int, features array<int>, thresholds array<int>, gains array<double>, leaves array<double>, base double, val_squared double"


@dataclass
class Bins:
    """Ascending upper bounds per feature; a value is in the bin of the number of bounds below it."""

    bounds: dict[str, list[float]]

    @classmethod
    def of(cls, rows: DataFrame, most: dict[str, int]) -> Bins:
        """Quantiles of all rows, at most `most[feature]` bins of about as many rows."""
        shares = {c: [i / n for i in range(1, n)] for c, n in most.items()}
        found = rows.agg(
            *[F.percentile_approx(c, s).alias(c) for c, s in shares.items()], *[F.max(c).alias(f"top_{c}") for c in most]).first()
        return cls({c: sorted({float(b) for b in found[c] or [] if b < found[f"top_{c}"]}) for c in most})

    @property
    def sizes(self) -> list[int]:
        return [len(b) + 1 for b in self.bounds.values()]

    def cell(self) -> Column:
        """All of a row's bins as one number."""
        out = F.lit(0).cast("long")
        for name, bounds in self.bounds.items():
            place = sum(((F.col(name) > F.lit(b)).cast("int") for b in bounds), F.lit(0))
            out = out * F.lit(len(bounds) + 1) + place
        return out

    def digits(self, cells: np.ndarray) -> np.ndarray:
        """The bins of cells, one row per feature."""
        return np.stack(np.unravel_index(cells, self.sizes)).astype(np.int32)


def cells_bound(bins: Bins) -> int:
    return int(np.prod(bins.sizes))


def grouped(rows: DataFrame, bins: Bins, label: str) -> DataFrame:
    """cell, n, total and squares of the labels, one row per cell."""
    value = F.col(label).cast("double")
    return rows.groupBy(bins.cell().alias("cell")).agg(
        F.count("*").alias("n"), F.sum(value).alias("total"), F.sum(value * value).alias("squares"))


@dataclass
class Trees:
    """Features, thresholds and gains per level of each tree, its leaf values, and the start value."""

    features: np.ndarray
    thresholds: np.ndarray
    gains: np.ndarray
    leaves: np.ndarray
    base: float

    def first(self, rounds: int) -> Trees:
        return Trees(self.features[:rounds], self.thresholds[:rounds], self.gains[:rounds], self.leaves[:rounds], self.base)

    def predict(self, digits: np.ndarray) -> np.ndarray:
        out = np.full(digits.shape[1], self.base)
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            leaf = np.zeros(digits.shape[1], np.int64)
            for f, t in zip(features, thresholds):
                leaf = 2 * leaf + (digits[f] > t)
            out += leaves[leaf]
        return out

    def of_all(self, bins: Bins) -> np.ndarray:
        """The values of all cells that the bins allow, in their order."""
        sizes = bins.sizes
        k = _halves(sizes)
        grids = [np.indices(part).reshape(len(part), int(np.prod(part))) for part in (sizes[:k], sizes[k:])]
        out = np.full([grid.shape[1] for grid in grids], self.base)
        for features, thresholds, leaves in zip(self.features, self.thresholds, self.leaves):
            high, low = _codes(features, thresholds, grids[0], 0), _codes(features, thresholds, grids[1], k)
            out += leaves[high[:, None] + low]
        return out.ravel()

    def importances(self, features: int) -> np.ndarray:
        """Share of each feature in the gain of all splits."""
        sums = np.bincount(self.features.ravel(), self.gains.ravel(), features)
        return sums / sums.sum() if sums.sum() > 0 else np.full(features, 1 / features)

    @classmethod
    def of(cls, rows: list) -> Trees:
        rows = sorted(rows, key=lambda r: r["tree"])
        return cls(
            *(np.array([r[c] for r in rows], kind) for c, kind in (
                ("features", np.int32), ("thresholds", np.int32), ("gains", float), ("leaves", float))),
            rows[0]["base"])


def _halves(sizes: list[int]) -> int:
    """Where to part the features, so that the larger of both halves' numbers of cells is least."""
    return min(range(1, len(sizes) + 1), key=lambda k: max(np.prod(sizes[:k]), np.prod(sizes[k:])))


def _codes(features: np.ndarray, thresholds: np.ndarray, digits: np.ndarray, first: int) -> np.ndarray:
    """The bits of each cell's leaf that the features from `first` on decide, of which `digits` are the bins."""
    out, depth = np.zeros(digits.shape[1], np.int64), len(features)
    for level, (f, t) in enumerate(zip(features, thresholds)):
        if first <= f < first + len(digits):
            out += (digits[f - first] > t).astype(np.int64) << (depth - 1 - level)
    return out


class _Half:
    """Distinct vectors of some features' bins, and the part of every leaf that these features decide."""

    def __init__(self, digits: np.ndarray, sizes: list[int], first: int):
        code = np.zeros(digits.shape[1], np.int64)
        for d, size in zip(digits, sizes):
            code = code * size + d
        _, places, self.of = np.unique(code, return_index=True, return_inverse=True)
        self.digits, self.sizes, self.first = digits[:, places], sizes, first

    def parts(self, features: list[int], thresholds: list[int]) -> None:
        self.codes, self.leaf = np.unique(
            _codes(np.array(features), np.array(thresholds), self.digits, self.first), return_inverse=True)
        self.member = np.zeros((self.digits.shape[1], len(self.codes)))
        self.member[np.arange(len(self.leaf)), self.leaf] = 1

    def scores(self, sums: np.ndarray, l2: float) -> list[np.ndarray]:
        """Per feature the score of every cut; `sums` has residuals and rows per vector and part of the other half."""
        out, others = [], sums.shape[2]
        for d, size in zip(self.digits, self.sizes):
            code = ((self.leaf * size + d)[:, None] * others + np.arange(others)).ravel()
            shape = (len(self.codes), size, others)
            g, w = (np.bincount(code, x.ravel(), np.prod(shape)).reshape(shape).cumsum(axis=1) for x in sums)
            gr, wr = g[:, -1:] - g, w[:, -1:] - w
            found = (g * g / (w + l2) + gr * gr / (wr + l2)).sum((0, 2))
            found[-1] = -np.inf  # a cut after a feature's last bin parts nothing
            out.append(found)
        return out


def boost(digits: np.ndarray, sizes: list[int], n: np.ndarray, total: np.ndarray, rounds: int, depth: int,
          rate: float, l2: float = L2) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
    """features, thresholds, gains, leaves and start value of one tree after the other.

    Cells lie in a matrix: its rows are the vectors of the first features, its columns those of
    the others. A question concerns rows or columns only, so a leaf is some rows by some columns,
    and all sums of a level come from two products of the matrix with the leaves' columns and rows.
    """
    offsets = np.cumsum([0, *sizes])
    feature_of = np.repeat(np.arange(len(sizes)), sizes)
    k = _halves(sizes)
    high, low = _Half(digits[:k], sizes[:k], 0), _Half(digits[k:], sizes[k:], k)
    shape = (high.digits.shape[1], low.digits.shape[1])
    place = high.of * shape[1] + low.of
    base = float(total.sum() / n.sum())
    matrix = np.stack([np.bincount(place, x, np.prod(shape)).reshape(shape) for x in (total - n * base, n)])
    for _ in range(rounds):
        features, thresholds, gains = [], [], []
        score = matrix[0].sum() ** 2 / (n.sum() + l2)
        for _ in range(depth):
            high.parts(features, thresholds)
            low.parts(features, thresholds)
            found = np.concatenate([
                *high.scores(matrix @ low.member, l2),
                *low.scores((high.member.T @ matrix).transpose(0, 2, 1), l2)])
            if not np.isfinite(found).any():
                found[0] = score
            top = found.max()
            best = int(np.argmax(found >= top - 1e-12 * abs(top)))  # the first of equal ones, however they round
            f = int(feature_of[best])
            features.append(f)
            thresholds.append(best - int(offsets[f]))
            gains.append(max(0.0, float(found[best] - score)))
            score = found[best]
        high.parts(features, thresholds)
        low.parts(features, thresholds)
        g, w = high.member.T @ matrix @ low.member
        values = rate * g / (w + l2)
        leaves = np.zeros(1 << depth)
        leaves[high.codes[:, None] + low.codes] = values
        matrix[0] -= matrix[1] * values[high.leaf][:, low.leaf]
        yield np.array(features), np.array(thresholds), np.array(gains), leaves, base


def fitted(train: DataFrame, bins: Bins, rounds: int, depth: int, rate: float, held_out: DataFrame | None = None) -> list:
    """Rows of `TREES`, fitted on grouped rows; `val_squared` is the squared error sum over grouped `held_out` rows.

    Both are bounded by the bins, so one task holds them.
    """
    both = train.withColumn("held", F.lit(False))
    if held_out is not None:
        both = both.unionByName(held_out.withColumn("held", F.lit(True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by("cell")
        held = table.column("held").to_numpy()
        cell, n, total, squares = (table.column(c).to_numpy().astype(kind) for c, kind in (
            ("cell", np.int64), ("n", float), ("total", float), ("squares", float)))
        digits = bins.digits(cell)
        error = None
        fit = boost(digits[:, ~held], bins.sizes, n[~held], total[~held], rounds, depth, rate)
        for i, (features, thresholds, gains, leaves, base) in enumerate(fit):
            if error is None:
                error = np.full(int(held.sum()), base)
            tree = Trees(features[None], thresholds[None], gains[None], leaves[None], 0.0)
            error = error + tree.predict(digits[:, held])
            squared = float((squares[held] - 2 * error * total[held] + n[held] * error * error).sum())
            values = (i, features, thresholds, gains, leaves, base, squared)
            kinds = (pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()),
                     pa.list_(pa.float64()), pa.float64(), pa.float64())
            names = [c.split()[0] for c in TREES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    return both.coalesce(1).mapInArrow(run, TREES).collect()


def predictions(cell: Column, bins: Bins, trees: Trees) -> Column:
    """The trees' value of each row's cell, looked up in the values of all cells, which every task gets."""
    table = SparkSession.active().sparkContext.broadcast(trees.of_all(bins))

    @F.pandas_udf("double")
    def values(cells: pd.Series) -> pd.Series:
        return pd.Series(table.value[cells.to_numpy()])

    return values(cell)
