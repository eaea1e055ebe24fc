"""Symmetric trees by plain Python, grouped against single rows, and codes that never see their own row."""

import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewmill.plans import boosting, rating


def plain_boost(rows, labels, sizes, rounds, depth, rate, l2=boosting.L2):
    """Predictions after each round, one row at a time."""
    base = sum(labels) / len(labels)
    predicted, out = [base] * len(rows), []
    for _ in range(rounds):
        residual = [y - p for y, p in zip(labels, predicted)]
        leaf = [0] * len(rows)
        for _ in range(depth):
            best = None
            for f, size in enumerate(sizes):
                for t in range(size - 1):
                    g, w = defaultdict(float), defaultdict(int)
                    for row, old, r in zip(rows, leaf, residual):
                        g[2 * old + (row[f] > t)] += r
                        w[2 * old + (row[f] > t)] += 1
                    score = sum(g[k] ** 2 / (w[k] + l2) for k in g)
                    if best is None or score > best[0] + 1e-9:
                        best = (score, f, t)
            leaf = [2 * old + (row[best[1]] > best[2]) for row, old in zip(rows, leaf)]
        g, w = defaultdict(float), defaultdict(int)
        for k, r in zip(leaf, residual):
            g[k] += r
            w[k] += 1
        predicted = [p + rate * g[k] / (w[k] + l2) for p, k in zip(predicted, leaf)]
        out.append(predicted)
    return out


def sample(n=300, seed=2):
    rng = np.random.default_rng(seed)
    sizes = [4, 2, 5]
    digits = np.stack([rng.integers(0, s, n) for s in sizes]).astype(np.int32)
    labels = np.clip(np.round(digits[0] + 0.5 * digits[2] * digits[1] + rng.normal(0, 0.7, n)), 1, 5)
    return sizes, digits, labels


def trees_of(digits, sizes, n, total, **settings):
    made = list(boosting.boost(digits, sizes, n, total, **settings))
    return boosting.Trees(*(np.array([m[i] for m in made]) for i in range(4)), made[0][4])


def test_trees_equal_plain_python():
    sizes, digits, labels = sample()
    trees = trees_of(digits, sizes, np.ones(300), labels, rounds=6, depth=3, rate=0.3)
    want = plain_boost(digits.T.tolist(), labels.tolist(), sizes, 6, 3, 0.3)
    for rounds in (1, 3, 6):
        assert np.allclose(trees.first(rounds).predict(digits), want[rounds - 1], atol=1e-9)
    assert trees.importances(3).sum() == pytest.approx(1)


def test_a_grouped_fit_equals_the_fit_on_single_rows():
    sizes, digits, labels = sample(2000)
    cell = np.ravel_multi_index(digits, sizes)
    cells, inverse = np.unique(cell, return_inverse=True)
    n, total = np.bincount(inverse).astype(float), np.bincount(inverse, labels)
    bins = boosting.Bins({f"f{i}": list(range(s - 1)) for i, s in enumerate(sizes)})
    grouped = trees_of(bins.digits(cells), sizes, n, total, rounds=200, depth=4, rate=0.05)
    single = trees_of(digits, sizes, np.ones(2000), labels, rounds=200, depth=4, rate=0.05)
    assert len(cells) <= boosting.cells_bound(bins) == 40
    assert np.allclose(grouped.predict(digits), single.predict(digits), atol=1e-8)


def test_one_cell_and_one_row():
    trees = trees_of(np.zeros((2, 1), np.int32), [1, 1], np.ones(1), np.array([4.0]), rounds=3, depth=2, rate=0.1)
    assert trees.predict(np.zeros((2, 1), np.int32)).tolist() == [4.0]


@pytest.mark.parametrize("sizes", [[3], [2, 2], [4, 2, 5], [1, 6, 3, 2]])
def test_values_of_all_cells_equal_those_of_single_rows(sizes):
    rng = np.random.default_rng(5)
    bins = boosting.Bins({f"f{i}": list(range(s - 1)) for i, s in enumerate(sizes)})
    digits = bins.digits(np.arange(boosting.cells_bound(bins)))
    some = np.sort(rng.choice(digits.shape[1], max(2, digits.shape[1] // 2), replace=False))
    labels = rng.integers(1, 6, len(some)).astype(float)
    trees = trees_of(digits[:, some], sizes, np.ones(len(some)), labels, rounds=5, depth=3, rate=0.3)
    want = plain_boost(digits[:, some].T.tolist(), labels.tolist(), sizes, 5, 3, 0.3)[-1]
    assert np.array_equal(trees.of_all(bins), trees.predict(digits))
    assert np.allclose(trees.of_all(bins)[some], want, atol=1e-9)


def test_rows_move_once_for_all_codes(spark):
    text = rating.ordered(frame(spark), 3.0)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def frame(spark, n=500):
    return spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("review_key"), (F.col("id") % 90).cast("int").alias("review_length"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 30).cast("int")).alias("word_count"),
        F.lit(0).alias("answer_length"), (F.col("id") % 2).cast("int").alias("has_answer"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("color"),
        (F.col("id") * 7 % 5 + 1).cast("int").alias("rating"),
        F.lit("positive").alias("sentiment_label"), F.lit(0.5).alias("sentiment_score"))


def test_codes_come_from_earlier_rows_only(spark):
    rows = [r.asDict() for r in rating.prepared(frame(spark)).collect()]
    order = sorted(rows, key=lambda r: (hashlib.md5(f"order:42:{r['review_key']}".encode()).hexdigest(), r["review_key"]))
    want, sums = {}, defaultdict(lambda: [0.0, 0])
    for r in order:
        codes = []
        for name in rating.CATEGORICAL:
            s = sums[name, r[name]]
            codes.append((s[0] + rating.PRIOR_ROWS * 3.0) / (s[1] + rating.PRIOR_ROWS))
            s[0] += r["rating"]
            s[1] += 1
        want[r["review_key"]] = codes
    got = rating.ordered(frame(spark), 3.0)
    assert {r.review_key: [r[f"{c}_code"] for c in rating.CATEGORICAL] for r in got.collect()} == want
    # A row's own rating changes the codes of others only.
    changed = frame(spark).withColumn("rating", F.when(F.col("review_key") == "k7", 1).otherwise(F.col("rating")))
    moved = {r.review_key: [r[f"{c}_code"] for c in rating.CATEGORICAL] for r in rating.ordered(changed, 3.0).collect()}
    assert moved["k7"] == want["k7"] and moved != want


def test_full_number_of_rounds_beats_the_mean(spark):
    rows = frame(spark)
    model, scores = rating.train(rows)
    spread = rows.agg(F.stddev_pop("rating")).first()[0]
    assert scores["val_rmse"] < 0.9 * spread and 1 <= scores["best_iteration"] <= rating.ROUNDS
    assert sum(model.importances().values()) == pytest.approx(1)
    assert model.predict(rows).where("predicted_rating BETWEEN 1 AND 5").count() == 500
