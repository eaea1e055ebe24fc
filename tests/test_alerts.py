"""Rule thresholds on hand-made products, and the known counts on the order lines."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from reviewmill.plans import alerts


def product(spark, ratings, labels=None, predicted=None):
    n = len(ratings)
    reviews = spark.createDataFrame(
        [(f"k{i}", "p", ratings[i]) for i in range(n)], "review_key string, product_id string, rating int"
    )
    labels, predicted = labels or [None] * n, predicted or [None] * n
    model = spark.createDataFrame(
        [(f"k{i}", labels[i], predicted[i]) for i in range(n)],
        "review_key string, sentiment_label string, predicted_rating double",
    )
    return reviews, model


def fired(df):
    return {(r.rule_name, r.severity): json.loads(r.details) for r in df.collect()}


def labels(negative, total, rest="positive"):
    return ["negative"] * negative + [rest] * (total - negative)


@pytest.mark.parametrize("negative, total, rest, want", [
    (3, 10, None, None),  # exactly 0.30; rows without a label count
    (4, 10, None, "medium"),
    (4, 9, "positive", None),
    (5, 10, "neutral", "high"),  # exactly 0.50
])
def test_negative_share(spark, negative, total, rest, want):
    df = alerts.high_negative_share(*product(spark, [3] * total, labels(negative, total, rest)))
    assert [r.severity for r in df.collect()] == ([want] if want else [])


@pytest.mark.parametrize("ratings, negative, want", [
    ([4] * 10, 3, "medium"),  # average exactly 4
    ([4] * 9 + [3], 3, None),
    ([5] * 10, 2, None),  # exactly 0.20
    ([5] * 20, 7, "high"),  # exactly 0.35
])
def test_mismatch(spark, ratings, negative, want):
    df = alerts.rating_sentiment_mismatch(*product(spark, ratings, labels(negative, len(ratings))))
    assert [r.severity for r in df.collect()] == ([want] if want else [])


@pytest.mark.parametrize("n, gap, want", [
    (20, 0.5, None), (20, 0.75, "medium"), (20, 1.0, "high"), (19, 2.0, None),
])
def test_gap(spark, n, gap, want):
    df = alerts.predicted_rating_gap(*product(spark, [4] * n, None, [4 - gap] * n))
    assert [r.severity for r in df.collect()] == ([want] if want else [])


@pytest.mark.parametrize("ratings, want", [
    ([3] * 5, None), ([2] * 5, "medium"), ([1] * 5, "high"), ([1] * 4, None),
    ([1, 1, 1, None, None], "high"),  # nulls count as reviews but not in the average
])
def test_low_rating(spark, ratings, want):
    df = alerts.low_overall_rating(product(spark, ratings)[0])
    assert [r.severity for r in df.collect()] == ([want] if want else [])


def test_details(spark):
    df = alerts.evaluate_all(*product(spark, [4] * 32, labels(12, 32), [2.5] * 32))
    assert fired(df) == {
        ("high_negative_share", "medium"): {"neg_pct": 0.375, "neg_count": 12, "total_reviews": 32},
        ("rating_sentiment_mismatch", "high"): {
            "avg_rating": 4.0, "neg_pct": 0.375, "neg_count": 12, "total_reviews": 32},
        ("predicted_rating_gap", "high"): {
            "real_avg": 4.0, "predicted_avg": 2.5, "gap": 1.5, "total_reviews": 32},
    }
    text = df.where("rule_name = 'high_negative_share'").select(
        alerts.details_text(F.col("details")).alias("t")).first().t
    assert text == "neg_pct: 0.375  |  neg_count: 12  |  total_reviews: 32"


def test_known_counts(spark):
    """Default thresholds over all order lines of sf0.01, as listed in FIXTURES.md."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    rows = spark.sql("""
        SELECT l_partkey AS product_id,
               concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS review_key,
               CAST(least(5, greatest(1, floor((l_quantity - 1) / 10) + 1 + (l_partkey % 7) - 3)) AS INT)
                   AS rating,
               CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END
                   AS sentiment_label,
               least(5.0D, greatest(1.0D, 3.0D + (l_tax - 0.04D) * 25)) AS predicted_rating
        FROM {lines}""", lines=lines)
    got = alerts.evaluate_all(
        rows.select("product_id", "review_key", "rating"),
        rows.select("review_key", "sentiment_label", "predicted_rating"),
    ).groupBy("rule_name").agg(F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high"))
    assert {r.rule_name: (r.n, r.high) for r in got.collect()} == {
        "high_negative_share": (1270, 84), "rating_sentiment_mismatch": (581, 287),
        "predicted_rating_gap": (833, 609), "low_overall_rating": (1021, 616),
    }


def test_snapshot_has_one_time(spark):
    df = alerts.snapshot(alerts.low_overall_rating(product(spark, [1] * 5)[0]),
                         dt.datetime(2024, 1, 2, 3, 4, 5, tzinfo=dt.timezone.utc))
    assert [r.created_at for r in df.collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5)]
