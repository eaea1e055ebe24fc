"""Threshold alerts over reviews and their model outputs."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.numbers import ratio, round_exact

RULES = [
    "high_negative_share", "rating_sentiment_mismatch", "predicted_rating_gap", "low_overall_rating",
]


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the original rules."""

    negative_min_reviews: int = 10
    negative_medium: float = 0.30
    negative_high: float = 0.50
    mismatch_min_reviews: int = 10
    mismatch_min_rating: float = 4.0
    mismatch_medium: float = 0.20
    mismatch_high: float = 0.35
    gap_min_reviews: int = 20
    gap_medium: float = 0.5
    gap_high: float = 1.0
    low_min_reviews: int = 5
    low_medium: float = 3.0
    low_high: float = 2.0


def product_signals(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    """Everything the four rules need, per product, from one join and one aggregation.

    The share rules see reviews that have a model row, whatever its label; the
    gap rule those with a prediction; the rating rule all reviews. The sums are
    partial on the map side, so a hot product reaches its reducer as one row
    per task.
    """
    model = review_ml.select(
        "review_key", "sentiment_label", "predicted_rating", F.lit(True).alias("has_ml")
    )
    rows = reviews.select("review_key", "product_id", "rating").join(model, "review_key", "left")
    rating = F.col("rating").cast("double")
    has_ml, predicted = F.col("has_ml").isNotNull(), F.col("predicted_rating").isNotNull()
    return rows.groupBy("product_id").agg(
        F.count("*").alias("n_all"),
        F.avg(rating).alias("avg_all"),
        F.count("has_ml").alias("n_ml"),
        F.avg(F.when(has_ml, rating)).alias("avg_ml"),
        F.count_if(F.col("sentiment_label") == "negative").alias("n_negative"),
        F.count("predicted_rating").alias("n_predicted"),
        F.avg(F.when(predicted, rating)).alias("avg_real"),
        F.avg("predicted_rating").alias("avg_predicted"),
    )


def _alert(rule: str, fires: Column, high: Column, details: dict[str, Column]) -> Column:
    body = F.struct(*[value.alias(name) for name, value in details.items()])
    return F.when(fires, F.struct(
        F.lit(rule).alias("rule_name"),
        F.when(high, "high").otherwise("medium").alias("severity"),
        F.to_json(body).alias("details"),
    ))


def _negative_share(t: Thresholds) -> Column:
    negative = ratio(F.col("n_negative"), F.col("n_ml"))
    fires = (F.col("n_ml") >= t.negative_min_reviews) & (negative > t.negative_medium)
    return _alert("high_negative_share", fires, negative >= t.negative_high, {
        "neg_pct": round_exact(negative, 3),
        "neg_count": F.col("n_negative"),
        "total_reviews": F.col("n_ml"),
    })


def _mismatch(t: Thresholds) -> Column:
    negative = ratio(F.col("n_negative"), F.col("n_ml"))
    fires = (
        (F.col("n_ml") >= t.mismatch_min_reviews)
        & (F.col("avg_ml") >= t.mismatch_min_rating)
        & (negative > t.mismatch_medium)
    )
    return _alert("rating_sentiment_mismatch", fires, negative >= t.mismatch_high, {
        "avg_rating": round_exact(F.col("avg_ml"), 2),
        "neg_pct": round_exact(negative, 3),
        "neg_count": F.col("n_negative"),
        "total_reviews": F.col("n_ml"),
    })


def _gap(t: Thresholds) -> Column:
    gap = F.col("avg_real") - F.col("avg_predicted")
    fires = (F.col("n_predicted") >= t.gap_min_reviews) & (gap > t.gap_medium)
    return _alert("predicted_rating_gap", fires, gap >= t.gap_high, {
        "real_avg": round_exact(F.col("avg_real"), 3),
        "predicted_avg": round_exact(F.col("avg_predicted"), 3),
        "gap": round_exact(gap, 3),
        "total_reviews": F.col("n_predicted"),
    })


def _low_rating(t: Thresholds) -> Column:
    fires = (F.col("n_all") >= t.low_min_reviews) & (F.col("avg_all") < t.low_medium)
    return _alert("low_overall_rating", fires, F.col("avg_all") < t.low_high, {
        "avg_rating": round_exact(F.col("avg_all"), 3),
        "total_reviews": F.col("n_all"),
    })


def _fired(signals: DataFrame, *alerts: Column) -> DataFrame:
    some = F.filter(F.array(*alerts), lambda alert: alert.isNotNull())
    return signals.select("product_id", F.inline(some))


def high_negative_share(reviews, review_ml, thresholds=Thresholds()) -> DataFrame:
    """Products whose share of negative reviews is too high."""
    return _fired(product_signals(reviews, review_ml), _negative_share(thresholds))


def rating_sentiment_mismatch(reviews, review_ml, thresholds=Thresholds()) -> DataFrame:
    """Products with a high star rating and many negative texts."""
    return _fired(product_signals(reviews, review_ml), _mismatch(thresholds))


def predicted_rating_gap(reviews, review_ml, thresholds=Thresholds()) -> DataFrame:
    """Products rated well above what the model expects."""
    return _fired(product_signals(reviews, review_ml), _gap(thresholds))


def low_overall_rating(reviews, thresholds=Thresholds()) -> DataFrame:
    """Products with a low star rating; needs no model output."""
    signals = reviews.groupBy("product_id").agg(
        F.count("*").alias("n_all"), F.avg(F.col("rating").cast("double")).alias("avg_all")
    )
    return _fired(signals, _low_rating(thresholds))


def evaluate_all(reviews: DataFrame, review_ml: DataFrame, thresholds=Thresholds()) -> DataFrame:
    """Alerts of all rules, from a single aggregation."""
    return _fired(
        product_signals(reviews, review_ml),
        _negative_share(thresholds), _mismatch(thresholds), _gap(thresholds), _low_rating(thresholds),
    )


def snapshot(alerts: DataFrame, created_at: dt.datetime | None = None) -> DataFrame:
    """Alert rows of one run, all with the same UTC time."""
    now = created_at or dt.datetime.now(dt.timezone.utc)
    stamp = now.astimezone(dt.timezone.utc).replace(tzinfo=None) if now.tzinfo else now
    return alerts.withColumn("created_at", F.lit(stamp.isoformat(sep=" ")).cast("timestamp_ntz"))


def details_text(details: Column) -> Column:
    """`name: value` parts joined for display."""
    entries = F.map_entries(F.from_json(details, "map<string,string>"))
    return F.array_join(
        F.transform(entries, lambda e: F.concat_ws(": ", e["key"], e["value"])), "  |  "
    )
