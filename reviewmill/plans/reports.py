"""Read-only report queries. Listings cover all products unless one is asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.functions.numbers import round_exact, share
from reviewmill.plans.alerts import details_text

# Labels in display order.
SENTIMENTS = ["positive", "neutral", "negative"]
STARS = [1, 2, 3, 4, 5]
SEVERITIES = ["high", "medium", "low"]


def enriched(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    """Reviews with their model outputs; the key is unique on both sides."""
    return reviews.join(review_ml, "review_key")


def _of_product(rows: DataFrame, product_id) -> DataFrame:
    return rows if product_id is None else rows.where(F.col("product_id") == F.lit(product_id))


def _first_per(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """First `n` rows of each group. Spark keeps `n` per group on the map side already."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


# Overview

def overview(reviews, products, review_ml, topics, alerts) -> DataFrame:
    """Counters over all tables as one row: each table is counted once, then merged."""
    parts = [
        reviews.agg(F.count("*").alias("total_reviews")),
        products.agg(F.count("*").alias("total_products")),
        review_ml.agg(
            F.count("sentiment_label").alias("with_sentiment"),
            F.count("embedding").alias("with_embedding"),
            F.count("predicted_rating").alias("with_predicted"),
        ),
        topics.agg(F.count("*").alias("total_topics")),
        alerts.agg(
            F.count("*").alias("total_alerts"),
            F.count_if(F.col("severity") == "high").alias("alerts_high"),
        ),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in merged.columns])


def completeness(overview_row: DataFrame) -> DataFrame:
    """Share of reviews each model stage has covered."""
    total = F.col("total_reviews")
    return overview_row.select(
        share(F.col("with_sentiment"), total).alias("sentiment"),
        share(F.col("with_embedding"), total).alias("embeddings"),
        share(F.col("with_predicted"), total).alias("predicted"),
    )


def sentiment_distribution(review_ml: DataFrame) -> DataFrame:
    labelled = review_ml.where(F.col("sentiment_label").isNotNull())
    return labelled.groupBy("sentiment_label").agg(F.count("*").alias("n"))


def top_products(reviews: DataFrame, limit: int = 50) -> DataFrame:
    sizes = reviews.groupBy("product_id").agg(F.count("*").alias("review_count"))
    return sizes.orderBy(F.col("review_count").desc(), "product_id").limit(limit)


def product_labels(top: DataFrame) -> DataFrame:
    """Picker text of each product."""
    text = F.format_string("Product %s  (%,d reviews)", F.col("product_id"), F.col("review_count"))
    return top.select("product_id", text.alias("label"))


def topic_index_labels(index: DataFrame) -> DataFrame:
    text = F.format_string(
        "Product %s  (%d topics, %,d reviews)",
        F.col("product_id"), F.col("topic_count"), F.col("review_count"),
    )
    return index.select("product_id", text.alias("label"))


# Sentiment

def product_sentiment(reviews, review_ml, product_id=None) -> DataFrame:
    """Labelled reviews, most confident first within a product."""
    rows = enriched(
        _of_product(reviews, product_id).select("review_key", "product_id", "rating", "text"),
        review_ml.where(F.col("sentiment_label").isNotNull())
        .select("review_key", "sentiment_label", "sentiment_score"),
    )
    return rows.select(
        "product_id", "review_key", "sentiment_label", "sentiment_score", "rating", "text"
    ).orderBy("product_id", F.col("sentiment_score").desc_nulls_first(), "review_key")


def product_sentiment_counts(reviews, review_ml) -> DataFrame:
    rows = reviews.select("review_key", "product_id").join(
        review_ml.where(F.col("sentiment_label").isNotNull()).select("review_key", "sentiment_label"),
        "review_key",
    )
    return rows.groupBy("product_id").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("sentiment_label") == s).alias(s) for s in SENTIMENTS],
    )


def rating_sentiment_matrix(reviews, review_ml) -> DataFrame:
    rows = reviews.where(F.col("rating").isNotNull()).select("review_key", "rating").join(
        review_ml.where(F.col("sentiment_label").isNotNull()).select("review_key", "sentiment_label"),
        "review_key",
    )
    return rows.groupBy("rating", "sentiment_label").agg(F.count("*").alias("n"))


def rating_sentiment_pivot(matrix: DataFrame, stars: list[int] = STARS) -> DataFrame:
    """Labels by stars; cells without reviews are 0."""
    wide = matrix.groupBy("sentiment_label").pivot("rating", stars).agg(F.sum("n")).na.fill(0)
    return wide.select("sentiment_label", *[F.col(str(s)).alias(f"stars_{s}") for s in stars])


def negative_reviews(reviews, review_ml, n: int = 15, ascending: bool = True,
                     product_id=None) -> DataFrame:
    """Negative reviews of each product, least confident first as the original table sorts."""
    of_product = _of_product(reviews, product_id)
    rows = of_product.select("review_key", "product_id", "rating").join(
        review_ml.where(F.col("sentiment_label") == "negative").select("review_key", "sentiment_score"),
        "review_key",
    )
    score = F.col("sentiment_score")
    order = score.asc_nulls_last() if ascending else score.desc_nulls_last()
    return _with_text(_first_per(rows, ["product_id"], [order, F.col("review_key")], n), of_product)


def _with_text(winners: DataFrame, reviews: DataFrame) -> DataFrame:
    """Texts of the rows that were kept; no text is joined or sorted before."""
    return winners.join(reviews.select("review_key", "text"), "review_key")


def sample_reviews(reviews, review_ml, n: int = 500, seed: int = 42, product_id=None) -> DataFrame:
    """A repeatable sample of at most `n` labelled reviews of each product."""
    rows = enriched(
        _of_product(reviews, product_id).select("review_key", "product_id", "rating"),
        review_ml.where(F.col("sentiment_label").isNotNull())
        .select("review_key", "sentiment_label", "sentiment_score"),
    )
    order = [F.md5(F.concat_ws(":", F.lit(str(seed)), "review_key")), F.col("review_key")]
    return _first_per(rows, ["product_id"], order, n)


# Topics

def products_with_topics(topics: DataFrame, limit: int = 100) -> DataFrame:
    sizes = topics.groupBy("product_id").agg(
        F.count("*").alias("topic_count"), F.sum("review_count").alias("review_count")
    )
    return sizes.orderBy(F.col("review_count").desc_nulls_first(), "product_id").limit(limit)


def topics_totals(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count("*").alias("products"),
        F.coalesce(F.sum("review_count"), F.lit(0)).alias("reviews"),
    )


def product_topics(topics: DataFrame, product_id=None) -> DataFrame:
    """Topics by polarity, largest first."""
    return _of_product(topics, product_id).select(
        "product_id", "topic_id", "polarity", "keywords", "review_count"
    ).orderBy("product_id", "polarity", F.col("review_count").desc_nulls_first(), "topic_id")


def topic_reviews(reviews, review_ml, n: int = 20, topic_id=None) -> DataFrame:
    """Most confident reviews of each topic."""
    model = review_ml.where(F.col("topic_id").isNotNull())
    if topic_id is not None:
        model = model.where(F.col("topic_id") == topic_id)
    rows = reviews.select("review_key", "rating").join(
        model.select("review_key", "topic_id", "sentiment_label", "sentiment_score"), "review_key"
    )
    order = [F.col("sentiment_score").desc_nulls_first(), F.col("review_key")]
    return _with_text(_first_per(rows, ["topic_id"], order, n), reviews)


def topic_labels(topics: DataFrame, width: int = 50) -> DataFrame:
    """Picker text of each topic."""
    text = F.concat(
        F.lit("["), F.col("topic_id"), F.lit("] "), F.substring("keywords", 1, width),
        F.lit("…  ("), F.col("review_count").cast("string"), F.lit(" reviews)"),
    )
    return topics.select("topic_id", text.alias("label"))


# Rating gap; rows come from `impact.rating_gaps`

def rating_gap_listing(gaps: DataFrame) -> DataFrame:
    return gaps.orderBy(F.col("gap").desc_nulls_first(), "product_id")


def rating_gap_summary(gaps: DataFrame) -> DataFrame:
    return gaps.agg(
        F.count("*").alias("products"),
        F.count_if(F.col("gap") > 0).alias("with_positive_gap"),
        F.max("gap").alias("max_gap"),
        F.avg("gap").alias("avg_gap"),
    )


def rating_gap_range(gaps: DataFrame, margin: float = 0.1) -> DataFrame:
    """Axis bounds that hold both averages."""
    return gaps.agg(
        (F.least(F.min("pred_avg"), F.min("real_avg")) - margin).alias("low"),
        (F.greatest(F.max("pred_avg"), F.max("real_avg")) + margin).alias("high"),
    )


def histogram(rows: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in equal-width bins between the smallest and the largest value.

    Values are counted per distinct value first; the bounds come from those counts.
    """
    present = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        F.count("*").alias("c")
    )
    bounds = present.agg(F.struct(F.min("v").alias("low"), F.max("v").alias("high")))
    binned = present.select("v", "c", bounds.scalar().alias("b")).withColumn(
        "width", F.col("b.high") - F.col("b.low")
    )
    position = F.floor((F.col("v") - F.col("b.low")) / F.col("width") * bins)
    bin_no = F.when(F.col("width") > 0, F.least(position, F.lit(bins - 1))).otherwise(F.lit(0))
    return binned.groupBy(bin_no.cast("int").alias("bin")).agg(F.sum("c").alias("n"))


def top_gap_products(gaps: DataFrame, n: int = 30) -> DataFrame:
    top = rating_gap_listing(gaps).limit(n)
    return top.select(
        "product_id", "review_count",
        *[round_exact(F.col(c), 3).alias(c) for c in ("real_avg", "pred_avg", "gap")],
    )


# Alerts

def alerts_listing(alerts: DataFrame) -> DataFrame:
    """Severity in descending text order, so "high" is last; `severity_rank` orders by weight."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity")).cast("int")
    order = [F.col("severity").desc_nulls_first()]
    if "created_at" in alerts.columns:
        order.append(F.col("created_at").desc_nulls_first())
    return alerts.withColumn("severity_rank", rank).orderBy(*order, "product_id", "rule_name")


def alerts_high(alerts: DataFrame, n: int = 20) -> DataFrame:
    rows = alerts_listing(alerts).where(F.col("severity") == "high").limit(n)
    return rows.select("product_id", "rule_name", "severity", "details")


def alerts_filtered(alerts: DataFrame, rules: list[str] | None = None,
                    severities: tuple[str, ...] = ("high", "medium")) -> DataFrame:
    rows = alerts.where(F.col("severity").isin(*severities))
    if rules is not None:
        rows = rows.where(F.col("rule_name").isin(*rules))
    return rows.select(
        "product_id", "rule_name", "severity", details_text(F.col("details")).alias("details_text")
    )


def alerts_by_rule(alerts: DataFrame) -> DataFrame:
    sizes = alerts.groupBy("rule_name").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.col("n").desc(), "rule_name")


def alerts_by_severity(alerts: DataFrame) -> DataFrame:
    sizes = alerts.groupBy("severity").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.col("n").desc(), "severity")
