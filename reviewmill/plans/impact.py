"""Revenue impact of rating gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.numbers import round_exact

# Default assumptions of the original calculation.
MIN_REVIEWS = 20
CONVERSION_PER_STAR = 0.15
MONTHLY_SALES = 1_000.0
AVG_PRICE = 1_000.0


def rating_gaps(reviews: DataFrame, review_ml: DataFrame, min_reviews: int = MIN_REVIEWS) -> DataFrame:
    """Average real and predicted rating per product, over reviews with a prediction."""
    predicted = review_ml.where(F.col("predicted_rating").isNotNull()).select(
        "review_key", "predicted_rating"
    )
    rows = reviews.select("review_key", "product_id", "rating").join(predicted, "review_key")
    return (
        rows.groupBy("product_id")
        .agg(
            F.count("*").alias("review_count"),
            F.avg(F.col("rating").cast("double")).alias("real_avg"),
            F.avg("predicted_rating").alias("pred_avg"),
        )
        .where(F.col("review_count") >= min_reviews)
        .withColumn("gap", F.col("real_avg") - F.col("pred_avg"))
    )


def effects(
    gaps: DataFrame,
    conversion_per_star: float | Column = CONVERSION_PER_STAR,
    monthly_sales: float | Column = MONTHLY_SALES,
    avg_price: float | Column = AVG_PRICE,
) -> DataFrame:
    """The linear model on each product; an assumption may be a column of `gaps`."""
    rate, sales, price = (
        a if isinstance(a, Column) else F.lit(float(a))
        for a in (conversion_per_star, monthly_sales, avg_price)
    )
    drop = F.greatest(F.lit(0.0), F.col("gap") * rate)
    return gaps.select(
        "product_id",
        "review_count",
        round_exact(F.col("real_avg"), 3).alias("real_avg_rating"),
        round_exact(F.col("pred_avg"), 3).alias("predicted_avg_rating"),
        round_exact(F.col("gap"), 3).alias("rating_gap"),
        round_exact(drop, 4).alias("conversion_drop_pct"),
        round_exact(sales * drop * price, 2).alias("lost_revenue"),
    )


def per_product(reviews: DataFrame, review_ml: DataFrame, min_reviews: int = MIN_REVIEWS,
                **assumptions) -> DataFrame:
    """Impact rows, largest gap first."""
    gaps = rating_gaps(reviews, review_ml, min_reviews)
    gaps = gaps.orderBy(F.col("gap").desc_nulls_first(), "product_id")
    return effects(gaps, **assumptions)


def for_products(reviews: DataFrame, review_ml: DataFrame, product_ids: list | None = None,
                 **assumptions) -> DataFrame:
    """Impact without a minimum of reviews; products whose average is null or 0 have none."""
    if product_ids is not None:
        reviews = reviews.where(F.col("product_id").isin(product_ids))
    gaps = rating_gaps(reviews, review_ml, 0).where(F.coalesce("real_avg", F.lit(0.0)) != 0)
    return effects(gaps, **assumptions)


def top_by_lost_revenue(rows: DataFrame, n: int) -> DataFrame:
    return rows.orderBy(F.col("lost_revenue").desc(), "product_id").limit(n)


def summary(rows: DataFrame) -> DataFrame:
    """Totals over impact rows; zeros when there are none."""
    def total(value: Column, digits: int) -> Column:
        return round_exact(F.coalesce(value, F.lit(0.0)), digits)

    return rows.agg(
        F.count("*").alias("total_products"),
        F.count_if(F.col("rating_gap") > 0).alias("products_with_gap"),
        total(F.avg("rating_gap"), 4).alias("avg_gap"),
        total(F.max("rating_gap"), 4).alias("max_gap"),
        total(F.sum("lost_revenue"), 2).alias("total_lost_revenue"),
        total(F.avg("lost_revenue"), 2).alias("avg_lost_revenue_per_product"),
    )


def summary_with_top(rows: DataFrame, top_n: int = 10) -> DataFrame:
    """The totals with the `top_n` largest losses as one nested column."""
    top = top_by_lost_revenue(rows, top_n)
    ordered = F.struct(-F.col("lost_revenue"), "product_id", F.struct(*rows.columns).alias("effect"))
    nested = top.agg(F.transform(F.sort_array(F.collect_list(ordered)), lambda x: x["effect"]))
    return summary(rows).withColumn("top_products", nested.scalar())


def top_with_drop_percent(rows: DataFrame, n: int = 20) -> DataFrame:
    """The display table of the largest losses."""
    return top_by_lost_revenue(rows, n).select(
        "product_id", "review_count", "rating_gap",
        round_exact(F.col("conversion_drop_pct") * 100, 1).alias("conversion_drop_percent"),
        "lost_revenue",
    )
