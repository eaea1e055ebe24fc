"""What each model stage still has to do, and writing its columns back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.functions.vectors import polarity
from reviewmill.operators.merge import merge_columns


def _pending(reviews: DataFrame, review_ml: DataFrame, column: str) -> DataFrame:
    """Non-empty reviews whose model row is missing or has no `column` yet."""
    done = review_ml.where(F.col(column).isNotNull()).select("review_key")
    todo = reviews.where(F.col("text_clean") != "").select("review_key", "text_clean")
    return todo.join(done, "review_key", "left_anti")


def pending_sentiment(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    return _pending(reviews, review_ml, "sentiment_label")


def pending_embedding(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    return _pending(reviews, review_ml, "embedding")


def upsert_sentiment(review_ml: DataFrame, scored: DataFrame) -> DataFrame:
    return merge_columns(review_ml, scored, "review_key", ["sentiment_label", "sentiment_score"])


def upsert_embedding(review_ml: DataFrame, vectors: DataFrame) -> DataFrame:
    return merge_columns(review_ml, vectors, "review_key", ["embedding"])


def upsert_predicted(review_ml: DataFrame, predictions: DataFrame) -> DataFrame:
    return merge_columns(review_ml, predictions, "review_key", ["predicted_rating"])


def cluster_input(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    """Reviews of all products that can be clustered."""
    ready = review_ml.where(
        F.col("embedding").isNotNull() & F.col("sentiment_label").isNotNull()
    ).select("review_key", "embedding", "sentiment_label")
    rows = reviews.select(
        "review_key", "product_id", F.coalesce("text_clean", F.lit("")).alias("text_clean")
    )
    return rows.join(ready, "review_key").withColumn("polarity", polarity(F.col("sentiment_label")))


def cluster_ready_products(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    return cluster_input(reviews, review_ml).select("product_id").distinct().orderBy("product_id")


def rating_input(reviews: DataFrame, review_ml: DataFrame) -> DataFrame:
    """Reviews the rating model can learn from and score, with all its features."""
    model = review_ml.select("review_key", "sentiment_label", "sentiment_score").dropna()
    rows = reviews.where(F.col("rating").isNotNull()).select(
        "review_key", "review_length", "word_count", "answer_length",
        F.col("has_answer").cast("int").alias("has_answer"), "color", "rating",
    )
    return rows.join(model, "review_key")
