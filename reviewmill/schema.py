"""Table schemas and the fixed settings the jobs share."""

from __future__ import annotations

from pyspark.sql import types as T

# Defaults of the original jobs.
MARKETPLACE = "market"
MAX_ROWS = 400_000
BATCH_SIZE = 5_000
SENTIMENT_BATCH_SIZE = 64
EMBEDDING_BATCH_SIZE = 128
EMBEDDING_DIM = 384
MIN_CLUSTER_REVIEWS = 50
MIN_TOKENS = 3
MAX_TOKENS = 512

# Padded tokens in a batch of a caller's model.
TOKEN_BUDGET = 16_384

FEEDBACK = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("nmId", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("productValuation", T.IntegerType()),
    T.StructField("color", T.StringType()),
    T.StructField("answer", T.StringType()),
])

REJECTS = T.StructType([*FEEDBACK.fields, T.StructField("text_clean", T.StringType())])

LOADS = T.StructType([
    T.StructField(name, T.LongType())
    for name in ("rows_read", "rows_kept", "rows_rejected", "reviews", "products")
])

PRODUCTS = T.StructType([
    T.StructField("marketplace", T.StringType()),
    T.StructField("external_id", T.StringType()),
])

REVIEWS = T.StructType([
    T.StructField("review_key", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("text_clean", T.StringType()),
    T.StructField("rating", T.IntegerType()),
    T.StructField("color", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("has_answer", T.BooleanType()),
    T.StructField("review_length", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("answer_length", T.IntegerType()),
])

REVIEW_ML = T.StructType([
    T.StructField("review_key", T.StringType()),
    T.StructField("sentiment_label", T.StringType()),
    T.StructField("sentiment_score", T.DoubleType()),
    T.StructField("topic_id", T.StringType()),
    T.StructField("fake_score", T.DoubleType()),
    T.StructField("predicted_rating", T.DoubleType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

# Reviews with their model outputs, as the listings show them.
LISTING = T.StructType([
    *[f for f in REVIEWS.fields if f.name != "text_clean"],
    *[f for f in REVIEW_ML.fields if f.name in ("sentiment_label", "sentiment_score", "topic_id", "predicted_rating")],
])

TOPICS = T.StructType([
    T.StructField("topic_id", T.StringType()),
    T.StructField("product_id", T.StringType()),
    T.StructField("polarity", T.StringType()),
    T.StructField("topic_no", T.IntegerType()),
    T.StructField("keywords", T.StringType()),
    T.StructField("review_count", T.LongType()),
])

ERRORS = T.StructType([
    T.StructField("stage", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("message", T.StringType()),
])

ALERTS = T.StructType([
    T.StructField("product_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("details", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()),
])

# Columns a second load of the same review may change; text and product follow from its key.
REVIEW_UPDATE_COLUMNS = [
    "text_clean", "rating", "color", "answer", "has_answer",
    "review_length", "word_count", "answer_length",
]
