"""The review tables, derived from the driver's parquet tables.

`oracle_ctes` holds the same derivations as SQL for the result check. Scores and
predictions are multiples of 1/32 and 1/4, so sums are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.functions.vectors import polarity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, *keys: str, partitions: int = 0) -> DataFrame:
    """A table whose texts take long to process, dealt to `partitions`, or to all cores.

    The test tables may be a single row group, hence one task for all texts. Texts that the
    scan itself deals to all cores are not moved.
    """
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    if not partitions and well_dealt(rows, cores):
        return rows
    return rows.repartition(partitions or cores, *keys)


def well_dealt(files: DataFrame, cores: int) -> bool:
    """Whether no scan task has over twice a core's share of the rows, as the footers tell."""
    sizes = [r["count"] for r in files.groupBy(F.spark_partition_id()).count().collect()]  # one per scan task
    return max(sizes, default=0) * cores <= 2 * sum(sizes)


def _line_key():
    """Unique at every scale only with the ship date."""
    day = F.unix_date(F.col("l_shipdate").cast("date"))
    return F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", day)


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as reviews of parts; a few have no rating or colour."""
    stars = F.floor((F.col("l_quantity") - 1) / 10) + 1 + F.col("l_partkey") % 7 - 3
    answered = F.col("l_linestatus") == "F"
    text = F.concat_ws(" ", F.lit("order"), "l_orderkey", F.lit("line"), "l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        _line_key().alias("review_key"),
        F.col("l_partkey").alias("product_id"),
        text.alias("text"),
        F.when(F.col("l_quantity") < 50, text).otherwise("").alias("text_clean"),
        F.when(F.col("l_discount") < 0.095, F.greatest(F.lit(1), F.least(F.lit(5), stars)))
        .cast("int").alias("rating"),
        F.when(F.col("l_quantity") > 1, F.concat(F.lit("c"), F.col("l_partkey") % 40)).alias("color"),
        F.when(answered, "thanks").alias("answer"),
        answered.alias("has_answer"),
        F.floor(F.col("l_extendedprice") / 100).cast("int").alias("review_length"),
        F.col("l_quantity").cast("int").alias("word_count"),
        F.when(answered, F.col("l_linenumber") * 10).otherwise(0).cast("int").alias("answer_length"),
    )


def review_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model rows of the lines shipped before 2000; later lines are still to be scored."""
    label = (
        F.when(F.col("l_returnflag") == "R", "negative")
        .when(F.col("l_returnflag") == "A", "positive")
        .when(F.col("l_tax") < 0.075, "neutral")
    )
    predicted = F.greatest(F.lit(1.0), F.least(F.lit(5.0), 3 + F.round(F.col("l_tax") * 100 - 4) / 4))
    side = polarity(label)
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
        .select(
            _line_key().alias("review_key"),
            label.alias("sentiment_label"),
            F.when(label.isNotNull(), 0.5 + F.round(F.col("l_discount") * 100) / 32)
            .alias("sentiment_score"),
            F.when(
                side.isNotNull() & (F.col("l_quantity") > 10),
                F.concat_ws("|", F.col("l_partkey"), side, F.col("l_linenumber")),
            ).alias("topic_id"),
            F.lit(None).cast("double").alias("fake_score"),
            F.when(F.col("l_tax") > 0.005, predicted).alias("predicted_rating"),
            F.when(
                F.col("l_quantity") <= 30,
                F.array(F.col("l_quantity").cast("float"), F.col("l_linenumber").cast("float")),
            ).alias("embedding"),
        )
    )


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per topic the model rows point to."""
    part = F.split("topic_id", r"\|")
    sizes = review_ml(spark, sf_dir).where(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(
        F.count("*").alias("review_count")
    )
    return sizes.select(
        "topic_id",
        part[0].cast("bigint").alias("product_id"),
        part[1].alias("polarity"),
        part[2].cast("int").alias("topic_no"),
        F.concat_ws(", ", F.lit("quality of stitching and seams"), part[1],
                    F.concat(F.lit("delivery and packaging "), part[2])).alias("keywords"),
        "review_count",
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.lit("market").alias("marketplace"), F.col("p_partkey").cast("string").alias("external_id")
    )


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw feedback on one product per language, so one product is hot."""
    number = (
        F.when(F.col("lang") == "en", 101).when(F.col("lang") == "fr", 102)
        .when(F.col("lang") == "de", 103)
    )
    return texts(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("seq"),
        number.cast("bigint").alias("nmId"),
        "text",
        (F.col("n_chars") % 5 + 1).cast("int").alias("productValuation"),
        F.col("source").alias("color"),
        F.lit(None).cast("string").alias("answer"),
    )


def feedback_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as reviews; a following assistant turn is the seller's answer."""
    turns = table(spark, sf_dir, "conversations")
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    return turns.where(F.col("role") == "user").join(answers, ["conv_id", "turn"], "left").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"),
        (F.col("conv_id") % 20).alias("nmId"),
        "text",
        (F.char_length("text") % 5 + 1).cast("int").alias("productValuation"),
        F.lit(None).cast("string").alias("color"),
        "answer",
    )
