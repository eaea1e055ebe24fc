"""Queries over the numeric review tables: alerts, reports, impact, incremental stages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from reviewmill.functions.numbers import clip_rating
from reviewmill.functions.vectors import normalise_label, polarity
from reviewmill.operators import merge
from reviewmill.plans import alerts, impact, incremental, jobs, reports
from reviewmill.registry.base import oracle, query
from reviewmill.session import shared_folder
from reviewmill.sources import driver_tables as t
from reviewmill.sources.feedback import scan_limit


def _both(spark, d):
    return t.reviews(spark, d), t.review_ml(spark, d)


def _alerts(spark, d):
    return alerts.evaluate_all(*_both(spark, d))


# Alerts

@query("alert_high_negative_share", oracle("negative_share", select="SELECT * FROM negative_share"))
def _(spark, d):
    return alerts.high_negative_share(*_both(spark, d))


@query("alert_rating_sentiment_mismatch", oracle("mismatch", select="SELECT * FROM mismatch"))
def _(spark, d):
    return alerts.rating_sentiment_mismatch(*_both(spark, d))


@query("alert_predicted_rating_gap", oracle("gap_alerts", select="SELECT * FROM gap_alerts"))
def _(spark, d):
    return alerts.predicted_rating_gap(*_both(spark, d))


@query("alert_low_overall_rating", oracle("low_rating", select="SELECT * FROM low_rating"))
def _(spark, d):
    return alerts.low_overall_rating(t.reviews(spark, d))


@query("alerts_all", oracle("alerts", select="SELECT * FROM alerts"))
def alerts_all(spark, d):
    return _alerts(spark, d)


@query("alerts_snapshot", oracle(
    "alerts", select="SELECT *, TIMESTAMP '2024-05-06 07:08:09' AS created_at FROM alerts"))
def _(spark, d):
    return alerts.snapshot(_alerts(spark, d), dt.datetime(2024, 5, 6, 7, 8, 9))


@query("alert_details_json", oracle("alerts", select="""
    SELECT product_id, rule_name, CAST(details->>'total_reviews' AS BIGINT) AS total_reviews,
           CAST(details->>'neg_pct' AS DOUBLE) AS neg_pct FROM alerts"""))
def _(spark, d):
    parsed = F.from_json("details", "total_reviews bigint, neg_pct double")
    return _alerts(spark, d).select("product_id", "rule_name", parsed.alias("p")).select(
        "product_id", "rule_name", "p.total_reviews", "p.neg_pct"
    )


_DETAILS_TEXT = """replace(replace(replace(replace(replace(details, '{', ''), '}', ''), ',', '  |  '),
                   ':', ': '), '"', '')"""


@query("alert_details_text", oracle("alerts", select=f"""
    SELECT product_id, rule_name, {_DETAILS_TEXT} AS details_text FROM alerts"""))
def _(spark, d):
    return _alerts(spark, d).select(
        "product_id", "rule_name", alerts.details_text(F.col("details")).alias("details_text")
    )


@query("alerts_filtered", oracle("alerts", select=f"""
    SELECT product_id, rule_name, severity, {_DETAILS_TEXT} AS details_text
    FROM alerts WHERE rule_name IN ('high_negative_share', 'low_overall_rating')
    AND severity IN ('high', 'medium')"""))
def _(spark, d):
    return reports.alerts_filtered(_alerts(spark, d), ["high_negative_share", "low_overall_rating"])


@query("alerts_listing", oracle("alerts", select="""
    SELECT *, CASE severity WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS severity_rank
    FROM alerts ORDER BY severity DESC, product_id, rule_name"""))
def _(spark, d):
    return reports.alerts_listing(_alerts(spark, d))


@query("alerts_high", oracle("alerts", select="""
    SELECT product_id, rule_name, severity, details FROM alerts WHERE severity = 'high'
    ORDER BY product_id, rule_name LIMIT 20"""))
def _(spark, d):
    return reports.alerts_high(_alerts(spark, d))


@query("alerts_by_rule", oracle(
    "alerts", select="SELECT rule_name, count(*) AS n FROM alerts GROUP BY rule_name"))
def _(spark, d):
    return reports.alerts_by_rule(_alerts(spark, d))


@query("alerts_by_severity", oracle(
    "alerts", select="SELECT severity, count(*) AS n FROM alerts GROUP BY severity"))
def _(spark, d):
    return reports.alerts_by_severity(_alerts(spark, d))


# Overview

_OVERVIEW = """
    SELECT (SELECT count(*) FROM reviews) AS total_reviews,
           (SELECT count(*) FROM products) AS total_products,
           (SELECT count(sentiment_label) FROM review_ml) AS with_sentiment,
           (SELECT count(embedding) FROM review_ml) AS with_embedding,
           (SELECT count(predicted_rating) FROM review_ml) AS with_predicted,
           (SELECT count(*) FROM topics) AS total_topics,
           (SELECT count(*) FROM alerts) AS total_alerts,
           (SELECT count(*) FROM alerts WHERE severity = 'high') AS alerts_high"""


def _overview(spark, d):
    reviews, review_ml = _both(spark, d)
    return reports.overview(
        reviews, t.products(spark, d), review_ml, t.topics(spark, d), _alerts(spark, d)
    )


@query("overview_stats", oracle("reviews", "products", "topics", "alerts", select=_OVERVIEW))
def _(spark, d):
    return _overview(spark, d)


@query("stage_completeness", oracle("reviews", "products", "topics", "alerts", o=_OVERVIEW, select="""
    SELECT with_sentiment::DOUBLE / total_reviews AS sentiment,
           with_embedding::DOUBLE / total_reviews AS embeddings,
           with_predicted::DOUBLE / total_reviews AS predicted FROM o"""))
def _(spark, d):
    return reports.completeness(_overview(spark, d))


@query("sentiment_distribution", oracle("review_ml", select="""
    SELECT sentiment_label, count(*) AS n FROM review_ml
    WHERE sentiment_label IS NOT NULL GROUP BY sentiment_label"""))
def _(spark, d):
    return reports.sentiment_distribution(t.review_ml(spark, d))


_TOP = """SELECT product_id, count(*) AS review_count FROM reviews GROUP BY product_id
          ORDER BY review_count DESC, product_id LIMIT """


@query("top_products", oracle("reviews", select=_TOP + "50"))
def _(spark, d):
    return reports.top_products(t.reviews(spark, d))


@query("product_labels", oracle("reviews", top=_TOP + "100", select="""
    SELECT product_id, format('Product {}  ({:,} reviews)', product_id, review_count) AS label
    FROM top"""))
def _(spark, d):
    return reports.product_labels(reports.top_products(t.reviews(spark, d), 100))


@query("reviews_enriched", oracle("reviews", "review_ml", select="""
    SELECT review_key, product_id, text, rating, color, has_answer, sentiment_label, sentiment_score,
           topic_id, predicted_rating
    FROM reviews JOIN review_ml USING (review_key)"""))
def _(spark, d):
    return reports.enriched(*_both(spark, d)).select(
        "review_key", "product_id", "text", "rating", "color", "has_answer", "sentiment_label",
        "sentiment_score", "topic_id", "predicted_rating",
    )


# Sentiment reports

@query("product_sentiment", oracle("reviews", "review_ml", select="""
    SELECT product_id, review_key, sentiment_label, sentiment_score, rating, text
    FROM reviews JOIN review_ml USING (review_key) WHERE sentiment_label IS NOT NULL"""))
def _(spark, d):
    return reports.product_sentiment(*_both(spark, d))


@query("product_sentiment_counts", oracle("reviews", "review_ml", select="""
    SELECT product_id, count(*) AS total,
           count(*) FILTER (sentiment_label = 'positive') AS positive,
           count(*) FILTER (sentiment_label = 'neutral') AS neutral,
           count(*) FILTER (sentiment_label = 'negative') AS negative
    FROM reviews JOIN review_ml USING (review_key) WHERE sentiment_label IS NOT NULL
    GROUP BY product_id"""))
def _(spark, d):
    return reports.product_sentiment_counts(*_both(spark, d))


@query("rating_sentiment_matrix", oracle("reviews", "review_ml", select="""
    SELECT rating, sentiment_label, count(*) AS n FROM reviews JOIN review_ml USING (review_key)
    WHERE rating IS NOT NULL AND sentiment_label IS NOT NULL GROUP BY rating, sentiment_label"""))
def _(spark, d):
    return reports.rating_sentiment_matrix(*_both(spark, d))


@query("rating_sentiment_pivot", oracle("reviews", "review_ml", select=f"""
    SELECT sentiment_label, {", ".join(
        f"count(*) FILTER (rating = {s}) AS stars_{s}" for s in reports.STARS)}
    FROM reviews JOIN review_ml USING (review_key)
    WHERE rating IS NOT NULL AND sentiment_label IS NOT NULL GROUP BY sentiment_label"""))
def _(spark, d):
    return reports.rating_sentiment_pivot(reports.rating_sentiment_matrix(*_both(spark, d)))


@query("negative_reviews", oracle("reviews", "review_ml", select="""
    SELECT review_key, product_id, rating, text, sentiment_score
    FROM reviews JOIN review_ml USING (review_key) WHERE sentiment_label = 'negative'
    QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY sentiment_score, review_key) <= 15"""))
def _(spark, d):
    return reports.negative_reviews(*_both(spark, d))


def _sampled(n: int) -> str:
    return oracle("reviews", "review_ml", select=f"""
    SELECT review_key, product_id, rating, sentiment_label, sentiment_score
    FROM reviews JOIN review_ml USING (review_key) WHERE sentiment_label IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY product_id
                               ORDER BY md5(concat('42:', review_key)), review_key) <= {n}""")


@query("sample_n", _sampled(500))
def _(spark, d):
    """The sample that the dashboard shows, 500 reviews of a product at most."""
    return reports.sample_reviews(*_both(spark, d))


@query("sample_n_of_15", _sampled(15))
def _(spark, d):
    """Fewer than most products have, so that the choice itself is compared."""
    return reports.sample_reviews(*_both(spark, d), n=15)


# Topic reports

_TOPIC_INDEX = """
    SELECT product_id, count(*) AS topic_count, CAST(sum(review_count) AS BIGINT) AS review_count
    FROM topics GROUP BY product_id ORDER BY review_count DESC, product_id LIMIT 100"""


@query("products_with_topics", oracle("topics", select=_TOPIC_INDEX))
def _(spark, d):
    return reports.products_with_topics(t.topics(spark, d))


@query("topics_totals", oracle("topics", i=_TOPIC_INDEX, select="""
    SELECT count(*) AS products, CAST(sum(review_count) AS BIGINT) AS reviews FROM i"""))
def _(spark, d):
    return reports.topics_totals(reports.products_with_topics(t.topics(spark, d)))


@query("topic_index_labels", oracle("topics", i=_TOPIC_INDEX, select="""
    SELECT product_id, format('Product {}  ({} topics, {:,} reviews)', product_id, topic_count,
                              review_count) AS label FROM i"""))
def _(spark, d):
    return reports.topic_index_labels(reports.products_with_topics(t.topics(spark, d)))


@query("product_topics", oracle("topics", select="""
    SELECT product_id, topic_id, polarity, keywords, review_count FROM topics"""))
def _(spark, d):
    return reports.product_topics(t.topics(spark, d))


@query("topic_reviews", oracle("reviews", "review_ml", select="""
    SELECT review_key, text, rating, topic_id, sentiment_label, sentiment_score
    FROM reviews JOIN review_ml USING (review_key) WHERE topic_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY topic_id
                               ORDER BY sentiment_score DESC, review_key) <= 20"""))
def _(spark, d):
    return reports.topic_reviews(*_both(spark, d))


@query("topic_label", oracle("topics", select="""
    SELECT topic_id, concat('[', topic_id, '] ', substring(keywords, 1, 50), '…  (', review_count,
                            ' reviews)') AS label FROM topics"""))
def _(spark, d):
    return reports.topic_labels(t.topics(spark, d))


# Rating gap and impact

def _gaps(spark, d):
    return impact.rating_gaps(*_both(spark, d))


def _histogram(value: str, source: str, bins: int) -> str:
    return f"""
    SELECT CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / (hi - lo) * {bins}), {bins - 1})
                     ELSE 0 END AS INTEGER) AS bin, count(*) AS n
    FROM (SELECT {value} AS v, min({value}) OVER () AS lo, max({value}) OVER () AS hi
          FROM {source} WHERE {value} IS NOT NULL) GROUP BY bin"""


@query("rating_gap", oracle("gaps", select="SELECT * FROM gaps"))
def _(spark, d):
    return reports.rating_gap_listing(_gaps(spark, d))


@query("rating_gap_summary", oracle("gaps", select="""
    SELECT count(*) AS products, count(*) FILTER (gap > 0) AS with_positive_gap,
           max(gap) AS max_gap, round(avg(gap), 9) AS avg_gap FROM gaps"""))
def _(spark, d):
    # The mean of quotients depends on the order of summation in its last digits.
    return reports.rating_gap_summary(_gaps(spark, d)).withColumn("avg_gap", F.round("avg_gap", 9))


@query("rating_gap_range", oracle("gaps", select="""
    SELECT least(min(pred_avg), min(real_avg)) - 0.1::DOUBLE AS low,
           greatest(max(pred_avg), max(real_avg)) + 0.1::DOUBLE AS high FROM gaps"""))
def _(spark, d):
    return reports.rating_gap_range(_gaps(spark, d))


@query("gap_histogram", oracle("gaps", select=_histogram("gap", "gaps", 60)))
def _(spark, d):
    return reports.histogram(_gaps(spark, d), "gap", 60)


@query("impact_gap_histogram", oracle("effects", select=_histogram("rating_gap", "effects", 80)))
def _(spark, d):
    return reports.histogram(impact.effects(_gaps(spark, d)), "rating_gap", 80)


@query("top_gap_products", oracle("gaps", select="""
    SELECT product_id, review_count, CAST(printf('%.3f', real_avg) AS DOUBLE) AS real_avg,
           CAST(printf('%.3f', pred_avg) AS DOUBLE) AS pred_avg,
           CAST(printf('%.3f', gap) AS DOUBLE) AS gap
    FROM (SELECT * FROM gaps ORDER BY gap DESC NULLS FIRST, product_id LIMIT 30)"""))
def _(spark, d):
    return reports.top_gap_products(_gaps(spark, d))


@query("impact_per_product", oracle("effects", select="SELECT * FROM effects"))
def _(spark, d):
    return impact.per_product(*_both(spark, d))


@query("impact_one_product", oracle("reviews", "review_ml", g="""
    SELECT product_id, count(*) AS review_count, avg(rating) AS real_avg,
           avg(predicted_rating) AS pred_avg, avg(rating) - avg(predicted_rating) AS gap
    FROM reviews JOIN review_ml USING (review_key)
    WHERE predicted_rating IS NOT NULL GROUP BY product_id""", select="""
    SELECT product_id, review_count,
           CAST(printf('%.3f', real_avg) AS DOUBLE) AS real_avg_rating,
           CAST(printf('%.3f', pred_avg) AS DOUBLE) AS predicted_avg_rating,
           CAST(printf('%.3f', gap) AS DOUBLE) AS rating_gap,
           CAST(printf('%.4f', greatest(0, gap * 0.2::DOUBLE)) AS DOUBLE) AS conversion_drop_pct,
           CAST(printf('%.2f', 500.0::DOUBLE * greatest(0, gap * 0.2::DOUBLE) * 250.0::DOUBLE)
                AS DOUBLE) AS lost_revenue
    FROM g WHERE real_avg <> 0"""))
def _(spark, d):
    return impact.for_products(
        *_both(spark, d), conversion_per_star=0.2, monthly_sales=500, avg_price=250
    )


@query("impact_product_prices", oracle("gaps", select="""
    SELECT product_id, review_count,
           CAST(printf('%.3f', real_avg) AS DOUBLE) AS real_avg_rating,
           CAST(printf('%.3f', pred_avg) AS DOUBLE) AS predicted_avg_rating,
           CAST(printf('%.3f', gap) AS DOUBLE) AS rating_gap,
           CAST(printf('%.4f', greatest(0, gap * 0.15::DOUBLE)) AS DOUBLE) AS conversion_drop_pct,
           CAST(printf('%.2f', 1000.0::DOUBLE * greatest(0, gap * 0.15::DOUBLE) * p_retailprice)
                AS DOUBLE) AS lost_revenue
    FROM gaps JOIN part ON p_partkey = product_id"""))
def _(spark, d):
    prices = t.table(spark, d, "part").select(F.col("p_partkey").alias("product_id"), "p_retailprice")
    return impact.effects(_gaps(spark, d).join(prices, "product_id"), avg_price=F.col("p_retailprice"))


@query("impact_summary", oracle("effects", select="""
    SELECT count(*) AS total_products, count(*) FILTER (rating_gap > 0) AS products_with_gap,
           CAST(printf('%.4f', coalesce(avg(rating_gap), 0)) AS DOUBLE) AS avg_gap,
           CAST(printf('%.4f', coalesce(max(rating_gap), 0)) AS DOUBLE) AS max_gap,
           CAST(printf('%.2f', coalesce(sum(lost_revenue), 0)) AS DOUBLE) AS total_lost_revenue,
           CAST(printf('%.2f', coalesce(avg(lost_revenue), 0)) AS DOUBLE)
                AS avg_lost_revenue_per_product
    FROM effects"""))
def _(spark, d):
    return impact.summary(impact.effects(_gaps(spark, d)))


@query("impact_top", oracle("effects", select="""
    SELECT * FROM effects ORDER BY lost_revenue DESC, product_id LIMIT 10"""))
def _(spark, d):
    return impact.top_by_lost_revenue(impact.effects(_gaps(spark, d)), 10)


@query("impact_top20", oracle("effects", select="""
    SELECT product_id, review_count, rating_gap,
           CAST(printf('%.1f', conversion_drop_pct * 100) AS DOUBLE) AS conversion_drop_percent,
           lost_revenue
    FROM effects ORDER BY lost_revenue DESC, product_id LIMIT 20"""))
def _(spark, d):
    return impact.top_with_drop_percent(impact.effects(_gaps(spark, d)))


# Incremental stages

def _pending(column: str) -> str:
    return f"""SELECT review_key, text_clean FROM reviews LEFT JOIN review_ml USING (review_key)
               WHERE text_clean <> '' AND {column} IS NULL"""


@query("pending_sentiment", oracle("reviews", "review_ml", select=_pending("sentiment_label")))
def _(spark, d):
    return incremental.pending_sentiment(*_both(spark, d))


@query("pending_embedding", oracle("reviews", "review_ml", select=_pending("embedding")))
def _(spark, d):
    return incremental.pending_embedding(*_both(spark, d))


_READY = "embedding IS NOT NULL AND sentiment_label IS NOT NULL"


@query("cluster_ready_products", oracle("reviews", "review_ml", select=f"""
    SELECT DISTINCT product_id FROM reviews JOIN review_ml USING (review_key) WHERE {_READY}"""))
def _(spark, d):
    return incremental.cluster_ready_products(*_both(spark, d))


@query("cluster_input", oracle("reviews", "review_ml", select=f"""
    SELECT product_id, review_key, coalesce(text_clean, '') AS text_clean, sentiment_label,
           CASE sentiment_label WHEN 'positive' THEN 'pos' WHEN 'negative' THEN 'neg' END AS polarity,
           CAST(embedding[1] AS DOUBLE) AS e1, CAST(embedding[2] AS DOUBLE) AS e2
    FROM reviews JOIN review_ml USING (review_key) WHERE {_READY}"""))
def _(spark, d):
    e = F.col("embedding")
    return incremental.cluster_input(*_both(spark, d)).select(
        "product_id", "review_key", "text_clean", "sentiment_label", "polarity",
        e[0].cast("double").alias("e1"), e[1].cast("double").alias("e2"),
    )


@query("polarity", oracle("review_ml", select="""
    SELECT review_key, CASE sentiment_label WHEN 'positive' THEN 'pos' ELSE 'neg' END AS polarity
    FROM review_ml WHERE sentiment_label IN ('positive', 'negative')"""))
def _(spark, d):
    rows = t.review_ml(spark, d).select("review_key", polarity(F.col("sentiment_label")).alias("polarity"))
    return rows.where(F.col("polarity").isNotNull())


@query("normalise_label", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive'
                WHEN 'N' THEN 'neutral' END AS label
    FROM lineitem""")
def _(spark, d):
    raw = (
        F.when(F.col("l_returnflag") == "R", "Negative").when(F.col("l_returnflag") == "A", "POSITIVE")
        .otherwise("LABEL_7")
    )
    return t.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", normalise_label(raw).alias("label")
    )


_ML_OUT = """coalesce(m.review_key, s.review_key) AS review_key, {label} AS sentiment_label,
             {score} AS sentiment_score, m.topic_id AS topic_id, {predicted} AS predicted_rating,
             CAST({embedding} AS DOUBLE) AS e1"""
_ML_KEEP = {"label": "m.sentiment_label", "score": "m.sentiment_score",
            "predicted": "m.predicted_rating", "embedding": "m.embedding[1]"}


def _ml_upsert(source: str, **new: str) -> str:
    columns = _ML_OUT.format(**{**_ML_KEEP, **{
        k: f"CASE WHEN s.review_key IS NOT NULL THEN {v} ELSE {_ML_KEEP[k]} END" for k, v in new.items()}})
    return oracle("reviews", "review_ml", s=source, select=f"""
        SELECT {columns} FROM review_ml m FULL JOIN s ON m.review_key = s.review_key""")


def _ml_view(df):
    return df.select(
        "review_key", "sentiment_label", "sentiment_score", "topic_id", "predicted_rating",
        F.col("embedding")[0].cast("double").alias("e1"),
    )


def _merged_ml(spark, d, source, update):
    """The stored model outputs after a merge that rewrites the buckets it touches."""
    store = jobs.ReviewStore(spark, shared_folder(spark))
    store.review_ml.write(t.review_ml(spark, d))
    store.review_ml.merge(source, update)
    return _ml_view(store.review_ml.read())


@query("ml_upsert_sentiment", _ml_upsert(
    "SELECT review_key, CASE WHEN rating >= 4 THEN 'positive' ELSE 'negative' END AS label, "
    "rating / 8 AS score FROM reviews WHERE rating IS NOT NULL",
    label="s.label", score="s.score"))
def _(spark, d):
    scored = t.reviews(spark, d).where(F.col("rating").isNotNull()).select(
        "review_key",
        F.when(F.col("rating") >= 4, "positive").otherwise("negative").alias("sentiment_label"),
        (F.col("rating") / 8).alias("sentiment_score"),
    )
    return _merged_ml(spark, d, scored, ["sentiment_label", "sentiment_score"])


@query("ml_upsert_embedding", _ml_upsert(
    "SELECT review_key, CAST(word_count AS FLOAT) AS e FROM reviews WHERE has_answer", embedding="s.e"))
def _(spark, d):
    vectors = t.reviews(spark, d).where("has_answer").select(
        "review_key", F.array(F.col("word_count").cast("float")).alias("embedding")
    )
    return _merged_ml(spark, d, vectors, ["embedding"])


@query("ml_upsert_predicted", _ml_upsert(
    "SELECT review_key, CAST(rating AS DOUBLE) AS p FROM reviews WHERE rating IS NOT NULL",
    predicted="s.p"))
def _(spark, d):
    predictions = t.reviews(spark, d).where(F.col("rating").isNotNull()).select(
        "review_key", F.col("rating").cast("double").alias("predicted_rating")
    )
    return _merged_ml(spark, d, predictions, ["predicted_rating"])


@query("clip_rating", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           greatest(1.0::DOUBLE, least(5.0::DOUBLE, l_quantity / 8)) AS clipped FROM lineitem""")
def _(spark, d):
    return t.table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        clip_rating(F.col("l_quantity") / 8).alias("clipped"),
    )


# A new clustering result: positive topics only, regrouped by the shipping line's colour.
_NEW_TOPICS = """
    SELECT concat_ws('|', product_id, 'pos', color) AS topic_id, product_id, 'pos' AS polarity,
           0 AS topic_no, color AS keywords, count(*) AS review_count
    FROM reviews JOIN review_ml USING (review_key)
    WHERE sentiment_label = 'positive' AND rating = 5 AND color IS NOT NULL
    GROUP BY product_id, color"""


def _new_topics(spark, d):
    rows = reports.enriched(*_both(spark, d)).where(
        (F.col("sentiment_label") == "positive") & (F.col("rating") == 5) & F.col("color").isNotNull()
    )
    return rows.groupBy("product_id", "color").agg(F.count("*").alias("review_count")).select(
        F.concat_ws("|", "product_id", F.lit("pos"), "color").alias("topic_id"), "product_id",
        F.lit("pos").alias("polarity"), F.lit(0).alias("topic_no"), F.col("color").alias("keywords"),
        "review_count",
    )


@query("topics_replace", oracle("reviews", "topics", n=_NEW_TOPICS, select="""
    SELECT * FROM topics t WHERE NOT EXISTS (
        SELECT 1 FROM n WHERE n.product_id = t.product_id AND n.polarity = t.polarity)
    UNION ALL SELECT * FROM n"""))
def _(spark, d):
    return merge.replace_groups(t.topics(spark, d), _new_topics(spark, d), ["product_id", "polarity"])


@query("topic_assign", oracle("reviews", "topics", n=_NEW_TOPICS, select="""
    SELECT m.review_key AS review_key,
           coalesce(CASE WHEN r.rating = 5 AND m.sentiment_label = 'positive' AND r.color IS NOT NULL
                         THEN concat_ws('|', r.product_id, 'pos', r.color) END,
                    CASE WHEN o.topic_id IS NULL THEN m.topic_id END) AS topic_id
    FROM review_ml m JOIN reviews r USING (review_key)
    LEFT JOIN (SELECT t.topic_id FROM topics t JOIN n USING (product_id, polarity)) o
         ON o.topic_id = m.topic_id"""))
def _(spark, d):
    reviews, review_ml = _both(spark, d)
    replaced = t.topics(spark, d).join(
        _new_topics(spark, d).select("product_id", "polarity"), ["product_id", "polarity"], "left_semi"
    )
    assigned = reports.enriched(reviews, review_ml).where(
        (F.col("sentiment_label") == "positive") & (F.col("rating") == 5) & F.col("color").isNotNull()
    ).select("review_key", F.concat_ws("|", "product_id", F.lit("pos"), "color").alias("topic_id"))
    moved = merge.reassign(review_ml, replaced, assigned, "review_key", "topic_id")
    return moved.select("review_key", "topic_id")


@query("scan_limit", """
    SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10000""")
def _(spark, d):
    orders = t.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return scan_limit(orders, 10_000, "o_orderkey")


# Listings of one product or topic, and the nested summary

_CHOSEN = "SELECT product_id FROM reviews GROUP BY product_id ORDER BY count(*) DESC, product_id LIMIT 1"


def _chosen_product(reviews):
    """The product with most reviews."""
    sizes = reviews.groupBy("product_id").agg(F.count("*").alias("n"))
    return sizes.orderBy(F.col("n").desc(), "product_id").first()["product_id"]


@query("product_sentiment_of_one", oracle("reviews", "review_ml", chosen=_CHOSEN, select="""
    SELECT product_id, review_key, sentiment_label, sentiment_score, rating, text
    FROM reviews JOIN review_ml USING (review_key)
    WHERE sentiment_label IS NOT NULL AND product_id = (FROM chosen)"""))
def _(spark, d):
    reviews, review_ml = _both(spark, d)
    return reports.product_sentiment(reviews, review_ml, product_id=_chosen_product(reviews))


@query("negative_reviews_of_one", oracle("reviews", "review_ml", chosen=_CHOSEN, select="""
    SELECT review_key, product_id, rating, text, sentiment_score
    FROM reviews JOIN review_ml USING (review_key)
    WHERE sentiment_label = 'negative' AND product_id = (FROM chosen)
    ORDER BY sentiment_score, review_key LIMIT 15"""))
def _(spark, d):
    reviews, review_ml = _both(spark, d)
    return reports.negative_reviews(reviews, review_ml, product_id=_chosen_product(reviews))


@query("topic_reviews_of_one", oracle("reviews", "review_ml", chosen="""
    SELECT topic_id FROM review_ml WHERE topic_id IS NOT NULL
    GROUP BY topic_id ORDER BY count(*) DESC, topic_id LIMIT 1""", select="""
    SELECT review_key, text, rating, topic_id, sentiment_label, sentiment_score
    FROM reviews JOIN review_ml USING (review_key) WHERE topic_id = (FROM chosen)
    ORDER BY sentiment_score DESC, review_key LIMIT 20"""))
def _(spark, d):
    reviews, review_ml = _both(spark, d)
    sizes = review_ml.where(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(F.count("*").alias("n"))
    chosen = sizes.orderBy(F.col("n").desc(), "topic_id").first()["topic_id"]
    return reports.topic_reviews(reviews, review_ml, topic_id=chosen)


@query("product_topics_of_one", oracle("reviews", "topics", chosen=_CHOSEN, select="""
    SELECT product_id, topic_id, polarity, keywords, review_count FROM topics
    WHERE product_id = (FROM chosen)"""))
def _(spark, d):
    return reports.product_topics(t.topics(spark, d), product_id=_chosen_product(_both(spark, d)[0]))


@query("impact_of_one", oracle("reviews", "review_ml", chosen=_CHOSEN, one="""
    SELECT product_id, count(*) AS review_count, avg(rating) AS real_avg, avg(predicted_rating) AS pred_avg,
           avg(rating) - avg(predicted_rating) AS gap
    FROM reviews JOIN review_ml USING (review_key)
    WHERE predicted_rating IS NOT NULL AND product_id = (FROM chosen) GROUP BY product_id""", select="""
    SELECT product_id, review_count, CAST(printf('%.3f', gap) AS DOUBLE) AS rating_gap FROM one"""))
def _(spark, d):
    reviews, review_ml = _both(spark, d)
    rows = impact.for_products(reviews, review_ml, [_chosen_product(reviews)])
    return rows.select("product_id", "review_count", "rating_gap")


@query("impact_summary_nested", oracle("effects", select="""
    SELECT (SELECT count(*) FROM effects) AS total_products, CAST(row_number() OVER (
           ORDER BY lost_revenue DESC, product_id) - 1 AS INTEGER) AS place, product_id, lost_revenue
    FROM effects QUALIFY place < 10"""))
def _(spark, d):
    nested = impact.summary_with_top(impact.effects(_gaps(spark, d)))
    return nested.select("total_products", F.posexplode("top_products").alias("place", "effect")).select(
        "total_products", "place", "effect.product_id", "effect.lost_revenue")
