"""Queries over vectors, topics, scoring and the rating model."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.functions import vectors as vx
from reviewmill.plans import incremental, jobs, rating, scoring, topics
from reviewmill.registry.base import KEYED, oracle, query, sql_clean
from reviewmill.registry.texts import _RUNS, _TERMS, _TOKENS
from reviewmill.session import shared_folder, staged
from reviewmill.sources import driver_tables as t


def _vectors(spark, d):
    return t.table(spark, d, "embeddings")


# Vectors

@query("vector_parse", """
    SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS value,
           generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings""")
def _(spark, d):
    parsed = vx.parse_vector(vx.format_vector(F.col("embedding")))
    return _vectors(spark, d).select("vec_id", F.posexplode(parsed).alias("pos", "x")).select(
        "vec_id", F.col("x").cast("double").alias("value"), F.col("pos").cast("bigint").alias("pos")
    )


@query("l2_normalise", """
    SELECT vec_id, CAST(CAST(x / sqrt(squares) AS FLOAT) AS DOUBLE) AS value, pos
    FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x,
                 generate_subscripts(embedding, 1) - 1 AS pos,
                 list_reduce(list_transform(embedding, lambda e: CAST(e AS DOUBLE) * CAST(e AS DOUBLE)),
                             lambda a, b: a + b) AS squares
          FROM embeddings)""")
def _(spark, d):
    unit = vx.l2_normalise(F.col("embedding"))
    return _vectors(spark, d).select("vec_id", F.posexplode(unit).alias("pos", "x")).select(
        "vec_id", F.col("x").cast("double").alias("value"), F.col("pos").cast("bigint").alias("pos")
    )


@query("softmax_argmax", """
    SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best,
           round(1 / list_sum(list_transform(embedding,
                 lambda e: exp(CAST(e AS DOUBLE) - CAST(list_max(embedding) AS DOUBLE)))), 9) AS score
    FROM embeddings""")
def _(spark, d):
    rows = _vectors(spark, d).select("vec_id", vx.softmax(F.col("embedding")).alias("p"))
    return rows.select(
        "vec_id", vx.argmax(F.col("p")).alias("best"), F.round(F.array_max("p"), 9).alias("score")
    )


# Deduplication and scoring

@query("dedup_texts", "SELECT text AS text_clean, count(*) AS copies FROM documents GROUP BY text")
def _(spark, d):
    return scoring.distinct_texts(
        t.texts(spark, d, "documents", "doc_id").select(F.col("text").alias("text_clean"))
    )


@query("dedup_score_join", "SELECT doc_id AS review_key, length(text) / 2 AS score FROM documents")
def _(spark, d):
    rows = t.texts(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("review_key"), F.col("text").alias("text_clean")
    )
    return scoring.score_once(
        rows, lambda texts: texts.withColumn("score", F.char_length("text_clean") / 2)
    )


def _documents(spark, d):
    """Documents as a stored table of cleaned reviews, one product per language."""
    return staged(t.texts(spark, d, "documents", "doc_id").select(
        F.col("doc_id").alias("review_key"), F.col("lang").alias("product_id"),
        tx.clean_text(F.col("text")).alias("text_clean"),
    ))


def _weak_labels(spark, d):
    label = (
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive")
        .otherwise("neutral").alias("sentiment_label")
    )
    return t.table(spark, d, "labels").select(F.col("doc_id").alias("review_key"), label)


def _sentiment_model(spark, d, rows):
    return scoring.train_sentiment(rows.join(_weak_labels(spark, d), "review_key"))


def _labelled_documents(spark, d):
    """What the sentiment model learns from; only documents with labels are cleaned."""
    rows = t.texts(spark, d, "documents", "doc_id").select(F.col("doc_id").alias("review_key"), "text").join(
        _weak_labels(spark, d), "review_key")
    return staged(rows.select("sentiment_label", tx.clean_text(F.col("text")).alias("text_clean")))


def _no_outputs(rows):
    """An empty model table: everything is still to be scored."""
    return rows.where(F.lit(False)).select(
        "review_key", F.lit(None).cast("string").alias("sentiment_label"),
        F.lit(None).cast("array<float>").alias("embedding"),
    )


_PENDING = f"""
    SELECT doc_id AS review_key, text_clean FROM (
        SELECT doc_id, {sql_clean('text')} AS text_clean FROM documents) WHERE text_clean <> ''"""


@query("sentiment_score", oracle(p=_PENDING, select="""
    SELECT review_key, true AS valid, true AS same_for_copies FROM p"""))
def _(spark, d):
    """A label of the set and a probability for every pending review; copies of a text agree."""
    rows = _documents(spark, d)
    scorer = scoring.model_sentiment(_sentiment_model(spark, d, rows))
    scored = staged(scoring.score_sentiment(rows, _no_outputs(rows), scorer).join(
        rows.select("review_key", F.sha2("text_clean", 256).alias("digest")), "review_key"))
    valid = F.col("sentiment_label").isin("positive", "neutral", "negative") & F.col("sentiment_score").between(0, 1)
    per_text = scored.groupBy("digest").agg(
        (F.count_distinct("sentiment_label", "sentiment_score") == 1).alias("same_for_copies"))
    return scored.join(per_text, "digest").select("review_key", valid.alias("valid"), "same_for_copies")


@query("embed_text", oracle(p=_PENDING, select="""
    SELECT review_key, 384 AS dim, 1.0::DOUBLE AS norm FROM p"""))
def _(spark, d):
    """A unit vector for every pending review."""
    rows = _documents(spark, d)
    scorer = scoring.model_embedding(scoring.train_embedding(rows))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return scoring.embed(rows, _no_outputs(rows), scorer).select(
        "review_key", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


_LABELS = ["positive", "neutral", "negative"]


def _length_logits():
    """A caller's classifier: the length of the text decides."""
    import numpy as np

    def predict(texts):
        out = np.zeros((len(texts), 3), np.float32)
        out[np.arange(len(texts)), [len(str(t)) % 3 for t in texts]] = 4
        return out
    return predict


def _length_vector():
    """A caller's encoder: the length of the text and one."""
    import numpy as np

    return lambda texts: np.array([[len(str(t)), 1.0] for t in texts], np.float32).reshape(-1, 2)


@query("sentiment_by_caller", oracle(p=_PENDING, select="""
    SELECT review_key, ['positive', 'neutral', 'negative'][length(text_clean) % 3 + 1] AS sentiment_label,
           round(exp(4.0::DOUBLE) / (exp(4.0::DOUBLE) + 2), 5) AS sentiment_score FROM p"""))
def _(spark, d):
    rows = _documents(spark, d)
    scored = scoring.score_sentiment(rows, _no_outputs(rows), scoring.batch_sentiment(_length_logits, _LABELS))
    return scored.select("review_key", "sentiment_label", F.round("sentiment_score", 5).alias("sentiment_score"))


@query("embedding_by_caller", oracle(p=_PENDING, select="""
    SELECT review_key, round(n / sqrt(n * n + 1), 4) AS x, round(1 / sqrt(n * n + 1), 4) AS y
    FROM (SELECT review_key, length(text_clean)::DOUBLE AS n FROM p)"""))
def _(spark, d):
    rows = _documents(spark, d)
    vectors = scoring.embed(rows, _no_outputs(rows), scoring.batch_embedding(_length_vector))
    return vectors.select("review_key", *[
        F.round(F.col("embedding")[i].cast("double"), 4).alias(name) for i, name in enumerate("xy")])


# Topics

@query("topic_cluster", """
    WITH sized AS (
        SELECT CAST(doc_id % 2 AS VARCHAR) AS half, lang, count(*) AS n FROM documents GROUP BY ALL),
    large AS (SELECT half FROM sized GROUP BY half HAVING sum(n) >= 50),
    numbered AS (
        SELECT half, lang, row_number() OVER (PARTITION BY half ORDER BY n DESC) - 1 AS topic_no
        FROM sized WHERE n >= 10)
    SELECT 'all' AS product_id, CASE half WHEN '0' THEN 'pos' ELSE 'neg' END AS polarity,
           doc_id AS review_key, CAST(coalesce(topic_no, -1) AS INTEGER) AS topic_no
    FROM documents JOIN large ON half = CAST(doc_id % 2 AS VARCHAR) LEFT JOIN numbered USING (half, lang)""")
def _(spark, d):
    """Document vectors that gather around one axis per language that occurs, so the topics are the languages."""
    docs = t.table(spark, d, "documents")
    lean = F.least(F.col("n_chars") / 20_000, F.lit(1.0)) * 0.2
    langs = sorted(r[0] for r in docs.select("lang").distinct().dropna().collect())
    axes = [(F.coalesce("lang", F.lit("")) == lang).cast("float") for lang in langs]
    rows = docs.select(
        F.lit("all").alias("product_id"), F.when(F.col("doc_id") % 2 == 0, "pos").otherwise("neg").alias("polarity"),
        F.col("doc_id").alias("review_key"), F.array(*axes, lean.cast("float")).alias("embedding"),
    )
    return topics.cluster_reviews(rows).withColumn("topic_no", F.col("topic_no").cast("int"))


@query("topic_sizes", oracle("topics", select="""
    SELECT product_id, polarity, topic_no, review_count FROM topics"""))
def _(spark, d):
    part = F.split("topic_id", r"\|")
    assigned = t.review_ml(spark, d).where(F.col("topic_id").isNotNull()).select(
        "review_key", part[0].cast("bigint").alias("product_id"), part[1].alias("polarity"),
        part[2].cast("int").alias("topic_no"),
    )
    return topics.topic_sizes(assigned)


@query("topic_keywords", oracle(
    runs=_RUNS, tokens=_TOKENS, terms=_TERMS,
    counted="""SELECT lang, source, term, count(*) AS tf
               FROM terms JOIN documents USING (doc_id) GROUP BY ALL""",
    per_class="SELECT lang, source, sum(tf) AS class_terms FROM counted GROUP BY ALL",
    per_group="SELECT lang, avg(class_terms) AS mean_terms FROM per_class GROUP BY lang",
    per_term="SELECT lang, term, sum(tf) AS term_tf FROM counted GROUP BY ALL",
    ranked="""SELECT lang, source, term, row_number() OVER (PARTITION BY lang, source ORDER BY
                  round(tf / class_terms * ln(1 + mean_terms / term_tf), 12) DESC, term) AS place
              FROM counted JOIN per_class USING (lang, source) JOIN per_group USING (lang)
              JOIN per_term USING (lang, term)""",
    select="""SELECT lang, source, string_agg(term, ', ' ORDER BY place) AS keywords
              FROM ranked WHERE place <= 10 GROUP BY lang, source"""))
def _(spark, d):
    rows = t.texts(spark, d, "documents", "doc_id").select("lang", "source", F.col("text").alias("text_clean"))
    return topics.topic_keywords(rows, ["lang"], "source")


# Rating model

_RATING_INPUT = """
    SELECT review_key, review_length, word_count, answer_length, CAST(has_answer AS INTEGER) AS has_answer,
           color, rating, sentiment_label, sentiment_score
    FROM reviews JOIN review_ml USING (review_key)
    WHERE rating IS NOT NULL AND sentiment_label IS NOT NULL AND sentiment_score IS NOT NULL"""


def _rating_input(spark, d):
    return incremental.rating_input(t.reviews(spark, d), t.review_ml(spark, d))


@query("rating_input", oracle("reviews", "review_ml", select=_RATING_INPUT))
def _(spark, d):
    return _rating_input(spark, d)


@query("min_class_count", oracle("reviews", "review_ml", i=_RATING_INPUT, select="""
    SELECT min(n) AS min_count FROM (SELECT count(*) AS n FROM i GROUP BY rating)"""))
def _(spark, d):
    return rating.min_class_count(_rating_input(spark, d))


_SPLIT = """
    SELECT *, row_number() OVER (PARTITION BY rating ORDER BY md5(concat('42:', review_key)))
              <= ceil(count(*) OVER (PARTITION BY rating) * 0.2::DOUBLE) AS validation FROM i"""


@query("stratified_split", oracle("reviews", "review_ml", i=_RATING_INPUT, s=_SPLIT, select="""
    SELECT review_key, rating, validation FROM s"""))
def _(spark, d):
    return rating.split(_rating_input(spark, d)).select("review_key", "rating", "validation")


def _code(name: str) -> str:
    return f"""
    SELECT {name}, (sum(rating)::DOUBLE + 10 * (SELECT avg(rating) FROM s WHERE NOT validation))
                   / (count(*) + 10) AS {name}_code
    FROM s WHERE NOT validation GROUP BY 1"""


def _ordered(name: str) -> str:
    """The code from the training rows before, or from all of them for a validation row."""
    return f"""
           CASE WHEN validation THEN coalesce({name}_code, (SELECT avg(rating) FROM s WHERE NOT validation))
                ELSE (coalesce(sum(rating) OVER {name}_before, 0)::DOUBLE
                      + 10 * (SELECT avg(rating) FROM s WHERE NOT validation))
                     / (count(*) OVER {name}_before + 10) END AS {name}_code"""


def _before(name: str) -> str:
    return f"""{name}_before AS (
        PARTITION BY validation, {name} ORDER BY md5(concat('order:42:', review_key)), review_key
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


@query("rating_features", oracle(
    "reviews", "review_ml", i=_RATING_INPUT, s0=_SPLIT,
    s="SELECT * REPLACE (coalesce(color, 'unknown') AS color) FROM s0",
    a=_code("sentiment_label"), b=_code("color"),
    select=f"""
    SELECT review_key, review_length::DOUBLE AS review_length, word_count::DOUBLE AS word_count,
           answer_length::DOUBLE AS answer_length, sentiment_score, has_answer::DOUBLE AS has_answer,
           {_ordered("sentiment_label")}, {_ordered("color")}
    FROM s LEFT JOIN a USING (sentiment_label) LEFT JOIN b USING (color)
    WINDOW {_before("sentiment_label")}, {_before("color")}"""))
def _(spark, d):
    parts = staged(rating.split(_rating_input(spark, d)))
    fit_rows = parts.where(~F.col("validation"))
    mean = rating.mean_rating(fit_rows)
    others = rating.encoded(parts.where("validation"), rating.encodings(fit_rows, mean), mean)
    columns = ["review_key", *rating.NUMERIC, *[f"{c}_code" for c in rating.CATEGORICAL]]
    return rating.ordered(fit_rows, mean).select(*columns).unionByName(others.select(*columns))


@query("rating_metrics", oracle("reviews", "review_ml", select="""
    SELECT round(sqrt(avg((predicted_rating - rating) * (predicted_rating - rating))), 9) AS rmse,
           avg(abs(predicted_rating - rating)) AS mae
    FROM reviews JOIN review_ml USING (review_key)
    WHERE rating IS NOT NULL AND predicted_rating IS NOT NULL"""))
def _(spark, d):
    rows = t.reviews(spark, d).join(t.review_ml(spark, d), "review_key").where(
        F.col("rating").isNotNull() & F.col("predicted_rating").isNotNull()
    )
    return rating.metrics(rows, "rating", "predicted_rating").withColumn("rmse", F.round("rmse", 9))


@query("prediction_stats", oracle("review_ml", select="""
    SELECT count(predicted_rating) AS n, avg(predicted_rating) AS mean,
           round(stddev_pop(predicted_rating), 9) AS std FROM review_ml"""))
def _(spark, d):
    stats = rating.prediction_stats(t.review_ml(spark, d))
    return stats.withColumn("std", F.round("std", 9))


def _in_range():
    return F.col("predicted_rating").between(1, 5).alias("in_range")


@query("rating_train", oracle("reviews", "review_ml", i=_RATING_INPUT, select="""
    SELECT count(*) AS rows, true AS has_rounds, true AS beats_no_model, true AS importances_sum_to_one FROM i"""))
def _(spark, d):
    """The full number of rounds; on the held-out rows the model errs less than their mean does."""
    rows = staged(_rating_input(spark, d))
    model, scores = rating.train(rows)
    spread = rating.split(rows).where("validation").agg(F.stddev_pop(F.col("rating").cast("double"))).first()[0]
    return rows.agg(
        F.count("*").alias("rows"), F.lit(1 <= scores["best_iteration"] <= rating.ROUNDS).alias("has_rounds"),
        F.lit(scores["val_rmse"] < spread).alias("beats_no_model"),
        F.lit(abs(sum(model.importances().values()) - 1) < 1e-9).alias("importances_sum_to_one"))


@query("rating_predict", oracle("reviews", "review_ml", i=_RATING_INPUT, select="""
    SELECT review_key, true AS in_range FROM i"""))
def _(spark, d):
    rows = staged(_rating_input(spark, d))
    return rating.train(rows)[0].predict(rows).select("review_key", _in_range())


@query("rating_predictions")
def _(spark, d):
    """The predicted ratings themselves, which SQL can't give; the tests boost row by row in plain Python."""
    rows = staged(_rating_input(spark, d))
    return rating.train(rows)[0].predict(rows)


@query("rating_model_io", oracle("reviews", "review_ml", i=_RATING_INPUT, select="""
    SELECT review_key, true AS in_range, true AS same_as_before FROM i"""))
def _(spark, d):
    """Predictions of the stored model, loaded again, equal those of the model in memory."""
    rows, path = staged(_rating_input(spark, d)), shared_folder(spark)
    model = rating.train(rows)[0]
    model.save(path)
    before = model.predict(rows).withColumnRenamed("predicted_rating", "before")
    loaded = rating.RatingModel.load(spark, path).predict(rows)
    return loaded.join(before, "review_key").select(
        "review_key", _in_range(), (F.col("before") == F.col("predicted_rating")).alias("same_as_before"))


@query("rating_job", oracle("reviews", "review_ml", i=_RATING_INPUT, select="""
    SELECT count(*) AS n, true AS mean_in_range, true AS std_in_range FROM i"""))
def _(spark, d):
    """The statistics the job reports are those of the rows that it has scored."""
    store = jobs.ReviewStore(spark, shared_folder(spark))
    reviews = t.reviews(spark, d).withColumn("product_id", F.col("product_id").cast("string"))
    store.reviews.write(reviews)
    store.review_ml.write(t.review_ml(spark, d))
    return jobs.rating_job(store).select(
        "n", F.col("mean").between(1, 5).alias("mean_in_range"), F.col("std").between(0, 2).alias("std_in_range"))


@query("enrich_reviews", oracle("feedback", k=KEYED, select="""
    SELECT DISTINCT review_key, true AS has_sentiment, true AS has_embedding, true AS has_prediction,
           true AS topic_is_known FROM k"""))
def _(spark, d):
    """Both stages over the documents: every review has all outputs, and its topic is in the topics table."""
    store = jobs.ReviewStore(spark, shared_folder(spark))
    jobs.ingest_job(store, t.feedback(spark, d))
    sentiment = scoring.model_sentiment(scoring.train_sentiment(_labelled_documents(spark, d)))
    embedding = scoring.model_embedding(scoring.train_embedding(store.reviews.read()))
    jobs.enrich(store, sentiment, embedding, topics.ClusterSettings(eps=0.5))
    found = store.topics.read().select("topic_id", F.lit(True).alias("known"))
    return store.review_ml.read().join(found, "topic_id", "left").select(
        "review_key", F.col("sentiment_label").isNotNull().alias("has_sentiment"),
        F.col("embedding").isNotNull().alias("has_embedding"),
        F.col("predicted_rating").isNotNull().alias("has_prediction"),
        (F.col("topic_id").isNull() | F.col("known").isNotNull()).alias("topic_is_known"),
    )
