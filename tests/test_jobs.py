"""Scoring, rating model, snapshots and the jobs built from them."""

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from reviewmill.plans import impact, incremental, jobs, rating, reports, scoring, topics
from __spark_entry__ import queries
from reviewmill.schema import REVIEW_ML, TOPICS
from reviewmill.sources.feedback import read_feedback, scan_limit
from reviewmill.sources.snapshots import SnapshotTable, save_bucketed


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file


def length_logits():
    """Short texts negative, long ones positive."""
    def predict(texts):
        n = np.array([len(t) for t in texts], dtype=np.float32)
        return np.stack([n - 15, np.zeros_like(n), 15 - n], axis=1)
    return predict


def letter_counts():
    def predict(texts):
        return np.array([[t.count("a"), t.count("b"), 1] for t in texts], dtype=np.float32)
    return predict


def reviews(spark, texts):
    return spark.createDataFrame(
        [(f"k{i:04d}", t) for i, t in enumerate(texts)], "review_key string, text_clean string"
    )


def test_caller_model_scores_each_text_once(spark):
    texts = ["tiny text a"] * 300 + ["a rather long review text"] * 2 + ["x y z"]
    empty = spark.createDataFrame([], REVIEW_ML)
    inner = scoring.batch_sentiment(length_logits, ["Positive", "Label_9", "NEGATIVE"], batch_size=4)
    seen = []

    def scorer(df):
        seen.append(df.count())
        return inner(df)

    pending = incremental.pending_sentiment(reviews(spark, texts), empty)
    scored = scoring.score_once(pending, scorer, hot_rows=100)
    assert plan(scored).count("MapInPandas") == 1
    rows = scored.collect()
    assert seen == [3]
    got = {r.review_key: (r.sentiment_label, r.sentiment_score) for r in rows}
    assert len(rows) == len(got) == 303
    assert got["k0000"][0] == "negative" and got["k0300"][0] == "positive" and got["k0302"][0] == "negative"
    logits = np.array([-4.0, 0.0, 4.0])
    assert got["k0000"][1] == pytest.approx(np.exp(4) / np.exp(logits).sum(), rel=1e-6)


def test_batches_keep_to_rows_and_padded_tokens():
    lengths = [900, 500, 40, 40, 39, 38, 10, 10, 10, 10, 1]
    got = list(scoring.padded_batches(lengths, 4, 100))
    assert got == [(0, 1), (1, 2), (2, 4), (4, 6), (6, 10), (10, 11)]
    assert list(scoring.padded_batches([], 4, 100)) == []


def failing_logits():
    def predict(texts):
        if any("bomb" in t for t in texts):
            raise ValueError("no bombs")
        return np.array([[len(t), 0, 0] for t in texts], np.float32)
    return predict


def broken_model():
    raise OSError("no such model")


def test_a_failing_model_leaves_the_other_results(spark, tmp_path):
    store = jobs.ReviewStore(spark, str(tmp_path / "store"), buckets=2)
    raw = spark.createDataFrame(
        [(i, 1, f"some good text {i}" + " bomb" * (i % 10 == 3), 4, None, None) for i in range(40)],
        "seq long, nmId long, text string, productValuation int, color string, answer string")
    jobs.ingest_job(store, raw)
    labels = ["positive", "neutral", "negative"]
    jobs.sentiment_job(store, scoring.batch_sentiment(failing_logits, labels, batch_size=7))
    jobs.embedding_job(store, scoring.batch_embedding(broken_model))
    ml = store.review_ml.read()
    assert ml.where("sentiment_label = 'positive'").count() == 36 and ml.where("embedding IS NOT NULL").count() == 0
    found = [tuple(r)[::2] for r in store.errors.read().collect()]
    assert found.count(("sentiment", "ValueError: no bombs")) == 4
    assert found.count(("embedding", "RuntimeError: OSError: no such model")) == 40
    # Reviews that failed are still pending; a sound model takes them, and their errors go.
    jobs.sentiment_job(store, scoring.batch_sentiment(length_logits, labels))
    assert store.review_ml.read().where("sentiment_label IS NOT NULL").count() == 40
    assert {r.stage for r in store.errors.read().collect()} == {"embedding"}


def test_groups_with_bad_vectors_are_told(spark):
    rows = spark.createDataFrame(
        [("p", "pos", "a", None), ("p", "pos", "b", [0.0, 0.0]), ("q", "neg", "c", [1.0, float("nan")]), ("q", "pos", "d", [1.0, 2.0])],
        "product_id string, polarity string, review_key string, embedding array<float>")
    got = {tuple(r) for r in topics.unusable(rows).collect()}
    assert got == {("p|pos", "2 vectors are null, zero or not finite"), ("q|neg", "1 vectors are null, zero or not finite")}


def test_caller_encoder_gives_unit_vectors(spark):
    empty = spark.createDataFrame([], REVIEW_ML)
    rows = scoring.embed(reviews(spark, ["a b a", "b b b"]), empty, scoring.batch_embedding(letter_counts)).collect()
    got = {r.review_key: r.embedding for r in rows}
    assert got["k0000"] == pytest.approx(np.array([2, 1, 1]) / np.sqrt(6), abs=1e-6)
    assert got["k0001"] == pytest.approx(np.array([0, 3, 1]) / np.sqrt(10), abs=1e-6)


def test_empty_input_gives_empty_output(spark):
    empty = spark.createDataFrame([], REVIEW_ML)
    none = reviews(spark, ["x"]).where("false")
    assert scoring.embed(none, empty, scoring.batch_embedding(letter_counts)).count() == 0


def test_word_model_learns(spark):
    texts = ["good shoes"] * 30 + ["bad shoes"] * 30 + ["plain shoes"] * 30
    labels = ["positive"] * 30 + ["negative"] * 30 + ["neutral"] * 30
    labelled = spark.createDataFrame(list(zip(texts, labels)), "text_clean string, sentiment_label string")
    scorer = scoring.model_sentiment(scoring.train_sentiment(labelled, features=64))
    out = scoring.score_sentiment(
        reviews(spark, ["very good shoes", "bad bad"]), spark.createDataFrame([], REVIEW_ML), scorer)
    got = {r.review_key: r for r in out.collect()}
    assert got["k0000"].sentiment_label == "positive" and got["k0001"].sentiment_label == "negative"
    assert all(1 / 3 < r.sentiment_score <= 1 for r in got.values())


def rating_rows(spark, n=600):
    """The colour decides most of the rating."""
    return spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("review_key"),
        (F.col("id") % 90).cast("int").alias("review_length"),
        F.when(F.col("id") % 7 > 0, (F.col("id") % 30).cast("int")).alias("word_count"),
        F.lit(0).alias("answer_length"), (F.col("id") % 2).cast("int").alias("has_answer"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("c"), F.col("id") % 5)).alias("color"),
        (F.col("id") % 5 + 1).cast("int").alias("rating"),
        F.lit("positive").alias("sentiment_label"), F.lit(0.5).alias("sentiment_score"),
    )


def test_split_is_stratified_and_repeatable(spark):
    rows = rating_rows(spark)
    parts = rating.split(rows)
    sizes = {r.rating: (r.n, r.v) for r in parts.groupBy("rating").agg(
        F.count("*").alias("n"), F.count_if("validation").alias("v")).collect()}
    assert sizes == {s: (120, 24) for s in range(1, 6)}
    again = rating.split(rows.repartition(13))
    key = lambda df: {r.review_key for r in df.where("validation").collect()}
    assert key(parts) == key(again)


def test_split_without_strata(spark):
    rows = rating_rows(spark, 50).where("rating < 5 or review_key = 'k4'")
    assert rating.split(rows).where("validation").count() == 9  # ceil(41 / 5)


def test_training_beats_the_mean_and_stays_in_range(spark, tmp_path):
    rows = rating_rows(spark)
    model, scores = rating.train(rows, rounds=6, rate=0.3)
    assert 1 <= scores["best_iteration"] <= 6
    assert scores["val_mae"] <= scores["val_rmse"] < 1.2  # the mean alone gives 1.41
    model.save(str(tmp_path / "m"))
    loaded = rating.RatingModel.load(spark, str(tmp_path / "m"))
    new = rows.limit(20).withColumn("color", F.lit("never seen"))
    for data in (rows, new):
        want = sorted(map(tuple, model.predict(data).collect()))
        assert sorted(map(tuple, loaded.predict(data).collect())) == want
        assert all(1.0 <= p <= 5.0 for _, p in want) and len(want) == data.count()


def test_stored_model_is_reused(spark, tmp_path):
    rows, path = rating_rows(spark, 200), str(tmp_path / "m")
    first = rating.predicted_ratings(spark, rows, path, rounds=2)
    calls = []
    original, rating.train = rating.train, lambda *a, **k: calls.append(1)
    try:
        second = rating.predicted_ratings(spark, rows, path, rounds=2)
    finally:
        rating.train = original
    assert not calls and sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def gaps(spark, real, predicted, n=20):
    r = spark.createDataFrame([(f"k{i}", "p", real) for i in range(n)], "review_key string, product_id string, rating double")
    m = spark.createDataFrame([(f"k{i}", predicted) for i in range(n)], "review_key string, predicted_rating double")
    return r, m


@pytest.mark.parametrize("real, predicted, drop, lost", [(4.5, 4.0, 0.075, 75000.0), (3.0, 4.0, 0.0, 0.0)])
def test_impact(spark, real, predicted, drop, lost):
    row = impact.per_product(*gaps(spark, real, predicted)).first()
    assert (row.conversion_drop_pct, row.lost_revenue, row.review_count) == (drop, lost, 20)


def test_impact_bounds_and_empty(spark):
    few = gaps(spark, 4.5, 4.0, 19)
    assert impact.per_product(*few).count() == 0
    assert impact.for_products(*few, product_ids=["p"]).count() == 1
    assert impact.for_products(*gaps(spark, None, 4.0)).count() == 0
    assert tuple(impact.summary(impact.per_product(*few)).first()) == (0, 0, 0.0, 0.0, 0.0, 0.0)
    full = impact.summary_with_top(impact.per_product(*gaps(spark, 4.5, 4.0)), 3).first()
    assert full.total_lost_revenue == 75000.0 and [x.product_id for x in full.top_products] == ["p"]
    assert impact.summary_with_top(impact.per_product(*few), 3).first().top_products == []


def test_snapshot_versions(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"), TOPICS)
    assert table.read().count() == 0
    row = ("p|pos|0", "p", "pos", 0, "words", 3)
    first = table.write(spark.createDataFrame([row], TOPICS))
    table.write(first.unionByName(first.withColumn("topic_no", F.lit(1))))  # reads what it replaces
    assert table.versions() == [0, 1] and table.read().count() == 2 and first.count() == 1
    (tmp_path / "t" / "version=1" / "_SUCCESS").unlink()  # a write that did not finish
    assert table.versions() == [0] and table.read().count() == 1


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_feedback_formats(spark, tmp_path, fmt):
    rows = [(0, 5, "a, b", 4, None, "x"), (1, None, "c d", None, "red", None)]
    df = spark.createDataFrame(rows, "seq bigint, nmId bigint, text string, productValuation int, color string, answer string")
    df.withColumn("extra", F.lit(1)).select(*df.columns).write.format(fmt).save(str(tmp_path / fmt))
    assert sorted(map(tuple, read_feedback(spark, str(tmp_path / fmt), fmt).collect())) == rows
    assert scan_limit(df, 1, "seq").first().seq == 0


def test_both_stages(spark, tmp_path):
    store = jobs.ReviewStore(spark, str(tmp_path / "store"))
    raw = spark.range(120).select(
        F.col("id").alias("seq"), F.lit(1).cast("bigint").alias("nmId"),
        F.concat(F.when(F.col("id") % 2 == 0, "aaaa good shoes number ").otherwise("bbbb bad "), "id").alias("text"),
        (F.col("id") % 5 + 1).cast("int").alias("productValuation"), F.lit("red").alias("color"),
        F.lit(None).cast("string").alias("answer"),
    )
    jobs.ingest_job(store, raw)
    run = lambda: jobs.enrich(
        store, scoring.batch_sentiment(length_logits, ["positive", "neutral", "negative"]),
        scoring.batch_embedding(letter_counts), topics.ClusterSettings(), rounds=2)
    run()
    ml = store.review_ml.read()
    assert ml.where("sentiment_label is not null and embedding is not null and predicted_rating is not null").count() == 120
    found = sorted((r.polarity, r.topic_no, r.review_count) for r in store.topics.read().collect())
    assert found == [("neg", 0, 60), ("pos", 0, 60)]
    assert ml.join(store.topics.read(), "topic_id").count() == 120
    assert [r.rule_name for r in store.alerts.read().collect()] == ["high_negative_share"]
    state = [sorted(map(tuple, t.read().drop("created_at").collect()), key=repr)
             for t in (store.reviews, store.review_ml, store.topics, store.alerts)]
    run()  # nothing is pending, so nothing changes
    assert state == [sorted(map(tuple, t.read().drop("created_at").collect()), key=repr)
                     for t in (store.reviews, store.review_ml, store.topics, store.alerts)]


# Plans

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bucketed_join_needs_no_shuffle(spark, tmp_path):
    for name in ("b_reviews", "b_ml"):
        df = spark.range(1000).select(F.col("id").cast("string").alias("review_key"), F.lit(1).alias(name))
        save_bucketed(df, name, "review_key", 4, str(tmp_path / name))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(reports.enriched(spark.table("b_reviews"), spark.table("b_ml")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in text and "Exchange" not in text


SF = "/root/testdata/sf0.001"
QUERIES = queries()


def test_a_frame_is_scored_in_pieces(monkeypatch):
    monkeypatch.setattr(scoring, "PIECE_CHARS", 10)
    assert list(scoring._pieces(np.array([4, 6, 1, 30, 0, 9, 2]))) == [(0, 2), (2, 3), (3, 4), (4, 6), (6, 7)]
    assert list(scoring._pieces(np.array([], int))) == []


def test_gradients_are_no_more_than_cores(spark):
    names = ["positive", "negative", "neutral"]
    rows = spark.createDataFrame(
        [(names[i % 3], f"word{i % 3} text{i % 5}") for i in range(300)],
        "sentiment_label string, text_clean string").repartition(40)
    tracker, job = spark.sparkContext.statusTracker(), "gradients"
    spark.sparkContext.setJobGroup(job, job)
    scoring.train_sentiment(rows, features=16, max_iter=2)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(job) for s in tracker.getJobInfo(j).stageIds]
    passes = [i.numTasks for i in infos if i and i.name.startswith("treeAggregate")]
    assert passes and max(passes) <= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("name", [
    "alerts_all", "overview_stats", "impact_summary", "ingest_reviews", "rating_gap", "pending_sentiment",
    "topics_replace", "ml_upsert_sentiment", "stratified_split", "topic_keywords", "gap_histogram",
])
def test_no_python_and_no_cartesian(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "Pandas"):
        assert bad not in text


def test_plan_shapes(spark):
    text = plan(QUERIES["alerts_all"](spark, SF))
    assert "partial_count" in text and text.count("FileScan parquet") == 2  # one scan per table
    assert "WindowGroupLimit" in plan(QUERIES["negative_reviews"](spark, SF))
    assert "TakeOrderedAndProject" in plan(QUERIES["top_products"](spark, SF))
    scan = plan(QUERIES["pending_sentiment"](spark, SF))
    assert "LeftAnti" in scan and "l_shipdate" in scan and "l_comment" not in scan


def test_tables_of_a_crashed_commit_stay_as_they_were(spark, tmp_path, monkeypatch):
    store = jobs.ReviewStore(spark, str(tmp_path / "store"))
    row = ("k", "negative", 0.5, "old", None, None, None)
    store.review_ml.write(spark.createDataFrame([row], REVIEW_ML))
    new = spark.createDataFrame([("k", "negative", 0.5, "new", None, None, None)], REVIEW_ML)
    topics_ = spark.createDataFrame([], TOPICS)

    def crash(df):
        raise RuntimeError("lost")

    monkeypatch.setattr(store.topics, "stage", crash)
    with pytest.raises(RuntimeError):
        store.commit({store.review_ml: new, store.topics: topics_})
    assert [r.topic_id for r in store.review_ml.read().collect()] == ["old"]
    monkeypatch.undo()
    store.commit({store.review_ml: new, store.topics: topics_})
    assert [r.topic_id for r in store.review_ml.read().collect()] == ["new"]
