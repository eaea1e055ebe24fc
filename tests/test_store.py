"""Bucketed tables, one-commit loads, and what a crash leaves behind."""

import pytest
from pyspark.sql import functions as F

from reviewmill.plans import ingest, jobs, reports
from reviewmill.schema import FEEDBACK, PRODUCTS, REVIEW_ML, REVIEWS
from reviewmill.sources import snapshots


def ml(spark, n, label="neutral"):
    return spark.range(n).select(
        F.concat(F.lit("k"), "id").alias("review_key"), F.lit(label).alias("sentiment_label"),
        F.lit(0.5).alias("sentiment_score"), F.lit(None).cast("string").alias("topic_id"),
        F.lit(None).cast("double").alias("fake_score"), F.lit(None).cast("double").alias("predicted_rating"),
        F.array(F.lit(1.0).cast("float")).alias("embedding"))


def files(root):
    return {str(f.relative_to(root)) for f in root.rglob("*.parquet")}


def test_merge_rewrites_the_touched_buckets_only(spark, tmp_path):
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=64)
    store.review_ml.write(ml(spark, 5000))
    root = tmp_path / "s" / "review_ml"
    before = files(root)
    assert len(before) == 64
    source = spark.createDataFrame(
        [(f"k{i * 499}", "positive", 0.9) for i in range(9)] + [("new", "negative", 0.8)],
        "review_key string, sentiment_label string, sentiment_score double")
    old = store.review_ml.read()
    store.review_ml.merge(source, ["sentiment_label", "sentiment_score"])
    added = files(root) - before
    assert 1 <= len(added) <= 10
    got = {r.review_key: r for r in store.review_ml.read().collect()}
    assert len(got) == 5001 and got["k499"].sentiment_label == "positive" and got["k1"].sentiment_label == "neutral"
    assert list(got["k499"].embedding) == [1.0] and got["new"].embedding is None
    assert old.count() == 5000 and old.where("sentiment_label <> 'neutral'").count() == 0  # copy on write
    store.sweep()
    left = files(root)
    assert len(left) == 64 and added <= left and store.review_ml.read().count() == 5001
    store.review_ml.merge(source.where("false"), ["sentiment_label"])  # nothing to write
    assert files(root) == left


def test_a_new_session_view_reads_the_stored_state(spark, tmp_path):
    jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=4).review_ml.write(ml(spark, 30))
    again = jobs.ReviewStore(spark.newSession(), str(tmp_path / "s"), buckets=4).review_ml.read()
    assert again.count() == 30 and again.columns == REVIEW_ML.fieldNames()


def test_reviews_join_their_model_outputs_without_a_shuffle(spark, tmp_path):
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=8)
    store.review_ml.write(ml(spark, 400))
    store.reviews.write(spark.range(400).select(*[
        (F.concat(F.lit("k"), "id") if f.name == "review_key" else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in REVIEWS.fields]))
    store.review_ml.merge(ml(spark, 7, "positive").select("review_key", "sentiment_label"), ["sentiment_label"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = reports.enriched(store.reviews.read(), store.review_ml.read())
        text = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in text and "Exchange" not in text
        assert joined.count() == 400 and joined.where("sentiment_label = 'positive'").count() == 7
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def raw_rows(spark, n=60):
    return spark.createDataFrame(
        [(i, i % 3 if i % 7 else None, f"text number {i % 40} ok", i % 5 + 1, None, None) for i in range(n)], FEEDBACK)


def state(store):
    tables = (store.products, store.reviews, store.rejects, store.loads)
    return [sorted(map(repr, t.read().collect())) for t in tables]


@pytest.mark.parametrize("table", ["products", "reviews", "rejects", "loads"])
def test_a_load_that_dies_changes_nothing_and_can_be_repeated(spark, tmp_path, monkeypatch, table):
    whole = jobs.ReviewStore(spark, str(tmp_path / "whole"), buckets=3)
    jobs.ingest_job(whole, raw_rows(spark, 20))
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=3)
    jobs.ingest_job(store, raw_rows(spark, 20))
    before = state(store)
    assert before == state(whole)

    def crash(*_, **__):
        raise RuntimeError("lost")

    monkeypatch.setattr(getattr(store, table), "stage_merge" if table == "reviews" else "stage", crash)
    with pytest.raises(RuntimeError):
        jobs.ingest_job(store, raw_rows(spark))
    assert state(store) == before
    monkeypatch.undo()
    for s in (store, whole):
        jobs.ingest_job(s, raw_rows(spark))
    assert state(store) == state(whole)
    assert len(store.loads.read().collect()) == 2


def test_counters_of_empty_loads(spark, tmp_path):
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=3)
    jobs.ingest_job(store, raw_rows(spark).where("false"))
    jobs.ingest_job(store, spark.createDataFrame([(1, 1, "x", 1, None, None)], FEEDBACK))
    assert sorted(map(tuple, store.loads.read().collect())) == [(0, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert store.reviews.read().count() == 0


@pytest.mark.parametrize("nulls", [1, 2, 1000])
@pytest.mark.parametrize("stored", [False, True])
def test_a_null_seq_always_fails_the_load(spark, tmp_path, nulls, stored):
    raw = spark.createDataFrame([(None, 1, f"a b c{i}", 5, None, None) for i in range(nulls)], FEEDBACK)
    if stored:
        raw.write.parquet(str(tmp_path / "raw"))
        raw = spark.read.schema(FEEDBACK).parquet(str(tmp_path / "raw"))
    empty = [spark.createDataFrame([], s) for s in (PRODUCTS, REVIEWS)]
    for _ in range(10):
        with pytest.raises(Exception, match="feedback row without seq"):
            ingest.last_batch_wins(ingest.keyed(raw)).collect()
    with pytest.raises(Exception, match="feedback row without seq"):
        ingest.ingest(raw, *empty)[1].collect()
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=3)
    with pytest.raises(Exception, match="feedback row without seq"):
        jobs.ingest_job(store, raw)
    assert store.loads.read().count() == 0


def test_a_listing_of_one_product_opens_few_files(spark, tmp_path):
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=2, listing_files=40)
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("review_key"), (F.col("id") % 200).alias("p"))
    store.reviews.write(keys.select(*[
        F.col("review_key") if f.name == "review_key" else F.lpad(F.col("p").cast("string"), 3, "0").alias("product_id")
        if f.name == "product_id" else F.lit(None).cast(f.dataType).alias(f.name) for f in REVIEWS.fields]))
    store.review_ml.write(ml(spark, 4000))
    jobs.listing_job(store)
    every = files(tmp_path / "s" / "listing" / "version=0")
    opened = store.listing.files_with(product_id="017")
    assert len(every) >= 30 and 1 <= len(opened) <= 2
    rows = store.listing.read_where(product_id="017")
    assert rows.count() == 20 and len(rows.inputFiles()) == len(opened)
    assert store.listing.read_where(product_id="nope").count() == 0
    assert store.listing.read().count() == 4000
    jobs.listing_job(store)
    store.sweep()
    assert store.listing.read_where(product_id="017").count() == 20
    assert not files(tmp_path / "s" / "listing" / "version=0")


def test_the_first_rows_of_a_table_are_not_staged_for_a_merge(spark, tmp_path, monkeypatch):
    seen, keep = [], snapshots.staged
    monkeypatch.setattr(snapshots, "staged", lambda df: seen.append(df.columns) or keep(df))
    store = jobs.ReviewStore(spark, str(tmp_path / "s"), buckets=3)
    jobs.ingest_job(store, raw_rows(spark, 20))
    first = sorted(map(repr, store.reviews.read().collect()))
    assert not seen and first
    jobs.ingest_job(store, raw_rows(spark, 20))
    assert len(seen) == 1 and sorted(map(repr, store.reviews.read().collect())) == first
    scores = keep(ml(spark, 5).select("review_key", "sentiment_label"))
    for _ in range(2):
        store.review_ml.merge(scores, ["sentiment_label"], stored=True)
    assert len(seen) == 1 and store.review_ml.read().count() == 5
