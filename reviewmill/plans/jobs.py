"""The batch jobs, from one table state to the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewmill.operators.merge import reassign, replace_groups
from reviewmill.plans import alerts, incremental, ingest, rating, scoring, topics
from reviewmill.schema import (
    ALERTS, BATCH_SIZE, ERRORS, LISTING, LOADS, MARKETPLACE, PRODUCTS, REJECTS, REVIEW_ML, REVIEW_UPDATE_COLUMNS, REVIEWS, TOPICS,
)
from reviewmill.session import staged
from reviewmill.sources.snapshots import (
    BUCKETS, AppendTable, BucketTable, Manifest, RangedTable, SnapshotTable,
)


class ReviewStore:
    """The tables under one folder that every executor can reach.

    Reviews and their model outputs are bucketed alike on the review key, so they join
    without a shuffle, and a job rewrites only the buckets it has new values for.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, listing_files: int | None = None):
        self.spark, self.root = spark, root.rstrip("/")
        self.manifest = Manifest(spark, f"{self.root}/manifest")
        table = lambda kind, name, schema, *more: kind(
            spark, f"{self.root}/{name}", schema, self.manifest, *more)
        self.products = table(AppendTable, "products", PRODUCTS)
        self.reviews = table(BucketTable, "reviews", REVIEWS, "review_key", buckets)
        self.review_ml = table(BucketTable, "review_ml", REVIEW_ML, "review_key", buckets)
        self.topics = table(SnapshotTable, "topics", TOPICS)
        self.alerts = table(SnapshotTable, "alerts", ALERTS)
        self.rejects = table(AppendTable, "rejects", REJECTS)
        self.loads = table(AppendTable, "loads", LOADS)
        self.errors = table(SnapshotTable, "errors", ERRORS)
        self.listing = table(RangedTable, "listing", LISTING, ["product_id", "topic_id"], listing_files)

    def commit(self, states: dict[SnapshotTable, DataFrame]) -> None:
        """Store the next states of several tables; they become current together or not at all."""
        self.manifest.commit({table: table.stage(df) for table, df in states.items()})

    def sweep(self) -> None:
        """Delete old versions of all tables. Only while no job or reader is at work."""
        for table in (self.products, self.reviews, self.review_ml, self.topics, self.alerts, self.rejects,
                      self.loads, self.errors, self.listing):
            table.sweep()
        self.manifest.sweep()


def ingest_job(store: ReviewStore, raw: DataFrame, marketplace: str = MARKETPLACE,
               batch_size: int = BATCH_SIZE) -> None:
    """Add the load's products and reviews; rows without a product and the counters are kept too.

    All of it becomes current in one commit, so a load that dies can be run again.
    """
    usable, observed = ingest.usable_observed(raw)
    rows = usable.where("nmId IS NOT NULL")
    source = ingest.review_rows(ingest.last_batch_wins(rows, batch_size), marketplace)
    store.manifest.commit({
        store.products: store.products.stage(ingest.new_products(rows, store.products.read(), marketplace)),
        store.reviews: store.reviews.stage_merge(source, REVIEW_UPDATE_COLUMNS),
        store.rejects: store.rejects.stage(usable.where("nmId IS NULL").select(*REJECTS.fieldNames())),
        store.loads: store.loads.stage(ingest.load_counts(observed, rows)),
    })


def _errors(store: ReviewStore, stage: str, found: DataFrame) -> DataFrame:
    """The errors table with those of this run of a stage in place of the last run's."""
    others = store.errors.read().where(F.col("stage") != stage)
    return others.unionByName(found.select(F.lit(stage).alias("stage"), "subject", "message"))


def _keep_scores(store: ReviewStore, stage: str, scored: DataFrame, update: list[str]) -> None:
    """Merge what was scored; reviews whose text the model failed on stay pending, with an error row."""
    if "error" not in scored.columns:
        scored = scored.withColumn("error", F.lit(None).cast("string"))
    scored = staged(scored)
    failed = scored.where("error IS NOT NULL").select(
        F.col("review_key").alias("subject"), F.col("error").alias("message"))
    store.manifest.commit({
        store.review_ml: store.review_ml.stage_merge(scored.where("error IS NULL").drop("error"), update, stored=True),
        store.errors: store.errors.stage(_errors(store, stage, failed)),
    })


def sentiment_job(store: ReviewStore, scorer: scoring.Scorer) -> None:
    scored = scoring.score_sentiment(store.reviews.read(), store.review_ml.read(), scorer)
    _keep_scores(store, "sentiment", scored, ["sentiment_label", "sentiment_score"])


def embedding_job(store: ReviewStore, scorer: scoring.Scorer) -> None:
    vectors = scoring.embed(store.reviews.read(), store.review_ml.read(), scorer)
    _keep_scores(store, "embedding", vectors, ["embedding"])


def cluster_job(store: ReviewStore, settings: topics.ClusterSettings = topics.ClusterSettings()) -> None:
    """Replace the topics of every (product, polarity) that was clustered; others stay."""
    review_ml, old = store.review_ml.read(), store.topics.read()
    rows = incremental.cluster_input(store.reviews.read(), review_ml)
    assigned = staged(topics.cluster_reviews(rows, settings))
    new = staged(topics.topic_table(assigned, rows.select("review_key", "text_clean")))
    replaced = old.join(new.select(*topics.GROUP).distinct(), topics.GROUP, "left_semi")
    moved = assigned.select("review_key", topics.topic_id().alias("topic_id"))
    before = review_ml.select("review_key", "topic_id", F.col("topic_id").alias("was"))
    changed = reassign(before, replaced, moved, "review_key", "topic_id").where(
        ~F.col("topic_id").eqNullSafe(F.col("was")))
    store.manifest.commit({
        store.review_ml: store.review_ml.stage_merge(changed.select("review_key", "topic_id"), ["topic_id"]),
        store.topics: store.topics.stage(replace_groups(old, new, topics.GROUP)),
        store.errors: store.errors.stage(_errors(store, "topics", topics.unusable(rows))),
    })


def rating_job(store: ReviewStore, model_path: str | None = None, **settings) -> DataFrame | None:
    """Predict every review that can be; returns the statistics of this run's predictions."""
    rows = incremental.rating_input(store.reviews.read(), store.review_ml.read())
    if rows.isEmpty():
        return None
    path = model_path or f"{store.root}/rating_model"
    predictions = staged(rating.predicted_ratings(store.spark, rows, path, **settings))
    store.review_ml.merge(predictions, ["predicted_rating"], stored=True)
    return rating.prediction_stats(predictions)


def alerts_job(store: ReviewStore, thresholds: alerts.Thresholds = alerts.Thresholds()) -> None:
    fired = alerts.evaluate_all(store.reviews.read(), store.review_ml.read(), thresholds)
    store.alerts.write(alerts.snapshot(fired))


def listing_job(store: ReviewStore) -> None:
    """Lay the reviews with their model outputs out by product and topic, for the listings of one product."""
    rows = store.reviews.read().join(store.review_ml.read().drop("embedding", "fake_score"), "review_key")
    store.commit({store.listing: rows})


def enrich(store: ReviewStore, sentiment: scoring.Scorer, embedding: scoring.Scorer,
           settings: topics.ClusterSettings = topics.ClusterSettings(),
           thresholds: alerts.Thresholds = alerts.Thresholds(), **rating_settings) -> None:
    """Stage 2: every step reads the state the step before has written."""
    sentiment_job(store, sentiment)
    embedding_job(store, embedding)
    cluster_job(store, settings)
    rating_job(store, **rating_settings)
    alerts_job(store, thresholds)
    listing_job(store)
