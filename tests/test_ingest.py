"""Stage 1 on hand-made rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

from reviewmill.plans import ingest
from reviewmill.schema import FEEDBACK, PRODUCTS, REVIEWS


def feedback(spark, rows):
    """Rows of (nmId, text, stars, color, answer), numbered in order."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], FEEDBACK)


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_token_bounds(spark):
    texts = [" ".join(f"t{i}" for i in range(n)) for n in (2, 3, 512, 513)]
    rows = ingest.keyed(feedback(spark, [(1, t, 5, None, None) for t in texts])).collect()
    assert sorted((len(r.text_clean.split()), r.word_count) for r in rows) == [(3, 3), (512, 512), (512, 513)]


def test_nul_is_removed_before_key_and_lengths(spark):
    row = ingest.keyed(feedback(spark, [(7, "ab\x00c d e", 5, "re\x00d", None)])).first()
    assert (row.text, row.text_clean, row.review_length, row.color) == ("abc d e", "abc d e", 7, "red")
    assert row.review_key == hashlib.sha256(b"7:abc d e").hexdigest()[:32]


@pytest.mark.parametrize("answer, has, length", [("  ", False, 2), (None, False, 0), ("ok", True, 2)])
def test_answer_features(spark, answer, has, length):
    rows = ingest.keyed(feedback(spark, [(1, "a b c", 5, None, answer)]))
    row = ingest.review_rows(rows).first()
    assert (row.has_answer, row.answer_length, row.answer) == (has, length, answer)


def test_null_product_goes_to_rejects(spark):
    raw = feedback(spark, [(None, "a b c", 5, None, None), (1, "d e f", 5, None, None)])
    assert [r.text for r in ingest.rejects(raw).collect()] == ["a b c"]
    assert [r.text for r in ingest.keyed(raw).collect()] == ["d e f"]


def test_last_batch_first_row_wins(spark):
    raw = feedback(spark, [
        (1, "same text here", 1, None, None), (1, "same text here", 2, None, None),
        (1, "same text here", 3, None, None), (1, "same text here", 4, None, None),
    ])
    rows = ingest.last_batch_wins(ingest.keyed(raw), batch_size=2).collect()
    assert [r.productValuation for r in rows] == [3]


def test_batches_count_kept_rows_only(spark):
    raw = feedback(spark, [
        (1, "short", 9, None, None), (1, "same text here", 1, None, None), (1, "x", 9, None, None),
        (1, "same text here", 2, None, None), (1, "other text here", 3, None, None),
    ])
    rows = ingest.last_batch_wins(ingest.keyed(raw), batch_size=2).collect()
    assert sorted(r.productValuation for r in rows) == [1, 3]


def test_upsert_keeps_text_and_product_and_is_idempotent(spark):
    raw = feedback(spark, [(1, "A b c", 2, "red", None), (2, "d e f", 4, None, "hi")])
    products, reviews = ingest.ingest(raw, empty(spark, PRODUCTS), empty(spark, REVIEWS))
    again = ingest.ingest(raw, products, reviews)
    assert sorted(map(tuple, again[0].collect())) == sorted(map(tuple, products.collect()))
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, reviews.collect()))

    stored = reviews.withColumn("text", F.lit("kept")).withColumn("product_id", F.lit("kept"))
    changed = feedback(spark, [(1, "A b c", 5, None, "yes")])
    rows = {r.rating: r for r in ingest.upsert_reviews(ingest.keyed(changed), stored).collect()}
    assert (rows[5].text, rows[5].product_id, rows[5].color, rows[5].answer) == ("kept", "kept", None, "yes")
    assert rows[4].answer == "hi"


def test_one_text_on_most_rows(spark):
    raw = feedback(spark, [(1, "copied over again", i % 5 + 1, None, None) for i in range(500)]
                   + [(i, f"text number {i}", 3, None, None) for i in range(50)])
    reviews = ingest.ingest(raw, empty(spark, PRODUCTS), empty(spark, REVIEWS), batch_size=100)[1]
    assert reviews.count() == 51
    copied = reviews.where("text_clean = 'copied over again'").collect()
    assert [r.rating for r in copied] == [1]  # row 400 opens the last batch that holds the text


def test_attach_product_drops_unknown(spark):
    rows = ingest.keyed(feedback(spark, [(1, "a b c", 5, None, None), (2, "a b c", 5, None, None)]))
    known = spark.createDataFrame([("market", "1"), ("elsewhere", "2")], PRODUCTS)
    got = ingest.attach_product(rows, known).collect()
    assert [(r.nmId, r.product_id) for r in got] == [(1, "market:1")]
    assert [r.external_id for r in ingest.new_products(rows, known).collect()] == ["2"]


def test_counts(spark):
    raw = feedback(spark, [
        (1, "a b c", 1, None, None), (1, "a b c", 2, None, None), (2, "a b c", 3, None, None),
        (None, "a b c", 4, None, None), (3, "a b", 5, None, None), (3, None, 5, None, None),
    ])
    assert ingest.counts(raw).first().asDict() == {
        "rows_read": 6, "rows_kept": 3, "rows_rejected": 1, "reviews": 2, "products": 2,
    }
    assert ingest.counts(raw.where("false")).first().rows_read == 0


def test_position_stands_in_for_an_absent_seq(spark, tmp_path):
    from reviewmill.sources.feedback import read_feedback

    path = str(tmp_path / "raw")
    rows = [(i % 3, f"good text number {i}", i % 5 + 1, None, None) for i in range(30)]
    plain = spark.createDataFrame(rows, "nmId long, text string, productValuation int, color string, answer string")
    plain.coalesce(1).write.parquet(path)
    plain.coalesce(1).write.mode("append").parquet(path)
    raw = read_feedback(spark, path)
    assert raw.columns == FEEDBACK.fieldNames()
    assert raw.select("seq").distinct().count() == 60
    products, reviews = ingest.ingest(raw, empty(spark, PRODUCTS), empty(spark, REVIEWS))
    assert (products.count(), reviews.count()) == (3, 30)


@pytest.mark.parametrize("fmt", ["json", "csv", "orc", "parquet"])
def test_positions_of_every_format_are_rows_of_files(spark, tmp_path, fmt):
    from reviewmill.sources.feedback import FILE_ROWS, read_feedback

    path = str(tmp_path / fmt)
    plain = spark.range(4000).selectExpr(
        "id % 3 AS nmId", "concat('text number ', id, repeat(' word', 20)) AS text", "1 AS productValuation",
        "'red' AS color", "'x' AS answer")
    options = {"header": True} if fmt == "csv" else {}
    plain.coalesce(1).write.format(fmt).options(**options).save(path)
    plain.coalesce(1).write.format(fmt).options(**options).mode("append").save(path)
    raw = read_feedback(spark, path, fmt, **options)
    first = {r.seq: r.text.split()[2] for r in raw.collect()}
    assert first == {f * FILE_ROWS + i: str(i) for f in (0, 1) for i in range(4000)}
    # Other blocks, read in another order, give the same numbers.
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        again = read_feedback(spark, path, fmt, **options)
        assert {r.seq: r.text.split()[2] for r in again.collect()} == first
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_null_seq_is_an_error(spark):
    raw = spark.createDataFrame([(None, 1, "a b c", 5, None, None)], FEEDBACK)
    with pytest.raises(Exception, match="feedback row without seq"):
        ingest.last_batch_wins(ingest.keyed(raw)).collect()


def test_repeated_and_sparse_seq_give_one_row_per_key(spark):
    repeated = spark.createDataFrame([(0, 1, "a b c", i % 5, None, None) for i in range(10)], FEEDBACK)
    assert [r.productValuation for r in ingest.last_batch_wins(ingest.keyed(repeated)).collect()] == [0]
    sparse = spark.createDataFrame(
        [(10**15 * i, 1, f"text number {i % 4}", i % 5, None, None) for i in range(12)], FEEDBACK)
    got = ingest.last_batch_wins(ingest.keyed(sparse), batch_size=4).collect()
    assert sorted((r.text, r.seq // 10**15) for r in got) == [(f"text number {i}", 8 + i) for i in range(4)]


def test_job_keeps_rejects_and_counters(spark, tmp_path):
    from reviewmill.plans import jobs

    store = jobs.ReviewStore(spark, str(tmp_path / "store"))
    raw = feedback(spark, [
        (None, "a b c", 5, None, None), (1, "d e f", 5, None, None), (1, "d e f", 4, None, None), (2, "x", 1, None, None)])
    jobs.ingest_job(store, raw)
    assert [r.text for r in store.rejects.read().collect()] == ["a b c"]
    assert [tuple(r) for r in store.loads.read().collect()] == [(4, 2, 1, 1, 1)]
    assert store.reviews.read().count() == 1


def test_texts_that_the_scan_deals_to_all_cores_are_not_moved(spark, tmp_path):
    from reviewmill.sources import driver_tables as t

    rows = spark.range(4000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    for name, files in (("even", 32), ("single", 1)):
        rows.repartition(files).write.parquet(str(tmp_path / name / "documents.parquet"))
    spark.conf.set("spark.sql.files.openCostInBytes", "1g")  # a task per file
    try:
        even, single = (t.texts(spark, str(tmp_path / name), "documents", "doc_id") for name in ("even", "single"))
        assert even.rdd.getNumPartitions() == 32 and even.count() == 4000
        assert single.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and single.count() == 4000
        assert t.texts(spark, str(tmp_path / "even"), "documents", "doc_id", partitions=5).rdd.getNumPartitions() == 5
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
