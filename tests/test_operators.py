"""Operators on hand-made rows, compared with brute force."""

import random

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import numbers, vectors
from reviewmill.operators.components import connected_components
from reviewmill.operators.merge import insert_absent, merge_columns, reassign, replace_groups
from reviewmill.operators.ranks import dense_positions, lowest_per_group
from reviewmill.operators.skew import hot_key_join, hot_keys, salted_join
from reviewmill.plans import incremental
from reviewmill.schema import REVIEW_ML
from reviewmill.sources.feedback import scan_limit


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merge_updates_only_its_columns(spark):
    ml = spark.createDataFrame([("a", "neutral", 0.5, "t", 0.1, 4.0, [1.0])], REVIEW_ML)
    new = spark.createDataFrame(
        [("a", "positive", 0.9), ("b", "negative", 0.8)],
        "review_key string, sentiment_label string, sentiment_score double",
    )
    got = incremental.upsert_sentiment(ml, new)
    assert got.columns == ml.columns
    assert rows(got) == [
        ("a", "positive", 0.9, "t", 0.1, 4.0, [1.0]), ("b", "negative", 0.8, None, None, None, None),
    ]
    assert rows(incremental.upsert_sentiment(got, new)) == rows(got)


def test_merge_can_set_null(spark):
    target = spark.createDataFrame([(1, "x", "y")], "k int, a string, b string")
    source = spark.createDataFrame([(1, None, "z")], "k int, a string, b string")
    assert rows(merge_columns(target, source, "k", ["a"])) == [(1, None, "y")]


def test_null_label_is_still_pending(spark):
    reviews = spark.createDataFrame(
        [("a", "x y z"), ("b", "x y z"), ("c", ""), ("d", "x y z")], "review_key string, text_clean string"
    )
    ml = spark.createDataFrame(
        [("a", None, None, None, None, None, None), ("b", "neutral", 0.5, None, None, None, None)], REVIEW_ML
    )
    assert [r.review_key for r in incremental.pending_sentiment(reviews, ml).orderBy("review_key").collect()] == [
        "a", "d"]
    assert incremental.pending_embedding(reviews, ml).count() == 3


def test_replace_keeps_groups_without_new_rows(spark):
    old = spark.createDataFrame([("p", "pos", 1), ("p", "neg", 2), ("q", "pos", 3)], "p string, s string, n int")
    new = spark.createDataFrame([("p", "pos", 9)], "p string, s string, n int")
    assert rows(replace_groups(old, new, ["p", "s"])) == [("p", "neg", 2), ("p", "pos", 9), ("q", "pos", 3)]


def test_reassign(spark):
    ml = spark.createDataFrame(
        [("a", "p|pos|0"), ("b", "p|pos|0"), ("c", "p|neg|0"), ("d", None)], "k string, topic string"
    )
    replaced = spark.createDataFrame([("p|pos|0",)], "topic string")
    fresh = spark.createDataFrame([("a", "p|pos|0"), ("d", "p|pos|1")], "k string, topic string")
    assert rows(reassign(ml, replaced, fresh, "k", "topic")) == [
        ("a", "p|pos|0"), ("b", None), ("c", "p|neg|0"), ("d", "p|pos|1")]


def test_insert_absent(spark):
    source = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(insert_absent(source, spark.createDataFrame([(2,)], "k int"), ["k"])) == [(1,)]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_equals_join(spark, how):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id") % 9).alias("k"))
    small = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k bigint, v string")
    got = salted_join(big, small, ["k"], ["id"], how)
    assert rows(got.select("id", "k", "v")) == rows(big.join(small, "k", how).select("id", "k", "v"))


def test_salted_join_does_not_broadcast_a_side_that_is_large_when_repeated(spark, tmp_path):
    spark.range(300_000).select(F.col("id").alias("k"), F.lit(1).alias("v")).write.parquet(f"{tmp_path}/small")
    spark.range(1_000).withColumn("k", F.col("id") % 7).write.parquet(f"{tmp_path}/big")
    small, big = spark.read.parquet(f"{tmp_path}/small"), spark.read.parquet(f"{tmp_path}/big")
    joined = salted_join(big, small, ["k"], ["id"], "left")  # only `small` could be broadcast
    assert "SortMergeJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.count() == 1_000


def test_hot_key_join_equals_join(spark):
    big = spark.range(1000).select(F.col("id"), F.when(F.col("id") < 700, 0).otherwise(F.col("id")).alias("k"))
    sized = big.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(sized, ["k"], "n", 100)
    assert rows(hot) == [(0,)]
    got = hot_key_join(big, sized, ["k"], hot, ["id"], salts=4)
    assert rows(got.select("id", "k", "n")) == rows(big.join(sized, "k").select("id", "k", "n"))
    some = sized.where("k < 800")
    left = hot_key_join(big, some, ["k"], hot, ["id"], "left", salts=4)
    assert rows(left.select("id", "k", "n")) == rows(big.join(some, "k", "left").select("id", "k", "n"))


def test_dense_positions(spark):
    picked = sorted(random.Random(1).sample(range(-50, 5000), 900))
    df = spark.createDataFrame([(s,) for s in picked], "seq bigint").repartition(7)
    got = dense_positions(df, "seq", width=37, fan=3).orderBy("seq").collect()
    assert [(r.seq, r.position) for r in got] == [(s, i) for i, s in enumerate(picked)]


def test_lowest_per_group(spark):
    rng = random.Random(2)
    data = [("a" if rng.random() < 0.9 else "b", f"{rng.getrandbits(128):032x}") for _ in range(400)]
    df = spark.createDataFrame(data, "g string, h string")
    for digits in (1, 4):
        got = lowest_per_group(df, ["g"], "h", F.ceil(F.col("n") * 0.25), "low", digits)
        want = []
        for g in "ab":
            members = sorted(h for x, h in data if x == g)
            want += [(g, h, i < -(-len(members) // 4)) for i, h in enumerate(members)]
        assert rows(got) == sorted(want, key=repr)


def test_lowest_per_group_ranks_one_slice_of_a_group(spark, tmp_path):
    data = [("a", f"{i % 16:x}{i:031x}") for i in range(320)] + [("b", "0" * 32), ("b", "0" * 32)]
    spark.createDataFrame(data, "g string, h string").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    for share, count in ((0.3, 96), (0.25, 80), (0.0, 0), (1.0, 320)):
        got = lowest_per_group(df, ["g"], "h", F.ceil(F.col("n") * share), "low", digits=1)
        chosen = sorted(r.h for r in got.where("low AND g = 'a'").collect())
        assert chosen == sorted(h for g, h in data if g == "a")[:count] and got.count() == 322
    half = lowest_per_group(df, ["g"], "h", F.ceil(F.col("n") * 0.5), "low", digits=1)
    assert half.where("low AND g = 'b'").count() == 1  # equal digests do not go over the quota
    # Rows outside the slice that a quota ends in need no shuffle.
    text = half._jdf.queryExecution().executedPlan().toString()
    assert "Union" in text and text.count("Exchange hashpartitioning") == 1


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [("g", i, i + 1) for i in range(100, 160)] + [("h", 1, 101)]
    edges += [("g", rng.randrange(1000, 1080), rng.randrange(1000, 1080)) for _ in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, a, b in edges:
        x, y = sorted((find((g, a)), find((g, b))))
        parent[y] = x
    want = sorted((g, n, find((g, n))[1]) for g, n in parent)
    df = spark.createDataFrame(edges, "g string, a bigint, b bigint")
    assert sorted(map(tuple, connected_components(df, ["g"]).collect())) == want
    assert sorted(map(tuple, connected_components(df, ["g"], hot_rows=2).collect())) == want


def test_components_of_nothing(spark):
    df = spark.createDataFrame([], "g string, a bigint, b bigint")
    assert connected_components(df, ["g"]).count() == 0


def test_round_is_pythons(spark):
    rng = random.Random(4)
    values = [2.675, 0.0625, 1 / 16, 0.5, 1.5, 2.5, -0.0004, 1e6 + 0.125] + [rng.uniform(-50, 50) for _ in range(500)]
    values += [k / n for n in range(1, 65) for k in range(0, n, 3)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (0, 1, 2, 3, 4):
        got = df.select("v", numbers.round_exact(F.col("v"), digits).alias("r")).collect()
        assert [(r.v, r.r) for r in got] == [(v, round(v, digits) + 0.0) for v in values]


def test_clip(spark):
    df = spark.createDataFrame([(0.2,), (3.3,), (7.1,), (None,)], "v double")
    assert [r[0] for r in df.select(numbers.clip_rating(F.col("v"))).collect()] == [1.0, 3.3, 5.0, None]


def test_softmax_and_labels(spark):
    row = spark.range(1).select(
        vectors.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("p")
    ).select(F.array_max("p").alias("top"), vectors.argmax(F.col("p")).alias("best")).first()
    assert (row.top, row.best) == (pytest.approx(0.6652409557748218), 2)
    big = spark.range(1).select(vectors.softmax(F.array(F.lit(1000.0), F.lit(0.0))).alias("p")).first().p
    assert big == [1.0, 0.0]
    names = spark.createDataFrame([("POSITIVE",), ("negative",), ("LABEL_7",), (None,)], "v string")
    got = names.select(vectors.normalise_label(F.col("v"))).collect()
    assert [r[0] for r in got] == ["positive", "negative", "neutral", "neutral"]


def test_zero_vector(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<float>")
    got = [[round(x, 6) for x in r[0]] for r in df.select(vectors.l2_normalise(F.col("v"))).collect()]
    assert got == [[0.0, 0.0], [0.6, 0.8]]


def test_scan_limit_takes_the_lowest(spark):
    picked = random.Random(5).sample(range(-10**6, 10**7), 700)
    df = spark.createDataFrame([(s, str(s)) for s in picked], "seq bigint, v string").repartition(5)
    for n in (1, 99, 699, 700, 5000):
        got = scan_limit(df, n, "seq", width=10**5)
        assert sorted(r.seq for r in got.collect()) == sorted(picked)[:n]
    assert scan_limit(df, 7).count() == 7
    assert scan_limit(df.where("false"), 7, "seq").count() == 0


def test_size_estimates_do_not_grow_with_the_rounds(spark):
    """A checkpoint keeps the product of the joined sizes, so planning took ever longer with every round."""
    edges = spark.createDataFrame([("g", i, i + 1) for i in range(70)], "g string, a long, b long")
    labels = connected_components(edges, ["g"])
    assert rows(labels.select("label").distinct()) == [(0,)] and labels.count() == 71
    assert labels._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40
