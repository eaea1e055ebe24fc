"""Text rules against Python's own, character by character and on real texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from reviewmill.functions import text as tx


def python_clean(text):
    text = re.sub(r"<[^>]+>", " ", text)
    text = re.sub(r"https?://\S+|www\.\S+", " ", text, flags=re.IGNORECASE)
    return " ".join(text.lower().split()[:512])


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r.v for r in df.select("i", fn(F.col("text")).alias("v")).orderBy("i").collect()]


HAND = [
    "a b c", "a\u001cb c", "<b>Good</b> see HTTPS://x.y/z www.q.r ok fine", "", "   ", "one",
    " lead and trail \n", "x\t \ty\r\nz", "a < b > c", "<>", "ПРИВЕТ Мир, ещё раз", "http://a b c d",
    "a　　b", "www.x", "tail\u0085", " start", "a  b", "a \t b",
]


def test_clean_matches_python(spark):
    long = [" ".join(f"w{i}" for i in range(n)) for n in (2, 3, 511, 512, 513, 2000)]
    texts = HAND + long
    assert column(spark, texts, tx.clean_text) == [python_clean(x) for x in texts]


def test_whitespace_class_is_pythons(spark):
    points = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    got = column(spark, [f"a{c}b" for c in points], tx.token_count)
    assert [c for c, n in zip(points, got) if n != len(f"a{c}b".split())] == []
    got = column(spark, [f"a{c}b" for c in points], tx.collapse_ws)
    assert [c for c, v in zip(points, got) if v != " ".join(f"a{c}b".split())] == []


def test_documents_match_python(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(
        "text", tx.clean_text(F.col("text")).alias("clean"), tx.token_count(F.col("text")).alias("n"),
        tx.keyword_tokens(F.col("text")).alias("words"),
    ).collect()
    pattern = re.compile(r"(?u)\b[а-яёa-zA-Z][а-яёa-zA-Z\-]{2,}\b")
    for row in rows:
        assert row.clean == python_clean(row.text)
        assert row.n == len(row.text.split())
        assert row.words == pattern.findall(row.text.lower())


@pytest.mark.parametrize("text", [
    "foo-", "foo- bar", "foo--bar", "été foo", "x1-foo", "foo-x1", "foo-été-bar", "a-b", "a--é", "ab-",
    "Тест-драйв ёлка", "don't stop", "under_score abc", "abc1 abc", "-abc-", "a-é bcd",
])
def test_keywords_match_python(spark, text):
    pattern = re.compile(r"(?u)\b[а-яёa-zA-Z][а-яёa-zA-Z\-]{2,}\b")
    assert column(spark, [text], tx.keyword_tokens) == [pattern.findall(text.lower())]


def test_ngrams(spark):
    assert column(spark, ["one two three", "one", ""], tx.ngrams) == [
        ["one", "two", "three", "one two", "two three"], ["one"], [],
    ]


def test_cleaning_is_idempotent(spark):
    once = column(spark, HAND, tx.clean_text)
    assert column(spark, once, tx.clean_text) == once


def test_enough_tokens(spark):
    assert column(spark, ["", "a", "a b", "a b c", "a b c d"], tx.has_enough_tokens) == [
        False, False, False, True, True,
    ]


def test_whitespace_is_split_off_without_a_class_of_ranges(spark):
    """Runs of mixed whitespace against Python; the pattern that is tried at every character is one range."""
    texts = ["  a\t  b 　　c\u0085", "   ", "é é  \x1f", "x", "\n"]
    assert column(spark, texts, tx.collapse_ws) == [" ".join(x.split()) for x in texts]
    assert column(spark, texts, tx.token_count) == [len(x.split()) for x in texts]
    plan = spark.range(1).select(tx.token_count(F.lit("a").cast("string") + F.col("id")))
    assert "[^ -~]" in plan._jdf.queryExecution().analyzed().toString()


def test_the_head_of_a_long_text_is_cleaned_like_the_whole(spark):
    """Tags over the end of the head, links at its end, runs of spaces, other whitespace, few tokens in many spaces."""
    rng = random.Random(1)
    parts = ["a", "Bc", "www.x", "https://Y", "<b", "c>", "\n", "\t", "Σ", "", " ", "WWW.", "http://", "x\x85y", " ", "ÉΣ.", "İ"]
    rows = [(" ".join(rng.choice(parts if rng.random() < p else ["word"]) for _ in range(rng.randrange(0, 1500))),)
            for p in (0.02, 0.2, 0.6, 1) for _ in range(100)] + [(None,), (" " * 2000 + "a b c",), ("w " * 575 + "http://",)]
    x = F.col("text")
    plain = tx.strip_urls(tx.strip_html(F.coalesce(x, F.lit(""))))
    whole = tx.truncate_tokens(tx.collapse_ws(F.lower(plain)))
    df = spark.createDataFrame(rows, "text string")
    assert df.where(~whole.eqNullSafe(tx.clean_text(x))).count() == 0
