"""Queries over texts: cleaning, features, keys, products and the review upsert."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators.ranks import dense_positions
from reviewmill.plans import ingest, topics
from reviewmill.registry.base import (
    HTML_TAG, KEYED, LETTER, URL, WS, oracle, query, sql_clean, sql_collapse, sql_keywords,
    sql_not_blank, sql_tokens,
)
from reviewmill.schema import PRODUCTS, REVIEW_UPDATE_COLUMNS, REVIEWS
from reviewmill.session import staged
from reviewmill.sources import driver_tables as t

BATCH = 100


def _documents(spark, d):
    return t.texts(spark, d, "documents", "doc_id")


def _pages(spark, d):
    return t.texts(spark, d, "pages", "page_id")


def _keyed(spark, d):
    return ingest.keyed(t.feedback(spark, d))


@query("strip_html", f"""
    SELECT page_id, regexp_replace(html, '{HTML_TAG}', ' ', 'g') AS plain FROM pages""")
def _(spark, d):
    return _pages(spark, d).select("page_id", tx.strip_html(F.col("html")).alias("plain"))


@query("strip_urls", f"""
    SELECT page_id, regexp_replace(html, '{URL}', ' ', 'g') AS plain FROM pages""")
def _(spark, d):
    return _pages(spark, d).select("page_id", tx.strip_urls(F.col("html")).alias("plain"))


@query("collapse_ws", f"SELECT doc_id, {sql_collapse('text')} AS plain FROM documents")
def _(spark, d):
    return _documents(spark, d).select("doc_id", tx.collapse_ws(F.col("text")).alias("plain"))


@query("clean_text", f"""
    SELECT 'page' AS kind, page_id AS id, {sql_clean('html')} AS text_clean FROM pages
    UNION ALL SELECT 'document', doc_id, {sql_clean('text')} FROM documents
    UNION ALL SELECT 'turn', conv_id * 1000 + turn, {sql_clean('text')} FROM conversations""")
def _(spark, d):
    rows = _pages(spark, d).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "html")
    rows = rows.union(_documents(spark, d).select(F.lit("document"), "doc_id", "text")).union(
        t.table(spark, d, "conversations").select(
            F.lit("turn"), F.col("conv_id") * 1000 + F.col("turn"), "text"
        )
    )
    return rows.select("kind", "id", tx.clean_text(F.col("html")).alias("text_clean"))


@query("strip_nul", """
    SELECT doc_id, replace(concat(source, chr(0), text), chr(0), '') AS text, lang FROM documents""")
def _(spark, d):
    rows = _documents(spark, d).select(
        "doc_id", F.concat("source", F.lit("\x00"), "text").alias("text"), "lang"
    )
    return tx.strip_nul(rows)


@query("min_tokens", f"""
    SELECT doc_id, text_clean FROM (SELECT doc_id, {sql_clean('text')} AS text_clean FROM documents)
    WHERE text_clean <> '' AND len(string_split(text_clean, ' ')) >= 3""")
def _(spark, d):
    return ingest.cleaned(_documents(spark, d)).select("doc_id", "text_clean")


@query("truncate_tokens", f"""
    SELECT doc_id, array_to_string(list_slice(string_split({sql_collapse('text')}, ' '), 1, 512), ' ')
           AS head FROM documents""")
def _(spark, d):
    head = tx.truncate_tokens(tx.collapse_ws(F.col("text")))
    return _documents(spark, d).select("doc_id", head.alias("head"))


@query("token_count", f"SELECT doc_id, {sql_tokens('text')} AS tokens FROM documents")
def _(spark, d):
    return _documents(spark, d).select("doc_id", tx.token_count(F.col("text")).alias("tokens"))


@query("drop_blank", oracle("feedback_turns", select=f"""
    SELECT seq, answer FROM feedback_turns WHERE {sql_not_blank('answer')}"""))
def _(spark, d):
    rows = t.feedback_turns(spark, d).select("seq", F.col("answer").alias("text"))
    return ingest.drop_blank(rows).withColumnRenamed("text", "answer")


@query("normalise_ids", """
    SELECT page_id, TRY_CAST(regexp_extract(url, '/([^/?#]*)(?:[?#].*)?$', 1) AS BIGINT) AS nmId
    FROM pages""")
def _(spark, d):
    tail = F.regexp_extract("url", r"/([^/?#]*)(?:[?#].*)?$", 1)
    return ingest.normalise_ids(_pages(spark, d).select("page_id", tail.alias("nmId")))


@query("review_features", oracle("feedback_turns", select=f"""
    SELECT seq, CAST(length(text) AS INTEGER) AS review_length, {sql_tokens('text')} AS word_count,
           {sql_not_blank('answer')} AS has_answer,
           CAST(length(coalesce(answer, '')) AS INTEGER) AS answer_length FROM feedback_turns"""))
def _(spark, d):
    return ingest.with_features(t.feedback_turns(spark, d)).select(
        "seq", "review_length", "word_count", "has_answer", "answer_length"
    )


@query("review_key", """
    SELECT doc_id, substring(sha256(concat(n_chars, ':', text)), 1, 32) AS review_key FROM documents""")
def _(spark, d):
    key = tx.review_key(F.col("n_chars"), F.col("text"))
    return _documents(spark, d).select("doc_id", key.alias("review_key"))


@query("review_rejects", oracle("feedback", select=f"""
    SELECT seq, text_clean FROM (SELECT *, {sql_clean('text')} AS text_clean FROM feedback)
    WHERE text_clean <> '' AND len(string_split(text_clean, ' ')) >= 3
      AND {sql_not_blank('text')} AND nmId IS NULL"""))
def _(spark, d):
    return ingest.rejects(t.feedback(spark, d)).select("seq", "text_clean")


_REVIEW = """concat('market:', nmId) AS product_id, text, text_clean,
             productValuation AS rating, color, answer, has_answer,
             CAST(review_length AS INTEGER) AS review_length, CAST(word_count AS INTEGER) AS word_count,
             CAST(answer_length AS INTEGER) AS answer_length"""


@query("review_projection", oracle("feedback", k=KEYED, select=f"""
    SELECT review_key, {_REVIEW} FROM k"""))
def _(spark, d):
    return ingest.review_rows(_keyed(spark, d))


@query("dense_positions", """
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents""")
def _(spark, d):
    return dense_positions(_documents(spark, d).select("doc_id"), "doc_id", width=64, fan=4)


# Products

@query("products_new", oracle("feedback", "products", k=KEYED, select="""
    SELECT DISTINCT 'market' AS marketplace, CAST(nmId AS VARCHAR) AS external_id FROM k
    WHERE CAST(nmId AS VARCHAR) NOT IN (SELECT CAST(s_suppkey + 102 AS VARCHAR) FROM supplier)"""))
def _(spark, d):
    known = t.table(spark, d, "supplier").select(
        F.lit("market").alias("marketplace"),
        (F.col("s_suppkey") + 102).cast("string").alias("external_id"),
    )
    return ingest.new_products(_keyed(spark, d), known)


@query("products_lookup", oracle("feedback", "products", k=KEYED, select="""
    SELECT * FROM products WHERE external_id IN (SELECT CAST(nmId AS VARCHAR) FROM k)"""))
def _(spark, d):
    return ingest.lookup_products(_keyed(spark, d), t.products(spark, d))


@query("attach_product", oracle("feedback", "products", k=KEYED, select="""
    SELECT seq, review_key, concat('market:', external_id) AS product_id
    FROM k JOIN products ON external_id = CAST(nmId AS VARCHAR)"""))
def _(spark, d):
    rows = ingest.attach_product(_keyed(spark, d), t.products(spark, d))
    return rows.select("seq", "review_key", "product_id")


@query("ingest_counts", oracle("feedback", k=KEYED, select=f"""
    SELECT (SELECT count(*) FROM feedback) AS rows_read, (SELECT count(*) FROM k) AS rows_kept,
           (SELECT count(*) FROM (SELECT *, {sql_clean('text')} AS c FROM feedback)
            WHERE c <> '' AND len(string_split(c, ' ')) >= 3 AND {sql_not_blank('text')}
              AND nmId IS NULL) AS rows_rejected,
           (SELECT count(DISTINCT review_key) FROM k) AS reviews,
           (SELECT count(DISTINCT nmId) FROM k) AS products"""))
def _(spark, d):
    return ingest.counts(t.feedback(spark, d))


# Review upsert. The stored table is an earlier load of the same texts with other stars.

_WINNER = f"""
    SELECT * EXCLUDE (position) FROM (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS position FROM k)
    QUALIFY row_number() OVER (PARTITION BY review_key ORDER BY position // {BATCH} DESC, position) = 1"""


@query("ingest_reviews", oracle("feedback", k=KEYED, w=_WINNER, select=f"""
    SELECT review_key, {_REVIEW} FROM w"""))
def _(spark, d):
    stored, products = spark.createDataFrame([], REVIEWS), spark.createDataFrame([], PRODUCTS)
    return ingest.ingest(t.feedback(spark, d), products, stored, batch_size=BATCH)[1]


@query("reviews_upsert", oracle("feedback", k=KEYED, w=_WINNER, n=f"SELECT review_key, {_REVIEW} FROM w",
    o="""SELECT review_key, concat('old:', nmId) AS product_id, text, 'old' AS text_clean,
                min(productValuation) - 1 AS rating FROM k
         WHERE productValuation >= 3 GROUP BY review_key, nmId, text""", select=f"""
    SELECT review_key, coalesce(o.product_id, n.product_id) AS product_id,
           coalesce(o.text, n.text) AS text, {", ".join("n." + c for c in REVIEW_UPDATE_COLUMNS)}
    FROM n LEFT JOIN o USING (review_key)"""))
def _(spark, d):
    rows = staged(_keyed(spark, d))
    old = rows.where(F.col("productValuation") >= 3).groupBy("review_key", "nmId", "text").agg(
        (F.min("productValuation") - 1).alias("rating")
    )
    stored = old.select(
        "review_key", F.concat(F.lit("old:"), F.col("nmId").cast("string")).alias("product_id"), "text",
        F.lit("old").alias("text_clean"), "rating", F.lit("grey").alias("color"),
        F.lit(None).cast("string").alias("answer"), F.lit(False).alias("has_answer"),
        F.lit(0).alias("review_length"), F.lit(0).alias("word_count"), F.lit(0).alias("answer_length"),
    )
    return ingest.upsert_reviews(rows, stored, batch_size=BATCH)


# Tokens

_RUNS = f"""
    SELECT doc_id, run_no, {sql_keywords('run')} AS tokens
    FROM (SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) AS run_no
          FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_\\-]+') AS runs
                FROM documents))"""
_TOKENS = """
    SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY run_no, token_no) AS pos
    FROM (SELECT doc_id, run_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS token_no
          FROM runs)"""
_TERMS = """
    SELECT doc_id, token AS term FROM tokens
    UNION ALL
    SELECT a.doc_id, concat(a.token, ' ', b.token) FROM tokens a
    JOIN tokens b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1"""


@query("ngrams", oracle(runs=_RUNS, tokens=_TOKENS, terms=_TERMS, select="""
    SELECT doc_id, term, count(*) AS n FROM terms GROUP BY doc_id, term"""))
def _(spark, d):
    return topics.term_counts(_documents(spark, d), "doc_id", "text")
