"""Registration of runnable queries and the SQL text their results are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reviewmill.functions.text import HTML_TAG, LETTER, URL, WS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query; without `oracle` only its rows are checked."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return add


LINE_KEY = (
    "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, "
    "date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)))"
)

TABLES = {
    "reviews": f"""
        SELECT {LINE_KEY} AS review_key, l_partkey AS product_id,
               concat_ws(' ', 'order', l_orderkey, 'line', l_linenumber) AS text,
               CASE WHEN l_quantity < 50
                    THEN concat_ws(' ', 'order', l_orderkey, 'line', l_linenumber)
                    ELSE '' END AS text_clean,
               CASE WHEN l_discount < 0.095 THEN
                    CAST(greatest(1, least(5, floor((l_quantity - 1) / 10) + 1 + l_partkey % 7 - 3))
                         AS INTEGER) END AS rating,
               CASE WHEN l_quantity > 1 THEN concat('c', l_partkey % 40) END AS color,
               CASE WHEN l_linestatus = 'F' THEN 'thanks' END AS answer,
               l_linestatus = 'F' AS has_answer,
               CAST(floor(l_extendedprice / 100) AS INTEGER) AS review_length,
               CAST(l_quantity AS INTEGER) AS word_count,
               CAST(CASE WHEN l_linestatus = 'F' THEN l_linenumber * 10 ELSE 0 END AS INTEGER)
                    AS answer_length
        FROM lineitem""",
    "review_ml": f"""
        SELECT review_key, sentiment_label,
               CASE WHEN sentiment_label IS NOT NULL THEN 0.5 + round(l_discount * 100) / 32 END
                    AS sentiment_score,
               CASE WHEN sentiment_label IN ('positive', 'negative') AND l_quantity > 10
                    THEN concat_ws('|', l_partkey, left(sentiment_label, 3), l_linenumber) END
                    AS topic_id,
               CAST(NULL AS DOUBLE) AS fake_score,
               CASE WHEN l_tax > 0.005
                    THEN greatest(1.0::DOUBLE, least(5.0::DOUBLE, 3 + round(l_tax * 100 - 4) / 4))
                    END AS predicted_rating,
               CASE WHEN l_quantity <= 30
                    THEN [CAST(l_quantity AS FLOAT), CAST(l_linenumber AS FLOAT)] END AS embedding
        FROM (SELECT *, {LINE_KEY} AS review_key,
                     CASE WHEN l_returnflag = 'R' THEN 'negative'
                          WHEN l_returnflag = 'A' THEN 'positive'
                          WHEN l_tax < 0.075 THEN 'neutral' END AS sentiment_label
              FROM lineitem WHERE l_shipdate < TIMESTAMP '2000-01-01')""",
    "topics": """
        SELECT topic_id,
               CAST(split_part(topic_id, '|', 1) AS BIGINT) AS product_id,
               split_part(topic_id, '|', 2) AS polarity,
               CAST(split_part(topic_id, '|', 3) AS INTEGER) AS topic_no,
               concat('quality of stitching and seams, ', split_part(topic_id, '|', 2),
                      ', delivery and packaging ', split_part(topic_id, '|', 3)) AS keywords,
               count(*) AS review_count
        FROM review_ml WHERE topic_id IS NOT NULL GROUP BY topic_id""",
    "products": """
        SELECT 'market' AS marketplace, CAST(p_partkey AS VARCHAR) AS external_id FROM part""",
    "negative_share": """
        SELECT product_id, 'high_negative_share' AS rule_name,
               CASE WHEN pct >= 0.5 THEN 'high' ELSE 'medium' END AS severity,
               '{"neg_pct":' || CAST(CAST(printf('%.3f', pct) AS DOUBLE) AS VARCHAR)
               || ',"neg_count":' || neg || ',"total_reviews":' || total || '}' AS details
        FROM (SELECT product_id, count(*) AS total,
                     count(*) FILTER (sentiment_label = 'negative') AS neg, neg::DOUBLE / total AS pct
              FROM reviews JOIN review_ml USING (review_key) GROUP BY product_id)
        WHERE total >= 10 AND pct > 0.3""",
    "mismatch": """
        SELECT product_id, 'rating_sentiment_mismatch' AS rule_name,
               CASE WHEN pct >= 0.35 THEN 'high' ELSE 'medium' END AS severity,
               '{"avg_rating":' || CAST(CAST(printf('%.2f', stars) AS DOUBLE) AS VARCHAR)
               || ',"neg_pct":' || CAST(CAST(printf('%.3f', pct) AS DOUBLE) AS VARCHAR)
               || ',"neg_count":' || neg || ',"total_reviews":' || total || '}' AS details
        FROM (SELECT product_id, count(*) AS total, avg(rating) AS stars,
                     count(*) FILTER (sentiment_label = 'negative') AS neg, neg::DOUBLE / total AS pct
              FROM reviews JOIN review_ml USING (review_key) GROUP BY product_id)
        WHERE total >= 10 AND stars >= 4 AND pct > 0.2""",
    "gaps": """
        SELECT product_id, count(*) AS review_count, avg(rating) AS real_avg,
               avg(predicted_rating) AS pred_avg, avg(rating) - avg(predicted_rating) AS gap
        FROM reviews JOIN review_ml USING (review_key)
        WHERE predicted_rating IS NOT NULL GROUP BY product_id HAVING count(*) >= 20""",
    "gap_alerts": """
        SELECT product_id, 'predicted_rating_gap' AS rule_name,
               CASE WHEN gap >= 1 THEN 'high' ELSE 'medium' END AS severity,
               '{"real_avg":' || CAST(CAST(printf('%.3f', real_avg) AS DOUBLE) AS VARCHAR)
               || ',"predicted_avg":' || CAST(CAST(printf('%.3f', pred_avg) AS DOUBLE) AS VARCHAR)
               || ',"gap":' || CAST(CAST(printf('%.3f', gap) AS DOUBLE) AS VARCHAR)
               || ',"total_reviews":' || review_count || '}' AS details
        FROM gaps WHERE gap > 0.5""",
    "low_rating": """
        SELECT product_id, 'low_overall_rating' AS rule_name,
               CASE WHEN stars < 2 THEN 'high' ELSE 'medium' END AS severity,
               '{"avg_rating":' || CAST(CAST(printf('%.3f', stars) AS DOUBLE) AS VARCHAR)
               || ',"total_reviews":' || total || '}' AS details
        FROM (SELECT product_id, count(*) AS total, avg(rating) AS stars FROM reviews GROUP BY product_id)
        WHERE total >= 5 AND stars < 3""",
    "alerts": """
        SELECT * FROM negative_share UNION ALL SELECT * FROM mismatch
        UNION ALL SELECT * FROM gap_alerts UNION ALL SELECT * FROM low_rating""",
    "effects": """
        SELECT product_id, review_count,
               CAST(printf('%.3f', real_avg) AS DOUBLE) AS real_avg_rating,
               CAST(printf('%.3f', pred_avg) AS DOUBLE) AS predicted_avg_rating,
               CAST(printf('%.3f', gap) AS DOUBLE) AS rating_gap,
               CAST(printf('%.4f', greatest(0, gap * 0.15::DOUBLE)) AS DOUBLE) AS conversion_drop_pct,
               CAST(printf('%.2f', 1000.0::DOUBLE * greatest(0, gap * 0.15::DOUBLE) * 1000.0::DOUBLE)
                    AS DOUBLE) AS lost_revenue
        FROM gaps""",
    "feedback": """
        SELECT doc_id AS seq,
               CAST(CASE lang WHEN 'en' THEN 101 WHEN 'fr' THEN 102 WHEN 'de' THEN 103 END AS BIGINT)
                    AS nmId,
               text, CAST(n_chars % 5 + 1 AS INTEGER) AS productValuation, source AS color,
               CAST(NULL AS VARCHAR) AS answer
        FROM documents""",
    "feedback_turns": """
        SELECT u.conv_id * 1000 + u.turn AS seq, u.conv_id % 20 AS nmId, u.text AS text,
               CAST(length(u.text) % 5 + 1 AS INTEGER) AS productValuation,
               CAST(NULL AS VARCHAR) AS color, a.text AS answer
        FROM conversations u LEFT JOIN conversations a
             ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
        WHERE u.role = 'user'""",
}
_NEEDS = {
    "topics": ["review_ml"],
    "negative_share": ["reviews", "review_ml"],
    "mismatch": ["reviews", "review_ml"],
    "gaps": ["reviews", "review_ml"],
    "gap_alerts": ["gaps"],
    "low_rating": ["reviews"],
    "alerts": ["negative_share", "mismatch", "gap_alerts", "low_rating"],
    "effects": ["gaps"],
}


def _closure(names: tuple[str, ...]) -> list[str]:
    order: list[str] = []
    for name in names:
        for needed in [*_closure(tuple(_NEEDS.get(name, []))), name]:
            if needed not in order:
                order.append(needed)
    return order


def oracle(*tables: str, select: str, **ctes: str) -> str:
    """SQL over the named derived tables and further CTEs."""
    parts = [f"{name} AS ({TABLES[name]})" for name in _closure(tables)]
    parts += [f"{name} AS ({body})" for name, body in ctes.items()]
    head = "WITH " + ",\n".join(parts) + "\n" if parts else ""
    return head + select


# Text rules in the oracle's regex dialect.

def sql_clean(text: str) -> str:
    plain = (
        f"regexp_replace(regexp_replace(coalesce({text}, ''), '{HTML_TAG}', ' ', 'g'), "
        f"'{URL}', ' ', 'g')"
    )
    tokens = f"string_split({sql_collapse(f'lower({plain})')}, ' ')"
    return f"array_to_string(list_slice({tokens}, 1, 512), ' ')"


def sql_collapse(text: str) -> str:
    return f"trim(regexp_replace({text}, '[{WS}]+', ' ', 'g'))"


def sql_tokens(text: str) -> str:
    collapsed = sql_collapse(f"coalesce({text}, '')")
    return f"CASE WHEN {collapsed} = '' THEN 0 ELSE len(string_split({collapsed}, ' ')) END"


def sql_not_blank(text: str) -> str:
    return f"coalesce(regexp_matches({text}, '[^{WS}]'), false)"


def sql_keywords(run: str) -> str:
    """Keyword tokens of one run of word characters and hyphens.

    A part between hyphens with any other letter or digit is replaced by `#`,
    hyphens at the end of the run are dropped, and the rest is matched.
    """
    marked = f"regexp_replace({run}, '[{LETTER}]*[^{LETTER}\\-][^\\-]*', '#', 'g')"
    return f"regexp_extract_all(regexp_replace({marked}, '-+$', ''), '[{LETTER}][{LETTER}\\-]{{2,}}')"


KEYED = f"""
    SELECT *, substring(sha256(concat(CAST(nmId AS VARCHAR), ':', text)), 1, 32) AS review_key,
           length(text) AS review_length, {sql_tokens('text')} AS word_count,
           {sql_not_blank('answer')} AS has_answer, length(coalesce(answer, '')) AS answer_length
    FROM (SELECT *, {sql_clean('text')} AS text_clean
          FROM (SELECT * REPLACE (replace(text, chr(0), '') AS text) FROM feedback))
    WHERE text_clean <> '' AND len(string_split(text_clean, ' ')) >= 3
      AND {sql_not_blank('text')} AND nmId IS NOT NULL"""
