"""Stage 1: raw feedback to products and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from reviewmill.functions import text as tx
from reviewmill.operators.merge import insert_absent, merge_columns
from reviewmill.operators.ranks import dense_positions
from reviewmill.operators.skew import salted_join
from reviewmill.schema import BATCH_SIZE, MARKETPLACE, REVIEW_UPDATE_COLUMNS, REVIEWS
from reviewmill.session import staged


def _with_clean_text(rows: DataFrame) -> DataFrame:
    return rows.withColumn("text_clean", tx.computed_once(tx.clean_text(F.col("text"))))


def cleaned(raw: DataFrame) -> DataFrame:
    """NUL-free rows with `text_clean`; texts under three tokens are dropped."""
    rows = _with_clean_text(tx.strip_nul(raw))
    return rows.where(tx.has_enough_tokens(F.col("text_clean")))


def drop_blank(rows: DataFrame) -> DataFrame:
    return rows.where(tx.is_not_blank(F.col("text")))


def normalise_ids(rows: DataFrame) -> DataFrame:
    """Product numbers as longs; what is no number becomes null."""
    return rows.withColumn("nmId", F.col("nmId").try_cast("bigint"))


def rejects(raw: DataFrame) -> DataFrame:
    """Usable texts that no product can be found for."""
    return normalise_ids(drop_blank(cleaned(raw))).where(F.col("nmId").isNull())


def with_features(rows: DataFrame) -> DataFrame:
    """Lengths of the raw text and of the seller's answer."""
    text = F.coalesce("text", F.lit(""))
    answer = F.coalesce("answer", F.lit(""))
    return rows.withColumns({
        "review_length": F.char_length(text),
        "word_count": tx.token_count(text),
        "has_answer": tx.is_not_blank(answer),
        "answer_length": F.char_length(answer),
    })


def checked_seq(rows: DataFrame) -> DataFrame:
    """`rows`, whose every reader fails at a null `seq`, whichever of them Spark runs first."""
    missing = F.raise_error(F.lit("feedback row without seq")).cast("long")
    return rows.withColumn("seq", F.coalesce("seq", missing))


def keyed(raw: DataFrame) -> DataFrame:
    """Usable feedback with features and the review key; a null `seq` is an error."""
    return with_keys(checked_seq(normalise_ids(drop_blank(cleaned(raw)))))


def with_keys(usable_rows: DataFrame) -> DataFrame:
    """Features and keys of usable rows that name a product."""
    return _with_features_and_key(usable_rows.where(F.col("nmId").isNotNull()))


def _with_features_and_key(rows: DataFrame) -> DataFrame:
    return with_features(rows).withColumn("review_key", tx.review_key(F.col("nmId"), F.col("text")))


def product_keys(rows: DataFrame, marketplace: str = MARKETPLACE) -> DataFrame:
    return rows.select(
        F.lit(marketplace).alias("marketplace"), F.col("nmId").cast("string").alias("external_id")
    ).distinct()


def new_products(rows: DataFrame, products: DataFrame, marketplace: str = MARKETPLACE) -> DataFrame:
    return insert_absent(product_keys(rows, marketplace), products, ["marketplace", "external_id"])


def lookup_products(rows: DataFrame, products: DataFrame, marketplace: str = MARKETPLACE) -> DataFrame:
    """Stored products that occur in the rows."""
    keys = product_keys(rows, marketplace)
    return products.join(keys, ["marketplace", "external_id"], "left_semi")


def attach_product(rows: DataFrame, products: DataFrame, marketplace: str = MARKETPLACE) -> DataFrame:
    """Rows of known products with their `product_id`; other rows are dropped."""
    known = products.where(F.col("marketplace") == marketplace).select(
        F.col("external_id").alias("__external"), product_id().alias("product_id")
    )
    rows = rows.withColumn("__external", F.col("nmId").cast("string"))
    return salted_join(rows, known, ["__external"], ["seq"]).drop("__external")


def product_id(marketplace: str | None = None):
    """Business key of a product: marketplace and product number."""
    market = F.col("marketplace") if marketplace is None else F.lit(marketplace)
    number = F.col("external_id") if marketplace is None else F.col("nmId").cast("string")
    return F.concat_ws(":", market, number)


def last_batch_wins(rows: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """One row per review key: of the last batch with that key, the first row.

    Batches are runs of `batch_size` kept rows in `seq` order. Only keys and
    sequence numbers are ranked; whole rows are then kept by a semi-join. The
    winner is a plain aggregate, so a review copied a billion times is reduced
    before the shuffle. A null `seq` is an error. Rows that repeat both key and
    `seq` count as one: the least of them is kept; whether there are such rows is counted
    first, as whole rows move a second time for it.
    """
    rows = checked_seq(rows)  # both sides of the semi-join read it
    at = dense_positions(rows.select("review_key", "seq"), "seq")
    batch = F.floor(F.col("position") / batch_size)
    precedence = batch * batch_size + (batch_size - 1 - F.col("position") % batch_size)
    per_seq = at.groupBy("review_key", "seq").agg(F.count("*").alias("rows"), F.max(precedence).alias("precedence"))
    last = per_seq.groupBy("review_key").agg(F.max_by(F.struct("seq", "rows"), "precedence").alias("last"))
    winners = staged(last.select("review_key", "last.*"))
    kept = rows.join(winners, ["review_key", "seq"], "left_semi").select(*rows.columns)
    if winners.where(F.col("rows") > 1).isEmpty():
        return kept
    others = [c for c in rows.columns if c != "review_key"]
    least = kept.groupBy("review_key").agg(F.min(F.struct(*others)).alias("row"))
    return least.select("review_key", "row.*").select(*rows.columns)


def review_rows(rows: DataFrame, marketplace: str = MARKETPLACE) -> DataFrame:
    """The columns of the reviews table, null-safe."""
    values = {
        "product_id": product_id(marketplace),
        "text": F.coalesce("text", F.lit("")),
        "text_clean": F.coalesce("text_clean", F.lit("")),
        "rating": F.nanvl(F.col("productValuation").cast("double"), F.lit(None)).cast("int"),
    }
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in REVIEWS.fieldNames()])


def upsert_reviews(rows: DataFrame, reviews: DataFrame, marketplace: str = MARKETPLACE,
                   batch_size: int = BATCH_SIZE) -> DataFrame:
    """Next state of the reviews table; a known review keeps its text and product."""
    source = review_rows(last_batch_wins(rows, batch_size), marketplace)
    return merge_columns(reviews, source, "review_key", REVIEW_UPDATE_COLUMNS)


def ingest(raw: DataFrame, products: DataFrame, reviews: DataFrame,
           marketplace: str = MARKETPLACE, batch_size: int = BATCH_SIZE) -> tuple[DataFrame, DataFrame]:
    """Next products and reviews.

    The cleaned rows are staged: the upsert reads their keys first and then the
    winning rows, and cleaning is the costly part. No product join is needed:
    the key of a product follows from the row, and every product of the load is
    in the next products table.
    """
    rows = staged(keyed(raw))
    next_products = products.unionByName(new_products(rows, products, marketplace))
    return next_products, upsert_reviews(rows, reviews, marketplace, batch_size)


def usable(raw: DataFrame) -> DataFrame:
    """Cleaned rows, staged, as reviews, rejects and counts are all taken from them; a null `seq` is an error."""
    return staged(checked_seq(normalise_ids(drop_blank(cleaned(raw)))))


def usable_observed(raw: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """`usable` rows, and rows_read, rows_kept and rows_rejected as seen by the pass that writes them.

    Features and keys are written too, as several steps read them; a key means nothing
    where there is no product.
    """
    read, written = Observation(), Observation()
    kept = F.col("nmId").isNotNull()
    cleaned_rows = cleaned(raw.observe(read, F.count(F.lit(1)).alias("rows_read")))
    rows = staged(_with_features_and_key(checked_seq(normalise_ids(drop_blank(cleaned_rows)))).observe(
        written, F.count_if(kept).alias("rows_kept"), F.count_if(~kept).alias("rows_rejected")))
    return rows, {**read.get, **written.get}


def load_counts(observed: dict[str, int], rows: DataFrame) -> DataFrame:
    """One row of counters of a load: what was observed, and the distinct reviews and products of its keyed rows."""
    distinct = rows.select("nmId", "review_key").distinct()
    per_product = distinct.groupBy("nmId").agg(F.count("*").alias("n"))
    return per_product.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("reviews"), F.count("*").alias("products")
    ).select(*[F.lit(n).cast("long").alias(name) for name, n in observed.items()], "reviews", "products")


def counts(raw: DataFrame) -> DataFrame:
    """Rows read, usable and rejected, and products and reviews among them, in one pass."""
    rows = _with_clean_text(normalise_ids(tx.strip_nul(raw)))
    usable = tx.has_enough_tokens(F.col("text_clean")) & tx.is_not_blank(F.col("text"))
    kept = usable & F.col("nmId").isNotNull()
    key = F.when(kept, tx.review_key(F.col("nmId"), F.col("text")))
    per_review = rows.select(
        usable.alias("usable"), kept.alias("kept"), "nmId", key.alias("review_key")
    ).groupBy("review_key", F.when(F.col("kept"), F.col("nmId")).alias("nmId")).agg(
        F.count("*").alias("n"),
        F.count_if("usable").alias("usable"),
        F.count_if("kept").alias("kept"),
    )
    per_product = per_review.groupBy("nmId").agg(
        F.sum("n").alias("n"), F.sum("usable").alias("usable"), F.sum("kept").alias("kept"),
        F.count("review_key").alias("reviews"),
    )
    return per_product.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.sum("kept"), F.lit(0)).alias("rows_kept"),
        F.coalesce(F.sum(F.col("usable") - F.col("kept")), F.lit(0)).alias("rows_rejected"),
        F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"),
        F.count("nmId").alias("products"),
    )
