"""Sentiment and embedding jobs over the reviews that still lack them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, IndexToString, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.functions.text import computed_once
from reviewmill.functions.vectors import argmax, l2_normalise, normalise_label, softmax
from reviewmill.operators.skew import HOT_ROWS, hot_key_join, hot_keys
from reviewmill.plans.incremental import pending_embedding, pending_sentiment
from reviewmill.schema import EMBEDDING_BATCH_SIZE, EMBEDDING_DIM, SENTIMENT_BATCH_SIZE, TOKEN_BUDGET

Scorer = Callable[[DataFrame], DataFrame]
PIECE_CHARS = 2 << 20


def distinct_texts(pending: DataFrame) -> DataFrame:
    """Each text once, with the number of its copies. Copies are counted before the shuffle."""
    return pending.groupBy("text_clean").agg(F.count("*").alias("copies"))


def score_once(pending: DataFrame, scorer: Scorer, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Score every distinct text once and give each review its text's result.

    Texts are shuffled once, to find the distinct ones; from there a 128-bit digest
    stands for them. The scored side is about as long as the reviews, and one text
    may be on a third of them: only texts with that many copies are repeated for the
    join. They are found from the digests of the reviews, so the scorer runs in one branch only.
    """
    digest = F.md5("text_clean")
    texts = distinct_texts(pending).withColumn("digest", digest)
    rows = pending.withColumn("digest", digest).drop("text_clean")
    hot = hot_keys(rows.groupBy("digest").agg(F.count("*").alias("copies")), ["digest"], "copies", hot_rows)
    joined = hot_key_join(rows, scorer(texts).drop("text_clean", "copies"), ["digest"], hot, ["review_key"])
    return joined.drop("digest")


def padded_batches(lengths: list[int], rows: int, budget: int) -> Iterator[tuple[int, int]]:
    """Runs of at most `rows` texts whose number times their longest length is within `budget`; a longer text alone."""
    low, longest = 0, 0
    for i, length in enumerate(lengths):
        if i > low and (i - low == rows or max(longest, length) * (i + 1 - low) > budget):
            yield low, i
            low, longest = i, 0
        longest = max(longest, length)
    if lengths:
        yield low, len(lengths)


def _attempt(predict: Callable, texts: np.ndarray, low: int, high: int, out: list, errors: list) -> None:
    """Outputs of texts low to high - 1; a batch that fails is halved until only the failing texts have errors."""
    try:
        made = np.asarray(predict(texts[low:high]), np.float32)
        if len(made) != high - low:
            raise ValueError(f"{len(made)} results for {high - low} texts")
        out[low:high] = list(made)
    except Exception as error:  # the model is the caller's: whatever it raises concerns these texts only
        if high - low == 1:
            errors[low] = f"{type(error).__name__}: {error}"
        else:
            middle = (low + high) // 2
            _attempt(predict, texts, low, middle, out, errors)
            _attempt(predict, texts, middle, high, out, errors)


def _pieces(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most `PIECE_CHARS` in all; a larger row alone."""
    ends, low = np.cumsum(sizes), 0
    while low < len(sizes):
        high = int(np.searchsorted(ends, ends[low] - sizes[low] + PIECE_CHARS, "right"))
        yield low, max(high, low + 1)
        low = max(high, low + 1)


def _called(texts: DataFrame, make_predict: Callable, batch_size: int, budget: int) -> DataFrame:
    """`texts` with the caller's `raw` output per text, or the `error` its model raised.

    Within a task the longest texts come first, so batches hold texts of like length and
    waste least padding; a batch is bounded by texts and by padded tokens. A frame, which Spark
    bounds by bytes, is scored and given back in pieces of `PIECE_CHARS`, so Python does not
    hold its texts a second and a third time.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            predict = make_predict()
        except Exception as error:
            message = f"{type(error).__name__}: {error}"

            def predict(_):
                raise RuntimeError(message)
        for frame in frames:
            for begin, end in _pieces(np.array([len(w) for w in frame["text_clean"]], np.int64)):
                part = frame.iloc[begin:end]
                words = part["text_clean"].to_numpy()
                out, errors = [None] * len(words), [None] * len(words)
                for low, high in padded_batches([len(w.split()) for w in words], batch_size, budget):
                    _attempt(predict, words, low, high, out, errors)
                yield part.assign(
                    raw=pd.Series(out, part.index, dtype=object), error=pd.Series(errors, part.index, dtype=object))
            frame = part = words = None  # the next frame is read while these names still hold this one

    schema = T.StructType([*texts.schema.fields, T.StructField("raw", T.ArrayType(T.FloatType())),
                           T.StructField("error", T.StringType())])
    ordered = texts.sortWithinPartitions(F.char_length("text_clean").desc())
    return ordered.mapInPandas(run, schema)


def batch_sentiment(make_predict: Callable, labels: list[str], batch_size: int = SENTIMENT_BATCH_SIZE,
                    budget: int = TOKEN_BUDGET) -> Scorer:
    """Scorer around a caller's classifier.

    `make_predict` runs once per task and returns a function from an array of texts to a
    matrix of logits, one column per name in `labels`. Texts it fails on get an `error`.
    """
    def score(texts: DataFrame) -> DataFrame:
        scored = _called(texts, make_predict, batch_size, budget)
        scored = scored.withColumn("probability", computed_once(softmax(F.col("raw"))))
        name = F.element_at(F.array(*[F.lit(x) for x in labels]), argmax(F.col("probability")) + 1)
        made = F.col("error").isNull()
        return scored.select(
            *texts.columns, F.when(made, normalise_label(name)).alias("sentiment_label"),
            F.when(made, F.array_max("probability")).alias("sentiment_score"), "error",
        )
    return score


def train_sentiment(labelled: DataFrame, features: int = 1 << 18, max_iter: int = 50) -> PipelineModel:
    """Bag-of-words classifier on `text_clean` and `sentiment_label`, for when no model is given.

    Every partition sends its whole gradient (`features` by labels) in every iteration, so
    there are no more partitions than cores, however many rows there are.
    """
    rows = labelled.select("sentiment_label", F.split("text_clean", " ").alias("tokens")).coalesce(
        labelled.sparkSession.sparkContext.defaultParallelism)
    index = StringIndexer(inputCol="sentiment_label", outputCol="target", stringOrderType="alphabetAsc")
    index_model = index.fit(rows)
    stages = [
        index_model,
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
        LogisticRegression(labelCol="target", maxIter=max_iter, regParam=0.01),
        IndexToString(inputCol="prediction", outputCol="predicted", labels=index_model.labels),
    ]
    fitted = Pipeline(stages=stages).fit(rows)
    return PipelineModel(fitted.stages[1:])


def model_sentiment(model: PipelineModel) -> Scorer:
    def score(texts: DataFrame) -> DataFrame:
        scored = model.transform(texts.withColumn("tokens", F.split("text_clean", " ")))
        return scored.select(
            *texts.columns, normalise_label(F.col("predicted")).alias("sentiment_label"),
            F.array_max(vector_to_array("probability")).alias("sentiment_score"),
        )
    return score


def score_sentiment(reviews: DataFrame, review_ml: DataFrame, scorer: Scorer) -> DataFrame:
    """Label and score of every review that has none yet; with a caller's model also its `error`."""
    return score_once(pending_sentiment(reviews, review_ml), scorer)


def batch_embedding(make_predict: Callable, batch_size: int = EMBEDDING_BATCH_SIZE,
                    budget: int = TOKEN_BUDGET) -> Scorer:
    """Scorer around a caller's text encoder; vectors are brought to unit length, failing texts get an `error`."""
    def score(texts: DataFrame) -> DataFrame:
        encoded = _called(texts, make_predict, batch_size, budget)
        return encoded.select(*texts.columns, l2_normalise(F.col("raw")).alias("embedding"), "error")
    return score


def train_embedding(texts: DataFrame, dim: int = EMBEDDING_DIM) -> PipelineModel:
    """Hashed, IDF-weighted unit vectors of `dim`, for when no encoder is given."""
    rows = texts.select(F.split("text_clean", " ").alias("tokens"))
    stages = [
        HashingTF(inputCol="tokens", outputCol="tf", numFeatures=dim),
        IDF(inputCol="tf", outputCol="weighted"),
        Normalizer(inputCol="weighted", outputCol="unit", p=2.0),
    ]
    return Pipeline(stages=stages).fit(rows)


def model_embedding(model: PipelineModel) -> Scorer:
    def score(texts: DataFrame) -> DataFrame:
        scored = model.transform(texts.withColumn("tokens", F.split("text_clean", " ")))
        return scored.select(*texts.columns, vector_to_array("unit", "float32").alias("embedding"))
    return score


def embed(reviews: DataFrame, review_ml: DataFrame, scorer: Scorer) -> DataFrame:
    """Unit vector of every review that has none yet; with a caller's model also its `error`."""
    return score_once(pending_embedding(reviews, review_ml), scorer)
