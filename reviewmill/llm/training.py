"""Shared steps of the text classifiers: bounded samples, sharded fits, averaged weights, scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewmill.llm.common import held_out, texts_of, utf8


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """doc_id and label of the training rows: not held out, labels 0 or 1, one row per doc_id.

    A document with contradicting labels counts as 1.
    """
    return (
        labels.where(F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    )


def sampled(ids: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, always the same ones: the lowest hashes of doc_id."""
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def with_texts(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The sample's texts, one row per id and label. Samples are bounded by their parameters, so they may be broadcast.

    Of an id that stands in several rows, the least text is taken, so the bound holds for rows too.
    """
    rows = texts_of(docs.where(F.col("doc_id").isNotNull()), "doc_id").join(F.broadcast(ids), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def fitted(rows: DataFrame, shards: int, fit: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
           size: int) -> np.ndarray:
    """Average of the `size` weights that `fit(data, offsets, label)` finds on each shard's rows.

    `rows` has doc_id, label and text and is bounded; shards are dealt by hash and each is
    put in one order, so a repeated task gives the same weights.
    """
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
        offsets, data = utf8(table.column("text").combine_chunks())
        weights = fit(data, offsets, table.column("label").to_numpy())
        used = np.flatnonzero(weights)
        return pa.table({"at": pa.array(used), "weight": pa.array(weights[used])})

    parts = dealt.groupBy("shard").applyInArrow(one, "at bigint, weight double")
    found = parts.groupBy("at").agg((F.sum(F.round("weight", 12).cast("decimal(30,12)")) / shards)
                                    .cast("double").alias("weight")).collect()
    out = np.zeros(size)
    for row in found:
        out[row["at"]] = row["weight"]
    return out


def scored(docs: DataFrame, weights: np.ndarray, scores: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray],
           threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold`) of every row."""
    rows = texts_of(docs, "doc_id")
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = utf8(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores(data, offsets, shared.value))], ["doc_id", "score"])

    made = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return made.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                       predicted(F.col("score"), threshold).alias("predicted"))


def predicted(score: Column, threshold: float) -> Column:
    return (score >= threshold).cast("int")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
