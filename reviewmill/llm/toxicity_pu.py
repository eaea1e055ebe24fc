"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; texts of any documents, labels unseen, are the
unlabelled rows, a share `prior` of which is toxic. With the logistic loss the risk is

    prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives)),

whose second part is the corrected risk of the negatives. Where a batch makes that part
negative, a step is taken back along it alone, so that the classifier can't fit it below
zero. At the end the intercept is set so that the share of unlabelled rows scored 0.5 or
more is the class prior. Features are the distinct words of a text, hashed; weights are
fitted by numpy with per-weight steps and a proximal L1 step, which drops chance words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.llm import training
from reviewmill.llm.common import (
    LOWER, cut_at_space, held_out, prefix_sums, slices, substring_hashes, utf8, word_spans,
)
from reviewmill.llm.features import BITS

SHARD_POSITIVES = 2_000
SHARD_UNLABELLED = 10_000
SHARDS = 4
STEPS = 500
RATE, L1 = 0.1, 4e-4
BATCH_POSITIVES, BATCH_UNLABELLED = 256, 1024
LEAST_SHARE = 0.003
LEAST_POSITIVE_SHARE = 0.01
THRESHOLD = 0.5
_INTERCEPT = 1 << BITS


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, rows = word_spans(data, offsets)
    hashes = substring_hashes(prefix_sums(LOWER[data]), starts, ends)
    return rows, (hashes >> np.uint64(64 - BITS)).astype(np.int64)


def _word_sets(data: np.ndarray, offsets: np.ndarray):
    """low, high, and row and bucket of each distinct word of the texts low to high - 1."""
    for low, high in slices(offsets):
        part, cut = data[offsets[low]:offsets[high]], offsets[low:high + 1] - offsets[low]
        if high - low == 1:
            pieces = [_words(part[a:b], np.array([0, b - a]))[1] for a, b in cut_at_space(part)]
            code = np.unique(np.concatenate([np.zeros(0, np.int64), *pieces]))
        else:
            row, bucket = _words(part, cut)
            code = np.unique(row << BITS | bucket)
        yield low, high, code >> BITS, code & ((1 << BITS) - 1)


def _gathered(bounds: np.ndarray, bucket: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the chosen rows, and which of them each belongs to."""
    sizes = bounds[rows + 1] - bounds[rows]
    owner = np.repeat(np.arange(len(rows)), sizes)
    ends = np.cumsum(sizes)
    return bucket[np.arange(len(owner)) - np.repeat(ends - sizes - bounds[rows], sizes)], owner


def fit(data: np.ndarray, offsets: np.ndarray, positive: np.ndarray, prior: float) -> np.ndarray:
    """Weights and intercept from rows marked 1 (confirmed toxic) or 0 (unlabelled)."""
    times, toxic_times = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for low, _, row, bucket in _word_sets(data, offsets):
        times += np.bincount(bucket, minlength=1 << BITS)
        toxic_times += np.bincount(bucket[positive[row + low] == 1], minlength=1 << BITS)
    # A word that is rare over all rows may still mark the few positives.
    often = (times >= max(2, LEAST_SHARE * len(positive))) | (
        toxic_times >= max(2, LEAST_POSITIVE_SHARE * (positive == 1).sum()))
    # Hashed again rather than held: most words are too rare to be kept.
    rows, buckets = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for low, _, row, bucket in _word_sets(data, offsets):
        rows.append((row[often[bucket]] + low).astype(np.int32))
        buckets.append(bucket[often[bucket]].astype(np.int32))
    row, bucket = np.concatenate(rows), np.concatenate(buckets)
    toxic, others = np.flatnonzero(positive == 1), np.flatnonzero(positive == 0)
    weights = np.zeros(_INTERCEPT + 1)
    if not len(toxic) or not len(others):
        weights[_INTERCEPT] = -1.0
        return weights
    bounds = np.searchsorted(row, np.arange(len(positive) + 1))
    squares = np.full(_INTERCEPT + 1, 1e-8)
    weights[_INTERCEPT] = np.log(prior / (1 - prior))
    choose = np.random.default_rng(0)
    for _ in range(STEPS):
        bp, op = _gathered(bounds, bucket, choose.choice(toxic, BATCH_POSITIVES))
        bu, ou = _gathered(bounds, bucket, choose.choice(others, BATCH_UNLABELLED))
        fp = np.bincount(op, weights[bp], BATCH_POSITIVES) + weights[_INTERCEPT]
        fu = np.bincount(ou, weights[bu], BATCH_UNLABELLED) + weights[_INTERCEPT]
        negatives = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        down = -prior * training.sigmoid(fp) / BATCH_POSITIVES
        up = training.sigmoid(fu) / BATCH_UNLABELLED
        if negatives >= 0:
            gp, gu = down - prior * training.sigmoid(-fp) / BATCH_POSITIVES, up
        else:
            gp, gu = -down, -up
        slope = (np.bincount(bp, gp[op], _INTERCEPT + 1) + np.bincount(bu, gu[ou], _INTERCEPT + 1))
        slope[_INTERCEPT] = gp.sum() + gu.sum()
        squares += slope * slope
        step = RATE / np.sqrt(squares)
        weights -= step * slope
        words = weights[:_INTERCEPT]
        words[:] = np.sign(words) * np.maximum(0, np.abs(words) - step[:_INTERCEPT] * L1)
    raw = np.bincount(row, weights[bucket], len(positive))[others]
    weights[_INTERCEPT] = -np.quantile(raw, 1 - prior)
    return weights


def _scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(offsets) - 1)
    for low, high, row, bucket in _word_sets(data, offsets):
        out[low:high] = np.bincount(row, weights[bucket], high - low)
    return training.sigmoid(out + weights[_INTERCEPT])


def weights(docs: DataFrame, labels: DataFrame, shards: int = SHARDS, shard_positives: int = SHARD_POSITIVES,
            shard_unlabelled: int = SHARD_UNLABELLED) -> np.ndarray:
    """Averaged weights of up to `shards` fits on bounded samples.

    The class prior is the share of toxic ones among all labelled training rows. Held-out
    documents are neither positives nor unlabelled rows.
    """
    known = training.labelled(labels, "toxic")
    total, toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = min(0.5, max(1e-4, toxic / max(1, total)))
    number = max(1, min(shards, round(toxic / shard_positives)))
    positives = training.sampled(known.where("label = 1"), number * shard_positives)
    some = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    unlabelled = training.sampled(some, number * shard_unlabelled).withColumn("label", F.lit(0))
    ids = positives.select("doc_id", "label").unionByName(unlabelled)
    return training.fitted(
        training.with_texts(ids, docs), number, lambda d, o, p: fit(d, o, p, prior), _INTERCEPT + 1)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic) and predicted of every row's whole text.

    Null and empty texts get the score of a text without known words. Without toxic
    training rows nothing is predicted toxic. Every input row gives one row.
    """
    return training.scored(docs, weights(docs, labels), _scores, threshold)


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs` that are not predicted toxic, all columns kept.

    Null and empty texts hold no known word, so they are kept unless most texts are toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights(docs, labels).astype(np.float32))

    # Columns go by position meanwhile, so that any name will do.
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{docs.columns.index('text')}"

    def run(batches):
        for batch in batches:
            offsets, data = utf8(batch.column(text))
            yield batch.filter(pa.array(_scores(data, offsets, shared.value) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
