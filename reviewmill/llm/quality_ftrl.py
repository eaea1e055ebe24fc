"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

Features are words, word pairs, and the same over word shapes (classes of characters, and
whether a word repeats one just before it), each valued by the square root of its share of
the text's n-grams. A text is scored by the sparse dot product with the weights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from reviewmill.llm import training
from reviewmill.llm.features import BITS, rows_of

SHARD_ROWS = 10_000
SHARDS = 4
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.05, 1.0
THRESHOLD = 0.3


def _leader(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _values(times: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    return np.sqrt(times / np.maximum(1, np.bincount(at, times, rows))[at])


def fit(data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights after `EPOCHS` passes over the rows in seeded random order, one update per row."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    held = []
    for low, high, at, bucket, times in rows_of(data, offsets, shapes=True):
        bounds = np.searchsorted(at, np.arange(high - low + 1))
        value = _values(times, at, high - low)
        held += [(bucket[a:b].astype(np.int32), value[a:b]) for a, b in zip(bounds, bounds[1:])]
    order = np.random.default_rng(0)
    for _ in range(EPOCHS):
        for i in order.permutation(len(held)):
            bucket, value = held[i]
            weight = _leader(z[bucket], n[bucket])
            slope = (training.sigmoid(weight @ value) - label[i]) * value
            step = (np.sqrt(n[bucket] + slope * slope) - np.sqrt(n[bucket])) / ALPHA
            z[bucket] += slope - step * weight
            n[bucket] += slope * slope
    return _leader(z, n)


def _scores(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.full(len(offsets) - 1, 0.5)
    for low, high, at, bucket, times in rows_of(data, offsets, shapes=True):
        value = _values(times, at, high - low)
        out[low:high] = training.sigmoid(np.bincount(at, value * weights[bucket], high - low))
    return out


def weights(docs: DataFrame, labels: DataFrame, shards: int = SHARDS, shard_rows: int = SHARD_ROWS) -> np.ndarray:
    """Averaged weights of up to `shards` fits of about `shard_rows` labelled training rows each."""
    ids = training.sampled(training.labelled(labels, "quality"), shards * shard_rows)
    number = max(1, min(shards, round(ids.count() / shard_rows)))
    return training.fitted(training.with_texts(ids, docs), number, fit, 1 << BITS)


def scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted of every row's whole text.

    Null and empty texts score 0.5, as do all texts when there are no labelled rows. Every
    input row gives one row; rows without a doc_id are scored but never learned from.
    """
    return training.scored(docs, weights(docs, labels), _scores, threshold)
