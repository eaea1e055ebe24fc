"""Classifiers on planted words, and their handling of awkward rows."""

import zlib

import numpy as np
import pytest

from reviewmill.llm import quality_ftrl, toxicity_pu
from reviewmill.llm.common import utf8, word_spans
from reviewmill.llm.features import rows_of
from reviewmill.llm.fingerprints import pa


def planted(spark, mark, share, n=1500):
    """Documents of chance words, `share` of which hold the mark, and labels that say so.

    The mark is a word for toxicity, and shouted words for quality.
    """
    rng = np.random.default_rng(3)
    hit = rng.random(n) < share
    rows = []
    for i in range(n):
        words = [f"w{w}" for w in rng.integers(0, 4000, 60)]
        if hit[i]:
            words[int(rng.integers(0, 60))] = mark
            if mark == "!!":
                words[:20] = [f"{w.upper()}!!" for w in words[:20]]
        rows.append((i, " ".join(words), f"x{i}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(not hit[i]), int(hit[i])) for i in range(n)],
                                   "doc_id long, quality int, toxic int")
    return docs, labels, hit


@pytest.mark.parametrize("scores, positive, mark", [
    (toxicity_pu.scores, lambda hit: hit, "vile"), (quality_ftrl.scores, lambda hit: ~hit, "!!")])
def test_held_out_accuracy(spark, scores, positive, mark):
    docs, labels, hit = planted(spark, mark, 0.25)
    got = sorted(scores(docs, labels).collect())
    truth = positive(hit)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    test = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) >= 0.95
    # Held-out labels change nothing.
    flipped = labels.selectExpr("doc_id", *[
        f"CASE WHEN crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - {c} ELSE {c} END AS {c}"
        for c in ("quality", "toxic")])
    assert [r.score for r in sorted(scores(docs, flipped).collect())] == [r.score for r in got]


@pytest.mark.parametrize("scores", [toxicity_pu.scores, quality_ftrl.scores])
def test_awkward_rows_are_scored(spark, awkward, awkward_rows, nothing, scores):
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (7, None, None), (3, 0, 0), (9999, 1, 1)],
        "doc_id long, quality int, toxic int")
    got = scores(awkward, labels).collect()
    assert len(got) == len(awkward_rows)
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(r[0] for r in awkward_rows if r[0] is not None)
    assert all(0 <= r.score <= 1 for r in got)
    by_text = {}
    for r in got:
        text = next(x[1] or "" for x in awkward_rows if x[0] == r.doc_id)
        if r.doc_id not in (5, 6):
            by_text.setdefault(text, set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    assert len(scores(awkward, labels.where("false")).collect()) == len(awkward_rows)
    assert scores(nothing, labels).count() == 0


def test_rejected_rows_go_and_columns_stay(spark):
    docs, labels, hit = planted(spark, "vile", 0.25)
    kept = toxicity_pu.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([hit[i] for i in ids]) < 0.03 and len(ids) > 0.7 * len(hit)


def test_risk_of_negatives_is_held_at_zero():
    """With all mass positive the corrected risk can't be driven below zero."""
    texts = [f"vile w{i % 7}" for i in range(60)] + [f"w{i % 7} vile" for i in range(200)]
    offsets, data = utf8(pa.array(texts, pa.large_string()))
    marks = np.array([1] * 60 + [0] * 200)
    weights = toxicity_pu.fit(data, offsets, marks, 0.5)
    assert np.isfinite(weights).all() and np.abs(weights).max() < 100


def test_word_spans_by_brute_force():
    texts = ["a  bb\tccc", "", " ", "dd", "é ü", "x" * 10, " y ", "z"]
    offsets, data = utf8(pa.array(texts, pa.large_string()))
    starts, ends, rows = word_spans(data, offsets)
    got = [(int(r), data[a:b].tobytes()) for a, b, r in zip(starts, ends, rows)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in t.encode().split()]


def test_ngrams_of_a_long_text_equal_those_of_a_short_slice(monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(5000))
    offsets, data = utf8(pa.array([text], pa.large_string()))
    whole = {(int(b), int(t)) for _, _, _, bucket, times in rows_of(data, offsets) for b, t in zip(bucket, times)}
    assert sum(t for _, t in whole) == 5000 + 4999
