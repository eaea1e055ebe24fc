"""Learners and fingerprints against plain Python, and the whole pipeline on awkward rows."""

import math
from collections import Counter

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from reviewmill.llm import features, fingerprints, quality_ftrl, suffix_dedup, toxicity_pu
from reviewmill.llm.common import utf8

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def column(texts):
    offsets, data = utf8(pa.array(texts, pa.large_string()))
    return data, offsets


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def word_hash(word):
    return mix(sum((b + 1) * pow(BASE, i, 1 << 64) for i, b in enumerate(word)) + len(word) & MASK)


def plain_fingerprint(text):
    words = [word_hash(w) for w in (text or "").encode().split()]
    terms = [mix(a * 3 + b & MASK) for a, b in zip(words, words[1:])] or words
    votes = [0] * 64
    for term, times in Counter(t >> 12 for t in terms).items():
        weight, hashed = round(1024 * (1 + math.log(times))), mix(term)
        for bit in range(64):
            votes[bit] += weight if hashed >> bit & 1 else -weight
    return sum(1 << bit for bit in range(64) if votes[bit] > 0) if words else 0


def test_fingerprints_equal_plain_python(awkward_rows):
    texts = [r[1] or "" for r in awkward_rows if len(r[1] or "") < 5000] + ["a a a b a a", "x\ty\nz", " é ü"]
    data, offsets = column(texts)
    assert fingerprints.simhash(data, offsets).tolist() == [plain_fingerprint(t) for t in texts]


def noise(n, seed, mark=None):
    rng = np.random.default_rng(seed)
    rows = [" ".join(f"w{w}" for w in rng.integers(0, 300, 12)) for _ in range(n)]
    return [f"{mark} {t}" if mark else t for t in rows]


def plain_rows(texts, shapes):
    """bucket -> count of each text, from the n-gram hashing that its own test checks."""
    out = [dict() for _ in texts]
    for low, _, at, bucket, times in features.rows_of(*column(texts), shapes=shapes):
        for a, b, t in zip(at.tolist(), bucket.tolist(), times.tolist()):
            out[low + a][b] = t
    return out


def test_ftrl_equals_one_update_a_row_in_plain_python():
    texts = noise(40, 1) + noise(40, 2, "SHOUT!! SHOUT!!") + [""]
    labels = [1] * 40 + [0] * 40 + [1]
    rows = [{b: math.sqrt(t / sum(r.values())) for b, t in r.items()} for r in plain_rows(texts, True)]
    q = quality_ftrl
    z, n = Counter(), Counter()

    def weight(b):
        return 0.0 if abs(z[b]) <= q.L1 else (math.copysign(q.L1, z[b]) - z[b]) / ((q.BETA + math.sqrt(n[b])) / q.ALPHA + q.L2)

    order = np.random.default_rng(0)
    for _ in range(q.EPOCHS):
        for i in order.permutation(len(texts)):
            w = {b: weight(b) for b in rows[i]}
            p = 1 / (1 + math.exp(-sum(w[b] * v for b, v in rows[i].items())))
            for b, v in rows[i].items():
                g = (p - labels[i]) * v
                z[b] += g - (math.sqrt(n[b] + g * g) - math.sqrt(n[b])) / q.ALPHA * w[b]
                n[b] += g * g
    got = q.fit(*column(texts), np.array(labels))
    assert {b for b in z if weight(b)} == set(np.flatnonzero(got).tolist())
    assert np.allclose([got[b] for b in z], [weight(b) for b in z], atol=1e-9)


def test_positive_unlabelled_steps_equal_plain_python(monkeypatch):
    p = toxicity_pu
    monkeypatch.setattr(p, "STEPS", 25)
    monkeypatch.setattr(p, "BATCH_POSITIVES", 8)
    monkeypatch.setattr(p, "BATCH_UNLABELLED", 16)
    texts, prior = noise(30, 3, "vile") + noise(60, 4) + noise(20, 5, "vile"), 0.25
    mark = np.array([1] * 30 + [0] * 80)
    data, offsets = column(texts)
    sets = [set() for _ in texts]
    for low, _, row, bucket in p._word_sets(data, offsets):
        for r, b in zip(row.tolist(), bucket.tolist()):
            sets[low + r].add(b)
    times = Counter(b for s in sets for b in s)
    toxic_times = Counter(b for s, m in zip(sets, mark) if m for b in s)
    often = {b for b in times if times[b] >= max(2, p.LEAST_SHARE * 110) or toxic_times[b] >= max(2, p.LEAST_POSITIVE_SHARE * 30)}
    sets = [s & often for s in sets]
    w, bias, squares, choose = Counter(), math.log(prior / (1 - prior)), {}, np.random.default_rng(0)
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    softplus = lambda x: math.log1p(math.exp(x))
    clipped = 0
    for _ in range(25):
        positives = choose.choice(np.flatnonzero(mark == 1), 8)
        others = choose.choice(np.flatnonzero(mark == 0), 16)
        fp = [bias + sum(w[b] for b in sets[i]) for i in positives]
        fu = [bias + sum(w[b] for b in sets[i]) for i in others]
        # d risk / d score: prior R+ pulls positives up; the corrected risk of the negatives counts while it is not below 0.
        negatives = sum(map(softplus, fu)) / 16 - prior * sum(map(softplus, fp)) / 8
        minus_p, minus_u = [-prior * sigmoid(x) / 8 for x in fp], [sigmoid(x) / 16 for x in fu]
        if negatives >= 0:
            gp, gu = [m - prior * sigmoid(-x) / 8 for m, x in zip(minus_p, fp)], minus_u
        else:
            clipped += 1
            gp, gu = [-m for m in minus_p], [-m for m in minus_u]
        slope, whole = Counter(), sum(gp) + sum(gu)
        for i, g in [*zip(positives, gp), *zip(others, gu)]:
            for b in sets[i]:
                slope[b] += g
        for b in often:
            squares[b] = squares.get(b, 1e-8) + slope[b] ** 2
            step = p.RATE / math.sqrt(squares[b])
            moved = w[b] - step * slope[b]
            w[b] = math.copysign(max(0.0, abs(moved) - step * p.L1), moved)
        squares[-1] = squares.get(-1, 1e-8) + whole ** 2
        bias -= p.RATE / math.sqrt(squares[-1]) * whole
    got = p.fit(data, offsets, mark, prior)
    assert np.allclose([got[b] for b in sorted(often)], [w[b] for b in sorted(often)], atol=1e-9)
    raw = [sum(w[b] for b in sets[i]) for i in np.flatnonzero(mark == 0)]
    assert got[p._INTERCEPT] == pytest.approx(-np.quantile(raw, 1 - prior))


def test_words_of_few_positives_are_kept():
    """100 positives among 10,000 rows, each toxic word in a tenth of them only."""
    rng = np.random.default_rng(6)
    base = [" ".join(f"w{w}" for w in rng.integers(0, 3000, 10)) for _ in range(10_100)]
    toxic = [f"{t} vile{i % 10}" for i, t in enumerate(base[:100])]
    weights = toxicity_pu.fit(*column(toxic + base[100:]), np.array([1] * 100 + [0] * 10_000), 0.01)
    scores = toxicity_pu._scores(*column([f"w1 w2 vile{i}" for i in range(10)] + noise(200, 7)), weights)
    assert (scores[:10] > np.quantile(scores[10:], 0.95)).all()


@pytest.mark.parametrize("shapes", [True, False])
def test_ngrams_of_a_text_over_many_slices(shapes):
    rng = np.random.default_rng(8)
    text = " ".join(rng.choice(["Aa", "b7", "c!", "repeat", "Été"], 200_000))
    data, offsets = column([text])
    assert len(data) > 3 * (1 << 18)
    ((_, _, _, bucket, times),) = features.rows_of(data, offsets, shapes=shapes)
    words, kinds, rows = features._hashed(data, offsets, shapes)
    whole = Counter(features._grams(words, kinds, rows, features.BITS, shapes)[1].tolist())
    assert dict(zip(bucket.tolist(), times.tolist())) == whole
    assert times.sum() == (2 if shapes else 1) * (200_000 + 199_999)


def test_anchors_scale_with_the_string(spark):
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 5))
    passage = " ".join(word() for _ in range(52))
    rows = [(i, " ".join([*(word() for _ in range(90)), passage if i % 4 == 0 else word(), *(word() for _ in range(90))]))
            for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.deduplicated(
        docs, suffix_dedup.PASSAGE, suffix_dedup.PASSAGE_GRAM).collect()}
    assert all((passage[:40] not in got[i]) if i % 4 == 0 else got[i] == t for i, t in rows)
    with pytest.raises(ValueError):
        suffix_dedup.deduplicated(docs, 200)


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("awkward"))
    awkward.write.parquet(f"{path}/documents.parquet")
    awkward.limit(0).write.parquet(f"{path}/none/documents.parquet")
    labels = spark.createDataFrame(
        [(i, i % 2, int(i % 3 == 0)) for i in range(40)] + [(None, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    labels.limit(0).write.parquet(f"{path}/none/labels.parquet")
    return path


def test_every_stage_takes_awkward_rows(spark, awkward, folder):
    odd = awkward.withColumn("a.b", awkward.n).withColumn("key", awkward.n).withColumn("row", awkward.fp)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, odd, folder)
        assert made.columns == odd.columns, name
        assert 0 < made.count() <= 2 * odd.count()
        assert stage(spark, odd.limit(0), folder).count() == 0
    coded = corpus_pipeline.STAGES[-1][1](spark, odd, folder).collect()
    assert len(coded) == awkward.count() and all(r.round_trip for r in coded)


def test_the_chain_of_awkward_rows_and_of_none(spark, folder):
    assert all(r.round_trip for r in corpus_pipeline.run(spark, folder).collect())
    assert corpus_pipeline.run(spark, f"{folder}/none").collect() == []
