"""Clustering on planted groups, and keywords by brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from reviewmill.plans import topics

DIM = 64


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def planted(product, sizes, far, noise=0.05, polarity="pos", seed=7):
    """Clusters around orthogonal centres and `far` points on axes of their own."""
    rng = np.random.default_rng(seed)
    out, axis = [], 0
    for size in sizes:
        centre = np.zeros((size, DIM))
        centre[:, axis] = 1
        vectors = unit(centre + noise * rng.standard_normal((size, DIM)))
        out += [(product, polarity, f"{product}-{polarity}-c{axis}-{i}", v.tolist()) for i, v in enumerate(vectors)]
        axis += 1
    for i in range(far):
        v = np.zeros(DIM)
        v[axis + i] = 1
        out.append((product, polarity, f"{product}-{polarity}-far-{i}", v.tolist()))
    return out


def frame(spark, rows):
    return spark.createDataFrame(
        rows, "product_id string, polarity string, review_key string, embedding array<float>"
    )


def found(df):
    groups = defaultdict(Counter)
    for r in df.collect():
        groups[(r.product_id, r.polarity, r.topic_no)][r.review_key.split("-")[2]] += 1
    return groups


def test_planted_clusters_are_recovered(spark):
    rows = planted("p", [30, 30, 30], 5) + planted("q", [49], 0) + planted("p", [40, 20], 0, polarity="neg")
    rows += [("p", None, f"none-x-n-{i}", [1.0] * DIM) for i in range(60)]
    got = found(topics.cluster_reviews(frame(spark, rows)))
    assert {k[0] for k in got} == {"p"}  # 49 rows are too few
    positive = {k[2]: v for k, v in got.items() if k[1] == "pos"}
    assert sorted(positive) == [-1, 0, 1, 2]
    assert positive[-1] == Counter(far=5)
    assert sorted(map(dict, (positive[i] for i in range(3))), key=str) == [{"c0": 30}, {"c1": 30}, {"c2": 30}]
    negative = {k[2]: v for k, v in got.items() if k[1] == "neg"}
    assert negative == {0: Counter(c0=40), 1: Counter(c1=20)}


def test_size_estimates_do_not_grow_with_the_depths(spark):
    points = topics.signed_points(frame(spark, planted("p", [30, 30, 30], 5)), topics.ClusterSettings())
    found = topics.level_clusters(points.where("sig0 IS NOT NULL"), topics.ClusterSettings())
    assert found.count() == 90
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40


def test_one_vector_on_most_rows(spark):
    copies = [("p", "pos", f"p-pos-same-{i}", [1.0] + [0.0] * (DIM - 1)) for i in range(400)]
    rows = copies + planted("p", [0, 30, 30], 3)
    settings = topics.ClusterSettings(hot_rows=50)
    got = found(topics.cluster_reviews(frame(spark, rows), settings))
    assert got[("p", "pos", 0)] == Counter(same=400)
    assert sorted(sum(v.values()) for k, v in got.items() if k[2] > 0) == [30, 30]


@pytest.mark.parametrize("noise", [0.06, 0.02])
def test_contract(spark, noise):
    rng = np.random.default_rng(1)
    centres = unit(rng.standard_normal((6, DIM)))
    picks = rng.integers(0, 6, 600)
    vectors = unit(centres[picks] + noise * rng.standard_normal((600, DIM)))
    rows = [("p", "pos", f"p-pos-c{c}-{i}", v.tolist()) for i, (c, v) in enumerate(zip(picks, vectors))]
    got = found(topics.cluster_reviews(frame(spark, rows)))
    assert sum(sum(v.values()) for v in got.values()) == 600
    sizes = [sum(got[k].values()) for k in sorted(got) if k[2] >= 0]
    assert min(sizes) >= 10 and sizes == sorted(sizes, reverse=True)
    assert len(sizes) == 6
    strays = [sum(v.values()) - max(v.values()) for k, v in got.items() if k[2] >= 0]
    assert sum(strays) <= 6  # signatures are estimates
    assert sum(sizes) >= 570


@pytest.mark.parametrize("clusters, size, strangers", [
    (6, 100, 0), (6, 100, 6_000), (6, 100, 19_500), (6, 100, 50_000), (100, 40, 0), (200, 50, 0)])
def test_clusters_are_kept_at_any_group_size(spark, clusters, size, strangers):
    rng = np.random.default_rng(3)
    centres = unit(rng.standard_normal((clusters, DIM)))
    picks = np.repeat(np.arange(clusters), size)
    vectors = np.concatenate([
        unit(centres[picks] + 0.05 * rng.standard_normal((len(picks), DIM))),
        unit(rng.standard_normal((strangers, DIM)))])
    names = [f"p-pos-c{c}-{i}" for i, c in enumerate(picks)] + [f"p-pos-far-{i}" for i in range(strangers)]
    frame_ = spark.createDataFrame(
        pd.DataFrame({"review_key": names, "embedding": vectors.tolist()}), "review_key string, embedding array<float>",
    ).selectExpr("'p' AS product_id", "'pos' AS polarity", "*")
    got = found(topics.cluster_reviews(frame_))
    right = Counter()
    for (_, _, topic), kinds in got.items():
        kind, n = max(((k, n) for k, n in kinds.items() if k != "far"), key=lambda x: x[1], default=("far", 0))
        if topic >= 0 and kind != "far":
            right[kind] = max(right[kind], n)
    assert sum(right.values()) >= 0.95 * clusters * size


def test_most_excess_of_mass_is_selected(spark):
    """a(100) parts into b(40) and c(50) at once; d(60) lives on as e(55), which parts into f(20) and g(20)."""
    group = ("p", "pos")
    rows = [(*group, "a", 100, None, 2), (*group, "b", 40, "a", 1), (*group, "c", 50, "a", 1),
            (*group, "d", 60, None, 2), (*group, "e", 55, "d", 1), (*group, "f", 20, "e", 0), (*group, "g", 20, "e", 0),
            (*group, "h", 12, None, 0)]
    names = {c: i for i, c in enumerate("abcdefgh")}
    tree = spark.createDataFrame(
        [(p, q, names[x], n, names.get(up), level) for p, q, x, n, up, level in rows],
        "product_id string, polarity string, label long, n long, parent long, level int")
    pick = lambda eps: {("abcdefgh"[r.label], r.level) for r in topics.selected_clusters(tree, eps).collect()}
    density = lambda e: 1 / e
    for eps in ((0.1, 0.4, 0.5), (0.3, 0.4, 0.5), (0.3, 0.31, 0.5), (0.05, 0.4, 0.9)):
        d = [density(e) for e in eps] + [1.0]
        rise = [d[i] - d[i + 1] for i in range(3)]
        want = {("h", 0)}
        want |= {("a", 2)} if 100 * rise[2] >= 90 * rise[1] else {("b", 1), ("c", 1)}
        want |= {("d", 2)} if 60 * rise[2] + 55 * rise[1] >= 40 * rise[0] else {("f", 0), ("g", 0)}
        assert pick(eps) == want


def test_bad_vectors_are_outliers(spark):
    rows = planted("p", [40, 30], 0)
    bad = [None, [0.0] * DIM, [float("nan")] * DIM, [1.0, 2.0, 3.0], [float("inf")] + [0.0] * (DIM - 1)]
    rows += [("p", "pos", f"p-pos-bad-{i}", v) for i, v in enumerate(bad)]
    got = found(topics.cluster_reviews(frame(spark, rows)))
    assert got == {("p", "pos", 0): Counter(c0=40), ("p", "pos", 1): Counter(c1=30), ("p", "pos", -1): Counter(bad=5)}


def test_keywords_by_brute_force(spark):
    texts = [
        ("g", 0, "сумка рвётся сумка"), ("g", 0, "сумка хорошая"), ("g", 1, "доставка долгая"),
        ("g", -1, "хорошая доставка"), ("h", 0, "one"), ("g", 2, "1 2"),
    ]
    got = topics.topic_keywords(
        spark.createDataFrame(texts, "grp string, topic int, text_clean string"), ["grp"], "topic")
    tf = defaultdict(Counter)
    for g, t, text in texts:
        words = [w for w in text.split() if len(w) > 2]
        tf[(g, t)].update(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    want = {}
    for (g, t), counts in tf.items():
        peers = [c for (x, _), c in tf.items() if x == g and c]
        mean = sum(sum(c.values()) for c in peers) / len(peers)
        weight = {w: n / sum(counts.values()) * math.log(1 + mean / sum(c[w] for c in peers))
                  for w, n in counts.items()}
        if weight:
            want[(g, t)] = ", ".join(sorted(weight, key=lambda w: (-round(weight[w], 12), w))[:10])
    assert {(r.grp, r.topic): r.keywords for r in got.collect()} == want


def test_counted_terms_move_once_for_their_weights(spark):
    rows = spark.createDataFrame([("g", i % 3, f"red cup{i % 4} lid") for i in range(40)], "grp string, topic int, text_clean string")
    text = topics.term_weights(rows, ["grp"], "topic")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_terms_are_counted_in_the_row_unless_keys_repeat(spark):
    texts = [(1, "red cup red cup"), (2, "one"), (3, None), (4, "1 2"), (None, "cup cup"), (5, "сумка cup")]
    kind = "id long, text_clean string"
    def counts(rows):
        want = Counter()
        for key, text in rows:
            words = [w for w in (text or "").split() if len(w) > 2]
            want.update((key, w) for w in words + [f"{a} {b}" for a, b in zip(words, words[1:])])
        return {(key, term, n) for (key, term), n in want.items()}
    single = topics.term_counts(spark.createDataFrame(texts, kind), "id")
    assert set(map(tuple, single.collect())) == counts(texts)
    # No hash table over terms that a large partition would have to spill.
    assert "Aggregate" not in single._jdf.queryExecution().executedPlan().toString()
    more = [*texts, (1, "cup"), (1, "red cup"), (None, "cup one"), (3, "one")]
    got = list(map(tuple, topics.term_counts(spark.createDataFrame(more, kind), "id").collect()))
    assert set(got) == counts(more) and len(got) == len(set(got))


def test_topic_table_falls_back_to_other(spark):
    assigned = spark.createDataFrame(
        [("p", "pos", "a", 0), ("p", "pos", "b", -1), ("p", "pos", "c", 1)],
        "product_id string, polarity string, review_key string, topic_no int")
    texts = spark.createDataFrame([("a", "good shoes"), ("b", "bad words"), ("c", "12 34")],
                                  "review_key string, text_clean string")
    rows = {r.topic_no: (r.keywords, r.review_count, r.topic_id) for r in topics.topic_table(assigned, texts).collect()}
    assert rows == {
        0: ("good, good shoes, shoes", 1, "p|pos|0"), -1: ("other", 1, "p|pos|-1"), 1: ("other", 1, "p|pos|1")}


def test_rare_terms_are_left_out_before_pairs_are_counted(spark):
    """Keywords as by all terms, in groups with many rare words, tiny topics, and ties; few terms reach the weights."""
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghij"))
    words = ["".join(letters[rng.integers(0, 10, 5)]) for _ in range(4000)]
    often = [w + "x" for w in words[:40]]
    rows = []
    for i in range(600):
        picked = [often[j] for j in rng.integers(0, 8 + i % 3 * 14, 12)] + [words[j] for j in rng.integers(0, 4000, 25)]
        rng.shuffle(picked)
        rows.append(("g" if i % 2 else "h", i % 3, " ".join(picked)))
    rows += [("g", 7, "one two"), ("g", 8, "12 34"), ("k", 0, "aaa bbb aaa bbb ccc"), ("k", 1, None)]
    texts = spark.createDataFrame(rows, "grp string, topic int, text_clean string")
    tf = defaultdict(Counter)
    for g, t, text in rows:
        found = [w for w in (text or "").split() if w.isalpha()]
        tf[(g, t)].update(found + [f"{a} {b}" for a, b in zip(found, found[1:])])
    want = {}
    for (g, t), counts in tf.items():
        peers = [c for (x, _), c in tf.items() if x == g and c]
        weight = {w: n / sum(counts.values()) * math.log(
            1 + sum(sum(c.values()) for c in peers) / len(peers) / sum(c[w] for c in peers)) for w, n in counts.items()}
        if weight:
            want[(g, t)] = ", ".join(sorted(weight, key=lambda w: (-round(weight[w], 12), w))[:10])
    assert {(r.grp, r.topic): r.keywords for r in topics.topic_keywords(texts, ["grp"], "topic").collect()} == want
    counted, _ = topics._leading_terms(texts, ["grp"], "topic", "text_clean", 10)
    assert counted.count() * 5 < sum(map(len, tf.values()))


def test_names_one_bit_away_are_those_of_existing_cells(spark):
    """Brute force over all names; next to none of the names without a cell are moved for the join."""
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << topics.KEY_BITS, (300, topics.KEYS))
    depths = [8, 12, 16]

    def name(key, tree, depth):
        return ((depth - 8) // 4 * topics.KEYS + tree) * (1 << topics.KEY_BITS) + (int(key) & (1 << depth) - 1)

    points = spark.createDataFrame(
        [(f"p{i % 2}", "pos", f"r{i}", i, -i, k.tolist()) for i, k in enumerate(keys)],
        "product_id string, polarity string, review_key string, sig0 long, sig1 long, keys array<long>")
    taken = {(f"p{i % 2}", name(keys[i][t] ^ (1 << i % d), t, d)) for i in range(0, 300, 30) for t in (0, 5) for d in depths}
    cells = spark.createDataFrame([(p, "pos", n) for p, n in taken], "product_id string, polarity string, node long")
    near = topics._one_bit_away(points, cells, depths)
    got = [(r.product_id, r.review_key, r.sig0, r.sig1, r.node) for r in near.collect()]
    want = {(f"p{i % 2}", f"r{i}", i, -i, n) for i, k in enumerate(keys) for d in depths for t in range(topics.KEYS)
            for b in range(d) if (f"p{i % 2}", n := name(int(k[t]) ^ 1 << b, t, d)) in taken}
    assert len(got) == len(set(got)) and want <= set(got)
    assert len(set(got) - want) < 0.05 * len(keys) * topics.KEYS * sum(depths)


def test_cells_count_their_points_planes(spark):
    rng = np.random.default_rng(5)
    sigs = rng.integers(-1 << 63, 1 << 63, (40, 2), dtype=np.int64)
    rows = [("p", "pos", i % 3, *map(int, s)) for i, s in enumerate(sigs)]
    cells = spark.createDataFrame(rows, "product_id string, polarity string, node long, sig0 long, sig1 long")
    found = topics._full_cells(cells, 1, 44.0)
    for r in found.collect():
        bits = np.unpackbits(sigs[r.node::3].view(np.uint8), axis=1, bitorder="little")
        centre = np.packbits(bits.sum(0) * 2 > len(bits), bitorder="little").view(np.int64)
        assert (r.size, r.centre0, r.centre1) == (len(bits), *centre)
        assert r.coherent == (np.minimum(bits.sum(0), len(bits) - bits.sum(0)).sum() <= len(bits) * 44.0)


@pytest.mark.parametrize("only", [None, {("x", "a"), ("x", "b"), ("y", "б")}])
def test_pairs_are_counted_within_pieces(spark, only):
    rng = np.random.default_rng(9)
    rows = [("xy"[i % 2], [None, 1, 2][i % 3], [str(w) for w in rng.choice(list("abcбß"), i % 40)]) for i in range(200)] + [("x", 1, None)]
    often = None if only is None else spark.createDataFrame(list(only), "g string, term string")
    df = spark.createDataFrame(rows, "g string, topic int, tokens array<string>").coalesce(2)
    made = topics._pair_counts(df, often, ["g"], ["g", "topic"], most=64).collect()
    got, want = Counter(), Counter()
    for r in made:
        if only is None or {(r.g, r.a), (r.g, r.b)} <= only:
            got[r.g, r.topic, r.a, r.b] += r.tf
    for g, t, words in rows:
        for a, b in zip(words or [], (words or [])[1:]):
            if only is None or {(g, a), (g, b)} <= only:
                want[g, t, a, b] += 1
    assert got == want and len(made) < sum(want.values())
