"""URL filters and hard negatives against their SQL, and by hand-made cases."""

import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from reviewmill.llm import hard_negatives as hn
from reviewmill.llm import url_filters as uf

URLS = [
    None, "", "no scheme", "http://", "http://HOST.Example.ORG", "http://example.org?x=/es/", "http://example.org/es/1",
    "http://example.org/en/19", "http://example.org/en/2", "ftp://a.b.example.org/es/", "http://notexample.org/es/1",
    "http://org/", "http://org", "http://x.com/fr/", "http://x.com/fr", "http://xcom/de/3", "http://Ä.com/de/#a?b",
    "http://x.net//", "http://x.net/a//b/", "http://x.net/a\nb/c\n", "a://b://c/d", "http://u:p@x.net:80/q",
    "http://long.net/" + "seg/" * 3000 + "x" * 100_000,
]


def pages(spark, urls, extra=False):
    rows = [(i if i % 5 else None, u, "h", 3, "k") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, host string, n int, prefix string")


def by_sql(oracle, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(oracle).fetchall()


def varied_urls(n=1500):
    rnd = random.Random(5)
    hosts = ["hot.com"] * 6 + ["blog.example.org", "m.example.org", "x.com", "y.net", "z.net"]
    words = ["news", "en", "fr", "de", "es", "tag", "u"]
    return [f"https://{rnd.choice(hosts)}/{rnd.choice(words)}/"
            + "/".join(rnd.choice([*words, f"slug-{rnd.random()}", str(rnd.randint(1, 99)), "f" * 20]) for _ in range(rnd.randint(0, 6)))
            for _ in range(n)]


def test_url_filter_equals_sql(spark):
    df = pages(spark, URLS + varied_urls() + URLS[:9])
    got = uf.judged(df)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
    assert Counter(tuple(r) for r in got.collect()) == Counter(by_sql(uf.ORACLE, pages=df.select("page_id", "url")))
    assert uf.judged(df.limit(0)).collect() == []


def test_rules(spark):
    rows = {r.path + "|" + r.host: r for r in uf.judged(pages(spark, URLS)).collect()}
    rule = lambda path, host: (rows[f"{path}|{host}"].rule, rows[f"{path}|{host}"].verdict)
    assert rule("/es/1", "example.org") == ("example.org/es/", "block")
    assert rule("/en/19", "example.org") == ("example.org/en/1", "block")
    assert rule("/en/2", "example.org") == ("org/", "allow")
    assert rule("/es/1", "notexample.org") == ("org/", "allow")
    assert rule("/es/", "a.b.example.org") == ("example.org/es/", "block")
    assert rule("/", "org") == ("org/", "allow") and rule("", "org")[0] is None
    assert rule("/fr/", "x.com") == ("com/fr/", "allow") and rule("/fr", "x.com")[0] is None
    assert rule("/de/3", "xcom")[0] is None and rule("", "host.example.org")[0] is None
    assert rule("/de/", "Ä.com") == ("com/de/", "block")


def test_templates_merge_alike_branches_and_reject_impure_ones(spark):
    rows = [("h", f"{lang}/#", label) for lang, label in (("a", 1), ("b", 1), ("c", 0), ("d", 0)) for _ in range(40)]
    rows += [("h", f"rare{i}/#", None) for i in range(30)] + [("h", "a/x/#", 1)] * 5
    rows += [("other", "", 0)] * 50 + [("third", "q", None)] * 2
    got = {(r.host, r["shape"]): r for r in uf.templates(
        spark.createDataFrame(rows, "host string, shape string, label int")).collect()}
    assert got["h", "rare3/#"].template == "h/*/*" or got["h", "rare3/#"].template == "h/*/#"
    assert got["h", "a/#"].purity > 0.9 > 0.1 > got["h", "c/#"].purity
    assert got["h", "c/#"].template == got["h", "d/#"].template != got["h", "a/#"].template
    assert got["other", ""].purity < 0.1 and 0.1 < got["third", "q"].purity < 0.9


def test_url_filter_has_no_python(spark):
    plan = uf.judged(pages(spark, varied_urls(50)))._jdf.queryExecution().toString()
    assert not [w for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop") if w in plan]


VECTORS = "vec_id long, embedding array<double>, label int, node string, v int, dim int, own string, score int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], VECTORS)


def clustered(n, dim, seed, hot=True):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(10, dim))
    label = lambda i: 1 if hot and i % 3 == 0 else int(rnd.integers(10))
    rows = []
    for i in range(n):
        own = label(i)
        rows.append((i, (rnd.normal(size=dim) * 0.6 + centres[own] + 0.5 * centres[0]).tolist(), own))
    return rows


@pytest.fixture(scope="module")
def odd_vectors():
    rows = clustered(900, 6, 3)
    rows += [(700, rows[700][1], 4), (700, rows[700][1], 4), (100, rows[100][1], 2)]  # repeated ids and rows
    rows += [(1000 + i, rows[5][1], i % 4) for i in range(60)]  # one common vector
    rows += [(2000, None, 1), (2100, rows[1][1], None), (2200, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1),
             (2300, [float("nan")] * 6, 1), (2400, [float("inf")] + [0.0] * 5, 2), (2500, [0.0] * 6, 3),
             (2501, [0.0] * 6, 5), (None, rows[2][1], 1), (None, rows[2][1], 7), (-100, rows[9][1], 1), (-7, rows[9][1], 9)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 2.5], 1), (3002, [1.0, 1.0], 2), (3100, [], 1), (3101, [], 1), (3102, [], 2)]
    return rows


def test_hard_negatives_equal_sql(spark, odd_vectors):
    df = vectors(spark, odd_vectors).repartition(3)
    got = hn.hard_negatives(df)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = Counter(by_sql(hn.ORACLE, embeddings=df.select("vec_id", "embedding", "label")))
    assert Counter(tuple(r) for r in got.collect()) == want and len(want) > 100
    # Many rounds of few anchors change nothing.
    assert Counter(tuple(r) for r in hn.hard_negatives(df, round_bytes=600, references=3).collect()) == want
    assert hn.hard_negatives(df.limit(0)).collect() == []
    assert hn.hard_negatives(vectors(spark, [(100, [1.0], 1)])).collect() == []


def test_angles_leave_out_most_of_separated_rows(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 32))
    rows = [(i, (centres[i % 12] + 0.05 * rnd.normal(size=32)).tolist(), i % 12 % 10) for i in range(2400)]
    stored = hn.stored_angles(r := hn.integer_vectors(vectors(spark, rows)), hn.reference_directions(r))
    table = stored.select("node", "vec_id", "label", "v", "norm", "angles").where("vec_id % 100 = 0").toArrow()
    anchors = hn.Anchors(table)
    n = len(anchors.node)
    search = hn.Search(anchors, np.arange(n), np.full(n, -2**62), np.full(n, 2**62), 5, True)
    for batch in stored.sort("dim", "label", "cell", "own", "node").toArrow().combine_chunks().to_batches():
        search.rows(batch)
    same = sum(int(r[2] == rows[a][2]) for a in range(0, 2400, 100) for r in rows)
    target, score, ids = search.result()
    assert search.scored < 0.8 * same
    brute = defaultdict(list)
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v, _ in rows}
    label = {r.vec_id: r.label for r in r.select("vec_id", "label").collect()}
    for a in range(0, 2400, 100):
        brute[a] = sorted(-int(whole[a] @ whole[i]) for i in whole if i != a and label[i] == label[a])[:5]
    ids_of = table.column("vec_id").to_pylist()
    got = defaultdict(list)
    for t, s in zip(target.tolist(), score.tolist()):
        got[ids_of[t]].append(-s)
    assert {a: sorted(s) for a, s in got.items()} == brute


def test_exact_scores_beyond_floats():
    a = np.array([[(1 << 27) + 1, 3]])
    assert hn.exact_scores(a, a)[0, 0] == ((1 << 27) + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        hn.exact_scores(a * 1000, a * 1000)
    assert pa.array([1]).type == pa.int64()
