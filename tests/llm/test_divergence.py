"""Source divergence against its SQL, and the perfect hash by itself."""

from collections import Counter

import duckdb
import pytest

from reviewmill.llm import source_divergence as sd

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def by_sql(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("text", "lang", "source").toArrow())
    return Counter(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({sd.ORACLE})").fetchall())


def rows(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


def test_awkward_rows_equal_sql_in_any_layout(awkward, nothing):
    want = by_sql(awkward)
    assert rows(sd.divergence(awkward)) == want and len(want) > 20
    # Many shards and rounds, and tiles of two blocks of sources, change nothing.
    assert rows(sd.divergence(awkward, per_shard=2, round_bytes=200, strip=2, block=1)) == want
    assert sd.divergence(nothing).collect() == []


def test_hot_source_groups_without_terms_and_a_language_without_kept_terms(spark):
    data = [(i, f"Common Wort{i % 40} Tür's x", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(300)]
    data += [(900, "12 ..", "en", "silent"), (901, None, None, None), (902, "lonely", "xx", "a"), (903, "", "xx", "b")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    want = by_sql(docs)
    assert rows(sd.divergence(docs)) == want
    got = {k[:4]: k[4] for k in want}
    assert got["xx", "a", "pair", "b"] == 0 and ("en", "silent", "pair", "hot") in got


@pytest.mark.parametrize("n", [1, 2, 3, 17, 512, 3000])
def test_perfect_hash_is_minimal_and_lookups_are_verified(n):
    terms = [f"term{i * 7919}é".encode() for i in range(n)]
    seed, pilots, slot = sd.perfect_hash(terms)
    assert sorted(slot.tolist()) == list(range(n))
    ordered = [t for _, t in sorted(zip(slot.tolist(), terms))]
    ends, total = [], 0
    for t in ordered:
        total += len(t)
        ends.append(total)
    row = {"lang": "l", "shard": 0, "seed": seed, "pilots": pilots.tobytes(), "keys": b"".join(ordered),
           "ends": sd.np.array(ends).tobytes()}
    shards = sd.PerfectShards([row], {"l": 1})
    assert shards.find("l", terms)[1] == slot.tolist()
    assert shards.find("l", [b"no", b"nor this"])[1] == [-1, -1]
    assert shards.find("other", terms[:1])[1] == [-1]


def test_terms_of_long_texts():
    text = ("Ab c-d " * 400_000).encode() + b"E" * 3_000_000
    found = [t for part in sd.terms_of(text) for t in part]
    assert len(found) == 1_200_001 and Counter(found)[b"ab"] == 400_000 and len(found[-1]) == 3_000_000
