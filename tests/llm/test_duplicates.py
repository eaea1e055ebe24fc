"""Near-duplicate operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from reviewmill.llm import embedding_graph, fingerprints, queries, simhash_tiles, suffix_dedup


def least_reachable(n, pairs, names):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return [min((names[j] for j in range(n) if label[j] == label[i] and names[j] is not None), default=None)
            for i in range(n)]


# SimHash tiles

def simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(awkward, awkward_rows, nothing):
    fps = [simhash(r[1]) for r in awkward_rows]
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    names = [r[0] for r in awkward_rows]
    want = Counter(zip(names, fps, least_reachable(len(fps), pairs, names)))
    got = simhash_tiles.groups(awkward).collect()
    assert Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in got) == want
    every = least_reachable(len(fps), pairs, list(range(len(fps))))
    assert simhash_tiles.deduplicated(awkward).count() == len(set(every))
    assert simhash_tiles.groups(nothing).count() == 0


def test_simhash_keeps_one_row_of_each_group(spark, awkward, awkward_rows, nothing):
    body = [" ".join(f"{c}{i * i % 97}" for i in range(60)) for c in "abcde"]
    texts = [body[0], body[1], body[2], body[3], body[2] + " ", body[4], body[3].upper()]
    repeated = list(zip([None, None, 5, 5, 7, 7, None], texts))
    frame = spark.createDataFrame(repeated, "doc_id bigint, text string").repartition(3)
    for docs, rows in ((frame, repeated), (awkward, awkward_rows)):
        fps = [simhash(r[1]) for r in rows]
        pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
        members = {}
        for r, group in zip(rows, least_reachable(len(fps), pairs, list(range(len(fps))))):
            members.setdefault(group, []).append((r[0] is None, r[0] or 0, r[1] or ""))
        want = Counter(min(rs) for rs in members.values())
        got = simhash_tiles.deduplicated(docs)
        assert got.columns == docs.columns
        assert Counter((r.doc_id is None, r.doc_id or 0, r.text or "") for r in got.collect()) == want
    assert simhash_tiles.deduplicated(nothing).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_tiles_connect_every_link(same):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2500, dtype=np.uint64)
    near = base.copy()
    for _ in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near), dtype=np.uint64)
    every = np.unique(np.concatenate([base, near]))
    left, right = (every, every) if same else (every[:2400], every[2400:])
    links = simhash_tiles.tile_links(left, right, 3, same)
    a, b = np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= 3)
    if same:
        assert 0 < len(links) <= len(every)
    whole = [(i, j if same else j + 2400) for i, j in zip(a.tolist(), b.tolist()) if not same or i < j]
    names = list(range(len(every)))
    small = simhash_tiles._Forest(len(every))
    large = simhash_tiles._Forest(len(every))
    for i, j in links:
        small.join(i, j)
    for i, j in whole:
        large.join(i, j)
    assert [small.root(i) for i in names] == [large.root(i) for i in names]


def test_near_links_over_chunks(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2**62, 2**62, 300)
    fps = sorted({*base.tolist(), *(base ^ 1).tolist(), *(base ^ 6).tolist()})
    rows = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    got = simhash_tiles.near_links(rows, chunk=20).collect()
    place = {f: i for i, f in enumerate(fps)}
    bits = [f & (2**64 - 1) for f in fps]
    whole = [(i, j) for i in range(len(bits)) for j in range(i) if (bits[i] ^ bits[j]).bit_count() <= 3]
    names = list(range(len(fps)))
    assert least_reachable(len(fps), [(place[r.a], place[r.b]) for r in got], names) == least_reachable(
        len(fps), whole, names)


# Suffix dedup

def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    times = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if times[d[i:i + length]] > 1:
                covered[i:i + length] = True
        edges = np.diff(np.concatenate([[0], covered.astype(int)]))
        rest = bytes(np.frombuffer(d, np.uint8)[~covered])
        out.append((len(d), int(covered.sum()), int((edges == 1).sum()), rest))
    return out


def passages(seed):
    rnd = random.Random(seed)
    alphabet = "abcdefgh é"
    shared = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(20, 120))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else
                 "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 90))) for _ in range(rnd.randint(0, 6))]
        text = "".join(parts)
        if rnd.random() < 0.3 and text:
            cut = rnd.randrange(len(text))
            text = f"{text[:cut]}X{text[cut + 1:]}"
        texts.append(text)
    return texts + [None, "", "a" * 300, "ab" * 100, texts[3], texts[4], texts[4] + "z", "a" * 35, "\0" * 100]


@pytest.mark.parametrize("length, gram, limits", [
    (40, 25, {}), (40, 25, {"most_items": 50, "most_bytes": 1000}), (64, 40, {})])
def test_repeated_bytes(spark, length, gram, limits):
    texts = passages(length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept))
           for r in suffix_dedup.without_repeats(docs, length, gram, **limits).collect()}
    assert [got[i] for i in range(len(texts))] == repeats(texts, length)


@pytest.mark.parametrize("length, passage, gram, limits", [
    (64, 40, 25, {}), (64, 40, 25, {"most_items": 50, "most_bytes": 1000}), (100, 30, 8, {}), (41, 40, 39, {})])
def test_passages_beside_repeated_bytes(spark, length, passage, gram, limits):
    texts = passages(length)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs, length, gram, passage=passage, **limits).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for _, r in sorted(got.items())] == repeats(texts, length)
    assert [(r.n_passage_bytes, r.n_passages) for _, r in sorted(got.items())] == [
        w[1:3] for w in repeats(texts, passage)]


def test_query_shows_passages_under_its_length(spark, tmp_path):
    """A repeated passage of over 50 words may have less than 400 bytes: nothing is removed, but it is found."""
    rnd = random.Random(4)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    short, long, far = words(52), words(80), words(50_000)  # the last is read in two pieces
    texts = [words(70), f"{words(40)} {short} {words(40)}", f"{words(30)} {short}", f"{long} {words(20)}",
             f"{words(9)} {long}", short, None, "", far[:300_000], f"{words(9)} {far[261_700:262_700]}"]
    assert len(short) < 400 < len(long)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(
        f"{tmp_path}/documents.parquet")
    rows = sorted(queries.QUERIES["op4_suffix_dedup"](spark, str(tmp_path)).collect())
    assert [r[1:5] for r in rows] == [
        (n, removed, spans, hashlib.sha256(rest).hexdigest()) for n, removed, spans, rest in repeats(texts, 400)]
    assert [(r.n_passage_bytes, r.n_passages) for r in rows] == [w[1:3] for w in repeats(texts, 200)]
    assert [r.n_passage_bytes > 0 for r in rows] == [False, True, True, True, True, True, False, False, True, True]
    assert [r.n_removed > 0 for r in rows] == [False, False, False, True, True, False, False, False, True, True]


@pytest.mark.parametrize("limits", [(), (1, 10)])
def test_window_left_of_a_shorter_run_is_no_repeat(limits):
    """What lies left of a run's first byte equals no byte, not even a comma (300 in eight bits)."""
    shared = bytes(range(60, 108))
    for mark in range(256):
        runs = [b"zz" + bytes([mark]) + shared, shared]  # aligned at the eighth byte of what they share
        more, back = np.array([11, 8]), np.array([11, 8])
        items, windows = suffix_dedup.InducedSorter(40, *limits).repeated(iter([(b"".join(runs), more, back)]))
        assert sorted(zip(items.tolist(), windows.tolist())) == [
            *((0, w) for w in range(3, 12)), *((1, w) for w in range(9))], mark


def test_repeated_bytes_of_awkward_rows(awkward, awkward_rows, nothing):
    want = Counter((r[0], *w) for r, w in zip(awkward_rows, repeats([r[1] for r in awkward_rows], 400)))
    got = suffix_dedup.without_repeats(awkward).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == want
    assert any(w[2] for w in want)
    made = suffix_dedup.deduplicated(awkward)
    assert made.columns == awkward.columns
    assert Counter((r.doc_id, r.text) for r in made.collect()) == Counter(
        {(i, rest.decode(errors="ignore")): n for (i, _, _, _, rest), n in want.items()})
    assert suffix_dedup.without_repeats(nothing).count() == 0


# Embedding graph

def vectors():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((120, 16))
    near = base[:60] + 0.1 * rng.standard_normal((60, 16))
    group = base[0] + 0.05 * rng.standard_normal((150, 16))
    rows = [v.tolist() for v in np.concatenate([base, near, group, base[:5], 3 * base[5:9]])]
    rows += [None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [float("inf")] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0]]
    return [(i, v) for i, v in enumerate(rows)]


def test_embedding_links(spark):
    rows = vectors()
    usable = lambda v: bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    pairs, links = [], [0] * len(rows)
    unit = [np.array(v) / np.linalg.norm(v) if usable(v) else None for _, v in rows]
    for i in range(len(rows)):
        for j in range(i):
            if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.9:
                pairs.append((i, j))
                links[i] += 1
                links[j] += 1
    names = [i for i, _ in rows]
    component = least_reachable(len(rows), pairs, names)
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, node string, n int")
    got = {r.vec_id: r for r in embedding_graph.audited_groups(frame).collect()}
    assert [got[i].component_id for i in names] == component
    assert [got[i].kept for i in names] == [component[i] == i for i in names]
    assert sum(got[i].n_links for i in names) >= 0.99 * sum(links)
    assert all(got[i].n_links <= links[i] for i in names)
    assert all(r.true_links == links[r.vec_id] for r in got.values() if r.true_links is not None)
    assert embedding_graph.groups(frame.where("false")).count() == 0


@pytest.mark.parametrize("block, queries", [(64, 40), (2048, 1024)])
def test_oversized_shards_lose_no_link(spark, block, queries):
    rng = np.random.default_rng(6)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.08 * rng.standard_normal(16)).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    _, distinct = embedding_graph.distinct_vectors(frame)
    linked, _ = embedding_graph.links(distinct, block=block, queries=queries)
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = int((unit @ unit.T >= 0.9).sum()) - len(rows)
    assert linked.agg({"linked": "sum"}).first()[0] >= 0.99 * true


def test_large_group_of_near_copies_loses_no_link(spark):
    rng = np.random.default_rng(7)
    centre = rng.standard_normal(16)
    group = centre + 0.15 * rng.standard_normal((5000, 16))
    unit = np.concatenate([group, rng.standard_normal((10_000, 16))])
    frame = spark.createDataFrame(list(enumerate(unit.tolist())), "vec_id bigint, embedding array<double>")
    _, distinct = embedding_graph.distinct_vectors(frame)
    linked, _ = embedding_graph.links(distinct)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = sum(int((unit[low:low + 1000] @ unit.T >= 0.9).sum()) for low in range(0, len(unit), 1000)) - len(unit)
    found = linked.agg({"linked": "sum"}).first()[0]
    assert 0.99 * true <= found <= true and found % 2 == 0


@pytest.mark.parametrize("overlap", [1, 2, 3])
def test_links_count_for_both_ends_whatever_search_met_them(spark, overlap):
    """Few shards a vector, so many pairs can be met from one side only."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((30, 8))
    rows = np.concatenate([centres[rng.integers(0, 30, 600)] + 0.2 * rng.standard_normal((600, 8)), centres[:10], centres[:10]])
    frame = spark.createDataFrame(list(enumerate(rows.tolist())), "vec_id bigint, embedding array<double>")
    _, distinct = embedding_graph.distinct_vectors(frame)
    linked, _ = embedding_graph.links(distinct, per_centre=15, overlap=overlap, block=64, queries=40)
    counts = {r.node: r.linked for r in linked.collect()}
    held = distinct.select("node", "embedding", "n").collect()
    unit = np.array([r.embedding for r in held])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    number = np.array([r.n for r in held])
    true = (unit @ unit.T >= 0.9) @ number - number
    weighted = sum(counts[r.node] * r.n for r in held)
    assert weighted % 2 == 0 and weighted >= 0.5 * (true * number).sum()
    assert all(counts[r.node] <= t for r, t in zip(held, true.tolist()))


def test_search_widens_where_the_audit_misses_links(spark, monkeypatch):
    frame = spark.createDataFrame(
        [(i, [1.0, i / 100]) for i in range(20)], "vec_id bigint, embedding array<double>")
    plain, tried = embedding_graph.groups, []

    def narrow(vectors, cosine, overlap):
        tried.append(overlap)
        made = plain(vectors, cosine, overlap)
        return made if overlap > 5 and len(tried) < 3 else made.withColumn("n_links", embedding_graph.F.lit(1))

    monkeypatch.setattr(embedding_graph, "groups", narrow)
    assert {r.n_links for r in embedding_graph.audited_groups(frame).collect()} == {19}
    assert tried == [5, 20]
    with pytest.raises(RuntimeError):
        embedding_graph.audited_groups(frame)


# Fingerprints

def test_edits_and_likeness(awkward, awkward_rows, nothing):
    order = sorted(awkward_rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    prints = fingerprints._simhash_texts(texts)
    want = Counter()
    for i, (r, text) in enumerate(zip(order, texts)):
        after, cut = texts[(i + 1) % len(texts)], len(text) // 2
        edited = text[:len(text) - cut] + after[:cut]
        own, changed, following = (int(x) for x in (
            prints[i], fingerprints._simhash_texts([edited])[0], prints[(i + 1) % len(texts)]))
        near = lambda a, b: 1 - (a ^ b).bit_count() / 64
        within = sum((int(p) ^ own).bit_count() <= 3 for p in prints) - 1
        want[(r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:016x}", f"{changed:016x}",
              near(own, changed), near(own, following), within if r[0] is not None and r[0] % 50 == 0 else None)] += 1
    assert Counter(map(tuple, fingerprints.compared(awkward).collect())) == want
    assert fingerprints.compared(nothing).count() == 0


def test_edits_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 7)
    rows = [(i * 3, f"text number {i} " * (i % 9)) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.with_edits(docs).collect()}
    for i, (doc_id, text) in enumerate(rows):
        after, cut = rows[(i + 1) % len(rows)][1], len(text) // 2
        assert got[doc_id] == hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()


def test_long_text_is_hashed_in_pieces():
    long = "word one two three " * 120_000
    offsets, data = fingerprints.utf8(fingerprints.pa.array([long], fingerprints.pa.large_string()))
    assert fingerprints.simhash(data, offsets)[0] == fingerprints._votes(fingerprints._terms(data, offsets), 1)[0]


def test_single_row_follows_itself(spark):
    docs = spark.createDataFrame([(1, "abcdef")], "doc_id bigint, text string")
    assert fingerprints.with_edits(docs).first().edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()


