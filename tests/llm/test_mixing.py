"""Mixing against its oracle and by hand, and the pipeline stage by stage."""

import sys
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers as P
import pytest

import corpus_pipeline
from reviewmill.llm import byte_bpe, source_mixing, toxicity_pu

COLUMNS = ["doc_id", "size", "source_size", "target", "taken"]


def test_mix_of_awkward_rows_equals_oracle(awkward, nothing):
    con = duckdb.connect()
    con.register("documents", awkward.select("doc_id", "text", "source").toArrow())
    want = con.execute(source_mixing.ORACLE).fetchall()
    got = [tuple(r) for r in source_mixing.mix(awkward).select(*COLUMNS).collect()]
    assert Counter(got) == Counter(want)
    assert source_mixing.mix(nothing).count() == 0


def test_targets_stop_at_the_cap_and_the_rest_is_shared(spark):
    sized = spark.createDataFrame(
        [("a", 10), ("b", 1000), ("c", 1000), (None, 500)], "source string, size long")
    got = {r.source: r.target for r in source_mixing.source_targets(sized).collect()}
    # 3765 words: a is full at 20, the others share 2:1:5, then None at 1000, then b at 2000.
    assert got["a"] == 20 and got[None] == 1000 and got["b"] == pytest.approx(2745 * 2 / 3)
    assert got["c"] == pytest.approx(2745 / 3)


def test_empty_sources_take_nothing(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [tuple(r)[1:] for r in source_mixing.mix(docs).select(*COLUMNS).orderBy("doc_id").collect()] == [(0, 0, 0.0, 0)] * 2


def test_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i * 7919 % 300), "hot" if i % 3 else f"s{i % 5}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target = defaultdict(int), {}
    for r in source_mixing.mix(docs).collect():
        assert 0 <= r.copies <= 2
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= max(600, 0.02 * target[s]) for s in target)


def test_mixed_documents_repeat_rows(awkward, awkward_rows):
    copies = Counter()
    for r in source_mixing.mix(awkward).collect():
        copies[(r.doc_id, r.source, r["size"])] += r.copies
    made = source_mixing.mixed_documents(awkward)
    assert made.columns == awkward.columns
    words = lambda text: len([w for w in (text or "").encode().split()])
    got = Counter((r.doc_id, r.source, words(r.text)) for r in made.collect())
    assert got == +copies
    texts = {(r[0], r[1]) for r in awkward_rows}
    assert all((r.doc_id, r.text) in texts for r in made.collect())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder of documents and labels with a toxic word, copies and a shared passage."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    passage = " ".join(f"passage{i}" for i in range(80))
    text = lambda i: " ".join(f"w{(i * 37 + j * j) % 900}" for j in range(40 + i % 20))
    rows = [(i, text(i) + (" vilething" if i % 4 == 0 else ""), "en", f"s{i % 3}", 0) for i in range(400)]
    rows += [(1000 + i, rows[i + 1][1], "en", "s0", 0) for i in range(10)]
    rows += [(2000 + i, f"{text(2000 + i)} {passage} {text(2100 + i)}", "fr", None, 0) for i in range(3)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "s1", 0)]
    docs = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(400)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, docs


def test_pipeline_stage_by_stage(spark, small):
    folder, docs = small
    columns = list(docs.columns)
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_dedup", "suffix_dedup", "mixing", "encoding"]
    kept = stage["toxicity"](spark, rows, folder)
    scores = {r.doc_id: r.predicted for r in toxicity_pu.scores(rows, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
    assert kept.columns == columns
    assert {r.doc_id for r in kept.collect()} == {i for i, p in scores.items() if p == 0}
    assert sum(scores[i] for i in range(0, 400, 4)) >= 90
    single = stage["near_dedup"](spark, rows, folder)
    assert single.columns == columns and not {1000 + i for i in range(10)} & {r.doc_id for r in single.collect()}
    cut = {r.doc_id: r.text for r in stage["suffix_dedup"](spark, single, folder).collect()}
    assert len(cut) == single.count()
    assert all("passage40" not in cut[2000 + i] for i in range(3)) and cut[7] == docs.text[7]
    coded = stage["encoding"](spark, rows, folder).collect()
    assert len(coded) == len(docs) and all(r.round_trip for r in coded)
    encoder = byte_bpe.ByteBpe.load(P.path(corpus_pipeline.TOKENIZER), P.PATTERN)
    assert {r.doc_id: list(r.ids) for r in coded}[9] == encoder.encode_texts([docs.text[9]])[1].tolist()


def test_pipeline_runs_through(spark, small):
    folder, _ = small
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and all(r.round_trip for r in got)
    assert not {1000 + i for i in range(10)} & {r.doc_id for r in got}
    assert Counter(map(str, got)) == Counter(map(str, corpus_pipeline.run(spark, folder).collect()))


def test_entry_imports_without_the_subpackage(monkeypatch):
    for name in [m for m in sys.modules if m.startswith(("reviewmill.llm", "__spark_entry__", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "reviewmill.llm", None)
    import __spark_entry__ as entry

    assert entry.llm is None and "alerts_all" in entry.queries() and "pipeline" not in entry.queries()
    monkeypatch.delitem(sys.modules, "__spark_entry__")
