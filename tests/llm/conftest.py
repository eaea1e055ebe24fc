"""Documents that hold every awkward case: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

import pytest

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "size bigint, n_tokens string, fp string, ids string, k0 int, spans int, score string, label int, n int, target int"
)
EXTRA = (7, "x", "y", "z", 1, 2, "s", 3, 4, 5)


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="session")
def awkward_rows():
    rnd = random.Random(11)
    words = [w * n for w in ("alpha", "Été", "naïve", "über", "don't", "x1", "漢字", "!!", "re,") for n in (1, 2)]
    body = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = body(150)
    rows = [row(i, body(rnd.randint(1, 60)), rnd.choice("abc")) for i in range(40)]
    rows += [row(100 + i, f"{body(5)} {shared} {body(5)}", "b") for i in range(4)]
    rows += [row(200, None), row(201, ""), row(202, " \n\t "), row(203, "word"), row(204, "word", None)]
    rows += [row(205, rows[3][1]), row(206, rows[3][1], None), row(207, body(30_000)), row(None, "no id here", None, None)]
    rows += [row(5, rows[5][1], rows[5][3]), row(5, rows[5][1], rows[5][3]), row(6, "same id other text")]
    return rows


@pytest.fixture(scope="session")
def awkward(spark, awkward_rows):
    return spark.createDataFrame(awkward_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
