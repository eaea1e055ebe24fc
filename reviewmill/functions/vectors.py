"""Vector expressions over `ARRAY<FLOAT>` columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model label names and the labels the tables store.
LABELS = {"POSITIVE": "positive", "NEGATIVE": "negative", "NEUTRAL": "neutral"}
POLARITIES = {"positive": "pos", "negative": "neg"}


def parse_vector(text: Column) -> Column:
    """A vector written as a JSON array."""
    return F.from_json(text, "array<float>")


def format_vector(vector: Column) -> Column:
    return F.to_json(vector)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value computed once; inside a lambda it would be computed per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalise(vector: Column) -> Column:
    """Scale to unit length in double precision; a zero vector is returned as it is."""
    squares = F.aggregate(
        vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")
    )
    norm = _with(squares, lambda s: F.when(s > 0, F.sqrt(s)).otherwise(F.lit(1.0)))
    return _with(norm, lambda n: F.transform(vector, lambda x: (x.cast("double") / n).cast("float")))


def softmax(logits: Column) -> Column:
    """Shifted by the maximum, so no exponent overflows."""
    exps = _with(
        F.array_max(logits).cast("double"),
        lambda top: F.transform(logits, lambda x: F.exp(x.cast("double") - top)),
    )
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return _with(exps, lambda e: _with(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def normalise_label(raw: Column) -> Column:
    """Upper-case, map to the stored label, unknown or null becomes neutral."""
    mapping = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(mapping, F.upper(raw)), F.lit("neutral"))


def polarity(label: Column) -> Column:
    """pos or neg; null for neutral and unknown labels."""
    mapping = F.create_map(*[F.lit(x) for pair in POLARITIES.items() for x in pair])
    return F.try_element_at(mapping, label)
