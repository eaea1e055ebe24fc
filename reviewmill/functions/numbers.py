"""Number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    `round` and `bround` work on the shortest decimal text instead: both turn
    2.675 (stored as 2.67499..) into 2.68. Meant for report rows, after aggregation.
    """
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", value.cast("double"), F.lit(pattern)).cast("double")


def clip_rating(value: Column, low: float = 1.0, high: float = 5.0) -> Column:
    """Bound a predicted rating; null stays null."""
    bounded = F.greatest(F.lit(low), F.least(F.lit(high), value.cast("double")))
    return F.when(value.isNotNull(), bounded)


def share(part: Column, whole: Column) -> Column:
    """part / whole in doubles, 0 when the whole is 0."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column) -> Column:
    return part.cast("double") / whole.cast("double")
