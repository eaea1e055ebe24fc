"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16
HOT_ROWS = 1_000_000
_SALT = "__salt"


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], spread: list[str],
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """Join a large side to a side with one small row per key (products, categories).

    Rows of `big` with one key go to `salts` partitions, chosen by a hash of the
    `spread` columns; `small` is repeated `salts` times. The salt comes from row
    values, not from a random number, so a retried task gives the same rows.
    The repeats come from a hash join with the salts, on a key that is 0 everywhere: the size
    estimate counts its rows, but not those of an `explode`, so a side that is small only
    before it is repeated never gets broadcast.
    Sides that measure under the broadcast threshold are still broadcast by AQE.
    """
    left = big.withColumn(_SALT, _salt(spread, salts))
    numbers = small.sparkSession.range(salts).select(
        F.col("id").cast("int").alias(_SALT), F.pmod("id", F.lit(1)).alias("__zero"))
    right = small.withColumn("__zero", F.pmod(F.xxhash64(*keys), F.lit(1))).join(numbers, "__zero").drop("__zero")
    return left.join(right, [*keys, _SALT], how).drop(_SALT)


def hot_keys(sized: DataFrame, keys: list[str], size_col: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than `hot_rows` rows, from a table that counts the rows of each key.

    There are at most all rows / `hot_rows` of them, which bounds the list.
    """
    return sized.where(F.col(size_col) > hot_rows).select(*keys).distinct()


def hot_key_join(
    big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, spread: list[str],
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """Join to a side with one row per key that may be about as long as `big`.

    Repeating all of that side would multiply it, so only the `hot` keys, given
    by some of the `keys` columns, are salted as in `salted_join`. The list gets
    no broadcast hint: AQE broadcasts it when its measured size allows that.
    """
    mark = hot.withColumn("__n", F.lit(salts))
    left = (
        big.join(mark, hot.columns, "left")
        .withColumn(_SALT, F.when(F.col("__n").isNotNull(), _salt(spread, salts)).otherwise(0))
        .drop("__n")
    )
    right = (
        small.join(mark, hot.columns, "left")
        .withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.coalesce("__n", F.lit(1)) - 1)))
        .drop("__n")
    )
    return left.join(right, [*keys, _SALT], how).drop(_SALT)


def _salt(spread: list[str], salts: int) -> Column:
    return F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
