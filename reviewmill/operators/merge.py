"""Merge operators: what MERGE INTO does, as joins that give the next table state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewmill.operators.skew import salted_join


def insert_absent(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct source keys that the target does not hold yet."""
    return source.select(*keys).distinct().join(target.select(*keys), keys, "left_anti")


def merge_columns(
    target: DataFrame, source: DataFrame, key: str, update: list[str],
) -> DataFrame:
    """Upsert `source` into `target` on a key that is unique on both sides.

    Rows of both sides get only the `update` columns from the source; new rows
    also take the other columns the source has; the rest of the target stays.
    The key is unique, so it cannot be skewed, and both sides shuffle once.
    """
    inserted = [c for c in target.columns if c != key and c in source.columns]
    new = source.select(
        key, F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in inserted]
    )
    old = target.withColumn("__old", F.lit(True))
    joined = old.join(new, key, "full_outer")

    def merged(name: str):
        if name not in inserted:
            return F.col(name)
        takes_new = F.col("__new") if name in update else F.col("__old").isNull()
        kind = target.schema[name].dataType
        return F.when(takes_new, F.col(f"__{name}").cast(kind)).otherwise(F.col(name)).alias(name)

    return joined.select(*[F.col(key) if c == key else merged(c) for c in target.columns])


def replace_groups(existing: DataFrame, new: DataFrame, group: list[str]) -> DataFrame:
    """Existing rows of groups the new result does not mention, plus the new rows."""
    kept = existing.join(new.select(*group).distinct(), group, "left_anti")
    return kept.unionByName(new.select(*existing.columns))


def reassign(
    rows: DataFrame, replaced: DataFrame, assigned: DataFrame, key: str, column: str,
) -> DataFrame:
    """Move `column` to its new values; clear it where its old value was replaced.

    `replaced` lists old values of `column`. One old value may be on a third of
    the rows, hence the salted join; `assigned` has one row per `key`.
    """
    stale = replaced.select(F.col(column)).distinct().withColumn("__stale", F.lit(True))
    marked = salted_join(rows, stale, [column], [key], how="left")
    fresh = assigned.select(key, F.col(column).alias("__fresh"))
    value = F.coalesce("__fresh", F.when(F.col("__stale").isNull(), F.col(column)))
    return (
        marked.join(fresh, key, "left")
        .select(*[value.alias(c) if c == column else F.col(c) for c in rows.columns])
    )
