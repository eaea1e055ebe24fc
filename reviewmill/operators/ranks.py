"""Exact ranks and positions without a global or a per-group sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.operators.skew import salted_join
from reviewmill.session import staged


def _range_offsets(rows: DataFrame, fan: int) -> DataFrame:
    """Per `__range` its row count `__n` and the rows in lower ranges, `__offset`.

    Offsets are summed up in two steps, within `fan` neighbouring ranges and
    then over those, so that no window sees more than `fan` ranges, or
    ranges / `fan` sums.
    """
    counts = (
        rows.groupBy("__range").agg(F.count("*").alias("__n"))
        .withColumn("block", F.floor(F.col("__range") / fan).cast("long"))
    )
    before = (Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("block").orderBy("__range").rowsBetween(*before)
    over_blocks = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(*before)
    blocks = counts.groupBy("block").agg(F.sum("__n").alias("s")).select(
        "block", F.sum("s").over(over_blocks).alias("outer")
    )
    inner = counts.withColumn("inner", F.sum("__n").over(in_block))
    return inner.join(blocks, "block").select(
        "__range", "__n",
        (F.coalesce("inner", F.lit(0)) + F.coalesce("outer", F.lit(0))).alias("__offset"),
    )


def _with_range(rows: DataFrame, seq: str, width: int) -> DataFrame:
    return rows.withColumn("__range", F.floor(F.col(seq) / width).cast("long"))


def dense_positions(
    rows: DataFrame, seq: str, out: str = "position", width: int = 1_000_000, fan: int = 1_000,
) -> DataFrame:
    """Zero-based position of every row in the order of a unique long `seq`.

    A row's position is the offset of its range of `width` sequence numbers plus
    its rank there, so no window sorts more than `width` rows.
    """
    ranged = _with_range(rows, seq, width)
    offsets = _range_offsets(ranged, fan).select("__range", "__offset")
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(seq)) - 1
    return (
        ranged.join(offsets, "__range")
        .withColumn(out, F.col("__offset") + rank)
        .drop("__range", "__offset")
    )


def nth_smallest(
    rows: DataFrame, seq: str, n: int, width: int = 1_000_000, fan: int = 1_000,
) -> int | None:
    """The `n`-th smallest value of a unique long column, or None if there are fewer rows.

    Finds the range it falls in from counts, then ranks inside that range only.
    """
    ranged = _with_range(rows.select(seq), seq, width)
    holds = (F.col("__offset") < n) & (F.col("__offset") + F.col("__n") >= n)
    found = _range_offsets(ranged, fan).where(holds).first()
    if found is None:
        return None
    inside = ranged.where(F.col("__range") == found["__range"]).orderBy(seq)
    return inside.limit(n - found["__offset"]).agg(F.max(seq)).first()[0]


def lowest_per_group(
    rows: DataFrame, group: list[str], digest: str, quota: Column, out: str, digits: int = 4,
) -> DataFrame:
    """Flag the rows whose hex `digest` is among the lowest `quota` of their group.

    `quota` is an expression over the group size `n`; group columns hold no nulls.
    The first hex `digits` of the digest put each group into equal slices. Counts per slice
    give the one slice of a group that its quota ends in; only that one's rows are shuffled
    and ranked, all others are flagged by their slice. `rows` are read three times.
    """
    sliced = rows.withColumn("__slice", F.conv(F.substring(digest, 1, digits), 16, 10).cast("int"))
    counts = sliced.groupBy(*group, "__slice").agg(F.count("*").alias("__c"))
    by_group = Window.partitionBy(*group)
    running = by_group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    room = counts.withColumn("n", F.sum("__c").over(by_group)).withColumn(
        "__room", quota - F.coalesce(F.sum("__c").over(running), F.lit(0)))
    cuts = staged(room.where(F.col("__room") < F.col("__c")).groupBy(*group).agg(
        F.min(F.struct(F.col("__slice").alias("slice"), F.col("__room").alias("room"))).alias("__cut")))
    marked = salted_join(sliced, cuts, group, [digest], "left")
    at, cut = F.col("__slice"), F.col("__cut.slice")
    rank = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy(digest))
    whole = marked.where(F.coalesce(at != cut, F.lit(True))).withColumn(out, F.coalesce(at < cut, F.lit(True)))
    ranked = marked.where(at == cut).withColumn(out, rank <= F.col("__cut.room"))
    return whole.select(*rows.columns, out).unionByName(ranked.select(*rows.columns, out))
