"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Within a source, documents are laid in a fixed order and their expected copies summed up;
one random offset per source is added, and a document is emitted once for every integer
that its step crosses. All documents of a source expect the same number of copies, so the
prefix sum is that number times the document's position. Positions come from counts per
(source, size class, digest slice), and ranks inside one such slice only, so a source with
a third of all rows is never sorted in one task. As the order runs through the sizes, the
words taken differ from the target by about the words of a few documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.session import staged

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SLICE_DIGITS = 3


def word_count(docs: DataFrame) -> DataFrame:
    """doc_id, source and `size`, the runs of characters that are not ASCII white space."""
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target, one row per source (null is a source of its own, last).

    Sources in code-point order take the weights in turn. A target stops at `cap` times its
    source's size; what is cut off is shared by weight among the rest, until none is above.
    Each pass is one aggregate over the sources and fixes at least one more of them.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Ranks in two steps: inside ranges of sources, and over the ranges' counts.
    ranged = sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn(
        "__part", F.spark_partition_id())
    ranged = staged(ranged)
    inside = Window.partitionBy("__part").orderBy(F.col("source").asc_nulls_last())
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("__part").agg(F.count("*").alias("n")).select(
        "__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    turn = F.col("__before") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    weighed = staged(
        ranged.join(parts, "__part").select("source", "source_size", weight.cast("long").alias("weight")))
    limit = F.col("source_size") * F.lit(float(cap))
    everything = weighed.agg(F.sum("source_size")).first()[0] or 0
    # A source is full when its limit is at most `level` times its weight.
    level, full = 0.0, -1
    while True:
        open_ = limit > F.col("weight") * F.lit(level)
        sums = weighed.agg(
            F.sum(F.when(~open_, F.col("source_size"))), F.sum(F.when(open_, F.col("weight"))),
            F.count(F.when(~open_, 1)),
        ).first()
        if sums[2] == full or not sums[1]:
            break
        full, level = sums[2], (share * everything - cap * (sums[0] or 0)) / sums[1]
    return weighed.select(
        "source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every row.

    Null texts and texts of white space have size 0 and are never taken more often than
    `cap`; a source of size 0 has target 0. Repeated rows are documents of their own. The
    offset and the order come from MD5 digests, so reruns agree. An empty table gives none.
    """
    sized = staged(word_count(docs))
    targets = source_targets(sized, weights, share, cap)
    cells = ["source", "__class", "__slice"]
    laid = (
        sized.withColumn("__class", F.length(F.bin("size")))
        .withColumn("__key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
        .withColumn("__slice", F.substring("__key", 1, SLICE_DIGITS))
    )
    counts = laid.groupBy(*cells).agg(F.count("*").alias("n"))
    earlier = (
        Window.partitionBy("source").orderBy("__class", "__slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    digest = F.md5(F.coalesce("source", F.lit("")).cast("binary"))
    offset = (F.conv(F.substring(digest, 1, 5), 16, 10).cast("double") + 0.5) / float(16**5)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    starts = counts.withColumn("__start", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    starts = starts.join(
        targets.withColumn("__each", expected).withColumn("__offset", offset),
        starts["source"].eqNullSafe(targets["source"]),
    ).drop(targets["source"])
    rank = F.row_number().over(Window.partitionBy(*cells).orderBy("size", "__key", "doc_id"))
    placed = laid.withColumn("__rank", rank)
    joined = placed.join(
        starts,
        placed["source"].eqNullSafe(starts["source"])
        & (placed["__class"] == starts["__class"]) & (placed["__slice"] == starts["__slice"]),
    ).drop(starts["source"])
    after = F.col("__start") + F.col("__rank")
    crossed = (
        F.floor(F.col("__each") * after + F.col("__offset"))
        - F.floor(F.col("__each") * (after - 1) + F.col("__offset"))
    ).cast("long")
    copies = F.least(crossed, F.lit(int(cap)).cast("long"))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The documents themselves, each row as often as the mix takes it (0 to `cap` times).

    Rows that agree in doc_id, source and size are exchangeable: their copies are summed
    and dealt out over them, in the order of their texts. Null texts have size 0 and are
    taken as often as others of their source; null ids are ids of their own; an empty table
    gives none. Columns of any name go along packed, so none can clash.
    """
    keys = ["doc_id", "source", "size"]
    size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    wanted = mix(docs, weights, share, cap).groupBy(*[F.col(c).alias(f"wanted_{c}") for c in keys]).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    rows = docs.select(
        "doc_id", "source", size.alias("size"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    ).join(
        wanted,
        F.col("doc_id").eqNullSafe(F.col("wanted_doc_id")) & F.col("source").eqNullSafe(F.col("wanted_source"))
        & (F.col("size") == F.col("wanted_size")),
    )
    # Only rows that share their key have to meet.
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("row").getField("text")))
    extra = (turn <= F.col("copies") % F.col("rows")).cast("long")
    shared = rows.where("rows > 1").select(
        "row", (F.floor(F.col("copies") / F.col("rows")).cast("long") + extra).alias("times"))
    alone = rows.where("rows = 1").select("row", F.col("copies").alias("times"))
    return (
        alone.unionByName(shared).where("times > 0")
        .select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("row.*")
    )


ORACLE = """
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size
    FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
    FROM sources),
filled AS (
    SELECT *, coalesce(sum(source_size) OVER below, 0) AS full_size,
           sum(weight) OVER () - coalesce(sum(weight) OVER below, 0) AS open_weight,
           sum(source_size) OVER () AS all_size
    FROM weighed
    WINDOW below AS (ORDER BY 2.0::DOUBLE * source_size / weight, source
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (
    SELECT source, 2.0::DOUBLE * source_size / weight AS ratio, 2.0::DOUBLE * source_size AS most, weight,
           (1.5::DOUBLE * all_size - 2.0::DOUBLE * full_size) / open_weight AS level
    FROM filled),
targets AS (
    SELECT source, source_size,
           coalesce(least(2.0::DOUBLE * source_size, weight * (
               SELECT level FROM levels WHERE most > weight * level ORDER BY ratio, source LIMIT 1)),
               0.0::DOUBLE) AS target
    FROM weighed),
laid AS (
    SELECT sized.*, source_size, target, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest,
           CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each,
           (CAST('0x' || substring(md5(coalesce(sized.source, '')), 1, 5) AS BIGINT) + 0.5::DOUBLE)
           / 1048576 AS shift
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
placed AS (
    SELECT *, row_number() OVER (
        PARTITION BY source ORDER BY length(bin(size)), substring(digest, 1, 3), size, digest, doc_id) AS position
    FROM laid)
SELECT doc_id, size, source_size, target,
       CAST(least(2, floor(each * position + shift) - floor(each * (position - 1) + shift)) * size
            AS BIGINT) AS taken
FROM placed"""
