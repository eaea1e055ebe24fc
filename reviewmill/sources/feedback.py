"""Raw feedback files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.operators.ranks import nth_smallest
from reviewmill.schema import FEEDBACK, MAX_ROWS
from reviewmill.session import staged

FILE_ROWS = 1 << 36  # more rows than a file can hold


def read_feedback(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Feedback rows with the declared schema: parquet, orc, json or csv; nothing is inferred.

    Files without a `seq` column get one from the position of each row: the number of its
    file in name order and its row in the file, the same at every load.
    """
    reader = spark.read.options(**options).format(fmt)
    if _has_seq(spark, path, fmt, options):
        return reader.schema(FEEDBACK).load(path)
    rows = reader.schema(T.StructType(FEEDBACK.fields[1:])).load(path)
    return with_positions(rows, rows_known=fmt == "parquet")


def _has_seq(spark: SparkSession, path: str, fmt: str, options: dict) -> bool:
    """Whether the files have a `seq` column, from footers or from one line."""
    if fmt == "json" and not options.get("multiLine"):
        line = spark.read.text(path).first()
        return line is not None and "seq" in json.loads(line[0])
    names = spark.read.options(**options).format(fmt).load(path).columns
    if fmt == "csv" and not options.get("header"):
        return len(names) == len(FEEDBACK.fields)
    return "seq" in names


def with_positions(files: DataFrame, rows_known: bool = True) -> DataFrame:
    """Feedback with `seq` from the file and row that each record was read from.

    Parquet knows a record's row in its file (`rows_known`). Of other formats Spark tells the
    block that it read the record from; the rows of a block are numbered as they are read,
    and the rows in all blocks before it in the file are added.
    """
    spark = files.sparkSession
    names = spark.createDataFrame(list(enumerate(sorted(files.inputFiles()))), "file_no long, file_path string")
    plain = lambda path: F.regexp_replace(path, "^([^:/]+):/+", "$1:/")  # noqa: E731  either form of a local path
    at = files.select("*", plain(F.col("_metadata.file_path")).alias("file_path"), *[
        F.col(f"_metadata.{c}").alias(c) for c in (["row_index"] if rows_known else ["file_block_start"])])
    if not rows_known:
        at = _with_row_index(at)
    seq = F.col("file_no") * F.lit(FILE_ROWS) + F.col("row_index")
    return at.join(names.withColumn("file_path", plain(F.col("file_path"))), "file_path").select(
        seq.alias("seq"), *FEEDBACK.fieldNames()[1:])


def _with_row_index(rows: DataFrame) -> DataFrame:
    """`row_index` within the file from its blocks, each of which one task reads from end to end."""
    # Written once, so that the numbers stay those of one reading.
    read = staged(rows.withColumn("number", F.monotonically_increasing_id()))
    block = ["file_path", "file_block_start"]
    before = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    starts = read.groupBy(*block).agg(F.count("*").alias("n"), F.min("number").alias("first")).select(
        *block, "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    # A block is a bounded piece of a file, so its rows are no hot key at a larger scale.
    return read.join(starts, block).withColumn("row_index", F.col("earlier") + F.col("number") - F.col("first"))


def scan_limit(df: DataFrame, max_rows: int = MAX_ROWS, seq: str | None = None,
               width: int = 1_000_000) -> DataFrame:
    """At most `max_rows` rows: those with the lowest `seq`, or any if none is given.

    `seq` is a unique long. The highest number to keep is found from that column
    alone and becomes a plain filter, which the scan uses to skip row groups; a
    sort with a large limit would end in one task instead.
    """
    if seq is None:
        return df.limit(max_rows)
    last = nth_smallest(df, seq, max_rows, width)
    return df if last is None else df.where(F.col(seq) <= last)

