"""Table states on a shared file system, changed by copy-on-write.

A table consists of numbered parts, each current in one version. A write goes to a new
folder; Spark puts `_SUCCESS` there after its commit. Then one small manifest is written
that names the current version of every part of every table, so that a job changes
several tables at once or not at all, and a job that dies half-way leaves the old state
current. One writer per manifest at a time.

- `SnapshotTable`: one part, replaced as a whole.
- `AppendTable`: each write adds a part.
- `RangedTable`: one part, in files by ranges of some columns; readers of one value of these
  columns open only the files that can hold it.
- `BucketTable`: a part per hash bucket of the key. A merge reads and rewrites only the
  buckets that hold keys of its source. Spark reads the files as a bucketed table, so
  tables with the same key and number of buckets join without a shuffle.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewmill.operators.merge import merge_columns
from reviewmill.session import staged

BUCKETS = 32
_BUCKET = "__bucket"


def _glob(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in whatever store they are."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return [f.getPath().toString() for f in found]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _number(path: str) -> int:
    return int(path.rstrip("/").rpartition("=")[2])


class SnapshotTable:
    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, manifest: Manifest | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema
        self.manifest = manifest

    def versions(self) -> list[int]:
        """Versions that were written to their end, oldest first."""
        return sorted(_number(f.rpartition("/")[0]) for f in _glob(self.spark, f"{self.root}/version=*/_SUCCESS"))

    def parts(self) -> dict[int, int]:
        """The current version of each part; without a manifest the newest version of the only part."""
        if self.manifest:
            return self.manifest.parts(self)
        return {0: v for v in self.versions()[-1:]}

    def read(self) -> DataFrame:
        """The current state; empty before the first write."""
        folders = sorted(self._folder(v) for v in set(self.parts().values()))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def write(self, df: DataFrame, max_records_per_file: int = 0) -> DataFrame:
        """Store the next state, make it current and return it as read back from storage."""
        parts = self.stage(df, max_records_per_file)
        if self.manifest:
            self.manifest.commit({self: parts})
        return self.read()

    def stage(self, df: DataFrame, max_records_per_file: int = 0) -> dict[int, int | None]:
        """Write the next state to its folder; the parts it gives are not current yet."""
        version = self._next_version()
        (
            self._shaped(df).write.mode("overwrite")
            .option("maxRecordsPerFile", max_records_per_file)
            .parquet(self._folder(version))
        )
        return {0: version}

    def sweep(self) -> None:
        """Delete what the current state does not use. Only while nothing reads an older state."""
        used = set(self.parts().values())
        for folder in _glob(self.spark, f"{self.root}/version=*"):
            if _number(folder) not in used:
                _delete(self.spark, folder)

    def _shaped(self, df: DataFrame) -> DataFrame:
        return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in self.schema.fields])

    def _next_version(self) -> int:
        return max([-1, *self.versions(), *self.parts().values()]) + 1

    def _folder(self, version: int) -> str:
        return f"{self.root}/version={version}"


class AppendTable(SnapshotTable):
    """Rows are only added: each write is a part of its own."""

    def stage(self, df: DataFrame, max_records_per_file: int = 0) -> dict[int, int | None]:
        (version,) = super().stage(df, max_records_per_file).values()
        return {version: version}


class BucketTable(SnapshotTable):
    """Rows dealt to hash buckets of a key that is unique."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, manifest: Manifest,
                 key: str, buckets: int = BUCKETS):
        super().__init__(spark, root, schema, manifest)
        self.key, self.buckets = key, buckets

    def bucket(self) -> Column:
        """Number of a row's bucket, as Spark's own bucketing has it."""
        return F.pmod(F.hash(self.key), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The current rows, of some buckets only if they are given."""
        parts = {b: v for b, v in self.parts().items() if buckets is None or b in buckets}
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.table(self._view(parts)).select(*self.schema.fieldNames())

    def stage(self, df: DataFrame, max_records_per_file: int = 0) -> dict[int, int | None]:
        """Write a whole new state."""
        return {**{b: None for b in self.parts()}, **self._write(df)}

    def stage_merge(self, source: DataFrame, update: list[str], stored: bool = False) -> dict[int, int | None]:
        """Write the buckets that an upsert of `source` touches; see `merge_columns`.

        The source is read twice, so it is staged unless it is `stored` already. The first rows
        of a table need no merge: they are read once and move once.
        """
        if not self.parts():
            return self._write(merge_columns(self.read().limit(0), source, self.key, update))
        source = source if stored else staged(source)
        touched = sorted(r[0] for r in source.select(self.bucket()).distinct().collect())  # at most `buckets`
        if not touched:
            return {}
        return self._write(merge_columns(self.read(touched), source, self.key, update))

    def merge(self, source: DataFrame, update: list[str], stored: bool = False) -> None:
        """Upsert `source`, whose keys are unique, and make the result current."""
        self.manifest.commit({self: self.stage_merge(source, update, stored)})

    def sweep(self) -> None:
        """Delete the buckets of versions that the current state does not use."""
        parts = self.parts()
        for folder in _glob(self.spark, f"{self.root}/version=*"):
            held = _glob(self.spark, f"{folder}/{_BUCKET}=*")
            stale = [f for f in held if parts.get(_number(f)) != _number(folder)]
            for f in [folder] if len(stale) == len(held) else stale:
                _delete(self.spark, f)

    def _write(self, df: DataFrame) -> dict[int, int | None]:
        version, name = self._next_version(), f"staged_{uuid.uuid4().hex}"
        rows = self._shaped(df).repartition(self.buckets, self.key).withColumn(_BUCKET, self.bucket())
        (
            rows.write.mode("overwrite").format("parquet").option("path", self._folder(version))
            .partitionBy(_BUCKET).bucketBy(self.buckets, self.key).sortBy(self.key).saveAsTable(name)
        )
        self.spark.sql(f"DROP TABLE {name}")  # the files stay, the manifest will name them
        return {_number(f): version for f in _glob(self.spark, f"{self._folder(version)}/{_BUCKET}=*")}

    def _view(self, parts: dict[int, int]) -> str:
        """Name of a table of this session over the files of the given parts."""
        state = hashlib.sha256(f"{self.root} {sorted(parts.items())}".encode()).hexdigest()[:32]
        name = f"bucketed_{state}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, {_BUCKET} INT) USING parquet PARTITIONED BY ({_BUCKET}) "
                f"CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.buckets} BUCKETS "
                f"LOCATION '{self.root}/none'")
            places = " ".join(
                f"PARTITION ({_BUCKET} = {b}) LOCATION '{self._folder(v)}/{_BUCKET}={b}'" for b, v in sorted(parts.items()))
            self.spark.sql(f"ALTER TABLE {name} ADD {places}")
        return name


class RangedTable(SnapshotTable):
    """Rows laid out by ranges of some columns, with the bounds of each file, so that readers of few values skip files."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, manifest: Manifest | None,
                 keys: list[str], files: int | None = None):
        super().__init__(spark, root, schema, manifest)
        self.keys, self.files = keys, files

    def stage(self, df: DataFrame, max_records_per_file: int = 0) -> dict[int, int | None]:
        """Write the next state in ranges of the keys, one file each, and the bounds of the files beside it."""
        shaped = self._shaped(df)
        ranged = shaped.repartitionByRange(self.files, *self.keys) if self.files else shaped.repartitionByRange(*self.keys)
        (version,) = super().stage(ranged.sortWithinPartitions(*self.keys), max_records_per_file).values()
        rows = self.spark.read.schema(self.schema).parquet(self._folder(version))
        bounds = [f(c).alias(f"{name}_{c}") for c in self.keys for name, f in (("least", F.min), ("most", F.max))]
        stored = rows.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("n"), *bounds)
        stored.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/bounds/of={version}")
        return {0: version}

    def files_with(self, **values) -> list[str]:
        """The current files whose bounds hold the given values of some keys."""
        parts = self.parts()
        if not parts:
            return []
        bounds = self.spark.read.parquet(f"{self.root}/bounds/of={parts[0]}")
        for name, value in values.items():
            bounds = bounds.where(F.lit(value).between(F.col(f"least_{name}"), F.col(f"most_{name}")))
        return sorted(r["file_path"] for r in bounds.select("file_path").collect())

    def read_where(self, **values) -> DataFrame:
        """The current rows with these values of keys; only files that can hold them are opened."""
        files = self.files_with(**values)
        if not files:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).parquet(*files)
        for name, value in values.items():
            rows = rows.where(F.col(name) == F.lit(value))
        return rows

    def sweep(self) -> None:
        super().sweep()
        for folder in _glob(self.spark, f"{self.root}/bounds/of=*"):
            if _number(folder) not in self.parts().values():
                _delete(self.spark, folder)


class Manifest:
    """The current version of every part of some tables, itself a small snapshot table."""

    def __init__(self, spark: SparkSession, root: str):
        self._table = SnapshotTable(spark, root, T.StructType([
            T.StructField("table", T.StringType()), T.StructField("part", T.LongType()),
            T.StructField("version", T.LongType())]))

    def _state(self) -> dict[tuple[str, int], int]:
        return {(row["table"], row["part"]): row["version"] for row in self._table.read().collect()}

    def parts(self, table: SnapshotTable) -> dict[int, int]:
        return {part: version for (root, part), version in self._state().items() if root == table.root}

    def commit(self, changes: dict[SnapshotTable, dict[int, int | None]]) -> None:
        """Make versions of parts current, all at once; a part without a version goes."""
        state = self._state()
        for table, parts in changes.items():
            state.update({(table.root, part): version for part, version in parts.items()})
        rows = sorted((root, part, version) for (root, part), version in state.items() if version is not None)
        self._table.write(self._table.spark.createDataFrame(rows, self._table.schema).coalesce(1))

    def sweep(self) -> None:
        self._table.sweep()


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int, path: str | None = None) -> DataFrame:
    """Store a catalog table bucketed and sorted on its key."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
