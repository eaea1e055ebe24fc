"""Session settings and the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ADAPTIVE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def build_session(app: str = "reviewmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with AQE on; `master=None` leaves the choice to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ADAPTIVE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the session names in `spark.checkpoint.dir`.

    A local master without the setting, as in tests, uses a folder in the
    warehouse; a cluster without it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name under the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """Write rows that several later steps read, and go on from the written table.

    Costly columns are computed once, readers take only the columns they need,
    and a lost executor does not bring the computation back.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
