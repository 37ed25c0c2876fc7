"""Spark session defaults and staging of reused intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "leadline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC clocks and adaptive execution; extra settings override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def staging_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables: the checkpoint folder the session names.

    Only a local session may fall back to a temporary folder; executors of a cluster
    could not read it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="leadline-stage-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where one plan reads the same join result several times. Unlike a cache the
    table survives lost executors, and unlike a checkpoint it stays columnar, so every
    reader still prunes columns and pushes filters. With ``partition_by`` (a column of few
    values) a filter on that column skips whole folders.
    """
    spark = df.sparkSession
    path = f"{staging_dir(spark)}/staged-{uuid.uuid4().hex}"
    if partition_by:
        # Rebalancing keeps the number of files low and cuts an oversized folder into several.
        df.hint("rebalance", partition_by).write.partitionBy(partition_by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
