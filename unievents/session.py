"""Spark session setup and small plan helpers shared by every job."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "unievents") -> SparkSession:
    """Session tuned for these jobs: UTC, AQE with skew-join and coalescing, no UI."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    parts = shuffle_partitions or os.environ.get("UNIEVENTS_SHUFFLE_PARTITIONS")
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **({"spark.sql.shuffle.partitions": str(parts)} if parts else {}),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": os.environ.get("UNIEVENTS_DRIVER_MEMORY", "16g"),
    }
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session, where it is unset as in tests, gets one of its own; on a cluster
    an unset folder is an error, as executors could not see the driver's disk.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="unievents-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:  # setting it again would open another folder
        spark.sparkContext.setCheckpointDir(path)
    return path


def spread(df: DataFrame, *by: Column | str) -> DataFrame:
    """``df`` dealt by ``by`` (in turn without) over as many parts as shuffles have, one for
    each core at least. Adaptive execution merges small parts by their bytes unless their
    number is given; rows that take long, or become many, would then run in a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *by)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Frames made and written in here leave no shuffle files behind. What follows reads what
    was written; otherwise the files of all steps add up on disk until the session ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` from Parquet files in the shared folder, written now. Unlike a checkpoint's rows
    they are known to be few where they are, and joined so."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
