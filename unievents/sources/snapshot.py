"""Versioned Parquet tables: an upsert computes the next snapshot and writes it to a new
version directory; readers pick the newest complete version. A path being read is never
overwritten, and the written version cuts the lineage of the job that produced it.

Tables live under a root the caller gives, by default ``<spark.checkpoint.dir>/tables``
(the shared folder the cluster names), never a machine-local temp folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir

_V = re.compile(r"^v=(\d+)$")


def default_root(spark: SparkSession) -> str:
    return ensure_checkpoint_dir(spark).rstrip("/") + "/tables"


def _versions(spark: SparkSession, root: str, name: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        m = _V.match(st.getPath().getName())
        if m and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(m.group(1)))
    return sorted(out)


def latest_path(spark: SparkSession, root: str, name: str) -> str | None:
    vs = _versions(spark, root, name)
    return f"{root}/{name}/v={vs[-1]}" if vs else None


def read_latest(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    p = latest_path(spark, root, name)
    return spark.read.parquet(p) if p else None


def write_version(df: DataFrame, root: str, name: str) -> str:
    """Write ``df`` as the next version of ``name`` and return its path."""
    spark = df.sparkSession
    vs = _versions(spark, root, name)
    path = f"{root}/{name}/v={(vs[-1] + 1) if vs else 1}"
    df.write.mode("errorifexists").parquet(path)
    return path
