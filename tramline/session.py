"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


_SCRATCH: list[str] = []


def build_session(app: str = "tramline", master: str | None = None, partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """UTC session, AQE on (skew join, coalescing) and dynamic partition overwrite."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.sources.partitionOverwriteMode", "dynamic")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        b = b.master(master)
    if shared:
        b = b.config("spark.checkpoint.dir", shared)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables: ``spark.checkpoint.dir``, else one below the warehouse.

    Driver and executors must both reach it, so a cluster has to name one that is not on a local disk.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if conf:
        return conf
    house = spark.conf.get("spark.sql.warehouse.dir")
    at = spark._jvm.org.apache.hadoop.fs.Path(house)  # a path without scheme lies in the default file system
    scheme = at.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
    if scheme == "file" and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{house.rstrip('/')}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/tramline-{name}-{uuid.uuid4().hex[:12]}"
    _SCRATCH.append(path)
    return path


def drop_path(spark: SparkSession, path: str) -> bool:
    """Delete one table that this driver wrote below the shared folder and that no result reads any more."""
    if path in _SCRATCH:
        _SCRATCH.remove(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True))


def drop_scratch(spark: SparkSession) -> int:
    """Delete the tables that this driver wrote below the shared folder; call it when their results are written."""
    return sum(drop_path(spark, path) for path in list(_SCRATCH))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Cut lineage through a written table, so that several consumers read it once computed.

    A table in the shared folder survives lost executors, unlike cached or locally checkpointed blocks.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
