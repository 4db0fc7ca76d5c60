"""Lake sources and sinks (S1-S9, S12-S16): layered tables on any Spark file system."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


LAYERS = ("raw", "processed", "cleaned", "final", "aggregations", "realtime")


def layer_path(root: str, layer: str, name: str) -> str:
    if layer not in LAYERS:
        raise ValueError(f"unknown layer {layer}")
    return f"{root.rstrip('/')}/{layer}/{name}"


def write_layer(df: DataFrame, root: str, layer: str, name: str, partition_by: Sequence[str] = ()) -> str:
    """Write a layer table; a rewritten partition replaces only itself."""
    path = layer_path(root, layer, name)
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if partition_by else "static")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return path


def read_layer(spark: SparkSession, root: str, layer: str, name: str, schema: T.StructType | None = None, **parts) -> DataFrame:
    """Read a layer table; keyword arguments become partition filters."""
    r = spark.read.schema(schema) if schema is not None else spark.read
    df = r.parquet(layer_path(root, layer, name))
    for k, v in parts.items():
        df = df.filter(F.col(k) == F.lit(v))
    return df


def read_json_docs(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = False) -> DataFrame:
    """JSON documents, one per line or one array per file."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def write_json_docs(df: DataFrame, path: str) -> None:
    """Reports as JSON lines."""
    df.write.mode("overwrite").json(path)


#: fixed values: columns of the static transit tables
STATIC_TABLES = {
    "trips": "trip_id string, route_id string, service_id string",
    "stop_times": "trip_id string, stop_id string, arrival_time string, departure_time string, stop_sequence int",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
    "shapes": "shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double",
}


def read_static(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """S3: a static transit text table by header, with its declared types."""
    df = spark.read.schema(STATIC_TABLES[name]).option("header", True).option("enforceSchema", False).csv(f"{folder}/{name}.txt")
    return df.select(*columns) if columns else df


def scan_days(df: DataFrame, start: dt.date, end: dt.date, day: str = "day", lookback_days: int = 0) -> DataFrame:
    """A range of day partitions; missing days are simply absent, earlier ones on request."""
    return df.filter(F.col(day).between(F.lit(start - dt.timedelta(days=lookback_days)), F.lit(end)))


def write_months(df: DataFrame, path: str, day: str, by_line: str | None = None) -> None:
    """One output per month (and line)."""
    parts = ["year", "month", *([by_line] if by_line else [])]
    d = df.withColumns({"year": F.year(day), "month": F.month(day)})
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def compact_lines(df: DataFrame, path: str, line: str, year: str, files_per_line: int = 8, key: str | None = None) -> None:
    """Yearly tables per line. A busy line is spread over several files, so no task writes it alone.

    The spread is a hash of the row, so a repeated task sends the same rows to the same file.
    """
    salt = F.pmod(F.xxhash64(*([key] if key else df.columns)), F.lit(files_per_line))
    d = df.withColumn("_salt", salt).repartition(line, year, "_salt").drop("_salt")
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(line, year).parquet(path)


def pick_version(days: DataFrame, versions: DataFrame, day: str, downloaded: str, url: str) -> DataFrame:
    """Newest feed version downloaded on or before each service day.

    Versions become validity ranges (each until the next), so a day meets one version.
    """
    from tramline.operators.asof import asof_backward

    d = days.withColumns({"_d": F.datediff(day, F.lit("1970-01-01")), "_k": F.lit(0)})
    v = versions.withColumns({"_v": F.datediff(downloaded, F.lit("1970-01-01")), "_k": F.lit(0)})
    out = asof_backward(d, v, ["_k"], "_d", "_v", [url, downloaded], [url], 366, prefix="version_")
    return out.drop("_d", "_k", "version__v")


def publish_snapshot(df: DataFrame, path: str) -> None:
    """Replace a published snapshot (schedule, weather, events)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def publish_window(df: DataFrame, path: str, start: str = "window_start") -> None:
    """Add or replace windows, one partition each."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(start).parquet(path)


def newest_starts(df: DataFrame, n: int, start: str = "window_start") -> DataFrame:
    return df.select(start).distinct().orderBy(F.col(start).desc()).limit(n)


def latest_windows(df: DataFrame, n: int = 8, start: str = "window_start") -> DataFrame:
    """Rows of the newest n windows. The starts are at most n rows, so they are broadcast."""
    return df.join(F.broadcast(newest_starts(df, n, start)), start, "left_semi")


def retain_windows(spark: SparkSession, path: str, keep: int = 8, start: str = "window_start") -> list[str]:
    """S14/ST3: drop windows older than the newest ``keep``; returns the dropped partitions.

    Windows are the partition folders; their names, whole numbers or times of one format, sort by length and text.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith(f"{start}=")] if fs.exists(at) else []
    found = sorted(found, key=lambda f: (len(f.getName()), f.getName()))
    old = found[: max(0, len(found) - keep)]
    for f in old:
        fs.delete(f, True)
    return [f.getName().partition("=")[2] for f in old]


