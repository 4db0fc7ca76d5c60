"""Decoded live feeds: nested messages to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIP_UPDATE = (
    "trip struct<trip_id:string,route_id:string,schedule_relationship:int>, "
    "stop_time_update array<struct<stop_id:string,arrival:struct<time:bigint,delay:int>,departure:struct<time:bigint,delay:int>>>, timestamp bigint"
)
VEHICLE = "trip struct<trip_id:string,route_id:string>, stop_id string, current_stop_sequence int, current_status int, timestamp bigint"
# fixed values: vehicle status codes
STATUS = {0: "INCOMING_AT", 1: "STOPPED_AT", 2: "IN_TRANSIT_TO"}


def flatten_trip_updates(df: DataFrame) -> DataFrame:
    """One row per stop update; a zero or absent time is null. A message has few stops."""
    u = df.select("trip.trip_id", "trip.route_id", "timestamp", F.posexplode("stop_time_update").alias("seq", "u"))
    at = lambda c: F.when(F.col(f"u.{c}.time") > 0, F.col(f"u.{c}.time"))
    return u.select("trip_id", "route_id", "timestamp", "seq", F.col("u.stop_id").alias("stop_id"), at("arrival").alias("arrival_time"), at("departure").alias("departure_time"))


def flatten_vehicles(df: DataFrame, received: str = "received") -> DataFrame:
    """Vehicles with a trip; unknown status codes stay as text, a missing time is the receive time."""
    s = F.col("current_status")
    name = None
    for k, v in STATUS.items():
        name = F.when(s == k, v) if name is None else name.when(s == k, v)
    return df.filter(F.coalesce(F.col("trip.trip_id"), F.lit("")) != "").select(
        "trip.trip_id", "trip.route_id", "stop_id", F.col("current_stop_sequence").alias("stop_sequence"),
        name.otherwise(s.cast("string")).alias("status"), F.coalesce(F.when(F.col("timestamp") > 0, F.col("timestamp")), F.col(received)).alias("timestamp"),
    )


def feed_progress(df: DataFrame, width: float) -> DataFrame:
    """delay against the schedule and scheduled time left, from flattened updates of one snapshot."""
    last = df.groupBy("trip_id", "timestamp").agg(F.max("arrival_time").alias("_last"))
    return df.join(last, ["trip_id", "timestamp"]).withColumn("time_left", F.col("_last") - F.col("arrival_time")).drop("_last")
