"""Registry of queries with their SQL, and the role views over the driver tables.

Roles: every event is a train passage (trip = user, stop = event type, route and direction from the
user), its value a delay in whole seconds; errors are service alerts; purchases are city events;
signups by hour are weather. The SQL text of each role view stands beside its DataFrame form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.operators.ordered import Stretches, stretches

US = 1_000_000
MIN_US = 60 * US
HOUR_US = 3600 * US
DAY_US = 24 * HOUR_US
#: rows that a chunk of a key may hold
CHUNK_ROWS = 1_000_000
_WIDTHS: dict[tuple, Stretches] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can state it, its SQL."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def width(spark: SparkSession, sf: str, by: tuple[str, ...] = ("stop",)) -> Stretches:
    """Chunks of the trains' order axis in which no value of ``by`` has more than ``CHUNK_ROWS`` rows.

    Stops are the coarsest keys of most queries, so finer keys keep it too; queries over all rows ask for the empty key. Counted once per
    table and key.
    """
    return chunks(trains(spark, sf), by, "t", MIN_US, (sf, *by))


def chunks(df: DataFrame, by, t: str, finest: int, name: tuple) -> Stretches:
    """Chunks of any table's order axis, counted once per ``name``."""
    key = (df.sparkSession.sparkContext.applicationId, t, finest, *name)
    if key not in _WIDTHS:
        _WIDTHS[key] = stretches(df, list(by), t, finest, CHUNK_ROWS)
    return _WIDTHS[key]


def us(col: str):
    return F.unix_micros(F.col(col).cast("timestamp"))


def trains(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    t = us("ts")
    return e.select(
        "event_id",
        t.alias("t"),
        F.to_date("ts").alias("day"),
        (F.floor(t / US) % 86_400).alias("sec"),
        F.col("user_id").alias("trip"),
        F.col("event_type").alias("stop"),
        (F.col("user_id") % 7).alias("route"),
        (F.col("user_id") % 2).alias("direction"),
        F.when(F.col("value") >= 1, F.floor(F.col("value") * 10).cast("double") - 300).alias("delay"),
        (F.col("value") < 5).alias("unscheduled"),
        "value",
    )


TRAINS = """
trains AS (
  SELECT event_id, epoch_us(ts) AS t, CAST(ts AS DATE) AS day, (epoch_us(ts) // 1000000) % 86400 AS sec,
         user_id AS trip, event_type AS stop, user_id % 7 AS route, user_id % 2 AS direction,
         CASE WHEN value >= 1 THEN CAST(floor(value * 10) AS DOUBLE) - 300 END AS delay,
         value < 5 AS unscheduled, value
  FROM events)"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Service alerts of a route."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "error")
    return e.select(
        F.col("event_id").alias("alert_id"),
        us("ts").alias("at"),
        F.to_date("ts").alias("alert_day"),
        (F.col("user_id") % 7).alias("route"),
        F.when(F.col("value") > 50, "Suspension").when(F.col("value") > 20, "Delay").otherwise("Service Change").alias("category"),
    )


ALERTS = """
alerts AS (
  SELECT event_id AS alert_id, epoch_us(ts) AS at, CAST(ts AS DATE) AS alert_day, user_id % 7 AS route,
         CASE WHEN value > 50 THEN 'Suspension' WHEN value > 20 THEN 'Delay' ELSE 'Service Change' END AS category
  FROM events WHERE event_type = 'error')"""


def city_events(spark: SparkSession, sf: str) -> DataFrame:
    """City events at a stop (the user's route group): value minutes long, on seconds of the day."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "purchase")
    t = us("ts")
    sec = F.floor(t / US) % 86_400
    return e.select(
        F.col("event_id").alias("city_id"),
        (F.col("user_id") % 7).alias("route"),
        F.to_date("ts").alias("day"),
        t.alias("start_t"),
        (t + F.floor(F.col("value")) * MIN_US).alias("end_t"),
        sec.alias("start_s"),
        (sec + F.floor(F.col("value")) * 60).alias("end_s"),
        F.floor(F.col("value") / 10).cast("double").alias("score"),
        F.concat(F.lit("kind"), (F.col("user_id") % 5).cast("string")).alias("kind"),
    )


CITY = """
city AS (
  SELECT event_id AS city_id, user_id % 7 AS route, CAST(ts AS DATE) AS day, epoch_us(ts) AS start_t,
         epoch_us(ts) + CAST(floor(value) AS BIGINT) * 60000000 AS end_t,
         (epoch_us(ts) // 1000000) % 86400 AS start_s,
         (epoch_us(ts) // 1000000) % 86400 + CAST(floor(value) AS BIGINT) * 60 AS end_s,
         floor(value / 10) AS score, 'kind' || CAST(user_id % 5 AS VARCHAR) AS kind
  FROM events WHERE event_type = 'purchase')"""


def weather(spark: SparkSession, sf: str) -> DataFrame:
    """Weather by day and hour from signups: whole-number readings."""
    e = table(spark, sf, "events").filter(F.col("event_type") == "signup")
    return (
        e.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour"))
        .agg(F.max(F.floor("value")).cast("double").alias("temp"), F.min(F.floor("value")).cast("double").alias("rain"), F.count(F.lit(1)).cast("double").alias("wind"))
    )


WEATHER = """
weather AS (
  SELECT CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, CAST(max(floor(value)) AS DOUBLE) AS temp,
         CAST(min(floor(value)) AS DOUBLE) AS rain, CAST(count(*) AS DOUBLE) AS wind
  FROM events WHERE event_type = 'signup' GROUP BY ALL)"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)
