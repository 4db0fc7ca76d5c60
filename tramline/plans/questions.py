"""Questions a rider or operator asks of the newest tables (Q1-Q10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalars import at_least_zero
from tramline.functions.text import base_stop
from tramline.operators.joins import lookup_chain


def at_stop(stop: str, asked: str) -> Column:
    """The stop itself or any platform of a base id; pushed down to the scan."""
    return (F.col(stop) == asked) | F.col(stop).isin(f"{asked}N", f"{asked}S")


def current_delay(df: DataFrame, stop: str, asked: str, value: str) -> DataFrame:
    """Q1: mean present delay at a stop or base id, never negative."""
    return df.filter(at_stop(stop, asked)).agg(at_least_zero(F.avg(value)).alias("delay_seconds"), F.count(value).alias("n"))


def propagation(df: DataFrame, stations: DataFrame, node: str, horizons: Sequence[str], route: str | None = None) -> DataFrame:
    """Q2: predicted delay per base station, platforms averaged, with coordinates and a route filter."""
    g = df.groupBy(base_stop(node).alias("base")).agg(*[at_least_zero(F.avg(h)).alias(h) for h in horizons])
    j = g.join(stations, "base", "left")
    return j if route is None else j.filter(F.array_contains(F.split("routes", " "), route))


def delay_predictions(df: DataFrame, value: str, route: str | None = None, stop: str | None = None, minimum: float | None = None, route_col: str = "route_id", stop_col: str = "stop_id") -> DataFrame:
    """Q3: predictions by route, stop and minimum, in seconds and minutes, never negative."""
    if route is not None:
        df = df.filter(F.col(route_col) == route)
    if stop is not None:
        df = df.filter(at_stop(stop_col, stop))
    d = df.withColumn("delay_seconds", at_least_zero(value)).withColumn("delay_minutes", F.col("delay_seconds") / 60)
    return d if minimum is None else d.filter(F.col("delay_seconds") >= minimum)


def improvement(df: DataFrame, prob: str, threshold: float = 0.5) -> DataFrame:
    """Q4: probability that a delay shrinks and the call at a threshold."""
    return df.withColumn("improves", F.col(prob) >= threshold)


def alert_probability(df: DataFrame, prob: str, minimum: float = 0.0, threshold: float = 0.35) -> DataFrame:
    """Q5: alert probability per line above a minimum, with the call at the serving threshold."""
    return df.filter(F.col(prob) >= minimum).withColumn("alert_predicted", F.col(prob) >= threshold)


def trip_status(asked: DataFrame, feed: DataFrame, trip: str, scheduled: Column) -> DataFrame:
    """Q6: ok when any feed row is scheduled, unscheduled when only others are, else not found."""
    s = feed.groupBy(trip).agg(F.max(scheduled.cast("int")).alias("_ok"))
    status = F.when(F.col("_ok") == 1, "ok").when(F.col("_ok") == 0, "unscheduled").otherwise("not_found")
    return asked.join(s, trip, "left").withColumn("status", status).drop("_ok")


def trip_features(live: DataFrame, trip: str, asked, by_line: Sequence[str], stops_left: str, time_left: str, value: str, width: float, tie: Sequence[str]) -> DataFrame:
    """Q7: feature row of one trip. Only its lines are read, as line features need all of their trips; the trip itself
    is picked last."""
    from tramline.operators.windows import imminent_stop, line_features

    lines = live.filter(F.col(trip) == asked).select(*by_line).distinct()
    trips = live.join(lines, list(by_line), "left_semi").select(trip).distinct()
    d = imminent_stop(live.join(trips, trip, "left_semi"), [trip], stops_left, tie)
    d = line_features(d, by_line, [time_left, trip], value, width)
    return d.filter(F.col(trip) == asked)


def route_models(df: DataFrame, time_left: str, limit: float = 1800) -> DataFrame:
    """Q8: near the terminal only the end model answers, else both."""
    return df.withColumn("models", F.when(F.col(time_left) < limit, F.array(F.lit("end"))).otherwise(F.array(F.lit("30m"), F.lit("end"))))


def line_stations(order: DataFrame, stations: DataFrame) -> DataFrame:
    """Q9: station ids along each line: by (name, line), else the least id of that name; lines of two or more.

    ``order``: line, seq, name. ``stations``: stop_id, name, lines (array).
    """
    norm = lambda c: F.lower(F.trim(c))
    st = stations.withColumn("_n", norm(F.col("name")))
    fine = st.select("_n", F.explode("lines").alias("line"), "stop_id").groupBy("_n", "line").agg(F.min("stop_id").alias("stop_id"))
    coarse = st.groupBy("_n").agg(F.min("stop_id").alias("stop_id"))
    got = lookup_chain(order.withColumn("_n", norm(F.col("name"))), [(fine, ["_n", "line"]), (coarse, ["_n"])], "stop_id", "stop_id").drop("_n").filter("stop_id is not null")
    enough = got.groupBy("line").agg(F.count(F.lit(1)).alias("_k")).filter("_k >= 2")
    return got.join(enough, "line", "left_semi").select("line", "seq", "name", "stop_id", "level")


def freshness(df: DataFrame, start: str) -> DataFrame:
    """Q10: oldest and newest window and their number."""
    return df.agg(F.min(start).alias("oldest"), F.max(start).alias("newest"), F.countDistinct(start).alias("n_windows"))
