"""Live pipeline: observed arrivals against the schedule, live features, context, published window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators import aggregates, asof, clean, intervals, joins, windows

BAD_MATCH_S = 3600


def match_observed(observed: DataFrame, schedule: DataFrame, on: Sequence[str], actual_t: str, scheduled_t: str, tie: Sequence[str], width=3600) -> DataFrame:
    """Every observed arrival with its closest schedule row, implausible ones unscheduled."""
    d = joins.match_nearest(observed, schedule, on, actual_t, scheduled_t, tie, width)
    d = clean.reject_bad_match(d, "delay", ["delay", scheduled_t], "is_unscheduled", BAD_MATCH_S)
    return clean.filter_outliers(d, "delay")


def live_features(df: DataFrame, trip: Sequence[str], stop: Sequence[str], line: Sequence[str], order: Sequence[str], width: float) -> DataFrame:
    """W2, W3, W4 on live rows: lags of the filled delay, headway, rolling line delay."""
    d = windows.lagged_filled(df, trip, order, "delay", 2, width, "lagged_delay_")
    d = windows.headway(d, stop, order, width, source=df)
    return windows.prev_mean(d, line, order, "delay", 5, width, "route_rolling_delay", source=df)


#: fixed values: what live rows carry where a source is missing
WEATHER_DEFAULTS = {"temp": 0.0, "rain": 0.0, "wind": 0.0}
EVENT_DEFAULTS = {"n_events": 0, "event_kind": "Ninguno", "n_before": 0, "n_during": 0, "n_after": 0}


def enrich_live(df: DataFrame, width, weather: DataFrame | None = None, events: DataFrame | None = None, alerts: DataFrame | None = None, day: str = "day", sec: str = "sec", t: str = "t", stop: str = "route", line: str = "route") -> DataFrame:
    """ST7: a batch of live rows with weather of the hour, city events around and the last alert; a missing source gives defaults.

    Weather hours without a reading take the defaults as well; without alerts the last one is null.
    """
    d = df
    if weather is None:
        d = d.withColumns({c: F.lit(v) for c, v in WEATHER_DEFAULTS.items()})
    else:
        d = joins.join_weather(d.withColumn("hour", F.floor(F.col(sec) / 3600).cast("int")), weather.select(day, "hour", *WEATHER_DEFAULTS)).na.fill(WEATHER_DEFAULTS).drop("hour")
    if events is None:
        d = d.withColumns({c: F.lit(v) for c, v in EVENT_DEFAULTS.items()})
    else:
        d = intervals.join_events(d, events, [stop, day], sec, "start_s", "end_s", "kind", "score")
    if alerts is None:
        return d.withColumns({"last_at": F.lit(None).cast("bigint"), "last_category": F.lit(None).cast("string")})
    return asof.asof_backward(d, alerts, [line], t, "at", ["category"], ["alert_id"], width)


def window_snapshot(df: DataFrame, t: str, width: int, now: Column, **spec) -> DataFrame:
    """A4: one aggregate of the whole snapshot, named after the bin ``now`` belongs to.

    ``now`` is passed in, so a repeated run gives the same window. Rows keep their own times for what is first in the window.
    """
    whole = df.filter(F.col(t).isNotNull()).agg(F.min(t).alias("_a"), F.max(t).alias("_b")).first()
    span = 1 if whole["_a"] is None else whole["_b"] - whole["_a"] + 1
    at = df.withColumn(t, F.col(t) - F.lit(whole["_a"] or 0))
    d = aggregates.window_aggregate(at, t, span, **spec)
    return d.withColumn("bin", aggregates.snapshot_bin(now, width)).drop("merge_time_mean")
