"""Historical pipeline: clean a table of service days, build features and targets, join the context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.functions import scalars as sc
from tramline.functions.fixed import FINAL_COLUMNS
from tramline.operators import asof, clean, intervals, joins, windows
from tramline.operators.ordered import key_stats, mean_of, nth_prior, prior_rows, row_index
from tramline.session import cut

# fixed values: horizons in minutes and the match tolerance in seconds
TRIP_HORIZONS_MIN = (10, 20, 30, 45, 60)
STATION_HORIZONS_MIN = (10, 20, 30)
TOLERANCE_S = 360
ALERT_FLAGS_S = {"is_alert_just_published": 60, "alert_in_next_15m": 900, "alert_in_next_30m": 1800}


def losses_after_alerts(trains: DataFrame, alerts: DataFrame, horizon: int, tolerance: int, width: float, k: int) -> DataFrame:
    """Lines by mean delay growth over ``horizon`` for passages that follow an alert within it."""
    d = clean.filter_outliers(trains, "delay").select("event_id", "trip", "route", "t", "delay")
    d = asof.value_at_horizons(d, ["trip"], "t", "delay", {"later": horizon}, tolerance, width, ["event_id"])
    d = asof.asof_backward(d, alerts, ["route"], "t", "at", [], ["alert_id"], width)
    near = d.filter(F.col("t") - F.col("last_at") <= horizon)
    top = near.groupBy("route").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("later") - F.col("delay")).alias("mean_loss"))
    return top.orderBy(F.col("mean_loss").desc_nulls_last(), "route").limit(k)


def clean_days(stop_events: DataFrame) -> DataFrame:
    """Validate, coerce, drop null keys, deduplicate, bound delays and add calendar fields.

    Input: service_date, trip_uid, match_key, route_id, stop_id, is_unscheduled, scheduled_seconds,
    actual_seconds, delay_seconds. Times are seconds past midnight of the service date.
    """
    need = ["service_date", "trip_uid", "match_key", "stop_id", "is_unscheduled", "scheduled_seconds", "actual_seconds", "delay_seconds"]
    d = clean.require(stop_events, need)
    d = clean.coerce_types(d, {"scheduled_seconds": "double", "actual_seconds": "double", "delay_seconds": "double"})
    d = clean.drop_null_keys(d, ["match_key", "stop_id"])
    d = clean.dedup(d, ["service_date", "match_key", "stop_id", "actual_seconds"], ["trip_uid", "scheduled_seconds", "delay_seconds"])
    d = clean.filter_outliers(d, "delay_seconds")
    hour = sc.event_hour("scheduled_seconds", "actual_seconds")
    d = d.withColumns(
        {
            "hour": hour,
            "hour_sin": sc.hour_sin(hour),
            "hour_cos": sc.hour_cos(hour),
            "dow": sc.dow("service_date"),
            "is_weekend": sc.is_weekend("service_date"),
            "scheduled_time": sc.seconds_to_clock("scheduled_seconds"),
            "actual_time": sc.seconds_to_clock("actual_seconds"),
            "direction": sc.direction("stop_id"),
            "period_of_day": sc.period_of_day(hour),
        }
    )
    d = d.withColumn("is_peak", F.col("period_of_day").isin("morning_peak", "evening_peak").cast("int"))
    sched, unsched = clean.split_scheduled(d, "is_unscheduled", ["scheduled_seconds", "delay_seconds"], ["actual_seconds"])
    return sched.unionByName(unsched)


def day_features(df: DataFrame, width: float = 3600.0, cross_day: bool = False) -> DataFrame:
    """Lags, headway, rolling means and progress.

    Keys carry the service date unless ``cross_day``; ``df`` should be a written layer, as each
    operator also reads a few of its columns for the chunk borders.
    """
    day = [] if cross_day else ["service_date"]
    by_trip, by_stop, by_route = [*day, "match_key"], [*day, "stop_id"], [*day, "route_id", "direction"]
    o = ["actual_seconds", "match_key", "stop_id"]
    c = "_trip_chunk"
    # one shuffle by trip: lags, rolling mean, position and trip totals share the chunk column
    d = prior_rows(df, by_trip, o, ["delay_seconds"], 3, width, "_p", source=df, chunk_col=c)
    d = row_index(d, by_trip, o, width, "_i", source=df, chunk_col=c)
    stats = {"target_delay_end": ("last", "delay_seconds"), "_first": ("min", "scheduled_seconds"), "_last": ("max", "scheduled_seconds"), "_n": ("count", None)}
    d = key_stats(d, by_trip, o, width, stats, source=df, chunk_col=c)
    d = d.withColumns(
        {
            "lagged_delay_1": nth_prior("_p", "delay_seconds", 1),
            "lagged_delay_2": nth_prior("_p", "delay_seconds", 2),
            "rolling_mean_delay_trip": mean_of("_p", "delay_seconds"),
            "trip_progress": (F.col("scheduled_seconds") - F.col("_first")) / F.nullif(F.col("_last") - F.col("_first"), F.lit(0.0)),
            "scheduled_time_to_end": F.col("_last") - F.col("scheduled_seconds"),
            "stops_to_end": F.col("_n") - F.col("_i"),
        }
    ).drop(c, "_p", "_i", "_first", "_last", "_n")
    d = windows.headway(d, by_stop, o, width, source=df).withColumnRenamed("headway", "actual_headway_seconds")
    return windows.prev_mean(d, by_route, o, "delay_seconds", 5, width, "route_rolling_delay", source=df)


def future_targets(df: DataFrame, width: float = 3600.0, cross_day: bool = False) -> DataFrame:
    """Delays ahead by trip and by station, and their growth against the present delay."""
    day = [] if cross_day else ["service_date"]
    tie = ["match_key", "stop_id"]
    st = {f"station_delay_{m}m": 60 * m for m in STATION_HORIZONS_MIN}
    tr = {f"_t{m}": 60 * m for m in TRIP_HORIZONS_MIN}
    rows = df.count()
    d = asof.value_at_horizons(df, [*day, "stop_id"], "actual_seconds", "delay_seconds", st, TOLERANCE_S, width, tie, rows)
    d = asof.value_at_horizons(d, [*day, "match_key"], "actual_seconds", "delay_seconds", tr, TOLERANCE_S, width, tie, rows)
    outs = {f"target_delay_{m}m": F.coalesce(f"_t{m}", "target_delay_end") for m in TRIP_HORIZONS_MIN}
    d = d.withColumns(outs).drop(*tr)
    deltas = {f"delta_delay_{h}": F.col(f"target_delay_{h}") - F.col("delay_seconds") for h in [f"{m}m" for m in TRIP_HORIZONS_MIN] + ["end"]}
    return d.withColumns(deltas)


def join_context(df: DataFrame, weather: DataFrame, events: DataFrame, alerts: DataFrame, weather_cols: Sequence[str], width: float = 6 * 3600.0, targets: bool = True) -> DataFrame:
    """Weather of the hour, city events, last and next alert of the line.

    ``events``: service_date, stop_id, start_s, end_s, tipo, score. ``alerts``: route_id, alert_s
    (absolute seconds), category, num_updates. Live rows pass ``targets=False``: no look ahead.
    """
    d = joins.join_weather(df, weather.select("service_date", "hour", *weather_cols), ["service_date", "hour"])
    d = d.withColumn("_sec", F.pmod(F.coalesce("actual_seconds", "scheduled_seconds"), F.lit(sc.DAY_S)))
    d = d.withColumn("merge_s", intervals.circular_seconds(F.col("service_date"), F.col("_sec").cast("bigint")))
    d = intervals.join_events(d, events, ["service_date", "stop_id"], "_sec", "start_s", "end_s", "tipo", "score")
    d = d.withColumnsRenamed({"n_events": "n_eventos_afectando", "event_kind": "tipo_referente"})
    d = d.withColumns({"afecta_previo": (F.col("n_before") > 0).cast("int"), "afecta_durante": (F.col("n_during") > 0).cast("int"), "afecta_despues": (F.col("n_after") > 0).cast("int")}).drop("n_before", "n_during", "n_after")
    asked = {"cols": ["category", "num_updates"], "tie": ["category"], "width": width}
    join = asof.asof_both if targets else asof.asof_backward
    d = join(d, alerts, ["route_id"], "merge_s", "alert_s", **asked)
    since = F.col("merge_s") - F.col("last_alert_s")
    d = d.withColumns({"seconds_since_last_alert": since, "is_alert_just_published": F.coalesce((since <= 60).cast("int"), F.lit(0))})
    d = d.withColumnsRenamed({"last_category": "category", "last_num_updates": "num_updates"}).drop("last_alert_s")
    if targets:
        to = F.col("next_alert_s") - F.col("merge_s")
        flag = lambda s: F.coalesce((to <= s).cast("int"), F.lit(0))
        d = d.withColumns({"seconds_to_next_alert": to, "alert_in_next_15m": flag(900), "alert_in_next_30m": flag(1800)})
        d = d.drop("next_alert_s", "next_category", "next_num_updates")
    return d.drop("_sec")


def build_final(cleaned: DataFrame, weather: DataFrame, events: DataFrame, alerts: DataFrame, weather_cols: Sequence[str] = ("temp_extreme",)) -> DataFrame:
    """Cleaned stop events to training rows; ``cleaned`` is a written layer."""
    d = cut(day_features(cleaned), "features")
    d = cut(future_targets(d), "targets")
    d = join_context(d, weather, events, alerts, weather_cols)
    d = d.withColumns({"date": F.col("service_date"), "merge_time": F.timestamp_seconds("merge_s"), "timestamp_start": F.timestamp_seconds(F.col("merge_s") - F.col("seconds_since_last_alert"))})
    return clean.column_policy(d, FINAL_COLUMNS)
