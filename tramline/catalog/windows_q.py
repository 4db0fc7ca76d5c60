"""Window and as-of queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import ALERTS, CITY, HOUR_US, MIN_US, TRAINS, US, width, alerts, chunks, city_events, query, r6, trains, us, with_, table
from tramline.operators import asof, intervals, ordered, windows

ORD = ["t", "event_id"]


@query("lagged_delay", with_(TRAINS) + """
SELECT event_id, lag(delay, 1) OVER w AS lag1, lag(delay, 2) OVER w AS lag2 FROM trains WINDOW w AS (PARTITION BY trip, day ORDER BY t, event_id)""")
def lagged_delay(spark, sf):
    return windows.lagged(trains(spark, sf), ["trip", "day"], ORD, "delay", 2, width(spark, sf)).select("event_id", "lag1", "lag2")


@query("lagged_delay_filled", with_(TRAINS) + """,
f AS (SELECT *, last_value(delay IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS fd FROM trains)
SELECT event_id, lag(fd, 1) OVER w AS lag1, lag(fd, 2) OVER w AS lag2 FROM f WINDOW w AS (PARTITION BY trip ORDER BY t, event_id)""")
def lagged_delay_filled(spark, sf):
    return windows.lagged_filled(trains(spark, sf), ["trip"], ORD, "delay", 2, width(spark, sf)).select("event_id", "lag1", "lag2")


@query("headway", with_(TRAINS) + """,
h AS (SELECT event_id, stop, t, t - lag(t) OVER w AS headway, lag(t) OVER w - lag(t, 2) OVER w AS prev FROM trains WINDOW w AS (PARTITION BY stop ORDER BY t, event_id))
SELECT event_id, headway, round(headway / nullif(CAST(prev AS DOUBLE), 0), 6) AS headway_ratio FROM h""")
def headway(spark, sf):
    return windows.headway(trains(spark, sf), ["stop"], ORD, width(spark, sf)).select("event_id", "headway", r6("headway_ratio").alias("headway_ratio"))


@query("prev5_mean", with_(TRAINS) + """
SELECT event_id, round(avg(delay) OVER (PARTITION BY route, direction ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS route_mean FROM trains""")
def prev5_mean(spark, sf):
    return windows.prev_mean(trains(spark, sf), ["route", "direction"], ORD, "delay", 5, width(spark, sf), "route_mean").select("event_id", r6("route_mean").alias("route_mean"))


@query("trip_rolling_progress", with_(TRAINS) + """
SELECT event_id, round(avg(delay) OVER (PARTITION BY trip, day ORDER BY t, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 6) AS trip_mean,
 round((sec - min(sec) OVER p) / nullif(CAST(max(sec) OVER p - min(sec) OVER p AS DOUBLE), 0), 6) AS trip_progress
FROM trains WINDOW p AS (PARTITION BY trip, day)""")
def trip_rolling_progress(spark, sf):
    df = windows.prev_mean(trains(spark, sf), ["trip", "day"], ORD, "delay", 3, width(spark, sf), "trip_mean")
    df = windows.trip_progress(df, ["trip", "day"], "sec", 43_200)
    return df.select("event_id", r6("trip_mean").alias("trip_mean"), r6("trip_progress").alias("trip_progress"))


@query("trip_end_values", with_(TRAINS) + """
SELECT event_id, last_value(delay IGNORE NULLS) OVER (PARTITION BY trip, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_value,
 max(t) OVER (PARTITION BY trip, day) - t AS time_left,
 count(*) OVER (PARTITION BY trip, day) - row_number() OVER (PARTITION BY trip, day ORDER BY t, event_id) AS stops_left FROM trains""")
def trip_end_values(spark, sf):
    return windows.trip_end(trains(spark, sf), ["trip", "day"], ORD, "delay", "t", width(spark, sf)).select("event_id", "final_value", "time_left", "stops_left")


@query("live_stops_left", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS qty, round(l_extendedprice, 2) AS price, l_shipdate - l_shipdate = INTERVAL 0 DAY AS ok,
 max(l_linenumber) OVER (PARTITION BY l_orderkey) - l_linenumber AS stops_left,
 (max(epoch_us(l_shipdate)) OVER (PARTITION BY l_orderkey) - epoch_us(l_shipdate)) // 1000000 AS time_left FROM lineitem""")
def live_stops_left(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("s", F.floor(us("l_shipdate") / US))
    d = windows.live_trip_end(li, li, ["l_orderkey"], "s", "l_linenumber")
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("bigint").alias("qty"), F.round("l_extendedprice", 2).alias("price"),
                    F.lit(True).alias("ok"), "stops_left", "time_left")


@query("rolling_sum_3h", with_(TRAINS) + """,
h AS (SELECT day, CAST(sec // 3600 AS BIGINT) AS hour, min(t) AS t, sum(coalesce(delay, 0)) AS rain FROM trains GROUP BY ALL)
SELECT day, hour, sum(rain) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rain_3h FROM h""")
def rolling_sum_3h(spark, sf):
    h = trains(spark, sf).groupBy("day", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.sum(F.coalesce("delay", F.lit(0.0))).alias("rain"))
    return windows.rolling_rows_sum(h, ["day"], ["hour"], "rain", 3, 12, "rain_3h").select("day", "hour", "rain_3h")


BINS = """,
b AS (SELECT stop, route, direction, (t // 3600000000) * 3600000000 AS bin, avg(delay) AS d FROM trains GROUP BY ALL)"""


def _bins(spark, sf):
    return trains(spark, sf).groupBy("stop", "route", "direction", (F.floor(F.col("t") / HOUR_US) * HOUR_US).alias("bin")).agg(F.avg("delay").alias("d"))


KEYS = ["stop", "route", "direction"]


@query("gap_checked_lag", with_(TRAINS) + BINS + """
SELECT stop, route, direction, bin,
 round(CASE WHEN bin - lag(bin, 1) OVER w <= 1 * 3600000000 + 300000000 THEN lag(d, 1) OVER w END, 6) AS lag1,
 round(CASE WHEN bin - lag(bin, 2) OVER w <= 2 * 3600000000 + 300000000 THEN lag(d, 2) OVER w END, 6) AS lag2,
 round(CASE WHEN bin - lag(bin, 3) OVER w <= 3 * 3600000000 + 300000000 THEN lag(d, 3) OVER w END, 6) AS lag3
FROM b WINDOW w AS (PARTITION BY stop, route, direction ORDER BY bin)""")
def gap_checked_lag(spark, sf):
    d = windows.bin_lags(_bins(spark, sf), KEYS, "bin", "d", 3, HOUR_US, 300 * US, width(spark, sf))
    return d.select(*KEYS, "bin", *[r6(f"lag{i}").alias(f"lag{i}") for i in (1, 2, 3)])


@query("spaced_lags", with_(TRAINS) + BINS + """
SELECT stop, route, direction, bin, round(coalesce(lag(d, 2) OVER w, 0), 6) AS lag2, round(coalesce(lag(d, 4) OVER w, 0), 6) AS lag4, round(coalesce(lag(d, 6) OVER w, 0), 6) AS lag6
FROM b WINDOW w AS (PARTITION BY stop, route, direction ORDER BY bin)""")
def spaced_lags(spark, sf):
    d = windows.spaced_lags(_bins(spark, sf), KEYS, ["bin"], "d", (2, 4, 6), width(spark, sf))
    return d.select(*KEYS, "bin", *[r6(f"lag{i}").alias(f"lag{i}") for i in (2, 4, 6)])


@query("rolling_line_stats", with_(TRAINS) + BINS + """
SELECT stop, route, direction, bin, round(avg(d) OVER w, 6) AS roll4_mean, round(max(d) OVER w, 6) AS roll4_max, round(coalesce(stddev_samp(d) OVER w, 0), 6) AS roll4_std
FROM b WINDOW w AS (PARTITION BY stop, route, direction ORDER BY bin ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)""")
def rolling_line_stats(spark, sf):
    d = windows.rolling_line(_bins(spark, sf), KEYS, ["bin"], "d", 4, width(spark, sf))
    return d.select(*KEYS, "bin", r6("roll4_mean").alias("roll4_mean"), r6("roll4_max").alias("roll4_max"), r6("roll4_std").alias("roll4_std"))


@query("next_stop", with_(TRAINS) + """
SELECT event_id, lead(stop) OVER w AS next_stop, lead(t) OVER w AS next_t FROM trains WINDOW w AS (PARTITION BY trip ORDER BY t, event_id)""")
def next_stop(spark, sf):
    return windows.next_stop(trains(spark, sf), ["trip"], ORD, ["stop", "t"], width(spark, sf)).select("event_id", "next_stop", "next_t")


@query("previous_stop", with_(TRAINS) + """
SELECT event_id, lag(stop) OVER w AS prev_stop, lag(t) OVER w AS prev_t FROM trains WINDOW w AS (PARTITION BY trip ORDER BY t, event_id)""")
def previous_stop(spark, sf):
    return windows.previous_stop(trains(spark, sf), ["trip"], ORD, ["stop", "t"], width(spark, sf)).select("event_id", "prev_stop", "prev_t")


@query("rolling_30min_closed_left", with_(TRAINS) + """
SELECT event_id, round(avg(delay) OVER w, 6) AS mean_delay_30m, round(avg(value_s) OVER w, 6) AS mean_value_30m, count(*) OVER w AS n_trains_30m
FROM (SELECT *, floor(value) AS value_s FROM trains)
WINDOW w AS (PARTITION BY stop ORDER BY t RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING)""")
def rolling_30min(spark, sf):
    df = trains(spark, sf).withColumn("value_s", F.floor("value").cast("double"))
    d = windows.rolling_time_stats(df, ["stop"], "t", {"mean_delay_30m": "delay", "mean_value_30m": "value_s"}, 30 * MIN_US, "n_trains_30m", width(spark, sf))
    return d.select("event_id", r6("mean_delay_30m").alias("mean_delay_30m"), r6("mean_value_30m").alias("mean_value_30m"), "n_trains_30m")


@query("running_alert_flags", with_(ALERTS) + """
SELECT alert_id, row_number() OVER w AS cum_rows, CAST(sum(CAST(category = 'Delay' AS BIGINT)) OVER w AS BIGINT) AS cum_is_delay, CAST(sum(CAST(category = 'Suspension' AS BIGINT)) OVER w AS BIGINT) AS cum_is_suspension
FROM alerts WINDOW w AS (PARTITION BY route ORDER BY "at", alert_id ROWS UNBOUNDED PRECEDING)""")
def running_alert_flags(spark, sf):
    a = alerts(spark, sf).withColumns({"is_delay": (F.col("category") == "Delay").cast("int"), "is_suspension": (F.col("category") == "Suspension").cast("int")})
    d = windows.running_flags(a, ["route"], ["at", "alert_id"], ["is_delay", "is_suspension"], width(spark, sf))
    return d.select("alert_id", "cum_rows", "cum_is_delay", "cum_is_suspension")


@query("moving_average_7d", with_(TRAINS) + """,
d AS (SELECT stop, day, CAST(count(*) AS DOUBLE) AS n FROM trains GROUP BY ALL)
SELECT stop, day, round(avg(n) OVER (PARTITION BY stop ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg7 FROM d""")
def moving_average_7d(spark, sf):
    d = trains(spark, sf).groupBy("stop", "day").agg(F.count(F.lit(1)).cast("double").alias("n")).withColumn("dn", F.datediff("day", F.lit("1970-01-01")))
    return windows.moving_average(d, ["stop"], ["dn"], "n", 7, 90, "avg7").select("stop", "day", r6("avg7").alias("avg7"))


@query("first_difference", with_(TRAINS) + """
SELECT event_id, delay - lag(delay) OVER (PARTITION BY stop ORDER BY t, event_id) AS growth FROM trains""")
def first_difference(spark, sf):
    return windows.difference(trains(spark, sf), ["stop"], ORD, "delay", width(spark, sf), "growth").select("event_id", "growth")


@query("fill_forward_back", with_(TRAINS) + """
SELECT event_id, coalesce(last_value(delay IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING),
 first_value(delay IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS filled FROM trains""")
def fill_forward_back(spark, sf):
    return windows.fill_gaps(trains(spark, sf), ["trip"], ORD, "delay", width(spark, sf), "filled").select("event_id", "filled")


@query("imminent_stop", with_(TRAINS) + """,
s AS (SELECT event_id, trip, day, count(*) OVER (PARTITION BY trip, day) - row_number() OVER (PARTITION BY trip, day ORDER BY t, event_id) AS stops_left FROM trains)
SELECT trip, day, event_id, stops_left FROM s WHERE stops_left > 0 QUALIFY row_number() OVER (PARTITION BY trip, day ORDER BY stops_left, event_id) = 1""")
def imminent_stop(spark, sf):
    d = windows.trip_end(trains(spark, sf), ["trip", "day"], ORD, "delay", "t", width(spark, sf))
    return windows.imminent_stop(d, ["trip", "day"], "stops_left", ["event_id"]).select("trip", "day", "event_id", "stops_left")


@query("line_features", with_(TRAINS) + """,
s AS (SELECT event_id, route, direction, delay, t, max(t) OVER (PARTITION BY trip, day) - t AS tl FROM trains)
SELECT event_id, round(avg(delay) OVER (PARTITION BY route, direction ORDER BY tl, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS line_mean5,
 delay - lag(delay) OVER (PARTITION BY route, direction ORDER BY tl, event_id) AS line_diff FROM s""")
def line_features(spark, sf):
    tr = trains(spark, sf)
    ends = tr.groupBy("trip", "day").agg(F.max("t").alias("e"))
    d = tr.join(ends, ["trip", "day"]).withColumn("tl", F.col("e") - F.col("t"))
    return windows.line_features(d, ["route", "direction"], ["tl", "event_id"], "delay", chunks(d, ["route", "direction"], "tl", MIN_US, (sf, "left by line"))).select("event_id", r6("line_mean5").alias("line_mean5"), "line_diff")


@query("newest_per_group", with_(TRAINS) + """
SELECT stop, route, event_id, t FROM trains QUALIFY row_number() OVER (PARTITION BY stop, route ORDER BY t DESC, event_id DESC) = 1""")
def newest_per_group(spark, sf):
    from tramline.operators.clean import dedup_last

    return dedup_last(trains(spark, sf), ["stop", "route"], ORD).select("stop", "route", "event_id", "t")


@query("history_8_bins", with_(TRAINS) + BINS + """,
q AS (SELECT stop, route, direction, bin, d, count(*) OVER w AS n, first_value(bin) OVER w AS h1_bin, lag(d, 1) OVER o AS h8, lag(d, 8) OVER o AS h1
 FROM b WINDOW w AS (PARTITION BY stop, route, direction ORDER BY bin ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), o AS (PARTITION BY stop, route, direction ORDER BY bin))
SELECT stop, route, direction, bin, round(d, 6) AS target, h1_bin, round(h1, 6) AS h1, round(h8, 6) AS h8 FROM q WHERE n = 8""")
def history_8_bins(spark, sf):
    d = windows.history(_bins(spark, sf), KEYS, ["bin"], ["bin", "d"], 8, width(spark, sf))
    return d.select(*KEYS, "bin", r6("d").alias("target"), F.col("history")[0]["bin"].alias("h1_bin"), r6(F.col("history")[0]["d"]).alias("h1"), r6(F.col("history")[7]["d"]).alias("h8"))


# ---- as-of ----------------------------------------------------------------------------------


@query("asof_last_alert", with_(TRAINS, ALERTS) + """
SELECT t.event_id, a.at AS last_at, a.category AS last_category, (t.t - a.at) / 1000000 AS seconds_since,
 CAST(coalesce((t.t - a.at) / 1000000 <= 60, FALSE) AS INTEGER) AS just_published
FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t >= a.at""")
def asof_last_alert(spark, sf):
    d = asof.asof_backward(trains(spark, sf), alerts(spark, sf), ["route"], "t", "at", ["category"], ["alert_id"], width(spark, sf))
    since = (F.col("t") - F.col("last_at")) / US
    return d.select("event_id", "last_at", "last_category", since.alias("seconds_since"), F.coalesce((since <= 60).cast("int"), F.lit(0)).alias("just_published"))


@query("asof_next_alert", with_(TRAINS, ALERTS) + """
SELECT t.event_id, a.at AS next_at, (a.at - t.t) / 1000000 AS seconds_to,
 CAST(coalesce((a.at - t.t) / 1000000 <= 900, FALSE) AS INTEGER) AS in_15m, CAST(coalesce((a.at - t.t) / 1000000 <= 1800, FALSE) AS INTEGER) AS in_30m
FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t <= a.at""")
def asof_next_alert(spark, sf):
    d = asof.asof_forward(trains(spark, sf), alerts(spark, sf), ["route"], "t", "at", [], ["alert_id"], width(spark, sf))
    to = (F.col("next_at") - F.col("t")) / US
    flag = lambda s: F.coalesce((to <= s).cast("int"), F.lit(0))
    return d.select("event_id", "next_at", to.alias("seconds_to"), flag(900).alias("in_15m"), flag(1800).alias("in_30m"))


@query("asof_next_strict", with_(TRAINS, ALERTS) + """
SELECT t.event_id, a.at AS next_at, (a.at - t.t) / 60000000 AS minutes_to, CAST(coalesce((a.at - t.t) / 60000000 BETWEEN 0 AND 30, FALSE) AS INTEGER) AS in_30m
FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t < a.at""")
def asof_next_strict(spark, sf):
    d = asof.asof_forward(trains(spark, sf), alerts(spark, sf), ["route"], "t", "at", [], ["alert_id"], width(spark, sf), strict=True)
    m = (F.col("next_at") - F.col("t")) / MIN_US
    return d.select("event_id", "next_at", m.alias("minutes_to"), F.coalesce(m.between(0, 30).cast("int"), F.lit(0)).alias("in_30m"))


@query("relative_minutes", with_(TRAINS, ALERTS) + """,
b AS (SELECT t.event_id, t.t, a.at AS pa FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t >= a.at),
f AS (SELECT t.event_id, a.at AS na FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t < a.at)
SELECT event_id, CASE WHEN na IS NULL OR t - pa <= na - t THEN t - pa ELSE t - na END / 60000000 AS rel_min FROM b JOIN f USING (event_id)""")
def relative_minutes(spark, sf):
    d = asof.asof_both(trains(spark, sf), alerts(spark, sf), ["route"], "t", "at", [], ["alert_id"], width(spark, sf), strict_forward=True)
    return asof.relative_time(d, "t", "last_at", "next_at", "rel_min", MIN_US).select("event_id", "rel_min")


HZ = {"in_10m": 600, "in_20m": 1200, "in_30m": 1800, "in_45m": 2700, "in_60m": 3600}


def _nearest_sql(key: str, horizons: dict[str, int], tol: int) -> str:
    cols, joins = [], ""
    for n, h in horizons.items():
        x = h * US
        cols.append(
            f"(CASE WHEN {n}b.rt IS NOT NULL AND p.t + {x} - {n}b.rt <= {tol * US} AND ({n}f.rt IS NULL OR p.t + {x} - {n}b.rt <= {n}f.rt - p.t - {x}) THEN {n}b.rv"
            f" WHEN {n}f.rt - p.t - {x} <= {tol * US} THEN {n}f.rv END) AS {n}"
        )
        joins += f" ASOF LEFT JOIN r {n}b ON p.k = {n}b.rk AND p.t + {x} >= {n}b.rt ASOF LEFT JOIN r {n}f ON p.k = {n}f.rk AND p.t + {x} <= {n}f.rt"
    return with_(TRAINS) + f""",
p AS (SELECT event_id, {key} AS k, t FROM trains), r AS (SELECT {key} AS rk, t AS rt, delay AS rv FROM trains WHERE delay IS NOT NULL)
SELECT p.event_id, {", ".join(cols)} FROM p{joins}"""


@query("trip_delay_horizons", _nearest_sql("trip", HZ, 3600))
def trip_delay_horizons(spark, sf):
    d = asof.value_at_horizons(trains(spark, sf).select("event_id", "trip", "t", "delay"), ["trip"], "t", "delay", {k: v * US for k, v in HZ.items()}, 3600 * US, width(spark, sf), ["event_id"])
    return d.select("event_id", *HZ)


SH = {"in_10m": 600, "in_20m": 1200, "in_30m": 1800}


@query("station_delay_horizons", _nearest_sql("stop", SH, 360))
def station_delay_horizons(spark, sf):
    d = asof.value_at_horizons(trains(spark, sf).select("event_id", "stop", "t", "delay"), ["stop"], "t", "delay", {k: v * US for k, v in SH.items()}, 360 * US, width(spark, sf), ["event_id"])
    return d.select("event_id", *SH)


@query("target_with_final_fallback", _nearest_sql("trip", {"in_30m": 1800}, 360).replace("SELECT p.event_id,", "SELECT p.event_id, x.final_value,").replace(
    "AS in_30m FROM p", "AS in_30m_raw FROM p JOIN (SELECT event_id, last_value(delay IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_value FROM trains) x ON x.event_id = p.event_id"))
def target_with_final_fallback(spark, sf):
    d = asof.value_at_horizons(trains(spark, sf).select("event_id", "trip", "t", "delay"), ["trip"], "t", "delay", {"in_30m_raw": 1800 * US}, 360 * US, width(spark, sf), ["event_id"])
    return windows.trip_end(d, ["trip"], ORD, "delay", "t", width(spark, sf)).select("event_id", "final_value", "in_30m_raw")


@query("active_count_120m", with_(TRAINS, ALERTS) + """
SELECT t.event_id, count(a.at) AS n_active, count(a.at) FILTER (a.category = 'Suspension') AS n_suspension, CAST(count(a.at) > 0 AS INTEGER) AS alert_active
FROM trains t LEFT JOIN alerts a ON t.route = a.route AND a.at BETWEEN t.t - 7200000000 AND t.t GROUP BY t.event_id""")
def active_count_120m(spark, sf):
    s = {"n_active": F.lit(1).cast("bigint"), "n_suspension": (F.col("category") == "Suspension").cast("bigint")}
    d = ordered.lookback_sums(trains(spark, sf), alerts(spark, sf), ["route"], "t", "at", 120 * MIN_US, s, closed="both", width=width(spark, sf, ("route",)))
    return d.select("event_id", "n_active", "n_suspension", (F.col("n_active") > 0).cast("int").alias("alert_active"))


@query("join_events", with_(TRAINS, CITY) + """
SELECT t.event_id, count(c.city_id) AS n_events,
 coalesce(max(struct_pack(s := c.score, k := c.kind)).k, 'Ninguno') AS event_kind,
 count(c.city_id) FILTER (t.sec < c.start_s) AS n_before, count(c.city_id) FILTER (t.sec BETWEEN c.start_s AND c.end_s) AS n_during, count(c.city_id) FILTER (t.sec > c.end_s) AS n_after
FROM trains t LEFT JOIN city c ON t.route = c.route AND t.day = c.day AND t.sec BETWEEN c.start_s - 5400 AND c.end_s + 5400 GROUP BY t.event_id""")
def join_events(spark, sf):
    d = intervals.join_events(trains(spark, sf), city_events(spark, sf), ["route", "day"], "sec", "start_s", "end_s", "kind", "score", width=max(60, width(spark, sf, ("route",)).even // US))
    return d.select("event_id", "n_events", "event_kind", "n_before", "n_during", "n_after")


@query("event_study", with_(TRAINS, ALERTS) + """
SELECT CAST(floor((t.t - a.at) / 300000000) * 5 AS BIGINT) AS rel_min, round(avg(t.delay), 6) AS mean_value, count(t.delay) AS n_rows
FROM trains t JOIN alerts a ON t.route = a.route AND t.day = a.alert_day AND t.t >= a.at - 5400000000 AND t.t < a.at + 5400000000
GROUP BY 1 HAVING count(t.delay) > 0""")
def event_study(spark, sf):
    pts, nt = trains(spark, sf), alerts(spark, sf).withColumnRenamed("alert_day", "day")
    d = intervals.event_study(pts, nt, ["route", "day"], "t", "at", "delay", -90 * MIN_US, 90 * MIN_US, 5 * MIN_US, width(spark, sf))
    return d.select((F.col("rel_bin") / MIN_US).cast("bigint").alias("rel_min"), r6("mean_value").alias("mean_value"), "n_rows")


@query("event_study_by_group", with_(TRAINS, ALERTS) + """
SELECT a.category, CAST(floor((t.t - a.at) / 300000000) * 5 AS BIGINT) AS rel_min, round(avg(t.delay), 6) AS mean_value, count(t.delay) AS n_rows
FROM trains t JOIN alerts a ON t.route = a.route AND t.day = a.alert_day AND t.t >= a.at - 3600000000 AND t.t < a.at
GROUP BY 1, 2 HAVING count(t.delay) > 0""")
def event_study_by_group(spark, sf):
    pts, nt = trains(spark, sf), alerts(spark, sf).withColumnRenamed("alert_day", "day")
    d = intervals.event_study(pts, nt, ["route", "day"], "t", "at", "delay", -60 * MIN_US, 0, 5 * MIN_US, width(spark, sf), ["category"])
    return d.select("category", (F.col("rel_bin") / MIN_US).cast("bigint").alias("rel_min"), r6("mean_value").alias("mean_value"), "n_rows")


@query("match_predictions", with_(TRAINS) + """,
p AS (SELECT event_id, route, direction, t FROM trains WHERE stop = 'signup'), a AS (SELECT route, direction, t AS at, delay FROM trains WHERE stop <> 'signup')
SELECT p.event_id, CASE WHEN a.at <= p.t + 900000000 THEN a.at END AS actual_at, CASE WHEN a.at <= p.t + 900000000 THEN a.delay END AS actual_delay
FROM p ASOF LEFT JOIN a ON p.route = a.route AND p.direction = a.direction AND p.t - 900000000 <= a.at""")
def match_predictions(spark, sf):
    tr = trains(spark, sf)
    p, a = tr.filter("stop = 'signup'"), tr.filter("stop <> 'signup'").withColumnRenamed("t", "at")
    return asof.first_within(p, a, ["route", "direction"], "t", "at", ["delay"], 900 * US, width(spark, sf), ["event_id"]).select("event_id", "actual_at", "actual_delay")


@query("compare_lagged", _nearest_sql("route", {"before": -600}, 120).replace("SELECT p.event_id,", "SELECT p.event_id, p.dv AS delay,").replace(" AS k, t FROM trains)", " AS k, t, delay AS dv FROM trains)"))
def compare_lagged(spark, sf):
    d = asof.value_at_horizons(trains(spark, sf).select("event_id", "route", "t", "delay"), ["route"], "t", "delay", {"before": -600 * US}, 120 * US, width(spark, sf), ["event_id"])
    return d.select("event_id", "delay", "before")


PH = [("before", "start_t - 4*5400000000", "start_t - 5400000000"), ("entry", "start_t - 5400000000", "start_t"), ("during", "start_t", "end_t"),
      ("exit", "end_t", "end_t + 5400000000"), ("after", "end_t + 5400000000", "end_t + 4*5400000000")]
PHASES = ", ph AS (" + " UNION ALL ".join(f"SELECT city_id, route, '{n}' AS phase, {a} AS lo, {b} AS hi FROM city" for n, a, b in PH) + ")"


@query("event_phases", with_(TRAINS, CITY) + PHASES + """
SELECT ph.city_id, ph.phase, round(avg(t.delay), 6) AS mean_value, count(t.delay) AS n_rows
FROM ph LEFT JOIN trains t ON t.route = ph.route AND t.t >= ph.lo AND t.t < ph.hi GROUP BY 1, 2""")
def event_phases(spark, sf):
    d = intervals.event_phases(trains(spark, sf), city_events(spark, sf), "route", "t", "delay", "start_t", "end_t", ["city_id"], 5400 * US, width(spark, sf))
    return d.select("city_id", "phase", r6("mean_value").alias("mean_value"), "n_rows")


@query("event_impact", with_(TRAINS, CITY) + PHASES + """
SELECT ph.city_id, ph.phase, round(avg(t.delay) FILTER (t.route = ph.route), 6) AS mean_stop, round(avg(t.delay) FILTER (t.route <> ph.route), 6) AS mean_rest,
 round(avg(t.delay) FILTER (t.route = ph.route) - avg(t.delay) FILTER (t.route <> ph.route), 6) AS net_impact
FROM ph LEFT JOIN trains t ON t.t >= ph.lo AND t.t < ph.hi WHERE ph.phase IN ('entry', 'exit') GROUP BY 1, 2""")
def event_impact(spark, sf):
    d = intervals.event_impact(trains(spark, sf), city_events(spark, sf), "route", "t", "delay", "start_t", "end_t", ["city_id"], 5400 * US, width(spark, sf, ("route",)), width(spark, sf, ()))
    return d.select("city_id", "phase", *[r6(c).alias(c) for c in ("mean_stop", "mean_rest", "net_impact")])


@query("snowball", with_(TRAINS, CITY) + """,
x AS (SELECT *, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS nd FROM trains),
j AS (SELECT c.city_id, count(*) FILTER (x.nd > x.delay) AS propagated, count(*) FILTER (x.nd < x.delay) AS absorbed, count(*) FILTER (x.nd = x.delay) AS unchanged
 FROM city c LEFT JOIN x ON x.route = c.route AND x.t >= c.end_t AND x.t < c.end_t + 5400000000 GROUP BY 1)
SELECT *, round(propagated / nullif(propagated + absorbed + unchanged, 0), 6) AS share_propagated FROM j""")
def snowball(spark, sf):
    x = windows.next_stop(trains(spark, sf), ["trip"], ORD, ["delay"], width(spark, sf))
    d = intervals.snowball(x, city_events(spark, sf), "route", "t", "next_delay", "delay", "end_t", ["city_id"], 5400 * US, width(spark, sf))
    return d.select("city_id", "propagated", "absorbed", "unchanged", r6("share_propagated").alias("share_propagated"))


@query("circular_window_rows", with_(TRAINS, CITY) + """
SELECT c.city_id, t.event_id FROM city c JOIN trains t ON t.route = c.route AND t.t >= c.end_t AND t.t < c.end_t + 5400000000""")
def circular_window_rows(spark, sf):
    c = city_events(spark, sf).select("city_id", "route", F.col("end_t").alias("lo"), (F.col("end_t") + 5400 * US).alias("hi"))
    return intervals.range_join(trains(spark, sf), c, ["route"], "t", "lo", "hi", 2 * HOUR_US).select("city_id", "event_id")


@query("row_positions", with_(TRAINS) + """
SELECT event_id, row_number() OVER (ORDER BY t, event_id) AS pos FROM trains""")
def row_positions(spark, sf):
    return ordered.row_index(trains(spark, sf), [], ORD, width(spark, sf, ()), "pos").select("event_id", "pos")
