"""Aggregate queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import ALERTS, CITY, HOUR_US, MIN_US, TRAINS, US, width, WEATHER, alerts, city_events, query, r6, table, trains, us, weather, with_
from tramline.operators import aggregates as ag
from tramline.operators import asof, quantiles
from tramline.operators.joins import join_weather

ORD = ["t", "event_id"]


def rnd(df, *cols):
    return df.withColumns({c: r6(c) for c in cols})


def _hour(df):
    return df.withColumn("hour", F.floor(F.col("sec") / 3600).cast("int"))


HOURS = ", h AS (SELECT *, CAST(sec // 3600 AS INTEGER) AS hour FROM trains)"


@query("collapse_alerts", with_(TRAINS) + """
SELECT trip, min(t) AS timestamp_start, max(t) AS timestamp_end, arg_min(stop, (t, event_id)) AS stop, arg_max(delay, (t, event_id)) AS delay, greatest(count(*) - 1, 0) AS num_updates FROM trains GROUP BY trip""")
def collapse_alerts(spark, sf):
    return ag.collapse_alerts(trains(spark, sf), "trip", "t", ["stop"], ["delay"], ["event_id"])


@query("count_updates", with_(TRAINS) + "SELECT event_id, count(*) OVER (PARTITION BY trip) - 1 AS num_updates FROM trains")
def count_updates(spark, sf):
    return ag.count_updates(trains(spark, sf), "trip").select("event_id", "num_updates")


KINDS = ("click", "error", "purchase", "signup", "view")


def _window_input(spark, sf):
    """Train rows under the column names of the window aggregate."""
    d = trains(spark, sf)
    h = F.floor(F.col("sec") / 3600)
    return d.select(
        "event_id", "t", F.col("stop").alias("stop_id"), F.col("route").alias("route_id"), "direction", F.col("trip").alias("match_key"), F.col("stop").alias("category"),
        F.col("unscheduled").alias("is_unscheduled"), (F.weekday("day") >= 5).alias("is_weekend"), F.col("delay").alias("delay_seconds"),
        F.when(F.col("value") > 20, F.col("delay") * 200).alias("target_delay_30m"), F.floor("value").cast("double").alias("actual_headway_seconds"),
        F.when(F.col("value") > 60, F.floor("value").cast("double")).alias("seconds_since_last_alert"), F.floor(F.col("value") / 50).alias("num_updates"),
        h.alias("hour_sin"), F.weekday("day").alias("dow"), (F.col("value") > 120).cast("int").alias("alert_in_next_15m"),
    )


WIN = """, w AS (SELECT event_id, t, stop AS stop_id, route AS route_id, direction, trip AS match_key, stop AS category, unscheduled AS is_unscheduled, isodow(day) >= 6 AS is_weekend, delay AS delay_seconds,
 CASE WHEN value > 20 THEN delay * 200 END AS target_delay_30m, CAST(floor(value) AS DOUBLE) AS actual_headway_seconds, CASE WHEN value > 60 THEN CAST(floor(value) AS DOUBLE) END AS seconds_since_last_alert,
 CAST(floor(value / 50) AS BIGINT) AS num_updates, sec // 3600 AS hour_sin, CAST(isodow(day) - 1 AS INTEGER) AS dow, CAST(value > 120 AS INTEGER) AS alert_in_next_15m FROM trains)"""


def _window_sql(width_us: int) -> str:
    oh = ", ".join(f"CAST(sum(CASE WHEN category = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS category_{k}_sum" for k in KINDS)
    return f"""SELECT stop_id, route_id, direction, (t // {width_us}) * {width_us} AS bin, max(CAST(is_unscheduled AS INTEGER)) AS is_unscheduled_max, max(CAST(is_weekend AS INTEGER)) AS is_weekend_max,
 CAST(max(alert_in_next_15m) AS DOUBLE) AS alert_in_next_15m_max, avg(delay_seconds) AS delay_seconds_mean, max(delay_seconds) AS delay_seconds_max,
 avg(CASE WHEN abs(target_delay_30m) <= 43200 THEN target_delay_30m END) AS target_delay_30m_mean, max(CASE WHEN abs(target_delay_30m) <= 43200 THEN target_delay_30m END) AS target_delay_30m_max,
 count(DISTINCT match_key) AS match_key_nunique, avg(actual_headway_seconds) AS actual_headway_seconds_mean, avg(seconds_since_last_alert) AS seconds_since_last_alert_mean,
 CAST(floor(avg(t - (t // {width_us}) * {width_us}) / 1000000) AS BIGINT) AS merge_offset_s, CAST(sum(num_updates) AS BIGINT) AS num_updates_sum, arg_min(hour_sin, (t, event_id)) AS hour_sin_first, arg_min(dow, (t, event_id)) AS dow_first, {oh}
FROM w GROUP BY ALL"""


def _window(spark, sf, width):
    return ag.window_aggregate(_window_input(spark, sf), "t", width, onehot={"category": KINDS}, tie=["event_id"])


@query("window_60min", with_(TRAINS) + WIN + "\n" + _window_sql(HOUR_US))
def window_60min(spark, sf):
    d = _window(spark, sf, HOUR_US)
    return d.withColumn("merge_offset_s", F.floor((F.col("merge_time_mean") - F.col("bin")) / US)).drop("merge_time_mean")


@query("onehot_sums", with_(TRAINS) + "SELECT route, " + ", ".join(f"CAST(sum(CASE WHEN stop = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS stop_{k}_sum" for k in KINDS) + " FROM trains GROUP BY route")
def onehot_sums(spark, sf):
    return trains(spark, sf).groupBy("route").agg(*ag.onehot_sums("stop", KINDS))


@query("snapshot_bin", with_(TRAINS) + "SELECT event_id, CASE WHEN t % 900000000 >= 450000000 THEN (t // 900000000) * 900000000 ELSE (t // 900000000) * 900000000 - 900000000 END AS bin FROM trains")
def snapshot_bin(spark, sf):
    return trains(spark, sf).select("event_id", ag.snapshot_bin(F.col("t"), 900_000_000).alias("bin"))


@query("line_aggregate", with_(TRAINS) + WIN + ", a AS (" + _window_sql(900_000_000) + f"""),
b AS (SELECT *, CASE WHEN bin - lag(bin, 1) OVER k <= 1200000000 THEN lag(delay_seconds_mean, 1) OVER k END AS delay_1_before, CASE WHEN bin - lag(bin, 2) OVER k <= 2100000000 THEN lag(delay_seconds_mean, 2) OVER k END AS delay_2_before,
 CASE WHEN bin - lag(bin, 3) OVER k <= 3000000000 THEN lag(delay_seconds_mean, 3) OVER k END AS delay_3_before FROM a WINDOW k AS (PARTITION BY stop_id, route_id, direction ORDER BY bin)),
l AS (SELECT route_id, direction, (bin // 1800000000) * 1800000000 AS bin, avg(delay_seconds_mean) AS dm, max(delay_seconds_mean) AS dx, stddev_samp(delay_seconds_mean) AS ds,
 CAST(coalesce(sum(CAST(delay_seconds_mean > 60 AS INTEGER)), 0) AS BIGINT) AS stops_delayed, count(*) AS stops_total, avg(delay_1_before) AS d1, avg(delay_2_before) AS d2, avg(delay_3_before) AS d3,
 avg(actual_headway_seconds_mean) AS hm, stddev_samp(actual_headway_seconds_mean) AS hs, max(is_unscheduled_max) AS is_unscheduled, CAST(sum(num_updates_sum) AS BIGINT) AS num_updates, CAST(sum(match_key_nunique) AS BIGINT) AS match_key_nunique,
 max(is_weekend_max) AS is_weekend, coalesce(min(seconds_since_last_alert_mean), 999999) AS since, CAST(max(alert_in_next_15m_max) AS INTEGER) AS target
 FROM b WHERE alert_in_next_15m_max IS NOT NULL GROUP BY ALL)
SELECT route_id, direction, bin, round(dm, 6) AS delay_mean_line, round(dx, 6) AS delay_max_line, round(ds, 6) AS delay_std_line, stops_delayed, stops_total, round(d1, 6) AS delay_1_before_mean, round(d2, 6) AS delay_2_before_mean,
 round(d3, 6) AS delay_3_before_mean, round(hm, 6) AS headway_mean_line, round(hs, 6) AS headway_std_line, is_unscheduled, num_updates, match_key_nunique, is_weekend, since AS seconds_since_alert_line, target,
 round(stops_delayed / greatest(stops_total, 1), 6) AS pct_stops_delayed, round(dm - d1, 6) AS delay_acceleration_line, round(hs / CASE WHEN hm IS NOT NULL THEN greatest(hm, 1) END, 6) AS headway_cv,
 CAST(stops_delayed / greatest(stops_total, 1) > 0.5 AS INTEGER) AS collapse_line, round(dm * CASE WHEN dm - d1 IS NOT NULL THEN greatest(dm - d1, 0) END, 6) AS delay_x_acceleration FROM l""")
def line_aggregate(spark, sf):
    from tramline.operators.windows import bin_lags

    a = _window(spark, sf, 900_000_000).withColumn("hour_cos_first", F.lit(0.0))
    b = bin_lags(a, ["stop_id", "route_id", "direction"], "bin", "delay_seconds_mean", 3, 900 * US, 300 * US, width(spark, sf), "_b")
    b = b.withColumnsRenamed({f"_b{i}": f"delay_{i}_before" for i in (1, 2, 3)})
    d = ag.line_aggregate(b, "bin", 1800 * US, "alert_in_next_15m_max").drop("hour_sin", "hour_cos", "dow")
    return rnd(d, "delay_mean_line", "delay_max_line", "delay_std_line", "delay_1_before_mean", "delay_2_before_mean", "delay_3_before_mean", "headway_mean_line", "headway_std_line", "pct_stops_delayed",
               "delay_acceleration_line", "headway_cv", "delay_x_acceleration")


@query("edge_list", with_(TRAINS) + """, n AS (SELECT stop AS src, lead(stop) OVER w AS dst, lead(t) OVER w - t AS tt FROM trains WINDOW w AS (PARTITION BY trip ORDER BY t, event_id))
SELECT src, dst, count(*) AS trip_count, quantile_cont(CAST(tt AS DOUBLE), 0.5) AS median_travel_time FROM n WHERE dst IS NOT NULL AND tt > 0 GROUP BY ALL""")
def edge_list(spark, sf):
    return ag.build_edges(trains(spark, sf), ["trip"], ORD, "stop", "t", width(spark, sf))


@query("bin_aggregate", with_(TRAINS) + """SELECT stop, (t // 900000000) * 900000000 AS bin, round(avg(delay), 6) AS delay_mean, CAST(coalesce(sum(CAST(floor(value) AS BIGINT)), 0) AS BIGINT) AS whole_sum, max(value) AS value_max FROM trains GROUP BY ALL""")
def bin_aggregate(spark, sf):
    return rnd(ag.bin_aggregate(trains(spark, sf).withColumn("whole", F.floor("value")), ["stop"], "t", 900_000_000, ["delay"], ["whole"], ["value"]), "delay_mean")


@query("historical_average", with_(TRAINS) + HOURS + """, tr AS (SELECT *, isodow(day) AS dow FROM h WHERE day < DATE '2024-01-20'), te AS (SELECT *, isodow(day) AS dow FROM h WHERE day >= DATE '2024-01-20'),
f AS (SELECT trip, dow, hour, avg(delay) AS a FROM tr GROUP BY ALL), c AS (SELECT trip, avg(delay) AS b FROM tr GROUP BY ALL)
SELECT event_id, round(coalesce(a, b, (SELECT avg(delay) FROM tr)), 6) AS expected FROM te LEFT JOIN f USING (trip, dow, hour) LEFT JOIN c USING (trip)""")
def historical_average(spark, sf):
    h = _hour(trains(spark, sf)).withColumn("dow", F.weekday("day"))
    d = ag.historical_average(h.filter("day < date'2024-01-20'"), h.filter("day >= date'2024-01-20'"), "trip", ["dow", "hour"], "delay")
    return d.select("event_id", r6("expected").alias("expected"))


@query("fuse_events", """SELECT p_brand, max(p_retailprice) AS score, arg_max(p_type, (p_retailprice, p_type)) AS kind, array_to_string(list_sort(list(DISTINCT w)), ';') AS stations
FROM (SELECT *, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY p_brand""")
def fuse_events(spark, sf):
    p = table(spark, sf, "part").select("p_brand", F.col("p_retailprice").alias("score"), F.col("p_type").alias("kind"), F.split("p_name", " ").alias("stations"))
    return ag.fuse_events(p, ["p_brand"], "score", "kind", "stations").withColumn("stations", F.array_join("stations", ";"))


@query("quality_report", with_(TRAINS) + """, a AS (SELECT event_id, trip, delay FROM trains WHERE delay IS NULL OR delay BETWEEN -900 AND 900)
SELECT (SELECT count(*) FROM trains) AS rows_before, count(*) AS rows_after, CAST(sum(CAST(event_id IS NULL AS INTEGER)) AS BIGINT) AS null_event_id, CAST(sum(CAST(trip IS NULL AS INTEGER)) AS BIGINT) AS null_trip, CAST(sum(CAST(delay IS NULL AS INTEGER)) AS BIGINT) AS null_delay,
 min(delay) AS min, max(delay) AS max, round(avg(delay), 6) AS mean, quantile_cont(delay, 0.5) AS p50, round(quantile_cont(delay, 0.95), 6) AS p95 FROM a""")
def quality_report(spark, sf):
    from tramline.operators.clean import filter_outliers

    t = trains(spark, sf)
    a = filter_outliers(t, "delay", -900, 900).select("event_id", "trip", "delay")
    return rnd(ag.quality_report(t, a, "delay"), "mean", "p95")


_PROF = ("event_id", "trip", "stop", "delay")


@query("column_profile", with_(TRAINS) + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values, round((count(*) - count({c})) / count(*), 6) AS null_share FROM trains" for c in _PROF))
def column_profile(spark, sf):
    return rnd(ag.profile(trains(spark, sf).select(*_PROF)), "null_share")


@query("duplicate_rows", "SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicate_rows")
def duplicate_rows(spark, sf):
    return ag.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"))


@query("describe_delay", with_(TRAINS) + """, q AS (SELECT quantile_cont(delay, 0.25) AS p25, quantile_cont(delay, 0.5) AS p50, quantile_cont(delay, 0.75) AS p75, quantile_cont(delay, 0.9) AS p90, quantile_cont(delay, 0.95) AS p95, quantile_cont(delay, 0.99) AS p99 FROM trains)
SELECT round(p25, 6) AS p25, round(p50, 6) AS p50, round(p75, 6) AS p75, round(p90, 6) AS p90, round(p95, 6) AS p95, round(p99, 6) AS p99, count(delay) AS count, round(avg(delay), 6) AS mean, round(stddev_samp(delay), 6) AS std, min(delay) AS min, max(delay) AS max,
 round(avg(CAST(delay = 0 AS INTEGER)), 6) AS zero_share, count(*) FILTER (delay > p90) AS above_p90, count(*) FILTER (delay > p95) AS above_p95, count(*) FILTER (delay > p99) AS above_p99 FROM trains, q GROUP BY q.p25, q.p50, q.p75, q.p90, q.p95, q.p99""")
def describe_delay(spark, sf):
    return rnd(ag.describe_col(trains(spark, sf), "delay"), "p25", "p50", "p75", "p90", "p95", "p99", "mean", "std", "zero_share")


@query("grouped_stats", with_(TRAINS) + HOURS + """SELECT hour, round(avg(delay), 6) AS mean, round(stddev_samp(delay), 6) AS std, count(delay) AS count, min(delay) AS min, max(delay) AS max,
 round(quantile_cont(delay, 0.5), 6) AS median, round(quantile_cont(delay, 0.95), 6) AS p95 FROM h GROUP BY hour""")
def grouped_stats(spark, sf):
    return rnd(ag.grouped_stats(_hour(trains(spark, sf)), ["hour"], "delay"), "mean", "std", "median", "p95")


@query("price_quantiles", """SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.05), 6) AS p05, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95 FROM lineitem GROUP BY ALL""")
def price_quantiles(spark, sf):
    return rnd(quantiles.exact_quantiles(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", {"p05": 0.05, "p50": 0.5, "p95": 0.95}), "p05", "p50", "p95")


@query("pivot_hour", with_(TRAINS) + HOURS + "SELECT route, " + ", ".join(f"round(avg(delay) FILTER (hour = {h}), 6) AS hour_{h}" for h in range(24)) + " FROM h GROUP BY route")
def pivot_hour(spark, sf):
    return rnd(ag.pivot_mean(_hour(trains(spark, sf)), "route", "hour", "delay", range(24)), *[f"hour_{h}" for h in range(24)])


@query("extreme_hours", with_(TRAINS) + HOURS + """, m AS (SELECT route, hour, avg(delay) AS m FROM h GROUP BY ALL HAVING avg(delay) IS NOT NULL)
SELECT route, arg_min(hour, (-m, hour)) AS worst, arg_min(hour, (m, hour)) AS best FROM m GROUP BY route""")
def extreme_hours(spark, sf):
    return ag.extreme_column(_hour(trains(spark, sf)), "route", "hour", "delay")


_CORR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("corr_pairs", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for i, a in enumerate(_CORR) for b in _CORR[i + 1:]))
def corr_pairs(spark, sf):
    return rnd(ag.corr_pairs(table(spark, sf, "lineitem"), _CORR), "r")


_STRONG = ("delay", "value", "sec", "route")


@query("corr_pairs_strong", with_(TRAINS) + "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r FROM trains" for i, a in enumerate(_STRONG) for b in _STRONG[i + 1:]) + ") WHERE abs(r) > 0.85")
def corr_pairs_strong(spark, sf):
    return rnd(ag.corr_pairs(trains(spark, sf), _STRONG, 0.85), "r")


@query("horizon_corr", with_(TRAINS) + """, l AS (SELECT delay, lead(delay, 1) OVER w AS h1, lead(delay, 2) OVER w AS h2, lead(delay, 3) OVER w AS h3 FROM trains WINDOW w AS (PARTITION BY trip ORDER BY t, event_id))
""" + " UNION ALL ".join(f"SELECT 'h{i}' AS \"column\", round(corr(h{i}, delay), 6) AS r FROM l" for i in (1, 2, 3)))
def horizon_corr(spark, sf):
    from tramline.operators.ordered import nth_prior, prior_rows

    d = prior_rows(trains(spark, sf), ["trip"], ORD, ["delay"], 3, width(spark, sf), "_p", reverse=True).withColumns({f"h{i}": nth_prior("_p", "delay", i) for i in (1, 2, 3)})
    return rnd(ag.corr_with(d, ["h1", "h2", "h3"], "delay"), "r")


def _edges_sql(col: str, table_: str, q: int) -> str:
    return f"(SELECT list_sort(list_distinct([{', '.join(f'quantile_cont(CAST({col} AS DOUBLE), {i / q})' for i in range(1, q))}])) AS es FROM {table_})"


@query("quantile_bins", with_(TRAINS) + f", e AS {_edges_sql('value', 'trains', 10)}" + """
SELECT CAST(len(list_filter(es, lambda x: x < value)) AS INTEGER) AS bin, round(avg(delay), 6) AS mean, count(*) AS n FROM trains, e GROUP BY 1""")
def quantile_bins(spark, sf):
    return rnd(ag.stats_per_bin(trains(spark, sf), "value", 10, "delay"), "mean")


@query("late_share", with_(TRAINS) + HOURS + "SELECT hour, round(count(*) FILTER (delay > 300) / count(*), 6) AS share, count(*) AS n FROM h GROUP BY hour")
def late_share(spark, sf):
    return rnd(ag.share_by(_hour(trains(spark, sf)), ["hour"], F.col("delay") > 300), "share")


@query("conditional_mean", with_(TRAINS) + HOURS + "SELECT hour, round(avg(value_w), 6) AS mean, count(value_w) AS n FROM (SELECT *, floor(value) AS value_w FROM h) WHERE delay BETWEEN 120 AND 300 GROUP BY hour")
def conditional_mean(spark, sf):
    d = _hour(trains(spark, sf)).withColumn("vw", F.floor("value"))
    return rnd(ag.conditional_mean(d, F.col("delay").between(120, 300), ["hour"], "vw"), "mean")


@query("platform_pairs", """WITH p AS (SELECT p_brand || CASE p_size % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' ELSE '' END AS s FROM part)
SELECT regexp_extract(s, '^(.*)([NS])$', 1) AS base, bool_or(s LIKE '%N') AS has_n, bool_or(s LIKE '%S') AS has_s, bool_or(s LIKE '%N') AND bool_or(s LIKE '%S') AS complete FROM p WHERE regexp_matches(s, '[NS]$') GROUP BY 1""")
def platform_pairs(spark, sf):
    m = F.col("p_size") % 3
    p = table(spark, sf, "part").withColumn("s", F.concat("p_brand", F.when(m == 0, "N").when(m == 1, "S").otherwise("")))
    return ag.platform_pairs(p, "s")


CAL = """, n AS (SELECT alert_day AS day, count(DISTINCT route) AS c FROM alerts GROUP BY 1),
cal AS (SELECT CAST(d AS DATE) AS day FROM (SELECT unnest(generate_series((SELECT min(day) FROM n), (SELECT max(day) FROM n), INTERVAL 1 DAY)) AS d)),
x AS (SELECT cal.day, coalesce(n.c, 0) AS n_alerts, CAST(isodow(cal.day) - 1 AS INTEGER) AS dow FROM cal LEFT JOIN n ON cal.day = n.day)"""


@query("alert_calendar", with_(ALERTS) + CAL + "SELECT day, n_alerts, dow FROM x")
def alert_calendar(spark, sf):
    return ag.alert_calendar(alerts(spark, sf).withColumnRenamed("alert_day", "day"), "route", "day")


@query("alert_weekend_share", with_(ALERTS) + CAL + "SELECT dow >= 5 AS weekend, CAST(sum(n_alerts) AS BIGINT) AS n, round(sum(n_alerts) / (SELECT sum(n_alerts) FROM x), 6) AS observed, round(CASE WHEN dow >= 5 THEN 2.0 / 7 ELSE 5.0 / 7 END, 6) AS expected FROM x GROUP BY 1, 4")
def alert_weekend_share(spark, sf):
    return rnd(ag.weekend_share(ag.alert_calendar(alerts(spark, sf).withColumnRenamed("alert_day", "day"), "route", "day")), "observed", "expected")


@query("effect_diff", with_(TRAINS, ALERTS) + """, b AS (SELECT t.*, CAST(coalesce(t.t - a.at <= 1800000000, FALSE) AS INTEGER) AS f, CAST(t.sec // 3600 AS INTEGER) AS hour FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t >= a.at)
SELECT hour, round(avg(delay) FILTER (f = 1), 6) AS mean_with, round(avg(delay) FILTER (f = 0), 6) AS mean_without, round(avg(delay) FILTER (f = 1) - avg(delay) FILTER (f = 0), 6) AS effect FROM b GROUP BY hour""")
def effect_diff(spark, sf):
    d = asof.asof_backward(_hour(trains(spark, sf)), alerts(spark, sf), ["route"], "t", "at", [], ["alert_id"], width(spark, sf))
    d = d.withColumn("f", F.coalesce((F.col("t") - F.col("last_at") <= 1800 * US).cast("int"), F.lit(0)))
    return rnd(ag.effect_diff(d, ["hour"], "f", "delay"), "mean_with", "mean_without", "effect")


def _curve_sql(unit: int, lo: int, hi: int, w: int) -> str:
    return with_(TRAINS, ALERTS) + f""", b AS (SELECT t.delay, (t.t - a.at) / {unit} AS rel FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t >= a.at)
SELECT CAST(floor(rel / {w}) * {w} AS BIGINT) AS rel_bin, round(avg(delay), 6) AS mean, count(*) AS n FROM b WHERE rel BETWEEN {lo} AND {hi} AND delay IS NOT NULL GROUP BY 1"""


def _curve(spark, sf, lo, hi, w):
    d = asof.asof_backward(trains(spark, sf), alerts(spark, sf), ["route"], "t", "at", [], ["alert_id"], width(spark, sf))
    return rnd(ag.relative_curve(d.withColumn("rel", (F.col("t") - F.col("last_at")) / MIN_US), "rel", "delay", lo, hi, w), "mean")


@query("latency_curve", _curve_sql(MIN_US, 0, 90, 1))
def latency_curve(spark, sf):
    return _curve(spark, sf, 0, 90, 1)


@query("recovery_curve", _curve_sql(MIN_US, 0, 120, 5))
def recovery_curve(spark, sf):
    return _curve(spark, sf, 0, 120, 5)


@query("phase_trips", with_(TRAINS, CITY) + """, ph AS (SELECT city_id, route, 'before' AS phase, start_t - 5400000000 AS lo, start_t AS hi FROM city UNION ALL SELECT city_id, route, 'during', start_t, end_t FROM city UNION ALL SELECT city_id, route, 'after', end_t, end_t + 5400000000 FROM city)
SELECT ph.city_id, ph.phase, count(DISTINCT CASE WHEN t.unscheduled THEN t.trip END) AS n_trips, round(count(*) FILTER (t.unscheduled) / count(*), 6) AS share_rows
FROM ph JOIN trains t ON t.route = ph.route AND t.t >= ph.lo AND t.t < ph.hi GROUP BY 1, 2""")
def phase_trips(spark, sf):
    from tramline.operators.intervals import THREE_PHASES, phase_trips as run

    d = run(trains(spark, sf), city_events(spark, sf), "route", "t", "trip", F.col("unscheduled"), "start_t", "end_t", ["city_id"], 5400 * US, width(spark, sf, ("route",)), THREE_PHASES)
    return rnd(d.select("city_id", "phase", "n_trips", "share_rows"), "share_rows")


@query("weather_effect", with_(TRAINS, WEATHER) + """, j AS (SELECT delay, CAST(temp > 60 AS INTEGER) AS hot, CAST(rain > 10 AS INTEGER) AS wet FROM trains t JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour)
""" + " UNION ALL ".join(f"SELECT '{f}' AS flag, round(avg(delay) FILTER ({f} = 1), 6) AS mean_with, round(avg(delay) FILTER ({f} = 0), 6) AS mean_without, round(avg(delay) FILTER ({f} = 1) - avg(delay) FILTER ({f} = 0), 6) AS delta FROM j" for f in ("hot", "wet")))
def weather_effect(spark, sf):
    j = join_weather(_hour(trains(spark, sf)), weather(spark, sf), how="inner").withColumns({"hot": (F.col("temp") > 60).cast("int"), "wet": (F.col("rain") > 10).cast("int")})
    return rnd(ag.weather_effect(j, ["hot", "wet"], "delay"), "mean_with", "mean_without", "delta")


@query("temp_extreme", with_(WEATHER) + """, q AS (SELECT day, quantile_cont(temp, 0.1) AS a, quantile_cont(temp, 0.9) AS b, count(temp) AS n FROM weather GROUP BY day)
SELECT day, hour, CAST(CASE WHEN n >= 10 THEN temp < a OR temp > b ELSE temp < -5 OR temp > 35 END AS INTEGER) AS temp_extreme FROM weather JOIN q USING (day)""")
def temp_extreme(spark, sf):
    return ag.temp_extreme(weather(spark, sf), ["day"], "temp").select("day", "hour", "temp_extreme")


_DR = ("delay", "sec", "route")


@query("drift_report", with_(TRAINS) + ", m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", avg(CAST({c} AS DOUBLE)) FILTER (day < DATE '2024-01-16') AS a, avg(CAST({c} AS DOUBLE)) FILTER (day >= DATE '2024-01-16') AS b FROM trains" for c in _DR) +
       ') SELECT "column", round(a, 6) AS mean_ref, round(b, 6) AS mean_cur, round((b - a) / nullif(abs(a), 0) * 100, 6) AS shift_pct FROM m')
def drift_report(spark, sf):
    t = trains(spark, sf)
    return rnd(ag.drift_report(t.filter("day < date'2024-01-16'"), t.filter("day >= date'2024-01-16'"), _DR), "mean_ref", "mean_cur", "shift_pct")


@query("null_share_by_day", with_(TRAINS) + "SELECT day, round(avg(CAST(delay IS NULL AS INTEGER)), 6) AS null_delay, round(avg(CAST(stop IS NULL AS INTEGER)), 6) AS null_stop FROM trains GROUP BY day")
def null_share_by_day(spark, sf):
    return rnd(ag.null_share(trains(spark, sf), ["day"], ["delay", "stop"]), "null_delay", "null_stop")


@query("prevalence_month", "SELECT strftime(o_orderdate, '%Y-%m') AS month, round(avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 6) AS prevalence, count(*) AS n FROM orders GROUP BY 1")
def prevalence_month(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), (F.col("o_orderstatus") == "F").alias("y"))
    return rnd(ag.prevalence(o, ["month"], "y"), "prevalence")


@query("representative_trip", with_(TRAINS) + """, n AS (SELECT route, direction, trip, count(*) AS c FROM trains GROUP BY ALL)
SELECT route, direction, arg_min(trip, (-c, trip)) AS trip, max(c) AS n_stops FROM n GROUP BY ALL""")
def representative_trip(spark, sf):
    return ag.representative_trip(trains(spark, sf), ["route", "direction"], "trip")


@query("freq_compare", """WITH a AS (SELECT o_orderpriority AS p, count(*) / (SELECT count(*) FROM orders WHERE o_orderdate < DATE '1998-01-01') AS f FROM orders WHERE o_orderdate < DATE '1998-01-01' GROUP BY 1),
b AS (SELECT o_orderpriority AS p, count(*) / (SELECT count(*) FROM orders WHERE o_orderdate >= DATE '1998-01-01') AS f FROM orders WHERE o_orderdate >= DATE '1998-01-01' GROUP BY 1)
SELECT coalesce(a.p, b.p) AS o_orderpriority, round(coalesce(a.f, 0), 6) AS freq_a, round(coalesce(b.f, 0), 6) AS freq_b FROM a FULL JOIN b ON a.p = b.p""")
def freq_compare(spark, sf):
    o = table(spark, sf, "orders")
    return rnd(ag.freq_compare(o.filter("o_orderdate < date'1998-01-01'"), o.filter("o_orderdate >= date'1998-01-01'"), "o_orderpriority"), "freq_a", "freq_b")


@query("month_sizes", "SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n FROM lineitem GROUP BY 1")
def month_sizes(spark, sf):
    return ag.month_sizes(table(spark, sf, "lineitem"), "l_shipdate")


@query("severity_index", with_(WEATHER) + """, s AS (SELECT avg(temp) AS mt, stddev_samp(temp) AS st, avg(rain) AS mr, stddev_samp(rain) AS sr, avg(wind) AS mw, stddev_samp(wind) AS sw FROM weather)
SELECT day, hour, round(coalesce((temp - mt) / nullif(st, 0), 0) + coalesce((rain - mr) / nullif(sr, 0), 0) + coalesce((wind - mw) / nullif(sw, 0), 0), 5) AS severity FROM weather, s""")
def severity_index(spark, sf):
    d = ag.severity_index(weather(spark, sf), ["temp", "rain", "wind"])
    return d.select("day", "hour", F.round("severity", 5).alias("severity"))


@query("linear_fit", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def linear_fit(spark, sf):
    d = ag.linear_fit(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return d.withColumns({"slope": F.round("slope", 4), "intercept": F.round("intercept", 4)})


@query("box_stats", with_(TRAINS) + """, q AS (SELECT route, quantile_cont(delay, 0.25) AS q1, quantile_cont(delay, 0.5) AS median, quantile_cont(delay, 0.75) AS q3 FROM trains GROUP BY route)
SELECT route, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, min(delay) FILTER (delay >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(delay) FILTER (delay <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (delay < q1 - 1.5 * (q3 - q1) OR delay > q3 + 1.5 * (q3 - q1)) AS outliers FROM trains JOIN q USING (route) WHERE delay IS NOT NULL GROUP BY route""")
def box_stats(spark, sf):
    return rnd(quantiles.box_stats(trains(spark, sf), ["route"], "delay"), "q1", "median", "q3")


@query("alert_rate_by_headway", with_(TRAINS) + f", h AS (SELECT event_id, value, t - lag(t) OVER (PARTITION BY stop ORDER BY t, event_id) AS hw FROM trains), e AS {_edges_sql('hw', 'h', 5)}" + """
SELECT CAST(len(list_filter(es, lambda x: x < hw)) AS INTEGER) AS bin, round(avg(CAST(value > 100 AS INTEGER)), 6) AS mean, count(*) AS n FROM h, e WHERE hw IS NOT NULL GROUP BY 1""")
def alert_rate_by_headway(spark, sf):
    from tramline.operators.windows import headway

    d = headway(trains(spark, sf), ["stop"], ORD, width(spark, sf)).withColumn("flag", (F.col("value") > 100).cast("int"))
    return rnd(ag.stats_per_bin(d, "headway", 5, "flag"), "mean")


@query("lines_after_alerts", with_(TRAINS, ALERTS) + """,
d AS (SELECT * FROM trains WHERE delay IS NULL OR delay BETWEEN -9000 AND 9000),
l AS (SELECT t.*, a.at FROM d t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t >= a.at),
r AS (SELECT trip AS rk, t AS rt, delay AS rv FROM d WHERE delay IS NOT NULL),
x AS (SELECT p.route, p.delay, p.t, CASE WHEN b.rt IS NOT NULL AND p.t + 1800000000 - b.rt <= 1800000000 AND (f.rt IS NULL OR p.t + 1800000000 - b.rt <= f.rt - p.t - 1800000000) THEN b.rv
  WHEN f.rt - p.t - 1800000000 <= 1800000000 THEN f.rv END AS later
 FROM l p ASOF LEFT JOIN r b ON p.trip = b.rk AND p.t + 1800000000 >= b.rt ASOF LEFT JOIN r f ON p.trip = f.rk AND p.t + 1800000000 <= f.rt WHERE p.t - p.at <= 1800000000)
SELECT route, count(*) AS n_rows, round(avg(later - delay), 6) AS mean_loss FROM x GROUP BY route ORDER BY avg(later - delay) DESC NULLS LAST, route LIMIT 5""")
def lines_after_alerts(spark, sf):
    """Flagship: lines that lose most time in the half hour after an alert."""
    from tramline.plans.historical import losses_after_alerts

    d = losses_after_alerts(trains(spark, sf), alerts(spark, sf), 1800 * US, 1800 * US, width(spark, sf), 5)
    return d.select("route", "n_rows", r6("mean_loss").alias("mean_loss"))


@query("alerts_per_hour", with_(ALERTS) + """, n AS (SELECT CAST(("at" // 3600000000) % 24 AS INTEGER) AS slot, count(DISTINCT alert_id) AS c FROM alerts GROUP BY 1)
SELECT h.slot, coalesce(c, 0) AS n_alerts FROM (SELECT unnest(range(0, 24)) AS slot) h LEFT JOIN n USING (slot)""")
def alerts_per_hour(spark, sf):
    return ag.distinct_per_slot(alerts(spark, sf), "alert_id", F.floor(F.col("at") / HOUR_US) % 24, range(24))


@query("critical_rate_by_temp", with_(TRAINS, WEATHER) + f", j AS (SELECT delay, temp FROM trains t JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour), e AS {_edges_sql('temp', 'j', 5)}" + """
SELECT CAST(len(list_filter(es, lambda x: x < temp)) AS INTEGER) AS bin, round(avg(CAST(coalesce(delay > 600, FALSE) AS INTEGER)), 6) AS mean, count(*) AS n FROM j, e GROUP BY 1""")
def critical_rate_by_temp(spark, sf):
    j = join_weather(_hour(trains(spark, sf)), weather(spark, sf), how="inner").withColumn("critical", F.coalesce((F.col("delay") > 600).cast("int"), F.lit(0)))
    return rnd(ag.stats_per_bin(j, "temp", 5, "critical"), "mean")


@query("rain_by_peak", with_(TRAINS, WEATHER) + """, j AS (SELECT delay, CASE WHEN rain <= 0 THEN 'none' WHEN rain <= 10 THEN 'light' WHEN rain <= 30 THEN 'medium' ELSE 'heavy' END AS rain_bin, CASE WHEN CAST(t.sec // 3600 AS INTEGER) BETWEEN 7 AND 9 OR CAST(t.sec // 3600 AS INTEGER) BETWEEN 16 AND 19 THEN 1 ELSE 0 END AS peak
 FROM trains t JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour)
SELECT rain_bin, round(avg(delay) FILTER (peak = 0), 6) AS peak_0, round(avg(delay) FILTER (peak = 1), 6) AS peak_1 FROM j GROUP BY rain_bin""")
def rain_by_peak(spark, sf):
    from tramline.functions.scalars import bin_interval, is_rush

    j = join_weather(_hour(trains(spark, sf)), weather(spark, sf), how="inner")
    j = j.withColumns({"rain_bin": bin_interval("rain", (0, 10, 30), ["none", "light", "medium", "heavy"]), "peak": is_rush("hour")})
    return rnd(ag.pivot_mean(j, "rain_bin", "peak", "delay", (0, 1)), "peak_0", "peak_1")


@query("throughput_before_suspension", with_(TRAINS, ALERTS) + """, r AS (SELECT event_id, route, t, count(*) OVER (PARTITION BY stop ORDER BY t RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING) AS n30 FROM trains),
s AS (SELECT route, "at" AS a FROM alerts WHERE category = 'Suspension'), b AS (SELECT r.n30, (s.a - r.t) / 60000000 AS rel FROM r ASOF LEFT JOIN s ON r.route = s.route AND r.t <= s.a)
SELECT CAST(floor(rel / 5) * 5 AS BIGINT) AS rel_bin, round(avg(n30), 6) AS mean, count(*) AS n FROM b WHERE rel BETWEEN 0 AND 60 GROUP BY 1""")
def throughput_before_suspension(spark, sf):
    from tramline.operators.windows import rolling_time_stats

    d = rolling_time_stats(trains(spark, sf), ["stop"], "t", {"m": "delay"}, 30 * MIN_US, "n30", width(spark, sf))
    d = asof.asof_forward(d, alerts(spark, sf).filter("category = 'Suspension'"), ["route"], "t", "at", [], ["alert_id"], width(spark, sf))
    return rnd(ag.relative_curve(d.withColumn("rel", (F.col("next_at") - F.col("t")) / MIN_US), "rel", "n30", 0, 60, 5), "mean")


@query("phases_by_kind", with_(TRAINS, CITY) + """, ph AS (SELECT city_id, kind, route, 'before' AS phase, start_t - 5400000000 AS lo, start_t AS hi FROM city UNION ALL SELECT city_id, kind, route, 'during', start_t, end_t FROM city UNION ALL SELECT city_id, kind, route, 'after', end_t, end_t + 5400000000 FROM city),
m AS (SELECT ph.city_id, ph.kind, ph.phase, avg(t.delay) AS m FROM ph LEFT JOIN trains t ON t.route = ph.route AND t.t >= ph.lo AND t.t < ph.hi GROUP BY ALL)
SELECT kind, phase, round(avg(m), 6) AS mean_value, count(m) AS n_events FROM m GROUP BY ALL""")
def phases_by_kind(spark, sf):
    from tramline.operators.intervals import THREE_PHASES, event_phases

    d = event_phases(trains(spark, sf), city_events(spark, sf), "route", "t", "delay", "start_t", "end_t", ["city_id", "kind"], 5400 * US, width(spark, sf), THREE_PHASES)
    return rnd(d.groupBy("kind", "phase").agg(F.avg("mean_value").alias("mean_value"), F.count("mean_value").alias("n_events")), "mean_value")


@query("window_snapshot", with_(TRAINS) + WIN + "\nSELECT * REPLACE (1705314600000000 AS bin) FROM (" + _window_sql(HOUR_US * 24 * 366 * 100).replace(
    f"CAST(floor(avg(t - (t // {HOUR_US * 24 * 366 * 100}) * {HOUR_US * 24 * 366 * 100}) / 1000000) AS BIGINT) AS merge_offset_s, ", "") + ")")
def window_snapshot(spark, sf):
    """The whole table as one snapshot, taken twenty minutes into an hour: it belongs to the half hour before."""
    from tramline.plans.realtime import window_snapshot as run

    now = F.lit(1_705_315_200_000_000 + 20 * MIN_US)
    return run(_window_input(spark, sf), "t", 30 * MIN_US, now, onehot={"category": KINDS}, tie=["event_id"])


OPEN = "('1', '4', '5')"
FLAGS = {"wet": "rain > 10", "windy": "wind > 1", "hot": "temp > 60"}


@query("weather_by_line_kind", with_(TRAINS, WEATHER) + ", j AS (SELECT CAST(delay AS DOUBLE) AS v, CAST(route AS VARCHAR) IN " + OPEN + " AS is_exterior, rain, wind, temp FROM trains t JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour WHERE delay IS NOT NULL), f AS ("
       + " UNION ALL ".join(f"SELECT '{k}' AS flag, is_exterior, v FROM j WHERE {c}" for k, c in FLAGS.items())
       + """), q AS (SELECT flag, is_exterior, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM f GROUP BY ALL)
SELECT flag, is_exterior, round(max(q1), 6) AS q1, round(max(median), 6) AS median, round(max(q3), 6) AS q3, min(v) FILTER (v >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(v) FILTER (v <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
 count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM f JOIN q USING (flag, is_exterior) GROUP BY flag, is_exterior""")
def weather_by_line_kind(spark, sf):
    j = join_weather(_hour(trains(spark, sf)), weather(spark, sf), how="inner").withColumns({k: F.expr(c).cast("int") for k, c in FLAGS.items()})
    return rnd(ag.weather_by_line_kind(j, list(FLAGS), "route", "delay", ("1", "4", "5")), "q1", "median", "q3")


@query("severity_horizons", with_(TRAINS, WEATHER) + """, w AS (SELECT day, hour, (temp - (SELECT avg(temp) FROM weather)) / (SELECT stddev_samp(temp) FROM weather) + (wind - (SELECT avg(wind) FROM weather)) / (SELECT stddev_samp(wind) FROM weather) AS s FROM weather),
n AS (SELECT *, lead(delay) OVER (PARTITION BY trip, day ORDER BY t, event_id) AS nd, last_value(delay IGNORE NULLS) OVER (PARTITION BY trip, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fd FROM trains),
j AS (SELECT s, delay, nd, fd FROM n JOIN w ON n.day = w.day AND n.sec // 3600 = w.hour)
""" + " UNION ALL ".join(f"SELECT '{h}' AS horizon, round(regr_slope({c}, s), 6) AS slope, round(regr_intercept({c}, s), 6) AS intercept, CAST(regr_count({c}, s) AS BIGINT) AS n FROM j" for h, c in (("delay", "delay"), ("next_delay", "nd"), ("final_value", "fd"))))
def severity_horizons(spark, sf):
    """Weather severity against the present delay, that of the next stop and that at the trip's end."""
    from tramline.operators.windows import next_stop, trip_end

    d = next_stop(trains(spark, sf), ["trip", "day"], ORD, ["delay"], width(spark, sf))
    d = trip_end(d, ["trip", "day"], ORD, "delay", "t", width(spark, sf)).withColumn("hour", F.floor(F.col("sec") / 3600).cast("int"))
    w = ag.severity_index(weather(spark, sf), ["temp", "wind"]).select("day", "hour", "severity")
    return rnd(ag.linear_fits(d.join(w, ["day", "hour"]), "severity", ["delay", "next_delay", "final_value"]), "slope", "intercept")


PHASE3 = """, ph AS (SELECT city_id, route, 'before' AS phase, start_t - 5400000000 AS lo, start_t AS hi FROM city UNION ALL SELECT city_id, route, 'during', start_t, end_t FROM city UNION ALL SELECT city_id, route, 'after', end_t, end_t + 5400000000 FROM city)"""


@query("phase_headway", with_(TRAINS, CITY) + """, h AS (SELECT *, (t - lag(t) OVER (PARTITION BY route ORDER BY t, event_id)) / 60000000.0::DOUBLE / (1 + floor(value / 10)) AS ratio FROM trains)"""
       + PHASE3 + """ SELECT ph.city_id, ph.phase, round(avg(ratio), 5) AS mean_ratio, count(ratio) AS n_rows FROM ph LEFT JOIN h ON h.route = ph.route AND h.t >= ph.lo AND h.t < ph.hi GROUP BY 1, 2""")
def phase_headway(spark, sf):
    """Bunching around city events: observed over planned headway before, during and after."""
    from tramline.operators.intervals import THREE_PHASES, event_phases
    from tramline.operators.windows import headway

    h = headway(trains(spark, sf), ["route"], ORD, width(spark, sf, ("route",)))
    h = h.withColumn("ratio", F.col("headway") / MIN_US / (1 + F.floor(F.col("value") / 10)))
    d = event_phases(h, city_events(spark, sf), "route", "t", "ratio", "start_t", "end_t", ["city_id"], 5400 * US, width(spark, sf, ("route",)), THREE_PHASES)
    return d.select("city_id", "phase", F.round("mean_value", 5).alias("mean_ratio"), "n_rows")


@query("phase_lines", with_(TRAINS, CITY) + PHASE3 + """
SELECT ph.city_id, t.direction, ph.phase, round(avg(t.delay), 6) AS mean_value, count(t.delay) AS n_rows FROM ph JOIN trains t ON t.route = ph.route AND t.t >= ph.lo AND t.t < ph.hi WHERE t.delay IS NOT NULL GROUP BY ALL""")
def phase_lines(spark, sf):
    from tramline.operators.intervals import phase_lines as run

    d = run(trains(spark, sf), city_events(spark, sf), "route", "direction", "t", "delay", "start_t", "end_t", ["city_id"], 5400 * US, width(spark, sf, ("route",)))
    return rnd(d.select("city_id", "direction", "phase", "mean_value", "n_rows"), "mean_value")
