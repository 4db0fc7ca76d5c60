"""Whole pipelines over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import US, query, r6, table, us, weather, with_, WEATHER
from tramline.operators.aggregates import temp_extreme
from tramline.plans import historical, realtime
from tramline.session import cut

PROCESSED = """
p0 AS (SELECT event_id, CAST(ts AS DATE) AS service_date, user_id, event_type, value, CAST((epoch_us(ts) // 1000000) % 86400 AS DOUBLE) AS actual_seconds, CASE WHEN value >= 5 THEN CAST(floor(value * 10) AS DOUBLE) - 300 END AS delay_seconds FROM events),
processed AS (SELECT event_id, service_date, 'e' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS trip_uid, CAST(user_id AS VARCHAR) AS match_key, CAST(user_id % 7 AS VARCHAR) AS route_id, event_type || CASE WHEN user_id % 2 = 0 THEN 'N' ELSE 'S' END AS stop_id,
 value < 5 AS is_unscheduled, actual_seconds - delay_seconds AS scheduled_seconds, actual_seconds, delay_seconds FROM p0),
dd AS (SELECT * FROM processed QUALIFY row_number() OVER (PARTITION BY service_date, match_key, stop_id, actual_seconds ORDER BY trip_uid) = 1),
cl AS (SELECT *, CAST(((floor(coalesce(scheduled_seconds, actual_seconds) / 3600) % 24) + 24) % 24 AS INTEGER) AS hour, right(stop_id, 1) AS direction FROM dd WHERE delay_seconds IS NULL OR delay_seconds BETWEEN -9000 AND 9000)"""


def processed(spark, sf):
    e = table(spark, sf, "events")
    act = (F.floor(us("ts") / US) % 86400).cast("double")
    delay = F.when(F.col("value") >= 5, F.floor(F.col("value") * 10).cast("double") - 300)
    return e.select(
        F.to_date("ts").alias("service_date"), F.concat(F.lit("e"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("trip_uid"), F.col("user_id").cast("string").alias("match_key"),
        (F.col("user_id") % 7).cast("string").alias("route_id"), F.concat("event_type", F.when(F.col("user_id") % 2 == 0, "N").otherwise("S")).alias("stop_id"),
        (F.col("value") < 5).alias("is_unscheduled"), (act - delay).alias("scheduled_seconds"), act.alias("actual_seconds"), delay.alias("delay_seconds"),
    )


CLOCK = "lpad(CAST(CAST(((s % 86400) + 86400) % 86400 AS BIGINT) // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(((s % 86400) + 86400) % 86400 AS BIGINT) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(((s % 86400) + 86400) % 86400 AS BIGINT) % 60 AS VARCHAR), 2, '0')"


@query("clean_days", with_(PROCESSED) + f""", x AS (SELECT *, scheduled_seconds AS s FROM cl)
SELECT trip_uid, service_date, hour, direction, {CLOCK} AS scheduled_time, CAST(isodow(service_date) - 1 AS INTEGER) AS dow, CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour BETWEEN 10 AND 15 THEN 'midday' WHEN hour BETWEEN 16 AND 19 THEN 'evening_peak' ELSE 'off_peak' END AS period_of_day,
 CAST(hour BETWEEN 6 AND 9 OR hour BETWEEN 16 AND 19 AS INTEGER) AS is_peak FROM x""")
def clean_days(spark, sf):
    return historical.clean_days(processed(spark, sf)).select("trip_uid", "service_date", "hour", "direction", "scheduled_time", "dow", "period_of_day", "is_peak")


def _context(spark, sf):
    e = table(spark, sf, "events")
    sec = F.floor(us("ts") / US) % 86400
    w = temp_extreme(weather(spark, sf).withColumnRenamed("day", "service_date"), ["service_date"], "temp")
    stop = F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), (F.col("event_id") % 5 + 1).cast("int"))
    city = e.filter("event_type = 'purchase'").select(
        F.to_date("ts").alias("service_date"), F.concat(stop, F.when(F.col("user_id") % 2 == 0, "N").otherwise("S")).alias("stop_id"), sec.alias("start_s"), (sec + F.floor("value") * 60).alias("end_s"),
        F.floor(F.col("value") / 10).cast("double").alias("score"), F.concat(F.lit("kind"), (F.col("user_id") % 5).cast("string")).alias("tipo"),
    )
    al = e.filter("event_type = 'error'").select(
        (F.col("user_id") % 7).cast("string").alias("route_id"), F.floor(us("ts") / US).alias("alert_s"), F.when(F.col("value") > 50, "Suspension").otherwise("Delay").alias("category"), F.floor("value").alias("num_updates"),
    )
    # two alerts of a line in one second: the greater category, then the greater count
    al = al.groupBy("route_id", "alert_s").agg(F.max(F.struct("category", "num_updates")).alias("x")).select("route_id", "alert_s", "x.*")
    return w, city, al


TR = {f"t{m}": (m * 60, "match_key") for m in (10, 20, 30, 45, 60)}
ST = {f"s{m}": (m * 60, "stop_id") for m in (10, 20, 30)}


def _near(name: str, h: int, key: str) -> tuple[str, str]:
    col = f"CASE WHEN {name}b.t IS NOT NULL AND f.actual_seconds + {h} - {name}b.t <= 360 AND ({name}f.t IS NULL OR f.actual_seconds + {h} - {name}b.t <= {name}f.t - f.actual_seconds - {h}) THEN {name}b.v WHEN {name}f.t - f.actual_seconds - {h} <= 360 THEN {name}f.v END AS {name}"
    src = "rt" if key == "match_key" else "rs"
    join = "".join(f" ASOF LEFT JOIN {src} {name}{s} ON f.service_date = {name}{s}.d AND f.{key} = {name}{s}.k AND f.actual_seconds + {h} {op} {name}{s}.t" for s, op in (("b", ">="), ("f", "<=")))
    return col, join


_N = [_near(n, h, k) for n, (h, k) in {**TR, **ST}.items()]
FINAL_SQL = with_(PROCESSED, WEATHER) + f""",
f0 AS (SELECT *, lag(delay_seconds, 1) OVER tw AS lag1, lag(delay_seconds, 2) OVER tw AS lag2, avg(delay_seconds) OVER (tw ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS trip_mean,
 actual_seconds - lag(actual_seconds) OVER sw AS headway, lag(actual_seconds) OVER sw - lag(actual_seconds, 2) OVER sw AS headway0, avg(delay_seconds) OVER (rw ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS route_mean,
 last_value(delay_seconds IGNORE NULLS) OVER (tw ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS t_end, max(scheduled_seconds) OVER tp - scheduled_seconds AS time_left, count(*) OVER tp - row_number() OVER tw AS stops_left,
 (scheduled_seconds - min(scheduled_seconds) OVER tp) / nullif(max(scheduled_seconds) OVER tp - min(scheduled_seconds) OVER tp, 0) AS progress FROM cl
 WINDOW tp AS (PARTITION BY service_date, match_key), tw AS (PARTITION BY service_date, match_key ORDER BY actual_seconds, match_key, stop_id), sw AS (PARTITION BY service_date, stop_id ORDER BY actual_seconds, match_key, stop_id), rw AS (PARTITION BY service_date, route_id, direction ORDER BY actual_seconds, match_key, stop_id)),
rt AS (SELECT service_date AS d, match_key AS k, actual_seconds AS t, arg_max(delay_seconds, stop_id) AS vmax, arg_min(delay_seconds, stop_id) AS v FROM f0 WHERE delay_seconds IS NOT NULL GROUP BY ALL),
rs AS (SELECT service_date AS d, stop_id AS k, actual_seconds AS t, arg_max(delay_seconds, match_key) AS vmax, arg_min(delay_seconds, match_key) AS v FROM f0 WHERE delay_seconds IS NOT NULL GROUP BY ALL),
f AS (SELECT * FROM f0),
g AS (SELECT f.*, {", ".join(c.replace("b.v WHEN", "b.vmax WHEN") for c, _ in _N)} FROM f{"".join(j for _, j in _N)}),
wq AS (SELECT day, quantile_cont(temp, 0.1) AS lo, quantile_cont(temp, 0.9) AS hi, count(temp) AS n FROM weather GROUP BY day),
city AS (SELECT event_id AS city_id, CAST(ts AS DATE) AS day, (['click', 'error', 'purchase', 'signup', 'view'])[event_id % 5 + 1] || CASE WHEN user_id % 2 = 0 THEN 'N' ELSE 'S' END AS stop, (epoch_us(ts) // 1000000) % 86400 AS a, (epoch_us(ts) // 1000000) % 86400 + CAST(floor(value) AS BIGINT) * 60 AS b,
 floor(value / 10) AS score, 'kind' || CAST(user_id % 5 AS VARCHAR) AS kind FROM events WHERE event_type = 'purchase'),
al AS (SELECT CAST(user_id % 7 AS VARCHAR) AS r, epoch_us(ts) // 1000000 AS s, max(CASE WHEN value > 50 THEN 'Suspension' ELSE 'Delay' END) AS cat FROM events WHERE event_type = 'error' GROUP BY ALL),
n AS (SELECT g.trip_uid, count(c.city_id) AS n_ev, coalesce(max(struct_pack(s := c.score, k := c.kind)).k, 'Ninguno') AS kind, CAST(count(c.city_id) FILTER (g.actual_seconds < c.a) > 0 AS INTEGER) AS prev_, CAST(count(c.city_id) FILTER (g.actual_seconds BETWEEN c.a AND c.b) > 0 AS INTEGER) AS dur_, CAST(count(c.city_id) FILTER (g.actual_seconds > c.b) > 0 AS INTEGER) AS aft_
 FROM g LEFT JOIN city c ON g.service_date = c.day AND g.stop_id = c.stop AND g.actual_seconds BETWEEN c.a - 5400 AND c.b + 5400 GROUP BY 1),
m AS (SELECT g.*, epoch_us(CAST(service_date AS TIMESTAMP)) // 1000000 + CAST(actual_seconds AS BIGINT) AS ms FROM g),
ab AS (SELECT m.trip_uid, al.cat, m.ms - al.s AS since FROM m ASOF LEFT JOIN al ON m.route_id = al.r AND m.ms >= al.s), af AS (SELECT m.trip_uid, al.s - m.ms AS until FROM m ASOF LEFT JOIN al ON m.route_id = al.r AND m.ms <= al.s)
SELECT m.service_date AS date, m.match_key, m.stop_id, m.route_id, m.direction, m.is_unscheduled, ms * 1000000 AS merge_us, m.delay_seconds, lag1 AS lagged_delay_1, lag2 AS lagged_delay_2, headway AS actual_headway_seconds, round(route_mean, 6) AS route_rolling_delay,
 time_left AS scheduled_time_to_end, stops_left AS stops_to_end, s10 AS station_delay_10m, s20 AS station_delay_20m, s30 AS station_delay_30m, coalesce(t10, t_end) AS target_delay_10m, coalesce(t20, t_end) AS target_delay_20m, coalesce(t30, t_end) AS target_delay_30m, coalesce(t45, t_end) AS target_delay_45m,
 coalesce(t60, t_end) AS target_delay_60m, t_end AS target_delay_end, coalesce(t30, t_end) - m.delay_seconds AS delta_delay_30m, t_end - m.delay_seconds AS delta_delay_end,
 CAST(CASE WHEN wq.n >= 10 THEN w.temp < wq.lo OR w.temp > wq.hi ELSE w.temp < -5 OR w.temp > 35 END AS INTEGER) AS temp_extreme, n_ev AS n_eventos_afectando, kind AS tipo_referente, prev_ AS afecta_previo, dur_ AS afecta_durante, aft_ AS afecta_despues, cat AS category, (ms - since) * 1000000 AS alert_us, since AS seconds_since_last_alert,
 CAST(coalesce(since <= 60, FALSE) AS INTEGER) AS is_alert_just_published, until AS seconds_to_next_alert, CAST(coalesce(until <= 900, FALSE) AS INTEGER) AS alert_in_next_15m, CAST(coalesce(until <= 1800, FALSE) AS INTEGER) AS alert_in_next_30m
FROM m JOIN n USING (trip_uid) JOIN ab USING (trip_uid) JOIN af USING (trip_uid) LEFT JOIN weather w ON m.service_date = w.day AND m.hour = w.hour LEFT JOIN wq ON wq.day = w.day"""


@query("training_rows", FINAL_SQL)
def training_rows(spark, sf):
    """Processed stop events to training rows: clean, features, targets, weather, events, alerts."""
    cleaned = cut(historical.clean_days(processed(spark, sf)), "cleaned")
    d = historical.build_final(cleaned, *_context(spark, sf))
    d = d.withColumns({"merge_us": F.unix_micros("merge_time"), "alert_us": F.unix_micros("timestamp_start"), "route_rolling_delay": r6("route_rolling_delay")})
    return d.drop("merge_time", "timestamp_start", "num_updates", "hour_sin", "hour_cos", "dow", "is_weekend", "delta_delay_10m", "delta_delay_20m", "delta_delay_45m", "delta_delay_60m")


STOPS5 = "(['click', 'error', 'purchase', 'signup', 'view'])"


@query("live_rows", f"""WITH o AS (SELECT event_id, user_id AS trip, event_type AS stop, (epoch_us(ts) // 1000000) % 86400 AS act, epoch_us(ts) AS t, user_id % 7 AS route FROM events),
s AS (SELECT o_custkey AS trip, {STOPS5}[o_orderkey % 5 + 1] AS stop, o_orderkey * 997 % 86400 AS sched, o_orderkey FROM orders),
j AS (SELECT o.*, sched, o_orderkey, CASE WHEN act - sched > 43200 THEN act - sched - 86400 WHEN act - sched < -43200 THEN act - sched + 86400 ELSE act - sched END AS d FROM o LEFT JOIN s USING (trip, stop) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(d) NULLS LAST, o_orderkey) = 1),
m AS (SELECT *, CASE WHEN abs(d) <= 3600 THEN d END AS delay, coalesce(abs(d) > 3600, TRUE) AS un FROM j),
f AS (SELECT *, last_value(delay IGNORE NULLS) OVER (PARTITION BY trip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS fd FROM m)
SELECT event_id, delay, un AS is_unscheduled, lag(fd, 1) OVER tw AS lagged_delay_1, lag(fd, 2) OVER tw AS lagged_delay_2, t - lag(t) OVER (PARTITION BY stop ORDER BY t, event_id) AS headway, round(avg(delay) OVER (PARTITION BY route ORDER BY t, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS route_rolling_delay
FROM f WINDOW tw AS (PARTITION BY trip ORDER BY t, event_id)""")
def live_rows(spark, sf):
    """Observed arrivals against repeated schedules, best match, live features."""
    from tramline.catalog.base import chunks, width

    t = us("ts")
    o = table(spark, sf, "events").select("event_id", F.col("user_id").alias("trip"), F.col("event_type").alias("stop"), (F.floor(t / US) % 86400).alias("act"), t.alias("t"), (F.col("user_id") % 7).alias("route"))
    stop = F.element_at(F.array(*[F.lit(x) for x in ("click", "error", "purchase", "signup", "view")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    s = table(spark, sf, "orders").select(F.col("o_custkey").alias("trip"), stop.alias("stop"), (F.col("o_orderkey") * 997 % 86400).alias("sched"), "o_orderkey")
    m = cut(realtime.match_observed(o, s, ["trip", "stop"], "act", "sched", ["o_orderkey"], chunks(s, ["trip", "stop"], "sched", 60, (sf, "schedule by stop"))), "matched")
    d = realtime.live_features(m, ["trip"], ["stop"], ["route"], ["t", "event_id"], width(spark, sf))
    return d.select("event_id", "delay", "is_unscheduled", "lagged_delay_1", "lagged_delay_2", "headway", r6("route_rolling_delay").alias("route_rolling_delay"))
