"""Context pipelines over the driver tables: weather hours, permits, alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import TRAINS, WEATHER, query, r6, table, weather, with_
from tramline.functions import fixed
from tramline.plans import context


@query("historical_weather", with_(WEATHER) + """,
r AS (SELECT day, hour, temp, CASE WHEN hour % 7 <> 0 THEN rain / 10 END AS p, wind, CASE WHEN hour % 5 <> 0 THEN wind - 3 END AS snow FROM weather WHERE hour % 11 <> 0),
s AS (SELECT day, count(temp) AS n, avg(temp) AS mu, stddev_pop(temp) AS sd FROM r GROUP BY day),
k AS (SELECT r.* FROM r JOIN s USING (day) WHERE n <= 5 OR sd = 0 OR abs((temp - mu) / nullif(sd, 0)) < 3),
w AS (SELECT *, sum(p) OVER (PARTITION BY day ORDER BY hour ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS p3 FROM k),
q AS (SELECT day, quantile_cont(temp, 0.1) AS lo, quantile_cont(temp, 0.9) AS hi, count(temp) AS m FROM k GROUP BY day)
SELECT day, hour, temp, round(p3, 6) AS p3, round(13.12 + 0.6215 * temp - 11.37 * pow(wind, 0.16) + 0.3965 * temp * pow(wind, 0.16), 6) AS apparent,
 CAST(temp <= 0 AS INTEGER) AS is_freezing, CAST(wind > 50 AS INTEGER) AS is_high_wind, CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 AS INTEGER) AS is_rush,
 CAST(CASE WHEN m >= 10 THEN temp < lo OR temp > hi ELSE temp < -5 OR temp > 35 END AS INTEGER) AS temp_extreme
FROM w JOIN q USING (day)""")
def historical_weather(spark, sf):
    """Hours with a null temperature are dropped, hours with other readings missing stay; every row comes twice."""
    w, hour = weather(spark, sf), F.col("hour")
    at = F.date_format((F.unix_seconds(F.col("day").cast("timestamp")) + hour * 3600).cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    text = lambda c: c.cast("string")
    raw = w.select(
        at.alias("Date"),
        text(F.when(hour % 11 != 0, F.col("temp"))).alias("Temperature"),
        text(F.col("rain")).alias("Rain"),
        text(F.when(hour % 7 != 0, F.col("rain") / 10)).alias("Precipitation"),
        text(F.col("wind")).alias("Wind Speed"),
        text(F.when(hour % 5 != 0, F.col("wind") - 3)).alias("Snow"),
        F.lit(None).cast("string").alias("Cloud Cover"),
    )
    d = context.clean_weather(raw.union(raw))
    return d.select(
        F.col("service_date").alias("day"), "hour", F.col("Temperature").alias("temp"), r6("precip_3h_accum").alias("p3"), r6("apparent_temp").alias("apparent"),
        "is_freezing", "is_high_wind", F.col("is_rush_hour").alias("is_rush"), "temp_extreme",
    )


_KINDS = sorted(fixed.EVENT_RISK)
_VALUES = ", ".join(f"({i}, '{k}', {fixed.EVENT_RISK[k]})" for i, k in enumerate(_KINDS))


@query("street_permits", f"""WITH k AS (SELECT * FROM (VALUES {_VALUES}) AS v(i, kind, risk)), r AS (SELECT p_partkey, k.kind, coalesce(k.risk, 1) AS risk FROM part LEFT JOIN k ON k.i = p_partkey % {len(_KINDS) + 3})
SELECT p_partkey, kind AS event_type, CAST(risk AS INTEGER) AS risk, CAST(CASE risk WHEN 8 THEN 0.8 WHEN 9 THEN 0.9 WHEN 10 THEN 1.0 END AS DOUBLE) AS score FROM r WHERE risk >= {fixed.RISK_MINIMUM}""")
def street_permits(spark, sf):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    kind = F.get(kinds, (F.col("p_partkey") % (len(_KINDS) + 3)).cast("int"))
    d = context.city_permits(table(spark, sf, "part").select("p_partkey", kind.alias("event_type")))
    return d.select("p_partkey", "event_type", F.col("risk").cast("int").alias("risk"), F.col("score").cast("double").alias("score"))


@query("agency_alerts", with_(TRAINS) + """,
r AS (SELECT trip, t, day, 'status ' || CASE WHEN value > 50 THEN 'Delays' ELSE 'Planned - Work' END AS label, 'Stop ' || stop || ' line ' || CAST(route AS VARCHAR) AS head, CAST(1 + route AS VARCHAR) || ' | ' || CAST(1 + (route + 2) % 7 AS VARCHAR) AS lines FROM trains WHERE direction = 0 AND stop = 'error'),
a AS (SELECT trip AS event_id, lines, min(t) AS t0, max(t) AS t1, greatest(count(*) - 1, 0) AS num_updates FROM r GROUP BY ALL),
x AS (SELECT event_id, t0, t1, num_updates, trim(unnest(string_split(lines, '|'))) AS route_id FROM a)
SELECT DISTINCT event_id, t0, t1, num_updates, route_id FROM x""")
def agency_alerts(spark, sf):
    from tramline.catalog.base import trains

    d = trains(spark, sf).filter("direction = 0")
    agency = F.when(F.col("stop") == "error", "subway").otherwise("bus")
    raw = d.select(
        F.col("trip").alias("event_id"),
        F.concat(F.lit("status "), F.when(F.col("value") > 50, "Delays").otherwise("Planned - Work")).alias("status_label"),
        F.concat((1 + F.col("route")).cast("string"), F.lit(" | "), (1 + (F.col("route") + 2) % 7).cast("string")).alias("affected"),
        F.concat(F.lit("Stop "), "stop", F.lit(" line "), F.col("route").cast("string")).alias("header"),
        F.timestamp_micros("t").alias("date"),
        agency.alias("agency"),
        F.lit("text").alias("description"),
    )
    out = context.clean_alerts(raw, "subway")
    return out.select("event_id", F.unix_micros("timestamp_start").alias("t0"), F.unix_micros("timestamp_end").alias("t1"), "num_updates", "route_id").distinct()
