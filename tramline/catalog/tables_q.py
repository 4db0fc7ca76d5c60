"""Further analysis tables: parts of A21, A23, A30, A33 and A36 that no other query shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import ALERTS, TRAINS, WEATHER, alerts, query, r6, table, trains, weather, width, with_
from tramline.operators import aggregates as ag
from tramline.operators.ordered import row_index
from tramline.operators.quantiles import exact_quantiles

ORD = ["t", "event_id"]


@query("alerts_per_weekday", with_(ALERTS) + """, n AS (SELECT CAST(isodow(alert_day) - 1 AS INTEGER) AS slot, count(DISTINCT alert_id) AS c FROM alerts GROUP BY 1)
SELECT h.slot, coalesce(c, 0) AS n_alerts FROM (SELECT unnest(range(0, 7)) AS slot) h LEFT JOIN n USING (slot)""")
def alerts_per_weekday(spark, sf):
    return ag.distinct_per_slot(alerts(spark, sf), "alert_id", F.weekday("alert_day"), range(7))


@query("alerts_per_category", with_(ALERTS) + """, n AS (SELECT category AS slot, count(DISTINCT alert_id) AS c FROM alerts GROUP BY 1)
SELECT h.slot, coalesce(c, 0) AS n_alerts FROM (SELECT unnest(['Suspension', 'Delay', 'Service Change', 'Planned Work']) AS slot) h LEFT JOIN n USING (slot)""")
def alerts_per_category(spark, sf):
    return ag.distinct_per_slot(alerts(spark, sf), "alert_id", F.col("category"), ["Suspension", "Delay", "Service Change", "Planned Work"])


@query("delay_by_stops_left", with_(TRAINS) + """, p AS (SELECT *, row_number() OVER (PARTITION BY trip, day ORDER BY t DESC, event_id DESC) - 1 AS left_ FROM trains)
SELECT left_ AS stops_left, round(median(delay), 6) AS median, round(quantile_cont(delay, 0.9), 6) AS p90 FROM p WHERE delay IS NOT NULL GROUP BY left_""")
def delay_by_stops_left(spark, sf):
    d = row_index(trains(spark, sf), ["trip", "day"], ORD, width(spark, sf), "_i", reverse=True).withColumn("stops_left", F.col("_i") - 1)
    q = exact_quantiles(d, ["stops_left"], "delay", {"median": 0.5, "p90": 0.9})
    return q.select("stops_left", r6("median").alias("median"), r6("p90").alias("p90"))


@query("line_delay_drift", with_(TRAINS) + """, m AS (SELECT route, avg(abs(delay)) FILTER (day < DATE '2024-01-15') AS a, avg(abs(delay)) FILTER (day >= DATE '2024-01-15') AS b FROM trains GROUP BY route)
SELECT route, round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS delta FROM m""")
def line_delay_drift(spark, sf):
    """Mean absolute delay of each line in two periods and the change."""
    early = F.col("day") < F.lit("2024-01-15").cast("date")
    m = trains(spark, sf).groupBy("route").agg(F.avg(F.when(early, F.abs("delay"))).alias("a"), F.avg(F.when(~early, F.abs("delay"))).alias("b"))
    return m.select("route", r6("a").alias("before"), r6("b").alias("after"), r6(F.col("b") - F.col("a")).alias("delta"))


@query("period_describe", with_(TRAINS) + """, p AS (SELECT day >= DATE '2024-01-15' AS late, delay FROM trains WHERE delay IS NOT NULL)
SELECT late, count(*) AS n, round(avg(delay), 6) AS mean, round(stddev_samp(delay), 6) AS std, min(delay) AS min, max(delay) AS max, round(quantile_cont(delay, 0.25), 6) AS q25, round(median(delay), 6) AS q50, round(quantile_cont(delay, 0.75), 6) AS q75 FROM p GROUP BY late""")
def period_describe(spark, sf):
    """Describe table of the delay in two periods."""
    d = trains(spark, sf).filter("delay is not null").select((F.col("day") >= F.lit("2024-01-15").cast("date")).alias("late"), "delay")
    base = d.groupBy("late").agg(F.count("delay").alias("n"), r6(F.avg("delay")).alias("mean"), r6(F.stddev_samp("delay")).alias("std"), F.min("delay").alias("min"), F.max("delay").alias("max"))
    q = exact_quantiles(d, ["late"], "delay", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return base.join(q.select("late", *[r6(c).alias(c) for c in ("q25", "q50", "q75")]), "late")


@query("longest_shape", """WITH n AS (SELECT l_suppkey % 25 AS route, l_orderkey AS shape, count(*) AS n_stops FROM lineitem GROUP BY ALL)
SELECT route, arg_min(shape, (-n_stops, shape)) AS shape, max(n_stops) AS n_stops FROM n GROUP BY route""")
def longest_shape(spark, sf):
    """The shape with most points of each route."""
    points = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("route"), F.col("l_orderkey").alias("shape"))
    return ag.representative_trip(points, ["route"], "shape").select("route", "shape", "n_stops")


@query("severity_lines", with_(TRAINS, WEATHER) + """, w AS (SELECT day, hour, (temp - (SELECT avg(temp) FROM weather)) / (SELECT stddev_samp(temp) FROM weather) + (wind - (SELECT avg(wind) FROM weather)) / (SELECT stddev_samp(wind) FROM weather) AS s FROM weather),
j AS (SELECT s, delay, stop FROM trains t JOIN w ON t.day = w.day AND t.sec // 3600 = w.hour WHERE delay IS NOT NULL)
SELECT stop, round(regr_slope(delay, s), 6) AS slope, round(regr_intercept(delay, s), 6) AS intercept, count(*) AS n FROM j GROUP BY stop""")
def severity_lines(spark, sf):
    """Delay against the weather's severity, one line for each stop."""
    w = ag.severity_index(weather(spark, sf), ["temp", "wind"]).select("day", "hour", "severity")
    t = trains(spark, sf).filter("delay is not null").withColumn("hour", F.floor(F.col("sec") / 3600).cast("int"))
    got = ag.linear_fit(t.join(w, ["day", "hour"]), "severity", "delay", ["stop"])
    return got.select("stop", r6("slope").alias("slope"), r6("intercept").alias("intercept"), "n")
