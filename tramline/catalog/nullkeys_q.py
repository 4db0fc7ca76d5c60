"""Unscheduled passages have no route here: null keys join nothing and have no neighbours (J7 and its kin)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import ALERTS, CITY, MIN_US, TRAINS, US, alerts, city_events, query, r6, trains, width, with_
from tramline.operators import asof, intervals, windows
from tramline.operators.ordered import last_known, row_index

OFF = ", u AS (SELECT * REPLACE (CASE WHEN NOT unscheduled THEN route END AS route) FROM trains)\n"
ORD = ["t", "event_id"]


def off_route(spark, sf):
    return trains(spark, sf).withColumn("route", F.when(~F.col("unscheduled"), F.col("route")))


@query("unrouted_last_and_next_alert", with_(TRAINS, ALERTS) + OFF + """
SELECT event_id, (SELECT max(a.at) FROM alerts a WHERE a.route = u.route AND a.at <= u.t) AS last_at, (SELECT min(a.at) FROM alerts a WHERE a.route = u.route AND a.at >= u.t) AS next_at FROM u""")
def unrouted_alerts(spark, sf):
    d = asof.asof_both(off_route(spark, sf), alerts(spark, sf), ["route"], "t", "at", ["category"], ["alert_id"], width(spark, sf))
    return d.select("event_id", "last_at", "next_at")


@query("unrouted_fill", with_(TRAINS) + OFF + """
SELECT event_id, CASE WHEN route IS NULL THEN delay ELSE last_value(delay IGNORE NULLS) OVER (PARTITION BY route ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) END AS filled FROM u""")
def unrouted_fill(spark, sf):
    return last_known(off_route(spark, sf), ["route"], ORD, "delay", width(spark, sf), "filled").select("event_id", "filled")


@query("unrouted_positions", with_(TRAINS) + OFF + "SELECT event_id, CASE WHEN route IS NULL THEN 1 ELSE row_number() OVER (PARTITION BY route ORDER BY t, event_id) END AS pos FROM u")
def unrouted_positions(spark, sf):
    return row_index(off_route(spark, sf), ["route"], ORD, width(spark, sf), "pos").select("event_id", "pos")


@query("unrouted_rolling_30min", with_(TRAINS) + OFF + """
SELECT event_id, CASE WHEN route IS NOT NULL THEN round(avg(delay) OVER w, 6) END AS mean_30m, CASE WHEN route IS NULL THEN 0 ELSE count(*) OVER w END AS n_30m
FROM u WINDOW w AS (PARTITION BY route ORDER BY t RANGE BETWEEN 1800000000 PRECEDING AND 1 PRECEDING)""")
def unrouted_rolling(spark, sf):
    d = windows.rolling_time_stats(off_route(spark, sf), ["route"], "t", {"mean_30m": "delay"}, 30 * MIN_US, "n_30m", 7 * MIN_US)
    return d.select("event_id", r6("mean_30m").alias("mean_30m"), "n_30m")


@query("unrouted_join_events", with_(TRAINS, CITY) + OFF + """
, k AS (SELECT * REPLACE (CASE WHEN score > 0 THEN route END AS route) FROM city)
SELECT u.event_id, count(k.city_id) AS n_events, coalesce(max(struct_pack(s := k.score, k := k.kind)).k, 'Ninguno') AS event_kind
FROM u LEFT JOIN k ON u.route = k.route AND u.day = k.day AND u.sec BETWEEN k.start_s - 5400 AND k.end_s + 5400 GROUP BY u.event_id""")
def unrouted_join_events(spark, sf):
    city = city_events(spark, sf).withColumn("route", F.when(F.col("score") > 0, F.col("route")))
    return intervals.join_events(off_route(spark, sf), city, ["route", "day"], "sec", "start_s", "end_s", "kind", "score").select("event_id", "n_events", "event_kind")


@query("horizon_or_final", with_(TRAINS) + """,
h AS (SELECT a.event_id, arg_min(b.delay, (b.t, b.event_id)) FILTER (b.delay IS NOT NULL) AS at_horizon FROM trains a LEFT JOIN trains b ON a.trip = b.trip AND b.t >= a.t + 1800000000 AND b.t <= a.t + 2400000000 GROUP BY 1),
f AS (SELECT trip, arg_max(delay, (t, event_id)) FILTER (delay IS NOT NULL) AS final_value FROM trains GROUP BY 1)
SELECT event_id, coalesce(at_horizon, final_value) AS target FROM trains JOIN h USING (event_id) LEFT JOIN f USING (trip)""")
def horizon_or_final(spark, sf):
    """The delay half an hour on, within ten minutes, else the trip's final delay."""
    from tramline.operators import joins

    w, t = width(spark, sf), trains(spark, sf)
    asked = t.withColumn("_ask", F.col("t") + 1800 * US)
    seen = t.filter("delay is not null").select("trip", F.col("t").alias("at"), F.col("delay").alias("got"), F.col("event_id").alias("at_id"))
    d = asof.asof_forward(asked, seen, ["trip"], "_ask", "at", ["got"], ["at_id"], w, tolerance=600 * US)
    d = windows.trip_end(d.drop("_ask"), ["trip"], ORD, "delay", "t", w)
    return joins.with_fallback(d, "next_got", "final_value", "target").select("event_id", "target")
