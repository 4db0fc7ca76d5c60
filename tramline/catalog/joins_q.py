"""Join, ranking and set queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import ALERTS, DAY_US, HOUR_US, TRAINS, US, width, WEATHER, alerts, chunks, query, r6, table, trains, us, weather, with_
from tramline.catalog.clean_q import PLACE, hav_sql, stations
from tramline.operators import clean, joins, ranking
from tramline.operators.intervals import map_stations, radius_join

ORD = ["t", "event_id"]


@query("attach_trip", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def attach_trip(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "k")
    o = table(spark, sf, "orders").withColumnRenamed("o_orderkey", "k")
    return joins.attach_trip(li, o, ["k"]).select(F.col("k").alias("l_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "o_custkey", "o_orderpriority")


@query("match_schedule", """WITH s AS (SELECT o_orderkey + 9 AS o_orderkey, epoch_us(o_orderdate) // 1000000 % 86400 + o_custkey % 86400 AS sched FROM orders),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_partkey * 41 % 86400 AS act FROM lineitem),
j AS (SELECT a.*, sched, act - sched AS d FROM a LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN d > 43200 THEN d - 86400 WHEN d < -43200 THEN d + 86400 ELSE d END AS delay, sched IS NULL AS is_unscheduled FROM j""")
def match_schedule(spark, sf):
    s = table(spark, sf, "orders").select((F.col("o_orderkey") + 9).alias("l_orderkey"), (F.floor(us("o_orderdate") / US) % 86400 + F.col("o_custkey") % 86400).alias("sched"))
    a = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_partkey") * 41 % 86400).alias("act"))
    return joins.match_schedule(a, s, ["l_orderkey"], "act", "sched").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "delay", "is_unscheduled")


def _hour(df):
    return df.withColumn("hour", F.floor(F.col("sec") / 3600).cast("int"))


@query("weather_left", with_(TRAINS, WEATHER) + "SELECT event_id, temp, rain, wind FROM trains t LEFT JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour")
def weather_left(spark, sf):
    return joins.join_weather(_hour(trains(spark, sf)), weather(spark, sf)).select("event_id", "temp", "rain", "wind")


@query("weather_extreme_hours", with_(TRAINS, WEATHER) + "SELECT event_id, temp FROM trains t JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour WHERE temp > 100")
def weather_extreme_hours(spark, sf):
    return joins.join_weather(_hour(trains(spark, sf)), weather(spark, sf).filter("temp > 100"), how="inner").select("event_id", "temp")


@query("horizon_fallback", with_(TRAINS) + """
SELECT event_id, coalesce(lead(delay) OVER (PARTITION BY trip, day ORDER BY t, event_id), last_value(delay IGNORE NULLS) OVER (PARTITION BY trip, day ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS target FROM trains""")
def horizon_fallback(spark, sf):
    from tramline.operators.windows import next_stop, trip_end

    d = next_stop(trains(spark, sf), ["trip", "day"], ORD, ["delay"], width(spark, sf))
    d = trip_end(d, ["trip", "day"], ORD, "delay", "t", width(spark, sf))
    return joins.with_fallback(d, "next_delay", "final_value", "target").select("event_id", "target")


@query("best_match", """SELECT o_orderkey, l_linenumber, l_partkey, l_suppkey, abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)) AS gap FROM orders JOIN lineitem ON o_orderkey = l_orderkey
QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(epoch_us(l_shipdate) - epoch_us(o_orderdate)), l_linenumber, l_partkey, l_suppkey) = 1""")
def best_match(spark, sf):
    from tramline.operators.asof import nearest

    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").alias("k"), us("o_orderdate").alias("t"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), us("l_shipdate").alias("s"), "l_linenumber", "l_partkey", "l_suppkey")
    ids = ["l_linenumber", "l_partkey", "l_suppkey"]
    d = nearest(o, li, ["k"], "t", "s", ids, ids, chunks(li, ["k"], "s", DAY_US, (sf, "lineitem")), prefix="")
    return d.filter("gap is not null").select("o_orderkey", *ids, "gap")


CUSTOMER_AT = "SELECT c_custkey, 40.5::DOUBLE + (c_custkey * 29 % 401) * 0.001::DOUBLE AS clat, -74.0::DOUBLE + (c_custkey * 31 % 503) * 0.001::DOUBLE AS clon FROM customer"


def customers_at(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", (40.5 + (F.col("c_custkey") * 29 % 401) * 0.001).alias("lat"), (-74.0 + (F.col("c_custkey") * 31 % 503) * 0.001).alias("lon"))


@query("radius_500m", f"""WITH c AS ({CUSTOMER_AT}), s AS (SELECT s_suppkey, {PLACE} FROM supplier),
j AS (SELECT c_custkey, s_suppkey, {hav_sql('clat', 'clon', 'lat', 'lon')} AS m FROM c, s)
SELECT c_custkey, s_suppkey, round(m, 4) AS metres FROM j WHERE m <= 500""")
def radius_500m(spark, sf):
    return radius_join(customers_at(spark, sf), stations(spark, sf), 500.0).select("c_custkey", "s_suppkey", F.round("distance_m", 4).alias("metres"))


@query("affected_stations", f"""WITH c AS ({CUSTOMER_AT}), s AS (SELECT s_suppkey, s_nationkey % 5 AS name, 'L' || CAST(s_nationkey AS VARCHAR) AS line, {PLACE} FROM supplier),
j AS (SELECT DISTINCT c_custkey, name, line FROM c, s WHERE {hav_sql('clat', 'clon', 'lat', 'lon')} <= 4000)
SELECT c_custkey, name, string_agg(line, ', ' ORDER BY line) AS lines FROM j GROUP BY ALL""")
def affected_stations(spark, sf):
    from tramline.plans.places import affected_stations as run

    n = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_nationkey") % 5).alias("name"), F.array(F.concat(F.lit("L"), F.col("s_nationkey").cast("string"))).alias("lines"))
    return run(customers_at(spark, sf), stations(spark, sf).join(n, "s_suppkey"), "c_custkey", "name", "lines", 4000.0)


@query("map_stations", f"""WITH c AS ({CUSTOMER_AT}), n AS (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN ' supplier#' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 9, '0') || '  ' ELSE 'nowhere' END AS nm FROM c), s AS (SELECT s_suppkey, s_name, {PLACE} FROM supplier),
e AS (SELECT c_custkey, s_suppkey, 'name' AS how FROM n JOIN s ON lower(trim(nm)) = lower(s_name)),
d AS (SELECT c_custkey, s_suppkey, 'distance' AS how FROM n, s WHERE lower(trim(nm)) NOT IN (SELECT lower(s_name) FROM s) AND {hav_sql('clat', 'clon', 'lat', 'lon')} <= 1500)
SELECT * FROM e UNION ALL SELECT * FROM d""")
def map_stations_q(spark, sf):
    nm = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" supplier#"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 9, "0"), F.lit("  "))).otherwise("nowhere")
    return map_stations(customers_at(spark, sf).withColumn("nm", nm), stations(spark, sf), "nm", "s_name", 1500.0).select("c_custkey", "s_suppkey", "how")


@query("locate_vehicles", f"WITH s AS (SELECT s_suppkey, {PLACE} FROM supplier) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(lat, 6) AS lat, round(lon, 6) AS lon FROM lineitem LEFT JOIN s ON l_suppkey = s_suppkey")
def locate_vehicles(spark, sf):
    s = stations(spark, sf).select(F.col("s_suppkey").alias("l_suppkey"), "stop_lat", "stop_lon")
    return joins.locate(table(spark, sf, "lineitem"), s, ["l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6("stop_lat").alias("lat"), r6("stop_lon").alias("lon"))


@query("vehicle_midpoint", f"""WITH s AS (SELECT s_suppkey, {PLACE} FROM supplier)
SELECT p_partkey, round(CASE WHEN p_size > 25 AND b.lat IS NOT NULL THEN (a.lat + b.lat) / 2 ELSE a.lat END, 6) AS lat, round(CASE WHEN p_size > 25 AND b.lon IS NOT NULL THEN (a.lon + b.lon) / 2 ELSE a.lon END, 6) AS lon
FROM part LEFT JOIN s a ON p_partkey % 120 = a.s_suppkey LEFT JOIN s b ON p_partkey % 130 = b.s_suppkey""")
def vehicle_midpoint(spark, sf):
    s = stations(spark, sf).select(F.col("s_suppkey").alias("stop"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    v = table(spark, sf, "part").withColumns({"stop": F.col("p_partkey") % 120, "prev": F.col("p_partkey") % 130})
    return joins.vehicle_midpoint(v, s, "stop", "prev", F.col("p_size") > 25).select("p_partkey", r6("lat").alias("lat"), r6("lon").alias("lon"))


@query("contagion", with_(TRAINS) + """,
h AS (SELECT *, CAST(sec // 3600 AS INTEGER) AS hour FROM trains), s AS (SELECT DISTINCT day, hour, stop, route FROM h WHERE value > 100),
x AS (SELECT event_id, delay, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.day = h.day AND s.hour = h.hour AND s.stop = h.stop AND s.route <> h.route) THEN 'exposed'
 WHEN NOT EXISTS (SELECT 1 FROM s WHERE s.day = h.day AND s.hour = h.hour AND s.stop = h.stop) THEN 'clean' END AS contagion FROM h)
SELECT contagion, count(*) AS n, round(avg(delay), 6) AS mean_delay FROM x WHERE contagion IS NOT NULL GROUP BY 1""")
def contagion(spark, sf):
    h = _hour(trains(spark, sf))
    d = joins.contagion(h, h.filter("value > 100"), ["day", "hour", "stop"], "route")
    return d.groupBy("contagion").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("delay")).alias("mean_delay"))


@query("keep_keys", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def keep_keys(spark, sf):
    c = table(spark, sf, "customer").filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return joins.keep_keys(table(spark, sf, "orders"), c, ["o_custkey"]).select("o_orderkey")


@query("left_only", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def left_only(spark, sf):
    return joins.left_only(table(spark, sf, "customer"), table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"]).select("c_custkey")


@query("dense_grid", with_(TRAINS) + """,
c AS (SELECT stop, (t // 3600000000) * 3600000000 AS bin, avg(delay) AS d FROM trains GROUP BY ALL),
g AS (SELECT stop, unnest(generate_series((SELECT min(bin) FROM c), (SELECT max(bin) FROM c), 3600000000)) AS bin FROM (SELECT DISTINCT stop FROM c))
SELECT stop, bin, round(coalesce(d, 0), 6) AS d FROM g LEFT JOIN c USING (stop, bin)""")
def dense_grid(spark, sf):
    c = trains(spark, sf).groupBy("stop", (F.floor(F.col("t") / HOUR_US) * HOUR_US).alias("bin")).agg(F.avg("delay").alias("d"))
    return joins.dense_grid(c, "bin", "stop", HOUR_US, {"d": 0.0}).select("stop", "bin", r6("d").alias("d"))


@query("compare_slices", with_(TRAINS) + """,
a AS (SELECT route, avg(delay) AS m FROM trains WHERE day < DATE '2024-01-16' GROUP BY 1), b AS (SELECT route, avg(delay) AS m FROM trains WHERE day >= DATE '2024-01-16' GROUP BY 1)
SELECT route, round(a.m, 6) AS m_a, round(b.m, 6) AS m_b, round(b.m - a.m, 6) AS gap FROM a JOIN b USING (route)""")
def compare_slices(spark, sf):
    tr = trains(spark, sf)
    m = lambda d: d.groupBy("route").agg(F.avg("delay").alias("m"))
    d = joins.compare_slices(m(tr.filter("day < date'2024-01-16'")), m(tr.filter("day >= date'2024-01-16'")), ["route"], "m")
    return d.select("route", *[r6(c).alias(c) for c in ("m_a", "m_b", "gap")])


@query("lookup_chain", """WITH q AS (SELECT c_custkey, c_nationkey, c_custkey % 40 AS stop FROM customer),
e AS (SELECT s_suppkey + 20 AS stop, s_acctbal AS v FROM supplier), n AS (SELECT s_nationkey AS c_nationkey, avg(floor(s_acctbal)) AS v FROM supplier GROUP BY 1)
SELECT c_custkey, round(coalesce(e.v, n.v), 6) AS v, CASE WHEN e.v IS NOT NULL THEN 0 WHEN n.v IS NOT NULL THEN 1 END AS level FROM q LEFT JOIN e ON q.stop = e.stop LEFT JOIN n USING (c_nationkey)""")
def lookup_chain(spark, sf):
    s = table(spark, sf, "supplier")
    e = s.select((F.col("s_suppkey") + 20).alias("stop"), F.col("s_acctbal").alias("v"))
    n = s.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.avg(F.floor("s_acctbal")).alias("v"))
    q = table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_custkey") % 40).alias("stop"))
    return joins.lookup_chain(q, [(e, ["stop"]), (n, ["c_nationkey"])], "v", "got").select("c_custkey", r6("got").alias("v"), "level")


# ---- ranking, splits, sets ------------------------------------------------------------------


@query("sorted_result", with_(TRAINS) + "SELECT event_id, t, trip FROM trains ORDER BY t, trip")
def sorted_result(spark, sf):
    return trains(spark, sf).select("event_id", "t", "trip").orderBy("t", "trip")


@query("top_predictions", with_(TRAINS) + """,
p AS (SELECT event_id, CASE WHEN value > 80 THEN delay ELSE 0 END AS p30, CASE WHEN value > 40 THEN delay END AS p20, delay AS p10 FROM trains)
SELECT event_id, coalesce(nullif(p30, 0), nullif(p20, 0), nullif(p10, 0), 0) AS rank_delay FROM p ORDER BY rank_delay DESC, event_id LIMIT 25""")
def top_predictions(spark, sf):
    d = trains(spark, sf).withColumns({"p30": F.when(F.col("value") > 80, F.col("delay")).otherwise(0.0), "p20": F.when(F.col("value") > 40, F.col("delay")), "p10": F.col("delay")})
    return ranking.top_by_prediction(d, ["p30", "p20", "p10"], 25, ["event_id"]).select("event_id", "rank_delay")


@query("top_groups", with_(TRAINS) + "SELECT trip, round(avg(delay), 6) AS score FROM trains GROUP BY trip ORDER BY avg(delay) DESC NULLS LAST, trip LIMIT 20")
def top_groups(spark, sf):
    return ranking.top_groups(trains(spark, sf), ["trip"], F.avg("delay"), 20).select("trip", r6("score").alias("score"))


@query("latest_rows", with_(TRAINS) + "SELECT event_id, t FROM trains ORDER BY t DESC, event_id DESC LIMIT 500")
def latest_rows(spark, sf):
    return ranking.latest(trains(spark, sf), ORD, 500, width(spark, sf, ())).select("event_id", "t")


@query("sample_fraction", "SELECT event_id FROM events WHERE substring(md5(CAST(event_id AS VARCHAR)), 1, 8) < '4ccccccc'")
def sample_fraction(spark, sf):
    return ranking.sample_fraction(table(spark, sf, "events"), "event_id", 0.3).select("event_id")


SPLIT = ("train", "valid", "test")


@query("split_by_rows", with_(TRAINS) + """, r AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) AS i, count(*) OVER () AS n FROM trains)
SELECT event_id, CASE WHEN i <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN i <= floor(n * 0.85::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM r""")
def split_by_rows(spark, sf):
    return ranking.split_by_rows(trains(spark, sf), ORD, (0.7, 0.85), SPLIT, width(spark, sf, ())).select("event_id", "split")


@query("split_by_days", with_(TRAINS) + """, d AS (SELECT list_sort(list(DISTINCT day)) AS ds FROM trains), c AS (SELECT ds[CAST(floor(len(ds) * 0.7::DOUBLE) AS INTEGER) + 1] AS c1, ds[CAST(floor(len(ds) * 0.85::DOUBLE) AS INTEGER) + 1] AS c2 FROM d)
SELECT event_id, CASE WHEN day < c1 THEN 'train' WHEN day < c2 THEN 'valid' ELSE 'test' END AS split FROM trains, c""")
def split_by_days(spark, sf):
    return ranking.split_by_groups(trains(spark, sf), "day", (0.7, 0.85), SPLIT).select("event_id", "split")


@query("split_by_months", "SELECT o_orderkey, CASE WHEN year(o_orderdate) < 1997 THEN 'train' ELSE 'test' END AS split FROM orders")
def split_by_months(spark, sf):
    months = {y: [f"{y}-{m:02d}" for m in range(1, 13)] for y in range(1990, 2003)}
    named = {"train": sum((months[y] for y in months if y < 1997), []), "test": sum((months[y] for y in months if y >= 1997), [])}
    d = ranking.split_by_months(table(spark, sf, "orders"), "o_orderdate", named)
    return d.select("o_orderkey", "split")


@query("split_by_bins", with_(TRAINS) + """, b AS (SELECT *, (t // 900000000) * 900000000 AS bin FROM trains), d AS (SELECT list_sort(list(DISTINCT bin)) AS ds FROM b),
c AS (SELECT ds[CAST(floor(len(ds) * 0.64::DOUBLE) AS INTEGER) + 1] AS c1, ds[CAST(floor(len(ds) * 0.8::DOUBLE) AS INTEGER) + 1] AS c2 FROM d)
SELECT event_id, CASE WHEN bin < c1 THEN 'train' WHEN bin < c2 THEN 'valid' ELSE 'test' END AS split FROM b, c""")
def split_by_bins(spark, sf):
    d = trains(spark, sf).withColumn("bin", (F.floor(F.col("t") / 900_000_000) * 900_000_000))
    return ranking.split_by_groups(d, "bin", (0.64, 0.8), SPLIT).select("event_id", "split")


@query("union_sources", """SELECT c_custkey AS k, c_name AS name, c_mktsegment AS seg, NULL::DOUBLE AS bal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name, NULL, NULL FROM nation""")
def union_sources(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("seg"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("bal"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))
    return ranking.union_sources(c, s, n)


@query("key_union", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def key_union(spark, sf):
    return ranking.key_union(table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation")))


@query("distinct_slots", with_(TRAINS) + "SELECT DISTINCT day, CAST(sec // 3600 AS INTEGER) AS hour, stop FROM trains")
def distinct_slots(spark, sf):
    return ranking.slots(_hour(trains(spark, sf)), ["day", "hour", "stop"])
