"""Source, sink and stream queries over the driver tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tramline.catalog.base import ALERTS, CITY, MIN_US, TRAINS, US, WEATHER, width, alerts, chunks, city_events, query, r6, table, trains, us, with_
from tramline.session import scratch_path
from tramline.sources import feeds, lake
from tramline.streaming import jobs


def events_stream(spark, sf):
    """The events table as a file stream."""
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def train_stream(spark, sf):
    return events_stream(spark, sf).select(
        "event_id", "ts", F.unix_micros("ts").alias("t"), F.col("user_id").alias("trip"), F.col("event_type").alias("stop"), (F.col("user_id") % 7).alias("route"),
        F.when(F.col("value") >= 1, F.floor(F.col("value") * 10).cast("double") - 300).alias("delay"), "value",
    )


# ---- tables ---------------------------------------------------------------------------------


@query("layer_round_trip", with_(TRAINS) + "SELECT event_id, day, delay FROM trains")
def layer_round_trip(spark, sf):
    root = scratch_path(spark, "lake")
    lake.write_layer(trains(spark, sf), root, "cleaned", "trains", ["day"])
    return lake.read_layer(spark, root, "cleaned", "trains").select("event_id", "day", "delay")


@query("layer_one_day", with_(TRAINS) + "SELECT event_id, day, delay FROM trains WHERE day = DATE '2024-01-10'")
def layer_one_day(spark, sf):
    root = scratch_path(spark, "lake")
    lake.write_layer(trains(spark, sf), root, "cleaned", "trains", ["day"])
    return lake.read_layer(spark, root, "cleaned", "trains", day=dt.date(2024, 1, 10)).select("event_id", "day", "delay")


@query("json_documents", with_(ALERTS) + 'SELECT alert_id, "at" AS at_us, route, category FROM alerts')
def json_documents(spark, sf):
    path = scratch_path(spark, "json")
    a = alerts(spark, sf).select("alert_id", F.col("at").alias("at_us"), "route", "category")
    lake.write_json_docs(a, path)
    return lake.read_json_docs(spark, path, a.schema)


@query("static_stop_times", """SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_partkey AS VARCHAR) AS stop_id, l_linenumber AS stop_sequence, l_suppkey % 30 * 3600 + l_partkey % 60 * 60 AS seconds FROM lineitem""")
def static_stop_times(spark, sf):
    from tramline.functions.scalars import clock_to_seconds

    folder = scratch_path(spark, "static")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    at = F.concat(two(F.col("l_suppkey") % 30), F.lit(":"), two(F.col("l_partkey") % 60), F.lit(":00"))
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_partkey").alias("stop_id"), at.alias("arrival_time"), at.alias("departure_time"), F.col("l_linenumber").alias("stop_sequence"))
    li.write.option("header", True).csv(f"{folder}/stop_times.txt")
    d = lake.read_static(spark, folder, "stop_times", ["trip_id", "stop_id", "arrival_time", "stop_sequence"])
    return d.select("trip_id", "stop_id", "stop_sequence", clock_to_seconds("arrival_time").alias("seconds"))


@query("day_range_lookback", with_(TRAINS) + "SELECT event_id, day FROM trains WHERE day BETWEEN DATE '2024-01-07' AND DATE '2024-01-12'")
def day_range_lookback(spark, sf):
    root = scratch_path(spark, "days")
    lake.write_layer(trains(spark, sf), root, "cleaned", "trains", ["day"])
    return lake.scan_days(lake.read_layer(spark, root, "cleaned", "trains"), dt.date(2024, 1, 10), dt.date(2024, 1, 12), lookback_days=3).select("event_id", "day")


@query("monthly_by_line", """SELECT o_orderkey, o_orderpriority, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(month(o_orderdate) AS INTEGER) AS month, o_orderstatus FROM orders""")
def monthly_by_line(spark, sf):
    path = scratch_path(spark, "months")
    lake.write_months(table(spark, sf, "orders"), path, "o_orderdate", "o_orderstatus")
    return spark.read.parquet(path).select("o_orderkey", "o_orderpriority", "year", "month", "o_orderstatus")


@query("yearly_lines", """SELECT o_orderstatus, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS s FROM orders GROUP BY ALL""")
def yearly_lines(spark, sf):
    path = scratch_path(spark, "lines")
    lake.compact_lines(table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), path, "o_orderstatus", "year", key="o_orderkey")
    return spark.read.parquet(path).groupBy("o_orderstatus", "year").agg(F.count(F.lit(1)).alias("n"), F.sum("o_custkey").alias("s"))


@query("pick_version", """WITH v AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS downloaded, 'v' || strftime(o_orderdate, '%Y%m%d') AS url FROM orders), d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day FROM lineitem)
SELECT d.day, v.url AS version_url, v.downloaded AS version_downloaded FROM d ASOF LEFT JOIN v ON d.day >= v.downloaded""")
def pick_version(spark, sf):
    v = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("downloaded"), F.concat(F.lit("v"), F.date_format("o_orderdate", "yyyyMMdd")).alias("url")).distinct()
    d = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")).distinct()
    return lake.pick_version(d, v, "day", "downloaded", "url")


@query("snapshot_replaced", "SELECT s_suppkey + 1 AS s_suppkey, s_name FROM supplier")
def snapshot_replaced(spark, sf):
    path = scratch_path(spark, "snapshot")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    lake.publish_snapshot(s, path)
    lake.publish_snapshot(s.withColumn("s_suppkey", F.col("s_suppkey") + 1), path)
    return spark.read.parquet(path).select("s_suppkey", "s_name")


@query("latest_windows", with_(TRAINS) + """, w AS (SELECT *, (t // 21600000000) * 21600000000 AS window_start FROM trains)
SELECT window_start, stop, count(*) AS n FROM w WHERE window_start IN (SELECT DISTINCT window_start FROM w ORDER BY 1 DESC LIMIT 8) GROUP BY ALL""")
def latest_windows(spark, sf):
    path = scratch_path(spark, "windows")
    w = trains(spark, sf).groupBy((F.floor(F.col("t") / (360 * MIN_US)) * (360 * MIN_US)).alias("window_start"), "stop").agg(F.count(F.lit(1)).alias("n"))
    lake.publish_window(w, path)
    return lake.latest_windows(spark.read.parquet(path), 8).select("window_start", "stop", "n")


@query("flatten_trip_updates", """WITH u AS (SELECT l_orderkey, l_suppkey, l_linenumber, l_partkey, epoch_us(l_shipdate) // 1000000 AS s FROM lineitem)
SELECT CAST(l_orderkey AS VARCHAR) AS trip_id, CAST(l_suppkey % 7 AS VARCHAR) AS route_id, l_partkey AS timestamp, 0 AS seq, 'A' || CAST(l_linenumber AS VARCHAR) AS stop_id, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE s END AS arrival_time, s + 60 AS departure_time FROM u
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), CAST(l_suppkey % 7 AS VARCHAR), l_partkey, 1, 'B' || CAST(l_linenumber AS VARCHAR), s + 300, NULL FROM u""")
def flatten_trip_updates(spark, sf):
    s = F.floor(us("l_shipdate") / US)
    n = F.lit(None).cast("int")
    none = F.lit(None).cast("struct<time:bigint,delay:int>")
    at = lambda x: F.struct(x.cast("bigint").alias("time"), n.alias("delay"))
    stop = lambda p: F.concat(F.lit(p), F.col("l_linenumber").cast("string")).alias("stop_id")
    upd = F.array(
        F.struct(stop("A"), at(F.when(F.col("l_partkey") % 5 == 0, 0).otherwise(s)).alias("arrival"), at(s + 60).alias("departure")),
        F.struct(stop("B"), at(s + 300).alias("arrival"), none.alias("departure")),
    )
    msg = table(spark, sf, "lineitem").select(
        F.struct(F.col("l_orderkey").cast("string").alias("trip_id"), (F.col("l_suppkey") % 7).cast("string").alias("route_id"), F.lit(0).alias("schedule_relationship")).alias("trip"),
        upd.alias("stop_time_update"), F.col("l_partkey").alias("timestamp"),
    )
    path = scratch_path(spark, "feed")
    lake.write_json_docs(msg, path)
    return feeds.flatten_trip_updates(spark.read.schema(feeds.TRIP_UPDATE).json(path))


@query("flatten_vehicles", """SELECT CAST(user_id AS VARCHAR) AS trip_id, CAST(user_id % 7 AS VARCHAR) AS route_id, event_type AS stop_id, CAST(event_id % 40 AS INTEGER) AS stop_sequence,
 CASE event_id % 4 WHEN 0 THEN 'INCOMING_AT' WHEN 1 THEN 'STOPPED_AT' WHEN 2 THEN 'IN_TRANSIT_TO' ELSE '3' END AS status, CASE WHEN value < 5 THEN 1700000000 ELSE epoch_us(ts) // 1000000 END AS timestamp FROM events WHERE user_id > 5""")
def flatten_vehicles(spark, sf):
    e = table(spark, sf, "events")
    v = e.select(
        F.struct(F.when(F.col("user_id") > 5, F.col("user_id").cast("string")).otherwise("").alias("trip_id"), (F.col("user_id") % 7).cast("string").alias("route_id")).alias("trip"),
        F.col("event_type").alias("stop_id"), (F.col("event_id") % 40).cast("int").alias("current_stop_sequence"), (F.col("event_id") % 4).cast("int").alias("current_status"),
        F.when(F.col("value") < 5, 0).otherwise(F.floor(us("ts") / US)).alias("timestamp"), F.lit(1_700_000_000).cast("bigint").alias("received"),
    )
    return feeds.flatten_vehicles(v)


# ---- streams --------------------------------------------------------------------------------


LAG_STATE_SQL = with_(TRAINS) + """,
q AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY trip ORDER BY t, event_id) > 21600000000 THEN 1 ELSE 0 END AS silent FROM trains),
p AS (SELECT *, sum(silent) OVER (PARTITION BY trip ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM q),
r AS (SELECT event_id, trip, leg, stop, t, coalesce(delay, 0) AS delay, CASE WHEN stop IS DISTINCT FROM lag(stop) OVER w THEN 1 ELSE 0 END AS fresh FROM p WINDOW w AS (PARTITION BY trip, leg ORDER BY t, event_id)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY trip, leg ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM r),
x AS (SELECT trip, leg, run, arg_min(delay, (t, event_id)) AS fd, arg_max(delay, (t, event_id)) AS ld FROM g GROUP BY ALL),
y AS (SELECT *, coalesce(lag(ld) OVER (PARTITION BY trip, leg ORDER BY run), fd) AS lag1 FROM x), z AS (SELECT *, coalesce(lag(lag1) OVER (PARTITION BY trip, leg ORDER BY run), fd) AS lag2 FROM y)
SELECT g.event_id, z.lag1, z.lag2 FROM g JOIN z USING (trip, leg, run)"""


@query("lag_state_stream", LAG_STATE_SQL)
def lag_state_stream(spark, sf):
    """The events come period by period, a few files a micro-batch, whose times overlap."""
    src, sink = scratch_path(spark, "lag-files"), jobs.LagState(scratch_path(spark, "lags"), width(spark, sf), buckets=8, merge=2)
    t = trains(spark, sf).select("trip", "event_id", "t", "stop", "delay", (F.col("t") + F.col("event_id") % 9 * MIN_US).alias("came"))
    jobs.deal_in_periods(t, "came", 12 * 24 * 60 * MIN_US, src)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 4).parquet(src).drop("came")
    jobs.run_batches(stream, sink, spark, "lags")
    sink.finish(spark)
    return sink.rows(spark).select("event_id", "lag1", "lag2")


@query("lag_state_table", LAG_STATE_SQL)
def lag_state_table(spark, sf):
    return jobs.lag_state_batch(trains(spark, sf), width(spark, sf)).select("event_id", "lag1", "lag2")


TUMBLE = with_(TRAINS) + """, m AS (SELECT max(t) - 600000000 AS wm FROM trains)
SELECT (t // 900000000) * 900000000 AS window_start, stop, count(*) AS n, round(avg(delay), 6) AS mean_delay, max(delay) AS max_delay FROM trains, m WHERE (t // 900000000) * 900000000 + 900000000 <= wm GROUP BY 1, 2"""


@query("tumbling_stream", TUMBLE)
def tumbling_stream(spark, sf):
    path = scratch_path(spark, "tumbling")
    d = jobs.tumbling(train_stream(spark, sf), "ts", "15 minutes", "10 minutes", ["stop"], [F.count(F.lit(1)).alias("n"), F.avg("delay").alias("mean_delay"), F.max("delay").alias("max_delay")])
    d = d.select(F.unix_micros("window.start").alias("window_start"), "stop", "n", "mean_delay", "max_delay")
    jobs.run_to_table(d, path)
    return spark.read.parquet(path).withColumn("mean_delay", r6("mean_delay"))


@query("newest_windows_stream", with_(TRAINS) + """, m AS (SELECT max(t) - 600000000 AS wm FROM trains), w AS (SELECT (t // 10800000000) * 10800000000 AS window_start, stop, count(*) AS n FROM trains, m WHERE (t // 10800000000) * 10800000000 + 10800000000 <= wm GROUP BY ALL)
SELECT * FROM w WHERE window_start IN (SELECT DISTINCT window_start FROM w ORDER BY 1 DESC LIMIT 8)""")
def newest_windows_stream(spark, sf):
    path = scratch_path(spark, "newest")
    d = jobs.tumbling(train_stream(spark, sf), "ts", "3 hours", "10 minutes", ["stop"], [F.count(F.lit(1)).alias("n")])
    d = d.select(F.unix_micros("window.start").alias("window_start"), "stop", "n")
    jobs.run_batches(d, jobs.windows_per_batch(path, 8), spark, "newest")
    return spark.read.parquet(path).select("window_start", "stop", "n")


@query("dedup_stream", with_(ALERTS) + "SELECT alert_id, category FROM alerts")
def dedup_stream(spark, sf):
    path = scratch_path(spark, "dedup")
    e = events_stream(spark, sf).filter("event_type = 'error'")
    a = e.select(F.col("event_id").alias("alert_id"), "ts", F.when(F.col("value") > 50, "Suspension").when(F.col("value") > 20, "Delay").otherwise("Service Change").alias("category"))
    # each message arrives twice
    jobs.run_to_table(jobs.dedup_messages(a.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy"), "alert_id", "ts"), path)
    return spark.read.parquet(path).select("alert_id", "category")


@query("fresh_only_stream", with_(TRAINS) + "SELECT event_id FROM trains WHERE delay IS NOT NULL AND t >= t + CAST(delay AS BIGINT) * 1000000 AND t + CAST(delay AS BIGINT) * 1000000 >= t - 200000000")
def fresh_only_stream(spark, sf):
    path = scratch_path(spark, "fresh")
    d = train_stream(spark, sf).withColumns({"arrival": F.col("t") + F.col("delay").cast("bigint") * US, "cutoff": F.col("t") - 200 * US})
    jobs.run_to_table(jobs.fresh_only(d, "arrival", "t", "cutoff").select("event_id"), path)
    return spark.read.parquet(path)


@query("match_schedule_stream", """WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000000 % 86400 AS act FROM events), s AS (SELECT o_custkey + 9 AS user_id, o_orderkey * 997 % 86400 AS sched, o_orderkey FROM orders),
j AS (SELECT e.event_id, s.o_orderkey, CASE WHEN act - sched > 43200 THEN act - sched - 86400 WHEN act - sched < -43200 THEN act - sched + 86400 ELSE act - sched END AS delay FROM e LEFT JOIN s USING (user_id))
SELECT event_id, delay, delay IS NULL AS is_unscheduled FROM j QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(delay) NULLS LAST, o_orderkey) = 1""")
def match_schedule_stream(spark, sf):
    path = scratch_path(spark, "match")
    s = table(spark, sf, "orders").select((F.col("o_custkey") + 9).alias("trip"), (F.col("o_orderkey") * 997 % 86400).alias("sched"), "o_orderkey")
    live = train_stream(spark, sf).withColumn("act", F.floor(F.col("t") / US) % 86400)
    jobs.run_batches(live, jobs.match_per_batch(path, s, ["trip"], "act", "sched", ["o_orderkey"], chunks(s, ["trip"], "sched", 60, (sf, "schedule"))), spark, "match")
    return spark.read.parquet(path).select("event_id", "delay", "is_unscheduled")


def _live(spark, sf):
    return train_stream(spark, sf).withColumns({"day": F.to_date("ts"), "sec": F.floor(F.col("t") / US) % 86400}).drop("ts", "delay")


def _enriched(spark, sf, **sources):
    from tramline.plans.realtime import enrich_live

    path, chunk = scratch_path(spark, "enrich"), width(spark, sf, ("route",))
    step = lambda d: enrich_live(d, chunk, **{k: f(d.sparkSession, sf) for k, f in sources.items()})
    jobs.run_batches(_live(spark, sf), jobs.enrich_per_batch(path, [step]), spark, "enrich")
    return spark.read.parquet(path).select("event_id", F.col("last_category").alias("category"), "n_events", "temp", "rain")


@query("enrich_stream", with_(TRAINS, ALERTS, CITY, WEATHER) + """, a AS (SELECT t.event_id, a.category FROM trains t ASOF LEFT JOIN alerts a ON t.route = a.route AND t.t >= a.at),
c AS (SELECT t.event_id, count(c.city_id) AS n_events FROM trains t LEFT JOIN city c ON t.route = c.route AND t.day = c.day AND t.sec BETWEEN c.start_s - 5400 AND c.end_s + 5400 GROUP BY 1),
w AS (SELECT event_id, coalesce(temp, 0) AS temp, coalesce(rain, 0) AS rain FROM trains t LEFT JOIN weather w ON t.day = w.day AND CAST(t.sec // 3600 AS INTEGER) = w.hour)
SELECT * FROM a JOIN c USING (event_id) JOIN w USING (event_id)""")
def enrich_stream(spark, sf):
    from tramline.catalog.base import weather

    return _enriched(spark, sf, weather=weather, events=city_events, alerts=alerts)


@query("enrich_without_sources", with_(TRAINS) + "SELECT event_id, NULL::VARCHAR AS category, CAST(0 AS INTEGER) AS n_events, 0.0::DOUBLE AS temp, 0.0::DOUBLE AS rain FROM trains")
def enrich_without_sources(spark, sf):
    """No source has come: every live row still passes, with defaults."""
    return _enriched(spark, sf)


@query("monitor_stream", with_(TRAINS) + """, m AS (SELECT max(t) - 600000000 - 60000000 AS wm FROM trains),
b AS (SELECT (t // 300000000) * 300000000 AS w, route, avg(delay) AS before FROM trains GROUP BY ALL), a AS (SELECT ((t - 600000000) // 300000000) * 300000000 AS w, route, avg(delay) AS after FROM trains GROUP BY ALL)
SELECT w AS window_start, route, round(before, 6) AS before, round(after, 6) AS after FROM a JOIN b USING (w, route), m WHERE w + 300000000 <= wm""")
def monitor_stream(spark, sf):
    path = scratch_path(spark, "monitor")
    d = jobs.monitor(train_stream(spark, sf), "ts", "route", "delay", "10 minutes", "5 minutes", "1 minute")
    jobs.run_to_table(d.select(F.unix_micros("w.start").alias("window_start"), F.col("k").alias("route"), "before", "after"), path)
    return spark.read.parquet(path).withColumns({"before": r6("before"), "after": r6("after")})


MONITOR_ROWS = with_(TRAINS) + """, m AS (SELECT least(max(t), max(t) FILTER (value > 60)) - 60000000 AS wm FROM trains), p AS (SELECT event_id, route, t, delay FROM trains WHERE value > 60),
j AS (SELECT p.event_id, p.t, p.delay AS predicted, a.event_id AS actual_id, a.delay AS actual, abs(a.t - p.t - 600000000) AS gap
 FROM p LEFT JOIN trains a ON p.route = a.route AND a.t BETWEEN p.t + 600000000 - 120000000 AND p.t + 600000000 + 120000000)
SELECT event_id, predicted, actual_id, actual FROM j, m WHERE actual_id IS NOT NULL OR t + 720000000 < wm QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY gap NULLS LAST, actual_id) = 1"""


@query("monitor_rows_stream", MONITOR_ROWS)
def monitor_rows_stream(spark, sf):
    """Predictions beside the value of their line ten minutes later; values that never came are null."""
    src, path = scratch_path(spark, "monitor-files"), scratch_path(spark, "monitor-rows")
    t = trains(spark, sf).select("event_id", "route", "t", "delay", "value")
    periods = jobs.deal_in_periods(t, "t", 8 * 24 * 60 * MIN_US, src)
    n = t.groupBy("route").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))  # one row a line
    rows, busiest, lo, hi = n.agg(F.sum("n"), F.max(F.when(F.col("route").isNotNull(), F.col("n"))), F.min("lo"), F.max("hi")).first()
    parts = jobs.state_partitions(spark, (rows or 0) // max(periods, 1))
    cell = jobs.nearest_cell(busiest or 0, (hi or 0) - (lo or 0), 2 * MIN_US)
    live = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 4).parquet(src)
    pred = live.filter("value > 60").select("event_id", "route", F.timestamp_micros("t").alias("ts"), F.col("delay").alias("predicted"))
    came = live.select(F.col("event_id").alias("actual_id"), "route", F.timestamp_micros("t").alias("actual_ts"), F.col("delay").alias("actual"))
    jobs.run_to_table(jobs.monitor_rows(pred, came, "route", "ts", "actual_ts", "10 minutes", "2 minutes", "1 minute", ["actual_id"], cell), path, partitions=parts)
    rows = jobs.nearest_value(spark.read.parquet(path), ["event_id"], "ts", "actual_ts", "10 minutes", ["actual_id"])
    return rows.select("event_id", "predicted", "actual_id", "actual")


@query("scores_stream", "SELECT event_id, round(value / (value + 50), 6) AS probability FROM events WHERE value / (value + 50) >= 0.35")
def scores_stream(spark, sf):
    path = scratch_path(spark, "scores")
    run = jobs.scores_per_batch(path, lambda d: d.withColumn("probability", F.col("value") / (F.col("value") + 50)), 0.35)
    jobs.run_batches(events_stream(spark, sf).select("event_id", "value"), run, spark, "scores")
    return spark.read.parquet(path).select("event_id", r6("probability").alias("probability"))
