"""Cleaning and scalar-function queries over the driver tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.catalog.base import ALERTS, MIN_US, TRAINS, US, width, WEATHER, alerts, query, r6, table, trains, us, weather, with_
from tramline.functions import scalars as sc
from tramline.functions import text as tx
from tramline.operators import clean


@query("required_columns", with_(TRAINS) + "SELECT count(*) AS n FROM trains")
def required_columns(spark, sf):
    return clean.require(trains(spark, sf), ["trip", "t", "delay"]).agg(F.count(F.lit(1)).alias("n"))


@query("coerce_types", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events""")
def coerce_types(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("bad"))
    return clean.coerce_types(e, {"k": "int", "bad": "double"})


@query("drop_null_keys", with_(TRAINS) + "SELECT event_id, delay FROM trains WHERE delay IS NOT NULL")
def drop_null_keys(spark, sf):
    return clean.drop_null_keys(trains(spark, sf), ["delay", "trip"]).select("event_id", "delay")


@query("dedup_first", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate::DATE AS ship FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_partkey, l_suppkey) = 1""")
def dedup_first(spark, sf):
    d = clean.dedup(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    return d.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("ship"))


@query("dedup_rows", with_(TRAINS) + "SELECT DISTINCT trip, stop, day FROM trains")
def dedup_rows(spark, sf):
    return clean.dedup_rows(trains(spark, sf).select("trip", "stop", "day"))


@query("dedup_last", with_(TRAINS) + "SELECT trip, day, event_id, delay FROM trains QUALIFY row_number() OVER (PARTITION BY trip, day ORDER BY t DESC, event_id DESC) = 1")
def dedup_last(spark, sf):
    return clean.dedup_last(trains(spark, sf), ["trip", "day"], ["t", "event_id"]).select("trip", "day", "event_id", "delay")


@query("outlier_filter", with_(TRAINS) + "SELECT event_id, delay FROM trains WHERE delay IS NULL OR delay BETWEEN -900 AND 900")
def outlier_filter(spark, sf):
    return clean.filter_outliers(trains(spark, sf), "delay", -900, 900).select("event_id", "delay")


@query("zscore_filter", with_(TRAINS) + """,
s AS (SELECT day, stop, count(delay) AS n, avg(delay) AS mu, stddev_pop(delay) AS sd FROM trains GROUP BY ALL)
SELECT event_id, delay FROM trains JOIN s USING (day, stop) WHERE delay IS NOT NULL AND (n <= 5 OR sd = 0 OR abs((delay - mu) / nullif(sd, 0)) < 3)""")
def zscore_filter(spark, sf):
    return clean.zscore_filter(trains(spark, sf), "delay", ["day", "stop"]).select("event_id", "delay")


@query("null_beyond", with_(TRAINS) + "SELECT event_id, CASE WHEN abs(delay) <= 600 THEN delay END AS delay FROM trains")
def null_beyond(spark, sf):
    return clean.null_beyond(trains(spark, sf), ["delay"], 600).select("event_id", "delay")


@query("split_scheduled", with_(TRAINS) + """
SELECT event_id, CASE WHEN unscheduled THEN 'unscheduled' ELSE 'scheduled' END AS part FROM trains WHERE (NOT unscheduled AND delay IS NOT NULL) OR (unscheduled AND t IS NOT NULL)""")
def split_scheduled(spark, sf):
    s, u = clean.split_scheduled(trains(spark, sf), "unscheduled")
    return s.select("event_id", F.lit("scheduled").alias("part")).unionByName(u.select("event_id", F.lit("unscheduled").alias("part")))


@query("column_policy", with_(TRAINS) + "SELECT event_id, trip, delay FROM trains")
def column_policy(spark, sf):
    return clean.column_policy(trains(spark, sf), ["event_id", "trip", "absent", "delay", "value"], ["value"])


@query("align_schema", with_(TRAINS) + "SELECT event_id, delay, CAST(NULL AS DOUBLE) AS target_30m, CAST(NULL AS BIGINT) AS n_events FROM trains")
def align_schema(spark, sf):
    s = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("delay", T.DoubleType()), T.StructField("target_30m", T.DoubleType()), T.StructField("n_events", T.LongType())])
    return clean.align_schema(trains(spark, sf), s)


TRIP_ID = "'AFA' || CAST(o_custkey AS VARCHAR) || '-' || o_orderpriority || '-Weekday-' || o_orderstatus || '_' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '_' || CASE WHEN o_custkey % 3 = 0 THEN 'SI' WHEN o_custkey % 3 = 1 THEN CAST(o_custkey % 9 AS VARCHAR) ELSE 'XYZ' END || '..N' || CAST(o_custkey % 7 AS VARCHAR)"


def _trips(spark, sf):
    o = table(spark, sf, "orders")
    tok = F.when(F.col("o_custkey") % 3 == 0, "SI").when(F.col("o_custkey") % 3 == 1, (F.col("o_custkey") % 9).cast("string")).otherwise("XYZ")
    tid = F.concat(
        F.lit("AFA"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderpriority"), F.lit("-Weekday-"), F.col("o_orderstatus"), F.lit("_"),
        F.lpad((F.col("o_orderkey") % 1000000).cast("string"), 6, "0"), F.lit("_"), tok, F.lit("..N"), (F.col("o_custkey") % 7).cast("string"),
    )
    return o.withColumn("trip_id", tid)


@query("trip_keys", f"""WITH o AS (SELECT *, {TRIP_ID} AS trip_id FROM orders)
SELECT o_orderkey, nullif(regexp_extract(trip_id, '_([0-9]{{6}}_.*)$', 1), '') AS match_key, string_split(trip_id, '-')[-2] AS service, regexp_replace(trip_id, '^[^_]*_', '') AS short_trip FROM o""")
def trip_keys(spark, sf):
    return _trips(spark, sf).select("o_orderkey", sc.trip_key("trip_id").alias("match_key"), sc.service_day("trip_id").alias("service"), sc.short_trip("trip_id").alias("short_trip"))


@query("route_recover", f"""WITH o AS (SELECT o_orderkey, o_custkey, regexp_extract({TRIP_ID}, '_([0-9]{{6}}_.*)$', 1) AS mk FROM orders),
k AS (SELECT *, split_part(string_split(mk, '_')[2], '.', 1) AS tok FROM o)
SELECT o_orderkey, CASE WHEN length(tok) < 3 AND tok <> '' THEN tok END AS recovered, coalesce(nullif(CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'Q' END, ''), nullif(tok, '')) AS filled, upper(trim('  ' || lower(tok) || ' ')) AS normal FROM k""")
def route_recover(spark, sf):
    d = _trips(spark, sf).withColumn("mk", sc.trip_key("trip_id")).withColumn("route", F.when(F.col("o_custkey") % 2 == 0, "").otherwise("Q"))
    return d.select("o_orderkey", tx.route_from_key("mk").alias("recovered"), tx.fill_route("route", "mk").alias("filled"),
                    tx.norm_route(F.concat(F.lit("  "), F.lower(tx.route_token("mk")), F.lit(" "))).alias("normal"))


_LISTED = "(" + ",".join(f"'{r}'" for r in tx.ROUTES) + ")"


@query("canonical_route", f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 = 0 THEN 'A-extra' WHEN o_custkey % 4 = 1 THEN 'SI' WHEN o_custkey % 4 = 2 THEN ' 6 ' ELSE '??' END AS route, {TRIP_ID} AS trip_id FROM orders),
x AS (SELECT *, trim(route) AS r, regexp_replace(trim(route), '[-_].*$', '') AS b, list_transform(list_slice(string_split(trip_id, '_'), 2, 99), lambda q: split_part(q, '.', 1)) AS toks FROM o),
y AS (SELECT *, list_filter(list_transform(toks, lambda q: CASE WHEN q IN {_LISTED} THEN q WHEN regexp_replace(q, '[-_].*$', '') IN {_LISTED} THEN regexp_replace(q, '[-_].*$', '') WHEN regexp_replace(q, '[-_].*$', '') = 'SI' THEN 'SIR' END), lambda z: z IS NOT NULL) AS ok FROM x)
SELECT o_orderkey, coalesce(CASE WHEN r IN {_LISTED} THEN r WHEN b IN {_LISTED} THEN b WHEN b = 'SI' THEN 'SIR' END, ok[1]) AS route FROM y""")
def canonical_route(spark, sf):
    d = _trips(spark, sf)
    m = F.col("o_custkey") % 4
    d = d.withColumn("raw", F.when(m == 0, "A-extra").when(m == 1, "SI").when(m == 2, " 6 ").otherwise("??"))
    return d.select("o_orderkey", tx.canonical_route("raw", "trip_id").alias("route"))


def _any_sql(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


STATUS_SQL = "CASE " + " ".join(f"WHEN {_any_sql('s', w)} THEN '{n}'" for n, w in tx.STATUS_RULES) + " ELSE 'Other' END"


@query("alert_category", f"""WITH x AS (SELECT event_id, lower(CASE WHEN value > 150 THEN 'Delays | Suspended' WHEN value > 100 THEN 'Severe-Delays' WHEN value > 60 THEN 'some-DELAY' WHEN value > 40 THEN 'Reroute'
 WHEN value > 20 THEN 'trip-cancellations' WHEN value > 10 THEN 'stops-skipped' WHEN value > 5 THEN event_type END) AS s FROM events)
SELECT event_id, {STATUS_SQL} AS category FROM x""")
def alert_category(spark, sf):
    v = F.col("value")
    s = (F.when(v > 150, "Delays | Suspended").when(v > 100, "Severe-Delays").when(v > 60, "some-DELAY").when(v > 40, "Reroute")
         .when(v > 20, "trip-cancellations").when(v > 10, "stops-skipped").when(v > 5, F.col("event_type")))
    return table(spark, sf, "events").select("event_id", tx.alert_category(s).alias("category"))


WORDS = r"[^\p{L}\p{N}\p{M}_]+"


def _strip_sql(col: str) -> str:
    t = f"regexp_replace({col}, '(?s)<!--.*?-->', ' ', 'g')"
    t = f"regexp_replace({t}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g')"
    t = f"regexp_replace({t}, '(?s)<[^>]*>', ' ', 'g')"
    for n, ch in tx.ENTITIES:
        ch = ch.replace("'", "''")
        t = f"replace({t}, '{n}', '{ch}')"
    return f"trim(regexp_replace({t}, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"


def _classify_sql(table_: str, key: str, col: str) -> str:
    return f"""WITH a AS (SELECT {key}, {_strip_sql(col)} AS x FROM {table_}), b AS (SELECT *, lower(x) AS low FROM a)
SELECT {key},
 CASE WHEN {_any_sql('low', tx.BODY_RESUMED)} THEN 'Service Resumed' WHEN contains(low, 'preparing for') AND contains(low, 'storm') THEN 'Weather Prep' WHEN {_any_sql('low', tx.BODY_DELAY)} THEN 'Delay'
  WHEN {_any_sql('low', tx.BODY_CHANGE)} THEN 'Service Change' WHEN contains(low, 'planned work') THEN 'Planned Work' ELSE 'Info/Other' END AS category,
 array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(x, '{WORDS}'), lambda w: regexp_full_match(w, '[1-7]|A|B|C|D|E|F|G|J|L|M|N|Q|R|S|W|Z')))), ', ') AS lines,
 CASE WHEN contains(low, 'door') THEN 'Mechanical (Doors)' WHEN contains(low, 'signal') THEN 'Signal Problems' WHEN contains(low, 'person on the tracks') OR contains(low, 'ems') THEN 'Medical/Police'
  WHEN contains(low, 'track') AND contains(low, 'work') THEN 'Maintenance' WHEN contains(low, 'winter storm') THEN 'Weather' ELSE 'Unknown' END AS reason,
 coalesce(nullif(regexp_extract(x, '(?:at|from|to|near)\\s+([A-Z][a-z0-9]+(?:\\s[A-Z][a-z0-9]+)*)', 1), ''), 'Multiple/System-wide') AS location,
 substring(x, 1, 500) AS text_snippet FROM b"""


@query("classify_pages", _classify_sql("pages", "page_id", "html"))
def classify_pages(spark, sf):
    return tx.classify_alert_text(table(spark, sf, "pages"), "html").select("page_id", "category", "lines", "reason", "location", "text_snippet")


@query("classify_documents", _classify_sql("documents", "doc_id", "text"))
def classify_documents(spark, sf):
    return tx.classify_alert_text(table(spark, sf, "documents"), "text").select("doc_id", "category", "lines", "reason", "location", "text_snippet")


@query("alert_flags", f"""WITH x AS (SELECT doc_id, lower(coalesce(source, '')) AS c, lower(coalesce(text, '')) AS d FROM documents)
SELECT doc_id, CAST(regexp_matches(c, '{tx.FLAG_DELAY}') AS INTEGER) AS is_delay_alert, CAST(regexp_matches(c, '{tx.FLAG_CHANGE}') AS INTEGER) AS is_service_change_alert,
 CAST(regexp_matches(c, '{tx.FLAG_SUSPENSION}') AS INTEGER) AS is_suspension_alert, CAST(regexp_matches(d, '{tx.FLAG_PLANNED}') AS INTEGER) AS is_planned_work,
 CAST(regexp_matches(d, '{tx.FLAG_SHOCK}') AND NOT regexp_matches(d, '{tx.FLAG_PLANNED}') AS INTEGER) AS is_unplanned_shock,
 CASE WHEN regexp_matches(c || ' ' || d, '{tx.GROUP_PLANNED}') THEN 'planned' WHEN regexp_matches(c || ' ' || d, '{tx.GROUP_SHOCK}') THEN 'unplanned' ELSE 'other' END AS incident_group FROM x""")
def alert_flags(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", *[v.alias(k) for k, v in tx.alert_flags("source", "text").items()], tx.incident_group("source", "text").alias("incident_group"))


@query("conversation_flags", f"""SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '{tx.GROUP_PLANNED}') THEN 'planned' WHEN regexp_matches(lower(text), '{tx.GROUP_SHOCK}') THEN 'unplanned' ELSE 'other' END AS incident_group FROM conversations""")
def conversation_flags(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", tx.incident_group("text").alias("incident_group"))


@query("filter_in", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filter_in(spark, sf):
    return clean.filter_in(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey")


@query("map_score", "SELECT event_id, CASE event_type WHEN 'purchase' THEN 10 WHEN 'click' THEN 8 WHEN 'view' THEN 5 ELSE 1 END AS score FROM events WHERE event_type IN ('purchase', 'click')")
def map_score(spark, sf):
    return clean.map_score(table(spark, sf, "events"), "event_type", {"purchase": 10, "click": 8, "view": 5}, 8, default=1).select("event_id", "score")


@query("home_games", """
SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE lower(c_mktsegment) LIKE '%build%' AND o_orderstatus = 'F' AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3')""")
def home_games(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    team = F.struct(F.col("c_mktsegment").alias("slug"), F.col("c_name").alias("displayName"))
    comp = F.array(F.struct(F.when(F.col("o_orderstatus") == "F", "home").otherwise("away").alias("homeAway"), team.alias("team")))
    return clean.home_games(j.withColumn("competitors", comp), "competitors", ["build"], F.col("n_name").isin("NATION_1", "NATION_2", "NATION_3")).select("o_orderkey")


TL = ", s AS (SELECT *, (max(t) OVER (PARTITION BY trip, day) - t) / 1000000 AS time_left FROM trains)"


def _with_left(spark, sf):
    tr = trains(spark, sf)
    return tr.join(tr.groupBy("trip", "day").agg(F.max("t").alias("e")), ["trip", "day"]).withColumn("time_left", (F.col("e") - F.col("t")) / US)


@query("model_population", with_(TRAINS) + TL + """
SELECT event_id, CASE WHEN time_left < 1800 THEN 'end' ELSE '30m' END AS side FROM s WHERE NOT unscheduled AND delay IS NOT NULL""")
def model_population(spark, sf):
    d = _with_left(spark, sf)
    a = clean.population(d, "delay", "end", "unscheduled").select("event_id", F.lit("end").alias("side"))
    return a.unionByName(clean.population(d, "delay", "30m", "unscheduled").select("event_id", F.lit("30m").alias("side")))


@query("exclude_days_routes", with_(TRAINS) + "SELECT event_id FROM trains WHERE day NOT IN (DATE '2024-01-05', DATE '2024-01-06') AND route NOT IN (2, 3)")
def exclude_days_routes(spark, sf):
    import datetime as dt

    return clean.exclude(trains(spark, sf), "day", [dt.date(2024, 1, 5), dt.date(2024, 1, 6)], "route", [2, 3]).select("event_id")


@query("drop_ambiguous", """WITH x AS (SELECT event_id, CAST(value > 60 AS INTEGER) AS y15, CAST(value > 30 AS INTEGER) AS y30 FROM events) SELECT event_id, y15, y30 FROM x WHERE y15 = 1 OR y30 = 0""")
def drop_ambiguous(spark, sf):
    e = table(spark, sf, "events").select("event_id", (F.col("value") > 60).cast("int").alias("y15"), (F.col("value") > 30).cast("int").alias("y30"))
    return clean.drop_ambiguous(e, "y15", "y30")


@query("weather_flags", with_(WEATHER) + """
SELECT day, hour, (rain > 10 OR rain > 25 OR temp < -5 OR temp > 35 OR wind > 40 OR wind - 5 > 0) AS extreme, CAST(rain > 1 AS INTEGER) AS is_flooding_risk, CAST(temp > 7 AS INTEGER) AS is_extreme_heat,
 CAST(wind - 5 > 0 AND wind > 25 AS INTEGER) AS is_blizzard, CAST(temp <= 0 AS INTEGER) AS is_freezing, CAST(wind > 50 AS INTEGER) AS is_high_wind FROM weather""")
def weather_flags(spark, sf):
    w = weather(spark, sf).withColumn("snow", F.col("wind") - 5)
    return w.select("day", "hour", clean.extreme_weather("rain", "rain", "temp", "wind", "snow").alias("extreme"), *[v.alias(k) for k, v in clean.weather_flags("rain", "temp", "wind", "snow").items()])


@query("past_only", with_(TRAINS) + "SELECT event_id FROM trains WHERE t >= t + CAST(delay AS BIGINT) * 1000000")
def past_only(spark, sf):
    d = trains(spark, sf).withColumn("arrival", F.col("t") + F.col("delay").cast("bigint") * US)
    return clean.past_only(d, "t", "arrival").select("event_id")


@query("reject_bad_match", with_(TRAINS) + """
SELECT event_id, CASE WHEN abs(delay) <= 600 THEN delay END AS delay, CASE WHEN abs(delay) <= 600 THEN stop END AS stop, coalesce(abs(delay) > 600, TRUE) AS unscheduled FROM trains""")
def reject_bad_match(spark, sf):
    return clean.reject_bad_match(trains(spark, sf), "delay", ["delay", "stop"], "unscheduled", 600).select("event_id", "delay", "stop", "unscheduled")


@query("clean_stations", """
SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: x <> 'red')) AS n_stations FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: x <> 'red')) > 0""")
def clean_stations(spark, sf):
    p = table(spark, sf, "part")
    st = F.transform(F.split("p_name", " "), lambda x: F.struct(F.when(x != "red", x).alias("name"), F.lit("1").alias("lines")))
    return clean.clean_stations(p.withColumn("stations", st), "stations").select("p_partkey", F.size("stations").cast("bigint").alias("n_stations"))


@query("feature_columns", with_(TRAINS) + "SELECT event_id, delay, value FROM trains")
def feature_columns(spark, sf):
    d = trains(spark, sf).select("event_id", "delay", "value", "unscheduled", F.col("value").alias("target_30m"), F.col("value").alias("delta_30m"))
    return d.select(*clean.feature_columns(d, ["unscheduled"]))


@query("platforms", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name || 'N' WHEN s_suppkey % 3 = 1 THEN s_name || 'S' ELSE s_name END AS stop_id, s_suppkey % 3 < 2 AS is_platform, s_name AS base,
 CASE s_suppkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'S' END AS direction, CASE s_suppkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS direction_code FROM supplier""")
def platforms(spark, sf):
    s = table(spark, sf, "supplier")
    m = F.col("s_suppkey") % 3
    stop = F.when(m == 0, F.concat("s_name", F.lit("N"))).when(m == 1, F.concat("s_name", F.lit("S"))).otherwise(F.col("s_name"))
    d = s.withColumn("stop_id", stop)
    return d.select("s_suppkey", "stop_id", tx.is_platform("stop_id").alias("is_platform"), tx.base_stop("stop_id").alias("base"), sc.direction("stop_id").alias("direction"), sc.direction_code("stop_id").alias("direction_code"))


@query("below_p99", with_(TRAINS) + "SELECT event_id, delay FROM trains WHERE delay < (SELECT quantile_cont(delay, 0.99) FROM trains)")
def below_p99(spark, sf):
    return clean.below_quantile(trains(spark, sf), "delay", 0.99).select("event_id", "delay")


# ---- scalars --------------------------------------------------------------------------------

CLOCK = "lpad(CAST(sec // 3600 + 3 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0')"


def _clock(df):
    p = lambda c: F.lpad(c.cast("bigint").cast("string"), 2, "0")
    s = F.col("sec")
    return df.withColumn("clock", F.concat_ws(":", p(F.floor(s / 3600) + 3), p(F.floor(s / 60) % 60), p(s % 60)))


@query("clock_seconds", with_(TRAINS) + f""", c AS (SELECT event_id, {CLOCK} AS clock, sec FROM trains)
SELECT event_id, clock, CAST(sec + 10800 AS INTEGER) AS seconds, lpad(CAST((sec // 3600 + 3) % 24 AS VARCHAR), 2, '0') || substring(clock, 3) AS wrapped, CAST(NULL AS INTEGER) AS bad FROM c""")
def clock_seconds(spark, sf):
    d = _clock(trains(spark, sf))
    return d.select("event_id", "clock", sc.clock_to_seconds("clock").alias("seconds"), sc.wrap_clock("clock").alias("wrapped"), sc.clock_to_seconds(F.concat(F.lit("x"), "clock")).alias("bad"))


@query("seconds_to_clock", with_(TRAINS) + f""", s AS (SELECT event_id, sec + CAST(delay AS BIGINT) AS x FROM trains)
SELECT event_id, lpad(CAST(((x % 86400) + 86400) % 86400 // 3600 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((x % 86400) + 86400) % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(((x % 86400) + 86400) % 60 AS VARCHAR), 2, '0') AS clock FROM s""")
def seconds_to_clock(spark, sf):
    d = trains(spark, sf).withColumn("x", F.col("sec") + F.col("delay").cast("bigint"))
    return d.select("event_id", sc.seconds_to_clock("x").alias("clock"))


@query("local_seconds", """SELECT event_id, CAST(hour(l) * 3600 + minute(l) * 60 + floor(second(l)) AS INTEGER) AS local_s
FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS l FROM events)""")
def local_seconds(spark, sf):
    return trains(spark, sf).select("event_id", sc.epoch_to_local_seconds(F.floor(F.col("t") / US), "America/New_York").alias("local_s"))


@query("wrap_delay", with_(TRAINS) + """, x AS (SELECT event_id, sec - 40000 - delay * 10 AS d FROM trains)
SELECT event_id, CASE WHEN d > 43200 THEN d - 86400 WHEN d < -43200 THEN d + 86400 ELSE d END AS d FROM x""")
def wrap_delay(spark, sf):
    d = trains(spark, sf).withColumn("d", F.col("sec") - 40000 - F.col("delay") * 10)
    return d.select("event_id", sc.wrap_delay("d").alias("d"))


@query("calendar_features", with_(TRAINS) + """, h AS (SELECT *, CAST(sec // 3600 AS INTEGER) AS hour FROM trains)
SELECT event_id, hour, CAST(isodow(day) - 1 AS INTEGER) AS dow, CAST(isodow(day) >= 6 AS INTEGER) AS is_weekend, CASE isodow(day) WHEN 6 THEN 'Saturday' WHEN 7 THEN 'Sunday' ELSE 'Weekday' END AS kind,
 CASE WHEN hour BETWEEN 6 AND 9 THEN 'morning_peak' WHEN hour BETWEEN 10 AND 15 THEN 'midday' WHEN hour BETWEEN 16 AND 19 THEN 'evening_peak' ELSE 'off_peak' END AS period,
 CAST(hour BETWEEN 7 AND 9 OR hour BETWEEN 16 AND 19 AS INTEGER) AS rush, CAST((hour >= 7 AND hour < 9) OR (hour >= 17 AND hour < 19) AS INTEGER) AS rush_half FROM h""")
def calendar_features(spark, sf):
    d = trains(spark, sf).withColumn("hour", sc.event_hour(F.lit(None).cast("double"), "sec"))
    return d.select("event_id", "hour", sc.dow("day").alias("dow"), sc.is_weekend("day").alias("is_weekend"), sc.day_kind("day").alias("kind"), sc.period_of_day("hour").alias("period"),
                    sc.is_rush("hour").alias("rush"), sc.is_rush("hour", "half_open").alias("rush_half"))


@query("cyclic_hour", with_(TRAINS) + """, h AS (SELECT event_id, CAST(sec // 3600 AS INTEGER) AS hour FROM trains)
SELECT event_id, round(sin(2 * pi() * hour / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour / 24), 6) + 0.0 AS hour_cos, hour AS decoded FROM h""")
def cyclic_hour(spark, sf):
    d = trains(spark, sf).withColumn("hour", F.floor(F.col("sec") / 3600))
    s, c = sc.hour_sin("hour"), sc.hour_cos("hour")
    return d.select("event_id", (r6(s) + 0.0).alias("hour_sin"), (r6(c) + 0.0).alias("hour_cos"), sc.decode_hour(s, c).alias("decoded"))


@query("merge_time", with_(TRAINS) + f""", c AS (SELECT event_id, day, {CLOCK} AS clock, sec FROM trains)
SELECT event_id, CASE WHEN sec + 10800 < 86400 THEN epoch_us(CAST(day AS TIMESTAMP)) + (sec + 10800) * 1000000 END AS merge_us FROM c""")
def merge_time(spark, sf):
    d = _clock(trains(spark, sf))
    return d.select("event_id", F.unix_micros(sc.merge_time("day", F.lit(None).cast("string"), "clock").cast("timestamp")).alias("merge_us"))


@query("apparent_temp", with_(WEATHER) + "SELECT day, hour, round(13.12 + 0.6215 * temp - 11.37 * pow(wind, 0.16) + 0.3965 * temp * pow(wind, 0.16), 6) AS apparent FROM weather")
def apparent_temp(spark, sf):
    return weather(spark, sf).select("day", "hour", r6(sc.apparent_temp("temp", "wind")).alias("apparent"))


PLACE = "40.5::DOUBLE + (s_suppkey * 37 % 100) * 0.004::DOUBLE AS lat, -74.0::DOUBLE + (s_suppkey * 53 % 100) * 0.005::DOUBLE AS lon"


def stations(spark, sf):
    s = table(spark, sf, "supplier")
    return s.select("s_suppkey", "s_name", (40.5 + (F.col("s_suppkey") * 37 % 100) * 0.004).alias("stop_lat"), (-74.0 + (F.col("s_suppkey") * 53 % 100) * 0.005).alias("stop_lon"))


def hav_sql(a1, o1, a2, o2):
    return (f"2 * 6371000 * asin(sqrt(least(1.0, pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2))))")


@query("haversine_to_centre", f"WITH s AS (SELECT s_suppkey, {PLACE} FROM supplier) SELECT s_suppkey, round({hav_sql('lat', 'lon', '40.75', '-73.98')}, 4) AS metres FROM s")
def haversine_to_centre(spark, sf):
    return stations(spark, sf).select("s_suppkey", F.round(sc.haversine_m("stop_lat", "stop_lon", F.lit(40.75), F.lit(-73.98)), 4).alias("metres"))


@query("delay_classes", with_(TRAINS) + """
SELECT event_id, CASE WHEN delay IS NULL THEN NULL WHEN delay <= -60 THEN 0 WHEN delay <= 60 THEN 1 WHEN delay <= 180 THEN 2 WHEN delay <= 300 THEN 3 WHEN delay <= 450 THEN 4 ELSE 5 END AS delay_class,
 CASE WHEN delay IS NULL THEN NULL WHEN delay <= 0 THEN 'early' WHEN delay <= 60 THEN 'short' WHEN delay <= 300 THEN 'medium' ELSE 'long' END AS bucket FROM trains""")
def delay_classes(spark, sf):
    return trains(spark, sf).select("event_id", sc.bin_interval("delay", sc.DELAY_CLASS_EDGES).alias("delay_class"), sc.bin_interval("delay", sc.DELAY_BUCKET_EDGES, ["early", "short", "medium", "long"]).alias("bucket"))


@query("delay_features", with_(TRAINS) + """, l AS (SELECT *, lag(delay, 1) OVER w AS l1, lag(delay, 2) OVER w AS l2, row_number() OVER w AS sl FROM trains WINDOW w AS (PARTITION BY trip, day ORDER BY t, event_id))
SELECT event_id, delay - l1 AS delay_velocity, (delay - l1) - (l1 - l2) AS delay_acceleration, delay * sec AS delay_x_stops, round(delay / (sec + 1), 6) AS delay_ratio FROM l""")
def delay_features(spark, sf):
    from tramline.operators.windows import lagged

    d = lagged(trains(spark, sf), ["trip", "day"], ["t", "event_id"], "delay", 2, width(spark, sf))
    f = sc.delay_features(stops_left="sec", time_left="sec")
    f["delay_ratio"] = r6(f["delay_ratio"])
    return d.select("event_id", *[v.alias(k) for k, v in f.items()])


@query("trend_features", with_(TRAINS) + """, l AS (SELECT *, lag(delay, 1) OVER w AS l1, lag(delay, 2) OVER w AS l2 FROM trains WINDOW w AS (PARTITION BY trip, day ORDER BY t, event_id))
SELECT event_id, delay - l1 AS delay_change, l1 - l2 AS delay_change_prev, (delay - l1) - (l1 - l2) AS delay_accel, delay - l2 AS delay_vs_route, delay - coalesce(l1, delay) AS delay_vs_station, l1 - l2 AS station_trend,
 round(delay / (sec + 1.0), 6) AS delay_time_ratio, CAST(route > 3 AS INTEGER) AS has_alert, CAST(unscheduled AS INTEGER) + CAST(direction AS INTEGER) AS alert_impact FROM l""")
def trend_features(spark, sf):
    from tramline.operators.windows import lagged

    d = lagged(trains(spark, sf), ["trip", "day"], ["t", "event_id"], "delay", 2, width(spark, sf)).withColumn("n_events", F.greatest(F.col("route") - 3, F.lit(0)))
    f = sc.trend_features(route_mean="lag2", station10="lag1", station20="lag2", time_left="sec", phases=("unscheduled", "direction"))
    f["delay_time_ratio"] = r6(f["delay_time_ratio"])
    return d.select("event_id", *[v.alias(k) for k, v in f.items()])


@query("split_lines", r"""SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array(p_name || ' , a|' || p_type || '| ', '[,|]'), lambda x: upper(trim(x))), lambda x: x <> ''), ';') AS lines FROM part""")
def split_lines(spark, sf):
    d = table(spark, sf, "part").withColumn("aff", F.concat("p_name", F.lit(" , a|"), "p_type", F.lit("| ")))
    return d.select("p_partkey", F.array_join(tx.split_lines("aff"), ";").alias("lines"))


@query("extract_stop_ids", """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter([p_type || 'N', p_brand, p_type || 'N', p_brand || 'S'], lambda x: regexp_matches(x, '[NS]$')))), ';') AS stops FROM part""")
def extract_stop_ids(spark, sf):
    n = F.array(F.array(F.concat("p_type", F.lit("N")), F.col("p_brand")), F.array(F.concat("p_type", F.lit("N")), F.concat("p_brand", F.lit("S"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(tx.extract_stop_ids(n), ";").alias("stops"))


@query("merge_stations", """SELECT p_brand, array_to_string(list_sort(list(DISTINCT p_type)), ', ') AS lines FROM part GROUP BY p_brand""")
def merge_stations(spark, sf):
    from tramline.plans.places import merge_stations as run

    d = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.array("p_type").alias("lines"))
    return run(d, "name", "lines").select(F.col("name").alias("p_brand"), "lines")


@query("event_end", with_(TRAINS) + "SELECT event_id, t + CAST(CASE stop WHEN 'purchase' THEN 3.0 WHEN 'click' THEN 2.7 ELSE 2.5 END * 3600 AS BIGINT) * 1000000 AS end_t FROM trains")
def event_end(spark, sf):
    h = sc.event_end_hours("stop", {"purchase": 3.0, "click": 2.7})
    return trains(spark, sf).select("event_id", (F.col("t") + F.round(h * 3600).cast("bigint") * US).alias("end_t"))


@query("intersections", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_name || ' & A St, ' || p_brand || ', New York;' || p_name || ' & B St, ' || p_brand || ', New York'
 ELSE p_name || ', ' || p_brand || ', New York' END AS places FROM part""")
def intersections(spark, sf):
    loc = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(" between A St and B St"))).otherwise(F.col("p_name"))
    d = table(spark, sf, "part").withColumn("loc", loc)
    return d.select("p_partkey", F.array_join(tx.intersections("loc", "p_brand"), ";").alias("places"))


@query("time_bins", with_(TRAINS) + "SELECT event_id, (t // 900000000) * 900000000 AS bin15, CAST(floor(sec / 60 / 5) * 5 AS BIGINT) AS rel5 FROM trains")
def time_bins(spark, sf):
    return trains(spark, sf).select("event_id", sc.time_bin("t", 15 * MIN_US).alias("bin15"), sc.rel_bin(F.col("sec") / 60, 5).alias("rel5"))


@query("feed_progress", with_(TRAINS) + """
SELECT event_id, lead(t) OVER w - t AS to_next, t - lag(t) OVER w AS from_prev, max(t) OVER (PARTITION BY trip, day) - t AS remaining FROM trains WINDOW w AS (PARTITION BY trip, day ORDER BY t, event_id)""")
def feed_progress(spark, sf):
    from tramline.operators.windows import next_stop, previous_stop

    d = next_stop(_with_left(spark, sf), ["trip", "day"], ["t", "event_id"], ["t"], width(spark, sf))
    d = previous_stop(d, ["trip", "day"], ["t", "event_id"], ["t"], width(spark, sf))
    return d.select("event_id", (F.col("next_t") - F.col("t")).alias("to_next"), (F.col("t") - F.col("prev_t")).alias("from_prev"), (F.col("e") - F.col("t")).alias("remaining"))


@query("present_delay", with_(TRAINS) + "SELECT event_id, round(CASE WHEN delay IS NOT NULL THEN greatest(delay, 0) / 60 END, 6) AS minutes FROM trains")
def present_delay(spark, sf):
    return trains(spark, sf).select("event_id", r6(sc.present_delay("delay")).alias("minutes"))


@query("default_time", "SELECT s_suppkey, CASE s_nationkey WHEN 1 THEN '19:30' WHEN 2 THEN '18:00' ELSE '20:00' END AS hora FROM supplier")
def default_time(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", sc.lookup("s_nationkey", {1: "19:30", 2: "18:00"}, "20:00").alias("hora"))
