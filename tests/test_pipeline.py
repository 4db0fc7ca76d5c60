"""Whole-layer behaviour: traps of a service day, live windows, stream batches."""

import datetime as dt
import os
import shutil

import pytest
from pyspark.sql import functions as F

from tramline.plans import historical, realtime
from tramline.session import scratch_path, shared_dir
from tramline.sources import lake
from tramline.streaming import jobs

DAY = dt.date(2024, 5, 6)
STOP_EVENTS = "service_date date, trip_uid string, match_key string, route_id string, stop_id string, is_unscheduled boolean, scheduled_seconds double, actual_seconds double, delay_seconds double"


def ev(trip, stop, sched, act, delay, route="1", un=False, uid=None):
    return (DAY, uid or f"u{trip}{stop}", trip, route, stop, un, sched, act, delay)


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [
        ev("T1", "AN", 100.0, 100.0, 0.0),
        ev("T1", "BN", 700.0, 720.0, 20.0),
        ev("T1", "BN", 700.0, 720.0, 20.0, uid="zz"),  # duplicate
        ev("T1", "CN", 1300.0, 1400.0, 100.0),
        ev("T1", "DN", 1900.0, 1960.0, 60.0),
        ev("T2", "BN", 700.0, 720.0, 20.0),  # same second at a stop
        ev("T3", "AS", 50.0, 9050.0, 9000.0),
        ev("T4", "AS", 50.0, 9051.0, 9001.0),  # out of bounds
        ev("T5", None, 50.0, 60.0, 10.0),  # no stop
        ev("T6", "BN", None, 800.0, None, route=None, un=True),
        ev("T7", "BN", None, 810.0, None),  # scheduled without schedule
    ]
    return historical.clean_days(spark.createDataFrame(rows, STOP_EVENTS))


def test_clean_rules(cleaned):
    assert sorted((r["match_key"], r["stop_id"]) for r in cleaned.collect()) == [("T1", "AN"), ("T1", "BN"), ("T1", "CN"), ("T1", "DN"), ("T2", "BN"), ("T3", "AS"), ("T6", "BN")]


@pytest.mark.parametrize("width", [200.0, 3600.0])
def test_features_and_targets(cleaned, width):
    d = historical.future_targets(historical.day_features(cleaned, width), width)
    got = {(r["match_key"], r["stop_id"]): r for r in d.collect()}
    c = got["T1", "CN"]
    assert (c["lagged_delay_1"], c["lagged_delay_2"], c["rolling_mean_delay_trip"]) == (20.0, 0.0, 10.0)
    assert (c["stops_to_end"], c["scheduled_time_to_end"], c["target_delay_end"]) == (1, 600.0, 60.0)
    assert c["trip_progress"] == pytest.approx(1200 / 1800)
    assert c["target_delay_10m"] == 60.0 and c["delta_delay_10m"] == -40.0
    # nothing within 360 s of +60 min: the final delay stands in
    assert c["target_delay_60m"] == 60.0
    assert got["T1", "AN"]["target_delay_10m"] == 20.0
    second, third = got["T2", "BN"], got["T6", "BN"]
    assert second["actual_headway_seconds"] == 0.0 and second["headway_ratio"] is None
    assert third["actual_headway_seconds"] == 80.0 and third["headway_ratio"] is None
    assert got["T3", "AS"]["lagged_delay_1"] is None and got["T3", "AS"]["stops_to_end"] == 0


def test_window_snapshot_is_repeatable(spark):
    d = spark.createDataFrame([("s", "r", "N", 5, 10.0), ("s", "r", "N", 9, 20.0)], "stop_id string, route_id string, direction string, t bigint, delay_seconds double")
    r = realtime.window_snapshot(d, "t", 900, F.lit(1400)).collect()
    assert len(r) == 1 and r[0]["bin"] == 900 and r[0]["delay_seconds_mean"] == 15.0


def test_shared_dir_is_the_sessions(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or shared_dir(spark) == before
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_retention_keeps_newest(spark):
    path = scratch_path(spark, "retain")
    lake.publish_window(spark.range(12).select("id", (F.col("id") * 900).alias("window_start")), path)
    assert len(lake.retain_windows(spark, path, 8)) == 4
    assert sorted(r[0] for r in spark.read.parquet(path).select("id").collect()) == list(range(4, 12))


def test_layer_rewrite_replaces_only_its_partition(spark):
    root = scratch_path(spark, "layer")
    lake.write_layer(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), root, "cleaned", "x", ["p"])
    lake.write_layer(spark.createDataFrame([(9, "b")], "v int, p string"), root, "cleaned", "x", ["p"])
    assert sorted(r["v"] for r in lake.read_layer(spark, root, "cleaned", "x").collect()) == [1, 9]


def test_lag_state_over_batches(spark, tmp_path):
    """State, held-back rows and a silence carry over out-of-order micro-batches and equal the table form."""
    schema = "trip string, event_id bigint, t bigint, stop string, delay double"
    minute = 60_000_000
    facts = [(0, "A", 1.0), (1, "A", 2.0), (2, "B", None), (3, "B", 4.0), (4, "C", 5.0), (5, "C", 6.0), (6, "D", 7.0), (486, "E", 20.0), (487, "F", 30.0)]
    rows = [("x", i, (m + 1) * minute, s, d) for i, (m, s, d) in enumerate(facts)] + [(None, 90, 2 * minute, "A", 3.0), (None, 91, 3 * minute, "B", 4.0)]
    src = tmp_path / "in"
    os.makedirs(src)
    for n, ids in enumerate([(0, 2, 90), (1, 5, 3, 91), (4, 6, 8), (7,)]):
        one = str(tmp_path / f"p{n}")
        spark.createDataFrame([r for r in rows if r[1] in ids], schema).coalesce(1).write.parquet(one)
        f = next(x for x in os.listdir(one) if x.endswith(".parquet"))
        shutil.copy(f"{one}/{f}", src / f"{n}.parquet")
        os.utime(src / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    sink = jobs.LagState(str(tmp_path / "lags"), 90_000_000)
    jobs.run_batches(stream, sink, spark, "lags")
    sink.finish(spark)
    got = {r["event_id"]: (r["lag1"], r["lag2"]) for r in sink.rows(spark).collect()}
    table = {r["event_id"]: (r["lag1"], r["lag2"]) for r in jobs.lag_state_batch(spark.createDataFrame(rows, schema), 90_000_000).collect()}
    want = {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (2.0, 1.0), 3: (2.0, 1.0), 4: (4.0, 2.0), 5: (4.0, 2.0), 6: (6.0, 4.0), 7: (20.0, 20.0), 8: (20.0, 20.0)}
    assert got == table and {k: v for k, v in got.items() if k < 90} == want and got[91] == (4.0, 4.0)
    sink(spark.createDataFrame([("x", 99, minute, "A", 1.0)], schema), sink.last + 1)  # far too late: kept apart
    assert spark.read.parquet(str(tmp_path / "lags" / "late")).filter("event_id = 99").count() == 1


def test_clean_weather_days(spark):
    from tramline.plans.context import clean_weather

    def row(day, h, temp, rain=1.0):
        return (f"2024-01-{day:02d} {h:02d}:00:00", temp, rain, rain, 60.0 if h == 3 else 10.0, 0.0, 5.0)

    rows = [row(1, h, 10.0 + h % 3) for h in range(24)]
    rows[5] = row(1, 5, 90.0)  # beyond three deviations
    rows += [row(2, h, 40.0 if h == 4 else 1.0) for h in range(5)]  # short day: fixed bounds
    rows += [row(3, h, 7.0) for h in range(12)]  # constant day stays
    rows += [rows[0], row(4, 0, None)]  # duplicate, missing reading
    cols = "Date string, Temperature double, Rain double, Precipitation double, `Wind Speed` double, Snow double, `Cloud Cover` double"
    d = clean_weather(spark.createDataFrame(rows, cols)).collect()
    by = {(r["service_date"].day, r["hour"]): r for r in d}
    assert len(d) == 23 + 5 + 12 and (1, 5) not in by and (4, 0) not in by
    assert by[2, 4]["temp_extreme"] == 1 and by[2, 0]["temp_extreme"] == 0 and by[3, 0]["temp_extreme"] == 0
    assert by[1, 0]["precip_3h_accum"] == 1.0 and by[1, 4]["precip_3h_accum"] == 3.0
    assert by[1, 3]["is_high_wind"] == 1 and by[1, 8]["is_rush_hour"] == 1


def test_clean_alerts(spark):
    from tramline.plans.context import clean_alerts

    t = [dt.datetime(2024, 1, 1, 8, m) for m in (0, 5, 9)]
    rows = [
        ("e1", "delays", "A | C", "h1", t[0], "subway", "d1"), ("e1", "delays | suspended", "A | C", "h2", t[1], "subway", "d2"), ("e1", None, None, "h3", t[2], "subway", None),
        ("e2", None, "B", "h", t[0], "subway", "d"), ("e3", "delays", "Q", "h", t[0], "bus", "d"),
    ]
    d = clean_alerts(spark.createDataFrame(rows, "event_id string, status_label string, affected string, header string, date timestamp, agency string, description string"), "subway")
    got = sorted((r["event_id"], r["route_id"], r["category"], r["num_updates"], r["description"]) for r in d.collect())
    assert got == [("e1", "A", "Suspension", 2, "d2"), ("e1", "C", "Suspension", 2, "d2"), ("e2", "B", "Other", 0, "d")]


def test_clean_events(spark):
    from tramline.plans.context import city_permits, clean_events

    raw = [
        ("game", "x", "2024-01-01", "22:00", "01:30", 0.9, [("Main St", None, 40.7, -74.0), ("Lost", None, 40.7505, -74.0)]),
        ("none", "x", "2024-01-01", "10:00", "11:00", 0.9, []),
    ]
    e = spark.createDataFrame(raw, "nombre_evento string, tipo string, fecha_inicio string, hora_inicio string, hora_salida_estimada string, score double, paradas_afectadas array<struct<name:string,lines:string,lat:double,lon:double>>")
    st = spark.createDataFrame([("M1N", "MAIN  st", 40.0, -73.0), ("M1", "Main St", 40.0, -73.0), ("L9S", "Other", 40.7509, -74.0)], "stop_id string, stop_name string, stop_lat double, stop_lon double")
    got = sorted((r["stop_id"], r["start_s"], r["end_s"]) for r in clean_events(e, st).collect())
    assert got == [("L9S", 79200, 5400), ("M1N", 79200, 5400)]
    kinds = spark.createDataFrame([("Parade",), ("Special Event",), ("Street Event",), ("Unknown",)], "event_type string")
    assert sorted((r["event_type"], r["score"]) for r in city_permits(kinds).collect()) == [("Parade", 1.0), ("Street Event", 0.8)]
    assert sorted(r["event_type"] for r in city_permits(kinds, live=True).collect()) == ["Parade", "Street Event"]


def test_lag_state_reads_and_writes_the_buckets_of_its_trips(spark, tmp_path, merge=2):
    """Many trips, then batches of one trip: the rows are those of the table form, and such a batch writes one bucket."""
    schema, minute = "trip string, event_id bigint, t bigint, stop string, delay double", 60_000_000
    rows = [(f"trip{i % 40}", i, (1 + i // 40) * minute, "ABCD"[i // 40 % 4], float(i)) for i in range(160)]
    late = [("trip7", 1000 + i, (20 + i) * minute, "EFG"[i % 3], 1.5 * i) for i in range(2)]
    sink = jobs.LagState(str(tmp_path / f"s{merge}"), 10 * minute, late=0, buckets=16, merge=merge)
    for n, part in enumerate([rows[:80], rows[80:], *[[x] for x in late]]):
        sink(spark.createDataFrame(part, schema), n)
        if n == 2:
            sink(spark.createDataFrame(part, schema), n)  # a repeated batch does no harm
    sink.finish(spark)
    ids = lambda df: {r["event_id"]: (r["lag1"], r["lag2"]) for r in df.collect()}
    assert ids(sink.rows(spark)) == ids(jobs.lag_state_batch(spark.createDataFrame(rows + late, schema), 10 * minute))
    buckets = lambda what, n: [x for x in os.listdir(tmp_path / f"s{merge}" / what / f"epoch={n}") if x.startswith("bucket=")]
    assert len(buckets("changes", 0)) > 4 and len(buckets("changes", 3)) == 1
    state = sink.state(spark, spark.createDataFrame([], schema + ", lag1 double, lag2 double, bucket int").schema, 5)
    assert state.count() == 40 and state.filter("trip = 'trip7'").first()["event_id"] == 1001


def test_monitor_rows_over_batches(spark):
    src, path = scratch_path(spark, "monitor"), scratch_path(spark, "monitor-out")
    minute = 60_000_000
    rows = [(i, "ab"[i % 2] if i % 9 else f"alone{i}", (i * 7 % 400) * minute + 1, float(i)) for i in range(120)]
    t = spark.createDataFrame(rows, "id bigint, k string, t bigint, v double")
    assert jobs.deal_in_periods(t, "t", 100 * minute, src, files=2) == 4
    live = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).parquet(src)
    pred = live.select("id", "k", F.timestamp_micros("t").alias("ts"), F.col("v").alias("predicted"))
    came = live.select(F.col("id").alias("actual_id"), "k", F.timestamp_micros("t").alias("actual_ts"), F.col("v").alias("actual"))
    jobs.run_to_table(jobs.monitor_rows(pred, came, "k", "ts", "actual_ts", "10 minutes", "5 minutes", "1 minute"), path)
    got = {r["id"]: r["actual_id"] for r in jobs.nearest_value(spark.read.parquet(path), ["id"], "ts", "actual_ts", "10 minutes", ["actual_id"]).collect()}
    end = max(r[2] for r in rows) - minute
    for i, k, at, _ in rows:
        near = [(abs(x[2] - at - 10 * minute), x[0]) for x in rows if x[1] == k and abs(x[2] - at - 10 * minute) <= 5 * minute]
        if near or at + 15 * minute < end:
            assert got[i] == (min(near)[1] if near else None)
    assert any(v is None for v in got.values())


def test_live_rows_without_sources(spark):
    d = spark.createDataFrame([(1, 2, dt.date(2024, 1, 1), 5, 10)], "id int, route int, day date, sec int, t bigint")
    w = spark.createDataFrame([(dt.date(2024, 1, 1), 9, 1.0, 2.0, 3.0)], "day date, hour int, temp double, rain double, wind double")
    for got in (realtime.enrich_live(d, 100).first(), realtime.enrich_live(d, 100, weather=w).first()):
        assert (got["temp"], got["n_events"], got["event_kind"], got["last_category"]) == (0.0, 0, "Ninguno", None)
