"""Steps whose cost must grow no faster than their input: same results, and work that is dealt out."""

import datetime as dt
import math
import random

from pyspark.sql import functions as F

from tramline.catalog import learning_q
from tramline.operators import asof, intervals, models
from tramline.plans.places import affected_stations
from tramline.streaming import jobs

MINUTE = 60_000_000


def test_monitor_rows_meet_on_stretches(spark):
    """Every pair in range once, and predictions without one; sides meet on more than the key."""
    r = random.Random(3)
    rows = [(i, "ab"[i % 2] if i % 11 else None, r.randrange(0, 90 * MINUTE, MINUTE // 4), float(i)) for i in range(200)]
    t = spark.createDataFrame(rows, "id int, k string, t bigint, v double")
    pred = t.select("id", "k", F.timestamp_micros("t").alias("ts"))
    came = t.select(F.col("id").alias("actual_id"), "k", F.timestamp_micros("t").alias("actual_ts"), "v")
    got = jobs.monitor_rows(pred, came, "k", "ts", "actual_ts", "10 minutes", "2 minutes", "1 minute")
    want = []
    for i, k, at, _ in rows:
        hits = [x[0] for x in rows if k is not None and x[1] == k and abs(x[2] - at - 10 * MINUTE) <= 2 * MINUTE]
        want += [(i, h) for h in hits] or [(i, None)]
    assert got.columns == ["id", "k", "ts", "actual_id", "actual_ts", "v"]
    assert sorted(((x["id"], x["actual_id"]) for x in got.collect()), key=str) == sorted(want, key=str)
    assert "_pw" in got._jdf.queryExecution().optimizedPlan().toString()


def test_state_partitions_follow_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert jobs.state_partitions(spark, 10) == cores
    assert jobs.state_partitions(spark, 50_000 * cores * 3) == 3 * cores


def _metres(a, b):
    p1, p2 = math.radians(a[0]), math.radians(b[0])
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(h, 1.0)))


def test_affected_stations_by_patches(spark):
    """Dense and lone places, the date line, null places, names and lines, repeated ids."""
    r = random.Random(8)
    spots = lambda n, lat, lon, size: [(lat + r.random() * size, lon + r.random() * size) for _ in range(n)]
    far = [(10.0, 179.9999), (10.0, -179.9999), (89.95, 10.0), (89.95, 190.0), (-33.0, 18.0), (None, 5.0), (10.0, None), (float("nan"), 1.0)]
    events = [(i % 150 if i % 40 else None, *at) for i, at in enumerate(spots(160, 40.7, -74.0, 0.06) + far)]
    st = [(i % 6 if i % 13 else None, [f"L{i % 9}", None] if i % 7 else [f"L{i % 4}"], *at) for i, at in enumerate(spots(160, 40.7, -74.0, 0.06) + far)]
    e = spark.createDataFrame(events, "id int, lat double, lon double")
    s = spark.createDataFrame(st, "name int, lines array<string>, stop_lat double, stop_lon double")
    known = lambda at: None not in at and not any(map(math.isnan, at))
    for metres in (300.0, 2000.0):
        want = {}
        for i, *a in events:
            for name, lines, *b in st:
                if known(a) and known(b) and _metres(a, b) <= metres:
                    want.setdefault((i, name), set()).update(lines)
        got = [((x["id"], x["name"]), x["lines"]) for x in affected_stations(e, s, "id", "name", "lines", metres).collect()]
        assert len(got) == len(want) and dict(got) == {k: ", ".join(sorted(v - {None})) for k, v in want.items()}
    labelled = s.withColumn("_l", F.explode("lines"))
    assert intervals.reached_labels(e, labelled, 300.0, ["id"], ["name", "_l"]).count() > 0


def test_training_rows_are_dealt_out(spark, monkeypatch):
    d = spark.range(1000).select((F.col("id") % 7).alias("a"), F.col("id").cast("double").alias("y"), F.lit(1.0).alias("w"), F.lit("x").alias("other")).coalesce(1)
    monkeypatch.setattr(models, "FIT_ROWS", 50)
    got = models._dealt(d, ["a"], "y", "w")
    assert got.columns == ["a", "y", "w"] and got.rdd.getNumPartitions() == 20 and got.count() == 1000
    assert max(got.groupBy(F.spark_partition_id()).count().toPandas()["count"]) <= 60
    monkeypatch.setattr(models, "FIT_ROWS", 5000)
    assert models._dealt(d, ["a"], "y").rdd.getNumPartitions() == 1


def test_horizons_are_dealt_out(spark, monkeypatch):
    """More tasks for more rows, whatever the session's shuffle partitions; the asking rows keep their columns."""
    monkeypatch.setattr(asof, "TASK_ROWS", 50)
    rows = [(i, f"k{i % 5}", i * 3 % 400, float(i), "wide" * 3) for i in range(400)]
    d = spark.createDataFrame(rows, "id int, k string, t int, v double, other string")
    got = asof.value_at_horizons(d, ["k"], "t", "v", {"a": 10, "b": 25}, 6, 40, ["id"])
    assert got.columns == [*d.columns, "a", "b"] and got.rdd.getNumPartitions() == 24
    for x in got.collect():
        for h, name in ((10, "a"), (25, "b")):
            near = [(abs(y[2] - x["t"] - h), y[2]) for y in rows if y[1] == x["k"] and abs(y[2] - x["t"] - h) <= 6]
            assert (x[name] is None) == (not near)
            if near:
                at = min(near)[1]
                assert x[name] in {y[3] for y in rows if y[1] == x["k"] and y[2] == at}


def test_range_join_by_fine_buckets(spark):
    r = random.Random(4)
    pts = [(i, "ab"[i % 2] if i % 9 else None, r.randrange(-50, 500)) for i in range(150)]
    iv = [(i, "ab"[i % 2], lo, lo + r.choice([0, 1, 30, 170])) for i, lo in enumerate(r.randrange(-50, 500) for _ in range(60))]
    p, i = spark.createDataFrame(pts, "id int, k string, t int"), spark.createDataFrame(iv, "iid int, k string, lo int, hi int")
    j = intervals.range_join(p, i, ["k"], "t", "lo", "hi", 100)
    assert sorted((x["id"], x["iid"]) for x in j.collect()) == sorted((a[0], b[0]) for a in pts for b in iv if a[1] == b[1] and b[2] <= a[2] < b[3])
    assert "12.5" in j._jdf.queryExecution().optimizedPlan().toString()


def _events(spark, path, rows):
    """An events table of own rows: (event_id, ts, user_id, event_type, value)."""
    d = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double")
    d.withColumn("props", F.lit(None).cast("string")).write.parquet(f"{path}/events.parquet")
    return str(path)


def test_window_weight_search_is_whole(spark, tmp_path, monkeypatch):
    """Seven windows x four schemes, each fit on all rows of its days with the whole forest's settings."""
    r = random.Random(5)
    rows = [(i, dt.datetime(2024, 1, 1 + i % 28, r.randrange(24), r.randrange(60)), i % 9, "view", r.random() * 90 + 1) for i in range(700)]
    fit, fits = models.fit_forest, []

    def cheap(train, features, label, classify=True, weight=None, **params):
        days = train.groupBy("day").agg(F.count("*").alias("n"), F.round(F.max(weight), 6).alias("w")).orderBy("day").collect()
        fits.append((tuple(x["day"] for x in days), tuple(x["w"] for x in days), sum(x["n"] for x in days), classify, params))
        return model[0] if model else model.append(fit(train, features, label, classify, weight, numTrees=1, maxDepth=1)) or model[0]

    model = []
    monkeypatch.setattr(models, "fit_forest", cheap)
    got = learning_q.window_weight_search(spark, _events(spark, tmp_path, rows)).collect()
    assert len(got) == len(fits) == 28 and len({(x["months"], x["scheme"]) for x in got}) == 28
    assert {len(x[0]) for x in fits} == {2, 3, 4, 5, 7, 10, 19} and len({x[:2] for x in fits}) == 27  # over two days linear and step agree
    assert all(x[0][-1] == dt.date(2024, 1, 19) for x in fits) and not any(x[3] for x in fits)
    tr, _ = learning_q.learning_rows(spark, str(tmp_path))
    assert max(x[2] for x in fits) == tr.count()
    assert all(x[4]["numTrees"] >= 20 and x[4]["maxDepth"] >= 8 for x in fits)


def test_range_join_by_tiles(spark, tmp_path):
    """More intervals than a tile holds, empty and turned intervals, null keys; the result takes a small part of a byte a row on disk."""
    r = random.Random(6)
    pts = [(i, "ab"[i % 2] if i % 9 else None, r.randrange(0, 60)) for i in range(120)]
    iv = [(i, "ab"[i % 2] if i % 50 else None, lo, lo + r.choice([-5, 0, 3, 40])) for i, lo in enumerate(r.randrange(-10, 60) for _ in range(900))]
    p, i = spark.createDataFrame(pts, "id int, k string, t int"), spark.createDataFrame(iv, "iid int, k string, lo int, hi int")
    j = intervals.range_join(p, i, ["k"], "t", "lo", "hi", 80)
    assert j.columns == ["id", "k", "t", "iid", "lo", "hi"]
    assert sorted((x["id"], x["iid"]) for x in j.collect()) == sorted((a[0], b[0]) for a in pts for b in iv if a[1] and a[1] == b[1] and b[2] <= a[2] < b[3])
    p = spark.range(2000).select("id", F.lit("a").alias("k"), (F.col("id") % 97).alias("t"))
    i = spark.range(505).select(F.col("id").alias("iid"), F.lit("a").alias("k"), F.lit(0).alias("lo"), F.lit(97).alias("hi"))
    intervals.range_join(p, i, ["k"], "t", "lo", "hi", 1000).select("iid", "id").write.parquet(f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.count() == got.distinct().count() == 2000 * 505
    assert sum(x.stat().st_size for x in (tmp_path / "out").glob("*.parquet")) < 2000 * 505 / 4


def test_monitor_rows_that_can_be_nearest(spark, monkeypatch):
    """The nearest value of every prediction as of all pairs, from a small part of them; ties, equal instants, nulls and cells cut between tasks."""
    r = random.Random(9)
    rows = [(i, "ab"[i % 2] if i % 11 else None, r.randrange(0, 30 * MINUTE, 5_000_000) if i % 50 else None) for i in range(900)] + [(1000 + i, "alone", i * 13 * MINUTE) for i in range(4)]
    t = spark.createDataFrame(rows, "id int, k string, t bigint")
    pred = t.select("id", "k", F.timestamp_micros("t").alias("ts"))
    came = t.select(F.col("id").alias("actual_id"), "k", F.timestamp_micros("t").alias("actual_ts"))
    want = {}
    for i, k, at in rows:
        hits = [(abs(x[2] - at - 10 * MINUTE), x[0]) for x in rows if None not in (k, at, x[2]) and x[1] == k and abs(x[2] - at - 10 * MINUTE) <= 2 * MINUTE]
        want[i] = (len(hits), min(hits)[1] if hits else None)

    def formed(cell):
        d = jobs.monitor_rows(pred, came, "k", "ts", "actual_ts", "10 minutes", "2 minutes", "1 minute", ["actual_id"], cell).persist()
        got = {x["id"]: x["actual_id"] for x in jobs.nearest_value(d, ["id"], "ts", "actual_ts", "10 minutes", ["actual_id"]).collect()}
        assert d.columns == ["id", "k", "ts", "actual_id", "actual_ts"] and got == {i: w[1] for i, w in want.items()}
        n = d.filter("actual_id is not null").count()
        assert n == d.filter("actual_id is not null").distinct().count()
        return n

    pairs = sum(w[0] for w in want.values())
    cell = jobs.nearest_cell(410, 30 * MINUTE, 2 * MINUTE)
    assert 0.5 * MINUTE < cell < MINUTE and formed(cell) < pairs / 2
    assert formed(7 * MINUTE) <= pairs
    monkeypatch.setattr(jobs, "MARK_ROWS", 7)
    assert formed(cell) <= pairs
