"""Scalar, text and cleaning functions with hand-computed values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tramline.functions import scalars as sc
from tramline.functions import text as tx
from tramline.operators import aggregates, clean, prep, ranking
from tramline.sources import feeds


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def lit(v, t="string"):
    return F.lit(v).cast(t)


@pytest.mark.parametrize("text,want", [("25:10:00", 90600), ("07:05", 25500), ("00:00:59", 59), ("x", None), (None, None), ("12:aa:00", None)])
def test_clock_to_seconds(spark, text, want):
    assert one(spark, sc.clock_to_seconds(lit(text))) == want


@pytest.mark.parametrize("s,want", [(0, "00:00:00"), (86399, "23:59:59"), (90600, "01:10:00"), (-60, "23:59:00"), (None, None)])
def test_seconds_to_clock(spark, s, want):
    assert one(spark, sc.seconds_to_clock(lit(s, "double"))) == want


@pytest.mark.parametrize("d,want", [(60 - 86340, 120), (86340 - 60, -120), (43200, 43200), (-43200, -43200), (None, None)])
def test_wrap_delay(spark, d, want):
    assert one(spark, sc.wrap_delay(lit(d, "int"))) == want


@pytest.mark.parametrize("v,want", [(-61, 0), (-60, 0), (-59, 1), (60, 1), (60.5, 2), (450, 4), (451, 5), (None, None)])
def test_delay_class_is_right_closed(spark, v, want):
    assert one(spark, sc.bin_interval(lit(v, "double"), sc.DELAY_CLASS_EDGES)) == want


def test_local_seconds_in_both_clock_changes(spark):
    at = lambda *a: int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp())
    f = lambda e: one(spark, sc.epoch_to_local_seconds(lit(e, "bigint"), "America/New_York"))
    assert f(at(2024, 3, 10, 6, 59, 59)) == 2 * 3600 - 1
    assert f(at(2024, 3, 10, 7)) == 3 * 3600
    assert f(at(2024, 11, 3, 5, 30)) == f(at(2024, 11, 3, 6, 30)) == 5400


def test_keys(spark):
    assert one(spark, sc.trip_key(lit("SIR-FA2017-SI017-Weekday-08_147100_SI..N03R"))) == "147100_SI..N03R"
    assert one(spark, sc.trip_key(lit("nothing"))) is None
    assert one(spark, sc.service_day(lit("SIR-FA2017-SI017-Weekday-08_147100_SI..N03R"))) == "Weekday"
    assert one(spark, sc.short_trip(lit("A_147100_SI..N03R"))) == "147100_SI..N03R"


@pytest.mark.parametrize("key,want", [("145650_1..S03R", "1"), ("145650_SI..N03R", "SI"), ("145650_SIR..N", None), ("145650", None), ("1_.x", None)])
def test_route_from_key(spark, key, want):
    assert one(spark, tx.route_from_key(lit(key))) == want


@pytest.mark.parametrize(
    "route,trip,want",
    [("6", "x", "6"), ("5-extra", "x", "5"), ("SI", "x", "SIR"), ("SS", "1_5X..N_A..S", "A"), (None, "AFA-1_135700_5..N06R", "5"), ("6X", "x", None)],
)
def test_canonical_route(spark, route, trip, want):
    assert one(spark, tx.canonical_route(lit(route), lit(trip))) == want


@pytest.mark.parametrize("status,want", [("delays | suspended", "Suspension"), ("Severe-Delays", "Severe Delay"), ("delays", "Delay"), ("stops-skipped", "Service Change"), ("Cancellations", "Cancellation"), (None, "Other"), ("x", "Other")])
def test_alert_category(spark, status, want):
    assert one(spark, tx.alert_category(lit(status))) == want


def test_classify_alert_text(spark):
    html = "<html><style>A B</style><body><p>[C] and E trains are delayed at <b>Canal Street</b> &amp; held:</p><script>var D=1</script> signal problems é1 A</body></html>"
    r = tx.classify_alert_text(spark.createDataFrame([(1, html)], "id int, body string"), "body").first()
    assert (r["category"], r["lines"], r["reason"], r["location"]) == ("Delay", "A, C, E", "Signal Problems", "Canal Street")
    assert r["text_snippet"].startswith("[C] and E trains are delayed at Canal Street & held:")


def test_long_text_is_read_whole(spark):
    body = "word " * 5000 + "service resolved"
    r = tx.classify_alert_text(spark.createDataFrame([(1, body)], "id int, body string"), "body").first()
    assert r["category"] == "Service Resumed" and len(r["text_snippet"]) == 500


def test_flags(spark):
    f = tx.alert_flags(F.lit("Delay"), F.lit("planned work, delay"))
    assert [one(spark, f[k]) for k in ("is_delay_alert", "is_planned_work", "is_unplanned_shock")] == [1, 1, 0]
    assert one(spark, tx.incident_group(F.lit("x"), F.lit("Police investigation"))) == "unplanned"


def test_split_and_intersections(spark):
    assert one(spark, tx.split_lines(F.lit("a , C|| e"))) == ["A", "C", "E"]
    got = one(spark, tx.intersections(F.lit("5 AVE between E 1 ST and E 2 ST, PARK"), F.lit("Manhattan")))
    assert got == ["5 AVE & E 1 ST, Manhattan, New York", "5 AVE & E 2 ST, Manhattan, New York"]
    assert one(spark, tx.intersections(F.lit("PARK"), F.lit("Bronx"))) == ["PARK, Bronx, New York"]


def test_outliers_keep_nulls_and_bounds(spark):
    d = spark.createDataFrame([(9000.0,), (9001.0,), (-9000.0,), (None,)], "v double")
    assert sorted(str(r[0]) for r in clean.filter_outliers(d, "v").collect()) == ["-9000.0", "9000.0", "None"]


def test_zscore_small_constant_and_outlier(spark):
    rows = [("few", float(v)) for v in (0, 0, 0, 0, 999)] + [("flat", 5.0)] * 8 + [("out", 1.0)] * 20 + [("out", 500.0), ("out", None)]
    got = clean.zscore_filter(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).groupBy("g").count().collect()
    assert {r["g"]: r["count"] for r in got} == {"few": 5, "flat": 8, "out": 20}


def test_dedup_null_equals_null(spark):
    d = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "k string, o int")
    assert sorted(r["o"] for r in clean.dedup(d, ["k"], ["o"]).collect()) == [1, 3]


def test_reject_bad_match(spark):
    d = spark.createDataFrame([(1, 3600.0, 5), (2, 3601.0, 6), (3, None, 7)], "i int, delay double, s int")
    got = {r["i"]: (r["delay"], r["s"], r["is_unscheduled"]) for r in clean.reject_bad_match(d, "delay", ["delay", "s"]).collect()}
    assert got == {1: (3600.0, 5, False), 2: (None, None, True), 3: (None, None, True)}


def test_require(spark):
    with pytest.raises(ValueError, match="absent"):
        clean.require(spark.range(1), ["absent"])


def test_snapshot_bin(spark):
    d = spark.createDataFrame([(0,), (449,), (450,), (899,)], "t int")
    assert [r[0] for r in d.select(aggregates.snapshot_bin(F.col("t"), 900)).collect()] == [-900, -900, 0, 0]


def test_window_aggregate_null_rules(spark):
    rows = [("s", "r", "N", 10, None, 50_000.0, None), ("s", "r", "N", 20, None, 10.0, None), ("s", None, "N", 20, 1.0, 10.0, 1)]
    d = spark.createDataFrame(rows, "stop_id string, route_id string, direction string, t bigint, delay_seconds double, target_delay_30m double, num_updates int")
    r = aggregates.window_aggregate(d, "t", 60).collect()
    assert len(r) == 1 and r[0]["delay_seconds_mean"] is None and r[0]["num_updates_sum"] == 0 and r[0]["target_delay_30m_max"] == 10.0


def test_flatten_feed(spark):
    msg = '{"trip":{"trip_id":"a","route_id":"5"},"stop_time_update":[{"stop_id":"x","arrival":{"time":0}},{"stop_id":"y","arrival":{"time":7},"departure":{"time":9}}],"timestamp":3}'
    d = spark.createDataFrame([(msg,), ('{"trip":{"trip_id":"b"},"stop_time_update":[]}',)], "j string").select(F.from_json("j", feeds.TRIP_UPDATE).alias("m")).select("m.*")
    got = [(r["stop_id"], r["arrival_time"], r["departure_time"]) for r in feeds.flatten_trip_updates(d).orderBy("seq").collect()]
    assert got == [("x", None, None), ("y", 7, 9)]


def test_weights_have_mean_one(spark):
    d = spark.createDataFrame([(m,) for m in ("2024-01", "2024-02", "2024-03")], "month string")
    for s in ("uniform", "linear", "exponential", "step"):
        w = [r["weight"] for r in prep.recency_weights(d, "month", s).orderBy("month").collect()]
        assert sum(w) / 3 == pytest.approx(1.0)
        assert s != "exponential" or w[2] / w[0] == pytest.approx(10.0)


def test_splits_are_disjoint_and_whole(spark):
    d = spark.range(97).withColumn("t", F.col("id") * 3)
    got = {r["split"]: r["count"] for r in ranking.split_by_rows(d, ["t"], (0.7, 0.85), ("a", "b", "c"), 20).groupBy("split").count().collect()}
    assert got == {"a": 67, "b": 15, "c": 15}


def test_vocabulary_is_alphabetical(spark):
    d = spark.createDataFrame([("b",), ("a",), ("abcd1",), ("abcd0",), ("b",), (None,)], "k string")
    assert {r["k"]: r["code"] for r in prep.vocabulary(d, "k").collect()} == {"a": 0, "abcd0": 1, "abcd1": 2, "b": 3}


def test_missing_predictions_stay_missing(spark):
    from tramline.functions.scalars import present_delay
    from tramline.plans import questions

    d = spark.createDataFrame([(-60.0, "a"), (None, "a"), (120.0, "a"), (None, "b")], "v double, stop string")
    assert [r[0] for r in d.select(present_delay("v")).collect()] == [0.0, None, 2.0, None]
    assert questions.current_delay(d, "stop", "b", "v").first().delay_seconds is None
    assert sorted(r.delay_seconds for r in questions.delay_predictions(d, "v", minimum=0).collect()) == [0.0, 120.0]


def test_months_in_number_order(spark):
    from tramline.operators.prep import month_number, recency_weights

    labels = [f"w{i}" for i in (1, 2, 9, 10, 11)]
    d = spark.createDataFrame([(x,) for x in labels], "m string")
    got = {r.m: r.weight for r in recency_weights(d, "m", "linear").collect()}
    assert sorted(labels, key=got.get) == labels and sorted(labels, key=month_number)[-2:] == ["w10", "w11"]


def test_window_weight_fits_equal_weighted_least_squares(spark):
    import random

    import numpy as np

    from tramline.operators import models

    r = random.Random(4)
    rows = [(f"w{i % 9}", r.gauss(0, 2), float(r.randrange(5)), None if i % 50 == 0 else r.gauss(0, 1)) for i in range(900)]
    rows = [(p, a, b, None if e is None else 3 + 2 * a - b * int(p[1]) + e) for p, a, b, e in rows]
    d = spark.createDataFrame(rows, "p string, a double, b double, y double")
    train, valid = d.filter("p < 'w7'"), d.filter("p >= 'w7'")
    got = {(x["window"], x["scheme"]): x for x in models.window_weight_fits(train, valid, "p", range(1, 8), ["uniform", "linear", "exponential", "step"], ["a", "b"], "y").collect()}
    assert len(got) == 28
    test = [x for x in rows if x[0] >= "w7" and x[3] is not None]
    for (n, scheme), x in got.items():
        part = [z for z in rows if f"w{7 - n}" <= z[0] < "w7" and z[3] is not None]
        w = models.scheme_weights(n, scheme)[[int(z[0][1]) - (7 - n) for z in part]]
        m = np.array([[1, z[1], z[2]] for z in part])
        beta = np.linalg.lstsq(m * np.sqrt(w)[:, None], np.array([z[3] for z in part]) * np.sqrt(w), rcond=None)[0]
        off = np.array([z[3] - beta @ [1, z[1], z[2]] for z in test])
        assert x["coefficients"] == pytest.approx(beta.tolist()) and x["n_train"] == len(part)
        assert (x["test_mae"], x["test_rmse"]) == pytest.approx((np.abs(off).mean(), np.sqrt((off**2).mean())))
        assert x["train_rmse"] == pytest.approx(np.sqrt(np.mean([(z[3] - beta @ [1, z[1], z[2]]) ** 2 for z in part])))
    best = {x["strategy"]: x for x in models.compare_strategies(train, valid, ["a", "b"], "y", {"a": ["a"], "both": ["a", "b"]}, [0.0, 5.0], 2).collect()}
    assert best["grid"]["valid_rmse"] <= min(best["plain"]["valid_rmse"], best["random"]["valid_rmse"]) and best["grid"]["candidates"] == 4
    assert models.window_weight_fits(train.limit(0), valid, "p", [1, 2], ["uniform"], ["a"], "y").count() == 0


def test_recency_weights_agree_with_scheme_weights(spark):
    from tramline.operators import models

    d = spark.createDataFrame([(f"2024-{m:02d}",) for m in range(1, 6)], "month string")
    for scheme in ("uniform", "linear", "exponential", "step"):
        got = [r["weight"] for r in prep.recency_weights(d, "month", scheme).orderBy("month").collect()]
        assert got == pytest.approx(models.scheme_weights(5, scheme).tolist())


def test_largest_eigenvalue_of_a_dense_graph(spark):
    import random

    import numpy as np

    from tramline.operators import graph

    r, n = random.Random(3), 12
    a = np.array([[r.random() if i != j else 0.0 for j in range(n)] for i in range(n)])
    a = (a + a.T) / 2
    d = a.sum(1)
    a = a / np.sqrt(np.outer(d, d))
    edges = spark.createDataFrame([(f"s{i}", f"s{j}", float(a[i, j])) for i in range(n) for j in range(n) if i != j], "src string, dst string, weight double")
    true = float(np.linalg.eigvalsh(np.eye(n) - a).max())
    few, many = (graph.largest_eigenvalue(edges, k).first()[0] for k in (2, 12))
    assert few <= many + 1e-9 <= true + 1e-6 and many > 0.95 * true
    signal = spark.createDataFrame([(f"s{i}", float(i)) for i in range(n)], "node string, x double")
    got = {x["node"]: x["t1"] for x in graph.chebyshev_features(signal, edges, "node", "x", [], 1, None).collect()}
    lam = graph.largest_eigenvalue(edges).first()[0]
    want = 2 / lam * (np.eye(n) - a) @ np.arange(n) - np.arange(n)
    assert [got[f"s{i}"] for i in range(n)] == pytest.approx(want.tolist())
    assert graph.largest_eigenvalue(edges.limit(0)).first()[0] == 2.0


def test_weather_by_line_kind(spark):
    rows = [("7", 1, 0, 5.0), ("7", 1, 1, 7.0), ("A", 1, None, 3.0), (None, 1, 0, 9.0), ("A", 0, 0, 100.0)]
    d = spark.createDataFrame(rows, "line string, wet int, hot int, v double")
    got = {(r["flag"], r["is_exterior"]): (r["q1"], r["median"], r["outliers"]) for r in aggregates.weather_by_line_kind(d, ["wet", "hot"], "line", "v").collect()}
    assert got == {("wet", True): (5.5, 6.0, 0), ("wet", False): (4.5, 6.0, 0), ("hot", True): (7.0, 7.0, 0)}
