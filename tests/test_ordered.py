"""Chunked operators against brute force: ties, nulls, hot keys, borders, any chunk width."""

import random

import pytest
from pyspark.sql import functions as F

from tramline.operators import asof, dominance, intervals, joins, metrics, prep, quantiles, ranking, windows
from tramline.operators.ordered import CHUNK, Stretches, chunk_of, chunk_width, last_known, lookback_sums, positions, prior_rows, row_index, running_sums, stretches, sums_until


def skewed(n=400, seed=1, span=5_000):
    """A hot key with half of the rows, equal times, null values, null keys."""
    r = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if r.random() < 0.5 else r.choice(["a", "b", "c", None])
        rows.append((i, k, r.randrange(0, span) // 7 * 7, None if r.random() < 0.2 else float(r.randrange(-50, 50))))
    return rows


SCHEMA = "id bigint, k string, t bigint, v double"
ROWS = skewed()


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(4)


def series():
    out = {}
    for row in sorted(ROWS, key=lambda r: (r[2], r[0])):
        out.setdefault(row[1], []).append(row)
    return out


@pytest.mark.parametrize("width", [3, 50, 700, 10**6])
def test_prior_rows_any_chunk(df, width):
    got = {r["id"]: r["p"] for r in prior_rows(df, ["k"], ["t", "id"], ["v"], 3, width, "p").collect()}
    for k, rows in series().items():
        for i, row in enumerate(rows):
            want = [x[3] for x in rows[max(0, i - 3) : i]] if k is not None else []
            assert [x["v"] for x in got[row[0]]] == want


@pytest.mark.parametrize("width", [3, 50, 10**6])
def test_following_rows(df, width):
    got = {r["id"]: r["next_id"] for r in windows.next_stop(df, ["k"], ["t", "id"], ["id"], width).collect()}
    for k, rows in series().items():
        for i, row in enumerate(rows):
            want = rows[i + 1][0] if k is not None and i + 1 < len(rows) else None
            assert got[row[0]] == want


@pytest.mark.parametrize("width", [3, 90, 10**6])
def test_fill_and_running(df, width):
    fwd = {r["id"]: r["f"] for r in last_known(df, ["k"], ["t", "id"], "v", width, "f").collect()}
    bwd = {r["id"]: r["f"] for r in last_known(df, ["k"], ["t", "id"], "v", width, "f", reverse=True).collect()}
    run = {r["id"]: (r["n"], r["s"]) for r in running_sums(df, ["k"], ["t", "id"], {"n": F.lit(1), "s": F.col("v")}, width).collect()}
    for k, rows in series().items():
        if k is None:
            continue
        last, total = None, 0.0
        for i, row in enumerate(rows):
            last = row[3] if row[3] is not None else last
            total += row[3] or 0.0
            assert fwd[row[0]] == last
            assert run[row[0]] == (i + 1, total)
        nxt = None
        for row in reversed(rows):
            nxt = row[3] if row[3] is not None else nxt
            assert bwd[row[0]] == nxt


def test_global_row_index(df):
    got = {r["id"]: r["row_index"] for r in row_index(df, [], ["t", "id"], 100).collect()}
    for i, row in enumerate(sorted(ROWS, key=lambda r: (r[2], r[0]))):
        assert got[row[0]] == i + 1


def test_null_time_sorts_last(spark):
    d = spark.createDataFrame([(1, "a", 5, 1.0), (2, "a", None, 2.0), (3, "a", 1, 3.0)], SCHEMA)
    got = {r["id"]: [x["v"] for x in r["p"]] for r in prior_rows(d, ["k"], ["t", "id"], ["v"], 2, 2, "p").collect()}
    assert got == {3: [], 1: [3.0], 2: [3.0, 1.0]}


@pytest.mark.parametrize("closed", ["left", "both"])
@pytest.mark.parametrize("span", [14, 500])
def test_lookback(df, closed, span):
    sums = {"n": F.lit(1).cast("bigint"), "s": F.col("v")}
    got = {r["id"]: (r["n"], r["s"]) for r in lookback_sums(df, df, ["k"], "t", "t", span, sums, closed).collect()}
    for k, rows in series().items():
        if k is None:
            continue
        for row in rows:
            hit = [x for x in rows if row[2] - span <= x[2] < row[2] or (closed == "both" and x[2] == row[2])]
            assert got[row[0]] == (len(hit), sum(x[3] or 0.0 for x in hit))


@pytest.mark.parametrize("inclusive", [True, False])
def test_sums_until(df, inclusive):
    got = {r["id"]: (r["n"], r["s"]) for r in sums_until(df, df, ["k"], "t", "t", {"n": F.lit(1), "s": F.col("v")}, 33, inclusive).collect()}
    for k, rows in series().items():
        if k is None:
            continue
        for row in rows:
            hit = [x for x in rows if x[2] < row[2] or (inclusive and x[2] == row[2])]
            assert got[row[0]] == (len(hit), sum(x[3] or 0.0 for x in hit))


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width,tol", [(5, None), (400, 40), (10**6, None)])
def test_asof(df, spark, forward, strict, width, tol):
    right = [(100 + i, r[1], r[2] // 2 * 2, float(i)) for i, r in enumerate(skewed(90, 7))]
    rdf = spark.createDataFrame(right, "rid bigint, k string, at bigint, w double")
    fn = asof.asof_forward if forward else asof.asof_backward
    got = {r["id"]: r["x_rid"] for r in fn(df, rdf, ["k"], "t", "at", ["rid"], ["rid"], width, strict, tol, "x_").collect()}
    assert len(got) == len(ROWS)
    for i, k, t, _ in ROWS:
        c = [x for x in right if k is not None and x[1] == k and ((x[2] > t if strict else x[2] >= t) if forward else (x[2] < t if strict else x[2] <= t))]
        c = [x for x in c if tol is None or abs(x[2] - t) <= tol]
        want = None
        if c:
            want = min(c, key=lambda x: (x[2], x[0]))[0] if forward else max(c, key=lambda x: (x[2], x[0]))[0]
        assert got[i] == want


@pytest.mark.parametrize("width", [20, 1000])
def test_nearest_at_horizons(df, width):
    hz = {"h0": 30, "h1": 301, "hm": -60}
    got = {r["id"]: r for r in asof.value_at_horizons(df, ["k"], "t", "v", hz, 9, width, ["id"]).collect()}
    for i, k, t, _ in ROWS:
        for name, h in hz.items():
            c = [x for x in ROWS if k is not None and x[1] == k and x[3] is not None and abs(x[2] - t - h) <= 9]
            want = None
            if c:
                back = [x for x in c if x[2] <= t + h]
                fwd = [x for x in c if x[2] >= t + h]
                b = max(back, key=lambda x: (x[2], x[0])) if back else None
                f = min(fwd, key=lambda x: (x[2], x[0])) if fwd else None
                want = (b if f is None or (b is not None and t + h - b[2] <= f[2] - t - h) else f)[3]
            assert got[i][name] == want


def test_nearest_tie_takes_earlier(spark):
    d = spark.createDataFrame([(1, "a", 0, 1.0), (2, "a", 95, 5.0), (3, "a", 105, 7.0)], SCHEMA)
    got = {r["id"]: r["h"] for r in asof.value_at_horizons(d, ["k"], "t", "v", {"h": 100}, 10, 50, ["id"]).collect()}
    assert got[1] == 5.0


@pytest.mark.parametrize("pad", [40, 150])
def test_join_events_bruteforce(df, spark, pad):
    r = random.Random(3)
    ev = [(i, r.choice(["hot", "hot", "a"]), s := r.randrange(0, 5000), s + r.choice([0, 10, 300, 900]), float(r.randrange(4)) if r.random() < 0.9 else None, r.choice(["x", "y", None])) for i in range(60)]
    e = spark.createDataFrame(ev, "eid int, k string, s bigint, e bigint, score double, kind string")
    got = {x["id"]: x for x in intervals.join_events(df, e, ["k"], "t", "s", "e", "kind", "score", pad).collect()}
    assert len(got) == len(ROWS)
    for i, k, t, _ in ROWS:
        near = [x for x in ev if x[1] == k and x[2] - pad <= t <= x[3] + pad]
        assert got[i]["n_events"] == len(near)
        assert got[i]["n_before"] == sum(t < x[2] for x in near)
        assert got[i]["n_during"] == sum(x[2] <= t <= x[3] for x in near)
        assert got[i]["n_after"] == sum(t > x[3] for x in near)
        want = max(((x[4] or 0.0, x[5] or "Desconocido") for x in near), default=(0, "Ninguno"))[1]
        assert got[i]["event_kind"] == want


def test_event_past_midnight(spark):
    tr = spark.createDataFrame([(1, "a", 86_000, 0.0)], SCHEMA)
    e = spark.createDataFrame([("a", 82_800, 1_800, 0.9, "x")], "k string, s bigint, e bigint, score double, kind string")
    got = intervals.join_events(tr, e, ["k"], "t", "s", "e", "kind", "score").first()
    assert (got["n_events"], got["n_during"], got["event_kind"]) == (1, 1, "x")


def test_quantiles_match_percentile(df):
    want = {r["k"]: r["q"] for r in df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5), F.lit(0.95))).alias("q")).collect()}
    got = {r["k"]: [r["a"], r["b"], r["c"]] for r in quantiles.exact_quantiles(df, ["k"], "v", {"a": 0.1, "b": 0.5, "c": 0.95}).collect()}
    for k, q in want.items():
        if k is not None:
            assert got[k] == pytest.approx(q)


def test_quantile_of_one_and_none(spark):
    d = spark.createDataFrame([("a", 3.0), ("b", None)], "k string, v double")
    got = quantiles.exact_quantiles(d, ["k"], "v", {"q": 0.9}).collect()
    assert [(r["k"], r["q"]) for r in got] == [("a", 3.0)]


def test_bins_keep_ties_together(spark):
    d = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5]], "v double")
    bins = {}
    for r in quantiles.quantile_bins(d, "v", 4).collect():
        bins.setdefault(r["v"], set()).add(r["bin"])
    assert all(len(b) == 1 for b in bins.values())


def test_auc_ties_and_one_class(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.9), ("a", 1, 0.4), ("a", 0, 0.1), ("b", 1, 0.5)]
    got = {r["g"]: r for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, y int, s double"), "y", "s", ["g"]).collect()}
    pairs = [(1.0 if p > n else 0.5 if p == n else 0.0) for p in (0.9, 0.4) for n in (0.9, 0.1)]
    assert got["a"]["roc_auc"] == pytest.approx(sum(pairs) / 4)
    assert got["a"]["average_precision"] == pytest.approx(0.5 * 0.5 + 0.5 * 2 / 3)
    assert got["b"]["roc_auc"] is None


def test_radius_join_bruteforce(spark):
    r = random.Random(5)
    pts = [(i, 40.7 + r.random() * 0.05, -74.0 + r.random() * 0.05) for i in range(80)]
    st = [(i, 40.7 + r.random() * 0.05, -74.0 + r.random() * 0.05) for i in range(80)]
    p = spark.createDataFrame(pts, "pid int, lat double, lon double")
    s = spark.createDataFrame(st, "sid int, stop_lat double, stop_lon double")
    got = {(x["pid"], x["sid"]) for x in intervals.radius_join(p, s, 500.0).collect()}
    import math

    def dist(a, b):
        p1, p2 = math.radians(a[1]), math.radians(b[1])
        h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(h))

    assert got == {(a[0], b[0]) for a in pts for b in st if dist(a, b) <= 500.0}


def test_plan_has_no_unsplit_window(df):
    plan = asof.asof_backward(df, df.withColumnRenamed("t", "at"), ["k"], "t", "at", ["v"], ["id"], 50)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


NULLS = [(i, "k" if i % 3 else None, t, float(t) if t % 2 else None) for i, t in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 11, 12])]


@pytest.mark.parametrize("width", [2, 5, 1000])
def test_null_keys_have_no_neighbours(spark, width):
    d = spark.createDataFrame(NULLS, SCHEMA)
    alone = [r for r in NULLS if r[1] is None]
    by = {r[0]: r for r in NULLS}

    def nulls(df, col):
        return {r["id"]: r[col] for r in df.collect() if by[r["id"]][1] is None}

    o = ["t", "id"]
    assert nulls(prior_rows(d, ["k"], o, ["v"], 2, width, "p"), "p") == {r[0]: [] for r in alone}
    assert nulls(last_known(d, ["k"], o, "v", width, "f"), "f") == {r[0]: r[3] for r in alone}
    assert nulls(last_known(d, ["k"], o, "v", width, "f", inclusive=False), "f") == {r[0]: None for r in alone}
    assert nulls(row_index(d, ["k"], o, width), "row_index") == {r[0]: 1 for r in alone}
    assert nulls(running_sums(d, ["k"], o, {"s": F.col("v")}, width, exclusive=True), "s") == {r[0]: 0 for r in alone}
    assert nulls(lookback_sums(d, d, ["k"], "t", "t", width, {"n": F.lit(1)}, "both"), "n") == {r[0]: 0 for r in alone}
    assert nulls(sums_until(d, d, ["k"], "t", "t", {"n": F.lit(1)}, width, inclusive=True), "n") == {r[0]: 0 for r in alone}
    assert nulls(asof.asof_backward(d, d.select("k", F.col("t").alias("rt")), ["k"], "t", "rt", width=width), "last_rt") == {r[0]: None for r in alone}
    ev = d.select("k", F.col("t").alias("s"), F.col("t").alias("e"), F.lit("x").alias("kind"), F.lit(1.0).alias("score"))
    assert nulls(intervals.join_events(d, ev, ["k"], "t", "s", "e", "kind", "score", pad=width), "n_events") == {r[0]: 0 for r in alone}


def test_chunk_width_bounds_a_hot_key(spark):
    """One key holds half of the rows; no (key, chunk) group passes the target, and a wider one would."""
    r = random.Random(9)
    rows = [("hot" if i % 2 else f"k{i % 40}", r.randrange(0, 100_000)) for i in range(8_000)] + [(None, 5)] * 900 + [("x", None)]
    d = spark.createDataFrame(rows, "k string, t bigint")
    for target in (50, 300, 10**6):
        w = chunk_width(d, ["k"], "t", 64, target)
        sizes = lambda w: max(d.filter("k is not null and t is not null").groupBy("k", F.floor(F.col("t") / w)).count().toPandas()["count"])
        assert sizes(w) <= target and (target == 10**6 or sizes(2 * w) > target)
    assert chunk_width(d.limit(0), ["k"], "t", 64) >= 64


def test_radius_join_over_the_date_line(spark):
    p = spark.createDataFrame([(1, 10.0, 179.9999), (2, 89.9, 10.0), (3, -20.0, -179.9999)], "pid int, lat double, lon double")
    s = spark.createDataFrame([(1, 10.0, -179.9999), (2, 89.9, 10.001), (3, -20.0, 179.9999), (4, 0.0, 0.0)], "sid int, stop_lat double, stop_lon double")
    got = {(x["pid"], x["sid"]) for x in intervals.radius_join(p, s, 100.0).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


@pytest.mark.parametrize("width", [7, 40, 10**6])
def test_lookback_in_sub_blocks(df, spark, width):
    """A key with half of the rows is split below the span; own rows and another table's rows."""
    sums = {"n": F.lit(1).cast("bigint"), "s": F.col("v")}
    other = [(i, r[1], r[2] + 3, r[3]) for i, r in enumerate(skewed(120, 8))]
    odf = spark.createDataFrame(other, SCHEMA)
    for closed in ("left", "both"):
        own = {r["id"]: (r["n"], r["s"]) for r in lookback_sums(df, df, ["k"], "t", "t", 360, sums, closed, width).collect()}
        far = {r["id"]: (r["n"], r["s"]) for r in lookback_sums(df, odf, ["k"], "t", "t", 360, sums, closed, width).collect()}
        for i, k, t, _ in ROWS:
            for got, table in ((own, ROWS), (far, other)):
                hit = [x for x in table if k is not None and x[1] == k and (t - 360 <= x[2] < t or (closed == "both" and x[2] == t))]
                assert got[i] == (len(hit), sum(x[3] or 0.0 for x in hit))


@pytest.mark.parametrize("width", [11, 80])
def test_join_events_in_narrow_chunks(df, spark, width):
    r = random.Random(4)
    ev = [(i, r.choice(["hot", "hot", "a", None]), s := r.randrange(0, 5000), s + r.choice([0, 10, 300, 900]), float(r.randrange(4)), r.choice(["x", "y"])) for i in range(60)]
    e = spark.createDataFrame(ev, "eid int, k string, s bigint, e bigint, score double, kind string")
    got = {x["id"]: x for x in intervals.join_events(df, e, ["k"], "t", "s", "e", "kind", "score", 100, width).collect()}
    for i, k, t, _ in ROWS:
        near = [x for x in ev if k is not None and x[1] == k and x[2] - 100 <= t <= x[3] + 100]
        want = (len(near), sum(t < x[2] for x in near), sum(x[2] <= t <= x[3] for x in near), max(((x[4], x[5]) for x in near), default=(0, "Ninguno"))[1])
        assert (got[i]["n_events"], got[i]["n_before"], got[i]["n_during"], got[i]["event_kind"]) == want


@pytest.mark.parametrize("base", [2, 16])
def test_dominance_counts(df, spark, base):
    r = random.Random(12)
    pts = [(k, t, r.randrange(0, 5000)) for _, k, t, _ in ROWS] + [("hot", None, 3), ("hot", 3, None)]
    ask = [(i, r.choice(["hot", "a", "zz", None]), r.randrange(-10, 6000), r.choice([None, r.randrange(-10, 5100)])) for i in range(120)]
    p = spark.createDataFrame(pts, "k string, x bigint, y bigint")
    q = spark.createDataFrame(ask, "id int, k string, px bigint, py bigint")
    for width in (300, 10**6):
        got = {x["id"]: (x["rank"], x["n"]) for x in dominance.dominance_counts(q, p, ["k"], "px", "py", "x", "y", ["id"], width, base).collect()}
        for i, k, px, py in ask:
            low = [x for x in pts if k is not None and x[0] == k and x[1] is not None and x[2] is not None and x[1] < px]
            assert got[i] == (len(low), sum(py is not None and x[2] < py for x in low))


def test_distinct_in_intervals(spark):
    """One key holds two thirds of the rows; equal times, repeated items, null items and keys."""
    r = random.Random(2)
    pts = [(r.choice(["hot", "hot", "a", None]), r.randrange(0, 900), r.choice([None, *range(12)])) for _ in range(700)]
    win = [(i, r.choice(["hot", "a", "b", None]), lo := r.choice([None, r.randrange(-50, 950)]), None if lo is None else lo + r.choice([-5, 0, 1, 40, 500])) for i in range(80)]
    p, w = spark.createDataFrame(pts, "k string, t bigint, item int"), spark.createDataFrame(win, "id int, k string, lo bigint, hi bigint")
    d = dominance.distinct_in_intervals(w, p, ["k"], "lo", "hi", "t", "item", ["id"], 60)
    got = {x["id"]: x["n_distinct"] for x in d.collect()}
    for i, k, lo, hi in win:
        assert got[i] == (0 if k is None or lo is None else len({x[2] for x in pts if x[0] == k and lo <= x[1] < hi and x[2] is not None}))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("width", [600, 10**6])
@pytest.mark.parametrize("period", [None, 86_400])
def test_nearest(spark, width, period):
    r = random.Random(7)
    left = [(i, r.choice(["hot", "hot", "a", "b", None]), r.choice([None, 0, 86_399, *(r.randrange(0, 86_400) // 600 * 600 for _ in range(5))])) for i in range(200)]
    right = [(i, r.choice(["hot", "hot", "a", None]), r.choice([None, *(r.randrange(0, 86_400) // 300 * 300 for _ in range(6))])) for i in range(90)]
    a, b = spark.createDataFrame(left, "id int, k string, t bigint"), spark.createDataFrame(right, "rid int, k string, at bigint")
    got = {x["id"]: (x["near_rid"], x["near_at"], x["near_gap"]) for x in asof.nearest(a, b, ["k"], "t", "at", ["rid"], ["rid"], width, period).collect()}
    assert len(got) == len(left)
    for i, k, t in left:
        c = [(min(abs(t - x[2]), 86_400 - abs(t - x[2])) if period else abs(t - x[2]), x[0], x[2]) for x in right if k is not None and t is not None and x[1] == k and x[2] is not None]
        best = min(c, default=(None, None, None))
        assert got[i] == (best[1], best[2], best[0])


def test_match_nearest_wraps_at_midnight(spark):
    a = spark.createDataFrame([(1, "x", 86_300), (2, "x", 40_000), (3, "y", 5), (4, None, 5)], "id int, k string, act bigint")
    s = spark.createDataFrame([("x", 100, 7), ("x", 43_000, 8), ("x", 43_000, 3)], "k string, sched bigint, tie int")
    got = {r["id"]: (r["sched"], r["delay"], r["tie"], r["is_unscheduled"]) for r in joins.match_nearest(a, s, ["k"], "act", "sched", ["tie"], cols=["tie"]).collect()}
    assert got == {1: (100, -200, 7, False), 2: (43_000, -3_000, 3, False), 3: (None, None, None, True), 4: (None, None, None, True)}


def test_quantiles_of_columns_with_an_offset(spark):
    """Epoch seconds and long tails: buckets are cut again until few values are left, and the answer is that of ``percentile``."""
    r = random.Random(3)
    rows = [("hot" if i % 3 else "b", r.choice([1.7e9 + r.randrange(10**6), 1.7e9 + i, -(10.0 ** r.randrange(-300, 300)), 0.0])) for i in range(3_000)] + [("one", 5.0), ("b", None)]
    d = spark.createDataFrame(rows, "k string, v double")
    want = {x["k"]: x["q"] for x in d.groupBy("k").agg(F.percentile("v", F.array(*[F.lit(q) for q in (0.0, 0.3, 0.5, 0.99, 1.0)])).alias("q")).collect()}
    for ranked in (10**6, 40, 1):
        got = {x["k"]: [x[c] for c in "abcde"] for x in quantiles.exact_quantiles(d, ["k"], "v", dict(zip("abcde", (0.0, 0.3, 0.5, 0.99, 1.0))), ranked).collect()}
        assert got == {k: pytest.approx(q) for k, q in want.items()}


def test_positions_spread_values_that_begin_alike(spark):
    n = 20_000
    d = spark.range(n).select(F.format_string("Customer#%09d", F.col("id") * 7919 % n).alias("name"))
    got = positions(d, ["name"], "i")
    assert got.filter(F.col("i") != F.substring("name", 10, 9).cast("int") + 1).count() == 0 and got.count() == n
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sizes = [x["count"] for x in positions(d, ["name"], "i").groupBy(F.spark_partition_id()).count().collect()]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(sizes) > 1 and max(sizes) < n
    assert {r["name"]: r["code"] for r in prep.vocabulary(d.limit(0), "name").collect()} == {}


def test_split_by_groups_takes_whole_groups(spark):
    d = spark.createDataFrame([(i, (i * 37 % 100) // 3) for i in range(300)] + [(-1, None)], "id int, bin int")
    bins = sorted({(i * 37 % 100) // 3 for i in range(300)})
    c = [bins[int(len(bins) * f)] for f in (0.5, 0.8)]
    got = {r["id"]: r["split"] for r in ranking.split_by_groups(d, "bin", (0.5, 0.8), ("a", "b", "c")).collect()}
    assert got == {i: "a" if (b := (i * 37 % 100) // 3) < c[0] else "b" if b < c[1] else "c" for i in range(300)}


@pytest.mark.parametrize("target", [40, 400, 10**6])
def test_stretches_follow_the_data(spark, target):
    """Half of the rows in one key, nearly all in one busy hour; an axis that folds onto itself."""
    r = random.Random(1)
    rows = [("hot" if i % 2 else f"k{i % 30}", r.choice([r.randrange(-20_000, 80_000), r.randrange(40_000, 41_000), r.randrange(40_000, 41_000)])) for i in range(6_000)] + [(None, 5), ("x", None)]
    d = spark.createDataFrame(rows, "k string, t bigint")
    s = stretches(d, ["k"], "t", 4, target, steps=64)
    n = d.filter("k is not null and t is not null").groupBy("k", chunk_of("t", s).alias(CHUNK)).count().toPandas()
    assert n["count"].max() <= target and (len(set(n[CHUNK])) == 1) == (target == 10**6)
    at = [x["c"] for x in spark.range(-30_000, 90_000, 7).select("id", chunk_of("id", s).alias("c")).orderBy("id").collect()]
    assert at == sorted(at)  # never decreasing, outside the counted range too
    if target == 400:  # quiet stretches are merged: far fewer chunks than even ones of the narrowest width
        assert len(set(n[CHUNK])) < 100_000 / s.even / 4
    for w in (s, Stretches(4, 0, (0,), (0,))):
        rows_ = {tuple(x) for x in row_index(d.filter("t is not null").withColumn("id", F.monotonically_increasing_id()), ["k"], ["t", "id"], w, "i").filter("k = 'hot'").select("t", "i").collect()}
        hot = sorted(x[1] for x in rows if x[0] == "hot")
        assert rows_ == {(t, i + 1) for i, t in enumerate(hot)}
    assert stretches(d.limit(0), ["k"], "t", 4).even > 0 and stretches(d, [], "t", 4, 100, 64).ids[-1] > 0
