"""Preparation, metric, model, graph and question queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tramline.catalog.base import HOUR_US, MIN_US, TRAINS, US, chunks, width, query, r6, table, trains, with_
from tramline.operators import aggregates as ag
from tramline.operators import graph, metrics, models, prep, windows
from tramline.plans import questions
from tramline.session import cut, scratch_path

ORD = ["t", "event_id"]
CUT = "2024-01-20"


def rnd(df, *cols, n=6):
    return df.withColumns({c: F.round(c, n) for c in cols})


def parts(spark, sf):
    t = trains(spark, sf)
    return t.filter(f"day < date'{CUT}'"), t.filter(f"day >= date'{CUT}'")


PARTS = f", tr AS (SELECT * FROM trains WHERE day < DATE '{CUT}'), te AS (SELECT * FROM trains WHERE day >= DATE '{CUT}')"


@query("label_encode", with_(TRAINS) + PARTS + """, v AS (SELECT trip, CAST(row_number() OVER (ORDER BY trip) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT trip + 5 AS trip FROM tr))
SELECT event_id, coalesce(code, -1) AS trip_code FROM te LEFT JOIN v USING (trip)""")
def label_encode(spark, sf):
    tr, te = parts(spark, sf)
    return prep.encode(te, prep.vocabulary(tr.withColumn("trip", F.col("trip") + 5), "trip"), "trip").select("event_id", "trip_code")


@query("label_encode_text", """WITH v AS (SELECT name, CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT c_name AS name FROM customer WHERE c_nationkey <> 7))
SELECT c_custkey, coalesce(code, -1) AS name_code FROM customer LEFT JOIN v ON c_name = name""")
def label_encode_text(spark, sf):
    """Names that all begin alike; those of one nation are not in the training part."""
    c = table(spark, sf, "customer").withColumnRenamed("c_name", "name")
    return prep.encode(c, prep.vocabulary(c.filter("c_nationkey <> 7"), "name"), "name").select("c_custkey", "name_code")


@query("target_encode", with_(TRAINS) + PARTS + """, m AS (SELECT trip + 5 AS trip, avg(delay) AS m FROM tr GROUP BY 1)
SELECT event_id, round(coalesce(m, (SELECT avg(delay) FROM tr)), 6) AS enc FROM te LEFT JOIN m USING (trip)""")
def target_encode(spark, sf):
    tr, te = parts(spark, sf)
    return prep.target_encode(te, tr.withColumn("trip", F.col("trip") + 5), "trip", "delay", "enc").select("event_id", r6("enc").alias("enc"))


@query("target_encode_own_out", with_(TRAINS) + PARTS + """
SELECT event_id, round(coalesce((sum(delay) OVER p - coalesce(delay, 0)) / nullif(count(delay) OVER p - CAST(delay IS NOT NULL AS INTEGER), 0), avg(delay) OVER ()), 6) AS enc FROM tr WINDOW p AS (PARTITION BY trip)""")
def target_encode_own_out(spark, sf):
    tr, _ = parts(spark, sf)
    return prep.target_encode(tr, tr, "trip", "delay", "enc", leave_one_out=True).select("event_id", r6("enc").alias("enc"))


@query("standardize", with_(TRAINS) + PARTS + """, s AS (SELECT avg(delay) AS m, stddev_pop(delay) AS d, avg(sec) AS ms, stddev_pop(sec) AS ds FROM tr)
SELECT event_id, round((delay - m) / d, 6) AS delay, round((sec - ms) / ds, 6) AS sec FROM te, s""")
def standardize(spark, sf):
    tr, te = parts(spark, sf)
    st = prep.standard_stats(tr, ["delay", "sec"])
    return rnd(prep.standardize(te, st, ["delay", "sec"]).select("event_id", "delay", "sec"), "delay", "sec")


@query("standardize_back", with_(TRAINS) + PARTS + "SELECT event_id, delay FROM te")
def standardize_back(spark, sf):
    tr, te = parts(spark, sf)
    st = prep.standard_stats(tr, ["delay"])
    back = prep.standardize(prep.standardize(te, st, ["delay"]), st, ["delay"], inverse=True)
    return rnd(back.select("event_id", "delay"), "delay")


@query("impute", with_(TRAINS) + PARTS + """, f AS (SELECT quantile_cont(delay, 0.5) AS d FROM tr), c AS (SELECT CASE WHEN value > 10 THEN stop END AS s FROM tr), k AS (SELECT s FROM c WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT event_id, coalesce(delay, d) AS delay, coalesce(CASE WHEN value > 10 THEN stop END, k.s) AS stop FROM te, f, k""")
def impute(spark, sf):
    tr, te = [d.withColumn("stop", F.when(F.col("value") > 10, F.col("stop"))) for d in parts(spark, sf)]
    return prep.impute(te, tr, ["delay"], ["stop"]).select("event_id", "delay", "stop")


_RAW = {"uniform": "1.0", "linear": "i + 1.0", "exponential": "exp(ln(10.0) / greatest(n - 1, 1) * i)", "step": "CASE WHEN i = n - 1 THEN 3.0 WHEN i = n - 2 THEN 1.5 ELSE 1.0 END"}


@query("recency_weights", "WITH m AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month FROM orders)) " +
       " UNION ALL ".join(f"SELECT month, '{k}' AS scheme, round(({v}) / avg({v}) OVER (), 6) AS weight FROM m" for k, v in _RAW.items()))
def recency_weights(spark, sf):
    o = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("month")).distinct()
    out = None
    for s in _RAW:
        w = prep.recency_weights(o, "month", s).withColumn("scheme", F.lit(s))
        out = w if out is None else out.unionByName(w)
    return rnd(out, "weight")


@query("one_hot", "SELECT event_id, CAST(event_type = 'error' AS INTEGER) AS event_type_error, CAST(event_type = 'purchase' AS INTEGER) AS event_type_purchase, CAST(event_type = 'signup' AS INTEGER) AS event_type_signup, CAST(event_type = 'view' AS INTEGER) AS event_type_view FROM events")
def one_hot(spark, sf):
    d = prep.one_hot(table(spark, sf, "events").select("event_id", "event_type"), "event_type", ["click", "error", "purchase", "signup", "view"])
    return d.drop("event_type")


@query("class_imbalance", with_(TRAINS) + """, y AS (SELECT CASE WHEN delay - 200 < 0 THEN 1 WHEN delay IS NOT NULL THEN 0 END AS y FROM trains)
SELECT count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg, round(count(*) FILTER (y = 0) / count(*) FILTER (y = 1), 6) AS scale_pos_weight, count(*) FILTER (y = 0) / count(*) FILTER (y = 1) > 1.5 OR count(*) FILTER (y = 0) / count(*) FILTER (y = 1) < 1 / 1.5 AS unbalanced FROM y""")
def class_imbalance(spark, sf):
    d = trains(spark, sf).withColumn("x", F.col("delay") - 200)
    return rnd(prep.imbalance(d.withColumn("y", prep.improves("x")), "y"), "scale_pos_weight")


BASE = """, n AS (SELECT event_id, day, delay, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS y, stop FROM trains)"""


def _next(spark, sf):
    return windows.next_stop(trains(spark, sf), ["trip"], ORD, ["delay"], width(spark, sf)).withColumnRenamed("next_delay", "y")


def _metrics_sql(where: str, pred: str, name: str) -> str:
    e = f"({pred} - y)"
    return f"SELECT '{name}' AS baseline, count(*) AS n, round(avg(abs{e}), 6) AS mae, round(sqrt(avg({e} * {e})), 6) AS rmse, round(1 - sum({e} * {e}) / nullif(var_pop(y) * count(*), 0), 6) AS r2, round(avg{e}, 6) AS bias, round(avg(abs{e}) / 60, 6) AS mae_min FROM n, g WHERE y IS NOT NULL AND {pred} IS NOT NULL AND {where}"


@query("baseline_metrics", with_(TRAINS) + BASE + f", g AS (SELECT avg(y) AS gm FROM n WHERE day < DATE '{CUT}') " + _metrics_sql(f"day >= DATE '{CUT}'", "gm", "mean") + " UNION ALL " + _metrics_sql(f"day >= DATE '{CUT}'", "delay", "persistence"))
def baseline_metrics(spark, sf):
    n = _next(spark, sf)
    tr, te = n.filter(f"day < date'{CUT}'"), n.filter(f"day >= date'{CUT}'")
    a = metrics.regression_metrics(prep.mean_baseline(tr, te, "y"), "y", "prediction").withColumn("baseline", F.lit("mean"))
    b = metrics.regression_metrics(prep.persistence_baseline(te, "delay"), "y", "prediction").withColumn("baseline", F.lit("persistence"))
    return rnd(a.unionByName(b), "mae", "rmse", "r2", "bias", "mae_min")


@query("class_baselines", with_(TRAINS) + PARTS + """, m AS (SELECT stop AS major FROM tr GROUP BY stop ORDER BY count(*) DESC, stop LIMIT 1), p AS (SELECT avg(CAST(value > 60 AS DOUBLE)) AS p FROM tr)
SELECT event_id, major, CAST(('0x' || substring(md5(CAST(event_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 < p AS INTEGER) AS dice FROM te, m, p""")
def class_baselines(spark, sf):
    tr, te = parts(spark, sf)
    d = prep.majority_baseline(tr, te, "stop", "major")
    return prep.random_baseline(tr.withColumn("y", (F.col("value") > 60)), d, "y", "event_id", "dice").select("event_id", "major", "dice")


@query("horizon_metrics", with_(TRAINS) + """, l AS (SELECT delay, lead(delay, 1) OVER w AS h1, lead(delay, 2) OVER w AS h2 FROM trains WINDOW w AS (PARTITION BY trip ORDER BY t, event_id)), g AS (SELECT 1)
""" + " UNION ALL ".join(_metrics_sql("TRUE", "delay", f"h{i}").replace(" y ", f" h{i} ").replace("- y)", f"- h{i})").replace("(y)", f"(h{i})").replace("baseline", "horizon").replace("FROM n, g", "FROM l, g") for i in (1, 2)))
def horizon_metrics(spark, sf):
    from tramline.operators.ordered import nth_prior, prior_rows

    d = prior_rows(trains(spark, sf), ["trip"], ORD, ["delay"], 2, width(spark, sf), "_p", reverse=True).withColumns({f"h{i}": nth_prior("_p", "delay", i) for i in (1, 2)})
    return rnd(metrics.horizon_metrics(d, {"h1": ("h1", "delay"), "h2": ("h2", "delay")}), "mae", "rmse", "r2", "bias", "mae_min")


LAB = """WITH l AS (SELECT l.doc_id, quality, toxic, lang, source, least(n_chars / 20000.0, 1.0) AS score, floor(least(n_chars / 20000.0, 1.0) * 20) / 20 AS step FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def scored(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "source", F.least(F.col("n_chars") / 20000.0, F.lit(1.0)).alias("score"))
    j = table(spark, sf, "labels").join(d, "doc_id")
    return j.withColumn("step", F.floor(F.col("score") * 20) / 20)


_RATES = {"accuracy": ("tp + tn", "n"), "precision": ("tp", "tp + fp"), "recall": ("tp", "tp + fn"), "f1": ("2 * tp", "2 * tp + fp + fn"), "specificity": ("tn", "tn + fp"), "fpr": ("fp", "fp + tn"), "fnr": ("fn", "fn + tp")}
_RSQL = ", ".join(f"round(CASE WHEN {b} > 0 THEN ({a}) / ({b}) ELSE 0 END, 6) AS {k}" for k, (a, b) in _RATES.items())


@query("confusion", LAB + f""", c AS (SELECT lang, count(*) AS n, count(*) FILTER (quality = 1 AND score >= 0.1) AS tp, count(*) FILTER (quality = 0 AND score >= 0.1) AS fp, count(*) FILTER (quality = 0 AND score < 0.1) AS tn, count(*) FILTER (quality = 1 AND score < 0.1) AS fn FROM l GROUP BY lang)
SELECT lang, tp, fp, tn, fn, {_RSQL}, round((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END + CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END) / 2, 6) AS balanced_accuracy FROM c""")
def confusion(spark, sf):
    d = scored(spark, sf).withColumn("p", (F.col("score") >= 0.1).cast("int"))
    return rnd(metrics.confusion(d, "quality", "p", ["lang"]), *_RATES, "balanced_accuracy")


CLS = with_(TRAINS) + """, n AS (SELECT delay, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS nd FROM trains),
k AS (SELECT CASE WHEN nd <= -60 THEN 0 WHEN nd <= 60 THEN 1 WHEN nd <= 180 THEN 2 WHEN nd <= 300 THEN 3 WHEN nd <= 450 THEN 4 ELSE 5 END AS y, CASE WHEN delay <= -60 THEN 0 WHEN delay <= 60 THEN 1 WHEN delay <= 180 THEN 2 WHEN delay <= 300 THEN 3 WHEN delay <= 450 THEN 4 ELSE 5 END AS p FROM n WHERE nd IS NOT NULL AND delay IS NOT NULL),
r AS (SELECT c AS class, count(*) FILTER (y = c) AS support, count(*) FILTER (y = c AND p = c) AS tp, count(*) FILTER (p = c) AS predicted FROM k, (SELECT unnest([0, 1, 2, 3, 4, 5]) AS c) GROUP BY c),
q AS (SELECT class, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN predicted + support > 0 THEN 2 * tp / (predicted + support) ELSE 0 END AS f1 FROM r WHERE support + predicted > 0)
"""


def _classes(spark, sf):
    from tramline.functions.scalars import DELAY_CLASS_EDGES, bin_interval

    n = _next(spark, sf).filter("y is not null and delay is not null")
    return n.select(bin_interval("y", DELAY_CLASS_EDGES).alias("yc"), bin_interval("delay", DELAY_CLASS_EDGES).alias("pc"))


@query("class_report", CLS + "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM q")
def class_report(spark, sf):
    return rnd(metrics.class_report(_classes(spark, sf), "yc", "pc"), "precision", "recall", "f1")


@query("macro_scores", CLS + "SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM q")
def macro_scores(spark, sf):
    return rnd(metrics.macro(metrics.class_report(_classes(spark, sf), "yc", "pc")), "macro_precision", "macro_recall", "macro_f1")


@query("log_loss", LAB + "SELECT lang, round(-avg(CASE WHEN quality = 1 THEN ln(least(greatest(score, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(score, 1e-15), 1 - 1e-15)) END), 6) AS log_loss FROM l GROUP BY lang")
def log_loss(spark, sf):
    return rnd(metrics.log_loss(scored(spark, sf), "quality", "score", ["lang"]), "log_loss")


def _auc_sql(by: str, y: str, score: str, src: str) -> str:
    return f"""g AS (SELECT {by}, {score} AS s, count(*) FILTER ({y} = 1) AS p, count(*) FILTER ({y} = 0) AS q FROM {src} GROUP BY ALL),
a AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp FROM g WINDOW w AS (PARTITION BY {by} ORDER BY s DESC ROWS UNBOUNDED PRECEDING)),
auc AS (SELECT {by}, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, CASE WHEN sum(p) > 0 AND sum(q) > 0 THEN round(sum(q * (tp - p / 2)) / (sum(p)::DOUBLE * sum(q)), 6) END AS roc_auc, CASE WHEN sum(p) > 0 THEN round(sum(p * tp / (tp + fp)) / sum(p), 6) END AS average_precision FROM a GROUP BY {by})"""


@query("roc_auc_segment", LAB + ", " + _auc_sql("source", "quality", "score", "l") + " SELECT * FROM auc")
def roc_auc_segment(spark, sf):
    return rnd(metrics.roc_auc(scored(spark, sf), "quality", "score", ["source"]), "roc_auc", "average_precision")


@query("roc_auc_ties", LAB + ", " + _auc_sql("lang", "toxic", "step", "l") + " SELECT * FROM auc")
def roc_auc_ties(spark, sf):
    return rnd(metrics.roc_auc(scored(spark, sf), "toxic", "step", ["lang"]), "roc_auc", "average_precision")


@query("roc_points", LAB + ", " + _auc_sql("lang", "quality", "step", "l") + """ SELECT a.lang, a.s AS score, round(CASE WHEN n_neg > 0 THEN fp / n_neg ELSE 0 END, 6) AS fpr, round(CASE WHEN n_pos > 0 THEN tp / n_pos ELSE 0 END, 6) AS tpr,
 round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision FROM a JOIN auc USING (lang)""")
def roc_points(spark, sf):
    return rnd(metrics.roc_points(scored(spark, sf), "quality", "step", ["lang"]), "fpr", "tpr", "precision")


GRID = LAB + """, t AS (SELECT unnest([""" + ", ".join(f"{round(0.05 + i * 0.01, 10)}::DOUBLE" for i in range(91)) + """]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (quality = 0 AND score >= threshold) AS fp, count(*) FILTER (quality = 1 AND score < threshold) AS fn, count(*) FILTER (quality = 0 AND score < threshold) AS tn FROM l, t GROUP BY threshold),
f AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS re, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c)
SELECT threshold, tp, fp, tn, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1 FROM f"""


@query("threshold_table", GRID)
def threshold_table(spark, sf):
    return rnd(metrics.threshold_table(scored(spark, sf), "quality", "score"), "precision", "recall", "f1")


@query("best_threshold", GRID.replace("round(f1, 6) AS f1 FROM f", "round(f.f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, threshold LIMIT 1"))
def best_threshold(spark, sf):
    return rnd(metrics.best_threshold(scored(spark, sf), "quality", "score"), "precision", "recall", "f1")


SEG = {"route": "CAST(route AS VARCHAR)", "weekend": "CAST(CAST(isodow(day) >= 6 AS INTEGER) AS VARCHAR)", "bucket": "CASE WHEN delay <= 0 THEN 'early' WHEN delay <= 60 THEN 'short' WHEN delay <= 300 THEN 'medium' ELSE 'long' END"}


@query("segment_regression", with_(TRAINS) + ", n AS (SELECT *, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS y FROM trains), s AS (" +
       " UNION ALL ".join(f"SELECT '{k}' AS segment, {v} AS level, delay, y FROM n WHERE y IS NOT NULL AND delay IS NOT NULL" for k, v in SEG.items()) + """)
SELECT segment, level, count(*) AS n, round(avg(abs(delay - y)), 6) AS mae, round(sqrt(avg((delay - y) * (delay - y))), 6) AS rmse, round(1 - sum((delay - y) * (delay - y)) / nullif(var_pop(y) * count(*), 0), 6) AS r2, round(avg(delay - y), 6) AS bias, round(avg(abs(delay - y)) / 60, 6) AS mae_min
FROM s GROUP BY ALL HAVING count(*) >= 50""")
def segment_regression(spark, sf):
    from tramline.functions.scalars import DELAY_BUCKET_EDGES, bin_interval

    seg = {"route": F.col("route"), "weekend": (F.weekday("day") >= 5).cast("int"), "bucket": bin_interval("delay", DELAY_BUCKET_EDGES, ["early", "short", "medium", "long"])}
    return rnd(metrics.segment_regression(_next(spark, sf), "y", "delay", seg), "mae", "rmse", "r2", "bias", "mae_min")


@query("segment_auc", LAB + ", s AS (SELECT 'lang' AS segment, lang AS level, quality, score FROM l UNION ALL SELECT 'source', source, quality, score FROM l), " + _auc_sql("segment, level", "quality", "score", "s") + " SELECT * FROM auc WHERE n_pos + n_neg >= 50")
def segment_auc(spark, sf):
    return rnd(metrics.segment_auc(scored(spark, sf), "quality", "score", {"lang": F.col("lang"), "source": F.col("source")}), "roc_auc", "average_precision")


# ---- graph ----------------------------------------------------------------------------------

#: stations of the graph: users, so that the graph grows with the data
EDGES = with_(TRAINS) + """, n AS (SELECT route * 5 + direction AS src, lead(route * 5 + direction) OVER w AS dst, lead(t) OVER w - t AS tt FROM (SELECT *, dense_rank() OVER (ORDER BY stop) AS sr FROM trains) WINDOW w AS (PARTITION BY stop ORDER BY t, event_id)),
e AS (SELECT src, dst, count(*) AS trip_count, quantile_cont(CAST(tt AS DOUBLE) / 1000000, 0.5) AS median_travel_time FROM n WHERE dst IS NOT NULL AND tt > 0 GROUP BY ALL)"""


def edges(spark, sf):
    t = trains(spark, sf).withColumns({"node": F.col("route") * 5 + F.col("direction")})
    e = ag.build_edges(t, ["stop"], ORD, "node", "t", width(spark, sf))
    # a written edge table: it is small, and every graph operator reads it several times
    return cut(e.withColumn("median_travel_time", F.col("median_travel_time") / US), "edges")


GAUSS = EDGES + """, s AS (SELECT stddev_pop(median_travel_time) AS sd FROM e), w AS (SELECT src, dst, exp(-pow(median_travel_time, 2) / (pow(sd, 2) + 1e-6)) AS weight FROM e, s UNION ALL SELECT DISTINCT src, src, 1.0 FROM (SELECT src FROM e UNION SELECT dst FROM e)),
gw AS (SELECT src, dst, sum(weight) AS weight FROM w GROUP BY ALL)"""


@query("gaussian_weights", GAUSS + " SELECT src, dst, round(weight, 6) AS weight FROM gw")
def gaussian_weights(spark, sf):
    return rnd(graph.gaussian_edges(edges(spark, sf)), "weight")


NORM = EDGES + """, k AS (SELECT * FROM e WHERE trip_count > 5), s AS (SELECT coalesce(nullif(stddev_samp(median_travel_time), 0), 1) AS sd FROM k),
w AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(exp(-pow(median_travel_time, 2) / pow(sd, 2)), src) AS w FROM k, s WHERE src <> dst GROUP BY ALL),
adj AS (SELECT a AS src, b AS dst, w FROM w UNION ALL SELECT b, a, w FROM w UNION ALL SELECT DISTINCT src, src, 1.0 FROM (SELECT src FROM e UNION SELECT dst FROM e)),
d AS (SELECT src, sum(w) AS deg FROM adj GROUP BY src),
na AS (SELECT adj.src, adj.dst, w / sqrt(x.deg * y.deg) AS weight FROM adj JOIN d x ON adj.src = x.src JOIN d y ON adj.dst = y.src)"""


@query("normalized_adjacency", NORM + " SELECT src, dst, round(weight, 6) AS weight FROM na")
def normalized_adjacency(spark, sf):
    return rnd(graph.normalized_adjacency(edges(spark, sf)), "weight")


SIGNAL = ", sg AS (SELECT day, route * 5 + direction AS node, avg(delay) AS x FROM trains GROUP BY ALL)"


def signal(spark, sf):
    return trains(spark, sf).groupBy("day", (F.col("route") * 5 + F.col("direction")).alias("node")).agg(F.avg("delay").alias("x"))


@query("chebyshev_terms", NORM + SIGNAL + """, a1 AS (SELECT sg.day, src AS node, sum(weight * x) AS ax FROM na JOIN sg ON na.dst = sg.node GROUP BY ALL), t1 AS (SELECT sg.day, sg.node, x AS t0, 0 * x - coalesce(ax, 0) AS t1 FROM sg LEFT JOIN a1 USING (day, node)),
a2 AS (SELECT t1.day, src AS node, sum(weight * t1) AS ax FROM na JOIN t1 ON na.dst = t1.node GROUP BY ALL)
SELECT t1.day, t1.node, round(t0, 4) AS t0, round(t1, 4) AS t1, round(2 * (0 * t1 - coalesce(ax, 0)) - t0, 4) AS t2 FROM t1 LEFT JOIN a2 USING (day, node)""")
def chebyshev_terms(spark, sf):
    d = graph.chebyshev_features(cut(signal(spark, sf), "signal"), cut(graph.normalized_adjacency(edges(spark, sf)), "adjacency"), "node", "x", ["day"], 2)
    return rnd(d, "t0", "t1", "t2", n=4)


def _power_sql(steps: int) -> str:
    sql = NORM + ", v0 AS (SELECT src AS node, 1.0::DOUBLE + src % 7 AS x FROM (SELECT src FROM na UNION SELECT dst FROM na))"
    for i in range(steps + 1):
        sql += f", v{i + 1} AS (SELECT v.node, v.x - coalesce(sum(weight * u.x), 0) AS x FROM v{i} v LEFT JOIN na ON na.src = v.node LEFT JOIN v{i} u ON na.dst = u.node GROUP BY v.node, v.x)"
    return sql + f" SELECT round(sum(a.x * b.x) / sum(a.x * a.x), 5) AS lambda_max FROM v{steps} a JOIN v{steps + 1} b USING (node)"


@query("largest_eigenvalue", _power_sql(6))
def largest_eigenvalue(spark, sf):
    adj = cut(graph.normalized_adjacency(edges(spark, sf)), "adjacency")
    return graph.largest_eigenvalue(adj, 6, 1 + F.col("src") % 7).select(F.round("lambda_max", 5).alias("lambda_max"))


@query("diffusion_features", GAUSS + SIGNAL + """, dg AS (SELECT src, sum(weight) AS d FROM gw GROUP BY src), tw AS (SELECT src, dst, weight / d AS weight FROM gw JOIN dg USING (src)),
h1 AS (SELECT sg.day, src AS node, sum(weight * x) AS hop1 FROM tw JOIN sg ON tw.dst = sg.node GROUP BY ALL), h2 AS (SELECT h1.day, src AS node, sum(weight * hop1) AS hop2 FROM tw JOIN h1 ON tw.dst = h1.node GROUP BY ALL)
SELECT sg.day, sg.node, round(x, 4) AS x, round(hop1, 4) AS hop1, round(hop2, 4) AS hop2 FROM sg LEFT JOIN h1 USING (day, node) LEFT JOIN h2 USING (day, node)""")
def diffusion_features(spark, sf):
    d = graph.diffusion_features(cut(signal(spark, sf), "signal"), cut(graph.gaussian_edges(edges(spark, sf)), "weights"), "node", "x", ["day"], 2)
    return rnd(d, "x", "hop1", "hop2", n=4)


STGRID = with_(TRAINS) + """, c AS (SELECT stop, (t // 3600000000) * 3600000000 AS bin, avg(delay) AS d FROM trains GROUP BY ALL),
g AS (SELECT stop, unnest(generate_series((SELECT min(bin) FROM c), (SELECT max(bin) FROM c), 3600000000)) AS bin FROM (SELECT DISTINCT stop FROM c)), j AS (SELECT g.stop, g.bin, d FROM g LEFT JOIN c USING (stop, bin)),
f AS (SELECT stop, bin, coalesce(last_value(d IGNORE NULLS) OVER (PARTITION BY stop ORDER BY bin ROWS UNBOUNDED PRECEDING), first_value(d IGNORE NULLS) OVER (PARTITION BY stop ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS delay FROM j)"""


def _grid(spark, sf):
    return graph.spatio_temporal_grid(trains(spark, sf), "stop", "t", HOUR_US, ["delay"], width(spark, sf), US)


@query("spatio_temporal_grid", STGRID + " SELECT stop, bin, round(delay, 6) AS delay, round(sin(2 * pi() * hour(make_timestamp(bin)) / 24), 6) + 0.0 AS hour_sin, round(cos(2 * pi() * hour(make_timestamp(bin)) / 24), 6) + 0.0 AS hour_cos, CAST(isodow(make_timestamp(bin)) - 1 AS INTEGER) AS dow FROM f")
def spatio_temporal_grid(spark, sf):
    d = _grid(spark, sf).select("stop", "bin", "delay", "hour_sin", "hour_cos", "dow")
    return rnd(d, "delay").withColumns({"hour_sin": r6("hour_sin") + 0.0, "hour_cos": r6("hour_cos") + 0.0})


@query("padded_history", STGRID + ", e AS (SELECT max(bin) AS e FROM f), x AS (SELECT stop, unnest(generate_series(e - 799 * 3600000000, e, 3600000000)) AS bin FROM (SELECT DISTINCT stop FROM f), e) SELECT x.stop, x.bin, round(coalesce(delay, 0), 6) AS delay FROM x LEFT JOIN f USING (stop, bin)")
def padded_history(spark, sf):
    return rnd(graph.pad_history(_grid(spark, sf).select("stop", "bin", "delay"), "stop", "bin", HOUR_US, 800, ["delay"]), "delay")


@query("node_coverage", """WITH n AS (SELECT DISTINCT p_type || 'N' AS node FROM part), a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || 'N' ELSE p_type || 'S' END AS stop FROM part)
SELECT p_partkey, stop, CASE WHEN stop IN (SELECT node FROM n) THEN 'exact' WHEN stop IN (SELECT regexp_replace(node, '[NS]$', '') FROM n) THEN 'directional' ELSE 'none' END AS coverage FROM a""")
def node_coverage(spark, sf):
    p = table(spark, sf, "part")
    m = F.col("p_partkey") % 3
    asked = p.select("p_partkey", F.when(m == 0, F.col("p_type")).when(m == 1, F.concat("p_type", F.lit("N"))).otherwise(F.concat("p_type", F.lit("S"))).alias("stop"))
    nodes = p.select(F.concat("p_type", F.lit("N")).alias("node"))
    return graph.node_coverage(asked, nodes, "stop", "node").select("p_partkey", "stop", "coverage")


# ---- questions ------------------------------------------------------------------------------

PF = with_(TRAINS) + ", f AS (SELECT event_id, trip, route, stop || CASE WHEN direction = 0 THEN 'N' ELSE 'S' END AS stop_id, delay, value / (value + 50) AS prob, t, day FROM trains)"


def platform_rows(spark, sf):
    t = trains(spark, sf)
    return t.withColumns({"stop_id": F.concat("stop", F.when(F.col("direction") == 0, "N").otherwise("S")), "prob": F.col("value") / (F.col("value") + 50)})


@query("current_delay", PF + " SELECT round(greatest(avg(delay), 0), 6) AS delay_seconds, count(delay) AS n FROM f WHERE stop_id IN ('click', 'clickN', 'clickS')")
def current_delay(spark, sf):
    return rnd(questions.current_delay(platform_rows(spark, sf), "stop_id", "click", "delay"), "delay_seconds")


@query("propagation", PF + """, s AS (SELECT event_type AS base, string_agg(DISTINCT CAST(user_id % 7 AS VARCHAR), ' ' ORDER BY CAST(user_id % 7 AS VARCHAR)) AS routes FROM events GROUP BY 1), g AS (SELECT regexp_replace(stop_id, '[NS]$', '') AS base, greatest(avg(delay), 0) AS h10, greatest(avg(delay) - 100, 0) AS h20 FROM f GROUP BY 1)
SELECT base, round(h10, 6) AS h10, round(h20, 6) AS h20 FROM g JOIN s USING (base) WHERE list_contains(string_split(routes, ' '), '3')""")
def propagation(spark, sf):
    st = table(spark, sf, "events").select(F.col("event_type").alias("base"), (F.col("user_id") % 7).cast("string").alias("r")).distinct()
    st = st.groupBy("base").agg(F.array_join(F.array_sort(F.collect_list("r")), " ").alias("routes"))  # at most seven lines
    d = platform_rows(spark, sf).withColumns({"h10": F.col("delay"), "h20": F.col("delay") - 100})
    return rnd(questions.propagation(d, st, "stop_id", ["h10", "h20"], "3").select("base", "h10", "h20"), "h10", "h20")


@query("delay_predictions", PF + " SELECT event_id, greatest(delay, 0) AS delay_seconds, round(greatest(delay, 0) / 60, 6) AS delay_minutes FROM f WHERE route = 2 AND stop_id IN ('view', 'viewN', 'viewS') AND greatest(coalesce(delay, 0), 0) >= 60")
def delay_predictions(spark, sf):
    d = questions.delay_predictions(platform_rows(spark, sf), "delay", 2, "view", 60, "route")
    return rnd(d.select("event_id", "delay_seconds", "delay_minutes"), "delay_minutes")


@query("improvement_calls", PF + " SELECT event_id, round(prob, 6) AS prob, prob >= 0.6 AS improves FROM f")
def improvement_calls(spark, sf):
    return rnd(questions.improvement(platform_rows(spark, sf), "prob", 0.6).select("event_id", "prob", "improves"), "prob")


@query("alert_probability", PF + " SELECT route, stop_id, round(max(prob), 6) AS prob, max(prob) >= 0.35 AS alert_predicted FROM f GROUP BY ALL HAVING max(prob) >= 0.2")
def alert_probability(spark, sf):
    d = platform_rows(spark, sf).groupBy("route", "stop_id").agg(F.max("prob").alias("prob"))
    return rnd(questions.alert_probability(d, "prob", 0.2), "prob")


@query("trip_status", with_(TRAINS) + """, s AS (SELECT trip, max(CAST(NOT unscheduled AS INTEGER)) AS ok FROM trains WHERE day = DATE '2024-01-15' GROUP BY trip)
SELECT c_custkey AS trip, CASE ok WHEN 1 THEN 'ok' WHEN 0 THEN 'unscheduled' ELSE 'not_found' END AS status FROM customer LEFT JOIN s ON c_custkey = trip""")
def trip_status(spark, sf):
    feed = trains(spark, sf).filter("day = date'2024-01-15'")
    return questions.trip_status(table(spark, sf, "customer").select(F.col("c_custkey").alias("trip")), feed, "trip", ~F.col("unscheduled"))


@query("trip_features", with_(TRAINS) + """, s AS (SELECT *, count(*) OVER (PARTITION BY trip) - row_number() OVER (PARTITION BY trip ORDER BY t, event_id) AS sl, max(t) OVER (PARTITION BY trip) - t AS tl FROM trains),
i AS (SELECT * FROM s WHERE sl > 0 QUALIFY row_number() OVER (PARTITION BY trip ORDER BY sl, event_id) = 1),
l AS (SELECT trip, event_id, avg(delay) OVER (PARTITION BY route ORDER BY tl, trip ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS m, delay - lag(delay) OVER (PARTITION BY route ORDER BY tl, trip) AS d FROM i)
SELECT trip, event_id, round(m, 6) AS line_mean5, d AS line_diff FROM l WHERE trip = 11""")
def trip_features(spark, sf):
    d = windows.trip_end(trains(spark, sf), ["trip"], ORD, "delay", "t", width(spark, sf))
    d = questions.trip_features(d, "trip", 11, ["route"], "stops_left", "time_left", "delay", chunks(d, ["route"], "time_left", MIN_US, (sf, "left by route")), ["event_id"])
    return rnd(d.select("trip", "event_id", "line_mean5", "line_diff"), "line_mean5")


@query("route_models", with_(TRAINS) + "SELECT event_id, CASE WHEN (max(t) OVER (PARTITION BY trip, day) - t) / 1000000 < 1800 THEN 'end' ELSE '30m,end' END AS models FROM trains")
def route_models(spark, sf):
    t = trains(spark, sf)
    d = t.join(t.groupBy("trip", "day").agg(F.max("t").alias("e")), ["trip", "day"]).withColumn("left_s", (F.col("e") - F.col("t")) / US)
    return questions.route_models(d, "left_s").select("event_id", F.array_join("models", ",").alias("models"))


@query("line_stations", """WITH st AS (SELECT p_partkey AS stop_id, p_name AS name, [p_brand, p_type] AS lines FROM part), o AS (SELECT p_brand AS line, p_partkey AS seq, upper(p_name) AS name FROM part),
f AS (SELECT lower(name) AS n, unnest(lines) AS line, stop_id FROM st), ff AS (SELECT n, line, min(stop_id) AS s FROM f GROUP BY ALL), c AS (SELECT lower(name) AS n, min(stop_id) AS s FROM st WHERE stop_id % 2 = 0 GROUP BY ALL)
SELECT o.line, o.seq, coalesce(ff.s, c.s) AS stop_id, CASE WHEN ff.s IS NOT NULL THEN 0 ELSE 1 END AS level FROM o LEFT JOIN ff ON lower(o.name) = ff.n AND o.line = ff.line LEFT JOIN c ON lower(o.name) = c.n WHERE coalesce(ff.s, c.s) IS NOT NULL
QUALIFY count(*) OVER (PARTITION BY o.line) >= 2""".replace("WHERE stop_id % 2 = 0 ", ""))
def line_stations(spark, sf):
    p = table(spark, sf, "part")
    st = p.select(F.col("p_partkey").alias("stop_id"), F.col("p_name").alias("name"), F.array("p_brand", "p_type").alias("lines"))
    o = p.select(F.col("p_brand").alias("line"), F.col("p_partkey").alias("seq"), F.upper("p_name").alias("name"))
    return questions.line_stations(o, st).select("line", "seq", "stop_id", "level")


@query("freshness", with_(TRAINS) + "SELECT min((t // 900000000) * 900000000) AS oldest, max((t // 900000000) * 900000000) AS newest, count(DISTINCT t // 900000000) AS n_windows FROM trains")
def freshness(spark, sf):
    return questions.freshness(trains(spark, sf).withColumn("w", F.floor(F.col("t") / 900_000_000) * 900_000_000), "w")


@query("availability", with_(TRAINS) + "SELECT 'sec' AS \"column\", 'train_only' AS kind, count(*) AS n FROM trains UNION ALL SELECT unnest(['event_id', 'delay']), 'servable', count(*) FROM trains")
def availability(spark, sf):
    from tramline.operators.clean import availability as matrix

    t = trains(spark, sf)
    m = matrix(t.select("event_id", "delay", "sec").schema, t.select("event_id", "delay", "stop").schema)
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind")) for k, cs in m.items() for c in cs])
    return t.agg(F.count(F.lit(1)).alias("n")).select(F.explode(pairs).alias("x"), "n").select("x.column", "x.kind", "n")


# ---- models (no SQL form) -------------------------------------------------------------------

FEATS = ["delay", "lag1", "lag2", "delay_velocity", "hour", "route", "direction"]


def learning_rows(spark, sf):
    """Lagged rows with the next delay as target, whether it shrinks, and its class."""
    from tramline.functions.scalars import DELAY_CLASS_EDGES, bin_interval

    d = windows.lagged(_next(spark, sf), ["trip"], ORD, "delay", 2, width(spark, sf))
    d = d.filter("y is not null and delay is not null").withColumns(
        {"hour": F.floor(F.col("sec") / 3600), "delay_velocity": F.col("delay") - F.col("lag1"), "better": (F.col("y") < F.col("delay")).cast("int"), "klass": bin_interval("y", DELAY_CLASS_EDGES).cast("double")}
    )
    # trainers pass over their rows many times: they read a written layer
    d = cut(d.withColumn("month", F.concat(F.lit("w"), F.weekofyear("day").cast("string"))), "learning")
    return d.filter(f"day < date'{CUT}'"), d.filter(f"day >= date'{CUT}'")


SMALL = {"maxIter": 4, "maxDepth": 3}


@query("boosted_regression")
def boosted_regression(spark, sf):
    tr, te = learning_rows(spark, sf)
    tr = prep.recency_weights(tr, "month", "exponential")
    m = models.fit_boosted_regressor(tr, FEATS, "y", "weight", **SMALL)
    return metrics.regression_metrics(models.score(m, te, FEATS), "y", "prediction")


@query("boosted_classifier")
def boosted_classifier(spark, sf):
    tr, te = learning_rows(spark, sf)
    m = models.fit_boosted_classifier(tr, FEATS, "better", **SMALL)
    return metrics.roc_auc(models.score(m, te, FEATS), "better", "probability")


@query("forest_importances")
def forest_importances(spark, sf):
    tr, _ = learning_rows(spark, sf)
    return models.importances(spark, models.fit_forest(tr, FEATS, "better", numTrees=5, maxDepth=4), FEATS)


@query("logistic_scores")
def logistic_scores(spark, sf):
    tr, te = learning_rows(spark, sf)
    st = prep.standard_stats(tr, ["delay", "lag1", "lag2", "delay_velocity"])
    cols = ["delay", "lag1", "lag2", "delay_velocity"]
    m = models.fit_logistic(prep.standardize(tr, st, cols), FEATS, "better", maxIter=10)
    return models.score(m, prep.standardize(te, st, cols), FEATS, 0.5).select("event_id", "probability", "flagged")


@query("class_forecast")
def class_forecast(spark, sf):
    tr, te = learning_rows(spark, sf)
    m = models.fit_boosted_classes(tr, FEATS, "klass", maxIter=2, maxDepth=3)
    return metrics.class_report(models.score(m, te, FEATS), "klass", "prediction")


@query("permutation_importance")
def permutation_importance(spark, sf):
    tr, te = learning_rows(spark, sf)
    m = models.fit_forest(tr, FEATS, "y", classify=False, numTrees=5, maxDepth=4)
    return models.permutation_importance(m, te, FEATS, "y", {"delays": ["delay", "lag1", "lag2"], "calendar": ["hour"]}, "event_id")


@query("parameter_search")
def parameter_search(spark, sf):
    from tramline.operators.ranking import sample_fraction

    tr, te = learning_rows(spark, sf)
    grid = models.param_grid({"maxDepth": [2, 3], "maxIter": [2, 4]}, 3)
    return models.search(sample_fraction(tr, "event_id", 0.3), te, FEATS, "y", models.fit_boosted_regressor, grid, models.mae_of("y")).drop("seconds")


#: the reference's windows reach back 2 to 13 months, the longest over all that it has; the forest is the one it fits to delays
SEARCH_WINDOWS = [2, 3, 4, 5, 7, 10]
SEARCH_SCHEMES = ["uniform", "linear", "exponential", "step"]
DELAY_FOREST = {"numTrees": 20, "maxDepth": 8}


@query("window_weight_search")
def window_weight_search(spark, sf):
    """Seven training windows x four weight schemes, a whole forest each; a table of some weeks has days for months."""
    tr, te = learning_rows(spark, sf)
    tr = tr.withColumn("period", F.concat(F.lit("d"), F.datediff("day", F.lit("1970-01-01")).cast("string")))
    periods = [r[0] for r in tr.select("period").distinct().collect()]  # one row a day
    windows_ = [*SEARCH_WINDOWS, max(13, len(periods))]
    d = models.window_weight_search(tr, "period", windows_, SEARCH_SCHEMES, periods, te, FEATS, "y", models.fit_forest, models.mae_of("y"), classify=False, **DELAY_FOREST)
    return d.drop("seconds")


def _fits_sql(features: str, test: str) -> str:
    """All windows of the newest 1 to 7 periods of two days x four weight schemes, by Cramer's rule."""
    sums = ["n", "a", "b", "aa", "ab", "bb", "y", "ay", "by_"]
    of = dict(zip(sums, ["1", "a", "b", "a * a", "a * b", "b * b", "y", "a * y", "b * y"]))
    det = lambda c: "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))".format(*c)
    cols = [["n", "a", "b"], ["a", "aa", "ab"], ["b", "ab", "bb"], ["y", "ay", "by_"]]
    rows = lambda m: [m[j][i] for i in range(3) for j in range(3)]
    d = det(rows(cols[:3]))
    beta = [f"{det(rows([cols[3] if j == i else cols[j] for j in range(3)]))} / {d} AS b{i}" for i in range(3)]
    return with_(TRAINS) + f""", nx AS (SELECT *, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS y FROM trains),
r AS (SELECT CAST(y AS DOUBLE) AS y, {features}, CAST(day(day) - 1 AS INTEGER) // 2 AS p, day FROM nx WHERE y IS NOT NULL AND delay IS NOT NULL),
m AS (SELECT p, row_number() OVER (ORDER BY p DESC) - 1 AS age, count(*) OVER () AS total, {', '.join(f'CAST(sum({e}) AS DOUBLE) AS {s}' for s, e in of.items())} FROM r WHERE day < DATE '{CUT}' GROUP BY p),
w AS (SELECT win, scheme FROM (SELECT unnest(range(1, 8)) AS win), (SELECT unnest(['uniform', 'linear', 'exponential', 'step']) AS scheme)),
f AS (SELECT w.win, scheme, m.*, least(win, total) AS c FROM w JOIN m ON age < win),
g AS (SELECT *, CASE scheme WHEN 'uniform' THEN 1.0::DOUBLE WHEN 'linear' THEN c - age WHEN 'exponential' THEN exp(ln(10::DOUBLE) / greatest(c - 1, 1) * (c - 1 - age)) ELSE CASE age WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.5::DOUBLE ELSE 1 END END AS wt FROM f),
s AS (SELECT win, scheme, CAST(count(*) AS INTEGER) AS n_periods, CAST(sum(n) AS BIGINT) AS n_train, {', '.join(f'sum(wt * {s}) AS {s}' for s in sums)} FROM g GROUP BY win, scheme),
x AS (SELECT win, scheme, n_periods, n_train, {', '.join(beta)} FROM s)
{test}"""


FIT_TEST = f"""SELECT CAST(win AS INTEGER) AS "window", scheme, n_periods, n_train, round(avg(abs(y - b0 - b1 * a - b2 * b)), 4) AS test_mae, round(sqrt(avg(pow(y - b0 - b1 * a - b2 * b, 2))), 4) AS test_rmse,
 round(1 - avg(pow(y - b0 - b1 * a - b2 * b, 2)) / var_pop(y), 6) AS test_r2 FROM x, r WHERE day >= DATE '{CUT}' GROUP BY ALL"""


@query("window_weight_grid", _fits_sql("delay AS a, CAST(sec // 3600 AS DOUBLE) AS b", FIT_TEST))
def window_weight_grid(spark, sf):
    """Seven training windows x four weight schemes from one pass over each part."""
    d = _next(spark, sf).filter("y is not null and delay is not null").withColumns({"hour": F.floor(F.col("sec") / 3600).cast("double"), "period": F.floor((F.dayofmonth("day") - 1) / 2).cast("string")})
    fits = models.window_weight_fits(d.filter(f"day < date'{CUT}'"), d.filter(f"day >= date'{CUT}'"), "period", range(1, 8), ["uniform", "linear", "exponential", "step"], ["delay", "hour"], "y")
    return rnd(fits.select("window", "scheme", "n_periods", "n_train", "test_mae", "test_rmse", "test_r2"), "test_mae", "test_rmse", n=4).withColumn("test_r2", r6("test_r2"))


@query("strategy_comparison", with_(TRAINS) + f""", nx AS (SELECT *, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS y FROM trains), r AS (SELECT y, delay AS a, sec // 3600 AS b, day < DATE '{CUT}' AS tr FROM nx WHERE y IS NOT NULL AND delay IS NOT NULL),
one AS (SELECT sqrt(avg(pow(y - i - k * a, 2)) FILTER (NOT tr)) AS e FROM r, (SELECT regr_slope(y, a) AS k, regr_intercept(y, a) AS i FROM r WHERE tr))
SELECT 'plain' AS strategy, CAST(1 AS INTEGER) AS candidates, round(e, 4) AS valid_rmse, TRUE AS no_worse FROM one UNION ALL SELECT 'grid', 6, NULL, TRUE UNION ALL SELECT 'random', 3, NULL, TRUE""")
def strategy_comparison(spark, sf):
    """The plain fit's error is held against SQL; the searches try more candidates (times differ from run to run and are left out)."""
    d = _next(spark, sf).filter("y is not null and delay is not null").withColumn("hour", F.floor(F.col("sec") / 3600).cast("double"))
    got = models.compare_strategies(d.filter(f"day < date'{CUT}'"), d.filter(f"day >= date'{CUT}'"), ["delay", "hour"], "y", {"delay": ["delay"], "both": ["delay", "hour"]}, [0.0, 10.0, 1000.0], 3)
    plain = got.filter("strategy = 'plain'").select(F.col("valid_rmse").alias("_p"))
    got = got.crossJoin(F.broadcast(plain))  # one row
    no_worse = F.when(F.col("strategy") == "grid", F.col("valid_rmse") <= F.col("_p") + 1e-9).otherwise(True)
    return got.select("strategy", "candidates", F.when(F.col("strategy") == "plain", F.round("valid_rmse", 4)).alias("valid_rmse"), no_worse.alias("no_worse"))


@query("feature_ablation")
def feature_ablation(spark, sf):
    tr, te = learning_rows(spark, sf)
    return models.ablation(tr, te, "y", models.fit_forest, {"all": FEATS, "no_lags": ["delay", "hour"]}, models.mae_of("y"), classify=False, numTrees=3, maxDepth=3)


@query("saved_model_scores")
def saved_model_scores(spark, sf):
    tr, te = learning_rows(spark, sf)
    path = scratch_path(spark, "model")
    models.save_prep(path, models.fit_forest(tr, FEATS, "y", classify=False, numTrees=3, maxDepth=3), vocab=prep.vocabulary(tr, "stop"))
    m, tabs = models.load_prep(spark, path, "vocab")
    return models.score(m, prep.encode(te, tabs["vocab"], "stop"), FEATS).select("event_id", "stop_code", "prediction")


# ---- models that SQL can state: one split, one tree, one binary feature ----------------------

TWO = ["hour", "route"]
SPLIT_ROWS = with_(TRAINS) + f""", nx AS (SELECT *, lead(delay) OVER (PARTITION BY trip ORDER BY t, event_id) AS y FROM trains),
ro AS (SELECT event_id, day, stop, sec // 3600 AS hour, route, direction, CAST(y AS DOUBLE) AS y, CAST(y < delay AS INTEGER) AS better, CASE WHEN y <= -60 THEN 0 WHEN y <= 300 THEN 1 ELSE 2 END AS klass FROM nx WHERE y IS NOT NULL AND delay IS NOT NULL),
tr AS (SELECT * FROM ro WHERE day < DATE '{CUT}'), te AS (SELECT * FROM ro WHERE day >= DATE '{CUT}')"""


def _split_sql(name: str, y: str, feats=tuple(TWO)) -> str:
    """The best single split of the training rows: feature, border, mean on either side."""
    cells = " UNION ALL ".join(f"SELECT '{f}' AS f, {f} AS x, count(*) AS n, CAST(sum({y}) AS DOUBLE) AS s FROM tr GROUP BY {f}" for f in feats)
    return f""", {name}c AS (SELECT f, (x + lead(x) OVER (PARTITION BY f ORDER BY x)) / 2 AS border, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY f) AS nt, sum(s) OVER (PARTITION BY f) AS st
 FROM ({cells}) WINDOW w AS (PARTITION BY f ORDER BY x ROWS UNBOUNDED PRECEDING)),
{name} AS (SELECT f, border, sl / nl AS ml, (st - sl) / (nt - nl) AS mr FROM {name}c WHERE border IS NOT NULL ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC, f LIMIT 1)"""


_SIDE = "CASE WHEN CASE f WHEN 'hour' THEN hour ELSE route END <= border THEN ml ELSE mr END"


def split_rows(spark, sf):
    d = _next(spark, sf).filter("y is not null and delay is not null").withColumns(
        {"hour": F.floor(F.col("sec") / 3600), "better": (F.col("y") < F.col("delay")).cast("int"), "klass": F.when(F.col("y") <= -60, 0.0).when(F.col("y") <= 300, 1.0).otherwise(2.0)}
    )
    d = cut(d, "learning")
    return d.filter(f"day < date'{CUT}'"), d.filter(f"day >= date'{CUT}'")


@query("split_regression", SPLIT_ROWS + _split_sql("b", "y") + f" SELECT event_id, round({_SIDE}, 4) AS prediction FROM te, b")
def split_regression(spark, sf):
    """M10 with one round and one split."""
    tr, te = split_rows(spark, sf)
    m = models.fit_boosted_regressor(tr, TWO, "y", maxIter=1, maxDepth=1)
    return models.score(m, te, TWO).select("event_id", F.round("prediction", 4).alias("prediction"))


@query("split_classifier", SPLIT_ROWS + _split_sql("b", "2 * better - 1") + f" SELECT event_id, round(1 / (1 + exp(-2 * ({_SIDE}))), 5) AS probability FROM te, b")
def split_classifier(spark, sf):
    """M11 with one round and one split."""
    tr, te = split_rows(spark, sf)
    m = models.fit_boosted_classifier(tr, TWO, "better", maxIter=1, maxDepth=1)
    return models.score(m, te, TWO).select("event_id", F.round("probability", 5).alias("probability"))


@query("one_tree_scores", SPLIT_ROWS + _split_sql("b", "better") + f" SELECT event_id, round({_SIDE}, 5) AS probability, CAST({_SIDE} >= 0.5 AS INTEGER) AS flagged FROM te, b")
def one_tree_scores(spark, sf):
    """M12 with one tree of one split on all rows; M28's threshold."""
    tr, te = split_rows(spark, sf)
    m = models.fit_forest(tr, TWO, "better", numTrees=1, maxDepth=1, bootstrap=False)
    return models.score(m, te, TWO, 0.5).select("event_id", F.round("probability", 5).alias("probability"), "flagged")


@query("logistic_groups", SPLIT_ROWS + " SELECT event_id, round(p, 3) AS probability, CAST(p >= 0.5 AS INTEGER) AS flagged FROM te JOIN (SELECT direction, avg(better) AS p FROM tr GROUP BY 1) USING (direction)")
def logistic_groups(spark, sf):
    """M13 on one binary feature: the probability is the share of its group."""
    tr, te = split_rows(spark, sf)
    m = models.fit_logistic(tr, ["direction"], "better", maxIter=200, tol=1e-10)
    return models.score(m, te, ["direction"], 0.5).select("event_id", F.round("probability", 3).alias("probability"), "flagged")


@query("class_splits", SPLIT_ROWS + "".join(_split_sql(f"b{k}", f"CASE WHEN klass = {k} THEN 1 ELSE -1 END") for k in range(3)) + ", s AS (" + " UNION ALL ".join(f"SELECT event_id, {k} AS k, {_SIDE} AS m FROM te, b{k}" for k in range(3)) +
       ") SELECT event_id, CAST(arg_min(k, (-m, k)) AS DOUBLE) AS prediction FROM s GROUP BY event_id")
def class_splits(spark, sf):
    """One split per class against the rest, the class of the greatest margin."""
    tr, te = split_rows(spark, sf)
    m = models.fit_boosted_classes(tr, TWO, "klass", maxIter=1, maxDepth=1)
    return models.score(m, te, TWO).select("event_id", "prediction")


@query("split_importances", SPLIT_ROWS + _split_sql("b", "y") + " SELECT x.feature, CAST(CASE WHEN x.feature = f THEN 100 ELSE 0 END AS DOUBLE) AS importance_pct FROM b, (SELECT unnest(['hour', 'route']) AS feature) x")
def split_importances(spark, sf):
    """M23 of one split."""
    tr, _ = split_rows(spark, sf)
    return models.importances(spark, models.fit_forest(tr, TWO, "y", classify=False, numTrees=1, maxDepth=1, bootstrap=False), TWO)


@query("split_permutation", SPLIT_ROWS + _split_sql("b", "y") + f""", q AS (SELECT *, row_number() OVER (ORDER BY event_id) AS i, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS j FROM te),
p AS (SELECT a.y, a.hour, a.route, c.hour AS h2, c.route AS r2 FROM q a JOIN q c ON a.i = c.j),
m AS (SELECT avg(abs({_SIDE} - y)) AS base, avg(abs({_SIDE.replace('THEN hour', 'THEN h2')} - y)) AS mh, avg(abs({_SIDE.replace('ELSE route', 'ELSE r2')} - y)) AS mr FROM p, b)
SELECT 'hour' AS "group", round(mh, 4) AS mae, round(base, 4) AS base_mae, round(mh - base, 4) AS delta_mae FROM m UNION ALL SELECT 'route', round(mr, 4), round(base, 4), round(mr - base, 4) FROM m""".replace("mr FROM p, b)", "mrr FROM p, b)").replace("round(mr, 4), round(base, 4), round(mr - base, 4)", "round(mrr, 4), round(base, 4), round(mrr - base, 4)"))
def split_permutation(spark, sf):
    """M24 of one split: the permutation follows a hash that SQL has too."""
    tr, te = split_rows(spark, sf)
    m = models.fit_boosted_regressor(tr, TWO, "y", maxIter=1, maxDepth=1)
    d = models.permutation_importance(m, te, TWO, "y", {"hour": ["hour"], "route": ["route"]}, "event_id")
    return rnd(d.select("group", "mae", "base_mae", "delta_mae"), "mae", "base_mae", "delta_mae", n=4)


@query("split_ablation", SPLIT_ROWS + _split_sql("b", "y") + _split_sql("bh", "y", ("hour",)) + _split_sql("br", "y", ("route",)) +
       " UNION ALL ".join(f" SELECT '{n}' AS subset, CAST({k} AS INTEGER) AS n_features, round(avg(abs({_SIDE} - y)), 4) AS metric FROM te, {b}" for n, k, b in (("both", 2, "b"), ("hour", 1, "bh"), ("route", 1, "br"))))
def split_ablation(spark, sf):
    """One split on subsets of the features."""
    tr, te = split_rows(spark, sf)
    d = models.ablation(tr, te, "y", models.fit_boosted_regressor, {"both": TWO, "hour": ["hour"], "route": ["route"]}, models.mae_of("y"), maxIter=1, maxDepth=1)
    return rnd(d, "metric", n=4)


@query("saved_split", SPLIT_ROWS + _split_sql("b", "y") + f""", v AS (SELECT stop, CAST(row_number() OVER (ORDER BY stop) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT stop FROM tr))
SELECT event_id, coalesce(code, -1) AS stop_code, round({_SIDE}, 4) AS prediction FROM te LEFT JOIN v USING (stop), b""")
def saved_split(spark, sf):
    """The model and its lookup table, written and read again."""
    tr, te = split_rows(spark, sf)
    path = scratch_path(spark, "model")
    models.save_prep(path, models.fit_boosted_regressor(tr, TWO, "y", maxIter=1, maxDepth=1), vocab=prep.vocabulary(tr, "stop"))
    m, tabs = models.load_prep(spark, path, "vocab")
    return models.score(m, prep.encode(te, tabs["vocab"], "stop"), TWO).select("event_id", "stop_code", F.round("prediction", 4).alias("prediction"))
