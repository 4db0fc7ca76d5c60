"""Exact evaluation metrics, also per segment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.ordered import running_sums

#: score steps that bound what one task ranks
SCORE_STEPS = 65_536


def regression_metrics(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2, bias and MAE in minutes; a constant target has no R2."""
    ok = df.filter(F.col(y).isNotNull() & F.col(pred).isNotNull())
    e = F.col(pred) - F.col(y)
    total = F.var_pop(y) * F.count(F.lit(1))
    return ok.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(total, F.lit(0.0))).alias("r2"),
        F.avg(e).alias("bias"),
        (F.avg(F.abs(e)) / 60).alias("mae_min"),
    )


def horizon_metrics(df: DataFrame, pairs: dict[str, tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """Regression metrics per horizon from (target, prediction) column pairs."""
    arr = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(a).alias("y"), F.col(b).alias("p")) for h, (a, b) in pairs.items()])
    long = df.select(*by, F.explode(arr).alias("x")).select(*by, "x.*")
    return regression_metrics(long, "y", "p", [*by, "horizon"])


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def rates(tp: Column, fp: Column, tn: Column, fn: Column) -> dict[str, Column]:
    """Ratios of confusion counts; an empty denominator gives 0."""
    prec, rec, spec = _ratio(tp, tp + fp), _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return {
        "accuracy": _ratio(tp + tn, tp + tn + fp + fn),
        "precision": prec,
        "recall": rec,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "specificity": spec,
        "balanced_accuracy": (rec + spec) / 2,
        "fpr": _ratio(fp, fp + tn),
        "fnr": _ratio(fn, fn + tp),
    }


def confusion(df: DataFrame, y: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    """M17."""
    n = lambda a, b: F.count_if((F.col(y) == a) & (F.col(pred) == b))
    c = df.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    return c.withColumns(rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")))


def class_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall and F1 per class (one row per class, from the pair counts)."""
    cells = df.groupBy(F.col(y).alias("_y"), F.col(pred).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    as_true = cells.groupBy(F.col("_y").alias("class")).agg(F.sum("_n").alias("support"), F.sum(F.when(F.col("_y") == F.col("_p"), F.col("_n")).otherwise(0)).alias("tp"))
    as_pred = cells.groupBy(F.col("_p").alias("class")).agg(F.sum("_n").alias("predicted"))
    j = as_true.join(as_pred, "class", "full").na.fill(0, ["support", "tp", "predicted"])
    return j.select(
        "class", "support",
        _ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        _ratio(F.col("tp"), F.col("support")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
    )


def macro(report: DataFrame) -> DataFrame:
    """M18."""
    return report.agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def log_loss(df: DataFrame, y: str, p: str, by: Sequence[str] = (), eps: float = 1e-15) -> DataFrame:
    """Binary log loss with clipped probabilities."""
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return df.groupBy(*by).agg((-F.avg(F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))).alias("log_loss"))


def score_curve(df: DataFrame, y: str, score: str, by: Sequence[str] = (), steps: int = SCORE_STEPS) -> DataFrame:
    """Counts at each distinct score and running true/false positives from the highest down.

    Rows are counted by score first; running counts are chunked by score, so one segment with
    most of the rows is ranked by many tasks.
    """
    by = list(by)
    cells = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    chunk = -F.floor(F.col("score") * steps)
    return running_sums(cells, by, ["score"], {"tp": F.col("pos"), "fp": F.col("neg")}, chunk=chunk, reverse=True)


def roc_auc(df: DataFrame, y: str, score: str, by: Sequence[str] = (), steps: int = SCORE_STEPS) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision per segment; one-class segments give null."""
    c = score_curve(df, y, score, by, steps)
    d = lambda x: F.col(x).cast("double")
    part = d("neg") * (d("tp") - d("pos") / 2)
    prec = d("pos") * d("tp") / (d("tp") + d("fp"))
    return c.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(part).alias("_u"), F.sum(prec).alias("_ap")).select(
        *by, "n_pos", "n_neg",
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_u") / (d("n_pos") * d("n_neg"))).alias("roc_auc"),
        F.when(F.col("n_pos") > 0, F.col("_ap") / d("n_pos")).alias("average_precision"),
    )


def roc_points(df: DataFrame, y: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision/recall points by distinct score."""
    c = score_curve(df, y, score, by)
    tot = c.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    j = c.join(tot, list(by)) if by else c.crossJoin(F.broadcast(tot))  # one row
    return j.select(
        *by, "score", _ratio(F.col("fp"), F.col("_n")).alias("fpr"), _ratio(F.col("tp"), F.col("_p")).alias("tpr"),
        _ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
    )


def threshold_table(df: DataFrame, y: str, score: str, lo: float = 0.05, hi: float = 0.95, step: float = 0.01) -> DataFrame:
    """Confusion rates at each threshold of a grid.

    Each row falls into one step of the grid; only step counts are accumulated.
    """
    grid = [round(lo + i * step, 10) for i in range(int(round((hi - lo) / step)) + 1)]
    passed = F.size(F.filter(F.array(*[F.lit(g) for g in grid]), lambda g: g <= F.col(score)))
    cells = df.filter(F.col(y).isNotNull() & F.col(score).isNotNull()).groupBy(passed.alias("_k")).agg(F.count_if(F.col(y) == 1).alias("_p"), F.count_if(F.col(y) == 0).alias("_n"))
    arr = F.array(*[F.struct(F.lit(i + 1).alias("_k"), F.lit(g).alias("threshold")) for i, g in enumerate(grid)])
    steps = df.sparkSession.range(1).select(F.explode(arr).alias("x")).select("x.*")
    full = steps.join(cells, "_k", "full").na.fill(0, ["_p", "_n"])  # at most one row per grid step
    above = Window.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    t = full.select("threshold", F.sum("_p").over(above).alias("tp"), F.sum("_n").over(above).alias("fp"), F.sum("_p").over(every).alias("_P"), F.sum("_n").over(every).alias("_N"))
    t = t.filter("threshold is not null").withColumn("fn", F.col("_P") - F.col("tp")).withColumn("tn", F.col("_N") - F.col("fp"))
    r = rates(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))
    return t.select("threshold", "tp", "fp", "tn", "fn", r["precision"].alias("precision"), r["recall"].alias("recall"), r["f1"].alias("f1"))


def best_threshold(df: DataFrame, y: str, score: str, lo: float = 0.05, hi: float = 0.95, step: float = 0.01) -> DataFrame:
    """The least threshold with the best F1."""
    return threshold_table(df, y, score, lo, hi, step).orderBy(F.col("f1").desc(), "threshold").limit(1)


def by_segments(df: DataFrame, segments: dict[str, Column], keep: Sequence[str]) -> DataFrame:
    """Rows repeated once per segmentation as (segment, level)."""
    arr = F.array(*[F.struct(F.lit(n).alias("segment"), c.cast("string").alias("level")) for n, c in segments.items()])
    return df.select(*keep, F.explode(arr).alias("_s")).select(*keep, "_s.segment", "_s.level").filter("level is not null")


def segment_regression(df: DataFrame, y: str, pred: str, segments: dict[str, Column], min_n: int = 50) -> DataFrame:
    """M22."""
    return regression_metrics(by_segments(df, segments, [y, pred]), y, pred, ["segment", "level"]).filter(F.col("n") >= min_n)


def segment_auc(df: DataFrame, y: str, score: str, segments: dict[str, Column], min_n: int = 50) -> DataFrame:
    """M22."""
    return roc_auc(by_segments(df, segments, [y, score]), y, score, ["segment", "level"]).filter(F.col("n_pos") + F.col("n_neg") >= min_n)
