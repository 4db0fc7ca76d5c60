"""Spark ML training, search, ablation and scoring."""

from __future__ import annotations

import itertools
import random
import time
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tramline.operators import metrics
from tramline.operators.ordered import positions


def _pipeline(features: Sequence[str], est) -> Pipeline:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep"), est])


def _ready(df: DataFrame, features: Sequence[str], label: str | None = None) -> DataFrame:
    """Numbers only, absent features 0; rows without a label are no training rows."""
    d = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features})
    return d if label is None else d.filter(F.col(label).isNotNull()).withColumn(label, F.col(label).cast("double"))


#: rows of one task of a trainer, which keeps several tables of them beside each other
FIT_ROWS = 100_000
#: rows up to which a search runs some fits side by side
SIDE_ROWS = 1_000_000


def _dealt(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None) -> DataFrame:
    """Training rows, the columns that a trainer reads only, in parts of about ``FIT_ROWS`` where there are more.

    A trainer keeps its rows as objects and reads all copies of its part in one task, so parts must not follow the size of files.
    """
    d = _ready(df, features, label).select(*dict.fromkeys([*features, label, *([weight] if weight else [])]))
    n = d.count()
    return d if n <= FIT_ROWS else d.repartition(max(d.sparkSession.sparkContext.defaultParallelism, -(-n // FIT_ROWS)))


def fit_boosted_regressor(train: DataFrame, features, label: str, weight: str | None = None, **params) -> PipelineModel:
    """Boosted trees with absolute loss."""
    est = GBTRegressor(featuresCol="features", labelCol=label, lossType="absolute", seed=42, **params)
    if weight:
        est = est.setWeightCol(weight)
    return _pipeline(features, est).fit(_dealt(train, features, label, weight))


def fit_boosted_classifier(train: DataFrame, features, label: str, weight: str | None = None, **params) -> PipelineModel:
    """M11."""
    est = GBTClassifier(featuresCol="features", labelCol=label, seed=42, **params)
    if weight:
        est = est.setWeightCol(weight)
    return _pipeline(features, est).fit(_dealt(train, features, label, weight))


def fit_forest(train: DataFrame, features, label: str, classify: bool = True, weight: str | None = None, **params) -> PipelineModel:
    """M12."""
    cls = RandomForestClassifier if classify else RandomForestRegressor
    est = cls(featuresCol="features", labelCol=label, seed=42, **params)
    if weight:
        est = est.setWeightCol(weight)
    return _pipeline(features, est).fit(_dealt(train, features, label, weight))


def fit_logistic(train: DataFrame, features, label: str, weight: str | None = None, **params) -> PipelineModel:
    """Binary or multinomial by the number of classes."""
    est = LogisticRegression(featuresCol="features", labelCol=label, **params)
    if weight:
        est = est.setWeightCol(weight)
    return _pipeline(features, est).fit(_dealt(train, features, label, weight))


def fit_boosted_classes(train: DataFrame, features, label: str, **params) -> PipelineModel:
    """Several delay classes, one boosted model against the rest each."""
    base = GBTClassifier(featuresCol="features", labelCol=label, seed=42, **params)
    return _pipeline(features, OneVsRest(classifier=base, featuresCol="features", labelCol=label)).fit(_dealt(train, features, label))


def score(model: PipelineModel, df: DataFrame, features: Sequence[str], threshold: float | None = None) -> DataFrame:
    """Predictions for whole tables; absent features count 0, the probability is a plain column."""
    out = model.transform(_ready(df, features))
    if "probability" in out.columns:
        out = out.withColumn("probability", vector_to_array("probability")[1])
        if threshold is not None:
            out = out.withColumn("flagged", (F.col("probability") >= threshold).cast("int"))
    return out.drop("features", "rawPrediction")


def importances(spark: SparkSession, model: PipelineModel, features: Sequence[str], top: int | None = None) -> DataFrame:
    """Percent importance per feature; linear models use absolute coefficients."""
    m = model.stages[-1]
    vals = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
    total = float(vals.sum()) or 1.0
    rows = [(f, float(v) / total * 100) for f, v in zip(features, vals)]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("feature", T.StringType()), T.StructField("importance_pct", T.DoubleType())]))
    df = df.orderBy(F.col("importance_pct").desc(), "feature")
    return df.limit(top) if top else df


def permute_columns(df: DataFrame, cols: Sequence[str], key: str, seed: int) -> DataFrame:
    """Rows with the given columns taken from another row; one permutation for all of them.

    Rows meet by position: the order of the key on one side, that of a hash of key and seed on the other.
    """
    a = positions(df.drop(*cols), [key], "_pos")
    mixed = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    b = positions(df.select(*cols, mixed.alias("_h"), F.col(key).alias("_k")), ["_h", "_k"], "_pos").drop("_h", "_k")
    return a.join(b, "_pos").drop("_pos").select(*df.columns)


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], label: str, groups: dict[str, Sequence[str]], key: str, seed: int = 42) -> DataFrame:
    """Growth of the mean absolute error when a group of features is permuted together."""
    base = metrics.regression_metrics(score(model, df, features), label, "prediction").select(F.col("mae").alias("base_mae"))
    out = None
    for name, cols in groups.items():
        p = permute_columns(df, cols, key, seed)
        m = metrics.regression_metrics(score(model, p, features), label, "prediction").select(F.lit(name).alias("group"), "mae")
        out = m if out is None else out.unionByName(m)
    return out.crossJoin(F.broadcast(base)).withColumn("delta_mae", F.col("mae") - F.col("base_mae"))  # one row


def param_grid(space: dict[str, Sequence], n: int | None = None, seed: int = 42) -> list[dict]:
    """The whole grid, or a seeded random part of it."""
    grid = [dict(zip(space, v)) for v in itertools.product(*space.values())]
    return grid if n is None or n >= len(grid) else random.Random(seed).sample(grid, n)


def search(train: DataFrame, valid: DataFrame, features, label: str, fit: Callable, candidates: Sequence[dict], metric: Callable[[DataFrame], float]) -> DataFrame:
    """Fit each candidate on the training part, judge it on the temporal validation part.

    The driver holds one small row per candidate; fitting and judging are Spark jobs.
    """
    rows = []
    for i, params in enumerate(candidates):
        t0 = time.time()
        model = fit(train, features, label, **params)
        rows.append((i, str(sorted(params.items())), float(metric(score(model, valid, features))), time.time() - t0))
    return train.sparkSession.createDataFrame(rows, "candidate int, params string, metric double, seconds double").orderBy("metric", "candidate")


def window_weight_search(df: DataFrame, month: str, windows: Sequence[int], schemes: Sequence[str], train_months: Sequence[str], valid: DataFrame, features, label: str, fit: Callable, metric: Callable[[DataFrame], float], **params) -> DataFrame:
    """Training windows of the newest months x recency weight schemes, one fit each.

    Fits of up to ``SIDE_ROWS`` rows are mostly short jobs, so a few run side by side; larger ones take the cluster one after the other.
    """
    from tramline.operators.prep import month_number, recency_weights

    order, spark = sorted(train_months, key=month_number), df.sparkSession

    def one(n: int, s: str) -> tuple:
        part = df.filter(F.col(month).isin(*order[-n:]))
        t0 = time.time()
        model = fit(recency_weights(part, month, s), features, label, weight="weight", **params)
        return n, s, float(metric(score(model, valid, features))), time.time() - t0

    with ThreadPool(4 if df.count() <= SIDE_ROWS else 1) as pool:
        rows = pool.starmap(inheritable_thread_target(spark)(one), itertools.product(windows, schemes))
    return spark.createDataFrame(rows, "months int, scheme string, metric double, seconds double").orderBy("metric")


def period_sums(df: DataFrame, period: str, features: Sequence[str], label: str) -> DataFrame:
    """Sums of products of (1, features, label) per period, from which every weighted linear fit follows; rows with nulls are left out.

    Columns ``p_i_j`` (i <= j), 0 being the constant and the last the label.
    """
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, label]]]
    known = df.na.drop(subset=[*features, label]).filter(F.col(period).isNotNull())
    return known.groupBy(period).agg(*[F.sum(cols[i] * cols[j]).alias(f"p_{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))])


def _moments(rows: list, size: int) -> dict:
    """Symmetric matrix of products per period."""
    out = {}
    for r in rows:
        m = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                m[i, j] = m[j, i] = r[f"p_{i}_{j}"]
        out[r[0]] = m
    return out


def solve(m: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Coefficients of the least squares fit with products ``m``; ``ridge`` weighs the squares of all but the constant."""
    g, b = m[:-1, :-1], m[:-1, -1]
    pull = ridge * np.eye(len(g))
    pull[0, 0] = 0.0
    return np.linalg.lstsq(g + pull, b, rcond=None)[0]


def squared_error(m: np.ndarray, beta: np.ndarray) -> float:
    """Sum of squared errors of a fit over the rows behind ``m``, which need not be read again."""
    v = np.append(-beta, 1.0)
    return max(0.0, float(v @ m @ v))


def scheme_weights(n: int, scheme: str) -> np.ndarray:
    """M6 for n periods in order: uniform, linear, exponential (x10 over the span) or step; mean 1."""
    w = {"uniform": np.ones(n), "linear": np.arange(1.0, n + 1), "exponential": np.exp(np.log(10) / max(n - 1, 1) * np.arange(n)), "step": np.array([1.0] * (n - 2) + [1.5, 3.0])[-n:]}[scheme]
    return w / w.mean()


def window_weight_fits(train: DataFrame, valid: DataFrame, period: str, windows: Sequence[int], schemes: Sequence[str], features: Sequence[str], label: str, ridge: float = 0.0) -> DataFrame:
    """Training windows of the newest periods x recency weights, all combinations from one pass over each part.

    The training part is read once for its sums of products per period; each combination solves their weighted sum. The
    validation part is read once for the errors of all fits. The driver holds one small matrix per period and one row per combination.
    """
    from tramline.operators.prep import month_number

    size = len(features) + 2
    sums = _moments(period_sums(train, period, features, label).collect(), size)
    order = sorted(sums, key=month_number)
    fits = []
    for n in windows:
        part = [sums[p] for p in order[-n:]]
        for s in schemes:
            if part:
                beta = solve(sum(w * m for w, m in zip(scheme_weights(len(part), s), part)), ridge)
                whole = sum(part)
                fits.append((n, s, len(part), int(whole[0, 0]), float(np.sqrt(squared_error(whole, beta) / whole[0, 0])), beta.tolist()))
    known = valid.na.drop(subset=[*features, label])
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in features]]
    off = [F.col(label) - sum((F.lit(b) * c for b, c in zip(f[5][1:], x[1:])), F.lit(f[5][0])) for f in fits]
    aggs = [e.alias(f"{k}{i}") for i, o in enumerate(off) for k, e in (("a", F.avg(F.abs(o))), ("s", F.avg(o * o)))]
    got = known.agg(F.var_pop(label).alias("v"), *aggs).first()
    rows = []
    for i, f in enumerate(fits):
        mse, var = got[f"s{i}"], got["v"]
        rows.append((*f, got[f"a{i}"], None if mse is None else float(np.sqrt(mse)), None if not var else 1 - mse / var))
    schema = "window int, scheme string, n_periods int, n_train long, train_rmse double, coefficients array<double>, test_mae double, test_rmse double, test_r2 double"
    return train.sparkSession.createDataFrame(rows, schema)


def compare_strategies(train: DataFrame, valid: DataFrame, features: Sequence[str], label: str, subsets: dict[str, Sequence[str]], ridges: Sequence[float], draws: int, seed: int = 42) -> DataFrame:
    """The best candidate of a full grid and of a random part of it beside the plain fit, with candidates and seconds per strategy.

    Candidates are a subset of the features and a ridge. Sums of products of both parts are taken once; a candidate is then a small system on the
    driver, judged on the temporal validation part by its root mean squared error.
    """
    t0 = time.time()
    one = lambda df: _moments(period_sums(df.withColumn("_all", F.lit(0)), "_all", features, label).collect(), len(features) + 2).get(0)
    a, b = one(train), one(valid)
    read = time.time() - t0
    grid = param_grid({"subset": list(subsets), "ridge": list(ridges)})
    plans = {"plain": [{"subset": next(iter(subsets)), "ridge": 0.0}], "random": param_grid({"subset": list(subsets), "ridge": list(ridges)}, draws, seed), "grid": grid}
    rows = []
    for name, candidates in plans.items():
        t0, found = time.time(), []
        for c in candidates if a is not None and b is not None else []:
            at = [0, *[1 + list(features).index(f) for f in subsets[c["subset"]]], len(features) + 1]
            m, v = a[np.ix_(at, at)], b[np.ix_(at, at)]
            found.append((float(np.sqrt(squared_error(v, solve(m, c["ridge"])) / v[0, 0])), c["subset"], float(c["ridge"])))
        if found:
            rows.append((name, len(candidates), *min(found), read + time.time() - t0))
    return train.sparkSession.createDataFrame(rows, "strategy string, candidates int, valid_rmse double, subset string, ridge double, seconds double")


def ablation(train: DataFrame, valid: DataFrame, label: str, fit: Callable, subsets: dict[str, Sequence[str]], metric: Callable[[DataFrame], float], **params) -> DataFrame:
    """Same parameters, other feature subsets."""
    rows = []
    for name, feats in subsets.items():
        model = fit(train, feats, label, **params)
        rows.append((name, len(feats), float(metric(score(model, valid, feats)))))
    return train.sparkSession.createDataFrame(rows, "subset string, n_features int, metric double").orderBy("metric", "subset")


def mae_of(label: str) -> Callable[[DataFrame], float]:
    return lambda scored: metrics.regression_metrics(scored, label, "prediction").first()["mae"]


def save_prep(path: str, model: PipelineModel | None = None, **tables: DataFrame) -> None:
    """Fitted model and its lookup tables side by side."""
    if model is not None:
        model.write().overwrite().save(f"{path}/model")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_prep(spark, path: str, *tables: str) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """S16."""
    return PipelineModel.load(f"{path}/model"), {t: spark.read.parquet(f"{path}/{t}") for t in tables}
