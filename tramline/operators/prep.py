"""Feature preparation from training data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.ordered import positions


def vocabulary(train: DataFrame, col: str) -> DataFrame:
    """M1/M2: codes of the training values in their order, from 0; texts and numbers alike, however alike they begin."""
    vals = train.select(col).filter(F.col(col).isNotNull()).distinct()
    return positions(vals, [col], "_i").select(col, (F.col("_i") - 1).cast("int").alias("code"))


def encode(df: DataFrame, vocab: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """M1/M2: code of a value, unknown -1."""
    out = out or f"{col}_code"
    v = vocab.select(F.col(col), F.col("code").alias(out))
    return df.join(v, col, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


def target_encode(df: DataFrame, train: DataFrame, col: str, target: str, out: str | None = None, leave_one_out: bool = False) -> DataFrame:
    """M3: training mean of the key, unknown keys the global mean.

    ``leave_one_out`` takes the row's own target out of its mean (for training rows).
    """
    out = out or f"{col}_target_enc"
    g = train.agg(F.avg(target).alias("_global"))
    m = train.groupBy(col).agg(F.sum(target).alias("_sum"), F.count(target).alias("_n"))
    j = df.join(m, col, "left").crossJoin(F.broadcast(g))  # one row
    if leave_one_out:
        own = F.when(F.col(target).isNotNull(), 1).otherwise(0)
        mean = (F.col("_sum") - F.coalesce(F.col(target), F.lit(0.0))) / F.nullif(F.col("_n") - own, F.lit(0))
    else:
        mean = F.col("_sum") / F.nullif(F.col("_n"), F.lit(0))
    return j.withColumn(out, F.coalesce(mean, F.col("_global"))).drop("_sum", "_n", "_global")


def standard_stats(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """M4: one row with mean and population deviation per column."""
    return train.agg(*[x for c in cols for x in (F.avg(c).alias(f"mu_{c}"), F.stddev_pop(c).alias(f"sd_{c}"))])


def standardize(df: DataFrame, stats: DataFrame, cols: Sequence[str], inverse: bool = False) -> DataFrame:
    """M4: (x - mean) / deviation and back; a constant column is only centred."""
    j = df.crossJoin(F.broadcast(stats))  # one row
    out = {}
    for c in cols:
        sd = F.when(F.col(f"sd_{c}") == 0, 1.0).otherwise(F.col(f"sd_{c}"))
        out[c] = F.col(c) * sd + F.col(f"mu_{c}") if inverse else (F.col(c) - F.col(f"mu_{c}")) / sd
    return j.withColumns(out).select(*df.columns)


def impute(df: DataFrame, train: DataFrame, numeric: Sequence[str] = (), categorical: Sequence[str] = ()) -> DataFrame:
    """M5: training median for numbers, most frequent value (least on ties) for categories."""
    from tramline.operators.quantiles import exact_quantiles

    fills = [exact_quantiles(train, [], c, {f"_f_{c}": 0.5}) for c in numeric]
    for c in categorical:
        n = train.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        fills.append(n.agg(F.min_by(c, F.struct(-F.col("_n"), c)).alias(f"_f_{c}")))
    j = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), fills, df)  # one row each
    return j.withColumns({c: F.coalesce(F.col(c), F.col(f"_f_{c}")) for c in [*numeric, *categorical]}).select(*df.columns)


def month_number(label) -> tuple[int, str]:
    """Order of month labels: the number in them, then the text."""
    digits = "".join(c for c in str(label) if c.isdecimal())
    return int(digits or -1), str(label)


def recency_weights(df: DataFrame, month: str, scheme: str, out: str = "weight") -> DataFrame:
    """M6: weight by month rank: uniform, linear, exponential (x10 over the span) or step; mean 1 over months.

    Month labels are ordered by the number in them (``2024-12``, ``w10``), then as text.
    """
    m = df.select(month).distinct()
    number = F.regexp_replace(F.col(month).cast("string"), "[^0-9]", "").try_cast("bigint")
    w = Window.orderBy(number, month)  # months are few
    every = Window.partitionBy()
    m = m.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(every))
    raw = {
        "uniform": F.lit(1.0),
        "linear": (F.col("_i") + 1).cast("double"),
        "exponential": F.exp(F.log(F.lit(10.0)) / F.greatest(F.col("_n") - 1, F.lit(1)) * F.col("_i")),
        "step": F.when(F.col("_i") == F.col("_n") - 1, 3.0).when(F.col("_i") == F.col("_n") - 2, 1.5).otherwise(1.0),
    }[scheme]
    m = m.withColumn("_w", raw).withColumn(out, F.col("_w") / F.avg("_w").over(every)).select(month, out)
    return df.join(m, month, "left")


def one_hot(df: DataFrame, col: str, values: Sequence, drop_first: bool = True) -> DataFrame:
    """M7: indicator columns in value order, the first dropped."""
    vals = sorted(values)[1 if drop_first else 0 :]
    return df.withColumns({f"{col}_{v}": F.coalesce((F.col(col) == v).cast("int"), F.lit(0)) for v in vals})


def improves(delta: str) -> Column:
    """M8: the delay shrinks."""
    return F.when(F.col(delta) < 0, 1).when(F.col(delta).isNotNull(), 0)


def imbalance(df: DataFrame, y: str) -> DataFrame:
    """M9: negatives per positive, and whether classes are unbalanced."""
    c = df.agg(F.count_if(F.col(y) == 1).alias("n_pos"), F.count_if(F.col(y) == 0).alias("n_neg"))
    r = F.col("n_neg") / F.nullif(F.col("n_pos"), F.lit(0))
    return c.withColumn("scale_pos_weight", r).withColumn("unbalanced", F.coalesce((r > 1.5) | (r < 1 / 1.5), F.lit(True)))


def mean_baseline(train: DataFrame, test: DataFrame, y: str, out: str = "prediction") -> DataFrame:
    """The training mean for every row."""
    return test.crossJoin(F.broadcast(train.agg(F.avg(y).alias(out))))  # one row


def persistence_baseline(df: DataFrame, current: str, out: str = "prediction") -> DataFrame:
    """The present value lasts."""
    return df.withColumn(out, F.col(current))


def majority_baseline(train: DataFrame, test: DataFrame, y: str, out: str = "prediction") -> DataFrame:
    """The most frequent training class."""
    n = train.filter(F.col(y).isNotNull()).groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    return test.crossJoin(F.broadcast(n.agg(F.min_by(y, F.struct(-F.col("_n"), y)).alias(out))))  # one row


def random_baseline(train: DataFrame, test: DataFrame, y: str, key: str, out: str = "prediction") -> DataFrame:
    """Stratified random class; the key's hash plays the dice, so runs repeat."""
    p = train.agg(F.avg(F.col(y).cast("double")).alias("_p"))
    u = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("double") / float(16**8)
    return test.crossJoin(F.broadcast(p)).withColumn(out, (u < F.col("_p")).cast("int")).drop("_p")  # one row
