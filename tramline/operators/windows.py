"""Window features of trips, stops, routes and bins (W1-W22), on the chunked operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.ordered import (
    key_stats,
    last_known,
    lookback_sums,
    mean_of,
    nth_prior,
    prior_rows,
    row_index,
    running_sums,
)


def lagged(df: DataFrame, by, order, value: str, n: int, width: float, prefix: str = "lag", source=None) -> DataFrame:
    """The n previous values of the key."""
    p = prior_rows(df, by, order, [value], n, width, "_p", source=source)
    return p.withColumns({f"{prefix}{i}": nth_prior("_p", value, i) for i in range(1, n + 1)}).drop("_p")


def lagged_filled(df: DataFrame, by, order, value: str, n: int, width: float, prefix: str = "lag") -> DataFrame:
    """Lags of the forward-filled value."""
    filled = last_known(df, by, order, value, width, "_f")
    return lagged(filled, by, order, "_f", n, width, prefix).drop("_f")


def headway(df: DataFrame, by, order, width: float, source=None) -> DataFrame:
    """Time since the previous passage of the key, and its ratio to the headway before (0 gives null)."""
    t = order[0]
    p = prior_rows(df, by, order, [t], 2, width, "_p", source=source)
    t1, t2 = nth_prior("_p", t, 1), nth_prior("_p", t, 2)
    now, prev = F.col(t) - t1, t1 - t2
    return p.withColumn("headway", now).withColumn("headway_ratio", now / F.nullif(prev.cast("double"), F.lit(0.0))).drop("_p")


def prev_mean(df: DataFrame, by, order, value: str, k: int, width: float, out: str, source=None) -> DataFrame:
    """Mean of the previous k values, current row excluded."""
    return prior_rows(df, by, order, [value], k, width, "_p", source=source).withColumn(out, mean_of("_p", value)).drop("_p")


def trip_progress(df: DataFrame, by: Sequence[str], t: str, width: float, out: str = "trip_progress") -> DataFrame:
    """Position of the row between the key's first and last time, in [0, 1]."""
    d = key_stats(df, by, [t], width, {"_a": ("min", t), "_b": ("max", t)})
    frac = (F.col(t) - F.col("_a")) / F.nullif((F.col("_b") - F.col("_a")).cast("double"), F.lit(0.0))
    return d.withColumn(out, frac).drop("_a", "_b")


def trip_end(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, scheduled: str, width: float, source: DataFrame | None = None) -> DataFrame:
    """Final value, scheduled time left and stops left of each row's trip, on one shuffle."""
    src = source if source is not None else df
    d = row_index(df, by, order, width, "_i", source=src, chunk_col="_trip_chunk")
    d = key_stats(d, by, order, width, {"final_value": ("last", value), "_last": ("max", scheduled), "_n": ("count", None)}, source=src, chunk_col="_trip_chunk")
    return (
        d.withColumn("time_left", F.col("_last") - F.col(scheduled))
        .withColumn("stops_left", F.col("_n") - F.col("_i"))
        .drop("_last", "_n", "_i", "_trip_chunk")
    )


def live_trip_end(df: DataFrame, schedule: DataFrame, by: Sequence[str], scheduled: str, position: str) -> DataFrame:
    """Stops and time left against the full schedule, not only what was seen."""
    ends = schedule.groupBy(*by).agg(F.max(scheduled).alias("_last"), F.max(position).alias("_n"))
    return (
        df.join(ends, list(by), "left")
        .withColumn("time_left", F.col("_last") - F.col(scheduled))
        .withColumn("stops_left", F.col("_n") - F.col(position))
        .drop("_last", "_n")
    )


def rolling_rows_sum(df: DataFrame, by, order, value: str, k: int, width: float, out: str) -> DataFrame:
    """Sum over the current and the k-1 previous rows, nulls skipped; null where all are null."""
    p = prior_rows(df, by, order, [value], k - 1, width, "_p")
    vals = F.filter(F.concat(F.col("_p")[value], F.array(value)), lambda x: x.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return p.withColumn(out, F.when(F.size(vals) > 0, total)).drop("_p")


def moving_average(df: DataFrame, by, order, value: str, k: int, width: float, out: str) -> DataFrame:
    """Mean over the current and the k-1 previous rows."""
    p = prior_rows(df, by, order, [value], k - 1, width, "_p")
    vals = F.filter(F.concat(F.col("_p")[value], F.array(value)), lambda x: x.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return p.withColumn(out, F.when(F.size(vals) > 0, total / F.size(vals))).drop("_p")


def bin_lags(df: DataFrame, by, t: str, value: str, n: int, bin_width: int, slack: int, width: float, prefix: str = "lag", tie: Sequence[str] = ()) -> DataFrame:
    """Lags over bins; a lag older than its own distance plus ``slack`` is null."""
    p = prior_rows(df, by, [t, *tie], [t, value], n, width, "_p")
    outs = {}
    for i in range(1, n + 1):
        gap = F.col(t) - nth_prior("_p", t, i)
        outs[f"{prefix}{i}"] = F.when(gap <= i * bin_width + slack, nth_prior("_p", value, i))
    return p.withColumns(outs).drop("_p")


def spaced_lags(df: DataFrame, by, order, value: str, steps: Sequence[int], width: float, prefix: str = "lag") -> DataFrame:
    """Lags at the given steps, absent ones 0."""
    p = prior_rows(df, by, order, [value], max(steps), width, "_p")
    return p.withColumns({f"{prefix}{k}": F.coalesce(nth_prior("_p", value, k), F.lit(0)) for k in steps}).drop("_p")


def rolling_line(df: DataFrame, by, order, value: str, k: int, width: float) -> DataFrame:
    """Mean, max and sample deviation of the k previous rows; a lone value deviates 0."""
    p = prior_rows(df, by, order, [value], k, width, "_p")
    v = F.filter(F.col("_p")[value], lambda x: x.isNotNull())
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
    p = p.withColumn("_v", v).withColumn("_m", F.when(n > 0, mean))
    ss = F.aggregate("_v", F.lit(0.0), lambda a, x: a + (x - F.col("_m")) * (x - F.col("_m")))
    m = F.size("_v")
    return (
        p.withColumn(f"roll{k}_mean", F.col("_m"))
        .withColumn(f"roll{k}_max", F.when(m > 0, F.array_max("_v")))
        .withColumn(f"roll{k}_std", F.when(m > 1, F.sqrt(ss / (m - 1))).otherwise(0.0))
        .drop("_p", "_v", "_m")
    )


def next_stop(df: DataFrame, by, order, fields: Sequence[str], width: float, prefix: str = "next_") -> DataFrame:
    """Values of the following row of the trip."""
    p = prior_rows(df, by, order, fields, 1, width, "_p", reverse=True)
    return p.withColumns({f"{prefix}{f}": nth_prior("_p", f, 1) for f in fields}).drop("_p")


def previous_stop(df: DataFrame, by, order, fields: Sequence[str], width: float, prefix: str = "prev_") -> DataFrame:
    """Values of the row before."""
    p = prior_rows(df, by, order, fields, 1, width, "_p")
    return p.withColumns({f"{prefix}{f}": nth_prior("_p", f, 1) for f in fields}).drop("_p")


def difference(df: DataFrame, by, order, value: str, width: float, out: str) -> DataFrame:
    """First difference per key."""
    p = prior_rows(df, by, order, [value], 1, width, "_p")
    return p.withColumn(out, F.col(value) - nth_prior("_p", value, 1)).drop("_p")


def rolling_time_stats(df: DataFrame, by, t: str, values: dict[str, str], span: int, count_out: str, width=None) -> DataFrame:
    """Means of the values and the row count over ``[t - span, t)`` of the key, in sub-blocks no wider than ``width``."""
    sums = {count_out: F.lit(1).cast("bigint")}
    for out, v in values.items():
        sums[f"_s_{out}"] = F.col(v)
        sums[f"_n_{out}"] = F.when(F.col(v).isNotNull(), 1).otherwise(0).cast("bigint")
    r = lookback_sums(df, df, by, t, t, span, sums, closed="left", width=width)
    return r.withColumns({o: F.when(F.col(f"_n_{o}") > 0, F.col(f"_s_{o}") / F.col(f"_n_{o}")) for o in values}).drop(
        *[f"_s_{o}" for o in values], *[f"_n_{o}" for o in values]
    )


def running_flags(df: DataFrame, by, order, flags: Sequence[str], width: float) -> DataFrame:
    """Running row count and running sums of flags."""
    sums = {"cum_rows": F.lit(1).cast("bigint"), **{f"cum_{f}": F.col(f).cast("bigint") for f in flags}}
    return running_sums(df, by, order, sums, width)


def fill_gaps(df: DataFrame, by, order, value: str, width: float, out: str) -> DataFrame:
    """Forward fill, then back fill, then 0."""
    f = last_known(df, by, order, value, width, "_ff")
    b = last_known(f, by, order, value, width, "_bf", reverse=True)
    return b.withColumn(out, F.coalesce("_ff", "_bf", F.lit(0.0))).drop("_ff", "_bf")


def imminent_stop(df: DataFrame, by, stops_left: str, tie: Sequence[str] = ()) -> DataFrame:
    """Per trip the row with the fewest stops left above zero."""
    w = Window.partitionBy(*by).orderBy(F.col(stops_left).asc(), *tie)
    return df.filter(F.col(stops_left) > 0).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def line_features(df: DataFrame, by, order, value: str, width: float) -> DataFrame:
    """Previous-5 mean and difference along a line."""
    p = prior_rows(df, by, order, [value], 5, width, "_p")
    return (
        p.withColumn("line_mean5", mean_of("_p", value)).withColumn("line_diff", F.col(value) - nth_prior("_p", value, 1)).drop("_p")
    )


def history(df: DataFrame, by, order, fields: Sequence[str], k: int, width: float, out: str = "history") -> DataFrame:
    """The k previous bins as an array, rows with a full history only."""
    return prior_rows(df, by, order, fields, k, width, out).filter(F.size(out) == k)
