"""Grouped aggregates (A1-A39). Every group-by combines map-side; quantiles come from counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.fixed import EXTERIOR_LINES
from tramline.operators.quantiles import exact_quantiles, quantile_bins
from tramline.session import cut


def _valued(v: str, order: Sequence[str]) -> Column:
    return F.when(F.col(v).isNotNull(), F.struct(*order))


def first_by(v: str, order: Sequence[str]) -> Column:
    """First non-null value in the stated order."""
    return F.min_by(v, _valued(v, order))


def last_by(v: str, order: Sequence[str]) -> Column:
    return F.max_by(v, _valued(v, order))


def collapse_alerts(df: DataFrame, key: str, t: str, first: Sequence[str], last: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """A1: one row per alert: start, end, first and last values, number of updates after the first."""
    order = [t, *tie]
    return df.groupBy(key).agg(
        F.min(t).alias("timestamp_start"),
        F.max(t).alias("timestamp_end"),
        *[first_by(c, order).alias(c) for c in first],
        *[last_by(c, order).alias(c) for c in last],
        F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("num_updates"),
    )


def count_updates(df: DataFrame, key: str, out: str = "num_updates") -> DataFrame:
    """A2: repetitions of the event minus one, on every row (count first, then join)."""
    n = df.groupBy(key).agg((F.count(F.lit(1)) - 1).alias(out))
    return df.join(n, key, "left")


def onehot_sums(col: str, values: Sequence[str], prefix: str | None = None) -> list[Column]:
    """A5: rows per category as columns."""
    prefix = prefix or col
    return [F.sum(F.when(F.col(col) == v, 1).otherwise(0)).alias(f"{prefix}_{v}_sum") for v in values]


#: fixed values: what the window aggregate does with each column, by name
WINDOW_MAX = (
    "is_unscheduled", "is_weekend", "temp_extreme", "afecta_previo", "afecta_durante", "afecta_despues",
    "is_alert_just_published", "alert_in_next_15m", "alert_in_next_30m", "n_eventos_afectando",
)
WINDOW_MEAN_MAX = (
    "delay_seconds", "lagged_delay_1", "lagged_delay_2", "route_rolling_delay",
    "target_delay_10m", "target_delay_20m", "target_delay_30m", "target_delay_45m", "target_delay_60m",
    "station_delay_10m", "station_delay_20m", "station_delay_30m", "target_delay_end",
    "delta_delay_10m", "delta_delay_20m", "delta_delay_30m", "delta_delay_45m", "delta_delay_60m", "delta_delay_end",
)
WINDOW_MEAN = ("actual_headway_seconds", "stops_to_end", "scheduled_time_to_end", "seconds_since_last_alert", "seconds_to_next_alert")
WINDOW_FIRST = ("hour_sin", "hour_cos", "dow")
DELAY_LIMIT_S = 43_200


def window_aggregate(
    df: DataFrame, t: str, width: int, keys: Sequence[str] = ("stop_id", "route_id", "direction"), trip: str = "match_key",
    onehot: dict[str, Sequence[str]] | None = None, tie: Sequence[str] = (), clip: float = DELAY_LIMIT_S,
) -> DataFrame:
    """Tumbling bins by stop, route and direction with flattened column names.

    ``t`` is a numeric time; delays beyond the clip are null. Absent columns are skipped, rows with a
    null key or time belong to no bin.
    """
    have = set(df.columns)
    df = df.na.drop(subset=[*keys, t])
    num = lambda c: F.col(c).cast("double") if dict(df.dtypes)[c] != "boolean" else F.col(c).cast("int")
    aggs: list[Column] = []
    for c in WINDOW_MAX:
        if c in have:
            aggs.append(F.max(num(c)).alias(f"{c}_max"))
    for c in WINDOW_MEAN_MAX:
        if c in have:
            v = F.when(F.abs(F.col(c)) <= clip, F.col(c))
            aggs += [F.avg(v).alias(f"{c}_mean"), F.max(v).alias(f"{c}_max")]
    if trip in have:
        aggs.append(F.countDistinct(trip).alias(f"{trip}_nunique"))
    for c in WINDOW_MEAN:
        if c in have:
            aggs.append(F.avg(c).alias(f"{c}_mean"))
    aggs.append(F.avg(t).alias("merge_time_mean"))
    if "num_updates" in have:
        aggs.append(F.coalesce(F.sum("num_updates"), F.lit(0)).alias("num_updates_sum"))
    for c in WINDOW_FIRST:
        if c in have:
            aggs.append(first_by(c, [t, *tie]).alias(f"{c}_first"))
    for c, values in (onehot or {}).items():
        aggs += onehot_sums(c, values)
    start = (F.floor(F.col(t) / width) * width).cast("bigint").alias("bin")
    return df.groupBy(*keys, start).agg(*aggs)


def snapshot_bin(t: Column, width: int) -> Column:
    """A4: a snapshot in the second half of a bin belongs to it, else to the bin before."""
    start = (F.floor(t / width) * width).cast("bigint")
    return F.when(t - start >= width / 2, start).otherwise(start - width)


def line_aggregate(df: DataFrame, t: str, width: int, target: str, keys: Sequence[str] = ("route_id", "direction"), delayed_s: float = 60.0, tie: Sequence[str] = ("stop_id",)) -> DataFrame:
    """Window rows to line rows of 30 minutes."""
    late = (F.col("delay_seconds_mean") > delayed_s).cast("int")
    order = [t, *tie]
    start = (F.floor(F.col(t) / width) * width).cast("bigint").alias("bin")
    d = df.filter(F.col(target).isNotNull()).groupBy(*keys, start).agg(
        F.avg("delay_seconds_mean").alias("delay_mean_line"),
        F.max("delay_seconds_mean").alias("delay_max_line"),
        F.stddev_samp("delay_seconds_mean").alias("delay_std_line"),
        F.coalesce(F.sum(late), F.lit(0)).alias("stops_delayed"),
        F.count(F.lit(1)).alias("stops_total"),
        *[F.avg(f"delay_{i}_before").alias(f"delay_{i}_before_mean") for i in (1, 2, 3)],
        F.avg("actual_headway_seconds_mean").alias("headway_mean_line"),
        F.stddev_samp("actual_headway_seconds_mean").alias("headway_std_line"),
        F.max("is_unscheduled_max").alias("is_unscheduled"),
        F.coalesce(F.sum("num_updates_sum"), F.lit(0)).alias("num_updates"),
        F.coalesce(F.sum("match_key_nunique"), F.lit(0)).alias("match_key_nunique"),
        *[first_by(f"{c}_first", order).alias(c) for c in WINDOW_FIRST],
        F.max("is_weekend_max").alias("is_weekend"),
        F.coalesce(F.min("seconds_since_last_alert_mean"), F.lit(999_999.0)).alias("seconds_since_alert_line"),
        F.max(target).cast("int").alias("target"),
    )
    pct = F.col("stops_delayed") / F.greatest("stops_total", F.lit(1))
    acc = F.col("delay_mean_line") - F.col("delay_1_before_mean")
    return d.withColumns(
        {
            "pct_stops_delayed": pct,
            "delay_acceleration_line": acc,
            "headway_cv": F.col("headway_std_line") / F.when(F.col("headway_mean_line").isNotNull(), F.greatest("headway_mean_line", F.lit(1.0))),
            "collapse_line": (pct > 0.5).cast("int"),
            "delay_x_acceleration": F.col("delay_mean_line") * F.when(acc.isNotNull(), F.greatest(acc, F.lit(0.0))),
        }
    )


def build_edges(df: DataFrame, trip: Sequence[str], order: Sequence[str], stop: str, t: str, width: float, min_count: int = 0) -> DataFrame:
    """Directed edges between consecutive stops with median travel time and trip count."""
    from tramline.operators.windows import next_stop

    nxt = next_stop(df, trip, order, [stop, t], width)
    e = nxt.withColumn("travel_time", F.col(f"next_{t}") - F.col(t)).filter(F.col(f"next_{stop}").isNotNull() & (F.col("travel_time") > 0))
    # the chain is followed once; counts and medians come from the counted travel times
    e = cut(e.groupBy(F.col(stop).alias("src"), F.col(f"next_{stop}").alias("dst"), "travel_time").agg(F.count(F.lit(1)).alias("_n")), "edges")
    n = e.groupBy("src", "dst").agg(F.sum("_n").alias("trip_count"))
    med = exact_quantiles(e, ["src", "dst"], "travel_time", {"median_travel_time": 0.5}, weight="_n")
    return n.filter(F.col("trip_count") > min_count).join(med, ["src", "dst"])


def bin_aggregate(df: DataFrame, keys: Sequence[str], t: str, width: int, mean: Sequence[str] = (), total: Sequence[str] = (), top: Sequence[str] = ()) -> DataFrame:
    """Bins with mean, sum or maximum by column."""
    start = (F.floor(F.col(t) / width) * width).cast("bigint").alias("bin")
    return df.groupBy(*keys, start).agg(
        *[F.avg(c).alias(f"{c}_mean") for c in mean], *[F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}_sum") for c in total], *[F.max(c).alias(f"{c}_max") for c in top]
    )


def historical_average(train: DataFrame, test: DataFrame, stop: str, slot: Sequence[str], value: str, out: str = "expected") -> DataFrame:
    """A10: train mean of (stop, slot), else of the stop, else of the network."""
    fine = train.groupBy(stop, *slot).agg(F.avg(value).alias("_fine"))
    coarse = train.groupBy(stop).agg(F.avg(value).alias("_coarse"))
    world = train.agg(F.avg(value).alias("_world"))
    j = test.join(fine, [stop, *slot], "left").join(coarse, [stop], "left").crossJoin(F.broadcast(world))  # one row
    return j.withColumn(out, F.coalesce("_fine", "_coarse", "_world")).drop("_fine", "_coarse", "_world")


def fuse_events(df: DataFrame, keys: Sequence[str], score: str, kind: str, stations: str) -> DataFrame:
    """One event from several sources: best score, its type, union of stations.

    Stations are made distinct per key before they are listed, so a list is bounded by the network.
    """
    top = df.groupBy(*keys).agg(F.max(score).alias(score), F.max_by(kind, F.when(F.col(kind).isNotNull(), F.struct(F.coalesce(F.col(score), F.lit(float("-inf"))), kind))).alias(kind))
    st = df.select(*keys, F.explode(stations).alias("_s")).distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("_s")).alias(stations))
    return top.join(st, list(keys), "left")


def quality_report(before: DataFrame, after: DataFrame, col: str) -> DataFrame:
    """One row: sizes, nulls per column, and the statistics of one column."""
    b = before.agg(F.count(F.lit(1)).alias("rows_before"))
    a = after.agg(
        F.count(F.lit(1)).alias("rows_after"),
        *[F.sum(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in after.columns],
        F.min(col).alias("min"), F.max(col).alias("max"), F.avg(col).alias("mean"),
    )
    q = exact_quantiles(after, [], col, {"p50": 0.5, "p95": 0.95})
    return b.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(q))  # one row each


def profile(df: DataFrame) -> DataFrame:
    """Per column the non-null count, null share and distinct count, one pass."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")]
    for i, c in enumerate(df.columns):
        aggs += [F.count(c).alias(f"_c{i}"), F.countDistinct(c).alias(f"_d{i}")]
    one = df.agg(*aggs)
    cols = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("non_null"), F.col(f"_d{i}").alias("distinct_values")) for i, c in enumerate(df.columns)])
    x = one.select("_n", F.explode(cols).alias("x"))
    return x.select("x.*", ((F.col("_n") - F.col("x.non_null")) / F.col("_n")).alias("null_share"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each equal set."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    return g.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicate_rows"))


def describe_col(df: DataFrame, col: str, tails: Sequence[float] = (0.90, 0.95, 0.99)) -> DataFrame:
    """Count, mean, deviation, range, quartiles, zero share, and rows above upper percentiles."""
    pct = {f"p{round(q * 100)}": q for q in (0.25, 0.5, 0.75, *tails)}
    q = exact_quantiles(df, [], col, pct)
    s = df.crossJoin(F.broadcast(q))  # one row
    names = list(pct)
    return s.groupBy(*names).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.min(col).alias("min"), F.max(col).alias("max"),
        F.avg((F.col(col) == 0).cast("int")).alias("zero_share"),
        *[F.count_if(F.col(col) > F.col(f"p{round(t * 100)}")).alias(f"above_p{round(t * 100)}") for t in tails],
    )


def grouped_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Mean, deviation, count, range, median and p95 per group."""
    base = df.groupBy(*by).agg(F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"), F.count(col).alias("count"), F.min(col).alias("min"), F.max(col).alias("max"))
    return base.join(exact_quantiles(df, by, col, {"median": 0.5, "p95": 0.95}), list(by), "left")


def pivot_mean(df: DataFrame, row: str, col: str, value: str, values: Sequence) -> DataFrame:
    """Mean by row and column, columns spread out."""
    return df.groupBy(row).agg(*[F.avg(F.when(F.col(col) == v, F.col(value))).alias(f"{col}_{v}") for v in values])


def extreme_column(df: DataFrame, row: str, col: str, value: str) -> DataFrame:
    """The column with the highest and lowest mean per row (least column on ties)."""
    m = df.groupBy(row, col).agg(F.avg(value).alias("_m")).filter("_m is not null")
    return m.groupBy(row).agg(
        F.min_by(col, F.struct(-F.col("_m"), col)).alias("worst"), F.min_by(col, F.struct("_m", col)).alias("best")
    )


def corr_pairs(df: DataFrame, cols: Sequence[str], minimum: float | None = None) -> DataFrame:
    """Pearson correlation of all column pairs, pairwise complete, in one pass."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"_r{i}") for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    out = one.select(F.explode(arr).alias("x")).select("x.*")
    return out if minimum is None else out.filter(F.abs("r") > minimum)


def corr_with(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Correlation of each column with one target."""
    one = df.agg(*[F.corr(c, target).alias(f"_r{i}") for i, c in enumerate(cols)])
    arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_r{i}").alias("r")) for i, c in enumerate(cols)])
    return one.select(F.explode(arr).alias("x")).select("x.*")


def stats_per_bin(df: DataFrame, col: str, q: int, value: str) -> DataFrame:
    """Mean and count of a value in equal-frequency bins of a column."""
    return quantile_bins(df, col, q).groupBy("bin").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def share_by(df: DataFrame, by: Sequence[str], cond: Column, out: str = "share") -> DataFrame:
    """A20."""
    return df.groupBy(*by).agg((F.count_if(cond) / F.count(F.lit(1))).alias(out), F.count(F.lit(1)).alias("n"))


def conditional_mean(df: DataFrame, cond: Column, by: Sequence[str], value: str) -> DataFrame:
    """A21."""
    return df.filter(cond).groupBy(*by).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def platform_pairs(df: DataFrame, stop: str) -> DataFrame:
    """Bases that lack one of their two platforms."""
    base = F.regexp_extract(stop, r"^(.*)([NS])$", 1)
    side = F.regexp_extract(stop, r"^(.*)([NS])$", 2)
    g = df.filter(F.col(stop).rlike("[NS]$")).groupBy(base.alias("base")).agg(F.bool_or(side == "N").alias("has_n"), F.bool_or(side == "S").alias("has_s"))
    return g.withColumn("complete", F.col("has_n") & F.col("has_s"))


def alert_calendar(alerts: DataFrame, key: str, day: str) -> DataFrame:
    """Distinct alerts per calendar day, missing days 0."""
    n = alerts.groupBy(day).agg(F.countDistinct(key).alias("n_alerts"))
    span = n.agg(F.min(day).alias("_a"), F.max(day).alias("_b"))
    days = span.select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))
    return days.join(n, day, "left").select(day, F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), F.weekday(day).alias("dow"))


def distinct_per_slot(alerts: DataFrame, key: str, slot: Column, values: Sequence, out: str = "slot") -> DataFrame:
    """Distinct alerts per hour, weekday or category; slots without any are 0."""
    n = alerts.groupBy(slot.alias(out)).agg(F.countDistinct(key).alias("n_alerts"))
    every = alerts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(out))
    return every.join(n, out, "left").na.fill(0, ["n_alerts"])


def weekend_share(calendar: DataFrame) -> DataFrame:
    """Observed against expected share of alerts on weekdays and weekends."""
    g = calendar.groupBy((F.col("dow") >= 5).alias("weekend")).agg(F.sum("n_alerts").alias("n"))
    total = calendar.agg(F.sum("n_alerts").alias("_all"))
    return g.crossJoin(F.broadcast(total)).select(  # one row
        "weekend", "n", (F.col("n") / F.col("_all")).alias("observed"), F.when(F.col("weekend"), 2 / 7).otherwise(5 / 7).alias("expected")
    )


def effect_diff(df: DataFrame, by: Sequence[str], flag: str, value: str) -> DataFrame:
    """Mean with the flag minus mean without."""
    on = F.avg(F.when(F.col(flag) == 1, F.col(value)))
    off = F.avg(F.when(F.col(flag) == 0, F.col(value)))
    return df.groupBy(*by).agg(on.alias("mean_with"), off.alias("mean_without"), (on - off).alias("effect"))


def relative_curve(df: DataFrame, rel: str, value: str, lo: float, hi: float, width: float, by: Sequence[str] = ()) -> DataFrame:
    """Mean by relative bin inside ``[lo, hi]``."""
    b = (F.floor(F.col(rel) / width) * width).cast("bigint").alias("rel_bin")
    return df.filter(F.col(rel).between(lo, hi) & F.col(value).isNotNull()).groupBy(*by, b).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def temp_extreme(df: DataFrame, by: Sequence[str], temp: str, min_rows: int = 10, low: float = -5, high: float = 35, out: str = "temp_extreme") -> DataFrame:
    """Outside the day's own 10th and 90th percentile, or fixed bounds on short days.

    Rows are hours, so a group holds a day's two dozen values and one aggregate serves.
    """
    q = df.groupBy(*by).agg(F.percentile(temp, F.lit(0.10)).alias("_p10"), F.percentile(temp, F.lit(0.90)).alias("_p90"), F.count(temp).alias("_n"))
    own = (F.col(temp) < F.col("_p10")) | (F.col(temp) > F.col("_p90"))
    fixed = (F.col(temp) < low) | (F.col(temp) > high)
    flag = F.coalesce(F.when(F.col("_n") >= min_rows, own).otherwise(fixed), F.lit(False)).cast("int")
    return df.join(q, list(by), "left").withColumn(out, flag).drop("_p10", "_p90", "_n")


def drift_report(ref: DataFrame, cur: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of each column in two periods and the percent shift."""
    def means(df: DataFrame, side: str) -> DataFrame:
        one = df.agg(*[F.avg(c).alias(c) for c in cols])
        arr = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias(side)) for c in cols])
        return one.select(F.explode(arr).alias("x")).select("x.*")

    j = means(ref, "mean_ref").join(means(cur, "mean_cur"), "column")
    return j.withColumn("shift_pct", (F.col("mean_cur") - F.col("mean_ref")) / F.nullif(F.abs("mean_ref"), F.lit(0.0)) * 100)


def null_share(df: DataFrame, by: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """A31."""
    return df.groupBy(*by).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(f"null_{c}") for c in cols])


def prevalence(df: DataFrame, by: Sequence[str], target: str) -> DataFrame:
    """A32."""
    return df.groupBy(*by).agg(F.avg(F.col(target).cast("double")).alias("prevalence"), F.count(target).alias("n"))


def representative_trip(df: DataFrame, group: Sequence[str], trip: str) -> DataFrame:
    """Per group the trip with most stops (least id on ties)."""
    n = df.groupBy(*group, trip).agg(F.count(F.lit(1)).alias("n_stops"))
    return n.groupBy(*group).agg(F.min_by(trip, F.struct(-F.col("n_stops"), trip)).alias(trip), F.max("n_stops").alias("n_stops"))


def freq_compare(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Relative frequency of a category in two tables."""
    def freq(df: DataFrame, out: str) -> DataFrame:
        total = df.agg(F.count(F.lit(1)).alias("_t"))
        g = df.groupBy(col).agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total))  # one row
        return g.select(col, (F.col("_n") / F.col("_t")).alias(out))

    return freq(a, "freq_a").join(freq(b, "freq_b"), col, "full").na.fill(0.0, ["freq_a", "freq_b"])


def month_sizes(df: DataFrame, day: str) -> DataFrame:
    """A35."""
    return df.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def severity_index(df: DataFrame, cols: Sequence[str], out: str = "severity") -> DataFrame:
    """Sum of sample z-scores; a constant column adds nothing."""
    st = df.agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    z = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / F.nullif(F.col(f"_s_{c}"), F.lit(0.0)), F.lit(0.0)) for c in cols]
    return df.crossJoin(F.broadcast(st)).withColumn(out, reduce(lambda a, b: a + b, z)).select(*df.columns, out)  # one row


def linear_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line."""
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def weather_effect(df: DataFrame, flags: Sequence[str], value: str) -> DataFrame:
    """Mean of a value with and without each weather flag."""
    one = df.agg(*[x for f in flags for x in (F.avg(F.when(F.col(f) == 1, F.col(value))).alias(f"_1_{f}"), F.avg(F.when(F.col(f) == 0, F.col(value))).alias(f"_0_{f}"))])
    arr = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"_1_{f}").alias("mean_with"), F.col(f"_0_{f}").alias("mean_without")) for f in flags])
    return one.select(F.explode(arr).alias("x")).select("x.*", (F.col("x.mean_with") - F.col("x.mean_without")).alias("delta"))


def weather_by_line_kind(df: DataFrame, flags: Sequence[str], line: str, value: str, exterior: Sequence[str] = EXTERIOR_LINES) -> DataFrame:
    """Box statistics of a value on lines with much open track against underground ones, per weather flag that is set.

    A row counts under each of its flags; values are counted per group before they are ranked.
    """
    from tramline.operators.quantiles import box_stats

    open_air = F.coalesce(F.col(line).cast("string").isin(*exterior), F.lit(False))
    held = F.array_compact(F.array(*[F.when(F.col(f) == 1, F.lit(f)) for f in flags]))
    rows = df.select(F.explode(held).alias("flag"), open_air.alias("is_exterior"), F.col(value).cast("double").alias("_v"))
    return box_stats(rows, ["flag", "is_exterior"], "_v")


def linear_fits(df: DataFrame, x: str, ys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line of ``x`` against each horizon, in one pass; one row per group and horizon."""
    aggs = [e.alias(f"{k}{i}") for i, y in enumerate(ys) for k, e in (("_s", F.regr_slope(y, x)), ("_i", F.regr_intercept(y, x)), ("_n", F.regr_count(y, x)))]
    one = df.groupBy(*by).agg(*aggs)
    lines = F.array(*[F.struct(F.lit(y).alias("horizon"), F.col(f"_s{i}").alias("slope"), F.col(f"_i{i}").alias("intercept"), F.col(f"_n{i}").alias("n")) for i, y in enumerate(ys)])
    return one.select(*by, F.explode(lines).alias("_l")).select(*by, "_l.*")
