"""Exact quantiles, equal-frequency bins and box statistics without gathering a group.

``percentile`` keeps every distinct value of a group in one task's memory. Here values are counted
first (map-side), then placed by running counts over value buckets. Buckets that hold a wanted position and still have many
values are cut again, between their own least and greatest value, until few are left to rank.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import cut

#: buckets per unit of log(1 + |value|): about 0.2 percent of a value each
BUCKETS = 512
#: parts into which a bucket is cut again
PARTS = 4096
#: distinct values that one task may rank
RANKED = 1_000_000


def value_bucket(col: str) -> Column:
    """A non-decreasing step function of the value, fine near zero and for long tails alike."""
    c = F.col(col)
    return (F.signum(c) * F.floor(F.least(F.log1p(F.abs(c)), F.lit(1000.0)) * BUCKETS)).cast("bigint")


def exact_quantiles(df: DataFrame, by: Sequence[str], col: str, qs: dict[str, float], ranked: int = RANKED, weight: str | None = None) -> DataFrame:
    """One row per group with linearly interpolated quantiles, as ``percentile`` would give; ``weight`` names a count of equal rows.

    Values are counted map-side into a written table. Bucket totals tell which few buckets hold a wanted position; as long as
    one of them has more than ``ranked`` distinct values, those buckets are cut into ``PARTS`` even parts between
    their least and greatest value and counted again, so columns with a large offset end in small buckets too. Only
    the last buckets' values are ranked.
    """
    by = list(by)
    counts = df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).cast("double").alias("_v")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_n"))
    part = cut(counts, "counts").withColumns({"_base": F.lit(0).cast("bigint"), "_b": value_bucket("_v")})
    lo_at = {n: F.floor(q * (F.col("_size") - 1)) for n, q in qs.items()}
    hi_at = {n: F.ceil(q * (F.col("_size") - 1)) for n, q in qs.items()}
    inside = lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_s"))
    wanted = reduce(lambda a, b: a | b, [inside(p) for p in [*lo_at.values(), *hi_at.values()]])
    size, had = F.sum("_s").over(Window.partitionBy(*by)), -1
    while True:
        keys = [*by, "_base"]
        totals = part.groupBy(*keys, "_b").agg(F.sum("_n").alias("_s"), F.count(F.lit(1)).alias("_k"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *([F.max("_size").alias("_size")] if had >= 0 else []))
        prev = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        at = totals.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_s").over(prev), F.lit(0)))
        at = at if had >= 0 else at.withColumn("_size", size)
        at = cut(at.filter(wanted), "borders")
        hit = (part.drop("_size") if had >= 0 else part).join(at.drop("_s"), [*keys, "_b"])
        most = at.agg(F.max("_k")).first()[0] or 0
        if most <= ranked or most == had:  # (equal buckets hold values that doubles cannot part)
            break
        had = most
        even = F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * PARTS)
        part = hit.select(*by, "_v", "_n", F.col("_before").alias("_base"), F.when(F.col("_hi") > F.col("_lo"), even).otherwise(0).cast("bigint").alias("_b"), "_size")
    w = Window.partitionBy(*by, "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = hit.withColumn("_last", F.col("_before") + F.sum("_n").over(w) - 1)
    first, last = F.col("_last") - F.col("_n") + 1, F.col("_last")
    pick = lambda pos: F.max(F.when((first <= pos) & (last >= pos), F.col("_v")))
    aggs = [F.max("_size").alias("_size")]
    for i, n in enumerate(qs):
        aggs += [pick(lo_at[n]).alias(f"_lo{i}"), pick(hi_at[n]).alias(f"_hi{i}")]
    got = placed.groupBy(*by).agg(*aggs)
    outs = []
    for i, (n, q) in enumerate(qs.items()):
        frac = q * (F.col("_size") - 1) - F.floor(q * (F.col("_size") - 1))
        outs.append((F.col(f"_lo{i}") + frac * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(n))
    return got.select(*by, *outs)


def quantile_bins(df: DataFrame, col: str, q: int, out: str = "bin") -> DataFrame:
    """Equal-frequency bins; equal values share a bin, equal edges collapse."""
    edges = exact_quantiles(df, [], col, {f"_e{i}": i / q for i in range(1, q)})
    arr = F.array_sort(F.array_distinct(F.array(*[f"_e{i}" for i in range(1, q)])))
    edges = edges.select(arr.alias("_edges"))
    placed = df.filter(F.col(col).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    return placed.withColumn(out, F.size(F.filter("_edges", lambda e: e < F.col(col)))).drop("_edges")


def box_stats(df: DataFrame, by: Sequence[str], col: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 IQR, outlier count; from counts of values, so a hot group is one row a value."""
    by = list(by)
    counts = cut(df.filter(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("_n")), "counts")
    q = exact_quantiles(counts, by, col, {"q1": 0.25, "median": 0.5, "q3": 0.75}, weight="_n")
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(col).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return (
        counts.join(q, by)
        .groupBy(*by)
        .agg(
            F.max("q1").alias("q1"),
            F.max("median").alias("median"),
            F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(col))).alias("whisker_low"),
            F.max(F.when(inside, F.col(col))).alias("whisker_high"),
            F.sum(F.when(inside, 0).otherwise(F.col("_n"))).alias("outliers"),
        )
    )
