"""Counts of points below a probe on two axes, and distinct items in time ranges, without pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.operators.ordered import nth_prior, prior_rows, sums_until
from tramline.session import cut

#: before any time
_NEVER = -(1 << 60)


def dominance_counts(probes: DataFrame, points: DataFrame, by: Sequence[str], px: str, py: str, x: str, y: str, keep: Sequence[str], width, base: int = 16) -> DataFrame:
    """For each probe, told by ``keep``: ``rank``, the key's points with ``x`` below ``px``, and ``n``, those of them with ``y`` below ``py``.

    Points get their rank on the first axis, and a rank below the probe's first differs from it in one digit, where it
    is smaller. So at each digit the points that share the higher digits are added up along the second axis by the
    value of the digit: a point is copied once per digit of the number of rows (five for a million), a probe as well, and
    every copy meets only running totals, chunk by chunk. A probe without ``py`` gets the rank alone.
    """
    by, keep = list(by), list(keep)
    asked = probes.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(px).alias("_x"), F.col(py).alias("_y"), F.lit(True).alias("_ask"))
    given = points.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col(x).alias("_x"), F.col(y).alias("_y")).filter("_x is not null and _y is not null")
    keys = [f"_b{i}" for i in range(len(by))]
    for k in keys:
        given = given.filter(F.col(k).isNotNull())
    both = asked.unionByName(given.withColumn("_ask", F.lit(False)), allowMissingColumns=True)
    ranked = cut(sums_until(both, given, keys, "_x", "_x", {"_r": F.lit(1).cast("bigint")}, width), "ranks")
    most = ranked.filter("not _ask").agg(F.max("_r")).first()[0] or 0
    levels = 1
    while base**levels <= most + 1:
        levels += 1
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.floor(F.col("_r") / base ** (i + 1)).alias("cell"), (F.floor(F.col("_r") / base**i) % base).alias("digit")) for i in range(levels)]))
    copies = ranked.withColumn("_d", at).select("*", F.col("_d.level").alias("_level"), F.col("_d.cell").alias("_cell"), F.col("_d.digit").alias("_digit")).drop("_d")
    below = {f"_s{j}": (F.col("_digit") == j).cast("bigint") for j in range(base - 1)}
    probe = copies.filter("_ask and _digit > 0 and _y is not null").drop("_x", "_r")
    got = sums_until(probe, copies.filter("not _ask"), [*keys, "_level", "_cell"], "_y", "_y", below, width)
    ids = [f"_k{i}" for i in range(len(keep))]
    total = sum((F.when(F.col("_digit") > j, F.col(f"_s{j}")).otherwise(0) for j in range(base - 1)), F.lit(0))
    n = got.select(*ids, total.alias("_n")).union(ranked.filter("_ask").select(*ids, F.lit(0).cast("bigint"))).groupBy(*ids).agg(F.sum("_n").alias("n"))
    rank = ranked.filter("_ask").select(*[F.col(c).alias(f"{c}_") for c in ids], F.col("_r").alias("rank"))
    # ids may hold nulls
    on = [n[c].eqNullSafe(rank[f"{c}_"]) for c in ids]
    return n.join(rank, on).select(*[F.col(i).alias(c) for i, c in zip(ids, keep)], "rank", "n")


def distinct_in_intervals(intervals: DataFrame, points: DataFrame, by: Sequence[str], lo: str, hi: str, t: str, item: str, keep: Sequence[str], width, out: str = "n_distinct") -> DataFrame:
    """Distinct items among the key's points in ``[lo, hi)`` of each interval, told by ``keep``; linear work, no pairs.

    A point is counted where it is the first of its item in the interval: its item's previous point of the key lies before
    ``lo``. Points before ``hi`` with such a previous point, less all points before ``lo``, are those. Null items do not count,
    intervals with a null end or key or without points get 0.
    """
    by, keep = list(by), list(keep)
    pts = points.filter(F.col(item).isNotNull() & F.col(t).isNotNull()).select(*dict.fromkeys([*by, item]), F.col(t).alias("_t"))
    for c in by:
        pts = pts.filter(F.col(c).isNotNull())
    last = prior_rows(pts, [*by, item], ["_t"], ["_t"], 1, width, "_p")
    pts = last.withColumn("_before", F.coalesce(nth_prior("_p", "_t", 1), F.lit(_NEVER).cast("bigint"))).drop("_p")
    whole = intervals.filter(F.col(lo).isNotNull() & F.col(hi).isNotNull())
    ends = F.array(F.struct(F.lit(True).alias("end"), F.col(hi).alias("x"), F.col(lo).alias("y")), F.struct(F.lit(False).alias("end"), F.col(lo).alias("x"), F.lit(None).alias("y")))
    probes = whole.filter(F.col(hi) > F.col(lo)).select(*dict.fromkeys([*by, *keep]), F.explode(ends).alias("_e")).select("*", F.col("_e.end").alias("_end"), F.col("_e.x").alias("_px"), F.col("_e.y").alias("_py")).drop("_e")
    got = dominance_counts(probes, pts, by, "_px", "_py", "_t", "_before", [*keep, "_end"], width)
    every = intervals.select(*keep, F.lit(0).cast("bigint").alias("_c"))
    counts = got.select(*keep, F.when(F.col("_end"), F.col("n")).otherwise(-F.col("rank")).alias("_c"))
    return counts.union(every).groupBy(*keep).agg(F.sum("_c").alias(out))
