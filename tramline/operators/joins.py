"""Equi joins, matches and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def attach_trip(stop_times: DataFrame, trips: DataFrame, on: Sequence[str]) -> DataFrame:
    """Stop times of known trips."""
    return stop_times.join(trips, list(on), "inner")


def match_schedule(actual: DataFrame, schedule: DataFrame, on: Sequence[str], actual_t: str, scheduled_t: str, wrap: bool = True) -> DataFrame:
    """Actual passages with their schedule; unmatched rows stay, flagged unscheduled."""
    from tramline.functions.scalars import wrap_delay

    j = actual.join(schedule, list(on), "left")
    d = F.col(actual_t) - F.col(scheduled_t)
    return j.withColumn("delay", wrap_delay(d) if wrap else d).withColumn("is_unscheduled", F.col(scheduled_t).isNull())


def match_nearest(actual: DataFrame, schedule: DataFrame, on: Sequence[str], actual_t: str, scheduled_t: str, tie: Sequence[str] = (), width: float = 3600, cols: Sequence[str] = ()) -> DataFrame:
    """J10/ST6: each passage with the schedule row of its key nearest on the clock, and the delay; one row a passage.

    Times are seconds of the day and nearness wraps at midnight; passages without a schedule row are flagged unscheduled.
    """
    from tramline.functions.scalars import wrap_delay
    from tramline.operators.asof import nearest

    j = nearest(actual, schedule, on, actual_t, scheduled_t, cols, tie, width, period=86_400, prefix="_near_")
    j = j.withColumnsRenamed({f"_near_{c}": c for c in [scheduled_t, *cols]}).drop("_near_gap")
    return j.withColumn("delay", wrap_delay(F.col(actual_t) - F.col(scheduled_t))).withColumn("is_unscheduled", F.col(scheduled_t).isNull())


def join_weather(df: DataFrame, weather: DataFrame, on: Sequence[str] = ("day", "hour"), how: str = "left") -> DataFrame:
    """Weather of the day and hour. Spark broadcasts it by measured size when it fits."""
    return df.join(weather, list(on), how)


def with_fallback(df: DataFrame, value: str, fallback: str, out: str) -> DataFrame:
    """A horizon beyond the trip's end takes the final value."""
    return df.withColumn(out, F.coalesce(value, fallback))


def best_match(df: DataFrame, keys: Sequence[str], cost: Column, tie: Sequence[str] = ()) -> DataFrame:
    """After a fan-out the candidate with the smallest cost per key; missing costs last."""
    w = Window.partitionBy(*keys).orderBy(cost.asc_nulls_last(), *tie)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def locate(df: DataFrame, places: DataFrame, on: Sequence[str]) -> DataFrame:
    """Coordinates of the stop, absent ones null."""
    return df.join(places, list(on), "left")


def vehicle_midpoint(vehicles: DataFrame, stops: DataFrame, stop: str, prev: str, moving: Column, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A moving vehicle lies midway between its previous and next stop, else at its stop."""
    here = stops.select(F.col(stop), F.col(lat).alias("_la"), F.col(lon).alias("_lo"))
    back = stops.select(F.col(stop).alias(prev), F.col(lat).alias("_pla"), F.col(lon).alias("_plo"))
    j = vehicles.join(here, stop, "left").join(back, prev, "left")
    mid = lambda a, b: F.when(moving & F.col(b).isNotNull(), (F.col(a) + F.col(b)) / 2).otherwise(F.col(a))
    return j.withColumn(lat, mid("_la", "_pla")).withColumn(lon, mid("_lo", "_plo")).drop("_la", "_lo", "_pla", "_plo")


def contagion(rows: DataFrame, suspended: DataFrame, slot: Sequence[str], route: str) -> DataFrame:
    """Label rows of other routes in slots where some route is suspended, and rows in no such slot.

    Slots are reduced to their least and greatest suspended route, which decides "another route" with
    one unique-key join instead of pairs.
    """
    s = suspended.groupBy(*slot).agg(F.min(route).alias("_a"), F.max(route).alias("_b"))
    j = rows.join(s, list(slot), "left")
    other = (F.col("_a") != F.col(route)) | (F.col("_b") != F.col(route))
    return j.withColumn("contagion", F.when(F.col("_a").isNull(), "clean").when(other, "exposed")).filter(F.col("contagion").isNotNull()).drop("_a", "_b")


def keep_keys(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """J23."""
    return df.join(keys, list(on), "left_semi")


def left_only(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """U3."""
    return a.join(b, list(on), "left_anti")


def dense_grid(cells: DataFrame, t: str, key: str, width: int, fill: dict[str, float] | None = None) -> DataFrame:
    """Every bin of the covered range for every key, aggregates joined on.

    The dense grid itself is the result (bins x nodes); each key makes its own bins from the
    range, so no table is crossed with another.
    """
    span = cells.agg(F.min(t).alias("_a"), F.max(t).alias("_b"))
    keys = cells.select(key).distinct().join(F.broadcast(span))  # one row
    grid = keys.select(key, F.explode(F.sequence("_a", "_b", F.lit(width))).alias(t))
    out = grid.join(cells, [key, t], "left")
    return out.na.fill(fill) if fill else out


def compare_slices(a: DataFrame, b: DataFrame, key: Sequence[str], metric: str) -> DataFrame:
    """One metric of two tables side by side and the gap."""
    x = a.select(*key, F.col(metric).alias(f"{metric}_a"))
    y = b.select(*key, F.col(metric).alias(f"{metric}_b"))
    return x.join(y, list(key)).withColumn("gap", F.col(f"{metric}_b") - F.col(f"{metric}_a"))


def lookup_chain(asked: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], value: str, out: str) -> DataFrame:
    """The first level that knows a value: exact stop, base stop, route average."""
    df, got = asked, []
    for i, (tab, on) in enumerate(levels):
        df = df.join(tab.select(*on, F.col(value).alias(f"_l{i}")), list(on), "left")
        got.append(F.col(f"_l{i}"))
    level = F.coalesce(*[F.when(g.isNotNull(), i) for i, g in enumerate(got)])
    return df.withColumn(out, F.coalesce(*got)).withColumn("level", level).drop(*[f"_l{i}" for i in range(len(levels))])
