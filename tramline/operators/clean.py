"""Validation, cleaning and filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise when a required column is missing; a schema check, no job."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def coerce_types(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Cast listed columns; unreadable values and NaN become null."""
    out = {}
    for c, t in spec.items():
        v = F.col(c).try_cast(t)
        out[c] = F.when(~F.isnan(v), v) if t in ("double", "float") else v
    return df.withColumns(out)


def drop_null_keys(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P3."""
    return df.na.drop(subset=list(cols))


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """First row per key in the stated order; null equals null.

    The rank filter is pushed below the shuffle as a group limit, so a hot key sends at most one
    row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key."""
    return dedup(df, keys, [F.col(c).desc_nulls_last() for c in order])


def dedup_rows(df: DataFrame) -> DataFrame:
    """Whole-row duplicates."""
    return df.distinct()


def filter_outliers(df: DataFrame, col: str, lo: float = -9000, hi: float = 9000) -> DataFrame:
    """Range filter that keeps nulls."""
    return df.filter(F.col(col).isNull() | F.col(col).between(lo, hi))


def zscore_filter(df: DataFrame, col: str, by: Sequence[str], z: float = 3.0, min_n: int = 5) -> DataFrame:
    """Keep |z| < 3 (population deviation) where a group has more than ``min_n`` values.

    A constant group has no spread to judge by and is kept. Statistics are aggregated first and
    joined back, so no group is gathered in one task.
    """
    st = df.groupBy(*by).agg(F.count(col).alias("_n"), F.avg(col).alias("_mu"), F.stddev_pop(col).alias("_sd"))
    zed = F.abs((F.col(col) - F.col("_mu")) / F.nullif(F.col("_sd"), F.lit(0.0)))
    keep = (F.col("_n") <= min_n) | (F.col("_sd") == 0) | (zed < z)
    return df.join(st, list(by)).filter(keep & F.col(col).isNotNull()).select(*df.columns)


def null_beyond(df: DataFrame, cols: Sequence[str], limit: float = 43_200) -> DataFrame:
    """P8."""
    return df.withColumns({c: F.when(F.abs(F.col(c)) <= limit, F.col(c)) for c in cols})


def split_scheduled(df: DataFrame, flag: str = "is_unscheduled", need_scheduled: Sequence[str] = ("delay",), need_unscheduled: Sequence[str] = ("t",)):
    """Scheduled and unscheduled parts, each with its own null rule."""
    return (
        drop_null_keys(df.filter(~F.col(flag)), need_scheduled),
        drop_null_keys(df.filter(F.col(flag)), need_unscheduled),
    )


def column_policy(df: DataFrame, keep: Sequence[str], drop: Sequence[str] = ()) -> DataFrame:
    """P10: ordered keep-list minus drop-list, columns that exist."""
    return df.select(*[c for c in keep if c in df.columns and c not in set(drop)])


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exact schema; absent columns become typed nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def filter_in(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """P19."""
    return df.filter(F.col(col).isin(*values))


def map_score(df: DataFrame, col: str, mapping: dict[str, int], minimum: float, out: str = "score", default: float = 1) -> DataFrame:
    """P20: score by type, rows below the minimum dropped; the fixed map is a literal."""
    from tramline.functions.scalars import lookup

    return df.withColumn(out, lookup(col, mapping, default)).filter(F.col(out) >= minimum)


def home_games(df: DataFrame, competitors: str, teams: Sequence[str], venue_ok: Column) -> DataFrame:
    """A listed team plays at home in an accepted venue."""
    def listed(c: Column) -> Column:
        hit = F.lit(False)
        for t in teams:
            hit = hit | F.contains(F.lower(c["team"]["slug"]), F.lit(t)) | F.contains(F.lower(c["team"]["displayName"]), F.lit(t))
        return (c["homeAway"] == "home") & F.coalesce(hit, F.lit(False))

    return df.filter(F.exists(F.col(competitors), listed) & venue_ok)


def population(df: DataFrame, target: str, side: str, flag: str = "is_unscheduled", left: str = "time_left", limit: float = 1800) -> DataFrame:
    """Scheduled rows with a target, far from (``30m``) or close to (``end``) the terminal."""
    near = F.col(left) < limit if side == "end" else F.col(left) >= limit
    return df.filter(~F.col(flag) & F.col(target).isNotNull() & near)


def exclude(df: DataFrame, day: str | None = None, days: Sequence = (), route: str | None = None, routes: Sequence = ()) -> DataFrame:
    """P23."""
    if day and days:
        df = df.filter(~F.col(day).isin(*days))
    if route and routes:
        df = df.filter(~F.col(route).isin(*routes))
    return df


def drop_ambiguous(df: DataFrame, y15: str, y30: str) -> DataFrame:
    """No alert within 15 min but one within 30 is neither positive nor negative."""
    return df.filter((F.col(y15) == 1) | (F.col(y30) == 0))


def extreme_weather(precip, precip3, temp, wind, snow) -> Column:
    """P25: six-term extreme weather label."""
    c = F.col
    return F.coalesce(
        (c(precip) > 10.0) | (c(precip3) > 25.0) | (c(temp) < -5.0) | (c(temp) > 35.0) | (c(wind) > 40.0) | (c(snow) > 0), F.lit(False)
    )


def weather_flags(precip3: str, temp: str, wind: str, snow: str) -> dict[str, Column]:
    """P25: risk flags; null readings raise no flag."""
    c = F.col
    flag = lambda e: F.coalesce(e, F.lit(False)).cast("int")
    return {
        "is_flooding_risk": flag(c(precip3) > 1),
        "is_extreme_heat": flag(c(temp) > 7.0),
        "is_blizzard": flag((c(snow) > 0) & (c(wind) > 25)),
        "is_freezing": flag(c(temp) <= 0),
        "is_high_wind": flag(c(wind) > 50),
    }


def past_only(df: DataFrame, now: str, arrival: str) -> DataFrame:
    """P26/ST5: drop arrivals that still lie ahead of the feed time."""
    return df.filter(F.col(now) >= F.col(arrival))


def reject_bad_match(df: DataFrame, delay: str, cols: Sequence[str], flag: str = "is_unscheduled", limit: float = 3600) -> DataFrame:
    """A match with an implausible delay is no match; missing delay is unscheduled too."""
    bad = F.coalesce(F.abs(F.col(delay)) > limit, F.lit(True))
    out = {c: F.when(~bad, F.col(c)) for c in cols}
    return df.withColumn("_bad", bad).withColumns({**out, flag: F.col("_bad")}).drop("_bad")


def clean_stations(df: DataFrame, col: str) -> DataFrame:
    """Stations with a name; rows without any are dropped."""
    arr = F.filter(F.col(col), lambda s: s["name"].isNotNull() & (F.trim(s["name"]) != ""))
    return df.withColumn(col, arr).filter(F.size(col) > 0)


def feature_columns(df: DataFrame, exclude_cols: Sequence[str], prefixes: Sequence[str] = ("target_", "delta_")) -> list[str]:
    """All columns that do not leak the target."""
    banned = set(exclude_cols)
    return [c for c in df.columns if c not in banned and not c.startswith(tuple(prefixes))]


def availability(train: T.StructType, live: T.StructType) -> dict[str, list[str]]:
    """Which training columns a live row can supply."""
    have = {f.name for f in live}
    names = [f.name for f in train]
    return {"servable": [n for n in names if n in have], "train_only": [n for n in names if n not in have]}


def below_quantile(df: DataFrame, col: str, q: float = 0.99) -> DataFrame:
    """Rows strictly below the column's own exact quantile."""
    from tramline.operators.quantiles import exact_quantiles

    cut = exact_quantiles(df, [], col, {"_q": q})
    # one row by construction
    return df.join(F.broadcast(cut), F.col(col) < F.col("_q")).select(*df.columns)
