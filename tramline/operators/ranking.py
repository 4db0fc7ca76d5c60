"""Top-k, samples, splits and unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.operators.ordered import positions, row_index


def top_by_prediction(df: DataFrame, preds: Sequence[str], k: int, tie: Sequence[str] = ()) -> DataFrame:
    """O2: k rows by the first prediction that is neither null nor zero."""
    score = F.coalesce(*[F.nullif(F.col(p), F.lit(0.0)) for p in preds], F.lit(0.0))
    return df.withColumn("rank_delay", score).orderBy(F.col("rank_delay").desc(), *tie).limit(k)


def top_groups(df: DataFrame, by: Sequence[str], agg: Column, k: int, out: str = "score") -> DataFrame:
    """O3: the k groups with the highest aggregate (key order on ties)."""
    return df.groupBy(*by).agg(agg.alias(out)).orderBy(F.col(out).desc_nulls_last(), *by).limit(k)


def latest(df: DataFrame, order: Sequence[str], n: int, width: float) -> DataFrame:
    """The n newest rows, by position; a large n is never gathered in one task."""
    return row_index(df, [], order, width, "_i", reverse=True).filter(F.col("_i") <= n).drop("_i")


def sample_fraction(df: DataFrame, key: str | Column, fraction: float) -> DataFrame:
    """Reproducible sample: a row is in when its key's hash lies below the fraction."""
    k = F.col(key) if isinstance(key, str) else key
    cut = format(int(fraction * 16**8), "08x")
    return df.filter(F.substring(F.md5(k.cast("string")), 1, 8) < F.lit(cut))


def split_by_rows(df: DataFrame, order: Sequence[str], fractions: Sequence[float], names: Sequence[str], width: float, out: str = "split") -> DataFrame:
    """Temporal split by row position; cumulative fractions close the first parts."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    at = row_index(df, [], order, width, "_i").crossJoin(F.broadcast(total))  # one row
    col = None
    for f, name in zip(fractions, names):
        cond = F.col("_i") <= F.floor(F.col("_n") * F.lit(f))
        col = F.when(cond, name) if col is None else col.when(cond, name)
    return at.withColumn(out, col.otherwise(names[-1])).drop("_i", "_n")


def split_by_groups(df: DataFrame, key: str, fractions: Sequence[float], names: Sequence[str], out: str = "split") -> DataFrame:
    """Temporal split by distinct days or bins; these are numbered range by range, and only the borders come together."""
    at = positions(df.select(key).filter(F.col(key).isNotNull()).distinct(), [key], "_i")
    total = at.agg(F.count(F.lit(1)).alias("_n"))
    wanted = [F.floor(F.col("_n") * F.lit(f)) + 1 for f in fractions]
    cuts = at.crossJoin(F.broadcast(total))  # one row
    cuts = cuts.agg(*[F.max(F.when(F.col("_i") == w, F.col(key))).alias(f"_c{i}") for i, w in enumerate(wanted)])
    j = df.filter(F.col(key).isNotNull()).crossJoin(F.broadcast(cuts))  # one row
    col = None
    for i, name in enumerate(names[:-1]):
        cond = F.col(key) < F.col(f"_c{i}")
        col = F.when(cond, name) if col is None else col.when(cond, name)
    return j.withColumn(out, col.otherwise(names[-1])).select(*df.columns, out)


def split_by_months(df: DataFrame, day: str, parts: dict[str, Sequence[str]], out: str = "split") -> DataFrame:
    """Named month lists; other months are left out."""
    m = F.date_format(day, "yyyy-MM")
    col = None
    for name, months in parts.items():
        col = F.when(m.isin(*months), name) if col is None else col.when(m.isin(*months), name)
    return df.withColumn(out, col).filter(F.col(out).isNotNull())


def union_sources(*dfs: DataFrame) -> DataFrame:
    """Union by name, absent columns null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def key_union(*dfs: DataFrame) -> DataFrame:
    """Union of key sets."""
    return reduce(lambda a, b: a.unionByName(b), dfs).distinct()


def slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """U4."""
    return df.select(*cols).distinct()
