"""Station graph and its spatio-temporal grid (N1-N8) as edge tables and joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tramline.functions.scalars import hour_cos, hour_sin
from tramline.operators.joins import dense_grid
from tramline.operators.windows import fill_gaps
from tramline.session import cut


def gaussian_edges(edges: DataFrame, dist: str = "median_travel_time") -> DataFrame:
    """Directed weights exp(-d^2 / (sigma^2 + 1e-6)) with population sigma, self loops of 1, equal edges summed."""
    sigma = edges.agg(F.stddev_pop(dist).alias("_s"))
    w = F.exp(-F.pow(F.col(dist), F.lit(2)) / (F.pow("_s", F.lit(2)) + 1e-6))
    e = edges.crossJoin(F.broadcast(sigma)).select("src", "dst", w.alias("weight"))  # one row
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    loops = nodes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("weight"))
    return e.unionByName(loops).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def normalized_adjacency(edges: DataFrame, dist: str = "median_travel_time", count: str = "trip_count", min_count: int = 5) -> DataFrame:
    """Undirected D^-1/2 A D^-1/2 with sample sigma, frequent edges only, unit diagonal.

    Where both directions exist, the one from the greater stop id gives the weight.
    """
    kept = edges.filter(F.col(count) > min_count)
    s = F.stddev_samp(dist)
    sigma = kept.agg(F.when(s.isNull() | (s == 0), 1.0).otherwise(s).alias("_s"))
    w = kept.crossJoin(F.broadcast(sigma)).select("src", "dst", F.exp(-F.pow(F.col(dist), F.lit(2)) / F.pow("_s", F.lit(2))).alias("w"))  # one row
    pair = w.filter("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max_by("w", "src").alias("w"))
    both = pair.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w").unionByName(pair.select(F.col("b").alias("src"), F.col("a").alias("dst"), "w"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
    adj = both.unionByName(nodes.select("src", F.col("src").alias("dst"), F.lit(1.0).alias("w")))
    deg = adj.groupBy("src").agg(F.sum("w").alias("deg"))
    return (
        adj.join(deg, "src")
        .join(deg.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst")
        .select("src", "dst", (F.col("w") / F.sqrt(F.col("deg") * F.col("deg2"))).alias("weight"))
    )


def spread(signal: DataFrame, edges: DataFrame, node: str, value: str, keys: Sequence[str] = (), out: str = "value", combine: Column | None = None) -> DataFrame:
    """One sparse product of the edge table with a node signal: sum of weight * value over neighbours."""
    s = signal.select(*keys, F.col(node).alias("dst"), F.col(value).alias("_v"))
    return edges.join(s, "dst").groupBy(*keys, F.col("src").alias(node)).agg(F.sum(F.col("weight") * F.col("_v")).alias(out))


def diffusion_features(signal: DataFrame, edges: DataFrame, node: str, value: str, keys: Sequence[str], hops: int) -> DataFrame:
    """1..k-hop neighbour means: repeated product with the row-normalised edge table."""
    deg = edges.groupBy("src").agg(F.sum("weight").alias("_d"))
    trans = edges.join(deg, "src").select("src", "dst", (F.col("weight") / F.col("_d")).alias("weight"))
    out, cur = signal, signal.select(*keys, node, F.col(value).alias("hop0"))
    for h in range(1, hops + 1):
        cur = spread(cur, trans, node, f"hop{h - 1}", keys, f"hop{h}")
        out = out.join(cur, [*keys, node], "left")
    return out


def largest_eigenvalue(adjacency: DataFrame, steps: int = 8, start: Column | None = None) -> DataFrame:
    """One row ``lambda_max``, the largest eigenvalue of I - A by a bounded power iteration over the edge table.

    Each step is one sparse product, written to the shared folder; the last one gives the Rayleigh quotient. The spectrum lies in [0, 2],
    so vectors need no scaling for some hundred steps. ``start`` gives the first vector as a function of ``src``; it must not be
    the same for all nodes, as the plain vector may lie in the kernel. The quotient comes from below and grows with the steps; it is
    never above the true value, and an empty or edgeless graph gets the bound 2.
    """
    start = 1 + F.pmod(F.xxhash64("src"), F.lit(97)) / 97 if start is None else start
    v = adjacency.select("src").union(adjacency.select("dst")).distinct().select(F.col("src").alias("node"), start.cast("double").alias("x"))
    for _ in range(steps):
        v = cut(_laplacian(v, adjacency, "node", "x", (), "x"), "power")
    after = _laplacian(v, adjacency, "node", "x", (), "y")
    quotient = F.sum(F.col("x") * F.col("y")) / F.nullif(F.sum(F.col("x") * F.col("x")), F.lit(0.0))
    return after.agg(F.coalesce(F.nullif(quotient, F.lit(0.0)), F.lit(2.0)).alias("lambda_max"))


def _laplacian(df: DataFrame, adjacency: DataFrame, node: str, col: str, keys: Sequence[str], out: str, c: float = 1.0, shift: float = 0.0) -> DataFrame:
    """``c (I - A) x - shift x`` as column ``out`` beside the others."""
    ax = spread(df, adjacency, node, col, keys, "_ax")
    return df.join(ax, [*keys, node], "left").withColumn(out, (c - shift) * F.col(col) - c * F.coalesce("_ax", F.lit(0.0))).drop("_ax")


def chebyshev_features(signal: DataFrame, adjacency: DataFrame, node: str, value: str, keys: Sequence[str], order: int, lambda_max: float | None = 2.0) -> DataFrame:
    """Chebyshev terms of the scaled Laplacian (2/lmax)(I - A) - I applied to a node signal.

    With a normalised adjacency the spectrum of I - A lies in [0, 2], so lambda_max 2 is the bound; None takes
    ``largest_eigenvalue``.
    """
    c = 2.0 / (largest_eigenvalue(adjacency).first()[0] if lambda_max is None else lambda_max)

    def lap(df: DataFrame, col: str, out: str) -> DataFrame:
        return _laplacian(df, adjacency, node, col, keys, out, c, 1.0)

    t = signal.select(*keys, node, F.col(value).cast("double").alias("t0"))
    if order >= 1:
        t = lap(t, "t0", "t1")
    for k in range(2, order + 1):
        t = lap(t, f"t{k - 1}", "_l").withColumn(f"t{k}", 2 * F.col("_l") - F.col(f"t{k - 2}")).drop("_l")
    return t


def spatio_temporal_grid(df: DataFrame, node: str, t: str, width: int, mean: Sequence[str], width_chunk: float, unit: int = 1) -> DataFrame:
    """Mean per (bin, node), densified, gaps filled forward, back, then 0, with calendar features.

    ``unit`` is the number of time units in a second.
    """
    start = (F.floor(F.col(t) / width) * width).cast("bigint").alias("bin")
    cells = df.na.drop(subset=[node, t]).groupBy(node, start).agg(*[F.avg(c).alias(c) for c in mean])
    grid = dense_grid(cells, "bin", node, width)
    for c in mean:
        grid = fill_gaps(grid, [node], ["bin"], c, width_chunk, c)
    ts = F.timestamp_seconds(F.col("bin") / unit)
    h = F.hour(ts)
    return grid.withColumns({"hour_sin": hour_sin(h), "hour_cos": hour_cos(h), "dow": F.weekday(ts)})


def pad_history(grid: DataFrame, node: str, t: str, width: int, length: int, zero: Sequence[str]) -> DataFrame:
    """Exactly ``length`` newest bins per node; absent ones are zero rows."""
    end = grid.agg(F.max(t).alias("_e"))
    bins = F.sequence(F.col("_e") - (length - 1) * width, F.col("_e"), F.lit(width))
    want = grid.select(node).distinct().crossJoin(F.broadcast(end)).select(node, F.explode(bins).alias(t))  # one row
    return want.join(grid, [node, t], "left").na.fill(0.0, list(zero))


def node_coverage(asked: DataFrame, nodes: DataFrame, stop: str, node: str) -> DataFrame:
    """Whether a stop is a node itself, or has a platform that is one."""
    exact = nodes.select(F.col(node).alias(stop)).distinct().withColumn("_x", F.lit(True))
    base = nodes.select(F.regexp_replace(node, "[NS]$", "").alias(stop)).distinct().withColumn("_b", F.lit(True))
    j = asked.join(exact, stop, "left").join(base, stop, "left")
    return j.withColumn("coverage", F.when(F.col("_x"), "exact").when(F.col("_b"), "directional").otherwise("none")).drop("_x", "_b")
