"""As-of joins: backward, forward, nearest, and the operators built on them.

Both sides are unioned and sorted once per (key, time chunk). The newest right row of earlier
chunks enters each chunk as one extra row, so a hot key is spread over many tasks. Only growing
frames are used; a frame that ends at the partition's end would cost quadratic time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.operators.ordered import CHUNK, _spread, chunk_of, even_width, known_key

#: rows and copies that one task sorts
TASK_ROWS = 400_000


def _asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    lt: str,
    rt: str,
    cols: Sequence[str],
    tie: Sequence[str],
    width: float,
    sides: dict[str, tuple[str, bool]],
    tolerance: float | None,
) -> DataFrame:
    """``sides`` maps 'backward' and/or 'forward' to (prefix, strict); both are answered on one shuffle."""
    by, cols, tie = list(by), list(cols), list(tie)
    # the match carries its time, its tie columns and the wanted columns
    match = F.struct(F.col(rt).alias("_mt"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(tie)], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    usable = F.col(rt).isNotNull()
    for c in by:
        usable = usable & F.col(c).isNotNull()
    r = right.filter(usable).select(*by, F.col(rt).alias("_t"), match.alias("_m")).withColumn(CHUNK, chunk_of("_t", width))
    probe = left.withColumn("_t", F.col(lt)).withColumn(CHUNK, _spread(by, ["_t"], chunk_of("_t", width))).withColumn("_role", F.lit(1))

    # one small row per (key, chunk): its first and last right row, carried to the chunks that follow or precede
    spine = r.groupBy(*by, CHUNK).agg(F.min("_m").alias("_lo"), F.max("_m").alias("_hi")).unionByName(probe.select(*by, CHUNK).distinct(), allowMissingColumns=True)
    spine = spine.groupBy(*by, CHUNK).agg(F.max("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    rows = probe
    hits = {}
    for side, (_, strict) in sides.items():
        fwd = side == "forward"
        chunk_order = F.col(CHUNK).desc() if fwd else F.col(CHUNK).asc()
        carried = F.last("_lo" if fwd else "_hi", True).over(Window.partitionBy(*by).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1))
        ctx = spine.select(*by, CHUNK, carried.alias("_m")).filter("_m is not null").withColumn("_t", F.col("_m._mt"))
        rows = rows.unionByName(ctx.withColumn("_role", F.lit(0)), allowMissingColumns=True)
    rows = rows.unionByName(r.withColumn("_role", F.lit(0)), allowMissingColumns=True)
    for side, (_, strict) in sides.items():
        fwd = side == "forward"
        along = F.col("_t").desc_nulls_last() if fwd else F.col("_t").asc_nulls_last()
        within = F.col("_m").desc_nulls_last() if fwd else F.col("_m").asc_nulls_last()
        role = F.col("_role").desc() if strict else F.col("_role").asc()
        w = Window.partitionBy(*by, CHUNK).orderBy(along, role, within).rowsBetween(Window.unboundedPreceding, 0)
        hits[f"_h_{side}"] = F.last("_m", True).over(w)
    for name, expr in hits.items():
        rows = rows.withColumn(name, expr)
    outs = []
    for side, (prefix, _) in sides.items():
        h = F.col(f"_h_{side}")
        ok = F.col("_t").isNotNull()
        if tolerance is not None:
            ok = ok & (F.abs(h["_mt"] - F.col("_t")) <= F.lit(tolerance))
        outs.append(F.when(ok, h["_mt"]).alias(f"{prefix}{rt}"))
        outs += [F.when(ok, h[f"_v{i}"]).alias(f"{prefix}{c}") for i, c in enumerate(cols)]
    return rows.filter("_role = 1").select(*left.columns, *outs)


def asof_backward(left, right, by, lt, rt, cols=(), tie=(), width=3600.0, strict=False, tolerance=None, prefix="last_") -> DataFrame:
    """Newest right row of the key at or before (``strict``: before) the left time.

    Equal right times: the greatest ``tie`` wins. Left rows are all kept; a null key finds nothing.
    """
    return _asof(left, right, by, lt, rt, cols, tie, width, {"backward": (prefix, strict)}, tolerance)


def asof_forward(left, right, by, lt, rt, cols=(), tie=(), width=3600.0, strict=False, tolerance=None, prefix="next_") -> DataFrame:
    """First right row of the key at or after (``strict``: after) the left time."""
    return _asof(left, right, by, lt, rt, cols, tie, width, {"forward": (prefix, strict)}, tolerance)


def asof_both(left, right, by, lt, rt, cols=(), tie=(), width=3600.0, strict_forward=False, tolerance=None, prefixes=("last_", "next_")) -> DataFrame:
    """J5 and J6 on one shuffle: newest row at or before, first row at or after (``strict_forward``: after)."""
    return _asof(left, right, by, lt, rt, cols, tie, width, {"backward": (prefixes[0], False), "forward": (prefixes[1], strict_forward)}, tolerance)


def nearest(left, right, by, lt, rt, cols=(), tie=(), width=3600.0, period=None, prefix="near_") -> DataFrame:
    """The key's right row nearest to each left time, with its time, ``cols`` and the gap; no row is fanned out.

    The nearest one before and the nearest one behind are found on one shuffle and the closer one is taken; equal gaps and
    equal times take the least ``tie``. With ``period`` times lie on a circle (seconds of the day): the key's last
    row also stands one period earlier and its first one a period later, so midnight is no border.
    """
    by, cols, tie = list(by), list(cols), list(tie)
    place = (lambda c: F.pmod(F.col(c), F.lit(period))) if period else F.col
    usable = F.col(rt).isNotNull() if (known := known_key(by)) is None else known & F.col(rt).isNotNull()
    item = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(tie)], F.col(rt).alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(cols)])
    r = right.filter(usable).select(*by, place(rt).alias("_rt"), item.alias("_item")).groupBy(*by, "_rt").agg(F.min("_item").alias("_item"))
    if period:
        ends = r.groupBy(*by).agg(F.min(F.struct("_rt", "_item")).alias("_first"), F.max(F.struct("_rt", "_item")).alias("_last"))
        around = F.array(F.struct((F.col("_first._rt") + period).alias("_rt"), F.col("_first._item").alias("_item")), F.struct((F.col("_last._rt") - period).alias("_rt"), F.col("_last._item").alias("_item")))
        r = r.unionByName(ends.select(*by, F.explode(around).alias("_e")).select(*by, "_e._rt", "_e._item"))
    got = asof_both(left.withColumn("_lt", place(lt)), r, by, "_lt", "_rt", ["_item"], (), width, prefixes=("_b", "_f"))
    back, ahead = F.col("_lt") - F.col("_b_rt"), F.col("_f_rt") - F.col("_lt")
    first = ahead.isNull() | (back < ahead) | ((back == ahead) & (F.col("_b_item") <= F.col("_f_item")))
    use = back.isNotNull() & first
    best, gap = F.when(use, F.col("_b_item")).otherwise(F.col("_f_item")), F.when(use, back).otherwise(ahead)
    outs = [F.col("_best.t").alias(f"{prefix}{rt}"), *[F.col(f"_best.v{i}").alias(f"{prefix}{c}") for i, c in enumerate(cols)], F.col("_gap").alias(f"{prefix}gap")]
    return got.withColumns({"_best": best, "_gap": gap}).select(*left.columns, *outs)


def value_at_horizons(
    df: DataFrame,
    by: Sequence[str],
    t: str,
    value: str,
    horizons: dict[str, float],
    tolerance: float,
    width: float,
    tie: Sequence[str] = (),
    rows: int | None = None,
) -> DataFrame:
    """Value of the same key at ``t + h``, nearest non-null reading within ``tolerance``.

    Equal gaps take the earlier reading. Instead of moving the probes, each reading is copied once
    per horizon to the time of the rows that ask for it, so every horizon is answered on the row
    itself: one shuffle, two sorts, no join back. ``rows`` is the number of rows where the caller knows it; with them the shuffle
    is dealt out so that the sorts of a task hold about ``TASK_ROWS``.
    """
    by, tie = list(by), list(tie)
    names = list(horizons)
    rows = df.count() if rows is None else rows
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows * (1 + len(names)) // TASK_ROWS))
    ties = [f"_k{i}" for i in range(len(tie))]
    reading = df.filter(F.col(t).isNotNull() & F.col(value).isNotNull()).select(*by, F.col(t).alias("_rt"), F.col(value).alias("_v"), *[F.col(c).alias(k) for c, k in zip(tie, ties)])
    for c in by:
        reading = reading.filter(F.col(c).isNotNull())
    shifts = F.array(*[F.struct(F.lit(i).alias("_hi"), F.lit(horizons[n]).alias("_hs")) for i, n in enumerate(names)])
    copies = reading.withColumn("_x", F.explode(shifts)).select(*by, "_v", *ties, F.col("_x._hi").alias("_hi"), (F.col("_rt") - F.col("_x._hs")).alias("_t"))
    # a reading is visible up to the tolerance on both sides: at most two chunks when width >= 2 * tolerance
    w_chunk = max(even_width(width), 2 * tolerance)
    spots = F.array_distinct(F.array(*[chunk_of(F.col("_t") + F.lit(d), w_chunk) for d in (-tolerance, 0, tolerance)]))
    copies = copies.withColumn(CHUNK, F.explode(spots)).withColumn("_role", F.lit(0))
    # the asking rows travel as one struct, so that a copy carries one null for all their columns
    probe = df.select(*by, F.col(t).alias("_t"), F.struct(*df.columns).alias("_row")).withColumn(CHUNK, chunk_of("_t", w_chunk)).withColumn("_role", F.lit(1))
    rows = probe.unionByName(copies, allowMissingColumns=True).repartition(tasks, *by, CHUNK)
    part = Window.partitionBy(*by, CHUNK)
    back = part.orderBy(F.col("_t").asc_nulls_last(), "_role", *ties).rowsBetween(Window.unboundedPreceding, 0)
    fwd = part.orderBy(F.col("_t").desc_nulls_last(), "_role", *[F.col(k).desc() for k in ties]).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.columns
    for side, w in (("_b", back), ("_f", fwd)):
        found = {f"{side}{i}": F.last(F.when(F.col("_hi") == i, F.struct("_t", "_v")), True).over(w) for i in range(len(names))}
        # what was found matters on asking rows only: copies go on without it, as the next sort holds all rows
        kept = [*kept, side]
        rows = rows.withColumns(found).withColumn(side, F.when(F.col("_role") == 1, F.struct(*found))).select(*kept)
    outs = []
    for i, n in enumerate(names):
        b, f = F.col(f"_b._b{i}"), F.col(f"_f._f{i}")
        gb, gf = F.col("_t") - b["_t"], f["_t"] - F.col("_t")
        use_b = (gb <= tolerance) & (gf.isNull() | (gb <= gf))
        outs.append(F.when(use_b, b["_v"]).when(gf <= tolerance, f["_v"]).alias(n))
    return rows.filter("_role = 1").select(*[F.col("_row")[c].alias(c) for c in df.columns], *outs)


def first_within(predictions, actuals, by, pt, at, cols, tolerance, width, tie=(), prefix="actual_") -> DataFrame:
    """The first actual within ``tolerance`` on either side of the prediction time."""
    asked = predictions.withColumn("_from", F.col(pt) - F.lit(tolerance))
    hit = asof_forward(asked, actuals, by, "_from", at, cols, tie, width, tolerance=2 * tolerance, prefix=prefix)
    return hit.drop("_from")


def relative_time(df: DataFrame, t: str, last_t: str, next_t: str, out: str, unit: float) -> DataFrame:
    """Signed time to the nearest notice: positive after the last one, negative before the next."""
    since, until = F.col(t) - F.col(last_t), F.col(next_t) - F.col(t)
    rel: Column = F.when(until.isNull() | (since <= until), since).otherwise(-until)
    return df.withColumn(out, rel / F.lit(unit))
