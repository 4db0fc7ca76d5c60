"""Ordered operators that never put a whole key into one task.

A time series key (trip, stop, route) may hold a large share of all rows, so a plain
``Window.partitionBy(key)`` would sort that share in one task. Every operator here splits a
key into chunks of the order axis (``floor(t / width)``) and partitions by ``(key, chunk)``.
What a chunk needs from its neighbours is computed as one small row per ``(key, chunk)``:
the last k rows, the last known value or the total so far. The results equal those of the
unsplit window.

Times are numeric (epoch microseconds, seconds past midnight, ...); ``width``, tolerances and
horizons use the same unit. Rows with a null key have no neighbours: no history, no totals but their own,
nothing within a range of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.session import cut

CHUNK = "_chunk"
#: chunk of rows without a time: they sort after all others
_NO_TIME = 1 << 60


def known_key(by: Sequence[str]) -> Column | None:
    """No part of the key is null; None for the empty key."""
    out = None
    for c in by:
        out = F.col(c).isNotNull() if out is None else out & F.col(c).isNotNull()
    return out


def _if_known(by: Sequence[str], value: Column, otherwise: Column) -> Column:
    known = known_key(by)
    return value if known is None else F.when(known, value).otherwise(otherwise)


def _spread(by: Sequence[str], order: Sequence[str], chunk: Column) -> Column:
    """Chunk of a row; rows with a null key have no neighbours, so they are dealt out by a hash of their place."""
    return _if_known(by, chunk, F.pmod(F.xxhash64(*order), F.lit(1 << 20)))


@dataclass(frozen=True)
class Stretches:
    """Chunk borders that follow the data: quiet stretches of the axis are merged, busy ones are split.

    The axis is cut into steps of ``unit`` from step ``first`` on. Step i begins chunk ``ids[i]`` (the same one for merged
    steps) and is split into ``2 ** splits[i]`` even parts. Times before the first or behind the last step fall into the
    first or last chunk.
    """

    unit: int
    first: int
    ids: tuple[int, ...]
    splits: tuple[int, ...]

    @property
    def even(self) -> int:
        """A width for operators that need an even one: that of the narrowest chunk."""
        if any(self.splits):
            return self.unit >> max(self.splits)
        return self.unit if self.ids[-1] else 2 * self.unit * len(self.ids)

    def of(self, c: Column) -> Column:
        if not self.ids[-1] and not any(self.splits):
            return F.when(c.isNotNull(), F.lit(0).cast("bigint"))
        listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  # one literal, folded once
        step = F.floor(c / F.lit(self.unit)).cast("bigint") - F.lit(self.first)
        at = F.greatest(F.lit(0), F.least(step, F.lit(len(self.ids) - 1))).cast("int")
        parts = F.pow(F.lit(2.0), F.get(listed(self.splits), at)).cast("bigint")
        inside = F.floor((c - (step + F.lit(self.first)) * F.lit(self.unit)) * parts / F.lit(self.unit)).cast("bigint")
        part = F.when(step < 0, 0).when(step >= len(self.ids), parts - 1).otherwise(F.least(inside, parts - 1))
        return F.when(c.isNotNull(), F.get(listed(self.ids), at) + part)


def even_width(width) -> float:
    return width.even if isinstance(width, Stretches) else width


def chunk_of(t: str | Column, width: float | Stretches, reverse: bool = False) -> Column:
    c = F.col(t) if isinstance(t, str) else t
    out = width.of(c) if isinstance(width, Stretches) else F.floor(c / F.lit(width)).cast("bigint")
    if reverse:
        out = -out
    return F.coalesce(out, F.lit(_NO_TIME))


def stretches(df: DataFrame, by: Sequence[str], t: str, finest: int, target: int = 1_000_000, steps: int = 1024) -> Stretches:
    """Borders along ``t`` with which no chunk of a key holds more than ``target`` rows (or is ``finest`` wide).

    Rows are counted by key; those of keys with more than ``target`` are counted by finest step too. Of each of at most ``steps``
    coarse steps the driver gets the fullest key's rows and the splits it needs, and merges neighbours while their sum keeps
    the target. ``t`` may be any order axis, also one that folds onto itself like the time left. Rows with a null key do not
    count, as they are dealt out by a hash.
    """
    rows = df.filter(F.col(t).isNotNull() if not by else _if_known(by, F.col(t).isNotNull(), F.lit(False)))
    totals = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
    most, lo, hi = totals.agg(F.max("n"), F.min("lo"), F.max("hi")).first()
    if lo is None:
        return Stretches(finest, 0, (0,), (0,))
    lo, hi, top = int(lo // finest), int(hi // finest), 0
    while (hi >> top) - (lo >> top) >= steps:
        top += 1
    if most <= target:
        whole = (0,) * ((hi >> top) - (lo >> top) + 1)
        return Stretches(finest << top, lo >> top, whole, whole)
    # keys that keep the target as a whole keep it in every chunk
    rows = rows.join(totals.filter(F.col("n") > target).select(*by), by, "left_semi") if by else rows
    fine = cut(rows.groupBy(*by, F.floor(F.col(t) / finest).cast("bigint").alias(CHUNK)).agg(F.count(F.lit(1)).alias("n")), "steps")
    wide = fine.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(top)))).withColumn(CHUNK, F.expr(f"shiftright({CHUNK}, {top} - _j)"))
    most = wide.groupBy(*by, "_j", CHUNK).agg(F.sum("n").alias("n")).groupBy("_j", CHUNK).agg(F.max("n").alias("n"))
    most = most.groupBy(F.expr(f"shiftright({CHUNK}, _j)").alias("step"), "_j").agg(F.max("n").alias("n"))
    rows = most.groupBy("step").agg(F.max(F.when(F.col("_j") == 0, F.col("n"))).alias("n"), F.min(F.when(F.col("n") <= target, F.col("_j"))).alias("j")).collect()
    found = {r["step"]: (r["n"], top if r["j"] is None else r["j"]) for r in rows}
    ids, splits, chunk, held = [], [], 0, 0
    for step in range(lo >> top, (hi >> top) + 1):
        n, j = found.get(step, (0, 0))
        if held and (j or held + n > target):
            chunk, held = chunk + 1, 0
        ids.append(chunk)
        splits.append(j)
        chunk, held = (chunk + (1 << j), 0) if j else (chunk, held + n)
    return Stretches(finest << top, lo >> top, tuple(ids), tuple(splits))


def chunk_width(df: DataFrame, by: Sequence[str], t: str, finest: int, target: int = 1_000_000, doublings: int = 20) -> int:
    """The widest ``finest * 2^j`` for which no chunk of a key holds more than ``target`` rows (``finest`` if none does).

    Rows are counted once by key and finest step, and the small counts are added up for all doublings together; one row
    a doubling comes to the driver.
    """
    known = _if_known(by, F.col(t).isNotNull(), F.lit(False))
    steps = df.filter(known).groupBy(*by, F.floor(F.col(t) / finest).cast("bigint").alias(CHUNK)).agg(F.count(F.lit(1)).alias("n"))
    wide = steps.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(doublings)))).withColumn(CHUNK, F.expr(f"shiftright({CHUNK}, _j)"))
    most = wide.groupBy(*by, "_j", CHUNK).agg(F.sum("n").alias("n")).groupBy("_j").agg(F.max("n").alias("n")).filter(F.col("n") <= target)
    return finest << (most.agg(F.max("_j")).first()[0] or 0)


def _order(cols: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).desc_nulls_last() if reverse else F.col(c).asc_nulls_last() for c in cols]


def _anti_order(cols: Sequence[str], reverse: bool) -> list[Column]:
    return [F.col(c).asc_nulls_first() if reverse else F.col(c).desc_nulls_first() for c in cols]


def _tail_of(arr: Column, k: int) -> Column:
    return F.when(F.size(arr) <= k, arr).otherwise(F.slice(arr, -k, k))


def _tag(df: DataFrame, chunk: Column, chunk_col: str | None) -> tuple[DataFrame, str]:
    """Add the chunk column, or keep one that an earlier operator of the same key left behind."""
    name = chunk_col or CHUNK
    return (df if name in df.columns else df.withColumn(name, chunk)), name


def _kept(df: DataFrame, chunk_col: str | None, drop: Sequence[str] = ()) -> list[str]:
    cols = [c for c in df.columns if c not in drop]
    return cols if chunk_col is None or chunk_col in cols else [*cols, chunk_col]


def prior_rows(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    fields: Sequence[str],
    k: int,
    width: float,
    out: str = "prior",
    reverse: bool = False,
    source: DataFrame | None = None,
    chunk_col: str | None = None,
) -> DataFrame:
    """Add ``out``: the up to ``k`` preceding rows of the key, oldest first, as array of structs.

    ``reverse=True`` gives the following rows (nearest last). ``source`` may name a cheaper table
    with the same rows from which chunk tails are read, so that a chain of operators does not
    recompute its own input. ``chunk_col`` keeps the chunk under that name: operators of one key that
    share it (and the direction) run on one shuffle.
    """
    by, order = list(by), list(order)
    need = list(dict.fromkeys([*by, *order, *fields]))
    item = F.struct(*fields)
    chunk = _spread(by, order, chunk_of(order[0], width, reverse))
    df_t, name = _tag(df, chunk, chunk_col)
    src = (source if source is not None else df).select(*need).withColumn(name, chunk)
    newest = Window.partitionBy(*by, name).orderBy(*_anti_order(order, reverse))
    tails = (
        src.withColumn("_rn", F.row_number().over(newest))
        .filter(F.col("_rn") <= k)  # becomes a map-side group limit
        .groupBy(*by, name)
        .agg(F.reverse(F.array_sort(F.collect_list(F.struct("_rn", item.alias("_item"))))).alias("_t"))
        .withColumn("_t", F.col("_t._item"))
    )
    before = Window.partitionBy(*by).orderBy(name).rowsBetween(-k, -1)
    ctx = tails.select(*by, name, _tail_of(F.flatten(F.collect_list("_t").over(before)), k).alias("_ctx"))
    w = Window.partitionBy(*by, name).orderBy(*_order(order, reverse))
    lags = F.array_compact(F.array(*[F.lag(item, i).over(w) for i in range(k, 0, -1)]))
    # the window sorts by (key, chunk, ...), which is also the order the join needs
    joined = df_t.withColumn("_lags", lags).join(ctx, [*by, name], "left")
    full = F.when(F.col("_ctx").isNull(), F.col("_lags")).otherwise(F.concat("_ctx", "_lags"))
    full = joined.withColumn(out, full)
    res = _tail_of(F.col(out), k)
    res = _if_known(by, res, F.slice(F.col(out), 1, 0))
    return full.withColumn(out, res).select(*_kept(df, chunk_col, [out]), out)


def nth_prior(prior: str, field: str, n: int) -> Column:
    """The value ``n`` rows before (1 = previous) from a ``prior_rows`` array, null when absent."""
    return F.try_element_at(F.col(prior), F.lit(-n))[field]


def mean_of(prior: str, field: str) -> Column:
    """Mean of the non-null values of ``field`` in a ``prior_rows`` array."""
    vals = F.filter(F.col(prior)[field], lambda x: x.isNotNull())
    total = F.aggregate(vals, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(vals) > 0, total / F.size(vals))


def last_known(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    value: str,
    width: float,
    out: str,
    inclusive: bool = True,
    reverse: bool = False,
) -> DataFrame:
    """Forward fill (``reverse=True``: back fill) of ``value`` per key."""
    by, order = list(by), list(order)
    chunk = _spread(by, order, chunk_of(order[0], width, reverse))
    seen = F.col(value).isNotNull()
    pos = F.when(seen, F.struct(*order))
    pick = F.min_by if reverse else F.max_by
    summary = df.select(*dict.fromkeys([*by, *order, value])).withColumn(CHUNK, chunk).groupBy(*by, CHUNK).agg(pick(F.col(value), pos).alias("_v"))
    carried = F.last("_v", True).over(Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1))
    ctx = summary.select(*by, CHUNK, carried.alias("_ctx"))
    w = Window.partitionBy(*by, CHUNK).orderBy(*_order(order, reverse)).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return (
        df.withColumn(CHUNK, chunk)
        .withColumn("_seen", F.last(value, True).over(w))
        .join(ctx, [*by, CHUNK], "left")
        .withColumn(out, _if_known(by, F.coalesce("_seen", "_ctx"), F.col(value) if inclusive else F.lit(None)))
        .select(*[c for c in df.columns if c != out], out)
    )


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    sums: dict[str, Column],
    width: float | None = None,
    chunk: Column | None = None,
    exclusive: bool = False,
    reverse: bool = False,
    source: DataFrame | None = None,
    chunk_col: str | None = None,
) -> DataFrame:
    """Running totals per key in order; ``by`` may be empty for a global order.

    ``chunk`` may be any expression that does not decrease along the order. Null addends count 0.
    """
    by, order = list(by), list(order)
    chunk = _spread(by, order, chunk_of(order[0], width, reverse) if chunk is None else chunk)
    adds = {n: F.coalesce(e, F.lit(0)) for n, e in sums.items()}
    totals = (source if source is not None else df).withColumn("_ck", chunk).groupBy(*by, "_ck").agg(*[F.sum(e).alias(f"_s_{n}") for n, e in adds.items()])
    tagged, name = _tag(df, chunk, chunk_col)
    prev = Window.partitionBy(*by).orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    ctx = totals.select(*by, F.col("_ck").alias(name), *[F.coalesce(F.sum(f"_s_{n}").over(prev), F.lit(0)).alias(f"_c_{n}") for n in sums])
    w = Window.partitionBy(*by, name).orderBy(*_order(order, reverse)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    within = tagged.withColumns({f"_w_{n}": F.coalesce(F.sum(e).over(w), F.lit(0)) for n, e in adds.items()})
    got = {f"_r_{n}": _if_known(by, F.col(f"_w_{n}") + F.coalesce(F.col(f"_c_{n}"), F.lit(0)), F.lit(0) if exclusive else e) for n, e in adds.items()}
    return within.join(ctx, [*by, name], "left").withColumns(got).select(*_kept(df, chunk_col, list(sums)), *[F.col(f"_r_{n}").alias(n) for n in sums])


def key_stats(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    width: float,
    stats: dict[str, tuple[str, str | None]],
    source: DataFrame | None = None,
    chunk_col: str | None = None,
) -> DataFrame:
    """Whole-key statistics on every row: ``{out: (kind, column)}``, kind one of min, max, sum, count, last.

    Chunks are aggregated first (map-side), their small table is combined per key and joined back by
    (key, chunk): a hot key never meets in one task, and the join needs no shuffle of its own beside
    other operators of the same chunks. ``last`` is the last non-null value in order.
    """
    by, order = list(by), list(order)
    chunk = _spread(by, order, chunk_of(order[0], width))
    src = (source if source is not None else df).withColumn("_ck", chunk)
    first, then = [], []
    every = Window.partitionBy(*by)
    for out, (kind, col) in stats.items():
        if kind == "count":
            first.append(F.count(F.lit(1)).alias(f"_g_{out}"))
        elif kind == "last":
            first.append(F.max(F.when(F.col(col).isNotNull(), F.struct(*[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(col).alias("_v")))).alias(f"_g_{out}"))
        else:
            first.append(getattr(F, kind)(col).alias(f"_g_{out}"))
        if kind == "last":
            then.append(F.max(f"_g_{out}").over(every)["_v"].alias(out))
        else:
            then.append((F.min if kind == "min" else F.max if kind == "max" else F.sum)(f"_g_{out}").over(every).alias(out))
    df_t, name = _tag(df, chunk, chunk_col)
    ctx = src.groupBy(*by, "_ck").agg(*first).select(*by, F.col("_ck").alias(name), *then)
    return df_t.join(ctx, [*by, name], "left").select(*_kept(df, chunk_col, list(stats)), *stats)


def row_index(df: DataFrame, by: Sequence[str], order: Sequence[str], width: float, out: str = "row_index", reverse: bool = False, source: DataFrame | None = None, chunk_col: str | None = None) -> DataFrame:
    """1-based position of each row in its key's order."""
    return running_sums(df, by, order, {out: F.lit(1).cast("bigint")}, width, reverse=reverse, source=source, chunk_col=chunk_col)


def _sub_blocks(span: int, width: float | Stretches | None) -> int:
    """The least divisor of ``span`` that makes blocks of ``width`` or less."""
    most = 1 if width is None else -(-span // max(1, int(even_width(width))))
    if most <= 1:
        return 1
    divisors = {d for i in range(1, int(span**0.5) + 1) if span % i == 0 for d in (i, span // i)}
    return min(d for d in divisors if d >= most) if most <= span else span


def lookback_sums(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    lt: str,
    rt: str,
    span: int,
    sums: dict[str, Column],
    closed: str = "left",
    width: float | Stretches | None = None,
) -> DataFrame:
    """Sums over the ``right`` rows of the key in the ``span`` before each left row; whole-number times.

    ``closed='left'`` is ``[t-span, t)``, ``'both'`` is ``[t-span, t]``. Time is cut into sub-blocks that divide the span
    and are no wider than ``width`` (one sub-block without it). A range is a prefix of its own sub-block, whole
    sub-blocks that enter as one row of totals each, and a suffix of the farthest one: each right row is copied
    once, the parts at both ends are growing frames, and there are additions only. A key as hot as may be is
    split as finely as ``width`` says.
    """
    by = list(by)
    m = _sub_blocks(span, width)
    step = span // m
    xs = [f"_x_{n}" for n in sums]
    add = [F.coalesce(e, F.lit(0)).alias(x) for x, e in zip(xs, sums.values())]
    vals = right.filter(F.col(rt).isNotNull()).select(*by, F.col(rt).alias("_t"), *add)
    late = vals.withColumn("_t", F.col("_t") + F.lit(span)).withColumn("_late", F.lit(True))
    if left is right and lt == rt:
        rows = left.select(*left.columns, F.col(lt).alias("_t"), *add).withColumn("_own", F.lit(True)).withColumn("_row", F.lit(True))
    else:
        rows = left.withColumn("_t", F.col(lt)).withColumn("_row", F.lit(True)).unionByName(vals.withColumn("_own", F.lit(True)), allowMissingColumns=True)
    rows = rows.unionByName(late, allowMissingColumns=True)
    if m > 1:
        rows = rows.unionByName(_whole_blocks(left, vals, by, lt, step, m, xs), allowMissingColumns=True)
    rows = rows.withColumn(CHUNK, _spread(by, ["_t"], chunk_of("_t", step)))
    part = Window.partitionBy(*by, CHUNK)
    # ascending: values of the own sub-block before (or up to) the row's time, behind the totals of whole ones
    up = part.orderBy(F.col("_t").asc()).rangeBetween(Window.unboundedPreceding, -1 if closed == "left" else 0)
    # descending: shifted values of the farthest sub-block, back to the start of the range
    down = part.orderBy(F.col("_t").desc()).rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_up{x}": F.sum(F.when(F.col("_own"), F.col(x))).over(up) for x in xs})
    rows = rows.withColumns({f"_dn{x}": F.sum(F.when(F.col("_late"), F.col(x))).over(down) for x in xs})
    zero = F.lit(0)
    if m > 1:  # the one row of totals of the sub-block
        rows = rows.withColumns({f"_md{x}": F.max(f"_mid{x}").over(part) for x in xs})
    mid = lambda x: F.coalesce(F.col(f"_md{x}"), zero) if m > 1 else zero
    outs = [_if_known(by, F.coalesce(F.col(f"_up{x}"), zero) + mid(x) + F.coalesce(F.col(f"_dn{x}"), zero), zero).alias(n) for x, n in zip(xs, sums)]
    return rows.filter("_row").select(*left.columns, *outs)


def _whole_blocks(left: DataFrame, vals: DataFrame, by: Sequence[str], lt: str, step: int, m: int, xs: Sequence[str]) -> DataFrame:
    """One row per (key, sub-block) that is asked: totals of the ``m - 1`` sub-blocks before it, placed at its start."""
    asked = left.filter(_if_known(by, F.col(lt).isNotNull(), F.lit(False)) if by else F.col(lt).isNotNull()).select(*by, chunk_of(lt, step).alias(CHUNK)).distinct()
    known = vals.filter(_if_known(by, F.lit(True), F.lit(False))) if by else vals
    totals = known.groupBy(*by, chunk_of("_t", step).alias(CHUNK)).agg(*[F.sum(x).alias(x) for x in xs])
    spine = totals.unionByName(asked, allowMissingColumns=True).groupBy(*by, CHUNK).agg(*[F.sum(x).alias(x) for x in xs])
    before = Window.partitionBy(*by).orderBy(CHUNK).rangeBetween(-(m - 1), -1)
    return spine.select(*by, (F.col(CHUNK) * F.lit(step)).alias("_t"), *[F.sum(x).over(before).alias(f"_mid{x}") for x in xs])


def positions(df: DataFrame, order: Sequence[str], out: str = "position") -> DataFrame:
    """Position from 1 of every row in the whole order, without one sort of all rows.

    Rows are dealt into ranges whose borders Spark draws from the values, so values that all begin alike are spread too; each range
    is numbered apart and the sizes of the ranges before it are added. The dealt rows are written, so that
    ranges stay as they were counted.
    """
    order = list(order)
    dealt = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    at = dealt.withColumn("_i", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    return at.join(offsets, "_range").select(*df.columns, (F.col("_i") + F.col("_before")).alias(out))


def sums_until(
    probes: DataFrame,
    points: DataFrame,
    by: Sequence[str],
    probe_t: str,
    point_t: str,
    sums: dict[str, Column],
    width: float,
    inclusive: bool = False,
) -> DataFrame:
    """For each probe, totals of the key's points before its time (``inclusive``: at or before).

    The difference of two probes is the total of an interval, so interval statistics need no
    pairs of points and intervals. Totals of whole earlier chunks enter as one row per chunk.
    """
    by = list(by)
    add = [F.coalesce(e, F.lit(0)).alias(f"_x_{n}") for n, e in sums.items()]
    xs = [f"_x_{n}" for n in sums]
    vals = (
        points.filter(_if_known(by, F.col(point_t).isNotNull(), F.lit(False)))
        .select(*by, F.col(point_t).alias("_t"), *add)
        .groupBy(*by, "_t")
        .agg(*[F.sum(x).alias(x) for x in xs])
        .withColumn(CHUNK, chunk_of("_t", width))
    )
    ask = probes.withColumn("_t", F.col(probe_t)).withColumn(CHUNK, _spread(by, ["_t"], chunk_of("_t", width)))
    totals = vals.groupBy(*by, CHUNK).agg(*[F.sum(x).alias(x) for x in xs])
    asked = ask.select(*by, CHUNK).distinct()
    spine = totals.unionByName(asked, allowMissingColumns=True).groupBy(*by, CHUNK).agg(*[F.sum(x).alias(x) for x in xs])
    prev = Window.partitionBy(*by).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    base = spine.select(*by, CHUNK, F.lit(0).alias("_role"), *[F.sum(x).over(prev).alias(x) for x in xs])
    rows = (
        ask.withColumn("_role", F.lit(2))
        .unionByName(vals.withColumn("_role", F.lit(1 if inclusive else 3)), allowMissingColumns=True)
        .unionByName(base, allowMissingColumns=True)
    )
    w = Window.partitionBy(*by, CHUNK).orderBy(F.col("_t").asc_nulls_first(), F.col("_role").asc()).rowsBetween(Window.unboundedPreceding, 0)
    for n in sums:
        rows = rows.withColumn(f"_r_{n}", F.sum(f"_x_{n}").over(w))
    return rows.filter("_role = 2").select(*probes.columns, *[_if_known(by, F.coalesce(F.col(f"_r_{n}"), F.lit(0)), F.lit(0)).alias(n) for n in sums])
