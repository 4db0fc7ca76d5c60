"""Interval joins and interval statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tramline.functions.scalars import EARTH_RADIUS_M, haversine_m
from tramline.operators.dominance import distinct_in_intervals
from tramline.operators.ordered import CHUNK, _spread, even_width, known_key, sums_until
from tramline.session import cut

EVENT_PAD_S = 5400
NO_EVENT = "Ninguno"
UNKNOWN_EVENT = "Desconocido"


def join_events(
    trains: DataFrame,
    events: DataFrame,
    by: Sequence[str],
    t: str,
    start: str,
    end: str,
    kind: str,
    score: str,
    pad: float = EVENT_PAD_S,
    width: float | None = None,
) -> DataFrame:
    """City events around each train at its stop and day.

    Adds the number of events whose padded interval holds the train time, the kind of the one with
    the highest score, and the counts before ``[start-pad, start)``, during ``[start, end]`` and
    after ``(end, end+pad]``. No pair of train and event is formed: time is cut into chunks no longer
    than a padded interval (``2 * pad``, or ``width`` where a hot key needs less), so inside a chunk an interval is
    open on at least one side; chunks it covers whole get one row of totals a chunk, added up before they are sent.
    Counts are running sums of +1/-1 steps, the best kind a running maximum from each side.
    An end before its start is read as past midnight (+86400).
    """
    by = list(by)
    w = 2 * pad if width is None else min(2 * pad, even_width(width))
    ev = events.filter(known_key(by) & F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn(
        "_e", F.when(F.col(end) < F.col(start), F.col(end) + 86_400).otherwise(F.col(end))
    )
    ev = ev.select(
        *by,
        F.col(start).cast("double").alias("_s"),
        F.col("_e").cast("double").alias("_e"),
        F.struct(F.coalesce(F.col(score), F.lit(0.0)).cast("double").alias("score"), F.coalesce(F.col(kind), F.lit(UNKNOWN_EVENT)).alias("kind")).alias("_best"),
    ).withColumns({"_sp": F.col("_s") - pad, "_ep": F.col("_e") + pad})
    first, last = F.floor(F.col("_sp") / w), F.floor(F.col("_ep") / w)
    # an interval covers few chunks: its length over 2 * pad
    piece = ev.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn("_cs", F.col(CHUNK) * F.lit(float(w)))
    ce = F.col("_cs") + w

    def steps(lo: Column, lo_closed: bool, hi: Column, hi_closed: bool, name: str) -> list[Column]:
        # rank at equal times: 0 before trains, 2 after trains
        enter_rank = F.when(lo < F.col("_cs"), 0).otherwise(0 if lo_closed else 2)
        leave_rank = F.lit(2 if hi_closed else 0)
        live = (hi >= F.col("_cs")) & (lo < ce) & (hi >= lo)
        blank = {n: F.lit(0) for n in ("d_before", "d_during", "d_after")}
        up, down = {**blank, name: F.lit(1)}, {**blank, name: F.lit(-1)}
        pack = lambda t_, r, d: F.struct(t_.alias("t"), r.cast("int").alias("r"), *[v.alias(k) for k, v in d.items()])
        return [F.when(live, pack(F.greatest(lo, F.col("_cs")), enter_rank, up)), F.when(live & (hi < ce), pack(hi, leave_rank, down))]

    moves = F.array_compact(
        F.array(
            *steps(F.col("_sp"), True, F.col("_s"), False, "d_before"),
            *steps(F.col("_s"), True, F.col("_e"), True, "d_during"),
            *steps(F.col("_e"), False, F.col("_ep"), True, "d_after"),
        )
    )
    deltas = (
        piece.withColumn("_m", F.explode(moves))
        .groupBy(*by, CHUNK, F.col("_m.t").alias("_t"), F.col("_m.r").alias("_role"))
        .agg(*[F.sum(f"_m.{d}").alias(d) for d in ("d_before", "d_during", "d_after")])
    )
    # open to the right: valid from its entry to the chunk's end; open to the left: up to its end
    opens = piece.filter(F.col("_ep") >= ce).select(*by, CHUNK, F.greatest("_sp", "_cs").alias("_t"), F.lit(0).alias("_role"), F.col("_best").alias("_open"))
    closes = piece.filter(F.col("_ep") < ce).select(*by, CHUNK, F.col("_ep").alias("_t"), F.lit(2).alias("_role"), F.col("_best").alias("_close"))
    opens = opens.groupBy(*by, CHUNK, "_t", "_role").agg(F.max("_open").alias("_open"))
    closes = closes.groupBy(*by, CHUNK, "_t", "_role").agg(F.max("_close").alias("_close"))
    probe = trains.withColumn("_t", F.col(t).cast("double")).withColumn(CHUNK, _spread(by, ["_t"], F.floor(F.col("_t") / w))).withColumn("_role", F.lit(1))
    rows = probe
    for part in (deltas, opens, closes):
        rows = rows.unionByName(part, allowMissingColumns=True)
    up = Window.partitionBy(*by, CHUNK).orderBy(F.col("_t").asc(), F.col("_role").asc()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, CHUNK).orderBy(F.col("_t").desc(), F.col("_role").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_{d}": F.sum(d).over(up) for d in ("d_before", "d_during", "d_after")} | {"_o": F.max("_open").over(up)})
    rows = rows.withColumn("_c", F.max("_close").over(down))
    n = lambda d: F.coalesce(F.col(f"_{d}"), F.lit(0)).cast("bigint")
    total = n("d_before") + n("d_during") + n("d_after")
    best = F.greatest("_o", "_c")
    return rows.filter("_role = 1").select(
        *trains.columns,
        total.alias("n_events"),
        F.when(total > 0, best["kind"]).otherwise(NO_EVENT).alias("event_kind"),
        n("d_before").alias("n_before"),
        n("d_during").alias("n_during"),
        n("d_after").alias("n_after"),
    )


def interval_stats(
    intervals: DataFrame, points: DataFrame, by: Sequence[str], lo: str, hi: str, t: str, sums: dict[str, Column], width: float, keep: Sequence[str]
) -> DataFrame:
    """Totals of the key's points in ``[lo, hi)`` for each interval, by running totals at its two ends.

    Intervals are identified by ``keep``; the work is linear in points plus intervals.
    """
    ends = intervals.select(
        *dict.fromkeys([*by, *keep]), F.explode(F.array(F.struct(F.col(lo).alias("t"), F.lit(-1).alias("s")), F.struct(F.col(hi).alias("t"), F.lit(1).alias("s")))).alias("_end")
    ).withColumns({"_at": F.col("_end.t"), "_sign": F.col("_end.s")})
    got = sums_until(ends.drop("_end"), points, by, "_at", t, sums, width)
    return got.groupBy(*keep).agg(*[F.sum(F.col(n) * F.col("_sign")).alias(n) for n in sums])


def event_study(points: DataFrame, notices: DataFrame, by: Sequence[str], t: str, at: str, value: str, lo: int, hi: int, step: int, width: float, group: Sequence[str] = ()) -> DataFrame:
    """Mean value by relative-time bin ``[lo, hi)`` around notices of the same key.

    Each notice asks for running totals at the bin edges; a bin is the difference of the totals of
    two edges, taken once over all notices.
    """
    edges = F.array(*[F.lit(e).cast("bigint") for e in range(lo, hi + 1, step)])
    probes = notices.select(*by, *group, F.col(at).alias("_at"), F.explode(edges).alias("rel_bin")).withColumn("_q", F.col("_at") + F.col("rel_bin"))
    sums = {"_sum": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("bigint")}
    got = sums_until(probes, points, by, "_q", t, sums, width)
    # totals over all notices of running counts can pass a long
    at_edge = got.groupBy(*group, "rel_bin").agg(F.sum("_sum").alias("_sum"), F.sum(F.col("_n").cast("decimal(38,0)")).alias("_n"))
    nxt = Window.partitionBy(*group).orderBy("rel_bin")  # one row per edge
    binned = at_edge.select(*group, "rel_bin", (F.lead("_sum").over(nxt) - F.col("_sum")).alias("_sum"), (F.lead("_n").over(nxt) - F.col("_n")).cast("bigint").alias("n_rows"))
    return binned.filter("n_rows > 0").select(*group, "rel_bin", (F.col("_sum") / F.col("n_rows")).alias("mean_value"), "n_rows")


def phase_windows(events: DataFrame, start: str, end: str, unit: float, phases: Sequence[tuple[str, str, float, str, float]]) -> DataFrame:
    """Phases of events as rows: (name, 'start'|'end', offset, 'start'|'end', offset) in ``unit`` steps."""
    base = {"start": F.col(start), "end": F.col(end)}
    arr = F.array(*[F.struct(F.lit(n).alias("phase"), (base[a] + F.lit(x * unit)).alias("lo"), (base[b] + F.lit(y * unit)).alias("hi")) for n, a, x, b, y in phases])
    return events.withColumn("_ph", F.explode(arr)).select(*events.columns, "_ph.phase", "_ph.lo", "_ph.hi")


# fixed values: phases in steps of 1.5 hours around an event
FIVE_PHASES = (
    ("before", "start", -4, "start", -1),
    ("entry", "start", -1, "start", 0),
    ("during", "start", 0, "end", 0),
    ("exit", "end", 0, "end", 1),
    ("after", "end", 1, "end", 4),
)
THREE_PHASES = (("before", "start", -1, "start", 0), ("during", "start", 0, "end", 0), ("after", "end", 0, "end", 1))


def event_phases(trains: DataFrame, events: DataFrame, stop: str, t: str, value: str, start: str, end: str, keep: Sequence[str], unit: float, width: float, phases=FIVE_PHASES) -> DataFrame:
    """Mean value at the event's stop per phase; absolute times carry windows over midnight."""
    win = phase_windows(events, start, end, unit, phases)
    sums = {"_sum": F.col(value), "n_rows": F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("bigint")}
    got = interval_stats(win, trains, [stop], "lo", "hi", t, sums, width, [*keep, "phase"])
    return got.select(*keep, "phase", F.when(F.col("n_rows") > 0, F.col("_sum") / F.col("n_rows")).alias("mean_value"), "n_rows")


def phase_lines(trains: DataFrame, events: DataFrame, stop: str, line: str, t: str, value: str, start: str, end: str, keep: Sequence[str], unit: float, width, phases=THREE_PHASES) -> DataFrame:
    """Mean value and rows per event, phase and line of the event's stop; lines without a value in the phase are left out.

    An event meets the few lines of its stop, never their rows.
    """
    lines = trains.select(stop, line).filter(F.col(line).isNotNull()).distinct()
    win = phase_windows(events.select(*dict.fromkeys([stop, *keep, start, end])).join(lines, stop), start, end, unit, phases)
    sums = {"_sum": F.col(value), "n_rows": F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("bigint")}
    got = interval_stats(win, trains, [stop, line], "lo", "hi", t, sums, width, [*keep, line, "phase"])
    return got.filter("n_rows > 0").select(*keep, line, "phase", (F.col("_sum") / F.col("n_rows")).alias("mean_value"), "n_rows")


def phase_trips(trains: DataFrame, events: DataFrame, stop: str, t: str, trip: str, cond: Column, start: str, end: str, keep: Sequence[str], unit: float, width, phases=THREE_PHASES) -> DataFrame:
    """Distinct trips with a row that meets ``cond`` per event and phase, and the share of such rows; phases with rows only."""
    win = phase_windows(events.select(*dict.fromkeys([stop, *keep, start, end])), start, end, unit, phases)
    ids = [*keep, "phase"]
    met = F.coalesce(cond, F.lit(False))
    rows = interval_stats(win, trains, [stop], "lo", "hi", t, {"_n": F.lit(1).cast("bigint"), "_met": met.cast("bigint")}, width, ids)
    n = distinct_in_intervals(win, trains.filter(met), [stop], "lo", "hi", t, trip, ids, width, "n_trips")
    return rows.filter("_n > 0").join(n, ids).select(*ids, "n_trips", (F.col("_met") / F.col("_n")).alias("share_rows"))


def event_impact(trains: DataFrame, events: DataFrame, stop: str, t: str, value: str, start: str, end: str, keep: Sequence[str], unit: float, width: float, net_width: float | None = None) -> DataFrame:
    """Mean at the event's stop against the rest of the network on entry and exit, and net impact.

    Network totals are the stops' totals of each instant added up, and running totals of these over the time axis; ``net_width`` is a
    chunk width of that axis for all stops together.
    """
    phases = (("entry", "start", -1, "start", 0), ("exit", "end", 0, "end", 1))
    win = phase_windows(events, start, end, unit, phases)
    sums = {"_sum": F.col(value), "_n": F.when(F.col(value).isNotNull(), 1).otherwise(0).cast("bigint")}
    ids = [*keep, "phase"]
    here = interval_stats(win, trains, [stop], "lo", "hi", t, sums, width, ids)
    # passages without a stop are no part of the network
    per_stop = trains.filter(F.col(stop).isNotNull()).groupBy(stop, t).agg(F.sum(value).alias("_sum"), F.count(value).alias("_n"))
    net = interval_stats(win, per_stop, [], "lo", "hi", t, {"_sum": F.col("_sum"), "_n": F.col("_n")}, width if net_width is None else net_width, ids)
    net = net.select(*ids, F.col("_sum").alias("_asum"), F.col("_n").alias("_an"))
    j = here.join(net, ids)
    at_stop = F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))
    rest = F.when(F.col("_an") > F.col("_n"), (F.col("_asum") - F.col("_sum")) / (F.col("_an") - F.col("_n")))
    return j.select(*ids, at_stop.alias("mean_stop"), rest.alias("mean_rest"), (at_stop - rest).alias("net_impact"))


#: intervals that meet a point as one row
TILE = 64


def range_join(points: DataFrame, intervals: DataFrame, by: Sequence[str], t: str, lo: str, hi: str, width: float, how: str = "inner") -> DataFrame:
    """Rows of the key inside each interval ``[lo, hi)``, for results that are rows themselves.

    Both sides meet on a time bucket, so a hot key is spread over its buckets. A bucket is an eighth of ``width``: an interval is copied to
    more of them, but few points are tried that lie outside of it. Inside a bucket the intervals meet points as tiles of ``TILE`` intervals that
    begin one after the other, which are taken apart after the join. So the join has a row for each point and tile, and the result comes tile by tile,
    the same intervals for one point after another, which a columnar file keeps in a small part of the space of rows in any order. Other
    joins than ``inner`` meet row by row.
    """
    by, fine = list(by), width / 8
    own = [c for c in intervals.columns if c not in by]
    p = points.withColumn(CHUNK, F.floor(F.col(t) / fine))
    i = intervals.withColumn(CHUNK, F.explode(F.sequence(F.floor(F.col(lo) / fine), F.floor(F.col(hi) / fine))))
    if how != "inner":
        j = p.join(i, [p[c] == i[c] for c in by] + [p[CHUNK] == i[CHUNK], p[t] >= i[lo], p[t] < i[hi]], how)
        for c in by:
            j = j.drop(i[c])
        return j.drop(CHUNK)
    if by:
        i = i.filter(known_key(by))
    rank = F.row_number().over(Window.partitionBy(*by, CHUNK).orderBy(lo, hi))
    tiles = i.withColumn("_tile", F.floor((rank - 1) / TILE)).groupBy(*by, CHUNK, "_tile").agg(
        F.min(lo).alias("_from"), F.max(hi).alias("_to"), F.collect_list(F.struct(*own)).alias("_rows")
    )
    # merged, not broadcast: memory stays that of a bucket, and tiles lead the order of the result
    j = tiles.hint("merge").join(p, [*by, CHUNK]).filter((F.col(t) >= F.col("_from")) & (F.col(t) < F.col("_to")))
    j = j.select(*points.columns, F.explode("_rows").alias("_row"))
    return j.filter((F.col(t) >= F.col(f"_row.{lo}")) & (F.col(t) < F.col(f"_row.{hi}"))).select(*points.columns, *[F.col(f"_row.{c}") for c in own])


def _cells(df: DataFrame, lat: str, lon: str, metres: float, spread: bool) -> DataFrame:
    """Grid cells at least ``metres`` wide; each row of cells divides its circle evenly, so it closes at 180 degrees."""
    step = metres / 111_000.0
    row = F.floor(F.col(lat) / step)

    def around(r: Column) -> Column:
        edge = F.least(F.abs(r * step) + 2 * step, F.lit(89.0))
        return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / step), F.lit(1))

    def cell(r: Column, lon_col: Column, shift: int = 0) -> Column:
        return F.pmod(F.floor((lon_col + 180) / 360 * around(r)) + shift, around(r))

    if not spread:
        return df.withColumn("_row", row).withColumn("_col", cell(row, F.col(lon)))
    out = df.withColumn("_row", F.explode(F.array(*[row + d for d in (-1, 0, 1)])))
    return out.withColumn("_col", F.explode(F.array_distinct(F.array(*[cell(F.col("_row"), F.col(lon), d) for d in (-1, 0, 1)]))))


def radius_join(points: DataFrame, stations: DataFrame, metres: float, plat="lat", plon="lon", slat="stop_lat", slon="stop_lon", out="distance_m") -> DataFrame:
    """Stations within ``metres`` of each point: equi join on grid cells, then the exact distance."""
    p = _cells(points, plat, plon, metres, True)
    s = _cells(stations, slat, slon, metres, False)
    return (
        p.join(s, ["_row", "_col"])
        .withColumn(out, haversine_m(plat, plon, slat, slon))
        .filter(F.col(out) <= metres)
        .drop("_row", "_col")
    )


def _patches(df: DataFrame, lat: str, lon: str, metres: float, name: str) -> DataFrame:
    """Rows with a place, by small patches of the map whose sides are at most ``metres`` long."""
    step = metres / 111_320.0
    d = df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(F.col(lat).cast("double")) & ~F.isnan(F.col(lon).cast("double")))
    turned = F.pmod(F.col(lon) + 180, F.lit(360.0)) - 180
    return d.withColumns({"_turned": turned, name: F.struct(F.floor(F.col(lat) / step).alias("r"), F.floor(turned / step).alias("c"))})


def _middles(df: DataFrame, lat: str, lon: str, name: str, out: str, *more: Column) -> DataFrame:
    """Each patch's middle and a bound on the distance of its rows from there: along the meridian, then along the widest parallel."""
    box = df.groupBy(name).agg(F.min(lat).alias("_a"), F.max(lat).alias("_b"), F.min("_turned").alias("_c"), F.max("_turned").alias("_d"), *more)
    inner = F.when((F.col("_a") <= 0) & (F.col("_b") >= 0), 1.0).otherwise(F.cos(F.radians(F.least(F.abs("_a"), F.abs("_b")))))
    bound = (F.radians(F.col("_b") - F.col("_a")) + F.radians(F.col("_d") - F.col("_c")) * F.abs(inner)) / 2 * EARTH_RADIUS_M * (1 + 1e-9) + 0.001
    return box.select(name, ((F.col("_a") + F.col("_b")) / 2).alias(f"{out}lat"), ((F.col("_c") + F.col("_d")) / 2).alias(f"{out}lon"), bound.alias(f"{out}far"), *[c for c in ["_labels"] if more])


def reached_labels(points: DataFrame, stations: DataFrame, metres: float, keep: Sequence[str], labels: Sequence[str], plat="lat", plon="lon", slat="stop_lat", slon="stop_lon", parts: int = 8) -> DataFrame:
    """The distinct ``labels`` of the stations within ``metres`` of each point, without a row for each point and station.

    Both sides are dealt to patches a part of the radius wide. Where two patches lie within reach as a whole, all labels of the one
    hold for all points of the other; where they lie partly within reach, points meet the stations of those labels only that
    their patch has not yet. Work follows the patches and the labels, not the pairs.
    """
    keep, labels = list(keep), list(labels)
    p = _patches(points, plat, plon, metres / parts, "_pp").select(*dict.fromkeys([*keep, plat, plon]), "_turned", "_pp")
    label = F.struct(*[F.col(c).alias(f"l{i}") for i, c in enumerate(labels)])
    s = _patches(stations, slat, slon, metres / parts, "_sp").select(label.alias("_label"), slat, slon, "_turned", "_sp").distinct()
    a = _middles(p, plat, plon, "_pp", "_p")
    b = _middles(s, slat, slon, "_sp", "_s", F.collect_set("_label").alias("_labels"))  # at most the labels of one patch
    # a middle lies at most a part of the radius from its patch's rows, so this reach meets all patches that matter
    near = radius_join(a, b, metres * (1 + 2.1 / parts) + 1, "_plat", "_plon", "_slat", "_slon", "_m")
    off = F.col("_pfar") + F.col("_sfar") + metres * 1e-9
    near = cut(near.filter(F.col("_m") - off <= metres).select("_pp", "_sp", "_labels", (F.col("_m") + off <= metres).alias("_whole")), "patches")
    held = near.filter("_whole").select("_pp", F.explode("_labels").alias("_label")).distinct()
    known = held.groupBy("_pp").agg(F.collect_list("_label").alias("_known"))
    open_ = near.filter(~F.col("_whole")).join(known, "_pp", "left").withColumn("_asked", F.explode(F.array_except("_labels", F.coalesce("_known", F.slice("_labels", 1, 0)))))
    some = p.join(open_.select("_pp", F.col("_sp").alias("_at"), "_asked"), "_pp")
    some = some.join(s.select("_sp", "_label", slat, slon), (F.col("_at") == F.col("_sp")) & F.col("_asked").eqNullSafe(F.col("_label")))
    some = some.filter(haversine_m(plat, plon, slat, slon) <= metres).select(*keep, "_label").distinct()
    # one list a point, so that its labels are no rows of their own until the last step
    lists = p.join(known, "_pp").select(*keep, "_known").unionByName(some.select(*keep, F.array("_label").alias("_known")))
    got = lists.groupBy(*keep).agg(F.array_distinct(F.flatten(F.collect_list("_known"))).alias("_known")).withColumn("_label", F.explode("_known"))
    return got.select(*keep, *[F.col(f"_label.l{i}").alias(c) for i, c in enumerate(labels)])


def map_stations(names: DataFrame, stops: DataFrame, name: str, stop_name: str, metres: float = 100.0) -> DataFrame:
    """Station to stop ids by normalised name, unmatched ones by distance."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    a = names.withColumn("_n", norm(F.col(name)))
    b = stops.withColumn("_n", norm(F.col(stop_name)))
    exact = a.join(b, "_n").withColumn("distance_m", F.lit(0.0)).withColumn("how", F.lit("name"))
    rest = a.join(b.select("_n").distinct(), "_n", "left_anti")
    near = radius_join(rest, b.drop("_n"), metres).withColumn("how", F.lit("distance"))
    return exact.drop("_n").unionByName(near.drop("_n"))


def circular_seconds(day: Column, seconds: Column) -> Column:
    """Absolute seconds of a service day, so a window over midnight is an ordinary range."""
    return F.datediff(day, F.lit("1970-01-01")).cast("bigint") * 86_400 + seconds


def snowball(trains: DataFrame, events: DataFrame, stop: str, t: str, final: str, delay: str, end: str, keep: Sequence[str], span: float, width: float) -> DataFrame:
    """Trains that grow, shrink or keep their delay in the ``span`` after an event's end."""
    win = events.withColumn("_lo", F.col(end)).withColumn("_hi", F.col(end) + F.lit(span))
    both = F.col(final).isNotNull() & F.col(delay).isNotNull()
    one = lambda c: F.when(both & c, 1).otherwise(0).cast("bigint")
    sums = {
        "propagated": one(F.col(final) > F.col(delay)),
        "absorbed": one(F.col(final) < F.col(delay)),
        "unchanged": one(F.col(final) == F.col(delay)),
    }
    got = interval_stats(win, trains, [stop], "_lo", "_hi", t, sums, width, keep)
    n = F.col("propagated") + F.col("absorbed") + F.col("unchanged")
    return got.withColumn("share_propagated", F.when(n > 0, F.col("propagated") / n))
