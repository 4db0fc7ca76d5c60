"""Structured Streaming jobs (ST1-ST9)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tramline.operators import clean, joins
from tramline.operators.ordered import last_known, nth_prior, prior_rows
from tramline.session import scratch_path
from tramline.sources import lake

#: a trip silent for longer (event time, microseconds) starts anew
FORGET_US = 6 * 3600 * 1_000_000


def lag_state_batch(df: DataFrame, width: float, state: DataFrame | None = None, forget: int = FORGET_US) -> DataFrame:
    """ST1 on a table (trip, event_id, t, stop, delay, ...): lag1 and lag2 of the delay at the two stops before.

    First sighting of a trip, or first after a silence longer than ``forget``: both lags are the present delay.
    Another stop: lags shift. Same stop: they stay. ``state`` holds earlier rows' last (trip, event_id,
    t, stop, delay, lag1, lag2), from which the lags go on.
    """
    by, o = ["trip"], ["t", "event_id"]
    d = df.withColumns({"delay": F.coalesce("delay", F.lit(0.0)), "_given1": F.lit(None).cast("double"), "_given2": F.lit(None).cast("double"), "_seed": F.lit(False)})
    if state is not None:
        seed = state.withColumnsRenamed({"lag1": "_given1", "lag2": "_given2"}).withColumn("_seed", F.lit(True))
        d = d.unionByName(seed, allowMissingColumns=True)
    d = prior_rows(d, by, o, ["stop", "delay", "t"], 1, width, "_p")
    fresh = (F.size("_p") == 0) | (F.col("t") - nth_prior("_p", "t", 1) > forget)
    moved = ~nth_prior("_p", "stop", 1).eqNullSafe(F.col("stop"))
    kind = F.when(F.col("_seed"), "seed").when(fresh, "fresh").when(moved, "moved").otherwise("same")
    d = d.withColumns({"_kind": kind, "_before": nth_prior("_p", "delay", 1)}).drop("_p")
    pick = lambda given, shifted: F.when(F.col("_kind") == "seed", F.col(given)).when(F.col("_kind") == "fresh", F.col("delay")).when(F.col("_kind") == "moved", F.col(shifted))
    d = last_known(d.withColumn("_s1", pick("_given1", "_before")), by, o, "_s1", width, "lag1")
    d = prior_rows(d, by, o, ["lag1"], 1, width, "_p").withColumn("_before", nth_prior("_p", "lag1", 1))
    d = last_known(d.withColumn("_s2", pick("_given2", "_before")).drop("_p"), by, o, "_s2", width, "lag2")
    return d.filter(~F.col("_seed")).select(*df.columns, "lag1", "lag2")


class LagState:
    """ST1 on a stream: a ``foreachBatch`` sink that gives the rows of ``lag_state_batch``, whatever the micro-batches.

    A row is held back until rows up to ``late`` younger have come, so order within that bound does not matter; rows that
    come later still are kept apart under ``late``. One state row per trip stays, as long as it can still matter.

    State lies in ``buckets`` by a hash of the trip: every ``merge`` batches a whole state, between them one small table of changed trips
    a batch. A batch reads the buckets of its own trips, of the last whole state and the changes since, and writes its changes
    alone, so a few trips cost a few buckets. Which tables a batch reads follows from its number, and every batch writes its
    own tables only, so a repeated batch does no harm.
    """

    COLS = ["trip", "event_id", "t", "stop", "delay"]

    def __init__(self, path: str, width: float, late: int = 10 * 60 * 1_000_000, forget: int = FORGET_US, buckets: int = 64, merge: int = 8):
        self.path, self.width, self.late, self.forget, self.last, self.buckets, self.merge = path, width, late, forget, -1, buckets, merge

    def _at(self, what: str, epoch: int) -> str:
        return f"{self.path}/{what}/epoch={epoch}"

    def _bucket(self):
        return F.pmod(F.xxhash64("trip"), F.lit(self.buckets)).cast("int")

    def state(self, spark: SparkSession, schema, epoch: int, buckets: list[int] | None = None) -> DataFrame | None:
        """Newest row of each trip before batch ``epoch``, of the named buckets only; None where nothing was written yet."""
        whole = epoch // self.merge * self.merge - 1  # the batch after which the last whole state was written
        paths = ([self._at("whole", whole)] if whole >= 0 else []) + [self._at("changes", e) for e in range(whole + 1, epoch)]
        if not paths:
            return None
        found = None
        for path in paths:
            part = spark.read.schema(schema).parquet(path)
            part = part if buckets is None else part.filter(F.col("bucket").isin(buckets))
            found = part if found is None else found.unionByName(part)
        return self._newest(found)

    @staticmethod
    def _newest(rows: DataFrame) -> DataFrame:
        best = rows.groupBy("trip").agg(F.max_by(F.struct("event_id", "t", "stop", "delay", "lag1", "lag2"), F.struct("t", "event_id")).alias("r"))
        return best.select("trip", "r.*")

    def __call__(self, batch: DataFrame, epoch: int, flush: bool = False) -> None:
        spark, self.last = batch.sparkSession, epoch
        batch = batch.select(*self.COLS)
        kept = lambda df, what: df.write.mode("overwrite").parquet(self._at(what, epoch))
        read = lambda what: spark.read.parquet(self._at(what, epoch - 1))
        first = epoch == 0
        old = None if first else read("bound").first().bound
        newest = batch.agg(F.max("t")).first()[0]
        bound = max([b for b in (old, None if newest is None else newest - (0 if flush else self.late)) if b is not None], default=0)
        kept(spark.createDataFrame([(bound,)], "bound long"), "bound")
        rows = batch if first else batch.filter(F.col("t") > old).union(read("held").select(*self.COLS))
        if not first:
            kept(batch.filter(F.col("t") <= old), "late")
        at_once = F.lit(True) if flush else F.col("t") <= bound
        kept(rows.filter(~at_once), "held")
        ready = rows.filter(at_once)
        touched = sorted(r[0] for r in ready.select(self._bucket()).distinct().collect() if r[0] is not None)  # at most ``buckets``
        schema = batch.withColumns({"lag1": F.lit(0.0), "lag2": F.lit(0.0), "bucket": F.lit(0)}).schema
        state = self.state(spark, schema, epoch, touched)
        if state is not None:
            state = state.join(ready.select("trip").distinct(), "trip", "left_semi")
        kept(lag_state_batch(ready, self.width, state, self.forget), "out")
        out = spark.read.parquet(self._at("out", epoch)).filter(F.col("trip").isNotNull())
        live = lambda df: df.filter(F.col("t") >= bound - self.forget).withColumn("bucket", self._bucket())
        live(self._newest(out)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("changes", epoch))
        if epoch % self.merge == self.merge - 1:
            whole = self.state(spark, schema, epoch)
            now = self._newest(spark.read.schema(schema).parquet(self._at("changes", epoch)))
            both = now if whole is None else self._newest(now.unionByName(whole))
            live(both).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self._at("whole", epoch))

    def finish(self, spark: SparkSession) -> None:
        """Release the rows held back once the stream has ended."""
        if self.last >= 0:
            self(spark.read.parquet(self._at("held", self.last)).limit(0), self.last + 1, flush=True)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/out").drop("epoch")


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys, aggs) -> DataFrame:
    """ST2: closed windows by key once the watermark has passed; windows still open at the end of a run are not shown."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs)


def dedup_messages(stream: DataFrame, key: str, ts: str, horizon: str = "30 minutes") -> DataFrame:
    """ST4: one message per id inside the horizon."""
    return stream.withWatermark(ts, horizon).dropDuplicatesWithinWatermark([key])


def fresh_only(stream: DataFrame, arrival: str, now: str, cutoff: str) -> DataFrame:
    """ST5: no future arrivals, nothing older than the cutoff."""
    return clean.past_only(stream, now, arrival).filter(F.col(arrival) >= F.col(cutoff))


def match_per_batch(path: str, schedule: DataFrame, on, actual_t: str, scheduled_t: str, tie, width) -> Callable[[DataFrame, int], None]:
    """ST6: sink that gives each passage the schedule row of its key nearest on the clock; no candidates are formed.

    A repeated batch rewrites its own folder.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        got = joins.match_nearest(batch, schedule, on, actual_t, scheduled_t, tie, width)
        got.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return run


def enrich_per_batch(path: str, steps: list[Callable[[DataFrame], DataFrame]]) -> Callable[[DataFrame, int], None]:
    """ST7: sink that applies batch operators (weather, events, alerts) to each micro-batch."""

    def run(batch: DataFrame, epoch: int) -> None:
        d = batch
        for step in steps:
            d = step(d)
        d.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return run


def windows_per_batch(path: str, keep: int = 8, start: str = "window_start") -> Callable[[DataFrame, int], None]:
    """ST3/S14: publish closed windows and keep the newest few; windows still open at the end of a run are not shown."""

    def run(batch: DataFrame, epoch: int) -> None:
        lake.publish_window(batch, path, start)
        lake.retain_windows(batch.sparkSession, path, keep, start)

    return run


def scores_per_batch(path: str, scorer: Callable[[DataFrame], DataFrame], threshold: float) -> Callable[[DataFrame, int], None]:
    """ST9: publish scores at or above the threshold."""

    def run(batch: DataFrame, epoch: int) -> None:
        d = scorer(batch).filter(F.col("probability") >= threshold)
        d.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return run


def monitor(stream: DataFrame, ts: str, key: str, value: str, after: str, width: str, late: str) -> DataFrame:
    """ST8: mean value per key and window beside the mean ``after`` later; closed windows only.

    Both sides are aggregated before they meet, so the join has one row per key and window.
    """
    now = stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), F.col(key).alias("k")).agg(F.avg(value).alias("before"))
    moved = stream.withColumn("_ts", F.expr(f"{ts} - interval {after}")).withWatermark("_ts", late)
    later = moved.groupBy(F.window("_ts", width).alias("w"), F.col(key).alias("k")).agg(F.avg(value).alias("after"))
    return now.join(later, ["w", "k"])


#: rows that are looked through at once for the ends of their cells
MARK_ROWS = 1_000_000


def _mark_ends(by: str, t: str, tie: Sequence[str]) -> Callable:
    """Marks the rows at a cell's first and last instant, the first by ``tie`` of each, among the rows that a task of a batch holds."""

    def mark(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def done(held):
            d = pa.Table.from_batches(held)
            order = pc.sort_indices(d, sort_keys=[(c, "ascending") for c in dict.fromkeys([by, "_cell", t, *tie])], null_placement="at_start")
            d = d.take(order).combine_chunks()
            moved = lambda c: np.diff(d[c].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(), prepend=-1) != 0
            first = moved(by) | moved("_cell")
            heads = np.flatnonzero(first | moved(t))
            cell = np.cumsum(first)[heads]
            last = np.zeros(len(first), bool)
            last[heads[np.append(cell[1:] != cell[:-1], True)]] = True
            return d.append_column("_first", pa.array(first)).append_column("_last", pa.array(last)).to_batches()

        held, n = [], 0
        for b in batches:
            if b.num_rows:
                held, n = [*held, b], n + b.num_rows
            if n >= MARK_ROWS:
                yield from done(held)
                held, n = [], 0
        if held:
            yield from done(held)

    return mark


def nearest_cell(rows: int, span: int, tolerance: int) -> int:
    """Cell for ``monitor_rows`` in microseconds, ``rows`` being those of the busiest key over ``span``: a cell then has about as many rows as there are ends in reach."""
    return int(min(max((4 * tolerance * span / max(rows, 1)) ** 0.5, 1000), 4 * tolerance))


def monitor_rows(
    predictions: DataFrame, actuals: DataFrame, by: str, ts: str, actual_ts: str, after: str, tolerance: str, late: str, nearest: Sequence[str] | None = None, cell: int | None = None
) -> DataFrame:
    """ST8: every prediction beside each value of its key that came ``after`` later, give or take ``tolerance``.

    A stream-stream outer join in event time with watermarks on both sides: state is kept for the horizon and the lateness only, and
    predictions whose value never came are given with nulls once the watermark has passed their range. The sides meet on the key
    and a stretch of time a little longer than a range, so a row looks at the state of that stretch, not at that of its whole key. A prediction
    lies in the stretch where its range begins; a value is copied to its own and the one before.

    For results that take the value nearest to the horizon (``nearest_value`` with the tie columns ``nearest``), time is cut into cells of ``cell``
    microseconds and pairs that cannot be nearest are not formed: a prediction meets every value of the cell that its horizon lies in, and of each other cell
    in reach the values at its end on this side. So its nearest values always are among those it meets, and it meets one if any is in range. Ends are
    those of the values that one task of a batch holds; a value later than ``late`` may stand at an end of its cell when it is dropped.
    """
    micros = f"unix_micros(timestamp_seconds(0) + interval {tolerance})"
    if nearest is not None:
        if not cell:
            raise ValueError("nearest needs a cell")
        reach = f"cast(ceil({micros} * 5 / 4 / {cell}) as bigint)"  # a quarter more for days of 25 hours
        cell_of = lambda moment: F.expr(f"cast(floor(unix_micros({moment}) / {cell}) as bigint)")
        p = predictions.withWatermark(ts, late).withColumnRenamed(by, "_p").withColumn("_pw", cell_of(f"{ts} + interval {after}"))
        a = actuals.withColumnRenamed(by, "_a").withColumn("_cell", cell_of(actual_ts))
        a = a.repartition("_a", "_cell")
        a = a.mapInArrow(_mark_ends("_a", actual_ts, nearest), T.StructType([*a.schema, T.StructField("_first", T.BooleanType()), T.StructField("_last", T.BooleanType())]))
        none = "cast(array() as array<bigint>)"
        cells = f"concat(array(_cell), if(_first, sequence(_cell - {reach}, _cell - 1), {none}), if(_last, sequence(_cell + 1, _cell + {reach}), {none}))"
        a = a.withWatermark(actual_ts, late).withColumn("_aw", F.explode(F.expr(cells))).drop("_cell", "_first", "_last")
    else:
        stretch = f"greatest({micros} * 9 div 4, 1)"  # a quarter more than the range has room for days of 25 hours
        at = lambda moment: F.expr(f"cast(floor(unix_micros({moment}) / {stretch}) as bigint)")
        p = predictions.withWatermark(ts, late).withColumnRenamed(by, "_p").withColumn("_pw", at(f"{ts} + interval {after} - interval {tolerance}"))
        a = actuals.withWatermark(actual_ts, late).withColumnRenamed(by, "_a").withColumn("_aw", F.explode(F.array(at(actual_ts), at(actual_ts) - 1)))
    reach = F.expr(
        f"_p = _a and _pw = _aw and {actual_ts} >= {ts} + interval {after} - interval {tolerance} and {actual_ts} <= {ts} + interval {after} + interval {tolerance}"
    )
    return p.join(a, reach, "leftOuter").withColumnRenamed("_p", by).drop("_a", "_pw", "_aw")


def nearest_value(rows: DataFrame, keys, ts: str, actual_ts: str, after: str, tie) -> DataFrame:
    """ST8 on the rows a stream left behind: of the values of one prediction the one nearest to its horizon."""
    gap = F.abs(F.unix_micros(actual_ts) - F.unix_micros(F.expr(f"{ts} + interval {after}")))
    return joins.best_match(rows, keys, gap, tie)


def deal_in_periods(df: DataFrame, t: str, period: int, path: str, files: int = 4) -> int:
    """Write a table as files that arrive period by period, ``files`` a period, and return the number of periods.

    One write job a period stands for its arrival; each is spread over ``files`` tasks, and a trigger takes as many files.
    """
    lo, hi = df.agg(F.floor(F.min(t) / period), F.floor(F.max(t) / period)).first()
    for k in range(lo, hi + 1) if lo is not None else ():
        df.filter((F.col(t) >= k * period) & (F.col(t) < (k + 1) * period)).repartition(files).write.mode("append").parquet(path)
    return 0 if lo is None else hi - lo + 1


def state_partitions(spark: SparkSession, rows: int, each: int = 50_000) -> int:
    """Partitions of a stream's state for ``rows`` a trigger: one a core, more where one would hold over ``each`` rows.

    Every partition writes its state files in every trigger, however few rows it has.
    """
    return max(spark.sparkContext.defaultParallelism, -(-rows // each))


def run_to_table(df: DataFrame, path: str, mode: str = "append", partitions: int | None = None) -> str:
    """Run a stream over all that is there and write its output table; ``partitions`` of its state, else the session's shuffle partitions."""
    spark, conf = df.sparkSession, "spark.sql.shuffle.partitions"
    before = spark.conf.get(conf)
    try:
        if partitions is not None:
            spark.conf.set(conf, partitions)  # a stream keeps the settings that it was started with
        q: StreamingQuery = (
            df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True).start()
        )
    finally:
        spark.conf.set(conf, before)
    q.awaitTermination()
    return path


def run_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], spark: SparkSession, name: str, mode: str = "append") -> None:
    """Run a stream over all that is there into a per-batch sink."""
    q = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", scratch_path(spark, name + "-checkpoint")).trigger(availableNow=True).start()
    q.awaitTermination()
