"""Live windows that lose no row: windows close at the watermark, stay open for corrections, and rows beyond that are a second output.

Spark drops rows behind the watermark from its own windowed aggregates. The operators here keep the watermark of the query
but not its mark on the column, so that every row reaches the state, which compares its time with the watermark itself. All they
emit goes into one log of mergeable rows (counts, sums, maxima, intervals):

* ``closed``: a window whose end the watermark has passed,
* ``corrected``: its whole state again, after late rows within the time it is kept,
* ``late``: rows that came after its state was given up, as a summand of their own.

``bucket_table`` and ``session_table`` fold the log, and the windows that are still open in the checkpoint, into what the batch operators
give for all rows received. A log is written per micro-batch and overwritten when a batch is repeated.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldlake.operators import series

# Spark asks a processor for its state in a Python process of the driver that does not see shipped packages
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SUMS = ["sample_count", "threat_count", "metric_sum", "metric_count", "metric_max"]


UNTIMED = -(1 << 63)  # bucket of rows without a time inside the state: its keys are never null
KEY = "__key"  # the keys as one JSON text, for the same reason


def _key(keys: Sequence[str]):
    return F.to_json(F.struct(*[F.col(k) for k in keys])) if keys else F.lit("{}")


def _named(df: DataFrame, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """The keys as columns again, in front."""
    parsed = F.from_json(KEY, T.StructType([T.StructField(k, schema[k].dataType) for k in keys])) if keys else None
    return df.select(*[parsed[k].alias(k) for k in keys], *[c for c in df.columns if c != KEY])


def _top(values):
    """Largest of the values that are neither null nor NaN."""
    return max((x for x in values if x is not None and x == x), default=None)


class Buckets(StatefulProcessor):
    """Sums of one bucket of one key."""

    def __init__(self, columns, size_ms, keep_ms):
        self.columns, self.size_ms, self.keep_ms = columns, size_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", "sample_count bigint, threat_count bigint, metric_sum double, metric_count bigint, metric_max double, revision int")

    def _row(self, key, kind, revision, sums) -> Row:
        return Row(*self.columns)(None if key[0] == UNTIMED else key[0], key[1], kind, revision, *sums)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts, threats, totals, metrics, tops = zip(*[tuple(r[s] for s in SUMS) for r in rows], strict=True)
        sums = (sum(counts), sum(threats), float(sum(x for x in totals if x == x)), sum(metrics), _top(tops))
        if key[0] == UNTIMED:  # rows without a time have no window
            yield self._row(key, "late", 0, sums)
            return
        mark, end = timerValues.getCurrentWatermarkInMs(), int(key[0]) + self.size_ms
        held = self.sums.get()
        if held is None and mark >= end + self.keep_ms:
            yield self._row(key, "late", 0, sums)
            return
        revision = 0
        if held is not None:
            sums = (*(a + b for a, b in zip(sums[:4], held[:4], strict=True)), _top((sums[4], held[4])))
            revision = int(held[5])
        if revision or (held is None and mark >= end):
            revision += 1
            yield self._row(key, "corrected", revision, sums)
        if held is None:
            self.handle.registerTimer(end if mark < end else end + self.keep_ms)
        self.sums.update((*sums, revision))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.sums.get()
        if held is None:
            return
        *sums, revision = held
        end = int(key[0]) + self.size_ms
        if not revision:
            yield self._row(key, "closed", 1, sums)
        if timerValues.getCurrentWatermarkInMs() >= end + self.keep_ms:
            self.sums.clear()
        elif not revision:
            self.sums.update((*sums, 1))
            self.handle.registerTimer(end + self.keep_ms)

    def close(self) -> None:
        pass


TOGETHER = 1 << 19  # rows of a task that are summed or joined at once


def _gathered(batches):
    """Batches as tables of about ``TOGETHER`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= TOGETHER:
            yield pa.Table.from_batches(held)
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def _summed(batches):
    names = ["bucket_epoch_ms", KEY]
    for table in _gathered(batches):
        out = table.group_by(names, use_threads=False).aggregate(
            [("one", "sum"), ("threat", "sum"), ("metric", "sum"), ("metric", "count"), ("metric", "max")])
        out = out.select([*names, "one_sum", "threat_sum", "metric_sum", "metric_count", "metric_max"]).rename_columns([*names, *SUMS])
        yield from out.set_column(4, "metric_sum", out["metric_sum"].fill_null(0.0)).to_batches()


def bucket_log(stream: DataFrame, time: str = "ts", size_ms: int = 3_600_000, delay: str = "2 hours", keep_ms: int = 0, keys: Sequence[str] = (),
               metric: str = "confidence", threat=None) -> DataFrame:
    """Log of tumbling buckets per key: ``bucket_epoch_ms``, keys, ``kind``, ``revision``, sums and maximum of ``metric``.

    ``keep_ms`` is how long, in event time after its end, a bucket is held for corrections. Rows are summed in the task that reads them
    before they are shuffled, so a hot key or hour costs a row per ``TOGETHER`` rows. Rows without a time form a bucket null.
    """
    threat = F.col("category") == "immediate_threat" if threat is None else threat
    at = F.unix_millis(time)
    rows = stream.withWatermark(time, delay).select(
        F.coalesce(at - F.pmod(at, F.lit(size_ms)), F.lit(UNTIMED)).alias("bucket_epoch_ms"), _key(keys).alias(KEY), F.lit(1).cast("long").alias("one"), F.coalesce(threat, F.lit(False)).cast("long").alias("threat"),
        F.col(metric).cast("double").alias("metric"))
    long, real = T.LongType(), T.DoubleType()
    names = [T.StructField("bucket_epoch_ms", long), T.StructField(KEY, T.StringType())]
    sums = [T.StructField(n, t) for n, t in zip(SUMS, (long, long, real, long, real), strict=True)]
    partial = rows.mapInArrow(_summed, T.StructType([*names, *sums]))
    schema = T.StructType([*names, T.StructField("kind", T.StringType()), T.StructField("revision", T.IntegerType()), *sums])
    out = partial.groupBy("bucket_epoch_ms", KEY).transformWithState(
        statefulProcessor=Buckets(schema.fieldNames(), size_ms, keep_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return _named(out, stream.schema, keys)


INTERVAL = ["start_ms", "end_ms", "confidence", "window_count"]


def joined(pdf: pd.DataFrame, keys: Sequence[str], gap_ms: int) -> pd.DataFrame:
    """Intervals of one key no more than ``gap_ms`` apart as one."""
    if pdf.empty:
        return pdf
    pdf = pdf.sort_values([*keys, "start_ms"], kind="mergesort").reset_index(drop=True)
    groups = [pdf[k] for k in keys]
    reach = pdf.groupby(groups, dropna=False)["end_ms"].cummax() if keys else pdf["end_ms"].cummax()
    same = pd.concat([g.eq(g.shift()) | (g.isna() & g.shift().isna()) for g in groups], axis=1).all(axis=1) if keys else pd.Series(True, pdf.index)
    same.iloc[0] = False
    island = (~same | (pdf["start_ms"] - gap_ms > reach.shift())).cumsum()
    return pdf.groupby(island).agg({**dict.fromkeys(keys, "first"), "start_ms": "min", "end_ms": "max", "confidence": "max", "window_count": "sum"})


def _merged(intervals, gap_ms: int) -> list[list]:
    """What ``joined`` gives for the intervals of one key, by start."""
    out = []
    for start, end, confidence, n in sorted(intervals, key=lambda i: i[0]):
        if out and start - gap_ms <= out[-1][1]:
            out[-1][1:] = max(out[-1][1], end), _top((out[-1][2], confidence)), out[-1][3] + n
        else:
            out.append([start, end, _top((confidence,)), n])
    return out


class Sessions(StatefulProcessor):
    """Open intervals of one key, by start."""

    def __init__(self, columns, gap_ms):
        self.columns, self.gap_ms = columns, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "start_ms bigint", "end_ms bigint, confidence double, window_count bigint")

    def _held(self) -> dict[int, tuple]:
        return {s[0]: tuple(v) for s, v in self.open.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held, mark = self._held(), timerValues.getCurrentWatermarkInMs()
        now = _merged([*((s, *v) for s, v in held.items()), *(tuple(r[c] for c in INTERVAL) for r in rows)], self.gap_ms)
        still = {start: tuple(rest) for start, *rest in now if rest[0] + self.gap_ms >= mark}
        for start in held.keys() - still.keys():
            self.open.removeKey((start,))
        for start, value in still.items():
            if held.get(start) != value:
                self.open.updateValue((start,), value)
                self.handle.registerTimer(value[0] + self.gap_ms + 1)
        for start, *rest in now:
            if start not in still:
                yield Row(*self.columns)(*key, start, *rest)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        for start, value in self._held().items():
            if value[0] + self.gap_ms < mark:
                self.open.removeKey((start,))
                yield Row(*self.columns)(*key, start, *value)

    def close(self) -> None:
        pass


def session_log(stream: DataFrame, keys: Sequence[str], seg_ms: int, gap_ms: int, time: str = "ts", delay: str = "1 hour", confidence: str = "confidence") -> DataFrame:
    """Log of sessions: keys, ``start_ms``, ``end_ms``, ``confidence`` (highest) and ``window_count``. A session is written when the
    watermark has passed its gap; a row that arrives later is a session of its own until ``session_table`` joins them.

    Rows are joined in the task that reads them before they are shuffled. Rows without a time belong to no session.
    """
    at = F.unix_millis(time)
    rows = stream.withWatermark(time, delay).select(_key(keys).alias(KEY), at.alias("start_ms"), (at + seg_ms).alias("end_ms"), F.col(confidence).cast("double").alias("confidence"),
                                                    F.lit(1).cast("long").alias("window_count")).filter("start_ms is not null")
    long = T.LongType()
    schema = T.StructType([T.StructField(KEY, T.StringType()), T.StructField("start_ms", long), T.StructField("end_ms", long), T.StructField("confidence", T.DoubleType()),
                           T.StructField("window_count", long)])

    def partial(batches):
        for table in _gathered(batches):
            found = joined(table.to_pandas(), [KEY], gap_ms)[schema.fieldNames()]
            yield from pa.Table.from_pandas(found, preserve_index=False).cast(table.schema).to_batches()

    out = rows.mapInArrow(partial, schema).groupBy(KEY).transformWithState(
        statefulProcessor=Sessions(schema.fieldNames(), gap_ms), outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return _named(out, stream.schema, keys)


PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def start_log(log: DataFrame, path: str, checkpoint: str, **trigger):
    """Write a log as ``<path>/batch=<n>``; a repeated batch replaces what it wrote before. The state store is RocksDB, which timers need."""
    spark = log.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # a query keeps the settings it was started with

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")
    try:
        return log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(PROVIDER, before)


def open_buckets(log: DataFrame, checkpoint: str, keys: Sequence[str] = ()) -> DataFrame:
    """Buckets that the watermark has not closed, from the checkpoint of the stream that writes ``log``."""
    state = log.sparkSession.read.format("statestore").option("stateVarName", "sums").load(checkpoint)
    return _named(state.filter("value.revision = 0").select("key.*", F.lit("open").alias("kind"), "value.*"), log.schema, keys)


def open_sessions(log: DataFrame, checkpoint: str, keys: Sequence[str]) -> DataFrame:
    """Sessions that may still grow, from the checkpoint of the stream that writes ``log``."""
    state = log.sparkSession.read.format("statestore").option("stateVarName", "open").load(checkpoint)
    return _named(state.select("key.*", "user_map_key.*", "user_map_value.*"), log.schema, keys)


def bucket_table(log: DataFrame, keys: Sequence[str] = (), metric: str = "confidence", still_open: DataFrame | None = None) -> DataFrame:
    """One row per bucket and key: the last revision plus all late summands; with ``still_open`` also those not closed yet."""
    named = ["bucket_epoch_ms", *keys]
    rows = log.select(*named, "kind", "revision", *SUMS)
    if still_open is not None:
        rows = rows.unionByName(still_open.select(*named, "kind", "revision", *SUMS))
    held, late = F.max_by(F.struct(*SUMS), F.when(F.col("kind") != "late", F.col("revision"))), F.col("kind") == "late"
    out = rows.groupBy(*named).agg(held.alias("held"), *[(F.max if s == "metric_max" else F.sum)(F.when(late, F.col(s))).alias(s) for s in SUMS])
    whole = {s: F.coalesce(F.col(f"held.{s}") + F.col(s), F.col(f"held.{s}"), F.col(s)) for s in SUMS[:4]}
    return (out.withColumns({**whole, "metric_max": F.greatest("held.metric_max", "metric_max")})
            .select(*named, "sample_count", "threat_count", (F.col("metric_sum") / F.nullif("metric_count", F.lit(0))).alias(f"{metric}_avg"), F.col("metric_max").alias(f"{metric}_max")))


def session_table(log: DataFrame, keys: Sequence[str], gap_ms: int, still_open: DataFrame | None = None, **kw) -> DataFrame:
    """Sessions of all rows of the log: those that late rows have brought within the gap are one."""
    columns = [*keys, *INTERVAL]
    rows = log.select(*columns) if still_open is None else log.select(*columns).unionByName(still_open.select(*columns))
    marked = series.islands(rows, keys, "start_ms", "end_ms", gap_ms, "end_ms", **kw)
    return (marked.groupBy(*keys, "island_start").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("confidence").alias("confidence"),
                                                      F.sum("window_count").alias("window_count")).drop("island_start"))
