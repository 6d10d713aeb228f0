"""Streaming queries: continuous ingest, the alert path, live statistics and discovery."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldlake.operators import alerts, validate
from fieldlake.operators.filters import is_critical
from fieldlake.schemas import KEYS, NULLABLE_KEYS
from fieldlake.sources import readers, sinks

TABLE_OF = {"gps": "telemetry", "environmental": "sensor_readings", "acoustic": "detections", "vision": "detections"}


def trigger_options(batch_rows: int = 500, interval_ms: int = 500, rows_per_file: int = 1) -> tuple[dict, dict]:
    """(reader options, trigger arguments) for micro-batches of at most ``batch_rows`` rows every ``interval_ms``: so many messages of
    a log, or so many files of ``rows_per_file`` rows each."""
    reader = {"maxOffsetsPerTrigger": str(batch_rows), "maxFilesPerTrigger": str(max(batch_rows // rows_per_file, 1))}
    return reader, {"processingTime": f"{interval_ms} milliseconds"}


def with_lateness(stream: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """Event-time bound of Spark's own windows, which drop later rows; ``late.bucket_log`` and ``late.session_log`` keep them."""
    return stream.withWatermark(time, delay)


def checked(parts: dict[str, DataFrame], now_ms) -> dict[str, DataFrame]:
    """Routed rows with their reasons."""
    out = {}
    for kind, rows in parts.items():
        time = "recorded_epoch_ms" if "recorded_epoch_ms" in rows.columns else "detected_epoch_ms"
        late = [("timestamp", F.col(time).isNull()), ("future", F.col(time) > F.lit(now_ms) + 300_000), ("position", validate.bad_position())]
        if kind == "environmental":
            rows = validate.validate(rows, "sensor_readings").withColumn("__unknown", F.size(F.array_except("reported", F.array(*[F.lit(m) for m in validate.MEASUREMENT_RANGES]))) > 0)
            rows = rows.withColumn("reject_reasons", F.concat("reject_reasons", validate.reasons(*late, ("unknown_measurement", F.col("__unknown"))))).drop("__unknown", "reported")
        elif kind == "gps":
            rows = rows.withColumn("reject_reasons", validate.reasons(*late, ("animal_id", F.col("animal_id").isNull()), ("species_id", F.coalesce(F.col("species_id") <= 0, F.lit(True))),
                                                                      ("fix_quality", ~F.col("fix_quality").isin(*validate.FIX_QUALITIES))))
        else:
            rows = validate.validate(rows, "detections")
            rows = rows.withColumn("reject_reasons", F.concat("reject_reasons", validate.reasons(*late)))
        out[kind] = rows
    return out


def ingest_batch(lines: DataFrame, tables: dict[str, sinks.ParquetTable], now_ms, cells: bool = True, quarantine: str | None = None) -> dict[str, dict[str, int]]:
    """One micro-batch: parse, route, validate, insert what is new. Replaying a batch stores nothing twice.

    Every payload is counted once: received = stored + duplicate + failed, by kind, and ``unreadable`` for payloads that cannot be read or
    routed. Failed ones go to ``quarantine`` as Parquet rows (kind, reason, data): a folder that one call replaces as a whole.
    """
    payloads = readers.messages(lines).persist()
    parts = checked(readers.route_ingest(readers.readable(payloads), cells), now_ms)
    lost, seen = payloads.filter("failure is not null"), Observation()
    out = lost.select(F.lit("unreadable").alias("kind"), F.col("failure").alias("reason"), F.col("raw").alias("data")).observe(seen, F.count(F.lit(1)).alias("n"))
    counters, failures, held = {}, [(out, "unreadable", seen)], []
    for kind, rows in parts.items():
        name = TABLE_OF[kind]
        # judged once, then split, stored and counted by the writes themselves
        rows = rows.persist()
        held.append(rows)
        good, bad = validate.split_valid(rows)
        counters[kind] = sinks.append_new(good, tables[kind], KEYS[name], nullable=NULLABLE_KEYS.get(name, ()))
        seen, data = Observation(), [c for c in bad.columns if c != "reject_reasons"]
        failures.append((bad.select(F.lit(kind).alias("kind"), F.array_join("reject_reasons", "; ").alias("reason"), F.to_json(F.struct(*data)).alias("data"))
                         .observe(seen, F.count(F.lit(1)).alias("n")), kind, seen))
    failed = reduce(DataFrame.unionByName, [x for x, _, _ in failures])
    (failed.write.mode("overwrite").parquet(quarantine) if quarantine else failed.write.format("noop").mode("overwrite").save())
    for _, kind, seen in failures:
        done = counters.setdefault(kind, {"received": 0, "stored": 0, "duplicate": 0})
        done["failed"] = seen.get["n"]
        done["received"] += done["failed"]
    for rows in [payloads, *held]:
        rows.unpersist()
    return counters


def start_ingest(lines: DataFrame, tables: dict[str, sinks.ParquetTable], checkpoint: str, now_ms: Callable[[], int],
                 on_batch: Callable[[dict], None] | None = None, quarantine: str | None = None, **trigger):
    """Continuous ingest of a stream of JSON lines (column ``value``); failed payloads of batch n go to ``<quarantine>/batch=<n>``."""
    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        try:
            counters = ingest_batch(batch, tables, now_ms(), quarantine=quarantine and f"{quarantine.rstrip('/')}/batch={n}")
        finally:
            batch.unpersist()
        if on_batch:
            on_batch(counters)
    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def threat_stream(stream: DataFrame) -> DataFrame:
    """Critical rows as top-priority alerts, before anything is stored. Needs no state."""
    flag = "threat_detected" if "threat_detected" in stream.columns else None
    rows = stream.filter(is_critical(flag=flag))
    if "reading_type" not in rows.columns:
        rows = rows.withColumn("reading_type", F.lower("source_type"))
    return alerts.threat_alerts(rows if "zone" in rows.columns else rows.withColumn("zone", F.lit(None).cast("string")))


def fan_out_stream(stream: DataFrame, subscriptions: DataFrame, deliver: Callable[[DataFrame], None], checkpoint: str, **trigger):
    """Alerts to their subscribers, a batch at a time against the current subscription table."""
    def write(batch: DataFrame, _: int) -> None:
        deliver(sinks.alert_frames(alerts.fan_out(batch, subscriptions)))
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_buckets(stream: DataFrame, time: str = "ts", size: str = "1 hour", delay: str = "2 hours", keys=(), metric: str = "confidence") -> DataFrame:
    """Tumbling statistics, emitted when their hour is closed."""
    return (with_lateness(stream, time, delay).groupBy(F.window(time, size), *keys)
            .agg(F.count(F.lit(1)).alias("sample_count"), F.count(F.when(F.col("category") == "immediate_threat", 1)).alias("threat_count"),
                 F.avg(metric).alias(f"{metric}_avg"), F.max(metric).alias(f"{metric}_max"))
            .select(F.unix_millis("window.start").alias("bucket_epoch_ms"), *keys, "sample_count", "threat_count", f"{metric}_avg", f"{metric}_max"))


def session_events(stream: DataFrame, keys, seg_ms: int, gap_ms: int, time: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Sound windows of one length as sessions; a session closes when the watermark passes its gap."""
    gap = f"{seg_ms + gap_ms} milliseconds"
    return (with_lateness(stream, time, delay).groupBy(*keys, F.session_window(time, gap).alias("session"))
            .agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("window_count"), F.min(time).alias("first"), F.max(time).alias("last"))
            .select(*keys, F.unix_millis("first").alias("start_ms"), (F.unix_millis("last") + seg_ms).alias("end_ms"), "confidence", "window_count"))


def dedupe_stream(stream: DataFrame, keys, time: str, delay: str = "1 hour") -> DataFrame:
    """First row per key within the lateness bound, so state does not grow for ever."""
    return with_lateness(stream, time, delay).dropDuplicatesWithinWatermark(list(keys))


def discover(stream: DataFrame, ledger: sinks.ParquetTable, handle: Callable[[DataFrame], None], checkpoint: str, **trigger):
    """Each file content once, whatever its name: a ledger of content hashes beside the source's own checkpoint."""
    def write(batch: DataFrame, _: int) -> None:
        rows = sinks.dedupe(batch.withColumn("source_hash", F.sha2("content", 256)), ["source_hash"], ["path"])
        fresh = sinks.skip_processed(rows, ledger.read()).persist()
        if not fresh.isEmpty():
            handle(fresh)
            ledger.append(fresh.select("source_hash", F.col("path").alias("source_path")))
        fresh.unpersist()
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
