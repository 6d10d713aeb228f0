"""Streams replayed with availableNow must give what the batch operators give."""

import json
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.operators import series, tracking
from fieldlake.registry.views import view
from fieldlake.schemas import KEYS
from fieldlake.sources import sinks
from fieldlake.sources.indexed import IndexedTable
from fieldlake.streaming import jobs, late, state
from fieldlake.streaming.state import accepted
from fieldlake.streaming.state import moments_before as state_moments


@pytest.fixture(scope="module")
def feed(spark, sf, tmp_path_factory):
    """The stand-in readings as time-ordered files, one micro-batch each."""

    def make(name, df, time, parts=3):
        path = str(tmp_path_factory.mktemp(name))
        lo, hi = df.agg(F.min(time), F.max(time)).first()
        step = (hi - lo) // parts + 1
        for i in range(parts):
            df.filter((F.col(time) >= lo + i * step) & (F.col(time) < lo + (i + 1) * step)).coalesce(1).write.mode("append").parquet(path)
        make.path = path
        return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)
    return make


def drain(df, name, tmp_path, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_speed_verdicts(spark, sf, feed, tmp_path):
    df = view(spark, sf, "v_telemetry").select("id", "animal_id", "recorded_epoch_ms", "latitude", "longitude", "altitude").withColumn("max_speed", F.lit(0.4)).cache()
    batch = {r["id"]: r["validation_status"] for r in tracking.speed_verdicts(df).collect()}
    live = {r["id"]: r["validation_status"] for r in drain(state.speed_verdicts(feed("fixes", df, "recorded_epoch_ms")), "verdicts", tmp_path).collect()}
    assert batch == live and set(batch.values()) == {"VALID_FIX", "EXCEEDED_SPEED_THRESHOLD"}
    # a plain loop over the definition
    rows = tracking.with_ecef(df).orderBy("animal_id", "recorded_epoch_ms", "id").collect()
    last, want = {}, {}
    for r in rows:
        prev = last.get(r["animal_id"])
        ok = True
        if prev and r["recorded_epoch_ms"] > prev[0]:
            chord = np.linalg.norm(np.array([r["ecef_x"], r["ecef_y"], r["ecef_z"]]) - prev[1])
            ok = 3.6 * chord / ((r["recorded_epoch_ms"] - prev[0]) / 1000) <= 0.4
        want[r["id"]] = "VALID_FIX" if ok else "EXCEEDED_SPEED_THRESHOLD"
        if ok:
            last[r["animal_id"]] = (r["recorded_epoch_ms"], np.array([r["ecef_x"], r["ecef_y"], r["ecef_z"]]))
    assert batch == want
    split = {r["id"]: r["validation_status"] for r in tracking.speed_verdicts(df.withColumn("animal_id", F.lit("one")), split=True, min_rows=100, chunks=4).collect()}
    whole = {r["id"]: r["validation_status"] for r in tracking.speed_verdicts(df.withColumn("animal_id", F.lit("one"))).collect()}
    assert split == whole


def test_filters_and_stress(spark, sf, feed, tmp_path):
    df = view(spark, sf, "v_sensor_readings").select("id", "device_id", F.col("h3_cell").alias("location_id"), "recorded_epoch_ms", F.col("ambient_temperature_c").alias("temperature"),
                                                     F.col("relative_humidity_percent").alias("humidity")).cache()
    clean = series.hampel(df.select("id", "device_id", "recorded_epoch_ms", "temperature"), ["device_id"], "temperature")
    batch = {r["id"]: r["temperature_hampel_ema"] for r in series.ema(clean, ["device_id"], "temperature_hampel", 0.1).collect()}
    live = {r["id"]: r["temperature_filtered"] for r in drain(state.filter_stream(feed("env", df, "recorded_epoch_ms"), ["temperature", "humidity"]), "smooth", tmp_path).collect()}
    assert batch.keys() == live.keys() and all(abs(batch[k] - live[k]) < 1e-9 for k in batch)
    flags = series.stress_flags(df.withColumn("at", F.timestamp_millis("recorded_epoch_ms")), ["temperature", "humidity"], "location_id", "at")
    batch = {r["id"]: r["triggered_metrics"] for r in flags.collect()}
    live = {r["id"]: r["triggered_metrics"] for r in drain(state.stress_stream(feed("env2", df, "recorded_epoch_ms"), ["temperature", "humidity"]), "stress", tmp_path).collect()}
    assert batch == live and sum(batch.values()) > 0


def test_throttles(spark, sf, feed, tmp_path):
    df = view(spark, sf, "v_detections").selectExpr("id", "id as event_id", "detected_epoch_ms as ts_ms", "'t' as event_type", "class_name as classification",
                                                    "device_id as zone", "if(id % 9 = 0, 'CRITICAL', 'HIGH') as priority").cache()
    keys = ["event_type", "classification", "zone"]
    batch = {r["id"] for r in series.suppress_alerts(df, window_ms=20_000_000).collect()}
    live = drain(state.throttle(feed("alerts", df, "ts_ms"), keys, 20_000_000, sliding=True, top="CRITICAL"), "calm", tmp_path)
    assert batch == {r["id"] for r in live.filter("accepted").collect()} and len(batch) < df.count()
    batch = {r["id"]: r["accepted"] for r in series.cooldown(df, keys, window_ms=40_000_000).collect()}
    live = drain(state.throttle(feed("alerts2", df, "ts_ms"), keys, 40_000_000), "cool", tmp_path)
    assert batch == {r["id"]: r["accepted"] for r in live.collect()}


def test_audio_buffers(spark, tmp_path):
    rng = np.random.default_rng(1)
    chunks = [("m", i, 1000 if i < 3 else 9000, i == 3, rng.random(7).tolist()) for i in range(6)]
    path = str(tmp_path / "chunks")
    schema = "source_id string, chunk int, origin_ms long, discontinuity boolean, samples array<double>"
    for c in chunks:
        spark.createDataFrame([c], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "2").parquet(path)
    got = {r["window_index"]: r for r in drain(state.audio_windows(stream, 6, 4, 10), "audio", tmp_path).collect()}
    before, after = np.concatenate([c[4] for c in chunks[:3]]), np.concatenate([c[4] for c in chunks[3:]])
    starts = [s for s in range(0, 21 - 5, 4)]
    assert [got[i]["start_sample"] for i in range(len(got))] == starts * 2
    assert got[1]["window_ms"] == 1000 + 400 and got[len(starts)]["window_ms"] == 9000
    assert np.allclose(got[1]["samples"], before[4:10]) and np.allclose(got[len(starts) + 1]["samples"], after[4:10])


def test_sessions_and_buckets(spark, sf, feed, tmp_path):
    df = view(spark, sf, "v_detections").withColumn("ts", F.timestamp_millis("detected_epoch_ms")).select("id", "device_id", "class_name", "category", "confidence", "ts", "detected_epoch_ms").cache()
    # a far later row closes every session and bucket
    end = df.limit(1).withColumn("ts", F.expr("timestamp'2030-01-01'")).withColumn("detected_epoch_ms", F.lit(1893456000000)).withColumn("device_id", F.lit("end")).withColumn("class_name", F.lit("end"))
    stream = feed("sound", df, "detected_epoch_ms")
    end.coalesce(1).write.mode("append").parquet(feed.path)
    batch = series.debounce_events(df, ["device_id", "class_name"], 600_000, 3_000_000).select("device_id", "class_name", "start_ms", "end_ms", "window_count")
    live = drain(jobs.session_events(stream, ["device_id", "class_name"], 600_000, 3_000_000), "sessions", tmp_path).filter("device_id <> 'end'")
    assert sorted(map(tuple, batch.collect())) == sorted(tuple(r) for r in live.select(batch.columns).collect())
    buckets = drain(jobs.live_buckets(stream), "buckets", tmp_path).filter("bucket_epoch_ms < 1893456000000")
    want = df.groupBy((F.col("detected_epoch_ms") - F.col("detected_epoch_ms") % 3_600_000).alias("b")).count()
    assert {r["bucket_epoch_ms"]: r["sample_count"] for r in buckets.collect()} == {r["b"]: r["count"] for r in want.collect()}


def test_ingest_is_idempotent(spark, tmp_path):
    base = {"sensor_id": "s", "latitude": 1.0, "longitude": 2.0}
    lines = [{**base, "reading_type": "environmental", "timestamp": f"2024-01-02T0{i}:00:00Z", "sensor_mac": "AA:BB:CC:DD:EE:FF", "measurements": {"ambient_temperature_c": 20.0 + i}} for i in range(3)]
    lines.append({**lines[0]})
    lines.append({**base, "reading_type": "environmental", "timestamp": "2024-01-02T09:00:00Z", "sensor_mac": "nope", "measurements": {"ambient_temperature_c": 20.0}})
    lines.append({**base, "reading_type": "acoustic", "timestamp": "2024-01-02T00:00:00Z", "class_name": "gunshot", "category": "immediate_threat", "confidence": 0.93})
    lines.append({**base, "reading_type": "gps", "timestamp": "2024-01-02T00:00:00Z", "species_id": 1, "animal_id": "a", "fix_quality": "4D"})
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join(map(json.dumps, lines)))
    tables = {k: sinks.ParquetTable(spark, str(tmp_path / k)) for k in ("gps", "environmental", "acoustic", "vision")}
    seen = []
    stream = spark.readStream.schema("value string").text(str(folder))
    query = jobs.start_ingest(stream, tables, str(tmp_path / "cp"), lambda: 1_800_000_000_000, seen.append)
    assert query.awaitTermination(120)
    assert seen[0]["environmental"] == {"received": 5, "stored": 3, "duplicate": 1, "failed": 1}
    assert seen[0]["gps"]["failed"] == 1 and seen[0]["acoustic"]["stored"] == 1 and seen[0]["unreadable"]["received"] == 0
    again = jobs.ingest_batch(spark.read.text(str(folder)), tables, 1_800_000_000_000)
    assert again["environmental"]["stored"] == 0 and tables["environmental"].read().count() == 3
    threats = jobs.threat_stream(tables["acoustic"].read().withColumn("id", F.lit(1)))
    assert threats.first()["priority"] == "CRITICAL" and threats.first()["event_type"] == "acoustic_anomaly"


def test_fan_out_and_discovery(spark, tmp_path):
    path = str(tmp_path / "alerts")
    schema = "event_id string, ts_ms long, priority string, event_type string, classification string, cri_score double, confidence double, latitude double, longitude double, zone string"
    spark.createDataFrame([("1", 1, "HIGH", "t", "c", None, 0.9, 1.0, 2.0, "872830828ffffff"), ("2", 2, "INFO", "t", "c", None, 0.9, 1.0, 2.0, "Sector_4")], schema).coalesce(1).write.parquet(path)
    subs = spark.createDataFrame([("up", "86283082fffffff", "ROUTINE"), ("all", None, "INFO"), ("named", "Sector_4", "INFO"), ("far", "862830807ffffff", "INFO"), ("strict", None, "CRITICAL")],
                                 "client_id string, zone string, min_priority string")
    out = []
    query = jobs.fan_out_stream(spark.readStream.schema(schema).parquet(path), subs, lambda df: out.extend(df.collect()), str(tmp_path / "cp1"))
    assert query.awaitTermination(120)
    assert {(r["key"], r["client_id"]) for r in out} == {("1", "up"), ("1", "all"), ("2", "all"), ("2", "named")}
    assert json.loads(out[0]["value"])["type"] == "alert"
    folder = tmp_path / "files"
    folder.mkdir()
    for name, body in (("a.bin", "x"), ("b.bin", "x"), ("c.bin", "y")):
        (folder / name).write_text(body)
    ledger, got = sinks.ParquetTable(spark, str(tmp_path / "ledger")), []
    binary = "path string, modificationTime timestamp, length long, content binary"
    for i in (1, 2):
        stream = spark.readStream.format("binaryFile").schema(binary).load(str(folder))
        assert jobs.discover(stream, ledger, lambda df: got.extend(r["path"] for r in df.collect()), str(tmp_path / f"cp-d{i}")).awaitTermination(120)
    assert len(got) == 2
    assert jobs.trigger_options()[1] == {"processingTime": "500 milliseconds"}


def test_no_message_is_lost(spark, tmp_path):
    """Broken, unknown, rejected and repeated messages: every one is stored, a duplicate or in the quarantine with its reason."""
    good = {"sensor_id": "s", "latitude": 1.0, "longitude": 2.0, "reading_type": "acoustic", "class_name": "gunshot", "category": "immediate_threat", "confidence": 0.9}
    lines = [json.dumps({**good, "timestamp": f"2024-01-02T00:00:{i % 20:02d}Z", "source_record_id": i % 20 + 1}) for i in range(30)]
    lines += ["{", "no", json.dumps([{"reading_type": "sonar"}, 3]), json.dumps({**good, "confidence": "x"}), json.dumps({**good, "confidence": 7.0, "timestamp": "2024-01-02T00:00:00Z"}), ""]
    folder = tmp_path / "feed"
    folder.mkdir()
    for k in range(4):
        (folder / f"{k}.json").write_text("\n".join(lines[k::4]))
    tables = {k: IndexedTable(spark, str(tmp_path / k), KEYS[jobs.TABLE_OF[k]]) for k in ("gps", "environmental", "acoustic", "vision")}
    seen = []
    reader, _ = jobs.trigger_options(500, rows_per_file=500)
    stream = spark.readStream.schema("value string").options(**reader).text(str(folder))
    assert jobs.start_ingest(stream, tables, str(tmp_path / "cp"), lambda: 1_800_000_000_000, seen.append, str(tmp_path / "q")).awaitTermination(240)
    assert len(seen) == 4  # one file of at most 500 rows each
    total = {name: sum(c[name] for batch in seen for c in batch.values()) for name in ("received", "stored", "duplicate", "failed")}
    assert total == {"received": 36, "stored": 20, "duplicate": 10, "failed": 6} and tables["acoustic"].read().count() == 20
    lost = spark.read.parquet(str(tmp_path / "q")).collect()
    assert sorted((r["kind"], r["reason"]) for r in lost) == [("acoustic", "confidence"), ("unreadable", "field_type"), ("unreadable", "not_an_object"), ("unreadable", "not_json"),
                                                              ("unreadable", "not_json"), ("unreadable", "unknown_type")]


@pytest.fixture(scope="module")
def late_feed(spark, sf, tmp_path_factory):
    """Events in five files by time, where every seventh row comes one file late and every eleventh in the last one; some have no time."""
    df = view(spark, sf, "v_detections").withColumn("ts", F.when(F.col("id") % 101 != 0, F.timestamp_millis("detected_epoch_ms"))).select(
        "id", F.when(F.col("id") % 9 != 0, F.col("device_id")).alias("device_id"), "class_name", "category", F.when(F.col("id") % 5 != 0, F.col("confidence")).alias("confidence"),
        "ts", "detected_epoch_ms").cache()
    lo, hi = df.agg(F.min("detected_epoch_ms"), F.max("detected_epoch_ms")).first()
    turn = F.floor((F.col("detected_epoch_ms") - lo) * 5 / (hi - lo + 1)).cast("int")
    turn = F.when(F.col("id") % 11 == 0, 4).when(F.col("id") % 7 == 0, F.least(turn + 1, F.lit(4))).otherwise(turn)
    path = str(tmp_path_factory.mktemp("late"))
    for i in range(5):
        df.filter(turn == i).coalesce(1).write.mode("append").parquet(path)
    return df, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(path)


@pytest.mark.parametrize("keep_hours, keys", [(0, []), (30, ["device_id"])])
def test_late_rows_of_buckets(spark, late_feed, tmp_path, keep_hours, keys):
    """Log, late summands and open windows together equal the batch for every row, with and without corrections."""
    df, stream = late_feed
    log = late.bucket_log(stream, keep_ms=keep_hours * 3_600_000, keys=keys)
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    assert late.start_log(log, path, checkpoint).awaitTermination(240)
    rows = spark.read.parquet(path)
    kinds = {r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()}
    assert kinds["closed"] and kinds["late"] and (not keep_hours or kinds["corrected"])
    open_ = late.open_buckets(rows, checkpoint, keys)
    assert open_.count() > 0
    got = late.bucket_table(rows, keys, still_open=open_)
    bucket = F.unix_millis("ts") - F.pmod(F.unix_millis("ts"), F.lit(3_600_000))
    want = df.groupBy(bucket.alias("bucket_epoch_ms"), *keys).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count(F.when(F.col("category") == "immediate_threat", 1)).alias("threat_count"),
        F.avg("confidence").alias("confidence_avg"), F.max("confidence").alias("confidence_max"))
    shown = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=str)
    assert shown(got) == shown(want)
    # a repeated batch replaces its rows
    last = max(int(p.split("=")[1]) for p in {str(x).rsplit("/", 2)[-2] for x in rows.inputFiles()})
    before = rows.count()
    again = rows.filter(F.col("batch") == last).drop("batch").collect()
    spark.createDataFrame(again, rows.drop("batch").schema).write.mode("overwrite").parquet(f"{path}/batch={last}")
    assert spark.read.parquet(path).count() == before


def test_late_rows_of_sessions(spark, late_feed, tmp_path):
    df, stream = late_feed
    keys, seg, gap = ["device_id", "class_name"], 600_000, 3_000_000
    log = late.session_log(stream, keys, seg, gap)
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    assert late.start_log(log, path, checkpoint).awaitTermination(240)
    rows = spark.read.parquet(path)
    got = late.session_table(rows, keys, gap, late.open_sessions(rows, checkpoint, keys))
    want = series.debounce_events(df.filter("ts is not null"), keys, seg, gap).select(got.columns)
    shown = lambda d: sorted(map(tuple, d.collect()), key=str)
    assert shown(got) == shown(want)
    native = drain(jobs.session_events(stream, keys, seg, gap), "native", tmp_path)
    assert native.agg(F.sum("window_count")).first()[0] < got.agg(F.sum("window_count")).first()[0]  # Spark's own windows drop late rows


def test_state_by_arrays_is_that_of_single_steps():
    """The vectorised state updates against plain loops, over all ways to cut the rows into batches."""
    from fieldlake.operators.tracking import judge
    r = np.random.default_rng(2)
    for _ in range(200):
        n = int(r.integers(1, 40))
        x = np.round(r.normal(20, 5, n), 1)
        state, got_mean, got_std = (0, 0.0, 0.0), [], []
        for part in np.array_split(x, int(r.integers(1, 4))):
            if len(part):
                mean, std, state = state_moments(part, state)
                got_mean += mean.tolist()
                got_std += std.tolist()
        for k in range(1, n):
            assert abs(got_mean[k] - x[:k].mean()) < 1e-9 and abs(got_std[k] - (x[:k].std(ddof=1) if k > 1 else 0.0)) < 1e-7
        # throttles
        times, window = np.sort(r.integers(0, 100, n)) if r.random() < 0.7 else r.integers(0, 100, n), int(r.integers(1, 30))
        for sliding in (True, False):
            last, keep, want, ref = None, [], [], None
            for part in np.array_split(times, int(r.integers(1, 4))):
                got, last = accepted(part, last, window, sliding)
                keep += got.tolist()
            for at in times:
                ok = ref is None or at - ref >= window
                want.append(bool(ok))
                if ok or sliding:
                    ref = int(at)
            assert keep == want
        # verdicts
        t = np.cumsum(r.integers(-2, 6, n)) * 1000
        xyz, limit, usable = r.normal(0, 30, (3, n)), r.uniform(5, 60, n), r.random(n) < 0.9
        last, got, want, ref = None, [], [], None
        for part in np.array_split(np.arange(n), int(r.integers(1, 4))):
            fast, last = judge(t[part], *(v[part] for v in xyz), limit[part], usable[part], last)
            got += fast.tolist()
        for i in range(n):
            fast = False
            if usable[i]:
                step = None if ref is None else (t[i] - ref[0]) / 1000
                fast = step is not None and step > 0 and 3.6 * float(np.linalg.norm(xyz[:, i] - ref[1])) / step > limit[i]
                if not fast and (step is None or step >= 0):
                    ref = (t[i], xyz[:, i])
            want.append(bool(fast))
        assert got == want


def test_silent_state_expires(spark, tmp_path):
    """The state of a key goes when the watermark has left its last row behind by the time to live; a key that is heard stays."""
    path, schema = str(tmp_path / "in"), "id long, kind string, priority string, ts_ms long"
    hour = 3_600_000
    for rows in ([(1, "a", "LOW", 0), (2, "b", "LOW", 0)], [(3, "b", "LOW", 4 * hour)], [(4, "b", "LOW", 9 * hour)], [(5, "b", "LOW", 10 * hour)], [(6, "a", "LOW", hour)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    answers, left = {}, {}
    for ttl in (None, 5 * hour):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(path)
        got = drain(state.throttle(stream, ["kind"], 3 * hour, ttl_ms=ttl), f"expiry{ttl}", tmp_path)
        answers[ttl] = {r["id"]: r["accepted"] for r in got.collect()}
        held = spark.read.format("statestore").option("stateVarName", "last").load(str(tmp_path / f"expiry{ttl}"))
        left[ttl] = {r["kind"]: r["at"] for r in held.select("key.kind", "value.at").collect()}
    assert answers[None] == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False} and left[None] == {"a": 0, "b": 9 * hour}
    # the state of a was dropped after five hours, so its late row starts anew; it is dropped again at once
    assert answers[5 * hour] == {1: True, 2: True, 3: True, 4: True, 5: False, 6: True} and left[5 * hour] == {"b": 9 * hour}
