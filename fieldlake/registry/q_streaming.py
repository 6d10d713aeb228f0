"""Streaming queries drained with availableNow over the whole event table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldlake.registry.core import query, rounded
from fieldlake.registry.views import table, view
from fieldlake.schemas import KEYS
from fieldlake.session import shared_folder
from fieldlake.sources.indexed import IndexedTable
from fieldlake.streaming import jobs, late


def _drain(stream, name):
    """Run a stream to its end into Parquet under the session's checkpoint folder and read it back."""
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/fieldlake-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("live_buckets", """
select (detected_epoch_ms // 3600000) * 3600000 as bucket_epoch_ms, count(*) as sample_count, count(*) filter (category = 'immediate_threat') as threat_count, round(avg(confidence), 4) as confidence_avg
from v_detections where (detected_epoch_ms // 3600000) * 3600000 + 3600000 <= (select max(epoch_us(ts) // 1000) from events) - 7200000 group by 1""")
def _(spark, sf):
    """Hours the watermark has closed; the last two hours of the data stay open."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    stream = events.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("value") - F.floor("value")).alias("confidence"),
                           F.when(F.col("event_type").isin("error", "purchase"), "immediate_threat").otherwise("other").alias("category"))
    out = _drain(jobs.live_buckets(stream), "buckets")
    return rounded(out.drop("confidence_max"), "confidence_avg")


def _folder(spark, name):
    return f"{shared_folder(spark)}/fieldlake-{name}-{uuid.uuid4().hex}"


def _received(spark, sf, name, log_of):
    """Log and checkpoint of the detections in five arrivals: every seventh row comes a quarter late, every eleventh at the very end.

    Each arrival, however many files it has, is drained by a run of the stream that goes on from the checkpoint of the run before.
    """
    df = view(spark, sf, "v_detections").select("id", "device_id", "class_name", "category", "confidence", F.timestamp_millis("detected_epoch_ms").alias("ts"))
    low, high = df.agg(F.min(F.unix_millis("ts")), F.max(F.unix_millis("ts"))).first()
    turn = F.floor((F.unix_millis("ts") - low) * 4 / (high - low + 1)).cast("int")
    turn = F.when(F.col("id") % 11 == 0, 4).when(F.col("id") % 7 == 0, turn + 1).otherwise(turn)
    folder = _folder(spark, name)
    path, checkpoint = f"{folder}/log", f"{folder}/cp"
    for k in range(5):
        df.filter(turn == k).write.mode("append").parquet(f"{folder}/in")
        late.start_log(log_of(spark.readStream.schema(df.schema).parquet(f"{folder}/in")), path, checkpoint).awaitTermination()
    return spark.read.parquet(path), checkpoint


@query("late_buckets", """
select (detected_epoch_ms // 3600000) * 3600000 as bucket_epoch_ms, device_id, count(*) as sample_count, count(*) filter (category = 'immediate_threat') as threat_count,
  round(avg(confidence), 4) as confidence_avg, round(max(confidence), 4) as confidence_max from v_detections group by 1, 2""")
def _(spark, sf):
    """Hourly statistics of a stream with late rows: closed and corrected hours, late summands and open hours."""
    log, checkpoint = _received(spark, sf, "late-buckets", lambda stream: late.bucket_log(stream, keep_ms=86_400_000, keys=["device_id"]))
    out = late.bucket_table(log, ["device_id"], still_open=late.open_buckets(log, checkpoint, ["device_id"]))
    return rounded(out, "confidence_avg", "confidence_max")


@query("late_sessions", """
with s as (select *, max(detected_epoch_ms + 600000) over (partition by device_id, class_name order by detected_epoch_ms, id rows between unbounded preceding and 1 preceding) as reach from v_detections),
i as (select *, sum(case when reach is null or detected_epoch_ms - 3000000 > reach then 1 else 0 end) over (partition by device_id, class_name order by detected_epoch_ms, id) as island from s)
select device_id, class_name, min(detected_epoch_ms) as start_ms, max(detected_epoch_ms) + 600000 as end_ms, round(max(confidence), 4) as confidence, count(*) as window_count from i group by device_id, class_name, island""")
def _(spark, sf):
    """Sound windows joined to events from the same stream; late windows join events that were closed."""
    keys = ["device_id", "class_name"]
    log, checkpoint = _received(spark, sf, "late-sessions", lambda stream: late.session_log(stream, keys, 600_000, 3_000_000))
    return rounded(late.session_table(log, keys, 3_000_000, late.open_sessions(log, checkpoint, keys)), "confidence")


@query("ingest_quarantine", """
with m as (select *, event_id % 20 as x from events),
k as (select case when x in (1, 2, 3) then 'unreadable' else 'acoustic' end as kind, x, event_id // 2 as key, (value % 10) / 8 > 1 as bad from m where x <> 19),
c as (select kind, count(*) as received, count(distinct case when kind = 'acoustic' and not bad then key end) as stored, count(*) filter (kind = 'unreadable' or bad) as failed from k group by 1)
select *, received - stored - failed as duplicate from c
union all select kind, 0, 0, 0, 0 from (values ('gps'), ('environmental'), ('vision')) t(kind)""")
def _(spark, sf):
    """Broken, unknown, rejected and repeated messages made from every event: what was received is stored, a duplicate or failed."""
    body = F.to_json(F.struct(F.when(F.col("x") == 2, "sonar").otherwise("acoustic").alias("reading_type"), F.lit("s").alias("sensor_id"),
                              F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"),
                              F.lit("gunshot").alias("class_name"), F.lit("immediate_threat").alias("category"), ((F.col("value") % 10) / 8).alias("confidence"),
                              (F.floor(F.col("event_id") / 2) + 1).alias("source_record_id")))
    lines = table(spark, sf, "events").withColumn("x", F.col("event_id") % 20).select(
        F.when(F.col("x") == 1, F.substring(body, 1, 40)).when(F.col("x") == 3, F.replace(body, F.lit('"latitude":1.0'), F.lit('"latitude":"north"')))
        .when(F.col("x") == 19, "").otherwise(body).alias("value"))
    folder = _folder(spark, "ingest")
    tables = {kind: IndexedTable(spark, f"{folder}/{kind}", KEYS[name]) for kind, name in jobs.TABLE_OF.items()}
    counters = jobs.ingest_batch(lines, tables, 4_000_000_000_000, cells=False, quarantine=f"{folder}/quarantine")
    # the counters are held against the tables themselves
    failed = spark.read.parquet(f"{folder}/quarantine").groupBy("kind").agg(F.count(F.lit(1)).alias("failed"))
    told = spark.createDataFrame([(k, c["received"], c["duplicate"]) for k, c in counters.items()], "kind string, received long, duplicate long")
    have = [(k, t.read()) for k, t in tables.items()]
    stored = spark.createDataFrame([(k, df.count()) for k, df in have if df is not None], "kind string, stored long")
    return told.join(stored, "kind", "left").join(failed, "kind", "left").fillna(0, ["stored", "failed"])


@query("indexed_upsert", """
with n as (select l_orderkey as k, max(l_quantity) as v from lineitem where l_orderkey % 50 = 7 group by 1)
select o_orderkey, round(coalesce(n.v, o_totalprice), 2) as v from orders left join n on n.k = o_orderkey
union all select k, round(v, 2) from n where k not in (select o_orderkey from orders)""")
def _(spark, sf):
    """Newest rows into a table of indexed files, which rewrites only the files that hold them."""
    target = IndexedTable(spark, _folder(spark, "upsert"), ["o_orderkey"])
    target.append_new(table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v")))
    new = table(spark, sf, "lineitem").filter("l_orderkey % 50 = 7").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").cast("double").alias("v"))
    target.upsert(new, ["v"])
    return rounded(target.read(), "v", digits=2)
