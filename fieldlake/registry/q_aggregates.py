"""Grouped summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.config import DAY_MS, HOUR_MS
from fieldlake.operators import aggregates as agg
from fieldlake.operators import filters
from fieldlake.registry.core import query, rounded
from fieldlake.registry.views import table, view

# January 2024, the month the event table covers
START, MIDDLE, END = 1704067200000, 1705363200000, 1706659200000


@query("bucket_stats_detections_hour", """
select recorded as bucket_epoch_ms, count(*) as sample_count, count(*) filter (category = 'immediate_threat') as threat_count,
  round(avg(confidence), 4) as confidence_avg, round(min(confidence), 4) as confidence_min,
  round(max(confidence), 4) as confidence_max, count(confidence) as confidence_count
from (select *, (detected_epoch_ms // 3600000) * 3600000 as recorded from v_detections) group by 1""")
def _(spark, sf):
    df = agg.bucket_stats(view(spark, sf, "v_detections"), "detections", "hour", ["confidence"])
    return rounded(df, "confidence_avg", "confidence_min", "confidence_max")


@query("bucket_stats_gps_day", """
select (recorded_epoch_ms // 86400000) * 86400000 as bucket_epoch_ms, count(*) as sample_count,
  round(avg(speed_kmh), 4) as speed_kmh_avg, round(min(speed_kmh), 4) as speed_kmh_min, round(max(speed_kmh), 4) as speed_kmh_max,
  count(speed_kmh) as speed_kmh_count, round(avg(altitude), 4) as altitude_avg, round(min(altitude), 4) as altitude_min,
  round(max(altitude), 4) as altitude_max, count(altitude) as altitude_count
from v_telemetry group by 1""")
def _(spark, sf):
    df = agg.bucket_stats(view(spark, sf, "v_telemetry"), "gps", "day", ["speed_kmh", "altitude"])
    return rounded(df, *[f"{m}_{k}" for m in ("speed_kmh", "altitude") for k in ("avg", "min", "max")])


@query("bucket_stats_environment_week", """
select h3_cell, ((recorded_epoch_ms - 345600000) // 604800000) * 604800000 + 345600000 as bucket_epoch_ms, count(*) as sample_count,
  round(avg(relative_humidity_percent), 4) as relative_humidity_percent_avg, min(relative_humidity_percent) as relative_humidity_percent_min,
  max(relative_humidity_percent) as relative_humidity_percent_max, count(relative_humidity_percent) as relative_humidity_percent_count
from v_sensor_readings where quality_flag <> 'INVALID' group by 1, 2""")
def _(spark, sf):
    df = filters.valid_readings(view(spark, sf, "v_sensor_readings"))
    return rounded(agg.bucket_stats(df, "environmental", "week", ["relative_humidity_percent"], keys=["h3_cell"]),
                   "relative_humidity_percent_avg")


@query("detection_summary", f"""
select count(*) as total_detections, count(*) filter (category = 'target_wildlife') as wildlife_sightings,
  count(*) filter (category = 'immediate_threat') as threat_alerts, count(distinct species_id) as species_detected
from v_detections where detected_epoch_ms >= {MIDDLE} and detected_epoch_ms < {END}""")
def _(spark, sf):
    return agg.detection_summary(view(spark, sf, "v_detections"), MIDDLE, END)


@query("gps_summary", f"""
select count(*) as gps_fixes, count(distinct animal_id) as active_animals, round(avg(speed_kmh), 4) as average_speed_kmh
from v_telemetry where recorded_epoch_ms >= {START} and recorded_epoch_ms < {END}""")
def _(spark, sf):
    return rounded(agg.gps_summary(view(spark, sf, "v_telemetry"), START, END), "average_speed_kmh")


ENVIRONMENT = f"""
select count(*) as sensor_count, cast(sum(reading_count) as bigint) as reading_count,
  round(avg(t), 4) as ambient_temperature_c, round(avg(h), 4) as relative_humidity_percent
from (select sensor_mac, avg(ambient_temperature_c) over w as t, avg(relative_humidity_percent) over w as h,
    row_number() over (partition by sensor_mac order by recorded_epoch_ms desc, id desc) as rank,
    count(*) over (partition by sensor_mac) as reading_count
  from v_sensor_readings where recorded_epoch_ms >= {START} and recorded_epoch_ms < {END} and quality_flag <> 'INVALID'
  window w as (partition by sensor_mac order by recorded_epoch_ms, id rows between 6 preceding and current row))
where rank = 1"""


@query("environment_summary", ENVIRONMENT)
def _(spark, sf):
    metrics = ["ambient_temperature_c", "relative_humidity_percent"]
    return rounded(agg.environment_summary(view(spark, sf, "v_sensor_readings"), START, END, metrics), *metrics)


@query("risk_summary", """
select count(*) as assessed_cells, round(max(conservation_risk_index), 4) as max_cri, round(avg(conservation_risk_index), 4) as mean_cri,
  count(*) filter (conservation_risk_index >= 60) as critical_cells, round(max(intervention_priority_index), 4) as top_ipi
from (select *, row_number() over (partition by species_id, h3_cell order by period_end_epoch_ms desc, id desc) as rank
  from v_risk_assessments where period_end_epoch_ms >= 0 and period_end_epoch_ms < 4102444800000) where rank = 1""")
def _(spark, sf):
    return rounded(agg.risk_summary(view(spark, sf, "v_risk_assessments"), 0, 4102444800000), "max_cri", "mean_cri", "top_ipi")


SHIFT = 820_454_400_000  # 26 years: the assessments' dates moved to those of the events


@query("summary_cards", f"""
with d as (select case when detected_epoch_ms >= {MIDDLE} then 1 else 0 end as cur, * from v_detections
    where detected_epoch_ms >= {2 * MIDDLE - END} and detected_epoch_ms < {END}),
g as (select case when recorded_epoch_ms >= {MIDDLE} then 1 else 0 end as cur, * from v_telemetry
    where recorded_epoch_ms >= {2 * MIDDLE - END} and recorded_epoch_ms < {END}),
e as (select cur, avg(t) as t, avg(h) as h from (
    select cur, sensor_mac, avg(ambient_temperature_c) as t, avg(relative_humidity_percent) as h from (
      select *, row_number() over (partition by cur, sensor_mac order by recorded_epoch_ms desc, id desc) as rn from (
        select case when recorded_epoch_ms >= {MIDDLE} then 1 else 0 end as cur, * from v_sensor_readings
        where recorded_epoch_ms >= {2 * MIDDLE - END} and recorded_epoch_ms < {END} and quality_flag <> 'INVALID'))
    where rn <= 7 group by 1, 2) group by 1),
r as (select cur, count(*) as assessed_cells, max(conservation_risk_index) as max_cri, avg(conservation_risk_index) as mean_cri,
    count(*) filter (conservation_risk_index >= 60) as critical_cells, max(intervention_priority_index) as top_ipi from (
    select *, row_number() over (partition by cur, species_id, h3_cell order by ended desc, id desc) as rn from (
      select *, period_end_epoch_ms + {SHIFT} as ended, case when period_end_epoch_ms + {SHIFT} >= {MIDDLE} then 1 else 0 end as cur from v_risk_assessments
      where period_end_epoch_ms + {SHIFT} >= {2 * MIDDLE - END} and period_end_epoch_ms + {SHIFT} < {END})) where rn = 1 group by 1),
cards as (
  select 'risk' as domain, 'assessed_cells' as key, coalesce(max(assessed_cells) filter (cur = 1), 0) as v, coalesce(max(assessed_cells) filter (cur = 0), 0) as p from r
  union all select 'risk', 'max_cri', max(max_cri) filter (cur = 1), max(max_cri) filter (cur = 0) from r
  union all select 'risk', 'mean_cri', max(mean_cri) filter (cur = 1), max(mean_cri) filter (cur = 0) from r
  union all select 'risk', 'critical_cells', coalesce(max(critical_cells) filter (cur = 1), 0), coalesce(max(critical_cells) filter (cur = 0), 0) from r
  union all select 'risk', 'top_ipi', max(top_ipi) filter (cur = 1), max(top_ipi) filter (cur = 0) from r
  union all select 'detections' as domain, 'total_detections' as key, count(*) filter (cur = 1) as v, count(*) filter (cur = 0) as p from d
  union all select 'detections', 'wildlife_sightings', count(*) filter (cur = 1 and category = 'target_wildlife'), count(*) filter (cur = 0 and category = 'target_wildlife') from d
  union all select 'detections', 'threat_alerts', count(*) filter (cur = 1 and category = 'immediate_threat'), count(*) filter (cur = 0 and category = 'immediate_threat') from d
  union all select 'detections', 'species_detected', count(distinct species_id) filter (cur = 1), count(distinct species_id) filter (cur = 0) from d
  union all select 'gps', 'gps_fixes', count(*) filter (cur = 1), count(*) filter (cur = 0) from g
  union all select 'gps', 'active_animals', count(distinct animal_id) filter (cur = 1), count(distinct animal_id) filter (cur = 0) from g
  union all select 'gps', 'average_speed_kmh', avg(speed_kmh) filter (cur = 1), avg(speed_kmh) filter (cur = 0) from g
  union all select 'environmental', 'ambient_temperature_c', max(t) filter (cur = 1), max(t) filter (cur = 0) from e
  union all select 'environmental', 'relative_humidity_percent', max(h) filter (cur = 1), max(h) filter (cur = 0) from e)
select domain, key, round(v, 4) as value, round(p, 4) as previous_value,
  round(case when v is null or p is null then null when p = 0 then case when v = 0 then 0.0 end else (v - p) / abs(p) * 100 end, 4) as delta_percent,
  case when v is null or p is null then 'unknown' when p = 0 then case when v > 0 then 'up' when v < 0 then 'down' else 'flat' end
    when abs((v - p) / abs(p) * 100) < 1 then 'flat' when v > p then 'up' else 'down' end as trend
from cards""")
def _(spark, sf):
    names = {"detections": "v_detections", "telemetry": "v_telemetry", "sensor_readings": "v_sensor_readings",
             "risk_assessments": "v_risk_assessments"}
    tables = {k: view(spark, sf, v) for k, v in names.items()}
    tables["risk_assessments"] = tables["risk_assessments"].withColumn("period_end_epoch_ms", F.col("period_end_epoch_ms") + SHIFT)
    cards = agg.summary_cards(tables, MIDDLE, END, ["ambient_temperature_c", "relative_humidity_percent"])
    return rounded(cards.drop("label", "unit"), "value", "previous_value", "delta_percent")


def _historical_sql(method):
    linear = ("coalesce(l + (r - l) * (i - li) / (ri - li), l)" if method == "linear" else "l")
    return f"""
with axis as (select {START} + range * {HOUR_MS} as bucket_epoch_ms from range(960)),
stats as (select (recorded_epoch_ms // {HOUR_MS}) * {HOUR_MS} as bucket_epoch_ms, count(*) as reading_count,
    avg(case when ambient_temperature_c > 120 then ambient_temperature_c end) as t from v_sensor_readings
  where recorded_epoch_ms >= {START} and recorded_epoch_ms < {START + 40 * DAY_MS} and quality_flag <> 'INVALID' group by 1),
dense as (select axis.bucket_epoch_ms, coalesce(reading_count, 0) as sample_count, t,
    row_number() over (order by axis.bucket_epoch_ms) as i from axis left join stats using (bucket_epoch_ms)),
filled as (select *, last_value(t ignore nulls) over b as l, last_value(case when t is not null then i end ignore nulls) over b as li,
    first_value(t ignore nulls) over a as r, first_value(case when t is not null then i end ignore nulls) over a as ri
  from dense window b as (order by i rows between unbounded preceding and current row),
    a as (order by i rows between current row and unbounded following))
select bucket_epoch_ms, sample_count, 'ambient_temperature_c' as metric, 'avg' as aggregate,
  round(case when t is not null then t when li is not null and coalesce(ri, 961) - li - 1 <= 3 then {linear} end, 4) as data,
  t is null and li is not null and coalesce(ri, 961) - li - 1 <= 3 as imputed from filled
union all
select bucket_epoch_ms, sample_count, 'reading_count', 'count', sample_count, false from dense"""


for _method in ("forward_fill", "linear"):
    @query(f"historical_environment_{_method}", _historical_sql(_method))
    def _(spark, sf, method=_method):
        """A sensor that reports heat only, so that hours are missing."""
        heat = F.when(F.col("ambient_temperature_c") > 120, F.col("ambient_temperature_c"))
        readings = view(spark, sf, "v_sensor_readings").withColumn("ambient_temperature_c", heat)
        df = agg.historical(readings, "environmental", ["ambient_temperature_c", "reading_count"], "hour", START, START + 40 * DAY_MS,
                            method, max_gap=3)
        return rounded(df, "data")


@query("historical_detections_day", f"""
with axis as (select {START} + range * {DAY_MS} as bucket_epoch_ms from range(30)),
s as (select (detected_epoch_ms // {DAY_MS}) * {DAY_MS} as bucket_epoch_ms, count(*) as n,
  count(*) filter (category = 'target_wildlife') as w, count(*) filter (category = 'immediate_threat') as t, avg(confidence) as c
  from v_detections where source_type = 'ACOUSTIC' and detected_epoch_ms >= {START} and detected_epoch_ms < {START + 30 * DAY_MS} group by 1),
d as (select bucket_epoch_ms, coalesce(n, 0) as sample_count, coalesce(w, 0) as w, coalesce(t, 0) as t, c from axis left join s using (bucket_epoch_ms))
select bucket_epoch_ms, sample_count, 'detection_count' as metric, 'count' as aggregate, cast(sample_count as double) as data, false as imputed from d
union all select bucket_epoch_ms, sample_count, 'wildlife_count', 'count', w, false from d
union all select bucket_epoch_ms, sample_count, 'threat_count', 'count', t, false from d
union all select bucket_epoch_ms, sample_count, 'mean_confidence', 'avg', round(c, 4), false from d""")
def _(spark, sf):
    df = agg.historical(view(spark, sf, "v_detections"), "acoustic",
                        ["detection_count", "wildlife_count", "threat_count", "mean_confidence"], "day", START, START + 30 * DAY_MS)
    return rounded(df.withColumn("imputed", F.coalesce("imputed", F.lit(False))), "data")


@query("sensor_means", """
select h3_cell, round(avg(ambient_temperature_c), 4) as ambient_temperature_c, round(avg(relative_humidity_percent), 4) as relative_humidity_percent
from v_sensor_readings where quality_flag <> 'INVALID' group by 1""")
def _(spark, sf):
    m = ["ambient_temperature_c", "relative_humidity_percent"]
    return rounded(agg.sensor_means(view(spark, sf, "v_sensor_readings"), m), *m)


@query("daily_means", """
select h3_cell, recorded_epoch_ms // 86400000 as day_index, round(avg(ambient_temperature_c), 4) as ambient_temperature_c
from v_sensor_readings where quality_flag <> 'INVALID' group by 1, 2""")
def _(spark, sf):
    return rounded(agg.daily_means(view(spark, sf, "v_sensor_readings"), ["ambient_temperature_c"]), "ambient_temperature_c")


RATE = "try_cast(json_extract_string(physiological_metrics, '$.heart_rate_bpm') as double)"


@query("telemetry_summary", f"""
select species_id, count(*) as fix_count, round(avg(case when speed_kmh >= 0 then speed_kmh end), 4) as mean_speed_kmh,
  round(avg(case when {RATE} > 0 then {RATE} end), 4) as mean_heart_rate_bpm
from (select * replace (replace(physiological_metrics, '"k"', '"heart_rate_bpm"') as physiological_metrics) from v_telemetry) group by 1""")
def _(spark, sf):
    df = view(spark, sf, "v_telemetry").withColumn(
        "physiological_metrics", F.replace("physiological_metrics", F.lit('"k"'), F.lit('"heart_rate_bpm"')))
    return rounded(agg.telemetry_summary(df), "mean_speed_kmh", "mean_heart_rate_bpm")


# metadata with an age class derived from the event's own property
AGE_SQL = """(select * replace (case cast(json_extract_string(metadata, '$.k') as int) % 5 when 0 then '{"age_class": "Juvenile "}'
  when 1 then '{"ageClass": "adult"}' when 2 then '{"age_class": "none", "ageClass": "elder"}' when 3 then '{"age_class": "subadult"}'
  else '{}' end as metadata) from v_detections where source_type = 'VISION' and species_id is not null)"""


def _aged(spark, sf):
    k = F.get_json_object("metadata", "$.k").cast("int") % 5
    return (view(spark, sf, "v_detections").filter("source_type = 'VISION' and species_id is not null")
            .withColumn("metadata", F.when(k == 0, '{"age_class": "Juvenile "}').when(k == 1, '{"ageClass": "adult"}')
                        .when(k == 2, '{"age_class": "none", "ageClass": "elder"}').when(k == 3, '{"age_class": "subadult"}')
                        .otherwise("{}")))


FRAMES_SQL = f"""
select species_id, coalesce(cast(source_record_id as varchar), 'd' || id) as frame, min(detected_epoch_ms) as ms, count(*) as n,
  count(*) filter (a = 'juvenile') as juvenile, count(*) filter (a = 'subadult') as subadult,
  count(*) filter (a = 'adult') as adult, count(*) filter (a = 'elder') as elder
from (select *, case when lower(trim(json_extract_string(metadata, '$.age_class'))) in ('juvenile','subadult','adult','elder')
    then lower(trim(json_extract_string(metadata, '$.age_class')))
    when lower(trim(json_extract_string(metadata, '$.ageClass'))) in ('juvenile','subadult','adult','elder')
    then lower(trim(json_extract_string(metadata, '$.ageClass'))) end as a from {AGE_SQL}) group by 1, 2"""


@query("herd_series", f"select species_id, ms // 86400000 as day_index, cast(max(n) as double) as herd_count from ({FRAMES_SQL}) group by 1, 2")
def _(spark, sf):
    return agg.herd_series(agg.frames(_aged(spark, sf)))


@query("age_classes", f"""select species_id, cast(sum(juvenile) as bigint) as juvenile, cast(sum(subadult) as bigint) as subadult,
  cast(sum(adult) as bigint) as adult, cast(sum(elder) as bigint) as elder from ({FRAMES_SQL}) group by 1""")
def _(spark, sf):
    return agg.age_classes(agg.frames(_aged(spark, sf)))


BOXED_SQL = """(select *, confidence * 0.5 as bbox_left, confidence * 0.5 + 0.3 as bbox_right,
  (id % 10) / 20.0 as bbox_top, (id % 10) / 20.0 + 0.4 as bbox_bottom from v_detections where source_type = 'VISION' and species_id is not null)"""


def boxed(spark, sf):
    return (view(spark, sf, "v_detections").filter("source_type = 'VISION' and species_id is not null")
            .selectExpr("*", "confidence * 0.5 as bbox_left", "confidence * 0.5 + 0.3 as bbox_right",
                        "(id % 10) / 20.0D as bbox_top", "(id % 10) / 20.0D + 0.4D as bbox_bottom"))


@query("density_grid", f"""
with b as (select * from {BOXED_SQL}),
cells as (select species_id, least(cast(trunc((bbox_top + bbox_bottom) / 2.0 * 5) as int), 4) as grid_row,
    least(cast(trunc((bbox_left + bbox_right) / 2.0 * 5) as int), 4) as grid_col, count(*) as hits from b group by 1, 2, 3),
seen as (select species_id, count(distinct source_record_id) as frames from b group by 1)
select species_id, grid_row, grid_col, round(hits / frames, 6) as density from cells join seen using (species_id)""")
def _(spark, sf):
    return rounded(agg.density_grid(boxed(spark, sf)), "density", digits=6)


@query("acoustic_threats", """
select species_id, count(*) as acoustic_threats, count(db) as levels, max(db) as peak_db, round(avg(db), 4) as mean_db
from (select *, case when try_cast(json_extract_string(metadata, '$.decibels') as double) between -200 and 250
    then try_cast(json_extract_string(metadata, '$.decibels') as double) end as db
  from (select * replace (replace(metadata, '"k"', '"decibels"') as metadata) from v_detections))
where source_type = 'ACOUSTIC' and category = 'immediate_threat' group by 1""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").withColumn("metadata", F.replace("metadata", F.lit('"k"'), F.lit('"decibels"')))
    return rounded(agg.acoustic_threats(df), "mean_db")


@query("threat_context", f"""
select species_id, class_name, events, trend, round(max_confidence, 4) as max_confidence, latest_ms, rn from (
  select *, row_number() over (partition by species_id order by events desc, latest_ms desc, class_name) as rn from (
    select species_id, class_name, count(*) as events,
      count(*) filter (detected_epoch_ms >= {(START + END) // 2}) - count(*) filter (detected_epoch_ms < {(START + END) // 2}) as trend,
      max(confidence) as max_confidence, max(detected_epoch_ms) as latest_ms
    from v_detections where category = 'immediate_threat' and species_id is not null group by 1, 2)) where rn <= 10""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").filter("category = 'immediate_threat' and species_id is not null")
    out = agg.threat_context(df, ["species_id"], F.lit(START), F.lit(END), n=10)
    return rounded(out.withColumn("rn", F.col("rn").cast("bigint")), "max_confidence")


@query("threat_cells", """
select species_id, cell, events, rn from (
  select *, row_number() over (partition by species_id order by events desc, cell) as rn from (
    select species_id, 'tile-' || cast(cast(floor(latitude * 10) as bigint) as varchar) || '-' || cast(cast(floor(longitude * 10) as bigint) as varchar) as cell,
      count(*) as events from v_detections
    where category = 'immediate_threat' and latitude is not null and species_id is not null group by 1, 2)) where rn <= 5""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").filter("category = 'immediate_threat' and species_id is not null").withColumn(
        "cell", F.when(F.col("latitude").isNotNull(), F.concat_ws("-", F.lit("tile"), F.floor(F.col("latitude") * 10), F.floor(F.col("longitude") * 10))))
    out = agg.threat_cells(df, ["species_id"], n=5)
    return out.withColumn("rn", F.col("rn").cast("bigint"))


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_profile", " union all ".join(f"select '{t}' as table_name, count(*) as row_count from {t}" for t in TABLES))
def _(spark, sf):
    return agg.table_profile({t: table(spark, sf, t) for t in TABLES})


@query("indicator_summary", """
select species_id, count(*) as records, max(db) as peak_db, round(avg(db), 4) as mean_db, round(sum(confidence), 4) as density_total
from (select *, cast(json_extract_string(metadata, '$.k') as double) as db from v_detections) group by 1""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").select("species_id", F.get_json_object("metadata", "$.k").cast("double").alias("decibels"),
                                                F.col("confidence").alias("density"))
    return rounded(agg.indicator_summary(df, ["species_id"]), "mean_db", "density_total")
