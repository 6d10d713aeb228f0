"""Media, habitat, radar, ingest and document queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.config import AcousticConfig, VisionConfig
from fieldlake.operators import aggregates, habitat, media, topk
from fieldlake.plans import radar
from fieldlake.registry.core import query, rounded
from fieldlake.registry.q_spatial import VIEW, _grid
from fieldlake.registry.views import table, view
from fieldlake.sources import readers, sinks

START, END = 1704067200000, 1706659200000

# predictions laid out from line items: frame = order, class scores from discount and tax
PRED = """(select l_orderkey as frame, l_partkey, l_suppkey, l_linenumber, (l_partkey % 640)::double as cx, (l_suppkey * 7 % 480)::double as cy, l_quantity * 4 as w, l_quantity * 3 as h,
  l_discount * 9 as s0, l_tax * 11 as s1 from lineitem)"""


def _predictions(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as frame", "l_partkey", "l_suppkey", "l_linenumber",
        "array(cast(l_partkey % 640 as double), cast(l_suppkey * 7 % 480 as double), l_quantity * 4, l_quantity * 3, l_discount * 9, l_tax * 11) as prediction",
        "1280 as frame_width", "960 as frame_height", "0.5D as resize_scale", "8.0D as pad_x", "4.0D as pad_y")


@query("decode_boxes", f"""
with p as (select *, greatest(s0, s1) as c, least(greatest((cx - w / 2 - 8) / 0.5, 0), 1280) as l, least(greatest((cy - h / 2 - 4) / 0.5, 0), 960) as t,
  least(greatest((cx + w / 2 - 8) / 0.5, 0), 1280) as r, least(greatest((cy + h / 2 - 4) / 0.5, 0), 960) as b from {PRED})
select frame, l_partkey, l_suppkey, l_linenumber, case when s0 >= s1 then 0 else 1 end::int as class_id, round(c, 6) as confidence, l as box_left, t as box_top, r as box_right, b as box_bottom
from p where c >= 0.45 and r > l and b > t""")
def _(spark, sf):
    df = media.decode_boxes(_predictions(spark, sf))
    return rounded(df.select("frame", "l_partkey", "l_suppkey", "l_linenumber", "class_id", "confidence", "box_left", "box_top", "box_right", "box_bottom"), "confidence", digits=6)


@query("nms")
def _(spark, sf):
    """Greedy suppression per frame and class; checked against the definition in tests."""
    boxes = media.decode_boxes(_predictions(spark, sf)).withColumn("box_id", F.struct("l_linenumber", "l_partkey", "l_suppkey").cast("string"))
    return media.nms(boxes.select("frame", "class_id", "box_id", "confidence", "box_left", "box_top", "box_right", "box_bottom")).groupBy("class_id").agg(F.count(F.lit(1)).alias("kept"))


BOXES = """(select l_orderkey as frame, l_returnflag as species, (l_partkey % 640)::double as l, (l_suppkey * 7 % 480)::double as t, l_quantity as w, l_tax * 100 + 1 as h, l_discount * 10 as c from lineitem)"""


def _framed(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey as frame", "l_returnflag as species", "cast(l_partkey % 640 as double) as box_left", "cast(l_suppkey * 7 % 480 as double) as box_top",
        "l_quantity as w", "l_tax * 100 + 1 as h", "l_discount * 10 as confidence", "640 as frame_width", "480 as frame_height")
    df = df.withColumn("box_right", F.col("box_left") + F.col("w")).withColumn("box_bottom", F.col("box_top") + F.col("h"))
    df = df.withColumn("cx", (F.col("box_left") + F.col("box_right")) / 2).withColumn("cy", (F.col("box_top") + F.col("box_bottom")) / 2)
    return media.frame_summary(df, cfg=VisionConfig(threats=("R",)))


@query("frame_summary", f"""
select frame, count(*) as total_count, round(max(c), 6) as highest_confidence, bool_or(species = 'R') as threat_detected, round(least(1, sum(w * h) / (640 * 480)), 6) as herd_density,
  coalesce(count(*) filter (species = 'A'), 0) as a_count from {BOXES} group by 1""")
def _(spark, sf):
    df = _framed(spark, sf).select("frame", "total_count", "highest_confidence", "threat_detected", "herd_density", F.coalesce(F.try_element_at("species_counts", F.lit("A")), F.lit(0)).alias("a_count"))
    return rounded(df, "highest_confidence", "herd_density", digits=6)


@query("video_summary", f"""
with f as (select frame % 500 as video, frame, count(*) as n, count(*) filter (species = 'N') as nn, max(c) as c from {BOXES} group by 1, 2)
select video, count(*) as sampled_frame_count, max(n) as total_count, round(max(c), 6) as highest_confidence, nullif(max(nn), 0) as n_count from f group by 1""")
def _(spark, sf):
    df = media.video_summary(_framed(spark, sf).withColumn("video", F.col("frame") % 500))
    return rounded(df.select("video", "sampled_frame_count", "total_count", "highest_confidence", F.try_element_at("species_counts", F.lit("N")).alias("n_count")), "highest_confidence", digits=6)


@query("sample_frames", """
select l_orderkey % 300 as video, l_partkey * 10 + l_linenumber as frame_index, l_suppkey, l_orderkey from lineitem
where (l_partkey * 10 + l_linenumber) % greatest(1, round_even(l_orderkey % 300 % 30, 0)::bigint) = 0 and l_partkey * 10 + l_linenumber < greatest(1, round_even(l_orderkey % 300 % 30, 0)::bigint) * 300""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey % 300 as video", "l_partkey * 10 + l_linenumber as frame_index", "l_suppkey", "l_orderkey", "cast(l_orderkey % 300 % 30 as double) as fps")
    return media.sample_frames(df).select("video", "frame_index", "l_suppkey", "l_orderkey")


@query("scores_to_detections", """
with s as (select vec_id, list_min(embedding) < 0 or list_max(embedding) > 1 as logits, embedding from embeddings),
e as (select vec_id, logits, unnest(embedding)::double as v, unnest(range(len(embedding))) as class_id from s),
p as (select vec_id, class_id, case when logits then 1 / (1 + exp(-v)) else v end as c from e)
select vec_id as window_id, n_name as class_name, case when n_regionkey = 0 then 'immediate_threat' else 'target_wildlife' end as category, round(c, 5) as confidence
from p join nation on n_nationkey = class_id where (n_regionkey = 0 and c >= 0.4) or (n_regionkey = 1 and c >= 0.52)""")
def _(spark, sf):
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("class_id"), F.col("n_name").alias("class_name"), "n_regionkey")
    # 25 configured class names at every scale
    names = nations.filter("n_regionkey < 2").collect()
    cfg = AcousticConfig(confidence=0.52, threats=tuple(r["class_name"] for r in names if r["n_regionkey"] == 0), wildlife=tuple(r["class_name"] for r in names if r["n_regionkey"] == 1))
    df = table(spark, sf, "embeddings").select(F.col("vec_id").alias("window_id"), F.col("embedding").alias("scores"))
    out = media.scores_to_detections(df, nations.drop("n_regionkey"), cfg)
    return rounded(out.select("window_id", "class_name", "category", "confidence"), "confidence", digits=5)


@query("slice_windows", """
with e as (select vec_id, embedding, unnest(range((len(embedding) - 24) // 16 + 1)) as i from embeddings)
select vec_id, i::int as window_index, (i * 16)::int as start_sample, 1000 * vec_id + i * 160 as window_ms, round(list_sum(list_transform(embedding[i * 16 + 1 : i * 16 + 24]::double[], lambda x, k: x * k)), 4) as total from e""")
def _(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples"), (F.col("vec_id") * 1000).alias("origin_ms"))
    out = media.slice_windows(df, 24, 16, 100, "vec_id")
    # every sample counts by its place
    placed = F.transform("samples", lambda s, i: s.cast("double") * (i + 1))
    total = F.aggregate(placed, F.lit(0.0), lambda a, s: a + s)
    return rounded(out.select("vec_id", "window_index", "start_sample", "window_ms", total.alias("total")), "total")


@query("to_mono", """
select vec_id, 32 as frames, round(list_sum(list_transform(embedding, lambda v, k: greatest(-1, least(1, v::double)) * ((k + 1) // 2))) / 2, 4) as total from embeddings""")
def _(spark, sf):
    df = media.to_mono(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples"), F.lit(2).alias("channels")))
    return rounded(df.select("vec_id", F.size("mono").alias("frames"), F.aggregate(F.transform("mono", lambda s, i: s * (i + 1)), F.lit(0.0), lambda a, s: a + s).alias("total")), "total")


@query("log_mel")
def _(spark, sf):
    """Spectrogram of every vector as a short sound; checked against numpy in tests."""
    cfg = AcousticConfig(rate=1000, n_fft=32, hop=8, mel_bands=6)
    df = media.log_mel(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples")), cfg)
    return df.select("vec_id", F.size("spectrogram").alias("bands"), F.round(F.array_max(F.transform("spectrogram", lambda b: F.array_max(b))).cast("double"), 2).alias("peak"))


GRID = "(select l_orderkey % 200 as r, l_partkey % 200 as c, avg(l_quantity) * 100 as elevation, avg(l_discount) as forest, avg(l_tax) as ndvi from lineitem group by 1, 2)"


def _cells(spark, sf):
    df = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("row"), (F.col("l_partkey") % 200).alias("col"))
    return df.agg((F.avg("l_quantity") * 100).alias("elevation"), F.avg("l_discount").alias("forest_fraction"), F.avg("l_tax").alias("ndvi")).withColumn("valid", F.lit(True))


@query("presence_cells", f"""
select distinct p.r as row, p.c as col from (select floor(s_suppkey * 1700 % 200000 / 1000.0)::bigint as r, floor(s_suppkey * 2300 % 200000 / 1000.0)::bigint as c from supplier) p join {GRID} g on g.r = p.r and g.c = p.c""")
def _(spark, sf):
    spots = table(spark, sf, "supplier").selectExpr("cast(s_suppkey * 2300 % 200000 as double) as x", "cast(s_suppkey * 1700 % 200000 as double) as y")
    return habitat.presence_cells(spots, _cells(spark, sf))


@query("pseudo_absences", f"""
select g.r as row, g.c as col from {GRID} g where elevation between 1400 and 3600 and forest < 0.1
  and not exists (select 1 from (select distinct s_suppkey * 7 % 200 as r, s_nationkey * 8 as c from supplier) p where abs(p.r - g.r) <= 1 and abs(p.c - g.c) <= 1)""")
def _(spark, sf):
    near = table(spark, sf, "supplier").selectExpr("s_suppkey * 7 % 200 as row", "cast(s_nationkey * 8 as bigint) as col").distinct()
    return habitat.pseudo_absences(_cells(spark, sf), near).select("row", "col")


@query("suitability_class", """
select l_returnflag, case when l_discount * 10 >= 0.75 then 'High' when l_discount * 10 >= 0.5 then 'Moderate' when l_discount * 10 >= 0.25 then 'Low' else 'Very Low' end as suitability, count(*) as n from lineitem group by 1, 2""")
def _(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", habitat.suitability_class(F.col("l_discount") * 10).alias("suitability")).agg(F.count(F.lit(1)).alias("n"))


@query("mask_extrapolation", f"""
with g as (select * from {GRID}), b as (select min(ndvi) as lo, max(ndvi) as hi, min(elevation) as el, max(elevation) as eh from g where forest < 0.05)
select r as row, c as col, case when ndvi < lo or ndvi > hi or elevation < el or elevation > eh then 'extrapolation' else 'suitable_model_domain' end as status from g, b""")
def _(spark, sf):
    cells = _cells(spark, sf)
    return habitat.mask_extrapolation(cells.withColumn("vote", F.lit(0.5)), cells.filter("forest_fraction < 0.05"), ["ndvi", "elevation"]).select("row", "col", "status")


@query("evaluate_threshold", """
with t as (select l_discount as s, count(*) filter (l_returnflag = 'A') as p, count(*) filter (l_returnflag <> 'A') as n from lineitem group by 1),
c as (select *, sum(p) over w as tp, sum(n) over w as fp, sum(p) over () as np, sum(n) over () as nn from t window w as (order by s desc)),
a as (select sum(n * (tp - p + p / 2.0)) / max(np * nn) as auc from c),
b as (select s, tp / np - fp / nn as gain from c order by 2 desc, 1 desc limit 1)
select (select count(*) from lineitem) as rows, round(auc, 5) as auc, round(gain, 5) as tss, round(s, 5) as threshold from a, b""")
def _(spark, sf):
    """AUC, TSS and threshold of a score."""
    df = table(spark, sf, "lineitem").selectExpr("case when l_returnflag = 'A' then 1 else 0 end as label", "l_discount as estimate")
    m = habitat.evaluate(df)
    return df.agg(F.count(F.lit(1)).alias("rows")).select("rows", *[F.lit(round(v, 5)).alias(k) for k, v in m.items()])


def _tables(spark, sf):
    return {"sensor_readings": view(spark, sf, "v_sensor_readings"), "detections": view(spark, sf, "v_detections"), "telemetry": view(spark, sf, "v_telemetry"),
            "risk_assessments": view(spark, sf, "v_risk_assessments").withColumn("period_end_epoch_ms", F.col("period_end_epoch_ms") + 700000000000)}


ZONES = """
e as (select 'zone-' || substr(h3_cell, 6)::int % 6 as z, count(*) as readings, count(ambient_temperature_c) as tn, stddev_pop(ambient_temperature_c) as sd from v_sensor_readings
  where quality_flag <> 'INVALID' and recorded_epoch_ms >= {s} and recorded_epoch_ms < {e} group by 1),
d as (select 'zone-' || floor((latitude + 2.5) * 6)::int as z, count(*) as n, count(*) filter (category = 'target_wildlife') as w, count(*) filter (source_type = 'ACOUSTIC' and category = 'immediate_threat') as a
  from v_detections where latitude is not null and detected_epoch_ms >= {s} and detected_epoch_ms < {e} group by 1),
g as (select 'zone-' || floor((latitude + 2.5) * 6)::int as z, count(*) as n, count(distinct animal_id) as animals from v_telemetry where recorded_epoch_ms >= {s} and recorded_epoch_ms < {e} group by 1),
r as (select 'zone-' || substr(h3_cell, 6)::int % 6 as z, count(*) as n, avg(conservation_risk_index) as cri from (
    select *, row_number() over (partition by species_id, h3_cell order by period_end_epoch_ms desc, id desc) as rn from v_risk_assessments
    where period_end_epoch_ms + 820454400000 >= {s} and period_end_epoch_ms + 820454400000 < {e}) where rn = 1 group by 1),
u as (select z, coalesce(readings, 0) + coalesce(d.n, 0) + coalesce(g.n, 0) + coalesce(r.n, 0) as activity, cri, coalesce(w, 0)::double as w, coalesce(animals, 0)::double as animals, case when tn >= 2 then sd end as sd, coalesce(a, 0)::double as a
  from e full join d using (z) full join g using (z) full join r using (z)),
t as (select * from u order by activity desc, z limit 5),
n as (select *, case when max(w) over () = min(w) over () then 0.5 else (w - min(w) over ()) / (max(w) over () - min(w) over ()) end as wn,
  case when max(animals) over () = min(animals) over () then 0.5 else (animals - min(animals) over ()) / (max(animals) over () - min(animals) over ()) end as an,
  case when sd is null then null when max(sd) over () = min(sd) over () then 0.5 else (sd - min(sd) over ()) / (max(sd) over () - min(sd) over ()) end as sn,
  case when max(a) over () = min(a) over () then 0.5 else (a - min(a) over ()) / (max(a) over () - min(a) over ()) end as ln,
  case when cri is null then null when max(cri) over () = min(cri) over () then 0.5 else (cri - min(cri) over ()) / (max(cri) over () - min(cri) over ()) end as rn from t)""".replace("{s}", str(START)).replace("{e}", str(END))


@query("zone_radar", f"""
with {ZONES.strip()}
select z as zone_id, activity, w as wildlife_sightings, animals as animal_presence, round(sd, 3) as temperature_variability, a as acoustic_threats, round(cri, 4) as conservation_risk,
  round((0.25 * wn + 0.15 * an + coalesce(0.15 * (1 - sn), 0) + 0.30 * (1 - ln) + coalesce(0.15 * (1 - rn), 0)) / (0.25 + 0.15 + case when sn is null then 0 else 0.15 end + 0.30 + case when rn is null then 0 else 0.15 end) * 100, 4) as health_score from n""")
def _(spark, sf):
    tables = _tables(spark, sf)
    tables["risk_assessments"] = view(spark, sf, "v_risk_assessments").withColumn("period_end_epoch_ms", F.col("period_end_epoch_ms") + 820_454_400_000)
    df = radar.zone_radar(tables, START, END, limit=5, cell_zone=lambda c: F.concat(F.lit("zone-"), (F.substring(c, 6, 9).cast("int") % 6).cast("string")),
                          place_zone=lambda la, lo: F.concat(F.lit("zone-"), F.floor((F.col(la) + 2.5) * 6).cast("string")))
    out = df.select("zone_id", "activity", "wildlife_sightings", "animal_presence", "temperature_variability", "acoustic_threats", "conservation_risk", "health_score")
    return rounded(rounded(out, "temperature_variability", digits=3), "conservation_risk", "health_score")


@query("geojson_features", """
select row_number() over (order by n desc, y, x) - 1 as cluster_id, n as point_count, n > 1 as is_cluster, 'Feature' as type, 'Point' as kind, round(lon + 1e-8, 4) as longitude, round(lat + 1e-8, 4) as latitude,
  round(n::double / max(n) over (), 4) as weight, threats as threat_count, round(west, 4) as west, round(south, 4) as south, round(east, 4) as east, round(north, 4) as north, round(mean, 4) as metric_avg from (
  select least(cast(floor((latitude + 2.5) / (1.0 / 16)) as int), 15) as y, least(cast(floor((longitude - 34.0) / (0.7 / 16)) as int), 15) as x, count(*) as n,
    avg(longitude) as lon, avg(latitude) as lat, count(*) filter (category = 'immediate_threat') as threats, min(longitude) as west, min(latitude) as south, max(longitude) as east, max(latitude) as north, avg(confidence) as mean
  from v_detections where latitude between -2.5 and -1.5 and longitude between 34.0 and 34.7 group by 1, 2)""")
def _(spark, sf):
    df = sinks.geojson_features(topk.rank_clusters(_grid(spark, sf)), VIEW[3], threats=True)
    feature = F.from_json("feature", """type string, geometry struct<type: string, coordinates: array<double>>, properties struct<cluster_id: bigint, cluster: boolean, point_count: bigint,
        weight: double, bbox: array<double>, threat_count: bigint, metric_avg: double>""")
    read = df.select(feature.alias("f"))
    place, box = "f.geometry.coordinates", "f.properties.bbox"
    out = read.select("f.properties.cluster_id", "f.properties.point_count", F.col("f.properties.cluster").alias("is_cluster"), "f.type", F.col("f.geometry.type").alias("kind"),
                      (F.get(place, F.lit(0)) + 1e-8).alias("longitude"), (F.get(place, F.lit(1)) + 1e-8).alias("latitude"), "f.properties.weight", "f.properties.threat_count",
                      *[F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("west", "south", "east", "north"))], "f.properties.metric_avg")
    return rounded(out, "longitude", "latitude", "west", "south", "east", "north")


def _payloads(spark, sf):
    """Mixed ingest messages made from every event."""
    e = table(spark, sf, "events")
    stamp = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    kind = F.when(F.col("event_type") == "view", "gps").when(F.col("event_type") == "click", "environmental").when(F.col("event_type") == "error", "acoustic").otherwise("vision")
    base = [kind.alias("reading_type"), F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("sensor_id"), stamp.alias("timestamp"), F.lit(-2.0).alias("latitude"), F.lit(34.5).alias("longitude"),
            (F.col("user_id") % 5 + 1).alias("species_id"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("animal_id"), F.lit("aa-bb-cc-dd-ee-ff").alias("sensor_mac"), F.lit("872830828ffffff").alias("h3_cell"),
            F.create_map(F.lit("ambient_temperature_c"), F.col("value") / 4).alias("measurements"), F.lit("gunshot").alias("class_name"), F.lit("immediate_threat").alias("category"), (F.col("value") / 500).alias("confidence")]
    return e.select(F.to_json(F.struct(*base)).alias("value"))


@query("route_ingest", """
select case event_type when 'view' then 'gps' when 'click' then 'environmental' when 'error' then 'acoustic' else 'vision' end as kind, 'dev-' || user_id as device_id, MS(ts) as at_ms, -2.0 as latitude,
  case when event_type in ('view', 'error') or event_type not in ('view', 'click', 'error') then user_id % 5 + 1 end as species_id, case when event_type = 'view' then 'a' || user_id end as animal_id,
  case when event_type = 'click' then 'AA:BB:CC:DD:EE:FF' end as sensor_mac, case when event_type = 'click' then round(value / 4, 4) end as temperature,
  case when event_type not in ('view', 'click') then 'gunshot' end as class_name, case when event_type not in ('view', 'click') then round(value / 500, 4) end as confidence from events""")
def _(spark, sf):
    parts = readers.route_ingest(readers.parse_ingest(_payloads(spark, sf)), cells=False)
    out = None
    for kind, df in parts.items():
        time = "recorded_epoch_ms" if "recorded_epoch_ms" in df.columns else "detected_epoch_ms"
        def held(name, kind_of, df=df):
            return (F.col(name) if name in df.columns else F.lit(None)).cast(kind_of)
        one = df.select(F.lit(kind).alias("kind"), "device_id", F.col(time).alias("at_ms"), "latitude", held("species_id", "bigint").alias("species_id"), held("animal_id", "string").alias("animal_id"),
                        held("sensor_mac", "string").alias("sensor_mac"), held("ambient_temperature_c", "double").alias("temperature"), held("class_name", "string").alias("class_name"),
                        held("confidence", "double").alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, "temperature", "confidence")


@query("parse_gps", "select event_id, 'dev-' || user_id as device_id, 'animal-' || user_id as animal_id, MS(ts) as recorded_epoch_ms, value as altitude, case when value < 30 then 'BATTERY_LOW' else 'BATTERY_OK' end as hardware_state from events")
def _(spark, sf):
    from fieldlake.functions.timex import PACKED_PATTERN
    from fieldlake.operators.validate import derive_hardware_state
    e = table(spark, sf, "events")
    fields = F.struct(F.concat(F.lit("animal-"), F.col("user_id").cast("string")).alias("animal_id"), F.date_format(F.col("ts").cast("timestamp"), PACKED_PATTERN).alias("timestamp"),
                      F.col("value").cast("string").alias("altitude"), F.col("value").alias("battery_percentage"), F.col("event_id").cast("string").alias("device_model"))
    body = F.to_json(F.struct(F.concat(F.lit("dev-"), F.col("user_id").cast("string")).alias("device_id"), fields.alias("fields")))
    df = derive_hardware_state(readers.parse_gps(e.select(body.alias("value"))))
    return df.select(F.col("device_model").cast("bigint").alias("event_id"), "device_id", "animal_id", "recorded_epoch_ms", "altitude", "hardware_state")


@query("dedupe_new_rows", """
select count(*) as stored from (select distinct l_orderkey, l_linenumber from lineitem) a where not exists (select 1 from orders o where o.o_orderkey = a.l_orderkey and o.o_orderstatus = 'F' and a.l_linenumber = 1)""")
def _(spark, sf):
    have = table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey as l_orderkey", "1 as l_linenumber")
    fresh = sinks.new_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), have, ["l_orderkey", "l_linenumber"], ["l_partkey"])
    return fresh.agg(F.count(F.lit(1)).alias("stored"))


@query("upsert_merge", """
select k, round(sum(v), 2) as v, count(*) as rows from (select o_orderpriority as k, case when l.q is not null then l.q else o_totalprice end as v from orders o left join (select l_orderkey, max(l_quantity) as q from lineitem group by 1) l on l.l_orderkey = o.o_orderkey) group by 1""")
def _(spark, sf):
    target = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    new = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("v"))
    merged = sinks.merged(new, target, ["o_orderkey"], ["v"])
    out = merged.join(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("k")), "o_orderkey")
    return out.groupBy("k").agg(F.round(F.sum("v"), 2).alias("v"), F.count(F.lit(1)).alias("rows"))


@query("ingest_counters", """
select l_returnflag, count(*) as received, count(*) filter (l_linestatus = 'O') as stored, count(*) filter (l_linestatus <> 'O' and l_linenumber > 3) as duplicate, count(*) filter (l_linestatus <> 'O' and l_linenumber <= 3) as failed from lineitem group by 1""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("status", F.when(F.col("l_linestatus") == "O", "stored").when(F.col("l_linenumber") > 3, "duplicate").otherwise("failed"))
    return aggregates.ingest_counters(df, keys=["l_returnflag"])


@query("outbox_rows", """
select 'species-' || (o_custkey % 900) as target_species, case when o_custkey % 3 = 0 then 'CRITICAL_INBREEDING_RISK' else 'VULNERABLE_POPULATION_RISK' end as risk_status, count(*) as n from orders where o_custkey % 3 < 2 group by 1, 2""")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("'p' as project_id", "concat('species-', cast(o_custkey % 900 as string)) as target_species", "'c' as h3_cell", "'2024' as time_bin",
                                               "case o_custkey % 3 when 0 then 'CRITICAL_INBREEDING_RISK' when 1 then 'VULNERABLE_POPULATION_RISK' else 'LOW_RISK' end as risk_status", "o_totalprice as ne")
    return sinks.outbox_rows(df).groupBy("target_species", "risk_status").agg(F.count(F.lit(1)).alias("n"))


@query("alert_frames", "select id::varchar as key, class_name as classification, round(confidence, 4) as confidence from v_detections where category = 'immediate_threat' and confidence >= 0.5")
def _(spark, sf):
    from fieldlake.streaming import jobs
    frames = sinks.alert_frames(jobs.threat_stream(view(spark, sf, "v_detections")))
    return frames.select("key", F.get_json_object("value", "$.classification").alias("classification"), F.round(F.get_json_object("value", "$.metrics.confidence").cast("double"), 4).alias("confidence"))


@query("quarantine_rows", "select id as source_row, 'ambient_temperature_c' as reason, ambient_temperature_c as kept from v_sensor_readings where not ambient_temperature_c between -90 and 70")
def _(spark, sf):
    from fieldlake.operators import validate
    bad = validate.split_valid(validate.validate(view(spark, sf, "v_sensor_readings").drop("h3_cell"), "sensor_readings"))[1]
    out = sinks.quarantine_rows(bad.withColumnRenamed("id", "source_row").withColumn("source_hash", F.col("device_id")))
    return out.select("source_row", "reason", F.col("source_data.ambient_temperature_c").alias("kept"))


