"""Validation rules over the stand-in tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.operators import filters, validate
from fieldlake.registry.core import query
from fieldlake.registry.views import table, view

LIMIT = 1706000000000


def _joined(df):
    return df.withColumn("reject_reasons", F.array_join("reject_reasons", ","))


@query("validate_gps", f"""
select id, case when not (latitude * 40 between -90 and 90 and longitude between -180 and 180) then 'INVALID_COORDINATE_BOUNDS'
  when recorded_epoch_ms > {LIMIT} + 86400000 then 'FUTURE_TIMESTAMP_ERROR' else 'VALID_FIX' end as validation_status,
  concat_ws(',', case when altitude * -40 < -11000 then 'altitude' end, case when altitude > 100 then 'temperature' end,
    case when altitude / 4 > 100 then 'battery_percentage' end) as reject_reasons
from v_telemetry""")
def _(spark, sf):
    df = view(spark, sf, "v_telemetry").selectExpr("id", "latitude * 40 as latitude", "longitude", "recorded_epoch_ms", "altitude * -40 as altitude",
                                                   "altitude as temperature", "altitude / 4 as battery_percentage")
    return _joined(validate.validate_gps(df, LIMIT)).select("id", "validation_status", "reject_reasons")


@query("hardware_state", """
select id, case when id % 3 = 0 then 'BATTERY_OK' when altitude < 30 then 'BATTERY_LOW' else 'BATTERY_OK' end as hardware_state,
  case when id % 2 = 0 then '3D_FIX' when id % 5 = 0 then '2D_FIX' else 'UNKNOWN' end as fix_quality from v_telemetry""")
def _(spark, sf):
    df = view(spark, sf, "v_telemetry").selectExpr(
        "id", "case when id % 3 = 0 then ' battery_ok ' else '' end as hardware_state", "altitude as battery_percentage",
        "case when id % 2 = 0 then '3d_fix' end as fix_quality", "case when id % 5 = 0 then '2D_FIX' end as gps_fix_quality")
    return validate.derive_hardware_state(df).select("id", "hardware_state", "fix_quality")


@query("validate_environmental", f"""
select id, case when recorded_epoch_ms > {LIMIT} + 86400000 then 'FUTURE_TIMESTAMP_ERROR' else 'VALID_FIX' end as validation_status,
  concat_ws(',', case when not ambient_temperature_c between -100 and 100 then 'temperature' end,
    case when relative_humidity_percent > 99 then 'humidity' end) as reject_reasons from v_sensor_readings""")
def _(spark, sf):
    df = view(spark, sf, "v_sensor_readings").selectExpr(
        "id", "recorded_epoch_ms", "0.5D as latitude", "1.5D as longitude", "0.0D as temperature", "ambient_temperature_c as temperature_filtered",
        "relative_humidity_percent + 1 as humidity")
    return _joined(validate.validate_environmental(df, LIMIT)).select("id", "validation_status", "reject_reasons")


@query("validate_sensor_readings", """
select id, concat_ws(',', case when not ambient_temperature_c between -90 and 70 then 'ambient_temperature_c' end,
  case when relative_humidity_percent > 100 then 'relative_humidity_percent' end,
  case when not regexp_full_match(sensor_mac, '([0-9A-F]{2}:){5}[0-9A-F]{2}') then 'sensor_mac' end) as reject_reasons from v_sensor_readings""")
def _(spark, sf):
    df = view(spark, sf, "v_sensor_readings").drop("h3_cell").withColumn("sensor_mac", F.lower(F.replace("sensor_mac", F.lit(":"), F.lit("-"))))
    return _joined(validate.validate(df, "sensor_readings")).select("id", "reject_reasons")


@query("validate_detections", """
with d as (select *, confidence * 1.2 as c, case when source_type = 'VISION' or id % 10 = 0 then 640 end as w, case when source_type = 'VISION' and id % 9 > 0 then confidence * 0.9 end as l,
  case when source_type = 'VISION' then 0.45 end as r, detected_epoch_ms + (id % 5 - 1) * 1000 as e from v_detections)
select id, concat_ws(',', case when c > 1.000001 then 'confidence' end,
  case when source_type = 'VISION' and (l is null) then 'box_required' end,
  case when source_type <> 'VISION' and w is not null then 'box_forbidden' end,
  case when source_type = 'VISION' and l >= r then 'box_order' end,
  case when e < detected_epoch_ms then 'ended_before_start' end) as reject_reasons from d""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").selectExpr(
        "id", "source_type", "category", "confidence * 1.2D as confidence", "latitude", "longitude", "detected_epoch_ms",
        "case when source_type = 'VISION' or id % 10 = 0 then 640 end as frame_width", "case when source_type = 'VISION' then 480 end as frame_height",
        "case when source_type = 'VISION' and id % 9 > 0 then confidence * 0.9D end as bbox_left", "case when source_type = 'VISION' then 0.45D end as bbox_right",
        "case when source_type = 'VISION' then 0.1D end as bbox_top", "case when source_type = 'VISION' then 0.2D end as bbox_bottom",
        "detected_epoch_ms + (id % 5 - 1) * 1000 as ended_epoch_ms")
    return _joined(validate.validate(df, "detections")).select("id", "reject_reasons")


@query("validate_genetics_records", """
with g as (select l_orderkey, l_linenumber, l_discount * 10 as p, case when l_discount > 0 and l_discount < 0.1 then 2 else 1 end as n, l_tax as he from lineitem)
select l_orderkey, l_linenumber, concat_ws(',', case when l_linenumber = 7 then 'frequency_sum' end,
  case when l_linenumber = 6 then 'allele_count' end,
  case when (case when l_linenumber = 6 then n + 1 else n end) = 1 and he <> 0 and l_linenumber <> 7 then 'monomorphic_heterozygosity' end,
  case when l_linenumber = 5 then 'ne_method' end, case when l_linenumber = 4 then 'ne_bounds' end) as reject_reasons from g""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_discount * 10 as p", "case when l_discount > 0 and l_discount < 0.1D then 2 else 1 end as n", "l_tax as he").selectExpr(
        "l_orderkey", "l_linenumber", "map('A', round(p, 6), 'B', round(1 - p, 6) + case when l_linenumber = 7 then 0.00001D else 0 end) as allele_frequencies",
        "case when l_linenumber = 6 then n + 1 else n end as allele_count", "he as expected_heterozygosity", "1.0D as allelic_richness",
        "case when l_linenumber in (4, 5) then 80.0D end as effective_population_size", "case when l_linenumber = 4 then 'TEMPORAL_VARIANCE' end as ne_method",
        "case when l_linenumber = 4 then 90.0D end as ne_lower_bound", "100.0D as ne_upper_bound", "10 as genotyped_individuals")
    # a frequency pushed above 1 is a second, independent reason; keep those rows inside [0, 1]
    df = df.withColumn("allele_frequencies", F.when((F.col("l_linenumber") == 7) & (F.element_at("allele_frequencies", "B") > 1),
                       F.create_map(F.lit("A"), F.lit(0.00002), F.lit("B"), F.lit(1.0))).otherwise(F.col("allele_frequencies")))
    df = df.withColumn("allele_count", F.when((F.col("l_linenumber") == 7), F.size(F.filter(F.map_values("allele_frequencies"), lambda v: v > 0))).otherwise(F.col("allele_count")))
    df = df.withColumn("expected_heterozygosity", F.when(F.col("l_linenumber") == 7, F.lit(0.0)).otherwise(F.col("expected_heterozygosity")))
    return _joined(validate.validate(df, "genetics_records")).select("l_orderkey", "l_linenumber", "reject_reasons")


@query("validate_species", """
select id, case when critical_ne_threshold + id * 100 >= viable_ne_threshold then 'ne_thresholds' else '' end as reject_reasons from v_species""")
def _(spark, sf):
    df = view(spark, sf, "v_species").selectExpr(
        "id", "critical_ne_threshold + id * 100 as critical_ne_threshold", "viable_ne_threshold", "60 as resting_heart_rate_min_bpm",
        "cast(null as int) as resting_heart_rate_max_bpm", "30.0 as body_temperature_min_c", "39.0 as body_temperature_max_c")
    return _joined(validate.validate(df, "species")).select("id", "reject_reasons")


@query("validate_risk_assessments", """
select id, concat_ws(',', case when conservation_risk_index > 95 then 'conservation_risk_index' end,
  case when id % 6 = 0 then 'period_order' end) as reject_reasons from v_risk_assessments""")
def _(spark, sf):
    df = view(spark, sf, "v_risk_assessments").selectExpr("id", "conservation_risk_index + 5 as conservation_risk_index",
                                                          "period_end_epoch_ms as period_end", "period_end_epoch_ms - id % 6 as period_start")
    return _joined(validate.validate(df, "risk_assessments")).select("id", "reject_reasons")


@query("validate_field_evidence", """
select o_orderkey as id, concat_ws(',', case when o_orderkey % 4 = 0 and o_orderstatus <> 'F' then 'no_evidence' end,
  case when o_custkey % 9 = 0 then 'source' end) as reject_reasons from orders""")
def _(spark, sf):
    df = table(spark, sf, "orders").selectExpr("o_orderkey as id", "case when o_orderkey % 4 > 0 then o_custkey end as census_count", "o_orderstatus = 'F' as threat_coverage",
                                               "o_orderdate as period_start", "o_orderdate as period_end", "case when o_custkey % 9 = 0 then ' ' else 'survey' end as source")
    return _joined(validate.validate(df, "focal_field_evidence")).select("id", "reject_reasons")


LOCI = [(f"species {s}", f"Locus-{n}", 2 if n < 7 else 1) for s in range(2) for n in range(1, 8)]
EDNA_ROWS = """(select l_orderkey as sample, l_linenumber as line, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as source_row,
  l_suppkey, l_partkey, l_quantity, l_returnflag from lineitem)"""


@query("validate_edna", """
select l_orderkey, l_linenumber, l_partkey, concat_ws(',', case when l_quantity > 49 then 'sample_id' end,
  case when l_discount > 0.09 then 'latitude' end, case when l_tax >= 0.08 then 'coordinate_bounds' end, case when l_tax >= 0.08 then 'study_area' end,
  case when l_suppkey % 3 = 2 then 'no_approved_loci' end,
  case when l_quantity < 2 then 'allele_count' when l_suppkey % 3 < 2 and l_linenumber = 7 then 'allele_count' end,
  case when l_returnflag = 'R' then 'sequence' end) as reject_reasons from lineitem""")
def _(spark, sf):
    loci = spark.createDataFrame(LOCI, "target_species string, locus_name string, max_allele_count int")
    df = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "case when l_quantity > 49 then ' ' else 's' end as sample_id", "'p' as project_id",
        "concat('Species_', cast(l_suppkey % 3 as string)) as target_species", "concat('locus-', cast(l_linenumber as string)) as locus_name",
        "date_format(l_shipdate, 'yyyy-MM-dd') as collection_date", "case when l_discount > 0.09D then 'north' else '1.5' end as latitude",
        "case when l_tax >= 0.08D then '190' else '36.25' end as longitude", "case when l_quantity < 2 then '1.5' else '2' end as allele_count",
        "case when l_returnflag = 'R' then 'ACGU' else 'ac gtn' end as sequence")
    return _joined(validate.validate_edna(df, loci)).select("l_orderkey", "l_linenumber", "l_partkey", "reject_reasons")


@query("validate_edna_batch", f"""
with r as (select *, 'species-' || l_suppkey % 3 as sp from {EDNA_ROWS}),
f as (select sample, arg_min(sp, source_row) as first_sp from r group by 1),
a as (select r.*, sp = first_sp as agrees from r join f using (sample)),
k as (select sample, line, min(source_row) as kept from a where agrees group by 1, 2)
select a.source_row, case when a.source_row = kept then '' when agrees or kept < a.source_row then 'duplicate_locus' else 'conflicting_profile' end as reject_reasons
from a left join k on k.sample = a.sample and k.line = a.line""")
def _(spark, sf):
    from fieldlake.operators import scale
    rows = table(spark, sf, "lineitem").withColumn("k", F.lit(0))
    rows = scale.row_numbers(rows, ["k"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], "l_orderkey", "source_row")
    df = rows.selectExpr("cast(source_row as bigint) as source_row", "'h' as source_hash", "'P' as project_id", "concat('S', cast(l_orderkey as string)) as sample_id",
                         "concat('Locus', cast(l_linenumber as string)) as locus_name", "concat('Species-', cast(l_suppkey % 3 as string)) as target_species",
                         "cast('2024-01-01' as date) as collection_date", "1.0D as latitude", "2.0D as longitude")
    return _joined(validate.validate_edna_batch(df)).select("source_row", "reject_reasons")


@query("approved_locus", """
select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 3 = 2 then null when l_linenumber < 7 then 2 else 1 end as max_allele_count from lineitem""")
def _(spark, sf):
    loci = spark.createDataFrame(LOCI, "target_species string, locus_name string, max_allele_count int")
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "concat('SPECIES ', cast(l_suppkey % 3 as string)) as target_species",
                                                 "concat('locus-', cast(l_linenumber as string)) as locus_name")
    return validate.approved_locus(df, loci).select("l_orderkey", "l_linenumber", "l_partkey", "max_allele_count")


@query("validate_bundle", """
select count(*) as cells, 0::bigint as bad_coordinates, count(*) filter (s_suppkey % 7 = 0 and s_suppkey % 5 > 0) as bad_votes,
  count(*) filter (s_suppkey % 5 = 0 and s_suppkey % 7 > 0) as bad_status, count(*) filter (s_acctbal > 9000) as bad_loss, count(*) filter (s_suppkey % 5 > 0) as usable,
  concat_ws(',', case when count(*) filter (s_suppkey % 7 = 0 and s_suppkey % 5 > 0) > 0 then 'cell_vote' end,
    case when count(*) filter (s_suppkey % 5 = 0 and s_suppkey % 7 > 0) > 0 then 'cell_status' end,
    case when count(*) filter (s_acctbal > 9000) > 0 then 'cell_loss' end) as reject_reasons from supplier""")
def _(spark, sf):
    cells = table(spark, sf, "supplier").selectExpr(
        "0.5D as lat", "1.5D as lon", "case when s_suppkey % 7 > 0 then 0.5D end as vote",
        "case when s_suppkey % 5 > 0 then 'suitable_model_domain' else 'nodata' end as status", "case when s_acctbal > 9000 then 1.5D else 0.5D end as loss")
    meta = spark.sql("""select 1 as version, 'Semnopithecus ajax' as species, 1000 as cell_size_m, 2022 as loss_year,
        named_struct('auc', 0.95D, 'tss', 0.8D, 'members', array(named_struct('auc', 0.92D, 'tss', 0.75D))) as metrics""")
    return _joined(validate.validate_bundle(cells, meta, "Semnopithecus ajax", 2026))


@query("normalise_mac", "select id, sensor_mac, true as valid, sensor_mac like '%:11' as is_eleven from v_sensor_readings")
def _(spark, sf):
    from fieldlake.functions import text
    raw = F.concat(F.lit(" "), F.lower(F.replace("sensor_mac", F.lit(":"), F.lit("-"))))
    df = view(spark, sf, "v_sensor_readings").select("id", text.normalise_mac(raw).alias("sensor_mac"))
    return df.select("id", "sensor_mac", text.is_mac("sensor_mac").alias("valid"), F.col("sensor_mac").endswith(":11").alias("is_eleven"))


@query("split_valid", """
select 'valid' as part, count(*) as n from v_sensor_readings where ambient_temperature_c between -90 and 70
union all select 'rejected', count(*) from v_sensor_readings where not ambient_temperature_c between -90 and 70""")
def _(spark, sf):
    good, bad = validate.split_valid(validate.validate(view(spark, sf, "v_sensor_readings").drop("h3_cell"), "sensor_readings"))
    count = F.count(F.lit(1)).alias("n")
    return good.agg(count).select(F.lit("valid").alias("part"), "n").unionByName(bad.agg(count).select(F.lit("rejected").alias("part"), "n"))


@query("filter_layer", """
select id from v_detections where source_type = 'ACOUSTIC' and detected_epoch_ms >= 1704067200000 and detected_epoch_ms < 1705363200000 and species_id = 3
  and category = 'immediate_threat' and latitude between -2.4 and -1.8 and longitude between 34.1 and 35.0""")
def _(spark, sf):
    df = view(spark, sf, "v_detections")
    return filters.filter_layer(df, "acoustic", 1704067200000, 1705363200000, species=3, category="immediate_threat",
                                bbox=(-2.4, -1.8, 34.1, 35.0)).select("id")


@query("bbox_across_antimeridian", "select id from v_detections where latitude between -2.4 and -1.8 and (longitude >= 35 or longitude <= 34.3)")
def _(spark, sf):
    return filters.filter_layer(view(spark, sf, "v_detections"), "detections", bbox=(-2.4, -1.8, 35.0, 34.3)).select("id")


@query("critical_and_poaching", f"""
select id, category = 'immediate_threat' and confidence >= 0.5 as critical,
  class_name = 'gunshot' and confidence >= 0.6 and ({LIMIT} - detected_epoch_ms) / 3600000.0 between 0 and 48 as poaching from v_detections""")
def _(spark, sf):
    return view(spark, sf, "v_detections").select("id", filters.is_critical().alias("critical"), filters.is_poaching(F.lit(LIMIT)).alias("poaching"))


@query("active_zones", "select id from v_habitat_zones where active and (species_id is null or species_id = 2)")
def _(spark, sf):
    return filters.active_zones(view(spark, sf, "v_habitat_zones"), 2).select("id")


@query("features_at", "select o_orderkey as id from orders where MS(o_orderdate) <= 900000000000 and (o_custkey % 3 = 0 or MS(o_orderdate) + o_custkey * 86400000 > 900000000000)")
def _(spark, sf):
    from fieldlake.functions.timex import epoch_ms
    df = table(spark, sf, "orders").withColumn("detected_epoch_ms", epoch_ms("o_orderdate")).withColumn(
        "removed_epoch_ms", F.when(F.col("o_custkey") % 3 > 0, F.col("detected_epoch_ms") + F.col("o_custkey") * 86_400_000))
    return filters.features_at(df, 900_000_000_000).select(F.col("o_orderkey").alias("id"))


@query("species_equality", "select id from v_species where lower(scientific_name) = lower('aSiA')")
def _(spark, sf):
    from fieldlake.functions import text
    return view(spark, sf, "v_species").filter(text.species_eq("scientific_name", " aSiA ")).select("id")


@query("filter_reports", """
select a.id from v_risk_assessments a join v_species s on s.id = a.species_id
where upper(scientific_name) = 'EUROPE' and conservation_risk_index >= 60 and conservation_risk_index <= 80 and h3_cell = 'cell-8'""")
def _(spark, sf):
    from fieldlake.functions.mathx import escalation_level
    df = view(spark, sf, "v_risk_assessments").withColumn("escalation_level", escalation_level("conservation_risk_index"))
    return filters.filter_reports(df, view(spark, sf, "v_species"), species_name="europe", cell="CELL-8", tier="high", min_cri=60).select("id")


@query("public_view", "select id, cast(species_id as bigint) as species_id, scientific_name as species_name from v_telemetry t left join (select id as sid, scientific_name from v_species) s on s.sid = t.species_id")
def _(spark, sf):
    out = filters.public_view(view(spark, sf, "v_telemetry"), "telemetry", view(spark, sf, "v_species"))
    assert "recorded_epoch_ms" not in out.columns
    return out.select("id", "species_id", F.col("species.scientific_name").alias("species_name"))


@query("decode_rows", "select event_id, MS(ts) as at_ms, value as number, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def _(spark, sf):
    from fieldlake.functions.timex import epoch_ms
    raw = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), F.col("value").cast("string").alias("number"), "props")
    out = filters.decode_rows(raw, timestamps=["at"], numbers=["number"], json_columns=["props"])
    return out.select("event_id", epoch_ms("at").alias("at_ms"), "number", F.try_variant_get("props", "$.k", "bigint").alias("k"))


@query("report_view", """
select id, species_id, h3_cell, case when conservation_risk_index < 20 then 'LOW' when conservation_risk_index < 40 then 'GUARDED'
  when conservation_risk_index < 60 then 'ELEVATED' when conservation_risk_index <= 80 then 'HIGH' else 'CRITICAL' end as tier,
  round(intervention_priority_index, 8) as ipi, 'Narrative o...' as excerpt, 12 + length(id::varchar) as narrative_characters from v_risk_assessments""")
def _(spark, sf):
    from fieldlake.functions.mathx import escalation_level
    df = view(spark, sf, "v_risk_assessments").withColumn("escalation_level", escalation_level("conservation_risk_index")).withColumn(
        "narrative_report", F.concat(F.lit("Narrative of"), F.col("id").cast("string")))
    out = filters.report_view(df, 11)
    return out.select("id", "species.id", "scope.h3_cell", F.col("scores.escalation_tier").alias("tier"), F.round("scores.intervention_priority_index", 8).alias("ipi"),
                      F.col("narrative_excerpt").alias("excerpt"), F.col("narrative_characters").cast("bigint").alias("narrative_characters")).toDF(
        "id", "species_id", "h3_cell", "tier", "ipi", "excerpt", "narrative_characters")
