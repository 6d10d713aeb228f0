"""Stand-in views: the driver's tables renamed to the tables the operators read.

Each view is one SELECT valid in Spark and DuckDB except for ``MS(x)``, the rounded epoch
milliseconds of a timestamp.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_telemetry": ("events", """
select event_id as id, cast(user_id % 5 + 1 as bigint) as species_id, concat('animal-', cast(user_id as string)) as animal_id,
  concat('dev-', cast(user_id % 20 as string)) as device_id, MS(ts) as recorded_epoch_ms,
  cast(-2.50 + (user_id % 50) * 0.02 + (event_id % 97) * 0.0005 as double) as latitude,
  cast(34.00 + (user_id % 37) * 0.02 + (event_id % 89) * 0.0005 as double) as longitude,
  value as altitude, value / 10 as speed_kmh, props as physiological_metrics
from events"""),
    "v_detections": ("events", """
select event_id as id, case when event_id % 2 = 0 then 'ACOUSTIC' else 'VISION' end as source_type,
  cast(floor(event_id / 3.0) as bigint) as source_record_id, cast(event_id % 3 as int) as detection_index,
  concat('dev-', cast(user_id % 20 as string)) as device_id,
  case when user_id % 11 = 0 then null else cast(user_id % 5 + 1 as bigint) end as species_id,
  case event_type when 'error' then 'gunshot' when 'purchase' then 'chainsaw' when 'signup' then 'vehicle_engine'
    when 'click' then 'elephant' else 'elephant_carcass' end as class_name,
  case when event_type in ('error','purchase') then 'immediate_threat' when event_type = 'signup' then 'other'
    else 'target_wildlife' end as category,
  value - floor(value) as confidence, MS(ts) as detected_epoch_ms,
  case when user_id % 13 = 0 then null else cast(-2.50 + (user_id % 50) * 0.02 as double) end as latitude,
  case when user_id % 13 = 0 then null else cast(34.00 + (event_id % 60) * 0.02 as double) end as longitude,
  props as metadata
from events"""),
    "v_sensor_readings": ("events", """
select event_id as id, concat('AA:BB:CC:DD:00:', cast(10 + user_id % 40 as string)) as sensor_mac,
  concat('dev-', cast(user_id % 20 as string)) as device_id, MS(ts) as recorded_epoch_ms,
  concat('cell-', cast(user_id % 12 as string)) as h3_cell, value as ambient_temperature_c,
  case when event_id % 7 = 0 then null else cast(user_id % 101 as double) end as relative_humidity_percent,
  case when event_type = 'error' then 'INVALID' when event_type = 'signup' then 'SUSPECT' else 'VALID' end as quality_flag
from events"""),
    "v_edna_samples": ("lineitem", """
select concat('s-', cast(l_orderkey as string)) as sample_id, 'p-1' as project_id,
  concat('species-', cast(l_suppkey % 3 as string)) as target_species, cast(l_shipdate as date) as collection_date,
  concat('cell-', cast(l_suppkey % 4 as string)) as h3_cell, concat('locus-', cast(l_linenumber as string)) as locus_name,
  2 as allele_count, concat(l_returnflag, '/', l_linestatus) as allele_state
from lineitem"""),
    "v_risk_assessments": ("orders", """
select o_orderkey as id, cast(o_custkey % 5 + 1 as bigint) as species_id, concat('cell-', cast(o_custkey % 20 as string)) as h3_cell,
  MS(o_orderdate) as period_end_epoch_ms, least(100.0, o_totalprice / 5000) as conservation_risk_index,
  o_totalprice / 4000 as intervention_priority_index
from orders"""),
    "v_species": ("region", """
select cast(r_regionkey + 1 as bigint) as id, r_name as scientific_name, 50 as critical_ne_threshold, 500 as viable_ne_threshold
from region"""),
    "v_habitat_zones": ("supplier", """
select s_suppkey as id, case when s_suppkey % 4 = 0 then null else cast(s_suppkey % 5 + 1 as bigint) end as species_id,
  s_name as zone_name, case s_suppkey % 4 when 0 then 'BREEDING' when 1 then 'WATER_SOURCE' when 2 then 'CORRIDOR' else 'CORE_RANGE' end as zone_type,
  cast(-2.50 + (s_suppkey % 50) * 0.02 as double) as latitude, cast(34.00 + (s_suppkey % 37) * 0.02 as double) as longitude,
  cast(2000 + (s_suppkey % 5) * 1000 as double) as radius_m, s_acctbal > 0 as active
from supplier"""),
}

SPARK_MS = r"cast(round(unix_micros(cast(\1 as timestamp))/1000.0) as bigint)"
DUCK_MS = r"cast(round(epoch_us(\1)/1000.0) as bigint)"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Tables that grow with the data.
FACTS = ("events", "lineitem", "orders")


def dealt(df: DataFrame) -> DataFrame:
    """A table that is read by fewer tasks than the session can run, dealt out to all of them.

    The driver's tables are single Parquet row groups, which one task reads; a table with as many splits as there are cores stays as it is.
    """
    wide = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wide else df.repartition(wide)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    base, text = VIEWS[name]
    text = re.sub(r"MS\((\w+)\)", SPARK_MS, text).replace(f"from {base}", "from {src}")
    source = table(spark, sf, base)
    return spark.sql(text, src=dealt(source) if base in FACTS else source)


def duck(sql: str) -> str:
    """DuckDB text with the views it mentions in front and ``MS`` expanded."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    ctes = [f"{name} as ({VIEWS[name][1]})" for name in used]
    body = sql.strip()
    if ctes:
        opening = re.match(r"(?i)with\s+(recursive\s+)?", body)
        rest = ",\n" + body[opening.end():] if opening else "\n" + body
        body = f"with {'recursive ' if opening and opening[1] else ''}" + ",\n".join(ctes) + rest
    return re.sub(r"MS\((\w+)\)", DUCK_MS, body)
