"""Risk model over the stand-in tables."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import DOMAINS, RISK
from fieldlake.operators import joins
from fieldlake.plans import risk
from fieldlake.registry.core import query, rounded
from fieldlake.registry.q_spatial import hav
from fieldlake.registry.views import table, view

# six scores, a trend and a genetic size derived from each order
SCORES = ("o_custkey % 101", "o_orderkey % 97", "(o_custkey * 7 + o_orderkey) % 101", "(o_custkey + o_orderkey * 3) % 89", "(o_orderkey * 11) % 101", "(o_custkey * 13) % 101")
WIDE = ", ".join(f"cast({e} as double) as {d}_subscore" for d, e in zip(DOMAINS, SCORES)) + """,
  o_orderkey as scope_id, cast(o_custkey % 5 + 1 as bigint) as species_id, concat('cell-', cast(o_custkey % 20 as string)) as h3_cell,
  case when o_orderkey % 4 > 0 then cast(o_custkey % 900 as double) end as effective_population_size,
  case when o_orderkey % 3 > 0 then cast(o_custkey % 60 as double) / 100 end as expected_heterozygosity, 50.0 as critical_ne_threshold,
  cast(o_orderkey % 41 - 20 as double) / 10 as risk_momentum_per_day, cast(-2.5 + (o_custkey % 50) * 0.02 as double) as latitude, cast(34.0 + (o_orderkey % 37) * 0.02 as double) as longitude,
  o_orderkey % 7 = 0 as immediate_poaching_threat"""
WEIGHTS = ("0.25::double", "0.15::double", "0.25::double", "0.10::double", "0.15::double", "0.10::double")
CRI = " + ".join(f"{w} * {d}_subscore" for d, w in zip(DOMAINS, WEIGHTS))
LEVEL = "case when cri < 20 then 1 when cri < 40 then 2 when cri < 60 then 3 when cri <= 80 then 4 else 5 end"
DOMINANT = "(" + "case " + " ".join(f"when {w} * {d}_subscore >= " + f"greatest({', '.join(f'{v} * {e}_subscore' for e, v in zip(DOMAINS, WEIGHTS))}) - 1e-12 then '{d}'" for d, w in zip(DOMAINS, WEIGHTS)) + " end)"
BASE = f"w as (select {WIDE} from orders), c as (select *, {CRI} as cri from w)"


def _wide(spark, sf):
    return table(spark, sf, "orders").selectExpr(*[x.strip() for x in WIDE_ITEMS])


def _split(text):
    depth, part, out = 0, "", []
    for ch in text:
        depth += {"(": 1, ")": -1}.get(ch, 0)
        if ch == "," and depth == 0:
            out.append(part)
            part = ""
        else:
            part += ch
    return [*out, part]


WIDE_ITEMS = _split(WIDE)


@query("conservation_risk_index", f"with {BASE} select scope_id, round(cri, 6) as cri, ({LEVEL})::int as escalation_level from c")
def _(spark, sf):
    df = risk.conservation_risk_index(_wide(spark, sf))
    return rounded(df.select("scope_id", F.col("conservation_risk_index").alias("cri"), "escalation_level"), "cri", digits=6)


@query("contributions", f"""
with {BASE} select scope_id, {DOMINANT} as dominant_domain, {", ".join(f"round({w} * {d}_subscore, 6) as {d}_contribution" for d, w in zip(DOMAINS, WEIGHTS))} from c""")
def _(spark, sf):
    df = risk.contributions(risk.conservation_risk_index(_wide(spark, sf)))
    assert "percentages" in df.columns
    each = [f"{d}_contribution" for d in DOMAINS]
    return rounded(df.select("scope_id", "dominant_domain", *each), *each, digits=6)


PENALTY = """case when effective_population_size < 50 then 100.0 when effective_population_size is null and expected_heterozygosity is null then genetics_subscore
  when effective_population_size is null then 100 * greatest(0, least(1, 1 - expected_heterozygosity / 0.5))
  when expected_heterozygosity is null then 100 * least(1, (1 - pow(1 - 1 / (2 * effective_population_size), 10)) / 0.1)
  else 0.6 * 100 * least(1, (1 - pow(1 - 1 / (2 * effective_population_size), 10)) / 0.1) + 0.4 * 100 * greatest(0, least(1, 1 - expected_heterozygosity / 0.5)) end"""


@query("inbreeding_penalty", f"with {BASE} select scope_id, round({PENALTY}, 6) as inbreeding_penalty_index, coalesce(effective_population_size < 50, false) as critical_inbreeding_risk from c")
def _(spark, sf):
    df = risk.inbreeding_penalty(_wide(spark, sf))
    return rounded(df.select("scope_id", "inbreeding_penalty_index", "critical_inbreeding_risk"), "inbreeding_penalty_index", digits=6)


IPI = f"cri * greatest(0.5, least(2.0, 1 + 2.0 * risk_momentum_per_day / 100 * 30)) * (1.2 - 0.4 * least(1, {hav('latitude', 'longitude', '-2.0', '34.4')} / 50000))"


@query("intervention_priority", f"""
with {BASE}, i as (select *, {IPI} as ipi from c)
select scope_id, round(ipi, 6) as ipi, case when ipi >= 80 then 'IMMEDIATE' when ipi >= 60 then 'HIGH' when ipi >= 40 then 'ELEVATED' when ipi >= 20 then 'ROUTINE' else 'MONITOR' end as tier from i""")
def _(spark, sf):
    cfg = replace(RISK, outposts=(("gate", -2.0, 34.4),))
    df = risk.intervention_priority(risk.conservation_risk_index(_wide(spark, sf), cfg), cfg)
    return rounded(df.select("scope_id", F.col("intervention_priority_index").alias("ipi"), F.col("intervention_priority_tier").alias("tier")), "ipi", digits=6)


def _directed(spark, sf):
    df = risk.inbreeding_penalty(risk.contributions(risk.conservation_risk_index(_wide(spark, sf).withColumn("threat_subscore", F.col("threat_subscore") / 2 + 50)
                                                                               .withColumn("genetics_subscore", F.col("genetics_subscore") / 2 + 60))))
    return df.withColumn("missing_domains", F.array().cast("array<string>")).withColumn("scientific_name", F.lit("x"))


DIRECT = f"""w0 as (select {WIDE} from orders), w as (select * replace (threat_subscore / 2 + 50 as threat_subscore, genetics_subscore / 2 + 60 as genetics_subscore) from w0),
c as (select *, {CRI} as cri from w), d as (select *, {LEVEL} as level, {DOMINANT} as driver, coalesce(effective_population_size < 50, false) as inbred from c)"""


@query("interventions", f"""
with {DIRECT}, a as (select scope_id, immediate_poaching_threat as p, driver, cri, inbred, list_concat(
  case level when 1 then ['ROUTINE_MONITORING'] when 2 then ['TARGETED_PATROLS'] when 3 then ['HABITAT_RESTORATION', 'GENETIC_ASSAY'] when 4 then ['CAPTIVE_BREEDING_PREP'] else ['GENETIC_RESCUE'] end,
  list_concat(case when cri < 80 then [] when driver = 'threat' and not p then ['RANGER_DISPATCH', 'DRONE_DEPLOYMENT'] when driver = 'genetics' then ['GENETIC_RESCUE', 'CAPTIVE_BREEDING_PREP']
    when driver in ('habitat', 'climate') then ['HABITAT_RESTORATION'] when driver = 'population' then ['TARGETED_PATROLS'] when driver = 'behavior' then ['DRONE_DEPLOYMENT'] else [] end,
  list_concat(case when p then ['RANGER_DISPATCH', 'DRONE_DEPLOYMENT'] else [] end, case when inbred then ['GENETIC_RESCUE'] else [] end))) as l from d p(a) )
select scope_id, array_to_string(list_sort(list_distinct(l)), ',') as actions, case when p then 'CRITICAL' when cri >= 80 and driver = 'threat' then 'HIGH' end as priority from a""".replace(" from d p(a) )", " from d)"))
def _(spark, sf):
    df = risk.interventions(_directed(spark, sf))
    return df.select("scope_id", F.array_join(F.array_sort("actions"), ",").alias("actions"), F.col("dispatch_priority").alias("priority"))


@query("mitigations", f"""
with {DIRECT} select scope_id, coalesce(nullif(concat_ws(',', case when inbred or genetics_subscore >= 70 then 'GENETIC_RESCUE' end,
  case when behavior_subscore >= 70 and scope_id % 2 = 0 then 'NEURAL_CONSERVATION_TRAINING' end, case when behavior_subscore >= 70 and scope_id % 2 = 0 then 'HERD_REINTEGRATION' end,
  case when immediate_poaching_threat or driver = 'threat' or threat_subscore >= 70 then 'ANTI_POACHING_DRONE_DEPLOYMENT' end), ''), 'CONTINUED_MONITORING') as mitigations,
  case when immediate_poaching_threat then 'poachingResponse' when inbred then 'geneticRescue' else 'standardNarrative' end as route from d""")
def _(spark, sf):
    df = _directed(spark, sf).withColumn("behavior_components", F.struct(F.lit(0.2).alias("elder_absence"), F.when(F.col("scope_id") % 2 == 0, 1).otherwise(0).alias("orphan_days")))
    out = risk.risk_route(risk.mitigations(df))
    return out.select("scope_id", F.array_join("mitigations", ",").alias("mitigations"), "route")


@query("primary_scores", f"""
with w as (select {WIDE} from orders)
select scope_id, 'population' as domain, case when scope_id % 3 > 0 then population_subscore end as risk, case when scope_id % 3 = 0 then 'unavailable' else 'available' end as status from w
union all select scope_id, 'habitat', habitat_subscore, 'available' from w union all select scope_id, 'threat', threat_subscore, 'available' from w
union all select scope_id, 'genetics', genetics_subscore, 'available' from w""")
def _(spark, sf):
    gap = F.when(F.col("scope_id") % 3 == 0, F.array(F.lit("population"))).otherwise(F.array().cast("array<string>"))
    return risk.primary_scores(_wide(spark, sf).withColumn("missing_domains", gap)).drop("label")


START, END = 1704067200000, 1706659200000
SCOPES = f"""(select n_nationkey::bigint as scope_id, (n_nationkey % 5 + 1)::bigint as species_id, 'cell-' || (n_nationkey % 12) as h3_cell, cast(-2.3 + (n_nationkey % 5) * 0.15 as double) as lat,
  cast(34.1 + (n_nationkey % 7) * 0.1 as double) as lon, {START}::bigint as s, {END}::bigint - (n_nationkey % 3) * 432000000 as e from nation)"""


def scopes(spark, sf):
    df = table(spark, sf, "nation").selectExpr(
        "cast(n_nationkey as bigint) as scope_id", "cast(n_nationkey % 5 + 1 as bigint) as species_id", "concat('cell-', cast(n_nationkey % 12 as string)) as h3_cell",
        "cast(-2.3 + (n_nationkey % 5) * 0.15 as double) as latitude", "cast(34.1 + (n_nationkey % 7) * 0.1 as double) as longitude",
        f"timestamp_millis({START}) as period_start", f"timestamp_millis({END} - (n_nationkey % 3) * 432000000) as period_end")
    return risk._timed(df)


FOUND = f"""found as (select sc.scope_id, sc.species_id as scope_species, sc.e, d.* from v_detections d join {SCOPES} sc on detected_epoch_ms between sc.s and sc.e
  and ((d.species_id = sc.species_id or category = 'immediate_threat') and {hav('d.latitude', 'd.longitude', 'sc.lat', 'sc.lon')} <= 50000 or (d.latitude is null and d.species_id = sc.species_id)))"""


@query("scoped_detections", f"""
with {FOUND} select scope_id, count(*) as detections, count(*) filter (category = 'immediate_threat') as threats, count(*) filter (latitude is null) as unlocated from found group by 1""")
def _(spark, sf):
    df = risk.scoped_detections(scopes(spark, sf), view(spark, sf, "v_detections"))
    return df.groupBy("scope_id").agg(F.count(F.lit(1)).alias("detections"), F.count(F.when(F.col("category") == "immediate_threat", 1)).alias("threats"),
                                      F.count(F.when(F.col("latitude").isNull(), 1)).alias("unlocated"))


@query("lineage", f"""
with {FOUND}, t as (select sc.scope_id, t.id from v_telemetry t join {SCOPES} sc on t.species_id = sc.species_id and recorded_epoch_ms between sc.s and sc.e
  and {hav('t.latitude', 't.longitude', 'sc.lat', 'sc.lon')} <= 50000),
r as (select sc.scope_id, r.id from v_sensor_readings r join {SCOPES} sc on sc.h3_cell = r.h3_cell and recorded_epoch_ms between sc.s and sc.e where quality_flag <> 'INVALID'),
u as (select 'detections' as table_name, scope_id, id from found union all select 'telemetry', * from t union all select 'sensor_readings', * from r)
select scope_id, table_name, count(*) as rows, sum(id)::bigint as ids from u where id <> 0 group by 1, 2""")
def _(spark, sf):
    """All source rows behind every assessment, found again by the pages of their ids."""
    tables = {"telemetry": view(spark, sf, "v_telemetry"), "detections": view(spark, sf, "v_detections"), "sensor_readings": view(spark, sf, "v_sensor_readings")}
    pages = risk.lineage(scopes(spark, sf).drop("start_ms", "end_ms", "window_start_ms", "window_end_ms"), tables, page=500)
    counted = [df.groupBy("scope_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids")).withColumn("table_name", F.lit(name))
               for name, df in joins.hydrate_pages(pages, tables).items()]
    return reduce(DataFrame.unionByName, counted)


@query("threat_subscore", f"""
with {FOUND}, t as (select scope_id, scope_species, id, latitude, longitude, (case class_name when 'gunshot' then 1.0 when 'chainsaw' then 0.7 else 0.5 end) * confidence * pow(2, -((e - detected_epoch_ms) / 1000.0) / 172800.0) as p
  from found where category = 'immediate_threat' and e - detected_epoch_ms between 0 and 2592000000),
z as (select t.scope_id, t.id, p, coalesce(max(case when z.id is null then null when z.zone_type = 'BREEDING' then 3.0 when z.zone_type = 'WATER_SOURCE' then 2.5 else 1.5 end), 1.0) as f
  from t left join v_habitat_zones z on z.active and (z.species_id is null or z.species_id = t.scope_species) and {hav('t.latitude', 't.longitude', 'z.latitude', 'z.longitude')} <= z.radius_m group by 1, 2, 3),
g as (select scope_id, sum(p * f) as pressure, count(*) as n from z group by 1)
select scope_id, n as event_count, round(pressure, 4) as pressure, round(least(100, 100 * (1 - exp(-pressure))), 6) as threat from g""")
def _(spark, sf):
    area = scopes(spark, sf)
    found = risk.scoped_detections(area, view(spark, sf, "v_detections"))
    df = risk.threat_subscore(area, risk.threat_events(found, None), view(spark, sf, "v_habitat_zones"))
    df = df.select("scope_id", "threat_components.event_count", F.col("threat_components.decayed_pressure").alias("pressure"), "threat")
    return rounded(rounded(df, "pressure"), "threat", digits=6)


@query("climate_inputs", f"""
select sc.scope_id, recorded_epoch_ms // 86400000 as day_index, round(avg(ambient_temperature_c), 4) as ambient_temperature_c from v_sensor_readings r join {SCOPES} sc on sc.h3_cell = r.h3_cell
  and recorded_epoch_ms between sc.s and sc.e where quality_flag <> 'INVALID' group by 1, 2""")
def _(spark, sf):
    from fieldlake.functions.timex import day_index
    df = risk.scoped_readings(scopes(spark, sf), view(spark, sf, "v_sensor_readings"))
    return rounded(df.groupBy("scope_id", day_index("recorded_epoch_ms").alias("day_index")).agg(F.avg("ambient_temperature_c").alias("ambient_temperature_c")), "ambient_temperature_c")


@query("with_previous", f"""
select sc.scope_id, max(period_end_epoch_ms) as previous_end_ms from (select * replace (s - 883612800000 + 62208000000 as s, 883612800000::bigint as e, 'cell-' || (scope_id % 5 + (scope_id % 4) * 5) as h3_cell) from {SCOPES}) sc
join v_risk_assessments a on a.species_id = sc.species_id and a.h3_cell = sc.h3_cell and a.period_end_epoch_ms < sc.e and a.period_end_epoch_ms >= sc.e - 7776000000 group by 1""")
def _(spark, sf):
    wide = scopes(spark, sf).withColumn("end_ms", F.lit(883612800000)).withColumn("h3_cell", F.expr("concat('cell-', cast(scope_id % 5 + (scope_id % 4) * 5 as string))"))
    df = risk.with_previous(wide, view(spark, sf, "v_risk_assessments"))
    return df.select("scope_id", "previous_end_ms").filter("previous_end_ms is not null")


@query("assess")
def _(spark, sf):
    """Full assessment of 25 scopes; every score is checked on worked scenarios in tests."""
    tables = {"species": view(spark, sf, "v_species"), "telemetry": view(spark, sf, "v_telemetry"), "detections": view(spark, sf, "v_detections"),
              "sensor_readings": view(spark, sf, "v_sensor_readings"), "habitat_zones": view(spark, sf, "v_habitat_zones"), "risk_assessments": view(spark, sf, "v_risk_assessments")}
    base = scopes(spark, sf).drop("start_ms", "end_ms", "window_start_ms", "window_end_ms")
    df = risk.assess(base, tables)
    return df.select("scope_id", "species_id", "h3_cell", F.round("conservation_risk_index", 4).alias("conservation_risk_index"), "escalation_level", "dominant_domain",
                     F.array_join("missing_domains", ",").alias("missing_domains"), F.array_join("actions", ",").alias("actions"), "narrative_report")


@query("resolve_scopes", """
select n_nationkey as scope_id, case when n_nationkey % 3 = 0 then 37.77 when n_nationkey % 3 = 1 then 1.5 else 2.5 end::double as lat,
  concat_ws(',', case when n_nationkey % 5 = 0 then 'window_order' end, case when n_nationkey % 5 = 1 then 'window_length' end) as reject_reasons,
  case when n_nationkey % 3 = 0 then '872830828ffffff' else '' end as cell from nation""")
def _(spark, sf):
    df = table(spark, sf, "nation").selectExpr(
        "n_nationkey as scope_id", "case when n_nationkey % 3 = 0 then ' 872830828FFFFFF' end as h3_cell", "case when n_nationkey % 3 = 1 then 1.5D end as latitude",
        "case when n_nationkey % 3 = 1 then 30.0D end as longitude", "case when n_nationkey % 3 = 2 then 2.0D end as min_lat", "case when n_nationkey % 3 = 2 then 3.0D end as max_lat",
        "case when n_nationkey % 3 = 2 then 10.0D end as min_lon", "case when n_nationkey % 3 = 2 then 11.0D end as max_lon", "timestamp'2024-06-01' as end_time",
        "case n_nationkey % 5 when 0 then timestamp'2024-07-01' when 1 then timestamp'2022-01-01' end as start_time", "cast(null as double) as lookback_days")
    out = risk.resolve_scopes(df)
    asked = F.when(F.col("scope_id") % 3 == 0, F.col("h3_cell")).otherwise("")
    return out.select("scope_id", F.round("latitude", 2).alias("lat"), F.array_join("reject_reasons", ",").alias("reject_reasons"), asked.alias("cell"))
