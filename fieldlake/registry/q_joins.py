"""Joins, pages, rankings, alerts and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.operators import alerts, joins, topk, tracking
from fieldlake.registry.core import query, rounded
from fieldlake.registry.q_spatial import _grid
from fieldlake.registry.views import table, view


@query("attach_location", """
select id, d.location_id, case when d.latitude is null then 'MISSING_DEVICE_LOCATION' else 'VALID' end as validation_status
from v_detections e left join (select 'dev-' || s_suppkey as device_id, s_name as location_id, case when s_suppkey % 3 > 0 then s_acctbal / 1000 end as latitude from supplier) d
  on d.device_id = e.device_id where source_type = 'ACOUSTIC'""")
def _(spark, sf):
    devices = table(spark, sf, "supplier").selectExpr("concat('dev-', cast(s_suppkey as string)) as device_id", "s_name as location_id",
                                                      "case when s_suppkey % 3 > 0 then s_acctbal / 1000 end as latitude", "1.0D as longitude", "0.0D as altitude")
    windows = view(spark, sf, "v_detections").filter("source_type = 'ACOUSTIC'").select("id", "device_id")
    return joins.attach_location(windows, devices).select("id", "location_id", "validation_status")


@query("with_species_left", "select d.id, scientific_name from v_detections d left join v_species s on s.id = d.species_id")
def _(spark, sf):
    return joins.with_species(view(spark, sf, "v_detections"), view(spark, sf, "v_species")).select("id", "scientific_name")


@query("with_species_inner", "select t.id, scientific_name from v_detections t join v_species s on s.id = t.species_id")
def _(spark, sf):
    return joins.with_species(view(spark, sf, "v_detections"), view(spark, sf, "v_species"), "inner").select("id", "scientific_name")


@query("semi_species", "select id from v_risk_assessments where species_id in (select id from v_species where lower(scientific_name) = 'asia')")
def _(spark, sf):
    return joins.semi_species(view(spark, sf, "v_risk_assessments"), view(spark, sf, "v_species"), "Asia").select("id")


@query("with_baselines", "select a.id, s.scientific_name, case when critical_ne_threshold > 0 then critical_ne_threshold::double end as critical_ne_threshold from v_risk_assessments a left join v_species s on s.id = a.species_id")
def _(spark, sf):
    scopes = view(spark, sf, "v_risk_assessments").select("id", "species_id")
    return joins.with_baselines(scopes, view(spark, sf, "v_species")).select("id", "scientific_name", "critical_ne_threshold")


ACOUSTIC = "(select id * 3 as id, detected_epoch_ms, class_name, category, confidence, latitude, longitude from v_detections)"


def _acoustic(spark, sf):
    return view(spark, sf, "v_detections").selectExpr(
        "id * 3 as id", "detected_epoch_ms as start_epoch_ms", "class_name", "category", "confidence", "latitude", "longitude")


@query("drop_linked", f"select id from {ACOUSTIC} a where id not in (select source_record_id from v_detections where source_type = 'ACOUSTIC' and source_record_id is not null)")
def _(spark, sf):
    return joins.drop_linked(_acoustic(spark, sf), view(spark, sf, "v_detections")).select("id")


@query("union_threats", f"""
select detected_epoch_ms, class_name, source_type, round(confidence, 4) as confidence, id as record_id from v_detections where category = 'immediate_threat'
union all select detected_epoch_ms, class_name, 'ACOUSTIC', round(confidence, 4), null from {ACOUSTIC}
where category = 'immediate_threat' and id not in (select source_record_id from v_detections where source_type = 'ACOUSTIC' and source_record_id is not null)""")
def _(spark, sf):
    df = joins.union_threats(view(spark, sf, "v_detections"), _acoustic(spark, sf))
    return rounded(df.drop("latitude", "longitude"), "confidence")


EVIDENCE = """(select (o_custkey % 5 + 1)::bigint as species_id, 'cell-' || (o_custkey % 20) as h3_cell, o_orderdate::date as ps, o_orderdate::date + (o_custkey % 30)::int as pe,
  case when o_orderkey % 3 > 0 then o_orderkey end as census, o_orderstatus = 'F' as cover, o_orderpriority || o_orderkey as source from orders)"""
SCOPES = "(select (n_nationkey)::bigint as scope_id, (n_nationkey % 5 + 1)::bigint as species_id, 'cell-' || ((n_nationkey % 5) + (n_nationkey % 4) * 5) as h3_cell, date '1996-01-01' as ps, date '1997-01-15' as pe from nation)"


def _evidence(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "cast(o_custkey % 5 + 1 as bigint) as species_id", "concat('cell-', cast(o_custkey % 20 as string)) as h3_cell", "cast(o_orderdate as date) as period_start",
        "date_add(cast(o_orderdate as date), cast(o_custkey % 30 as int)) as period_end", "case when o_orderkey % 3 > 0 then o_orderkey end as census_count",
        "o_orderstatus = 'F' as threat_coverage", "concat(o_orderpriority, cast(o_orderkey as string)) as source")


def _scopes(spark, sf, start="1996-01-01", end="1997-01-15"):
    return table(spark, sf, "nation").selectExpr("cast(n_nationkey as bigint) as scope_id", "cast(n_nationkey % 5 + 1 as bigint) as species_id",
                                                 "concat('cell-', cast((n_nationkey % 5) + (n_nationkey % 4) * 5 as string)) as h3_cell",
                                                 f"timestamp'{start}' as period_start", f"timestamp'{end}' as period_end")


@query("latest_census", f"""
select scope_id, census as verified_census_count from (select s.scope_id, e.census, row_number() over (partition by s.scope_id order by e.pe desc, e.ps desc, e.source) as rn
  from {SCOPES} s join {EVIDENCE} e on e.species_id = s.species_id and e.h3_cell = s.h3_cell and e.ps >= s.ps and e.pe <= s.pe where e.census is not null) where rn = 1""")
def _(spark, sf):
    return joins.latest_census(_scopes(spark, sf), _evidence(spark, sf))


@query("has_coverage", f"""
select scope_id from {SCOPES.replace("date '1997-01-15'", "date '1996-01-05'")} s where exists (select 1 from {EVIDENCE} e where e.species_id = s.species_id and e.h3_cell = s.h3_cell and cover and e.ps <= s.ps and e.pe >= s.pe)""")
def _(spark, sf):
    return joins.has_coverage(_scopes(spark, sf, end="1996-01-05"), _evidence(spark, sf)).select("scope_id")


@query("hydrate", """
with r as (select o_custkey as report_id, list(o_orderkey order by o_orderkey)[1:50] as ids from orders group by 1)
select report_id, t.id, t.animal_id from (select report_id, unnest(ids) as id from r) x join v_telemetry t on t.id = x.id""")
def _(spark, sf):
    reports = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.create_map(F.lit("telemetry"), F.array_sort(F.collect_list("o_orderkey"))).alias("record_ids"))
    return joins.hydrate(reports, {"telemetry": view(spark, sf, "v_telemetry"), "orders": table(spark, sf, "orders")}, 50)["telemetry"].select("report_id", "id", "animal_id")


@query("drop_neighbours", """
with g as (select distinct l_orderkey % 600 as r, l_partkey % 600 as c from lineitem), p as (select distinct s_suppkey * 7 % 600 as r, s_nationkey * 20 as c from supplier)
select r as row, c as col from g where not exists (select 1 from p where abs(p.r - g.r) <= 1 and abs(p.c - g.c) <= 1)""")
def _(spark, sf):
    cells = table(spark, sf, "lineitem").selectExpr("l_orderkey % 600 as row", "l_partkey % 600 as col").distinct()
    near = table(spark, sf, "supplier").selectExpr("s_suppkey * 7 % 600 as row", "cast(s_nationkey * 20 as bigint) as col").distinct()
    return joins.drop_neighbours(cells, near)


@query("assemble", """
select s.id as scope_id, t.fixes, d.detections, r.assessments from v_species s left join (select species_id, count(*) as fixes from v_telemetry group by 1) t on t.species_id = s.id
left join (select species_id, count(*) as detections from v_detections group by 1) d on d.species_id = s.id left join (select species_id, count(*) as assessments from v_risk_assessments group by 1) r on r.species_id = s.id""")
def _(spark, sf):
    def count(name, label):
        return view(spark, sf, name).groupBy(F.col("species_id").alias("scope_id")).agg(F.count(F.lit(1)).alias(label))
    return joins.assemble(view(spark, sf, "v_species").select(F.col("id").alias("scope_id")), count("v_telemetry", "fixes"),
                          count("v_detections", "detections"), count("v_risk_assessments", "assessments"))


@query("species_with_records", """
select species_id, ((rn - 1) // 100)::bigint as page, count(*)::int as records, min(recorded_epoch_ms) as first_ms, max(recorded_epoch_ms) as last_ms
from (select *, row_number() over (partition by species_id order by recorded_epoch_ms, id) as rn from v_telemetry) group by 1, 2""")
def _(spark, sf):
    df = joins.species_with_records(view(spark, sf, "v_species"), view(spark, sf, "v_telemetry"), "recorded_epoch_ms", ("id", "recorded_epoch_ms", "animal_id"), page=100)
    return df.select("species_id", "page", F.size("records").alias("records"), F.get("records", F.lit(0))["recorded_epoch_ms"].alias("first_ms"),
                     F.get("records", F.size("records") - 1)["recorded_epoch_ms"].alias("last_ms"))


@query("trace_ids", "select distinct species_id, id from v_telemetry where id <> 0")
def _(spark, sf):
    return joins.trace_ids(view(spark, sf, "v_telemetry"), ["species_id"])


@query("trace_id_pages", """
select species_id, ((rn - 1) // 100)::bigint as page, string_agg(id::varchar, ',' order by id) as ids
from (select *, row_number() over (partition by species_id order by id) as rn from (select distinct species_id, id from v_telemetry where id <> 0)) group by 1, 2""")
def _(spark, sf):
    df = joins.trace_pages(view(spark, sf, "v_telemetry"), ["species_id"], page=100)
    return df.select("species_id", "page", F.array_join("record_ids", ",").alias("ids"))


@query("keyset_page", "select id, recorded_epoch_ms from v_telemetry where (recorded_epoch_ms, id) < (1705363200000, 5000) order by recorded_epoch_ms desc, id desc limit 201")
def _(spark, sf):
    return topk.keyset_page(view(spark, sf, "v_telemetry").select("id", "recorded_epoch_ms"), "recorded_epoch_ms", (1705363200000, 5000))


@query("offset_page", """
select id, (select count(*) from v_risk_assessments where conservation_risk_index >= 40) as total from v_risk_assessments where conservation_risk_index >= 40
order by period_end_epoch_ms desc, id desc limit 20 offset 40""")
def _(spark, sf):
    rows = view(spark, sf, "v_risk_assessments").filter("conservation_risk_index >= 40")
    page, total = topk.offset_page(rows, [F.desc("period_end_epoch_ms"), F.desc("id")], 20, 40)
    return page.select("id", total.scalar().alias("total"))


@query("top_zones", "select h3_cell as zone_id, count(*) as activity from v_sensor_readings group by 1 order by activity desc, zone_id limit 5")
def _(spark, sf):
    zones = view(spark, sf, "v_sensor_readings").groupBy(F.col("h3_cell").alias("zone_id")).agg(F.count(F.lit(1)).alias("activity"))
    return topk.top_zones(zones, 5)


@query("rank_clusters", """
select point_count, row_number() over (order by point_count desc, cell_y, cell_x) - 1 as cluster_id, round(point_count / max(point_count) over (), 5) as weight from (
  select least(cast(floor((latitude + 2.5) / (1.0 / 16)) as int), 15) as cell_y, least(cast(floor((longitude - 34.0) / (0.7 / 16)) as int), 15) as cell_x, count(*) as point_count
  from v_detections where latitude between -2.5 and -1.5 and longitude between 34.0 and 34.7 group by 1, 2)""")
def _(spark, sf):
    return rounded(topk.rank_clusters(_grid(spark, sf)).select("point_count", "cluster_id", "weight"), "weight", digits=5)


@query("rank_by_risk", "select id, round(conservation_risk_index, 6) as cri from v_risk_assessments order by cri desc")
def _(spark, sf):
    df = topk.rank_by_risk(view(spark, sf, "v_risk_assessments"))
    return df.select("id", F.round("conservation_risk_index", 6).alias("cri"))


@query("dispatch_targets", """
with e as (select species_id, class_name, case class_name when 'gunshot' then 1.0 else 0.7 end as w, detected_epoch_ms as t, round(latitude, 4) as la, round(longitude, 4) as lo
    from v_detections where category = 'immediate_threat' and latitude is not null and species_id is not null),
p as (select species_id, la, lo, max(struct_pack(w := w, t := t)) as best, count(*) as events from e group by 1, 2, 3),
r as (select *, row_number() over (partition by species_id order by best desc, la, lo) as target from p)
select species_id, target, la as lat4, lo as lon4, events from r where target <= 3""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").filter("category = 'immediate_threat' and species_id is not null")
    out = topk.dispatch_targets(df, ["species_id"], 3)
    return rounded(out.select("species_id", F.col("target").cast("bigint").alias("target"), "lat4", "lon4", "events"), "lat4", "lon4")


@query("claimable", """
select id from v_detections where source_type = 'ACOUSTIC' and (id % 5 = 0 or (id % 5 = 1 and (id % 2 = 0 or detected_epoch_ms <= 1705363200000 - 600000)))
order by detected_epoch_ms, id limit 32""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").filter("source_type = 'ACOUSTIC'").selectExpr(
        "id", "detected_epoch_ms as window_ms", "case id % 5 when 0 then 'PENDING' when 1 then 'RUNNING' else 'PROCESSED' end as status",
        "case when id % 2 > 0 then detected_epoch_ms end as started_ms")
    return topk.claimable(df, 1705363200000, 32).select("id")


@query("threat_alerts", """
select id::varchar as event_id, 'CRITICAL' as priority, lower(source_type) || '_anomaly' as event_type, class_name as classification, round(confidence, 4) as confidence, device_id as zone
from v_detections where category = 'immediate_threat' and confidence >= 0.5""")
def _(spark, sf):
    from fieldlake.operators.filters import is_critical
    df = view(spark, sf, "v_detections").filter(is_critical()).withColumn("reading_type", F.lower("source_type")).withColumn("zone", F.col("device_id"))
    return rounded(alerts.threat_alerts(df).select("event_id", "priority", "event_type", "classification", "confidence", "zone"), "confidence")


@query("assessment_alerts", """
select id::varchar as event_id, case when conservation_risk_index >= 80 then 'CRITICAL' when conservation_risk_index >= 60 then 'HIGH'
  when conservation_risk_index >= 40 then 'ELEVATED' else 'ROUTINE' end as priority, 'conservation_risk' as classification, h3_cell as zone from v_risk_assessments""")
def _(spark, sf):
    return alerts.assessment_alerts(view(spark, sf, "v_risk_assessments")).select("event_id", "priority", "classification", "zone")


SUBS = """(select n_nationkey as client_id, case when n_nationkey % 10 > 0 then 'cell-' || (n_nationkey % 20) end as zone,
  case n_nationkey % 3 when 0 then 'HIGH' when 1 then 'CRITICAL' else 'ELEVATED' end as floor from nation)"""
RANK = "list_position(['INFO','ROUTINE','ELEVATED','HIGH','CRITICAL'], {})"


def _subs(spark, sf):
    return table(spark, sf, "nation").selectExpr(
        "n_nationkey as client_id", "case when n_nationkey % 10 > 0 then concat('cell-', cast(n_nationkey % 20 as string)) end as zone",
        "case n_nationkey % 3 when 0 then 'HIGH' when 1 then 'CRITICAL' else 'ELEVATED' end as min_priority")


RISK_ALERTS = """(select id::varchar as event_id, period_end_epoch_ms as ts, case when conservation_risk_index >= 80 then 'CRITICAL' when conservation_risk_index >= 60 then 'HIGH'
  when conservation_risk_index >= 40 then 'ELEVATED' else 'ROUTINE' end as priority, case when id % 50 > 0 then h3_cell end as zone from v_risk_assessments)"""


def _risk_alerts(spark, sf):
    df = view(spark, sf, "v_risk_assessments").withColumn("h3_cell", F.when(F.col("id") % 50 > 0, F.col("h3_cell")))
    return alerts.assessment_alerts(df)


@query("fan_out", f"""
select event_id, client_id from {RISK_ALERTS} a join {SUBS} s on (a.zone is null or s.zone is null or s.zone = a.zone) and {RANK.format('a.priority')} >= {RANK.format('s.floor')}""")
def _(spark, sf):
    return alerts.fan_out(_risk_alerts(spark, sf), _subs(spark, sf)).select("event_id", "client_id")


@query("replay", f"""
select event_id, client_id from (select * from {RISK_ALERTS} order by ts desc, event_id desc limit 10) a join {SUBS} s
  on (s.zone is null or s.zone = a.zone) and {RANK.format('a.priority')} >= {RANK.format('s.floor')}""")
def _(spark, sf):
    return alerts.replay(_risk_alerts(spark, sf), _subs(spark, sf), 10).select("event_id", "client_id")


@query("speed_verdicts", """
with recursive g as (select animal_id, id, recorded_epoch_ms as t, radians(latitude) as phi, radians(longitude) as lam, coalesce(altitude, 0) as alt from v_telemetry),
n as (select *, 40680631590769.0::double / sqrt(pow(6378137.0::double * cos(phi), 2) + pow(6356752.3142::double * sin(phi), 2)) as n from g),
p as (select animal_id, t, (n + alt) * cos(phi) * cos(lam) as x, (n + alt) * cos(phi) * sin(lam) as y, (40408299984087.05552164::double * n / 40680631590769.0::double + alt) * sin(phi) as z,
  row_number() over (partition by animal_id order by t, id) as rn from n),
r as (select animal_id, rn, t, x, y, z, false as fast from p where rn = 1
  union all
  select animal_id, rn, case when too then t0 else t end, case when too then x0 else x end, case when too then y0 else y end, case when too then z0 else z end, too from (
    select p.*, r.t as t0, r.x as x0, r.y as y0, r.z as z0,
      p.t > r.t and 3.6 * sqrt(pow(p.x - r.x, 2) + pow(p.y - r.y, 2) + pow(p.z - r.z, 2)) / ((p.t - r.t) / 1000.0) > 0.4 as too
    from r join p on p.animal_id = r.animal_id and p.rn = r.rn + 1))
select animal_id, case when fast then 'EXCEEDED_SPEED_THRESHOLD' else 'VALID_FIX' end as validation_status, count(*) as fixes from r group by 1, 2""")
def _(spark, sf):
    """Recursive verdicts per animal."""
    df = view(spark, sf, "v_telemetry").withColumn("max_speed", F.lit(0.4))
    return tracking.speed_verdicts(df).groupBy("animal_id", "validation_status").agg(F.count(F.lit(1)).alias("fixes"))


