"""Points, zones, tracks and clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.functions import geo, h3grid
from fieldlake.operators import aggregates, series, spatial
from fieldlake.registry.core import query, rounded
from fieldlake.registry.q_aggregates import BOXED_SQL, boxed
from fieldlake.registry.views import table, view


def hav(a, b, c, d):
    """Haversine text for the oracles."""
    return (f"(2 * 6371008.8 * asin(least(1, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
            f"* pow(sin(radians({d} - {b}) / 2), 2)))))")


@query("haversine", f"select id, round({hav('latitude', 'longitude', '10.5', '34.9')}, 3) as metres from v_telemetry")
def _(spark, sf):
    return rounded(view(spark, sf, "v_telemetry").select("id", geo.haversine_m("latitude", "longitude", F.lit(10.5), F.lit(34.9)).alias("metres")), "metres", digits=3)


ECEF = "(40680631590769.0 / sqrt(pow(6378137.0 * cos(radians({p}latitude)), 2) + pow(6356752.3142 * sin(radians({p}latitude)), 2)))"


def _xyz(p):
    n = ECEF.format(p=p)
    ring = f"(({n} + {p}altitude) * cos(radians({p}latitude)))"
    return (f"({ring} * cos(radians({p}longitude)))", f"({ring} * sin(radians({p}longitude)))",
            f"((40408299984087.05552164 * {n} / 40680631590769.0 + {p}altitude) * sin(radians({p}latitude)))")


@query("ecef_speed", f"""
select id, round(3.6 * sqrt({' + '.join(f'pow({a} - {b}, 2)' for a, b in zip(_xyz('f_'), _xyz('')))}) / ((recorded_epoch_ms - f_recorded_epoch_ms) / 1000.0), 4) as speed
from (select *, lag(latitude) over w as f_latitude, lag(longitude) over w as f_longitude, lag(altitude) over w as f_altitude, lag(recorded_epoch_ms) over w as f_recorded_epoch_ms
  from v_telemetry window w as (partition by animal_id order by recorded_epoch_ms, id)) where f_latitude is not null and recorded_epoch_ms > f_recorded_epoch_ms""")
def _(spark, sf):
    from fieldlake.operators import scale
    names = ("latitude", "longitude", "altitude", "recorded_epoch_ms")
    df = scale.with_frame(view(spark, sf, "v_telemetry"), ["animal_id"], ["recorded_epoch_ms", "id"], 1,
                          {f"f_{n}": (lambda w, n=n: F.lag(n).over(w)) for n in names})
    speed = geo.ecef_speed_kmh("f_latitude", "f_longitude", "f_altitude", "f_recorded_epoch_ms", "latitude", "longitude", "altitude", "recorded_epoch_ms")
    return rounded(df.select("id", speed.alias("speed")).filter("speed is not null"), "speed")


@query("project_local", """
select id, round(radians(longitude - 34.3) * 6371008.8 * cos(radians(-2.0)), 3) as east, round(radians(latitude + 2.0) * 6371008.8, 3) as north from v_telemetry""")
def _(spark, sf):
    east, north = geo.project_local("latitude", "longitude", F.lit(-2.0), F.lit(34.3))
    return rounded(view(spark, sf, "v_telemetry").select("id", east.alias("east"), north.alias("north")), "east", "north", digits=3)


@query("viewport_offset", "select id, round(case when longitude >= 34.5 then longitude - 34.5 else longitude + 360 - 34.5 end, 6) as lon_offset from v_telemetry")
def _(spark, sf):
    return rounded(view(spark, sf, "v_telemetry").select("id", geo.viewport_offset("longitude", 34.5, 34.0).alias("lon_offset")), "lon_offset", digits=6)


@query("search_frames", """
with z as (select id, (id % 37) * 10.0 - 180 as lon, (id % 18) * 10.0 - 87 as lat, radius_m * 100 as r from v_habitat_zones),
d as (select *, degrees(r / 6335439.327) * 1.01 as dlat from z),
e as (select *, degrees(r / (6378137.0 * cos(radians(least(greatest(abs(lat - dlat), abs(lat + dlat)), 89.999999))))) * 1.01 as dlon from d)
select id, case when lat - dlat <= -90 or lat + dlat >= 90 or dlon >= 180 then 1 when lon - dlon < -180 or lon + dlon > 180 then 2 else 1 end as frames,
  round(case when lat - dlat <= -90 or lat + dlat >= 90 or dlon >= 180 then -180.0 when lon - dlon < -180 then lon - dlon + 360 else lon - dlon end, 6) as min_lon,
  round(greatest(lat - dlat, -90), 6) as min_lat from e""")
def _(spark, sf):
    df = view(spark, sf, "v_habitat_zones").selectExpr("id", "(id % 37) * 10.0D - 180 as lon", "(id % 18) * 10.0D - 87 as lat", "radius_m * 100 as r")
    df = df.select("id", geo.search_frames("lat", "lon", F.col("r")).alias("f"))
    return rounded(df.select("id", F.size("f").alias("frames"), F.get("f", F.lit(0))["min_lon"].alias("min_lon"),
                             F.get("f", F.lit(0))["min_lat"].alias("min_lat")), "min_lon", "min_lat", digits=6)


@query("within_radius", f"""
select id, round({hav('latitude', 'longitude', '-2.0', '34.5')}, 3) as distance_m from v_detections
where category = 'immediate_threat' and detected_epoch_ms between 1704067200000 and 1705363200000 and {hav('latitude', 'longitude', '-2.0', '34.5')} <= 50000""")
def _(spark, sf):
    df = geo.within_radius(view(spark, sf, "v_detections"), -2.0, 34.5, 50_000, 1704067200000, 1705363200000, "immediate_threat")
    return rounded(df.select("id", "distance_m"), "distance_m", digits=3)


@query("radius_join", f"""
select d.id, z.id as zone, round({hav('d.latitude', 'd.longitude', 'z.latitude', 'z.longitude')}, 3) as distance_m
from v_detections d join v_habitat_zones z on {hav('d.latitude', 'd.longitude', 'z.latitude', 'z.longitude')} <= 12000
  and detected_epoch_ms between 1704067200000 and 1705363200000""")
def _(spark, sf):
    zones = view(spark, sf, "v_habitat_zones").selectExpr("id as zone", "latitude as centre_lat", "longitude as centre_lon",
                                                          "1704067200000L as start_ms", "1705363200000L as end_ms")
    df = spatial.radius_join(view(spark, sf, "v_detections").select("id", "latitude", "longitude", "detected_epoch_ms"), zones, 12_000, time="detected_epoch_ms", many=True)
    return rounded(df.select("id", "zone", "distance_m"), "distance_m", digits=3)


@query("zone_multiplier", f"""
select d.id, coalesce(max(case when z.id is null then null when z.zone_type = 'BREEDING' then 3.0 when z.zone_type = 'WATER_SOURCE' then 2.5 else 1.5 end),
  max(case when {hav('d.latitude', 'd.longitude', '-2.0', '34.5')} > 40000 then 0.5 else 1.0 end))::double as proximity
from v_detections d left join v_habitat_zones z on z.active and (z.species_id is null or z.species_id = d.species_id)
  and {hav('d.latitude', 'd.longitude', 'z.latitude', 'z.longitude')} <= z.radius_m
where d.category = 'immediate_threat' group by d.id""")
def _(spark, sf):
    events = view(spark, sf, "v_detections").filter("category = 'immediate_threat'").selectExpr("*", "-2.0D as home_lat", "34.5D as home_lon", "40000D as home_radius_m")
    return spatial.zone_multiplier(events, view(spark, sf, "v_habitat_zones")).select("id", "proximity")


@query("corridor_retention", f"""
with f as (select t.id, t.species_id, t.animal_id, max(case when z.id is not null then 1.0 else 0.0 end) as i from v_telemetry t left join v_habitat_zones z
    on z.active and z.zone_type = 'CORRIDOR' and (z.species_id is null or z.species_id = t.species_id)
    and {hav('t.latitude', 't.longitude', 'z.latitude', 'z.longitude')} <= z.radius_m * 6 group by 1, 2, 3),
a as (select species_id, animal_id, avg(i) as share from f group by 1, 2)
select species_id, count(*) as animals, round(avg(case when share >= 0.5 then 1.0 else 0.0 end), 6) as retention from a group by 1""")
def _(spark, sf):
    zones = view(spark, sf, "v_habitat_zones").withColumn("radius_m", F.col("radius_m") * 6)
    return rounded(spatial.corridor_retention(view(spark, sf, "v_telemetry"), zones), "retention", digits=6)


# straight fences and square settlements placed at the suppliers' positions
FEATURES = """case when s_suppkey % 2 = 0 then concat('LINESTRING(', cast(34.00 + (s_suppkey % 37) * 0.02 as double), ' ', cast(-2.50 + (s_suppkey % 50) * 0.02 as double), ', ',
  cast(34.013 + (s_suppkey % 37) * 0.02 as double), ' ', cast(-2.487 + (s_suppkey % 50) * 0.02 as double), ')')
  else concat('LINESTRING(', cast(34.01 + (s_suppkey % 37) * 0.02 as double), ' ', cast(-2.50 + (s_suppkey % 50) * 0.02 as double), ', ',
  cast(34.01 + (s_suppkey % 37) * 0.02 as double), ' ', cast(-2.485 + (s_suppkey % 50) * 0.02 as double), ')') end"""
TURN = "sign(({b}x - {a}x) * ({c}y - {a}y) - ({b}y - {a}y) * ({c}x - {a}x))"


def _turn(a, b, c):
    return TURN.format(a=a, b=b, c=c)


@query("crossings", f"""
with s as (select * from (select id, species_id, lag(longitude) over w as px, lag(latitude) over w as py, longitude as qx, latitude as qy
    from v_telemetry window w as (partition by animal_id order by recorded_epoch_ms, id)) where px is not null and (px <> qx or py <> qy)),
f as (select case when s_suppkey % 2 = 0 then cast(34.00 + (s_suppkey % 37) * 0.02 as double) else cast(34.01 + (s_suppkey % 37) * 0.02 as double) end as cx,
  cast(-2.50 + (s_suppkey % 50) * 0.02 as double) as cy, case when s_suppkey % 2 = 0 then cast(34.013 + (s_suppkey % 37) * 0.02 as double) else cast(34.01 + (s_suppkey % 37) * 0.02 as double) end as dx,
  case when s_suppkey % 2 = 0 then cast(-2.487 + (s_suppkey % 50) * 0.02 as double) else cast(-2.485 + (s_suppkey % 50) * 0.02 as double) end as dy from supplier),
h as (select distinct id from s join f on {_turn('p', 'q', 'c')} <> {_turn('p', 'q', 'd')} and {_turn('c', 'd', 'p')} <> {_turn('c', 'd', 'q')})
select species_id, count(*) as segment_count, count(h.id) as crossing_count from s left join h using (id) group by 1""")
def _(spark, sf):
    features = table(spark, sf, "supplier").select(F.expr(FEATURES).alias("geometry_wkt"))
    return spatial.crossings(series.track_segments(view(spark, sf, "v_telemetry")), features)


@query("nearest_cell", """
with c as (select s_suppkey, cast(-2.50 + (s_suppkey % 50) * 0.02 + 0.002 as double) as lat, cast(34.00 + (s_suppkey % 37) * 0.02 + 0.001 as double) as lon, (s_suppkey % 10) / 10.0 as loss from supplier),
t as (select id, latitude, longitude, 0.009 / greatest(0.1, cos(radians(latitude))) as dlon from v_telemetry),
p as (select t.id, c.*, sqrt(pow((lat - latitude) / 0.009, 2) + pow((lon - longitude) / dlon, 2)) as d from t join c on abs(lat - latitude) <= 0.009 and abs(lon - longitude) <= dlon),
r as (select *, row_number() over (partition by id order by d, lat, lon) as rn from p)
select id, round(d, 5) as scaled_distance, round(lat, 5) as cell_lat from r where rn = 1 and d <= 0.72""")
def _(spark, sf):
    cells = table(spark, sf, "supplier").selectExpr("cast(-2.50 + (s_suppkey % 50) * 0.02 + 0.002 as double) as lat", "cast(34.00 + (s_suppkey % 37) * 0.02 + 0.001 as double) as lon",
                                                    "(s_suppkey % 10) / 10.0D as loss", "0.5D as vote")
    df = spatial.nearest_cell(view(spark, sf, "v_telemetry"), cells, "id")
    return rounded(df.select("id", "scaled_distance", "cell_lat"), "scaled_distance", "cell_lat", digits=5)


@query("nearest_outpost", f"""
select id, round(least({hav('latitude', 'longitude', '-2.1', '34.2')}, {hav('latitude', 'longitude', '-1.7', '34.6')}), 3) as metres from v_telemetry""")
def _(spark, sf):
    near = spatial.nearest_distance("latitude", "longitude", (("north", -2.1, 34.2), ("south", -1.7, 34.6)))
    return rounded(view(spark, sf, "v_telemetry").select("id", near.alias("metres")), "metres", digits=3)


@query("shifted_window", """
select species_id, count(*) as fixes from v_telemetry where recorded_epoch_ms between 1736000000000 - 31556952000 and 1737000000000 - 31556952000 group by 1""")
def _(spark, sf):
    scopes = view(spark, sf, "v_species").selectExpr("id as species_id", "1736000000000L as start_ms", "1737000000000L as end_ms")
    df = spatial.shifted_window(view(spark, sf, "v_telemetry").select("species_id", "recorded_epoch_ms"), scopes, ["species_id"], "recorded_epoch_ms")
    return df.groupBy("species_id").agg(F.count(F.lit(1)).alias("fixes"))


CENTROIDS = "(select l_orderkey as frame, l_returnflag as species, l_partkey % 640 as cx, l_suppkey * 37 % 480 as cy, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey) as i from lineitem)"


@query("herd_flags", f"""
with p as (select * from {CENTROIDS})
select a.frame, a.species, bool_or(b.i is not null) as is_herd from p a left join p b on a.frame = b.frame and a.species = b.species and a.i < b.i
  and sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) <= 100 group by 1, 2""")
def _(spark, sf):
    df = table(spark, sf, "lineitem").selectExpr("l_orderkey as frame", "l_returnflag as species", "cast(l_partkey % 640 as double) as cx", "cast(l_suppkey * 37 % 480 as double) as cy")
    return spatial.herd_flags(df)


# deaths on a coarse lattice, so that one species' clusters form and break by distance and by days
DEATHS = """select event_id as id, cast(user_id % 5 + 1 as bigint) as species_id, case when event_id % 23 = 0 then null else cast((user_id % 97) * 0.045 - 2 as double) end as latitude,
  case when event_id % 23 = 0 then null else cast((user_id % 29) * 0.061 + 34 + (event_id % 7) * 0.003 as double) end as longitude, MS(ts) * 40 as detected_epoch_ms from events where event_type = 'error'"""


@query("mortality_clusters", f"""
with recursive d as ({DEATHS}),
e as (select a.id as a, b.id as b from d a join d b on a.species_id = b.species_id and abs(a.detected_epoch_ms - b.detected_epoch_ms) <= 604800000 and abs(a.latitude - b.latitude) < 0.05
  and {hav('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 5000),
r as (select id as a, id as root from d union select e.b, r.root from r join e on e.a = r.a),
c as (select a as id, min(root) as root from r group by 1),
s as (select species_id, root, count(*) as size from c join d using (id) group by 1, 2)
select species_id, size, count(*) as clusters from s group by 1, 2""")
def _(spark, sf):
    import re

    from fieldlake.registry.views import SPARK_MS
    deaths = spark.sql(re.sub(r"MS\((\w+)\)", SPARK_MS, DEATHS).replace("from events", "from {src}"), src=table(spark, sf, "events"))
    sizes = spatial.cluster_sizes(spatial.mortality_clusters(deaths))
    return sizes.groupBy("species_id", "size").agg(F.count(F.lit(1)).alias("clusters"))


@query("circular_centre", """
select species_id, round(avg(latitude), 6) as centre_lat, round(degrees(atan2(sum(sin(radians(longitude))), sum(cos(radians(longitude))))), 6) as centre_lon, count(*) as fixes
from v_telemetry group by 1""")
def _(spark, sf):
    return rounded(spatial.circular_centre(view(spark, sf, "v_telemetry"), ["species_id"]), "centre_lat", "centre_lon", digits=6)


# a hull's edge is a pair with every other point on its left, and as long as the points on its line allow
RANGES = """
c as (select species_id, animal_id, avg(latitude) as la, degrees(atan2(sum(sin(radians(longitude))), sum(cos(radians(longitude))))) as lo, count(*) as fixes from v_telemetry group by 1, 2),
f as (select animal_id, fixes, radians((longitude - lo + 540) - floor((longitude - lo + 540) / 360) * 360 - 180) * 6371008.8 * cos(radians(la)) as x, radians(latitude - la) * 6371008.8 as y
  from v_telemetry join c using (species_id, animal_id) where fixes >= 3),
d as (select *, pow(x - avg(x) over (partition by animal_id), 2) + pow(y - avg(y) over (partition by animal_id), 2) as d2 from f),
k as (select distinct animal_id, x, y from (select *, row_number() over (partition by animal_id order by d2, x, y) as rn from d) where rn <= greatest(3, ceil(fixes * 95 / 100.0))),
e as (select a.animal_id, a.x as px, a.y as py, b.x as qx, b.y as qy from k a join k b on a.animal_id = b.animal_id and (a.x <> b.x or a.y <> b.y)
  where not exists (select 1 from k where k.animal_id = a.animal_id and ((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x) < -1
    or abs((b.x - a.x) * (k.y - a.y) - (b.y - a.y) * (k.x - a.x)) <= 1 and ((b.x - a.x) * (k.x - a.x) + (b.y - a.y) * (k.y - a.y) < -1
      or (b.x - a.x) * (k.x - a.x) + (b.y - a.y) * (k.y - a.y) > pow(b.x - a.x, 2) + pow(b.y - a.y, 2) + 1)))),
h as (select animal_id, sum(px * qy - py * qx) / 2 / 1e6 as area_km2 from e group by 1)"""


@query("home_range", f"""
with {RANGES.strip()}
select c.animal_id, c.fixes, round(case when c.fixes >= 3 then coalesce(area_km2, 0) end, 4) as area_km2 from c left join h using (animal_id)""")
def _(spark, sf):
    """95 % polygons per animal."""
    return rounded(spatial.home_range_km2(view(spark, sf, "v_telemetry")), "area_km2")


@query("mean_home_range", f"""
with {RANGES.strip()}
select species_id, round(avg(area_km2), 4) as mean_range_km2, count(*) as animals from c join h using (animal_id) where fixes >= 5 and area_km2 > 0 group by 1""")
def _(spark, sf):
    ranges = spatial.home_range_km2(view(spark, sf, "v_telemetry"), ["species_id", "animal_id"])
    return rounded(aggregates.with_mean_home_range(ranges, ["species_id"]), "mean_range_km2")


@query("two_means", f"""
with recursive b as (select species_id, (bbox_right - bbox_left) * (bbox_bottom - bbox_top) * case when id % 3 = 0 then 0.2 else confidence + 0.6 end as v from {BOXED_SQL}),
q as (select *, row_number() over (partition by species_id order by v) as rn, count(*) over (partition by species_id) as n from b),
r as (select species_id, 0 as round, max(v) filter (rn = n // 4 + 1) as small, max(v) filter (rn = n * 3 // 4 + 1) as large, 0::bigint as a, 0::bigint as z from q where n >= 10 group by 1
  union all
  select r.species_id, max(r.round) + 1, avg(v) filter (v <= (small + large) / 2), avg(v) filter (v > (small + large) / 2), count(*) filter (v <= (small + large) / 2), count(*) filter (v > (small + large) / 2)
  from r join b on b.species_id = r.species_id where r.round < 60 group by r.species_id)
select species_id, a as juveniles, z as adults from r where round = 60 and small > 0 and large / small >= 1.8""")
def _(spark, sf):
    """Juvenile and adult box clusters per species."""
    area = (F.col("bbox_right") - F.col("bbox_left")) * (F.col("bbox_bottom") - F.col("bbox_top")) * F.when(F.col("id") % 3 == 0, 0.2).otherwise(F.col("confidence") + 0.6)
    return spatial.two_means(boxed(spark, sf).withColumn("area", area), ["species_id"], "area")


VIEW = (-1.5, -2.5, 34.7, 34.0)
GRID = """
select least(cast(floor((latitude + 2.5) / (1.0 / 16)) as int), 15) as cell_y, least(cast(floor((longitude - 34.0) / (0.7 / 16)) as int), 15) as cell_x,
  count(*) as point_count, round(avg(latitude), 6) as latitude, round(avg(longitude - 34.0), 6) as lon_offset, count(*) filter (category = 'immediate_threat') as threat_count,
  round(sum(confidence), 4) as metric_sum, count(confidence) as metric_count
from v_detections where latitude between -2.5 and -1.5 and longitude between 34.0 and 34.7 group by 1, 2"""


def _grid(spark, sf):
    return spatial.grid_clusters(view(spark, sf, "v_detections"), VIEW, 16, F.col("confidence"), threats=True)


@query("grid_clusters", GRID)
def _(spark, sf):
    df = _grid(spark, sf).drop("min_latitude", "max_latitude", "min_lon_offset", "max_lon_offset")
    return rounded(rounded(df, "latitude", "lon_offset", digits=6), "metric_sum")


@query("kmeans_clusters")
def _(spark, sf):
    """Weighted k-means over the grid; checked against brute force in tests."""
    df = spatial.merge_clusters(spatial.weighted_kmeans(_grid(spark, sf), VIEW))
    return rounded(df, "latitude", "lon_offset", "metric_sum")


@query("pre_round", "select round(latitude, 4) as latitude, round(longitude, 4) as longitude, count(*) as rows from v_telemetry group by 1, 2")
def _(spark, sf):
    return rounded(spatial.pre_round(view(spark, sf, "v_telemetry")), "latitude", "longitude")


@query("cell_of")
def _(spark, sf):
    """Fixes per grid cell at resolution 7, from rounded places; checked against known vectors in tests."""
    places = spatial.pre_round(view(spark, sf, "v_telemetry"))
    return places.withColumn("cell", h3grid.cell_of("latitude", "longitude", 7)).groupBy("cell").agg(F.sum("rows").alias("fixes"))


@query("cell_geometry")
def _(spark, sf):
    places = spatial.pre_round(view(spark, sf, "v_telemetry"))
    cells = places.select(h3grid.cell_of("latitude", "longitude", 7).alias("cell")).distinct()
    df = cells.select("cell", h3grid.cell_centre("cell").alias("c"), h3grid.cell_bounds("cell").alias("b"))
    return df.select("cell", F.round("c.lat", 6).alias("lat"), F.round("c.lon", 6).alias("lon"), F.round("b.min_lat", 6).alias("min_lat"), F.round("b.max_lon", 6).alias("max_lon"))


# indexes put together from order numbers: resolution 7, digits from the key
@query("cell_parent", """
with b as (select o_orderkey, (576460752303423488 + 31525197391593472 + (o_custkey % 122) * 35184372088832 + ((o_orderkey % 5 + 2) * 4398046511104)
  + ((o_custkey % 7) * 549755813888) + ((o_orderkey % 7) * 16777216) + 16777215)::bigint as h from orders)
select o_orderkey, printf('%x', h) as cell, true as valid, 7 as res,
  printf('%x', (h & ~(15::bigint << 52)) | (5::bigint << 52) | ((1::bigint << 30) - 1)) as parent, false as coarse_has_parent from b""")
def _(spark, sf):
    bits = F.expr("""cast(576460752303423488L + 31525197391593472L + (o_custkey % 122) * 35184372088832L + ((o_orderkey % 5 + 2) * 4398046511104L)
        + ((o_custkey % 7) * 549755813888L) + ((o_orderkey % 7) * 16777216L) + 16777215L as bigint)""")
    df = table(spark, sf, "orders").select("o_orderkey", h3grid.cell_text(bits).alias("cell"))
    return df.select("o_orderkey", "cell", h3grid.is_cell("cell").alias("valid"), h3grid.cell_res("cell").alias("res"),
                     h3grid.cell_parent("cell", 5).alias("parent"), h3grid.cell_parent(h3grid.cell_parent("cell", 5), 6).isNotNull().alias("coarse_has_parent"))


@query("wkt_vertices", """
select s_suppkey, 2 as vertices, round(case when s_suppkey % 2 = 0 then 34.00 + (s_suppkey % 37) * 0.02 else 34.01 + (s_suppkey % 37) * 0.02 end, 4)::double as first_lon,
  round(case when s_suppkey % 2 = 0 then -2.487 + (s_suppkey % 50) * 0.02 else -2.485 + (s_suppkey % 50) * 0.02 end, 4)::double as last_lat from supplier""")
def _(spark, sf):
    df = table(spark, sf, "supplier").select("s_suppkey", geo.wkt_vertices(F.expr(FEATURES)).alias("v"))
    return rounded(df.select("s_suppkey", F.size("v").alias("vertices"), F.get("v", F.lit(0))["lon"].alias("first_lon"),
                             F.get("v", F.size("v") - 1)["lat"].alias("last_lat")), "first_lon", "last_lat")


@query("points_from_blobs", "select id, latitude as lat, longitude as lon from v_telemetry")
def _(spark, sf):
    """Positions written as little-endian WKB points and read back."""
    df = view(spark, sf, "v_telemetry").select("id", "latitude", "longitude")

    @F.pandas_udf(T.BinaryType())
    def wkb(lon: pd.Series, lat: pd.Series) -> pd.Series:
        head = b"\x01\x01\x00\x00\x00"
        both = np.column_stack([lon, lat]).astype("<f8")
        return pd.Series([head + row.tobytes() for row in both])
    point = geo.point_from_blob("blob")
    return df.select("id", wkb("longitude", "latitude").alias("blob")).select("id", point.alias("p")).select("id", "p.lat", "p.lon")
