"""Ordered series."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldlake.operators import aggregates as agg
from fieldlake.operators import filters, scale, series
from fieldlake.registry.core import query, rounded
from fieldlake.registry.q_aggregates import FRAMES_SQL, _aged
from fieldlake.registry.views import view


@query("rolling_mean", """
select id, sensor_mac, round(avg(ambient_temperature_c) over (partition by sensor_mac order by recorded_epoch_ms, id
  rows between 6 preceding and current row), 4) as ambient_temperature_c_rolling from v_sensor_readings""")
def _(spark, sf):
    df = series.rolling_mean(view(spark, sf, "v_sensor_readings"), ["sensor_mac"], "ambient_temperature_c")
    return rounded(df.select("id", "sensor_mac", "ambient_temperature_c_rolling"), "ambient_temperature_c_rolling")


@query("latest_per", """
select id, sensor_mac, recorded_epoch_ms from (select *, row_number() over (partition by sensor_mac order by recorded_epoch_ms desc, id desc) as rn
  from v_sensor_readings) where rn = 1""")
def _(spark, sf):
    df = view(spark, sf, "v_sensor_readings").select("id", "sensor_mac", "recorded_epoch_ms")
    return scale.latest_per(df, ["sensor_mac"], "recorded_epoch_ms", "id")


@query("with_count", "select id, sensor_mac, count(*) over (partition by sensor_mac) as key_rows from v_sensor_readings")
def _(spark, sf):
    return filters.with_count(view(spark, sf, "v_sensor_readings").select("id", "sensor_mac"), ["sensor_mac"])


@query("track_segments", """
select id, animal_id, round(from_latitude, 4) as from_latitude, round(latitude, 4) as latitude, from_recorded_epoch_ms from (
  select *, lag(latitude) over w as from_latitude, lag(longitude) over w as from_longitude, lag(recorded_epoch_ms) over w as from_recorded_epoch_ms
  from v_telemetry window w as (partition by animal_id order by recorded_epoch_ms, id))
where from_latitude is not null and (from_latitude <> latitude or from_longitude <> longitude)""")
def _(spark, sf):
    df = series.track_segments(view(spark, sf, "v_telemetry"))
    return rounded(df.select("id", "animal_id", "from_latitude", "latitude", "from_recorded_epoch_ms"), "from_latitude", "latitude")


HERD = f"(select species_id, ms // 86400000 as day_index, cast(max(n) as double) as herd_count from ({FRAMES_SQL}) group by 1, 2)"


def _herd(spark, sf):
    return agg.herd_series(agg.frames(_aged(spark, sf)))


@query("herd_decline", f"""
with s as (select *, count(*) over (partition by species_id) as n, row_number() over (partition by species_id order by day_index) as i from {HERD}),
m as (select species_id, n, i, least(7, n // 2) as size, avg(herd_count) over (partition by species_id order by i rows between 6 preceding and current row) as a7,
  herd_count from s),
e as (select species_id, avg(herd_count) filter (i <= size) as f, avg(herd_count) filter (i > n - size) as l from m group by 1)
select species_id, round(f, 4) as first_average, round(l, 4) as last_average, round(greatest(0, 1 - l / f), 4) as decline from e""")
def _(spark, sf):
    return rounded(series.herd_decline(_herd(spark, sf)), "first_average", "last_average", "decline")


@query("population_trend", f"""
with s as (select *, count(*) over (partition by species_id) as n, row_number() over (partition by species_id order by day_index) as i from {HERD}),
e as (select species_id, max(n) as points, avg(herd_count) filter (i <= n // 2) as earlier, avg(herd_count) filter (i > n - n // 2) as later from s group by 1)
select species_id, points, round(earlier, 4) as earlier, round(later, 4) as later,
  case when points < 4 then null when earlier <= 0 then case when later > 0 then 'INCREASING' else 'STABLE' end
    when (later - earlier) / earlier <= -0.05 then 'DECLINING' when (later - earlier) / earlier >= 0.05 then 'INCREASING' else 'STABLE' end as population_trend
from e""")
def _(spark, sf):
    return rounded(series.population_trend(_herd(spark, sf)), "earlier", "later")


@query("hampel", """
with w as (select id, ambient_temperature_c as x, list(ambient_temperature_c) over (partition by device_id order by recorded_epoch_ms, id
    rows between 10 preceding and current row) as recent from v_sensor_readings),
m as (select *, list_sort(recent)[6] as mid from w),
d as (select *, 1.4826 * list_sort(list_transform(recent, lambda v: abs(v - mid)))[6] as mad from m)
select id, round(case when len(recent) < 11 then x when mad = 0 then mid when abs(x - mid) > 3.0 * mad then mid else x end, 4) as ambient_temperature_c_hampel from d""")
def _(spark, sf):
    df = series.hampel(view(spark, sf, "v_sensor_readings"), ["device_id"], "ambient_temperature_c")
    return rounded(df.select("id", "ambient_temperature_c_hampel"), "ambient_temperature_c_hampel")


@query("ema", """
with recursive s as (select id, device_id, ambient_temperature_c as x, row_number() over (partition by device_id order by recorded_epoch_ms, id) as i
  from v_sensor_readings),
r as (select id, device_id, i, x as y from s where i = 1
  union all select s.id, s.device_id, s.i, 0.1 * s.x + (1 - 0.1) * r.y from r join s on s.device_id = r.device_id and s.i = r.i + 1)
select id, round(y, 4) as ambient_temperature_c_ema from r""")
def _(spark, sf):
    df = series.ema(view(spark, sf, "v_sensor_readings"), ["device_id"], "ambient_temperature_c", 0.1)
    return rounded(df.select("id", "ambient_temperature_c_ema"), "ambient_temperature_c_ema")


STRESS = """
with l as (select h3_cell, month(epoch_ms(recorded_epoch_ms)) as m, recorded_epoch_ms, id, ambient_temperature_c as v, 't' as metric from v_sensor_readings
  union all select h3_cell, month(epoch_ms(recorded_epoch_ms)), recorded_epoch_ms, id, relative_humidity_percent, 'h' from v_sensor_readings
    where relative_humidity_percent is not null),
b as (select *, avg(v) over w as mean, coalesce(stddev_samp(v) over w, 0) as sd from l
  window w as (partition by h3_cell, m, metric order by recorded_epoch_ms, id rows between unbounded preceding and 1 preceding)),
z as (select *, case when sd = 0 then 0 else (v - coalesce(mean, 0)) / sd end as z from b)
"""


@query("stress_flags", STRESS + """
select id, bool_or(abs(z) > 2.5) as stress, count(*) filter (abs(z) > 2.5) as triggered_metrics from z group by id""")
def _(spark, sf):
    df = view(spark, sf, "v_sensor_readings").withColumn("at", F.timestamp_millis("recorded_epoch_ms"))
    out = series.stress_flags(df, ["ambient_temperature_c", "relative_humidity_percent"], "h3_cell", "at")
    return out.select("id", "stress", "triggered_metrics")


@query("stress_scores", STRESS + "select id, metric, round(z, 4) as z from z")
def _(spark, sf):
    df = view(spark, sf, "v_sensor_readings").withColumn("at", F.timestamp_millis("recorded_epoch_ms"))
    out = series.stress_scores(df, ["ambient_temperature_c", "relative_humidity_percent"], "h3_cell", "at")
    short = F.when(F.col("metric") == "ambient_temperature_c", "t").otherwise("h")
    return rounded(out.select("id", short.alias("metric"), "z"), "z")


@query("debounce_events", """
with w as (select *, detected_epoch_ms + 600000 as fin from v_detections where source_type = 'ACOUSTIC'),
r as (select *, max(fin) over (partition by device_id, class_name order by detected_epoch_ms, id rows between unbounded preceding and 1 preceding) as reach from w),
i as (select *, sum(case when reach is null or detected_epoch_ms - 3000000 > reach then 1 else 0 end)
  over (partition by device_id, class_name order by detected_epoch_ms, id) as island from r)
select device_id, class_name, min(detected_epoch_ms) as start_ms, max(fin) as end_ms, round(max(confidence), 4) as confidence,
  count(distinct id) as window_count from i group by device_id, class_name, island""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").filter("source_type = 'ACOUSTIC'")
    return rounded(series.debounce_events(df, ["device_id", "class_name"], 600_000, 3_000_000), "confidence")


@query("suppress_alerts", """
with a as (select id, case when id % 6 = 0 then 'CRITICAL' else 'HIGH' end as priority, detected_epoch_ms, class_name, device_id from v_detections),
l as (select *, lag(detected_epoch_ms) over (partition by class_name, device_id order by detected_epoch_ms, id) as prev from a where priority <> 'CRITICAL')
select id from l where prev is null or detected_epoch_ms - prev >= 3600000
union all select id from a where priority = 'CRITICAL'""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").selectExpr(
        "id as event_id", "case when id % 6 = 0 then 'CRITICAL' else 'HIGH' end as priority", "detected_epoch_ms as ts_ms",
        "'threat' as event_type", "class_name as classification", "device_id as zone")
    return series.suppress_alerts(df, window_ms=3_600_000).select(F.col("event_id").alias("id"))


@query("cooldown", """
with recursive s as (select id, species_id, device_id, detected_epoch_ms as ms, row_number() over (partition by species_id, device_id order by detected_epoch_ms, id) as i
  from v_detections where category = 'immediate_threat' and species_id is not null),
r as (select id, species_id, device_id, ms, i, ms as last_ms, true as accepted from s where i = 1
  union all select s.id, s.species_id, s.device_id, s.ms, s.i, case when s.ms - r.last_ms >= 43200000 then s.ms else r.last_ms end, s.ms - r.last_ms >= 43200000
  from r join s on s.species_id = r.species_id and s.device_id = r.device_id and s.i = r.i + 1)
select id, accepted from r""")
def _(spark, sf):
    df = view(spark, sf, "v_detections").filter("category = 'immediate_threat' and species_id is not null").select(
        "id", "species_id", "device_id", F.col("detected_epoch_ms").alias("ts_ms"))
    return series.cooldown(df, ["species_id", "device_id"], window_ms=43_200_000).select("id", "accepted")


PREVIOUS = """
with e as (select species_id, h3_cell, period_end_epoch_ms, arg_max(conservation_risk_index, id) as cri from v_risk_assessments group by 1, 2, 3),
p as (select *, lag(cri) over w as pc, lag(period_end_epoch_ms) over w as pm from e
  window w as (partition by species_id, h3_cell order by period_end_epoch_ms)),
j as (select a.id, a.conservation_risk_index as cri, a.period_end_epoch_ms as ms,
    case when a.period_end_epoch_ms - pm <= 7776000000 then pm end as previous_end_ms,
    case when a.period_end_epoch_ms - pm <= 7776000000 then pc end as prev
  from v_risk_assessments a join p using (species_id, h3_cell, period_end_epoch_ms))
"""


@query("previous_assessment", PREVIOUS + "select id, previous_end_ms, round(prev, 6) as previous_conservation_risk_index from j")
def _(spark, sf):
    df = series.previous_assessment(view(spark, sf, "v_risk_assessments"))
    return rounded(df.select("id", "previous_end_ms", "previous_conservation_risk_index"), "previous_conservation_risk_index", digits=6)


@query("momentum", PREVIOUS + """
, d as (select *, coalesce((ms - previous_end_ms) / 86400000.0, 30.0) as days, coalesce(cri - prev, 0.0) as delta from j)
select id, days as momentum_window_days, round(delta, 6) as delta_cri, round(delta / days, 12) as risk_momentum_per_day,
  case when delta / days / 100 > 0.001 then 'ACCELERATING' when delta / days / 100 < -0.001 then 'DECAYING' else 'STABLE' end as trajectory from d""")
def _(spark, sf):
    df = series.momentum(series.previous_assessment(view(spark, sf, "v_risk_assessments")))
    df = df.select("id", "momentum_window_days", "delta_cri", "risk_momentum_per_day", "trajectory")
    return rounded(rounded(df, "delta_cri", digits=6), "risk_momentum_per_day", digits=12)


@query("last_known", """
select sensor_mac, recorded_epoch_ms, relative_humidity_percent from (select *, row_number() over (partition by sensor_mac order by recorded_epoch_ms desc) as rn
  from v_sensor_readings where relative_humidity_percent is not null) where rn = 1""")
def _(spark, sf):
    return series.last_known(view(spark, sf, "v_sensor_readings"), ["sensor_mac"], "recorded_epoch_ms", "relative_humidity_percent")


@query("minmax", """
select id, round(case when hi = lo then 0.5 else (ambient_temperature_c - lo) / (hi - lo) end, 6) as ambient_temperature_c_norm from (
  select id, ambient_temperature_c, min(ambient_temperature_c) over (partition by h3_cell) as lo, max(ambient_temperature_c) over (partition by h3_cell) as hi
  from v_sensor_readings)""")
def _(spark, sf):
    df = series.minmax(view(spark, sf, "v_sensor_readings"), "ambient_temperature_c", ["h3_cell"])
    return rounded(df.select("id", "ambient_temperature_c_norm"), "ambient_temperature_c_norm", digits=6)
