"""Comparison of parent zones on five axes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.config import ANALYTICS, AnalyticsConfig
from fieldlake.functions import h3grid
from fieldlake.operators import scale, spatial, topk
from fieldlake.operators.filters import filter_layer, valid_readings


def zone_activity(tables: dict[str, DataFrame], start: int, end: int, cell_zone, place_zone, species=None) -> DataFrame:
    """Counts and axis values per zone. ``cell_zone(column)`` maps a stored cell to its zone and
    ``place_zone(lat, lon)`` a position; positions are aggregated to four decimals first, so a
    Python grid function runs per place and not per row."""
    only = {} if species is None else {"species": species}
    t = F.col("ambient_temperature_c")
    env = (valid_readings(filter_layer(tables["sensor_readings"], "environmental", start, end)).groupBy("h3_cell")
           .agg(F.count(F.lit(1)).alias("readings"), F.count(t).alias("t_n"), F.sum(t).alias("t_sum"), F.sum(t * t).alias("t_sq"))
           .withColumn("zone_id", cell_zone("h3_cell")).groupBy("zone_id").agg(*[F.sum(c).alias(c) for c in ("readings", "t_n", "t_sum", "t_sq")]))
    wild = F.count(F.when(F.col("category") == "target_wildlife", 1))
    loud = F.count(F.when((F.col("source_type") == "ACOUSTIC") & (F.col("category") == "immediate_threat"), 1))
    det = spatial.pre_round(filter_layer(tables["detections"], "detections", start, end, **only), 4,
                            aggs=[F.count(F.lit(1)).alias("detections"), wild.alias("wildlife"), loud.alias("loud")])
    det = det.withColumn("zone_id", place_zone("latitude", "longitude")).groupBy("zone_id").agg(*[F.sum(c).alias(c) for c in ("detections", "wildlife", "loud")])
    gps = spatial.pre_round(filter_layer(tables["telemetry"], "gps", start, end, **only), 4, ["animal_id"])
    gps = gps.withColumn("zone_id", place_zone("latitude", "longitude")).groupBy("zone_id").agg(F.sum("rows").alias("fixes"), F.countDistinct("animal_id").alias("animals"))
    latest = scale.latest_per(filter_layer(tables["risk_assessments"], "risk", start, end, **only).select("species_id", "h3_cell", "period_end_epoch_ms", "id", "conservation_risk_index"),
                              ["species_id", "h3_cell"], "period_end_epoch_ms", "id")
    risk = latest.withColumn("zone_id", cell_zone("h3_cell")).groupBy("zone_id").agg(F.count(F.lit(1)).alias("assessments"), F.avg("conservation_risk_index").alias("conservation_risk"))
    parts = [p.filter("zone_id is not null") for p in (env, det, gps, risk)]
    wide = reduce(lambda a, b: a.join(b, "zone_id", "full_outer"), parts)
    wide = wide.fillna(0, [c for c in wide.columns if c not in ("zone_id", "conservation_risk")])
    n = F.nullif(F.col("t_n").cast("double"), F.lit(0.0))
    spread = F.sqrt(F.greatest(F.col("t_sq") / n - F.pow(F.col("t_sum") / n, F.lit(2.0)), F.lit(0.0)))
    return wide.select("zone_id", (F.col("readings") + F.col("detections") + F.col("fixes") + F.col("assessments")).alias("activity"),
                       F.col("wildlife").cast("double").alias("wildlife_sightings"), F.col("animals").cast("double").alias("animal_presence"),
                       F.when(F.col("t_n") >= 2, spread).alias("temperature_variability"), F.col("loud").cast("double").alias("acoustic_threats"), "conservation_risk")


def health_score(cfg: AnalyticsConfig = ANALYTICS) -> Column:
    """Weighted share of the best reachable value over the axes with data; the sign says which way is good."""
    got, best = F.lit(0.0), F.lit(0.0)
    for axis, weight in cfg.radar_weights.items():
        if weight:
            value = F.col(f"{axis}_norm")
            got = got + F.coalesce(abs(weight) * (value if weight > 0 else 1.0 - value), F.lit(0.0))
            best = best + F.when(value.isNotNull(), abs(weight)).otherwise(0.0)
    return got / F.nullif(best, F.lit(0.0)) * 100.0


def zone_radar(tables: dict[str, DataFrame], start: int, end: int, resolution: int | None = None, zones=None, limit: int = 5, species=None,
               cell_zone=None, place_zone=None, cfg: AnalyticsConfig = ANALYTICS) -> DataFrame:
    """The chosen or the most active zones with raw and normalised axes and a health score.

    Axes are normalised across the zones shown, so a zone's score depends on the selection.
    Chosen zones that recorded nothing are rows too.
    """
    level = cfg.zone_resolution if resolution is None else resolution
    cell_zone = cell_zone or (lambda c: h3grid.cell_parent(c, level))
    place_zone = place_zone or (lambda la, lo: h3grid.cell_of(la, lo, level))
    rows = zone_activity(tables, start, end, cell_zone, place_zone, species)
    if zones is not None:
        wanted = rows.sparkSession.createDataFrame([(z.strip().lower(),) for z in dict.fromkeys(zones)], "zone_id string")
        rows = wanted.join(rows, "zone_id", "left").fillna(0, ["activity", "wildlife_sightings", "animal_presence", "acoustic_threats"])
    else:
        rows = topk.top_zones(rows, limit)
    # a handful of zones is left, so one window over all of them is the cheap plan
    shown = Window.partitionBy(F.lit(0))
    for axis in cfg.radar_weights:
        low, high = F.min(axis).over(shown), F.max(axis).over(shown)
        rows = rows.withColumn(f"{axis}_norm", F.when(F.col(axis).isNull(), None).when(high == low, F.lit(0.5))
                               .otherwise((F.col(axis) - low) / F.nullif(high - low, F.lit(0.0))))
    return rows.withColumn("health_score", health_score(cfg))
