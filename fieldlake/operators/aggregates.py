"""Grouped summaries of readings, detections, fixes and assessments.

All of them are plain hash aggregates: map tasks combine before the shuffle, so a hot
sensor or a hot hour costs one row per task, not one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import AGE_CLASSES, ANALYTICS, BUCKET_MS, RISK
from fieldlake.functions import jsonx
from fieldlake.functions.mathx import delta_trend, escalation_level
from fieldlake.functions.text import label_of, unit_of
from fieldlake.functions.timex import bucket_start, col, day_index, scalar_bucket_start, count_buckets
from fieldlake.operators import scale
from fieldlake.operators.filters import LAYERS, filter_layer, metric_column, valid_readings

# Metadata keys of the inference workers.
AGE_KEYS = ("age_class", "ageClass")
DECIBEL_KEYS = ("peak_db", "peakDb", "sound_level_db", "decibels")


def _count_if(test: Column) -> Column:
    return F.count(F.when(test, F.lit(1)))


def bucket_stats(df: DataFrame, layer: str, bucket, metrics, keys=()) -> DataFrame:
    """Count, threats (detections) and avg/min/max/count of each metric per time bucket."""
    spec = LAYERS[layer]
    aggs = [F.count(F.lit(1)).alias("sample_count")]
    if spec.table == "detections":
        aggs.append(_count_if(F.col("category") == "immediate_threat").alias("threat_count"))
    for name in metrics:
        value = metric_column(name)
        aggs += [F.avg(value).alias(f"{name}_avg"), F.min(value).alias(f"{name}_min"),
                 F.max(value).alias(f"{name}_max"), F.count(value).alias(f"{name}_count")]
    return df.groupBy(*keys, bucket_start(spec.time, bucket).alias("bucket_epoch_ms")).agg(*aggs)


def detection_summary(df: DataFrame, start: int, end: int, keys=(), **filters) -> DataFrame:
    return filter_layer(df, "detections", start, end, **filters).groupBy(*keys).agg(*_detection_aggs())


def _detection_aggs():
    return [F.count(F.lit(1)).alias("total_detections"),
            _count_if(F.col("category") == "target_wildlife").alias("wildlife_sightings"),
            _count_if(F.col("category") == "immediate_threat").alias("threat_alerts"),
            F.countDistinct("species_id").alias("species_detected")]


def gps_summary(df: DataFrame, start: int, end: int, keys=(), approximate: bool = False, **filters) -> DataFrame:
    return filter_layer(df, "gps", start, end, **filters).groupBy(*keys).agg(*_gps_aggs(approximate))


def _gps_aggs(approximate: bool = False):
    animals = F.approx_count_distinct("animal_id") if approximate else F.countDistinct("animal_id")
    return [F.count(F.lit(1)).alias("gps_fixes"), animals.alias("active_animals"),
            F.avg("speed_kmh").alias("average_speed_kmh")]


def environment_summary(df: DataFrame, start: int, end: int, metrics, keys=(), rows: int = ANALYTICS.rolling_rows) -> DataFrame:
    """Mean over sensors of each sensor's latest rolling mean.

    The latest rolling mean is the mean of the sensor's newest ``rows`` readings, so the
    query is a top-n per sensor, cut before the shuffle, not a window over the history.
    """
    good = valid_readings(filter_layer(df, "environmental", start, end))
    newest = scale.top_n(good.select(*keys, "sensor_mac", "recorded_epoch_ms", "id", *metrics), [*keys, "sensor_mac"],
                         [F.desc("recorded_epoch_ms"), F.desc("id")], rows)
    per_sensor = newest.groupBy(*keys, "sensor_mac").agg(*[F.avg(m).alias(m) for m in metrics])
    cards = per_sensor.groupBy(*keys).agg(F.count(F.lit(1)).alias("sensor_count"), *[F.avg(m).alias(m) for m in metrics])
    totals = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("reading_count"))
    if keys:
        return cards.join(totals, list(keys))
    return cards.withColumn("reading_count", totals.scalar())


def risk_summary(df: DataFrame, start: int, end: int, keys=(), **filters) -> DataFrame:
    """Cards over the latest assessment of each (species, cell)."""
    rows = filter_layer(df, "risk", start, end, **filters)
    if "escalation_level" not in rows.columns:
        rows = rows.withColumn("escalation_level", escalation_level("conservation_risk_index"))
    latest = scale.latest_per(rows.select(*keys, "species_id", "h3_cell", "period_end_epoch_ms", "id", "escalation_level",
                                          "conservation_risk_index", "intervention_priority_index"),
                              [*keys, "species_id", "h3_cell"], "period_end_epoch_ms", "id")
    return latest.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("assessed_cells"), F.max("conservation_risk_index").alias("max_cri"),
        F.avg("conservation_risk_index").alias("mean_cri"), _count_if(F.col("escalation_level") >= 4).alias("critical_cells"),
        F.max("intervention_priority_index").alias("top_ipi"))


def summary_cards(tables: dict[str, DataFrame], start: int, end: int, metrics, species=None) -> DataFrame:
    """Dashboard cards: value, previous value, change and trend. Each table is read once for both windows."""
    before = start - (end - start)

    def both(layer, **extra):
        name, time = LAYERS[layer].table, LAYERS[layer].time
        rows = filter_layer(tables[name], layer, before, end, **extra)
        return rows.withColumn("part", F.when(F.col(time) >= start, "current").otherwise("previous"))

    only = {} if species is None else {"species": species}
    blocks = {
        "detections": both("detections", **only).groupBy("part").agg(*_detection_aggs()),
        "gps": both("gps", **only).groupBy("part").agg(*_gps_aggs()),
        "environmental": environment_summary(both("environmental"), before, end, metrics, keys=["part"])
        .drop("sensor_count", "reading_count"),
        "risk": risk_summary(both("risk", **only), before, end, keys=["part"]),
    }
    long = None
    for domain, block in blocks.items():
        names = [c for c in block.columns if c != "part"]
        stacked = block.select("part", F.lit(domain).alias("domain"), F.explode(F.array(*[
            F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")) for n in names])).alias("card"))
        stacked = stacked.select("part", "domain", "card.key", "card.value")
        long = stacked if long is None else long.unionByName(stacked)
    cards = long.groupBy("domain", "key").agg(
        F.max(F.when(F.col("part") == "current", F.col("value"))).alias("value"),
        F.max(F.when(F.col("part") == "previous", F.col("value"))).alias("previous_value"))
    counted = F.col("key").isin("total_detections", "wildlife_sightings", "threat_alerts", "species_detected",
                                "gps_fixes", "active_animals", "assessed_cells", "critical_cells")
    cards = (cards.withColumn("value", F.when(counted, F.coalesce("value", F.lit(0.0))).otherwise(F.col("value")))
             .withColumn("previous_value", F.when(counted, F.coalesce("previous_value", F.lit(0.0)))
                         .otherwise(F.col("previous_value"))))
    percent, trend = delta_trend("value", "previous_value")
    return cards.select("domain", "key", label_of("key").alias("label"), unit_of("key").alias("unit"), "value",
                        "previous_value", percent.alias("delta_percent"), trend.alias("trend"))


def delta_text(percent, trend, window: str) -> Column:
    """Card caption, e.g. ``Up 12.5% vs previous 24h``."""
    word = F.when(col(trend) == "up", "Up").otherwise("Down")
    tail = F.lit(f" vs previous {window}")
    return (F.when(col(trend) == "unknown", "No comparison data")
            .when(col(percent).isNull(), F.concat(word, F.lit(" from 0"), tail))
            .when(col(trend) == "flat", F.concat(F.lit("Stable"), tail))
            .otherwise(F.concat(word, F.lit(" "), F.format_string("%.1f", F.abs(col(percent))), F.lit("%"), tail)))


def window_text(hours: float) -> str:
    return f"{int(hours // 24)}d" if hours % 24 == 0 and hours >= 48 else f"{hours:g}h"


# Metrics offered by the historical chart and how they aggregate.
COUNT_METRICS = {
    "detection_count": lambda: F.count(F.lit(1)),
    "wildlife_count": lambda: _count_if(F.col("category") == "target_wildlife"),
    "threat_count": lambda: _count_if(F.col("category") == "immediate_threat"),
    "reading_count": lambda: F.count(F.lit(1)),
    "fix_count": lambda: F.count(F.lit(1)),
    "active_animals": lambda: F.countDistinct("animal_id"),
}


def historical(df: DataFrame, layer: str, metrics, bucket: str, start: int, end: int, method: str = "forward_fill",
               max_gap: int = ANALYTICS.max_gap, **filters) -> DataFrame:
    """Chart series on a dense axis: counts are 0 where nothing was recorded, averages are imputed.

    The axis has at most the chart's point budget, so it and the aggregate beside it are small.
    """
    from fieldlake.operators.series import impute

    rows = filter_layer(df, layer, start, end, **filters)
    if layer == "environmental":
        rows = valid_readings(rows)
    names = {"mean_confidence": "confidence"}
    aggs = [COUNT_METRICS[m]().cast("double").alias(m) if m in COUNT_METRICS
            else F.avg(metric_column(names.get(m, m))).alias(m) for m in metrics]
    stats = rows.groupBy(bucket_start(LAYERS[layer].time, bucket).alias("bucket_epoch_ms")).agg(
        F.count(F.lit(1)).alias("sample_count"), *aggs)
    size, first = BUCKET_MS[bucket], scalar_bucket_start(start, bucket)
    steps = count_buckets(start, end, bucket)
    axis = df.sparkSession.range(steps).select((F.col("id") * size + first).alias("bucket_epoch_ms"))
    dense = axis.join(stats, "bucket_epoch_ms", "left").withColumn("sample_count", F.coalesce("sample_count", F.lit(0)))
    long = dense.select("bucket_epoch_ms", "sample_count", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.lit("count" if m in COUNT_METRICS else "avg").alias("aggregate"),
                 (F.coalesce(F.col(m), F.lit(0.0)) if m in COUNT_METRICS else F.col(m)).alias("raw"))
        for m in metrics])).alias("p")).select("bucket_epoch_ms", "sample_count", "p.*")
    filled = impute(long, ["metric"], "bucket_epoch_ms", "raw", method, max_gap)
    return filled.drop("raw")


def sensor_means(df: DataFrame, metrics, keys=("h3_cell",)) -> DataFrame:
    return valid_readings(df).groupBy(*keys).agg(*[F.avg(m).alias(m) for m in metrics])


def daily_means(df: DataFrame, metrics, keys=("h3_cell",), time="recorded_epoch_ms") -> DataFrame:
    return (valid_readings(df).groupBy(*keys, day_index(time).alias("day_index"))
            .agg(*[F.avg(m).alias(m) for m in metrics]))


def telemetry_summary(df: DataFrame, keys=("species_id",)) -> DataFrame:
    rate = jsonx.json_num("physiological_metrics", "$.heart_rate_bpm")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("fix_count"),
        F.avg(F.when(F.col("speed_kmh") >= 0, F.col("speed_kmh"))).alias("mean_speed_kmh"),
        F.avg(F.when(rate > 0, rate)).alias("mean_heart_rate_bpm"))


def frame_key() -> Column:
    """One camera frame is one sighting; a detection without a frame stands alone."""
    return F.coalesce(F.concat(F.lit("frame-"), F.col("source_record_id").cast("string")),
                      F.concat(F.lit("detection-"), F.col("id").cast("string")))


def frames(df: DataFrame, keys=("species_id",), time="detected_epoch_ms") -> DataFrame:
    """Per frame: first time seen, detections and age classes."""
    age = jsonx.first_json_label("metadata", AGE_KEYS, AGE_CLASSES)
    return (df.withColumn("frame", frame_key()).withColumn("age", age).groupBy(*keys, "frame").agg(
        F.min(time).alias(time), F.count(F.lit(1)).alias("detections"),
        *[_count_if(F.col("age") == a).alias(f"{a}_count") for a in AGE_CLASSES]))


def herd_series(frames_df: DataFrame, keys=("species_id",), time="detected_epoch_ms") -> DataFrame:
    """Herd size per day is the largest single-frame count, so repeats never double count."""
    return (frames_df.groupBy(*keys, day_index(time).alias("day_index"))
            .agg(F.max("detections").cast("double").alias("herd_count")))


def age_classes(frames_df: DataFrame, keys=("species_id",)) -> DataFrame:
    return frames_df.groupBy(*keys).agg(*[F.sum(f"{a}_count").alias(a) for a in AGE_CLASSES])


def density_grid(df: DataFrame, n: int = RISK.density_grid, keys=("species_id",)) -> DataFrame:
    """Mean detections per frame and grid square of the frame; squares never hit are absent."""
    def square(low, high):
        return F.least(((F.col(low) + F.col(high)) / 2.0 * n).cast("int"), F.lit(n - 1))
    cells = df.groupBy(*keys, square("bbox_top", "bbox_bottom").alias("grid_row"),
                       square("bbox_left", "bbox_right").alias("grid_col")).agg(F.count(F.lit(1)).alias("hits"))
    seen = df.select(*keys, frame_key().alias("frame")).groupBy(*keys).agg(F.countDistinct("frame").alias("frames"))
    return cells.join(seen, list(keys)).select(*keys, "grid_row", "grid_col", (F.col("hits") / F.col("frames")).alias("density"))


def decibel() -> Column:
    return jsonx.first_json_num("metadata", DECIBEL_KEYS, -200.0, 250.0)


def acoustic_threats(df: DataFrame, keys=("species_id",)) -> DataFrame:
    """Threat count and loudness of acoustic threats (peak, mean and how many carried a level)."""
    level = decibel()
    return (df.filter((F.col("source_type") == "ACOUSTIC") & (F.col("category") == "immediate_threat")).groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("acoustic_threats"), F.count(level).alias("levels"),
                 F.max(level).alias("peak_db"), F.avg(level).alias("mean_db")))


def threat_context(events: DataFrame, keys, start, end, time="detected_epoch_ms", n: int | None = None) -> DataFrame:
    """Counts per threat class with the half-window trend; with ``n`` the most frequent classes per scope, ranked."""
    middle = (col(start) + col(end)) / 2.0
    later = F.col(time) >= middle
    classes = events.groupBy(*keys, "class_name").agg(
        F.count(F.lit(1)).alias("events"), (_count_if(later) - _count_if(~later)).alias("trend"),
        F.max("confidence").alias("max_confidence"), F.max(time).alias("latest_ms"))
    return classes if n is None else scale.top_n(classes, list(keys), [F.desc("events"), F.desc("latest_ms"), F.asc("class_name")], n)


def threat_cells(events: DataFrame, keys, cell="cell", n: int | None = None) -> DataFrame:
    """Events per cell; with ``n`` only the cells with the most events of every key, ranked."""
    counts = events.filter(F.col(cell).isNotNull()).groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("events"))
    return counts if n is None else scale.top_n(counts, list(keys), [F.desc("events"), F.asc(cell)], n)


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    rows = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
            for name, df in tables.items()]
    return reduce(DataFrame.unionByName, rows)


def ingest_counters(df: DataFrame, status="status", keys=()) -> DataFrame:
    """Received, stored, duplicate and failed rows of a batch."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"),
        *[_count_if(F.col(status) == s).alias(s) for s in ("stored", "duplicate", "failed")])


def indicator_summary(df: DataFrame, keys) -> DataFrame:
    """Run summary over section rows that carry a density and a decibel level."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.max("decibels").alias("peak_db"),
                                 F.avg("decibels").alias("mean_db"), F.sum("density").alias("density_total"))


def with_mean_home_range(areas: DataFrame, keys, minimum: int = RISK.minimum_fixes) -> DataFrame:
    """Mean area over animals with enough fixes and a real polygon."""
    good = areas.filter((F.col("fixes") >= minimum) & (F.col("area_km2") > 0))
    return good.groupBy(*keys).agg(F.avg("area_km2").alias("mean_range_km2"), F.count(F.lit(1)).alias("animals"))


