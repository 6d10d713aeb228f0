"""Layers, composable filters and row projections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import ESCALATION_TIERS, MEASUREMENTS, RISK, RiskConfig
from fieldlake.functions import geo, jsonx, text
from fieldlake.functions.timex import col
from fieldlake.operators import scale


@dataclass(frozen=True)
class Layer:
    """A logical reading layer: table, time column, offered filters and metrics."""

    table: str
    time: str
    source_type: str | None = None
    has_species: bool = True
    has_cell: bool = False
    json_columns: tuple = ()
    metrics: tuple = ()

    @property
    def has_category(self) -> bool:
        return self.source_type is not None


LAYERS = {
    "gps": Layer("telemetry", "recorded_epoch_ms", json_columns=("physiological_metrics",),
                 metrics=("speed_kmh", "altitude", "hdop", "satellite_count", "battery_voltage", "heart_rate_bpm")),
    "environmental": Layer("sensor_readings", "recorded_epoch_ms", has_species=False, has_cell=True, metrics=MEASUREMENTS),
    "acoustic": Layer("detections", "detected_epoch_ms", "ACOUSTIC", json_columns=("metadata",), metrics=("confidence",)),
    "vision": Layer("detections", "detected_epoch_ms", "VISION", json_columns=("metadata",), metrics=("confidence",)),
    "detections": Layer("detections", "detected_epoch_ms", json_columns=("metadata",), metrics=("confidence",)),
    "risk": Layer("risk_assessments", "period_end_epoch_ms", has_cell=True, metrics=(
        "conservation_risk_index", "intervention_priority_index", "inbreeding_penalty_index", "risk_momentum_per_day",
        "population_subscore", "habitat_subscore", "threat_subscore", "climate_subscore", "genetics_subscore",
        "behavior_subscore")),
}


def metric_column(name: str) -> Column:
    if name == "heart_rate_bpm":
        return jsonx.json_num("physiological_metrics", "$.heart_rate_bpm")
    return F.col(name)


def scan_layer(tables: dict[str, DataFrame], layer: str) -> DataFrame:
    spec = LAYERS[layer]
    df = tables[spec.table]
    return df if spec.source_type is None else df.filter(F.col("source_type") == spec.source_type)


def filter_layer(df: DataFrame, layer: str, start: int | None = None, end: int | None = None,
                 device: str | None = None, species: int | None = None, cell: str | None = None,
                 category: str | None = None, bbox: tuple | None = None, closed: bool = False) -> DataFrame:
    """Conjunction of the given filters, each a plain predicate the Parquet scan can use.

    Windows are ``[start, end)``; ``closed`` keeps both ends. A filter the layer does not
    offer is an error rather than silently ignored.
    """
    spec = LAYERS[layer]
    if species is not None and not spec.has_species:
        raise ValueError(f"{layer} rows have no species")
    if cell is not None and not spec.has_cell:
        raise ValueError(f"{layer} rows have no grid cell")
    if category is not None and not (spec.has_category or layer == "detections"):
        raise ValueError(f"{layer} rows have no category")
    tests = []
    if spec.source_type is not None:
        tests.append(F.col("source_type") == spec.source_type)
    if start is not None:
        tests.append(F.col(spec.time) >= start)
    if end is not None:
        tests.append(F.col(spec.time) <= end if closed else F.col(spec.time) < end)
    for name, value in (("device_id", device), ("species_id", species), ("category", category)):
        if value is not None:
            tests.append(F.col(name) == value)
    if cell is not None:
        tests.append(F.col("h3_cell") == cell.strip().lower())
    if bbox is not None:
        if any(edge is None for edge in bbox):
            raise ValueError("a bounding box needs all four edges")
        if bbox[0] > bbox[1]:
            raise ValueError("min_lat is above max_lat")
        tests.append(geo.in_bbox("latitude", "longitude", bbox))
    for test in tests:
        df = df.filter(test)
    return df


def valid_readings(df: DataFrame) -> DataFrame:
    return df.filter(F.col("quality_flag") != "INVALID")


def is_critical(threshold: float = 0.5, categories=("immediate_threat",), flag: str | None = None) -> Column:
    """Reading that takes the alert path: flagged by the device, or a confident threat class."""
    by_class = F.col("category").isin(*categories) & (F.col("confidence") >= threshold)
    return by_class if flag is None else F.coalesce(F.col(flag), F.lit(False)) | by_class


def is_poaching(ref_ms, time="detected_epoch_ms", cfg: RiskConfig = RISK) -> Column:
    age_h = (col(ref_ms) - col(time)) / F.lit(3_600_000.0)
    return ((text.threat_weight("class_name", cfg) >= cfg.poaching_weight)
            & (F.col("confidence") >= cfg.poaching_confidence) & age_h.between(0.0, cfg.poaching_hours))


def not_future(ts, tolerance_sec: float, now: Column | None = None) -> Column:
    """Clock check on epoch ms; ``now`` (epoch ms) is a parameter so that batch runs repeat."""
    limit = (now if now is not None else F.unix_millis(F.current_timestamp())) + F.lit(int(tolerance_sec * 1000))
    return col(ts) <= limit


def active_zones(df: DataFrame, species=None) -> DataFrame:
    keep = F.col("active")
    if species is not None:
        keep = keep & (F.col("species_id").isNull() | (F.col("species_id") == species))
    return df.filter(keep)


def features_at(df: DataFrame, ms) -> DataFrame:
    at = ms if isinstance(ms, Column) else F.lit(ms)
    return df.filter((F.col("detected_epoch_ms") <= at)
                     & (F.col("removed_epoch_ms").isNull() | (F.col("removed_epoch_ms") > at)))


def measurements_view(df: DataFrame) -> DataFrame:
    """Environmental rows with the reported measurements folded into one map."""
    present = [n for n in MEASUREMENTS if n in df.columns]
    return df.withColumn("measurements", jsonx.measurements_map(present)).drop(*present)


def filter_reports(df: DataFrame, species: DataFrame | None = None, species_id=None, species_name=None, cell=None,
                   tier=None, min_level=None, priority_tier=None, min_cri=None, start=None, end=None,
                   critical_inbreeding: bool = False) -> DataFrame:
    """Report list filters; ``tier`` is a tier name or a level 1-5."""
    if species_id is not None:
        df = df.filter(F.col("species_id") == species_id)
    if species_name is not None:
        named = species.filter(text.species_eq("scientific_name", species_name)).select(F.col("id").alias("species_id"))
        df = df.join(named, "species_id", "left_semi")
    if cell is not None:
        df = df.filter(F.col("h3_cell") == cell.strip().lower())
    if tier is not None:
        name = str(tier).strip().upper()
        level = int(name) if name.isdigit() else ESCALATION_TIERS.index(name) + 1
        if not 1 <= level <= len(ESCALATION_TIERS):
            raise ValueError(f"no tier {tier!r}")
        df = df.filter(F.col("escalation_level") == level)
    if min_level is not None:
        df = df.filter(F.col("escalation_level") >= min_level)
    if priority_tier is not None:
        df = df.filter(F.col("intervention_priority_tier") == priority_tier.strip().upper())
    if min_cri is not None:
        df = df.filter(F.col("conservation_risk_index") >= min_cri)
    if start is not None:
        df = df.filter(F.col("generated_at") >= start)
    if end is not None:
        df = df.filter(F.col("generated_at") <= end)
    return df.filter(F.col("critical_inbreeding_risk")) if critical_inbreeding else df


# Columns that never leave the lake, per table.
INTERNAL_COLUMNS = {
    "species": ("created_at", "updated_at"),
    "telemetry": ("recorded_epoch_ms", "geom"),
    "sensor_readings": ("recorded_epoch_ms", "geom"),
    "detections": ("detected_epoch_ms", "geom"),
    "genetics_records": ("geom",),
    "risk_assessments": ("period_end_epoch_ms",),
}


def public_view(df: DataFrame, table: str, species: DataFrame | None = None) -> DataFrame:
    """Rows without internal columns, the species nested as a struct."""
    out = df
    if species is not None:
        nested = species.select(F.col("id").alias("species_id"), F.struct(
            *[c for c in species.columns if c not in INTERNAL_COLUMNS["species"]]).alias("species"))
        out = out.join(nested, "species_id", "left")
    return out.drop(*INTERNAL_COLUMNS.get(table, ()))


def decode_rows(df: DataFrame, timestamps=(), dates=(), numbers=(), json_columns=(), points=()) -> DataFrame:
    """Typed columns from stored text: timestamps, dates, numbers, JSON variants, geometry blobs."""
    out = df
    for name in timestamps:
        out = out.withColumn(name, F.try_to_timestamp(name))
    for name in dates:
        out = out.withColumn(name, F.col(name).try_cast("date"))
    for name in numbers:
        out = out.withColumn(name, F.col(name).try_cast("double"))
    for name in json_columns:
        out = out.withColumn(name, jsonx.decode_json(name))
    for name in points:
        out = out.withColumn(name, geo.point_from_blob(name))
    return out


def tier_name(level) -> Column:
    return F.get(F.array(*[F.lit(t) for t in ESCALATION_TIERS]), col(level) - 1)


def report_view(df: DataFrame, narrative_chars: int | None = None) -> DataFrame:
    """List or detail row: nested species, scope and scores, the priority index from its own column."""
    def some(*names):
        return [F.col(n) if n in df.columns else F.lit(None).alias(n) for n in names]
    subscores = [c for c in df.columns if c.endswith("_subscore")]
    scores = [F.col("conservation_risk_index"), F.col("escalation_level"), tier_name("escalation_level").alias("escalation_tier"),
              *some("intervention_priority_index", "intervention_priority_tier", "inbreeding_penalty_index",
                    "critical_inbreeding_risk", "risk_momentum_per_day", "momentum_window_days", "population_trend",
                    "effective_population_size"),
              F.struct(*[F.col(c).alias(c.removesuffix("_subscore")) for c in subscores]).alias("subscores")
              if subscores else F.lit(None).alias("subscores")]
    out = df.select("id", F.struct(F.col("species_id").alias("id"),
                                   *some("scientific_name", "common_name", "iucn_status")).alias("species"),
                    F.struct(*some("h3_cell", "period_start", "period_end", "latitude", "longitude")).alias("scope"),
                    F.struct(*scores).alias("scores"), *some("model_version", "generated_at", "narrative_report"))
    if narrative_chars is None:
        return out
    return (out.withColumn("narrative_excerpt", text.excerpt("narrative_report", narrative_chars))
            .withColumn("narrative_characters", F.length("narrative_report")).drop("narrative_report"))


def with_count(df: DataFrame, keys) -> DataFrame:
    """Partition size beside every row: an aggregate joined back, so no key is buffered in one task."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("key_rows"))
    return scale.same_key_join(df, counts, list(keys))


