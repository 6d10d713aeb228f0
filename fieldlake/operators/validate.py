"""Constraints as table operators: every row keeps its list of reasons, then the table is split."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import (CATEGORIES, DOMAINS, FIX_QUALITIES, GPS, HARDWARE_STATES, MEASUREMENT_RANGES, QUALITY_FLAGS,
                              RAW_SENSOR_RANGES, RISK, GpsConfig, RiskConfig)
from fieldlake.functions import jsonx, text
from fieldlake.functions.h3grid import is_cell
from fieldlake.functions.mathx import UNIT_SLACK, clamp_unit, escalation_level
from fieldlake.functions.timex import col
from fieldlake.operators import scale

VALID_FIX = "VALID_FIX"
FUTURE = "FUTURE_TIMESTAMP_ERROR"
BAD_COORDINATES = "INVALID_COORDINATE_BOUNDS"
TOO_FAST = "EXCEEDED_SPEED_THRESHOLD"


def reasons(*rules: tuple[str, Column]) -> Column:
    """array of the names of the violated rules; a rule that evaluates to null holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules]))


def split_valid(df: DataFrame, column: str = "reject_reasons") -> tuple[DataFrame, DataFrame]:
    return df.filter(F.size(column) == 0).drop(column), df.filter(F.size(column) > 0)


def outside(name: str, low, high) -> Column:
    value = F.col(name)
    tests = [value < low] if low is not None else []
    if high is not None:
        tests.append(value > high)
    broken = tests[0] if len(tests) == 1 else tests[0] | tests[1]
    return broken | F.isnan(value.cast("double"))


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name).cast("string")) == "")


def bad_position(lat="latitude", lon="longitude") -> Column:
    return ~(F.col(lat).between(-90, 90) & F.col(lon).between(-180, 180))


def half_position(lat="latitude", lon="longitude") -> Column:
    return F.col(lat).isNull() != F.col(lon).isNull()


# -- collars and sensors ----------------------------------------------------------------------

def validate_gps(df: DataFrame, now_ms, cfg: GpsConfig = GPS) -> DataFrame:
    """Status of each fix and hard rejects. Bad coordinates outrank a future clock.

    The speed verdict needs the animal's history and is ``tracking.speed_verdicts``.
    """
    limit = (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) + F.lit(int(cfg.future_days * 86_400_000))
    status = (F.when(F.coalesce(bad_position(), F.lit(True)), BAD_COORDINATES)
              .when(F.col("recorded_epoch_ms") > limit, FUTURE).otherwise(VALID_FIX))
    rules = [("altitude", F.col("altitude") < -11000)]
    for name, (low, high) in {"temperature": (-100, 100), "body_temperature": (-100, 100), "heart_rate": (0, 1000),
                              "battery_percentage": (0, 100)}.items():
        if name in df.columns:
            rules.append((name, outside(name, low, high)))
    for name, allowed in (("fix_quality", FIX_QUALITIES), ("hardware_state", HARDWARE_STATES)):
        if name in df.columns:
            rules.append((name, ~F.col(name).isin(*allowed)))
    return df.withColumn("validation_status", status).withColumn("reject_reasons", reasons(*rules))


def derive_hardware_state(df: DataFrame, cfg: GpsConfig = GPS) -> DataFrame:
    """Hardware state from the battery when unreported; fix quality from either field, UNKNOWN when absent."""
    stated = F.nullif(F.upper(F.trim("hardware_state")), F.lit(""))
    by_battery = F.when(F.col("battery_percentage") < cfg.battery_low, "BATTERY_LOW").otherwise("BATTERY_OK")
    quality = F.col("fix_quality")
    if "gps_fix_quality" in df.columns:
        quality = F.coalesce(quality, F.col("gps_fix_quality"))
    return (df.withColumn("hardware_state", F.coalesce(stated, by_battery))
            .withColumn("fix_quality", F.upper(F.trim(F.coalesce(quality, F.lit("UNKNOWN")))))
            .drop("gps_fix_quality"))


def validate_environmental(df: DataFrame, now_ms, suffix: str = "_filtered", cfg: GpsConfig = GPS) -> DataFrame:
    """Ranges on the filtered value where one exists; rainfall is never filtered."""
    limit = (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) + F.lit(int(cfg.future_days * 86_400_000))
    rules = []
    if "altitude" in df.columns:
        rules.append(("altitude", F.col("altitude") < -11000))
    for name, (low, high) in RAW_SENSOR_RANGES.items():
        source = f"{name}{suffix}" if f"{name}{suffix}" in df.columns else name
        if source in df.columns:
            rules.append((name, outside(source, low, high)))
    if "battery_percentage" in df.columns:
        rules.append(("battery_percentage", outside("battery_percentage", 0, 100)))
    status = (F.when(F.coalesce(bad_position(), F.lit(True)), BAD_COORDINATES)
              .when(F.col("recorded_epoch_ms") > limit, FUTURE).otherwise(VALID_FIX))
    return df.withColumn("validation_status", status).withColumn("reject_reasons", reasons(*rules))


# -- stored tables ----------------------------------------------------------------------------

def _measurement_rules(df):
    names = [n for n in MEASUREMENT_RANGES if n in df.columns]
    rules = [(n, outside(n, *MEASUREMENT_RANGES[n])) for n in names]
    if names:
        rules.append(("no_measurement", F.coalesce(*[F.col(n).cast("double") for n in names]).isNull()))
    return rules


def _sensor_rules(df):
    rules = _measurement_rules(df)
    rules += [("sensor_mac", ~text.is_mac(text.normalise_mac("sensor_mac")))] if "sensor_mac" in df.columns else []
    rules += [("quality_flag", ~F.col("quality_flag").isin(*QUALITY_FLAGS))] if "quality_flag" in df.columns else []
    return rules + _cell_rules(df)


def _cell_rules(df):
    return [("h3_cell", F.col("h3_cell").isNull() | ~is_cell(text.norm_text("h3_cell")))] if "h3_cell" in df.columns else []


def _detection_rules(df):
    boxes = ("frame_width", "frame_height", "bbox_left", "bbox_top", "bbox_right", "bbox_bottom")
    vision = F.col("source_type") == "VISION"
    missing, present = F.lit(False), F.lit(False)
    for name in boxes:
        missing, present = missing | F.col(name).isNull(), present | F.col(name).isNotNull()
    units = [(n, ~clamp_unit(n).between(0, 1)) for n in ("confidence", *boxes[2:])]
    return [("source_type", ~F.col("source_type").isin("VISION", "ACOUSTIC")),
            ("category", ~F.col("category").isin(*CATEGORIES)), *units,
            ("box_required", vision & missing), ("box_forbidden", ~vision & present),
            ("box_order", vision & ((F.col("bbox_left") >= F.col("bbox_right")) | (F.col("bbox_top") >= F.col("bbox_bottom")))),
            ("ended_before_start", F.col("ended_epoch_ms") < F.col("detected_epoch_ms")),
            ("position_pair", half_position()), ("position", bad_position())]


def _genetics_rules(df):
    values = F.map_values("allele_frequencies")
    count, he, rich = F.col("allele_count"), F.col("expected_heterozygosity"), F.col("allelic_richness")
    ne = F.col("effective_population_size")
    return [("frequencies_missing", F.coalesce(F.size("allele_frequencies") <= 0, F.lit(True))),
            ("frequency_range", F.exists(values, lambda v: ~v.between(0, 1))),
            ("frequency_sum", F.abs(jsonx.map_total("allele_frequencies") - 1) > UNIT_SLACK),
            ("allele_count", F.size(F.filter(values, lambda v: v > 0)) != count),
            ("monomorphic_heterozygosity", (count == 1) & (he != 0)),
            ("heterozygosity", ~((he >= 0) & (he < 1))),
            ("richness", (rich < 1) | (rich > count + 1e-9)),
            ("ne_method", ne.isNotNull() & F.col("ne_method").isNull()),
            ("ne_bounds", (F.col("ne_lower_bound") > ne) | (ne > F.col("ne_upper_bound"))),
            ("genotyped_individuals", F.col("genotyped_individuals") <= 0)]


def _species_rules(df):
    return [("ne_thresholds", F.col("critical_ne_threshold") >= F.col("viable_ne_threshold")),
            ("heart_rate_order", F.col("resting_heart_rate_min_bpm") > F.col("resting_heart_rate_max_bpm")),
            ("temperature_order", F.col("body_temperature_min_c") > F.col("body_temperature_max_c"))]


def _risk_rules(df):
    scores = [c for c in (*[f"{d}_subscore" for d in DOMAINS], "conservation_risk_index") if c in df.columns]
    rules = [(c, ~F.col(c).between(0, 100)) for c in scores]
    if "period_start" in df.columns:
        rules.append(("period_order", F.col("period_end") <= F.col("period_start")))
    if "inbreeding_penalty_index" in df.columns:
        rules.append(("inbreeding_penalty_index", F.col("inbreeding_penalty_index") < 0))
    return rules


def _evidence_rules(df):
    return [("no_evidence", F.col("census_count").isNull() & ~F.coalesce("threat_coverage", F.lit(False))),
            ("census", F.col("census_count") < 0), ("period_order", F.col("period_end") < F.col("period_start")),
            ("source", _blank("source"))]


RULES = {"sensor_readings": _sensor_rules, "detections": _detection_rules, "genetics_records": _genetics_rules,
         "species": _species_rules, "risk_assessments": _risk_rules, "focal_field_evidence": _evidence_rules}


def validate(df: DataFrame, table: str) -> DataFrame:
    return df.withColumn("reject_reasons", reasons(*RULES[table](df)))


def unknown_measurements(names) -> Column:
    """Names in a measurements map that no column stores."""
    return F.array_except(F.map_keys(col(names)), F.array(*[F.lit(n) for n in MEASUREMENT_RANGES]))


# -- eDNA ---------------------------------------------------------------------------------------

def validate_edna(df: DataFrame, loci: DataFrame, bounds: dict | None = None) -> DataFrame:
    """Row rules of a sample file; typed columns replace the text ones.

    ``loci`` is the configured assay list (target_species, locus_name, max_allele_count).
    """
    box = bounds or {"min_latitude": -90.0, "max_latitude": 90.0, "min_longitude": -180.0, "max_longitude": 180.0}
    lookup = loci.select(F.lower("target_species").alias("__sp"), F.lower("locus_name").alias("__lo"),
                         F.col("max_allele_count").cast("double").alias("__max"))
    known = loci.select(F.lower("target_species").alias("__sp")).distinct().withColumn("__known", F.lit(True))
    rows = df.withColumn("target_species", F.replace(F.trim("target_species"), F.lit("_"), F.lit(" ")))
    rows = rows.withColumn("__sp", F.lower("target_species")).withColumn("__lo", F.lower(F.trim("locus_name")))
    rows = rows.join(lookup, ["__sp", "__lo"], "left").join(known, "__sp", "left")
    for name in ("latitude", "longitude", "allele_count"):
        rows = rows.withColumn(f"__{name}", F.trim(F.col(name).cast("string")).try_cast("double"))
    when = F.try_to_timestamp(F.trim(F.col("collection_date").cast("string")))
    rows = rows.withColumn("__when", when)
    lat, lon, count = F.col("__latitude"), F.col("__longitude"), F.col("__allele_count")

    def bad_number(value):
        return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))

    clean = text.clean_sequence("sequence") if "sequence" in df.columns else F.lit(None).cast("string")
    rules = [(n, _blank(n)) for n in ("sample_id", "target_species", "locus_name")]
    rules += [("collection_date", F.col("__when").isNull()), ("latitude", bad_number(lat)), ("longitude", bad_number(lon)),
              ("coordinate_bounds", ~(lat.between(-90, 90) & lon.between(-180, 180))),
              ("study_area", ~(lat.between(box["min_latitude"], box["max_latitude"])
                               & lon.between(box["min_longitude"], box["max_longitude"]))),
              ("no_approved_loci", ~_blank("target_species") & F.col("__known").isNull()),
              ("unknown_locus", F.col("__known") & ~_blank("locus_name") & F.col("__max").isNull()),
              ("allele_count", bad_number(count) | (count != F.floor(count)) | (count < 0) | (count > F.col("__max"))),
              ("sequence", clean.isNotNull() & ~clean.rlike("^[ACGTN]+$"))]
    if "sequence_header" in df.columns:
        rules.append(("empty_sequence", F.col("sequence_header").isNotNull() & clean.isNull()))
    out = rows.withColumn("reject_reasons", reasons(*rules))
    out = (out.withColumn("latitude", lat).withColumn("longitude", lon).withColumn("collection_date", F.col("__when"))
           .withColumn("allele_count", count.try_cast("int")))
    return out.drop("__sp", "__lo", "__max", "__known", "__latitude", "__longitude", "__allele_count", "__when")


def approved_locus(df: DataFrame, loci: DataFrame) -> DataFrame:
    """Rows with the configured maximum of their species and locus, case-insensitively."""
    dim = loci.select(F.lower("target_species").alias("__sp"), F.lower("locus_name").alias("__lo"), "max_allele_count")
    return (df.withColumn("__sp", F.lower("target_species")).withColumn("__lo", F.lower("locus_name"))
            .join(dim, ["__sp", "__lo"], "left").drop("__sp", "__lo"))


def validate_edna_batch(df: DataFrame, order: str = "source_row", file_keys=("source_hash",),
                        profile=("target_species", "collection_date", "latitude", "longitude")) -> DataFrame:
    """Rules between the rows of a file, in row order, over rows that passed the row rules.

    A sample's first row fixes its profile; later rows must agree, and of the agreeing rows
    the first per locus is kept. Both "firsts" are aggregates, so a sample or file that
    holds most of the rows is combined map-side. A missing project, sample or locus is a value
    like any other, so no row is lost.
    """
    rows = df.withColumn("__p", F.lower("project_id")).withColumn("__s", F.lower("sample_id")).withColumn("__l", F.lower("locus_name"))
    lead = [F.lower(profile[0]) if df.schema[profile[0]].dataType.simpleString() == "string" else F.col(profile[0])]
    rows = rows.withColumn("__profile", F.struct(*lead, *[F.col(c) for c in profile[1:]]))
    sample = [*file_keys, "__p", "__s"]
    first = rows.groupBy(*sample).agg(F.min_by("__profile", order).alias("__first"))
    rows = scale.same_key_join(rows, first, sample).withColumn("__agrees", F.col("__profile").eqNullSafe(F.col("__first")))
    locus = [*sample, "__l"]
    kept = rows.filter("__agrees").groupBy(*locus).agg(F.min(order).alias("__kept"))
    rows = scale.same_key_join(rows, kept, locus)
    verdict = (F.when(F.col(order) == F.col("__kept"), None)
               .when(F.col("__agrees") | (F.col("__kept") < F.col(order)), "duplicate_locus")
               .otherwise("conflicting_profile"))
    return (rows.withColumn("reject_reasons", F.array_compact(F.array(verdict)))
            .drop("__p", "__s", "__l", "__profile", "__first", "__agrees", "__kept"))


# -- habitat, risk and narrative --------------------------------------------------------------

def validate_bundle(cells: DataFrame, meta: DataFrame, species: str, this_year: int) -> DataFrame:
    """One row: how many cells break each rule and which document rules fail."""
    vote, loss, status = F.col("vote"), F.col("loss"), F.col("status")
    model = status == "suitable_model_domain"

    def broken(test):
        return F.count(F.when(F.coalesce(test, F.lit(False)), 1))
    year = meta.select(F.col("loss_year")).limit(1).scalar()
    counts = cells.agg(
        F.count(F.lit(1)).alias("cells"), broken(F.coalesce(bad_position("lat", "lon"), F.lit(True))).alias("bad_coordinates"),
        broken(model & ~F.coalesce(vote.between(0, 1), F.lit(False))).alias("bad_votes"),
        broken(~model & (~status.isin("nodata", "extrapolation") | vote.isNotNull())).alias("bad_status"),
        broken(loss.isNotNull() & (~loss.between(0, 1) | year.isNull())).alias("bad_loss"), broken(model).alias("usable"))
    head = meta.select("version", "species", "cell_size_m", "loss_year", "metrics").limit(1)
    ok_members = F.size("metrics.members").between(1, 15) & F.forall(
        "metrics.members", lambda m: m["auc"].between(0.9, 1) & m["tss"].between(0.7, 1))
    rules = head.select(reasons(
        ("schema", (F.col("version") != 1) | (F.col("species") != species) | (F.col("cell_size_m") != 1000)),
        ("metrics", ~(F.col("metrics.auc").between(0.9, 1) & F.col("metrics.tss").between(0.7, 1))),
        ("members", ~F.coalesce(ok_members, F.lit(False))),
        ("loss_year", ~F.col("loss_year").between(2001, this_year - 1))).alias("document"))
    out = counts.withColumn("document", rules.scalar())
    return out.withColumn("reject_reasons", F.concat("document", reasons(
        ("cell_count", ~F.col("cells").between(1, 150_000)), ("cell_coordinates", F.col("bad_coordinates") > 0),
        ("cell_vote", F.col("bad_votes") > 0), ("cell_status", F.col("bad_status") > 0), ("cell_loss", F.col("bad_loss") > 0),
        ("no_usable_cell", F.col("usable") == 0)))).drop("document")


def check_assessments(df: DataFrame, cfg: RiskConfig = RISK, tolerance: float = 1e-4) -> DataFrame:
    """Cross-checks of finished rows (0-100 scale): weighted sum, delta, slope, flags and dispatches."""
    total = sum((F.col(f"{d}_weight") * F.col(f"{d}_subscore") for d in DOMAINS), F.lit(0.0))
    cri = F.col("conservation_risk_index")
    rules = [("cri_sum", F.abs(cri - total) > tolerance)]
    if "previous_conservation_risk_index" in df.columns:
        rules += [("delta", F.abs(F.col("delta_cri") - (cri - F.col("previous_conservation_risk_index"))) > tolerance)]
    if "risk_momentum_per_day" in df.columns:
        rules += [("slope", F.abs(F.col("risk_momentum_per_day") * F.col("momentum_window_days") - F.col("delta_cri")) > tolerance)]
    if "effective_population_size" in df.columns:
        rules += [("inbreeding_flag", (F.col("effective_population_size") < cfg.critical_ne) & ~F.col("critical_inbreeding_risk"))]
    if "actions" in df.columns:
        ranger = F.array_contains("actions", "RANGER_DISPATCH")
        rules += [("poaching_dispatch", F.col("immediate_poaching_threat") & ~ranger),
                  ("dispatch_targets", ranger != (F.size("dispatch_targets") > 0)),
                  ("duplicate_actions", F.size(F.array_distinct("actions")) != F.size("actions")),
                  ("level", F.col("escalation_level") != escalation_level(cri))]
    return df.withColumn("reject_reasons", reasons(*rules))


# Fixed value: words a genetics text may not use while the Ne flag is up.
SAFE_WORDS = r"(?i)\b(safe|secure|stable|healthy|viable)\b"


def check_narratives(df: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Texts against their numbers: shares, forbidden reassurance, missing data, mitigations and cells."""
    told, computed = F.col("reported_shares"), F.col("percentages")
    off = F.exists(F.map_keys(computed), lambda d: F.abs(
        F.coalesce(F.element_at(told, d), F.lit(-1.0)) - F.element_at(computed, d)) > cfg.contribution_tolerance)
    lacks = F.lit(text.INSUFFICIENT.lower())
    return df.withColumn("reject_reasons", reasons(
        ("shares", off),
        ("safe_words", F.col("critical_inbreeding_risk") & F.col("genetics_text").rlike(SAFE_WORDS)),
        ("genetics_missing", F.col("genetics_missing") & ~F.lower("genetics_text").contains(lacks)),
        ("behavior_missing", F.col("behavior_missing") & ~F.lower("behavior_text").contains(lacks)),
        ("mitigations", F.size(F.array_except("reported_mitigations", "mitigations")) > 0),
        ("cells", F.size(F.array_except("reported_cells", "target_cells")) > 0)))


def column_drift(df: DataFrame, declared) -> DataFrame:
    """Columns a table lacks and columns nobody declared."""
    have, want = list(df.columns), list(declared)
    lacking = [c for c in want if c not in have]
    extra = [c for c in have if c not in want]
    return df.sparkSession.createDataFrame([(lacking, extra)], "missing array<string>, unexpected array<string>")


def check_weights(weights: dict) -> None:
    """Configuration check: exactly the six domains, non-negative and finite, summing to 1."""
    if set(weights) != set(DOMAINS):
        raise ValueError(f"weights must name exactly {DOMAINS}")
    if any(w < 0 or not math.isfinite(w) for w in weights.values()):
        raise ValueError("weights must be finite and not negative")
    if abs(math.fsum(weights.values()) - 1) > UNIT_SLACK:
        raise ValueError("weights must sum to 1")


