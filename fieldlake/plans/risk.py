"""Six-domain risk assessment of every (species, cell, period) in one job.

``assess`` starts from a table of scopes, aggregates each section for all scopes at once,
joins the sections into one wide row per scope and scores that row with column expressions.
A scope is (scope_id, species_id, h3_cell, period_start, period_end, latitude, longitude).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import AGE_CLASSES, DAY_MS, DOMAINS, FOCAL_SPECIES, MEASUREMENTS, RISK, RiskConfig
from fieldlake.functions import h3grid, text
from fieldlake.functions.mathx import (adverse_z, clamp, decay, escalate_climate, escalation_level, mean_decay, positive_part,
                                       priority_tier, projected_f, ratio, saturate, scale_to_risk, weighted_score)
from fieldlake.functions.timex import day_index, epoch_ms
from fieldlake.operators import aggregates, genetics, joins, scale, series, spatial, topk
from fieldlake.operators.filters import is_poaching
from fieldlake.operators.validate import check_weights, reasons
from fieldlake.session import cut_lineage

ID = "scope_id"


# -- scopes ---------------------------------------------------------------------------------------

def resolve_scopes(df: DataFrame, now: Column | None = None, resolution: int = 7, lookback_days: float = 30.0,
                   max_days: float = 365.0) -> DataFrame:
    """Requests to scopes: a cell, or a point, or the centre of a box; a window of at most 365 days."""
    cell = text.norm_text("h3_cell")
    lat = F.coalesce("latitude", F.when(F.col("min_lat") < F.col("max_lat"), (F.col("min_lat") + F.col("max_lat")) / 2))
    lon = F.coalesce("longitude", F.when(F.col("min_lon") < F.col("max_lon"), (F.col("min_lon") + F.col("max_lon")) / 2))
    centre = h3grid.cell_centre(cell)
    both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    use_cell = cell.isNotNull()
    end = F.coalesce("end_time", now if now is not None else F.current_timestamp())
    start = F.coalesce("start_time", F.timestamp_micros(F.unix_micros(end) - (F.coalesce("lookback_days", F.lit(lookback_days)) * DAY_MS * 1000).cast("bigint")))
    rows = df.withColumn("__lat", F.when(use_cell & ~both, centre["lat"]).otherwise(lat)).withColumn(
        "__lon", F.when(use_cell & ~both, centre["lon"]).otherwise(lon))
    rows = rows.withColumn("period_end", end).withColumn("period_start", start)
    rows = rows.withColumn("__cell", F.when(use_cell, cell).when(F.col("__lat").isNotNull() & F.col("__lon").isNotNull(),
                                                                  h3grid.cell_of("__lat", "__lon", resolution)))
    span = (F.unix_micros("period_end") - F.unix_micros("period_start")) / F.lit(DAY_MS * 1000.0)
    rows = rows.withColumn("reject_reasons", reasons(
        ("h3_cell", use_cell & ~h3grid.is_cell(cell)), ("position", ~use_cell & (F.col("__lat").isNull() | F.col("__lon").isNull())),
        ("window_order", span <= 0), ("window_length", span > max_days)))
    return rows.select(*[c for c in (ID, "species_id", "scientific_name") if c in df.columns], F.col("__cell").alias("h3_cell"),
                       F.col("__lat").alias("latitude"), F.col("__lon").alias("longitude"), "period_start", "period_end", "reject_reasons")


def _timed(scopes: DataFrame) -> DataFrame:
    return (scopes.withColumn("start_ms", epoch_ms("period_start")).withColumn("end_ms", epoch_ms("period_end"))
            .withColumn("window_start_ms", F.col("start_ms")).withColumn("window_end_ms", F.col("end_ms")))


def _centres(scopes: DataFrame, *extra) -> DataFrame:
    return scopes.select(ID, F.col("latitude").alias("centre_lat"), F.col("longitude").alias("centre_lon"), "start_ms", "end_ms", *extra)


# -- sections ---------------------------------------------------------------------------------------

def scoped_fixes(scopes: DataFrame, telemetry: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Fixes of the scope's species within the radius and the closed window."""
    return spatial.radius_join(telemetry, _centres(scopes, "species_id"), cfg.analysis_radius_m, on=["species_id"], time="recorded_epoch_ms")


def scoped_detections(scopes: DataFrame, detections: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Detections of the species or of a threat near the scope, and unlocated ones tagged with the species."""
    centres = _centres(scopes, F.col("species_id").alias("scope_species"))
    near = spatial.radius_join(detections, centres, cfg.analysis_radius_m, time="detected_epoch_ms").drop("distance_m")
    near = near.filter((F.col("species_id") == F.col("scope_species")) | (F.col("category") == "immediate_threat"))
    nowhere = detections.filter(F.col("latitude").isNull() | F.col("longitude").isNull())
    tagged = scale.spread_join(nowhere, centres.withColumn("species_id", F.col("scope_species")), ["species_id"]).filter(
        F.col("detected_epoch_ms").between(F.col("start_ms"), F.col("end_ms")))
    names = [*detections.columns, ID, "scope_species"]
    return near.select(*names).unionByName(tagged.select(*names))


def scoped_acoustic(scopes: DataFrame, events: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    threats = events.filter(F.col("category") == "immediate_threat")
    return spatial.radius_join(threats, _centres(scopes), cfg.analysis_radius_m, time="start_epoch_ms")


def threat_events(found: DataFrame, heard: DataFrame | None) -> DataFrame:
    """Threats per scope; acoustic events a detection in the scope was promoted from are left out."""
    def shaped(df, time, source, record):
        both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
        return df.select(ID, F.col(time).alias("detected_epoch_ms"), "class_name", source, confidence.alias("confidence"),
                         F.when(both, F.col("latitude")).alias("latitude"), F.when(both, F.col("longitude")).alias("longitude"), record)
    seen = shaped(found.filter(F.col("category") == "immediate_threat"), "detected_epoch_ms", "source_type", F.col("id").alias("record_id"))
    if heard is None:
        return seen
    linked = found.filter((F.col("source_type") == "ACOUSTIC") & F.col("source_record_id").isNotNull()).select(
        ID, F.col("source_record_id").alias("id")).distinct()
    new = heard.join(linked, [ID, "id"], "left_anti")
    return seen.unionByName(shaped(new, "start_epoch_ms", F.lit("ACOUSTIC").alias("source_type"), F.lit(None).cast("bigint").alias("record_id")))


def scoped_readings(scopes: DataFrame, readings: DataFrame) -> DataFrame:
    keyed = scopes.select(ID, "h3_cell", "start_ms", "end_ms")
    return scale.spread_join(readings.filter(F.col("quality_flag") != "INVALID"), keyed, ["h3_cell"]).filter(
        F.col("recorded_epoch_ms").between(F.col("start_ms"), F.col("end_ms")))


# -- domain scores: (scope_id, score, components) -----------------------------------------------

def population_subscore(scopes: DataFrame, found: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Herd trend, census viability and recruitment, plus a penalty that doubles with every death of a cluster."""
    own = found.filter((F.col("category") != "immediate_threat") & (F.col("species_id") == F.col("scope_species")))
    dead = own.filter(text.is_mortality("class_name", cfg))
    live = own.filter(~text.is_mortality("class_name", cfg) & (F.col("source_type") == "VISION"))
    frames = aggregates.frames(live, [ID])
    daily = aggregates.herd_series(frames, [ID])
    decline = series.herd_decline(daily, [ID], longest=cfg.herd_window).select(ID, "decline")
    trend = series.population_trend(daily, [ID], cfg=cfg).select(ID, "population_trend")
    ages = aggregates.age_classes(frames, [ID])
    parts = [decline, trend, ages]
    if "bbox_left" in found.columns:
        area = clamp((F.col("bbox_right") - F.col("bbox_left")) * (F.col("bbox_bottom") - F.col("bbox_top")), 0.0, 1.0)
        # only scopes without a classified age need the box sizes
        named = ages.filter(F.col("juvenile") + F.col("adult") + F.col("elder") > 0).select(ID)
        parts.append(spatial.two_means(live.withColumn("area", area).join(named, ID, "left_anti"), [ID], "area", cfg)
                     .withColumnsRenamed({"juveniles": "box_juveniles", "adults": "box_adults"}))
    clusters = spatial.cluster_sizes(spatial.mortality_clusters(dead, [ID], radius_m=cfg.mortality_radius_m, days=cfg.mortality_days), [ID])
    size = F.col("size").cast("double")
    parts.append(clusters.groupBy(ID).agg(F.sum(F.lit(cfg.mortality_penalty) * size * F.pow(F.lit(cfg.mortality_growth), size - 1)).alias("penalty")))
    wide = joins.assemble(scopes, *parts)
    if "box_juveniles" not in wide.columns:
        wide = wide.withColumn("box_juveniles", F.lit(None).cast("bigint")).withColumn("box_adults", F.lit(None).cast("bigint"))
    zero = F.lit(0).cast("bigint")
    young, grown = F.coalesce("juvenile", zero), F.coalesce("adult", zero) + F.coalesce("elder", zero)
    boxed = (young + grown == 0) & F.col("box_adults").isNotNull()
    young, grown = F.when(boxed, F.col("box_juveniles")).otherwise(young), F.when(boxed, F.col("box_adults")).otherwise(grown)
    recruitment = ratio(young, F.when(grown > 0, grown))
    expected = F.coalesce("juvenile_recruitment_ratio", F.lit(cfg.juvenile_ratio))
    pieces = {"trend": scale_to_risk("herd_decline", F.col("decline"), cfg),
              "viability": scale_to_risk("viability_shortfall", positive_part(1 - ratio("census_count", "minimum_viable_population")), cfg),
              "recruitment": scale_to_risk("recruitment_deficit", positive_part(1 - recruitment / expected), cfg)}
    base = weighted_score(pieces, cfg.population_weights)
    score = F.when(base.isNotNull() | F.col("penalty").isNotNull(), clamp(F.coalesce(base, F.lit(0.0)) + F.coalesce("penalty", F.lit(0.0))))
    return wide.select(ID, "population_trend", score.alias("population"), F.struct(
        *[c.alias(n) for n, c in pieces.items()], recruitment.alias("recruitment_ratio"), clamp("penalty").alias("mortality"),
        boxed.alias("recruitment_from_boxes")).alias("population_components"))


def range_baselines(scopes: DataFrame, telemetry: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Mean home range of the species one year before the window. Scopes that share a window share the work."""
    windows = scopes.select("species_id", "start_ms", "end_ms").distinct()
    fixes = spatial.shifted_window(telemetry.select("species_id", "animal_id", "recorded_epoch_ms", "latitude", "longitude"), windows, ["species_id"], "recorded_epoch_ms")
    keys = ["species_id", "start_ms", "end_ms"]
    ranges = spatial.home_range_km2(fixes, [*keys, "animal_id"], cfg.mcp_percent)
    mean = aggregates.with_mean_home_range(ranges, keys, cfg.minimum_fixes).select(*keys, F.col("mean_range_km2").alias("baseline_range_km2"))
    return scopes.select(ID, *keys).join(mean, keys).select(ID, "baseline_range_km2")


def fragmentation(scopes: DataFrame, telemetry: DataFrame, features: DataFrame) -> DataFrame:
    """Track segments of the species in the window and how many cross infrastructure that stood at its end."""
    keys = ["species_id", "start_ms", "end_ms"]
    windows = scopes.select(*keys).distinct()
    rows = scale.spread_join(telemetry.select("id", "species_id", "animal_id", "recorded_epoch_ms", "latitude", "longitude"), windows, ["species_id"]).filter(
        F.col("recorded_epoch_ms").between(F.col("start_ms"), F.col("end_ms")))
    tracks = series.track_segments(rows, [*keys, "animal_id"]).withColumn("segment", F.xxhash64(*keys, "id"))
    met = spatial.crossings(tracks, features, keys, "segment", at="end_ms")
    return scopes.select(ID, *keys).join(met, keys).select(ID, "segment_count", "crossing_count")


def habitat_subscore(scopes: DataFrame, fixes: DataFrame, means: DataFrame, baselines: DataFrame, extras: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Range loss, fragmentation, degradation against the season's baseline, and fresh tree-cover loss.

    ``means`` is (scope_id, metric columns), ``baselines`` the long table of ``seasonal_baseline``,
    ``extras`` carries segment_count, crossing_count, reference_range_km2 and forest_loss_fraction per scope.
    """
    ranges = spatial.home_range_km2(fixes, [ID, "animal_id"], cfg.mcp_percent)
    current = aggregates.with_mean_home_range(ranges, [ID], cfg.minimum_fixes).select(ID, F.col("mean_range_km2").alias("current_range_km2"))
    metrics = [m for m in cfg.degradation_directions if m in means.columns]
    worse = F.create_map(*[F.lit(x) for kv in cfg.degradation_directions.items() for x in kv])
    z = adverse_z("value", "baseline_mean", "baseline_std", F.try_element_at(worse, F.col("metric")))
    wide = joins.assemble(scopes, current, extras)
    if metrics:
        long = means.select(ID, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])).alias("p")).select(ID, "p.*")
        scored = long.join(baselines, [ID, "metric"]).withColumn("s", scale_to_risk("degradation_z", z, cfg))
        wide = wide.join(scored.groupBy(ID).agg(clamp(0.5 * F.avg("s") + 0.5 * F.max("s")).alias("degradation")), ID, "left")
    else:
        wide = wide.withColumn("degradation", F.lit(None).cast("double"))
    crossing = ratio("crossing_count", "segment_count")
    pieces = {"range_loss": scale_to_risk("range_loss", positive_part(1 - ratio("current_range_km2", "reference_range_km2")), cfg),
              "fragmentation": scale_to_risk("crossing_rate", crossing, cfg), "degradation": F.col("degradation"),
              "tree_cover_loss": clamp(100.0 * F.col("forest_loss_fraction"))}
    return wide.select(ID, weighted_score(pieces, {**cfg.habitat_weights, "tree_cover_loss": 1.0}).alias("habitat"), F.struct(
        *[c.alias(n) for n, c in pieces.items()], "current_range_km2", F.col("reference_range_km2"), crossing.alias("crossing_rate")).alias("habitat_components"))


def threat_subscore(scopes: DataFrame, threats: DataFrame, zones: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Decayed, weighted and located pressure on a saturating curve. No events is a genuine zero."""
    home = F.sqrt(F.col("reference_range_km2") / 3.141592653589793) * 1000.0 if "reference_range_km2" in scopes.columns else F.lit(None).cast("double")
    around = scopes.select(ID, "species_id", "end_ms", F.col("latitude").alias("home_lat"), F.col("longitude").alias("home_lon"), home.alias("home_radius_m"))
    rows = threats.join(around, ID).withColumn("age_s", (F.col("end_ms") - F.col("detected_epoch_ms")) / 1000.0)
    rows = rows.filter(F.col("age_s").between(0.0, cfg.threat_window_days * 86400.0))
    placed = spatial.zone_multiplier(rows, zones, cfg=cfg)
    power = text.threat_weight("class_name", cfg) * F.col("confidence") * decay("age_s", cfg.threat_half_life_h * 3600.0) * F.col("proximity")
    sums = placed.groupBy(ID).agg(F.sum(power).alias("pressure"), F.count(F.lit(1)).alias("event_count"),
                                  F.count(F.when(F.col("proximity") > 1, 1)).alias("core_zone_events"))
    wide = joins.assemble(scopes, sums)
    pressure = F.coalesce("pressure", F.lit(0.0))
    if "acoustic_threat_event_count" in scopes.columns:
        # undated counts: events spread evenly over the window
        seconds = F.least(F.lit(cfg.threat_window_days * 86400.0), (F.col("end_ms") - F.col("start_ms")) / 1000.0)
        pressure = F.coalesce("pressure", F.col("acoustic_threat_event_count") * cfg.default_threat_weight * mean_decay(seconds, cfg.threat_half_life_h * 3600.0), F.lit(0.0))
    return wide.select(ID, saturate(pressure, cfg.bounds["threat_pressure"][1]).alias("threat"), F.struct(
        pressure.alias("decayed_pressure"), F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.coalesce("core_zone_events", F.lit(0)).alias("core_zone_events")).alias("threat_components"))


def climate_subscore(scopes: DataFrame, daily: DataFrame, means: DataFrame, baselines: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Worst anomaly of the last 30 days plus a share for days beyond two deviations.

    ``daily`` is (scope_id, day_index, metrics), ``means`` (scope_id, metrics) serves where no day does.
    """
    metrics = [m for m in cfg.climate_directions if m in daily.columns]
    if not metrics:
        return scopes.select(ID, F.lit(None).cast("double").alias("climate"), F.lit(None).cast("struct<worst_anomaly:double,extreme_weather:double>").alias("climate_components"))
    worse = F.create_map(*[F.lit(x) for kv in cfg.climate_directions.items() for x in kv])
    direction = F.try_element_at(worse, F.col("metric"))
    spread = F.coalesce("baseline_daily_std", "baseline_std")

    def long(df, *keep):
        return df.select(ID, *keep, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("p")
                         ).select(ID, *keep, "p.*").filter("value is not null")
    day = F.col("day_index") * DAY_MS
    recent = long(daily, "day_index").join(scopes.select(ID, "end_ms"), ID).filter((day > F.col("end_ms") - int(cfg.climate_days * DAY_MS)) & (day <= F.col("end_ms")))
    recent = recent.join(baselines, [ID, "metric"])
    extreme = adverse_z("value", "baseline_mean", spread, direction) >= cfg.sigma_threshold
    days = recent.groupBy(ID, "metric").agg(F.avg("value").alias("rolling"), F.avg(extreme.cast("double")).alias("extreme"))
    wanted = baselines.select(ID, "metric", "baseline_mean", "baseline_std").filter(F.col("metric").isin(*metrics))
    rows = wanted.join(days, [ID, "metric"], "left").join(long(means).withColumnRenamed("value", "overall"), [ID, "metric"], "left")
    rows = rows.withColumn("value", F.coalesce("rolling", "overall")).filter("value is not null")
    rows = rows.withColumn("anomaly", escalate_climate(adverse_z("value", "baseline_mean", "baseline_std", direction), cfg))
    worst = rows.groupBy(ID).agg(F.max("anomaly").alias("worst"), F.max("extreme").alias("extreme"))
    frequency = F.coalesce(scale_to_risk("extreme_days", F.col("extreme"), cfg), F.lit(0.0))
    return joins.assemble(scopes, worst).select(ID, F.when(F.col("worst").isNotNull(), clamp(F.col("worst") + cfg.extreme_weight * frequency)).alias("climate"), F.struct(
        F.col("worst").alias("worst_anomaly"), frequency.alias("extreme_weather")).alias("climate_components"))


def genetics_subscore(scopes: DataFrame, summary: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Effective size against the viable size and lost heterozygosity; below the critical size it is 100."""
    wide = joins.assemble(scopes, summary)
    ne = F.col("effective_population_size")
    critical = F.coalesce("critical_ne_threshold", F.lit(cfg.critical_ne))
    viable = F.greatest(F.coalesce("viable_ne_threshold", F.lit(cfg.viable_ne)), critical + 1.0)
    he = F.coalesce("expected_heterozygosity", "heterozygosity_from_counts")
    pieces = {"effective_population": clamp(100.0 * (1 - ne / viable)),
              "heterozygosity": scale_to_risk("heterozygosity_deficit", positive_part(1 - he / cfg.heterozygosity_baseline), cfg)}
    hard = F.coalesce(ne < critical, F.lit(False))
    score = F.when(hard, F.lit(100.0)).otherwise(weighted_score(pieces, cfg.genetic_weights))
    return wide.select(ID, "effective_population_size", "expected_heterozygosity", score.alias("genetics"),
                       F.struct(*[c.alias(n) for n, c in pieces.items()], he.alias("heterozygosity_used"), hard.alias("critical_override")).alias("genetics_components"))


def heart_rate_deviation(rate: str, low: str, high: str) -> Column:
    r, a, b = F.col(rate), F.col(low), F.col(high)
    return F.when(r.isNotNull() & a.isNotNull() & b.isNotNull(), F.when(r > b, ratio(r - b, b)).when(r < a, ratio(a - r, a)).otherwise(F.lit(0.0)))


def behavior_subscore(scopes: DataFrame, fixes: DataFrame, found: DataFrame, zones: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Corridor use, missing elders and heart rate; juveniles alone on three days set a floor of 85."""
    own = found.filter((F.col("category") != "immediate_threat") & (F.col("species_id") == F.col("scope_species"))
                       & (F.col("source_type") == "VISION") & ~text.is_mortality("class_name", cfg))
    groups = aggregates.frames(own, [ID]).filter(reduce(lambda a, b: a + b, [F.col(f"{a}_count") for a in AGE_CLASSES]) > 0)
    no_elder, no_adult = F.col("elder_count") == 0, F.col("adult_count") == 0
    orphan = (F.col("juvenile_count") > 0) & no_elder & no_adult
    social = groups.groupBy(ID).agg(
        F.avg(F.when(no_elder, F.when(no_adult, 1.0).otherwise(0.5)).otherwise(0.0)).alias("elder_absence"),
        F.countDistinct(F.when(orphan, day_index("detected_epoch_ms"))).alias("orphan_days"))
    # the species has corridors or the component is missing altogether
    corridors = zones.filter(F.col("active") & (F.col("zone_type") == "CORRIDOR"))
    of_species = corridors.filter("species_id is not null").select("species_id").distinct().withColumn("own_corridor", F.lit(True))
    of_all = corridors.filter("species_id is null").agg(F.count(F.lit(1)) > 0).scalar()
    has = scopes.select(ID, "species_id").join(of_species, "species_id", "left").select(
        ID, (F.coalesce("own_corridor", F.lit(False)) | of_all).alias("has_corridor"))
    keyed = fixes.withColumn("fix", F.xxhash64(ID, "id"))
    kept = spatial.corridor_retention(keyed, zones, [ID], "fix", cfg=cfg).select(ID, "retention")
    body = aggregates.telemetry_summary(fixes, [ID])
    wide = joins.assemble(scopes, social, kept, has, body)
    retention = F.when(F.col("has_corridor"), F.col("retention"))
    pieces = {"corridor": scale_to_risk("corridor_loss", positive_part(1 - retention / cfg.corridor_retention), cfg),
              "social": scale_to_risk("elder_absence", F.col("elder_absence"), cfg),
              "physiology": scale_to_risk("heart_rate_deviation", heart_rate_deviation(
                  "mean_heart_rate_bpm", "resting_heart_rate_min_bpm", "resting_heart_rate_max_bpm"), cfg)}
    base = weighted_score(pieces, cfg.behavior_weights)
    days = F.coalesce("orphan_days", F.lit(0))
    some = F.coalesce(base, F.lit(0.0))
    score = (F.when(days == 0, base).when(days >= cfg.orphan_days, F.greatest(some, F.lit(cfg.orphan_floor)))
             .otherwise(clamp(some + cfg.orphan_day_penalty * days)))
    return wide.select(ID, score.alias("behavior"), "mean_speed_kmh", "mean_heart_rate_bpm", "fix_count", F.struct(
        *[c.alias(n) for n, c in pieces.items()], retention.alias("corridor_retention"), F.col("elder_absence"), days.alias("orphan_days")).alias("behavior_components"))


# -- compilation ------------------------------------------------------------------------------------

def focal(cfg_species: str = FOCAL_SPECIES) -> Column:
    return F.coalesce(F.lower("scientific_name") == cfg_species.lower(), F.lit(False))


def compile_subscores(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Missing domains score 50 and are named. The focal species counts verified census and coverage only."""
    is_focal = focal()
    if "verified_census_count" in wide.columns:
        shortfall = positive_part(1 - ratio("verified_census_count", "minimum_viable_population"))
        wide = wide.withColumn("population", F.when(is_focal, scale_to_risk("viability_shortfall", shortfall, cfg)).otherwise(F.col("population")))
        blind = is_focal & (F.col("threat_components.event_count") == 0) & ~F.coalesce("threat_coverage", F.lit(False))
        wide = wide.withColumn("threat", F.when(~blind, F.col("threat")))
    missing = F.array_compact(F.array(*[F.when(F.col(d).isNull(), F.lit(d)) for d in DOMAINS]))
    wide = wide.withColumn("missing_domains", missing)
    return wide.select("*", *[F.coalesce(clamp(d), F.lit(cfg.missing_score)).alias(f"{d}_subscore") for d in DOMAINS]).drop(*DOMAINS)


def domain_weights(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Weight columns; a species may have its own set, by id or by name."""
    check_weights(cfg.domain_weights)
    chosen = {d: F.lit(float(cfg.domain_weights[d])) for d in DOMAINS}
    name = F.lower("scientific_name") if "scientific_name" in wide.columns else F.lit(None).cast("string")
    for key, weights in cfg.species_weights.items():
        check_weights(weights)
        hit = (F.col("species_id").cast("string") == str(key)) | (name == str(key).strip().lower())
        chosen = {d: F.when(hit, F.lit(float(weights[d]))).otherwise(c) for d, c in chosen.items()}
    return wide.withColumns({f"{d}_weight": c for d, c in chosen.items()})


def conservation_risk_index(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    rows = wide if f"{DOMAINS[0]}_weight" in wide.columns else domain_weights(wide, cfg)
    total = reduce(lambda a, b: a + b, [F.col(f"{d}_weight") * F.col(f"{d}_subscore") for d in DOMAINS])
    return rows.withColumn("conservation_risk_index", clamp(total)).withColumn("escalation_level", escalation_level("conservation_risk_index"))


def inbreeding_penalty(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """0-100: pinned below the critical size, else drift over ten generations and lost diversity."""
    ne, he = F.col("effective_population_size"), F.col("expected_heterozygosity")
    critical = F.greatest(F.lit(cfg.critical_ne), F.coalesce("critical_ne_threshold", F.lit(cfg.critical_ne)))
    flag = F.coalesce(ne < critical, F.lit(False))
    f = projected_f("effective_population_size", cfg.inbreeding_generations)
    drift = F.when(ne.isNotNull(), 100.0 * F.least(F.lit(1.0), f / cfg.inbreeding_tolerance))
    lost = 100.0 * clamp(1 - he / cfg.heterozygosity_baseline, 0.0, 1.0)
    mixed = weighted_score({"drift": drift, "diversity": lost}, {"drift": cfg.drift_weight, "diversity": 1 - cfg.drift_weight})
    return (wide.withColumn("critical_inbreeding_risk", flag).withColumn("projected_inbreeding_f", F.when(ne.isNotNull(), f))
            .withColumn("drift_penalty", F.when(~flag, drift)).withColumn("heterozygosity_penalty", F.when(~flag, lost))
            .withColumn("inbreeding_penalty_index", F.when(flag, F.lit(100.0)).otherwise(F.coalesce(mixed, F.col("genetics_subscore")))))


def with_previous(wide: DataFrame, history: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """The newest stored assessment of the same species and cell that ended before this one, within 90 days."""
    slope = F.col("risk_momentum_per_day") if "risk_momentum_per_day" in history.columns else F.lit(None).cast("double")
    past = history.select("species_id", "h3_cell", F.col("period_end_epoch_ms").alias("__ms"), F.col("conservation_risk_index").alias("__cri"), slope.alias("__slope"))
    asked = wide.select(ID, "species_id", "h3_cell", "end_ms")
    pairs = scale.spread_join(past, asked, ["species_id", "h3_cell"]).filter(
        (F.col("__ms") < F.col("end_ms")) & (F.col("__ms") >= F.col("end_ms") - int(cfg.momentum_lookback_days * DAY_MS)))
    best = pairs.groupBy(ID).agg(F.max_by(F.struct("__ms", "__cri", "__slope"), "__ms").alias("p")).select(
        ID, F.col("p.__ms").alias("previous_end_ms"), clamp("p.__cri").alias("previous_conservation_risk_index"), F.col("p.__slope").alias("previous_slope"))
    return wide.join(best, ID, "left")


def intervention_priority(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """CRI × momentum factor × reach of the nearest outpost."""
    low, high = cfg.momentum_bounds
    factor = clamp(1.0 + cfg.momentum_gain * (F.col("risk_momentum_per_day") / 100.0) * cfg.momentum_window_days, low, high)
    if cfg.outposts:
        near, far = cfg.feasibility
        share = F.least(F.lit(1.0), spatial.nearest_distance("latitude", "longitude", cfg.outposts) / cfg.feasibility_radius_m)
        feasible = F.lit(near) + F.lit(far - near) * share
    else:
        feasible = F.lit(1.0)
    rows = wide.withColumn("momentum_factor", factor).withColumn("feasibility_multiplier", feasible)
    rows = rows.withColumn("intervention_priority_index", F.col("conservation_risk_index") * F.col("momentum_factor") * F.col("feasibility_multiplier"))
    return rows.withColumn("intervention_priority_tier", priority_tier("intervention_priority_index"))


def contributions(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Weighted points and shares per domain; the first domain wins a tie."""
    points = {d: F.col(f"{d}_weight") * F.col(f"{d}_subscore") for d in DOMAINS}
    total = reduce(lambda a, b: a + b, points.values())
    rows = wide.withColumns({f"{d}_contribution": c for d, c in points.items()}).withColumn("__total", total)
    shares = [x for d in DOMAINS for x in (F.lit(d), F.coalesce(F.round(100.0 * ratio(F.col(f"{d}_contribution"), F.when(F.col("__total") > 0, F.col("__total"))), cfg.contribution_decimals), F.lit(0.0)))]
    best = F.array_max(F.array(*[F.struct(F.round(f"{d}_contribution", 9).alias("p"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DOMAINS)]))
    return rows.withColumn("percentages", F.create_map(*shares)).withColumn("dominant_domain", best["d"]).drop("__total")


def risk_route(wide: DataFrame) -> DataFrame:
    return wide.withColumn("route", F.when(F.col("immediate_poaching_threat"), "poachingResponse")
                           .when(F.col("critical_inbreeding_risk"), "geneticRescue").otherwise("standardNarrative"))


# Actions of each escalation level.
BASE_ACTIONS = {1: ("ROUTINE_MONITORING",), 2: ("TARGETED_PATROLS",), 3: ("HABITAT_RESTORATION", "GENETIC_ASSAY"),
                4: ("CAPTIVE_BREEDING_PREP",), 5: ("GENETIC_RESCUE",)}
PRIMARY = {"population": "Population Health", "habitat": "Habitat Destruction", "threat": "Human Threats", "genetics": "Genetic Resilience"}


def _actions(*names) -> Column:
    return F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")


def imputed_primary() -> Column:
    """The focal species with a primary domain missing: the composite may not authorise anything."""
    return focal() & (F.size(F.array_intersect("missing_domains", _actions(*PRIMARY))) > 0)


def interventions(wide: DataFrame, targets: DataFrame | None = None, cfg: RiskConfig = RISK) -> DataFrame:
    """Directives: level actions, the driver's rule from CRI 80 on, poaching and inbreeding triggers.

    ``targets`` (from ``dispatch_targets``) gives dispatch places; without any the scope centre serves.
    """
    none, dispatch = _actions(), _actions("RANGER_DISPATCH", "DRONE_DEPLOYMENT")
    guarded, driver, poaching = imputed_primary(), F.col("dominant_domain"), F.col("immediate_poaching_threat")
    critical = ~guarded & (F.col("conservation_risk_index") >= cfg.critical_cri * 100.0)
    level = F.col("escalation_level")
    base = reduce(lambda acc, kv: acc.when(level == kv[0], _actions(*kv[1])), list(BASE_ACTIONS.items())[1:],
                  F.when(level == 1, _actions(*BASE_ACTIONS[1])))
    base = F.when(guarded, _actions("ROUTINE_MONITORING")).otherwise(base)
    threat_led = critical & (driver == "threat") & ~poaching
    by_driver = (F.when(~critical, none).when(threat_led, dispatch).when(driver == "genetics", _actions("GENETIC_RESCUE", "CAPTIVE_BREEDING_PREP"))
                 .when(driver.isin("habitat", "climate"), _actions("HABITAT_RESTORATION")).when(driver == "population", _actions("TARGETED_PATROLS"))
                 .when(driver == "behavior", _actions("DRONE_DEPLOYMENT")).otherwise(none))
    triggers = F.concat(F.when(poaching, dispatch).otherwise(none),
                        F.when(F.col("critical_inbreeding_risk") & ~guarded, _actions("GENETIC_RESCUE")).otherwise(none))
    rows = wide.withColumn("actions", F.array_distinct(F.concat(base, by_driver, triggers)))
    rows = rows.withColumn("dispatch_reason", F.when(poaching, "signs of poaching").when(threat_led, "threats drive a critical score"))
    rows = rows.withColumn("dispatch_priority", F.when(poaching, "CRITICAL").when(threat_led, "HIGH"))
    place = "struct<latitude:double,longitude:double,class_names:array<string>>"
    if targets is not None:
        spots = targets.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("target", "latitude", "longitude", "class_names"))).alias("__spots"))
        rows = rows.join(spots, ID, "left")
        chosen = F.transform("__spots", lambda s: F.struct(s["latitude"].alias("latitude"), s["longitude"].alias("longitude"), s["class_names"].alias("class_names")))
    else:
        rows = rows.withColumn("__spots", F.lit(None))
        chosen = F.lit(None).cast(f"array<{place}>")
    centre = F.array(F.struct("latitude", "longitude", _actions().alias("class_names")))
    rows = rows.withColumn("dispatch_targets", F.when(F.col("dispatch_reason").isNotNull(), F.coalesce(chosen, centre)).otherwise(F.array().cast(f"array<{place}>")))
    return rows.drop("__spots").withColumn("ranger_messages", F.transform("dispatch_targets", lambda t: F.concat_ws(
        " | ", F.format_string("go to lat %.5f lon %.5f", t["latitude"], t["longitude"]), F.concat(F.lit("why: "), F.col("dispatch_reason")),
        F.when(F.size(t["class_names"]) > 0, F.concat(F.lit("seen or heard: "), F.array_join(t["class_names"], ", "))))))


def mitigations(wide: DataFrame, cfg: RiskConfig = RISK) -> DataFrame:
    """Strategies the numbers authorise, and the cells of the drone strategy (``threat_cells`` when present)."""
    def real(d):
        return (F.col(f"{d}_subscore") >= cfg.critical_subscore) & ~F.array_contains("missing_domains", d)
    absence, days = F.col("behavior_components.elder_absence"), F.col("behavior_components.orphan_days")
    loss = F.coalesce(absence >= cfg.elder_absence_loss, F.lit(False)) | (days > 0)
    drones = F.col("immediate_poaching_threat") | (F.col("dominant_domain") == "threat") | (F.col("threat_subscore") >= cfg.critical_subscore)
    found = F.array_compact(F.array(F.when(F.col("critical_inbreeding_risk") | real("genetics"), "GENETIC_RESCUE"),
                                    F.when(real("behavior") & loss, "NEURAL_CONSERVATION_TRAINING"), F.when(real("behavior") & loss, "HERD_REINTEGRATION"),
                                    F.when(drones, "ANTI_POACHING_DRONE_DEPLOYMENT")))
    rows = wide.withColumn("mitigations", F.when(F.size(found) > 0, found).otherwise(_actions("CONTINUED_MONITORING")))
    cells = F.coalesce("threat_cells", F.array("h3_cell")) if "threat_cells" in wide.columns else F.array("h3_cell")
    return rows.withColumn("target_cells", F.when(drones, cells).otherwise(_actions())).withColumn("knowledge_loss", loss)


def primary_scores(wide: DataFrame, evidence_known: Column | bool = True) -> DataFrame:
    """One row per primary domain: risk where it is backed by data, with its status."""
    known = F.lit(evidence_known) if isinstance(evidence_known, bool) else evidence_known
    items = []
    for domain, label in PRIMARY.items():
        value = F.col(f"{domain}_subscore").cast("double")
        gap = F.array_contains("missing_domains", domain)
        items.append(F.struct(F.lit(domain).alias("domain"), F.lit(label).alias("label"), F.when(known & ~gap, value).alias("risk"),
                              F.when(~known, "unknown").when(gap | value.isNull(), "unavailable").otherwise("available").alias("status")))
    return wide.select(ID, F.explode(F.array(*items)).alias("p")).select(ID, "p.*")


def lineage(scopes: DataFrame, tables: dict[str, DataFrame], cfg: RiskConfig = RISK, page: int = 1000) -> DataFrame:
    """Ids of all source rows of each assessment: ``scope_id``, ``table_name`` and pages of ascending ``record_ids``."""
    scopes = _timed(scopes)
    sections = {"telemetry": lambda df: scoped_fixes(scopes, df, cfg), "detections": lambda df: scoped_detections(scopes, df, cfg),
                "acoustic_events": lambda df: scoped_acoustic(scopes, df, cfg), "sensor_readings": lambda df: scoped_readings(scopes, df)}
    rows = [of(tables[name]).select(ID, F.lit(name).alias("table_name"), F.col("id").cast("bigint").alias("id")) for name, of in sections.items() if name in tables]
    return joins.trace_pages(reduce(DataFrame.unionByName, rows), [ID, "table_name"], page=page)


def assess(scopes: DataFrame, tables: dict[str, DataFrame], cfg: RiskConfig = RISK, baseline: bool = True) -> DataFrame:
    """Finished assessment rows for all scopes.

    The scoped sections feed several scores each, so they are checkpointed once instead of
    being joined again per score; the domain scores are one row per scope.

    ``tables``: species, telemetry, detections, sensor_readings, habitat_zones; optional acoustic_events,
    genetics_records, infrastructure_features, risk_assessments, focal_field_evidence, habitat_cells.
    """
    from fieldlake.plans.narrative import report_text

    scopes = cut_lineage(joins.with_baselines(_timed(scopes), tables["species"]))
    fixes = cut_lineage(scoped_fixes(scopes, tables["telemetry"], cfg).select(
        ID, "id", "species_id", "animal_id", "latitude", "longitude", "speed_kmh", "physiological_metrics"))
    boxes = [c for c in ("bbox_left", "bbox_top", "bbox_right", "bbox_bottom") if c in tables["detections"].columns]
    found = cut_lineage(scoped_detections(scopes, tables["detections"], cfg).select(
        ID, "scope_species", "id", "source_type", "source_record_id", "species_id", "class_name", "category", "confidence",
        "detected_epoch_ms", "latitude", "longitude", "metadata", *boxes))
    heard = scoped_acoustic(scopes, tables["acoustic_events"], cfg) if "acoustic_events" in tables else None
    threats = cut_lineage(threat_events(found, heard))
    metrics = [m for m in MEASUREMENTS if m in tables["sensor_readings"].columns]
    readings = scoped_readings(scopes, tables["sensor_readings"])
    sums = [x for m in metrics for x in (F.avg(m).alias(m), F.sum(m).alias(f"{m}_sum"), F.count(m).alias(f"{m}_n"))]
    daily = cut_lineage(readings.groupBy(ID, day_index("recorded_epoch_ms").alias("day_index")).agg(*sums))
    means = daily.groupBy(ID).agg(*[ratio(F.sum(f"{m}_sum"), F.sum(f"{m}_n")).alias(m) for m in metrics])
    history = aggregates.daily_means(tables["sensor_readings"], metrics)
    seasons = cut_lineage(series.seasonal_baseline(history, scopes, metrics, scope_cols=(ID,), cfg=cfg))
    zones = tables["habitat_zones"]
    ranges = range_baselines(scopes, tables["telemetry"], cfg) if baseline else scopes.select(ID, F.lit(None).cast("double").alias("baseline_range_km2"))
    scopes = cut_lineage(scopes.join(ranges, ID, "left").withColumn("reference_range_km2", F.coalesce("baseline_range_km2", "home_range_km2")))
    extras = scopes.select(ID, "reference_range_km2")
    if "infrastructure_features" in tables:
        extras = extras.join(fragmentation(scopes, tables["telemetry"], tables["infrastructure_features"]), ID, "left")
    else:
        extras = extras.withColumn("segment_count", F.lit(None).cast("bigint")).withColumn("crossing_count", F.lit(None).cast("bigint"))
    if "habitat_cells" in tables:
        asked = scopes.filter(focal())
        loss = spatial.nearest_cell(asked, tables["habitat_cells"].filter("loss is not null"), ID)
        extras = extras.join(loss.select(ID, F.col("loss").alias("forest_loss_fraction")), ID, "left")
    else:
        extras = extras.withColumn("forest_loss_fraction", F.lit(None).cast("double"))
    if "genetics_records" in tables:
        genes = genetics.genetics_summary(tables["genetics_records"], scopes, (ID,), cfg)
    else:
        genes = scopes.select(ID, *[F.lit(None).cast("double").alias(n) for n in ("effective_population_size", "expected_heterozygosity", "heterozygosity_from_counts")])
    scores = [population_subscore(scopes, found, cfg), habitat_subscore(scopes.drop("reference_range_km2"), fixes, means, seasons, extras, cfg),
              threat_subscore(scopes, threats, zones, cfg), climate_subscore(scopes, daily, means, seasons, cfg),
              genetics_subscore(scopes, genes, cfg), behavior_subscore(scopes, fixes, found, zones, cfg)]
    wide = joins.assemble(scopes, *[cut_lineage(s) for s in scores])
    if "focal_field_evidence" in tables:
        evidence = tables["focal_field_evidence"]
        covered = joins.has_coverage(scopes, evidence).select(ID, F.lit(True).alias("threat_coverage"))
        wide = joins.assemble(wide, joins.latest_census(scopes, evidence), covered)
    poached = threats.join(scopes.select(ID, "end_ms"), ID).filter(is_poaching("end_ms", cfg=cfg)).select(ID, F.lit(True).alias("immediate_poaching_threat")).distinct()
    wide = joins.assemble(wide, poached).withColumn("immediate_poaching_threat", F.coalesce("immediate_poaching_threat", F.lit(False)))
    wide = cut_lineage(conservation_risk_index(compile_subscores(wide, cfg), cfg))
    if "risk_assessments" in tables:
        wide = with_previous(wide, tables["risk_assessments"], cfg)
    else:
        wide = wide.withColumns({"previous_end_ms": F.lit(None).cast("bigint"), "previous_conservation_risk_index": F.lit(None).cast("double"), "previous_slope": F.lit(None).cast("double")})
    wide = series.momentum(wide, cfg, time="end_ms", previous_slope="previous_slope")
    wide = risk_route(contributions(intervention_priority(inbreeding_penalty(wide, cfg), cfg), cfg))
    classes = aggregates.threat_context(threats.join(scopes.select(ID, "start_ms", "end_ms"), ID), [ID, "start_ms", "end_ms"], "start_ms", "end_ms", n=cfg.max_threat_classes)
    context = classes.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("rn", "class_name", "events", "trend", "max_confidence", "latest_ms"))).alias("threat_classes"))
    wide = cut_lineage(joins.assemble(wide, context))
    placed = threats.join(scopes.select(ID, "h3_cell"), ID).withColumn("cell", h3grid.cell_like("latitude", "longitude", "h3_cell"))
    busiest = aggregates.threat_cells(placed, [ID], n=cfg.max_target_cells)
    wide = joins.assemble(wide, busiest.groupBy(ID).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "cell"))), lambda x: x["cell"]).alias("threat_cells")))
    wide = mitigations(interventions(wide, topk.dispatch_targets(threats, [ID], cfg.max_targets, cfg=cfg), cfg), cfg)
    return report_text(wide, cfg)
