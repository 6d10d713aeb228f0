"""Frozen settings shared by the operators.

The numbers below are fixed values: they must equal the monitoring application's
defaults for results to agree. Every operator takes the dataclass as an argument, so
a deployment overrides a value with ``dataclasses.replace``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Risk domains in report order.
DOMAINS = ("population", "habitat", "threat", "climate", "genetics", "behavior")

# Physical ranges of stored sensor measurements (None = unbounded).
MEASUREMENT_RANGES = {
    "water_ph": (0.0, 14.0),
    "dissolved_oxygen_mg_l": (0.0, None),
    "water_turbidity_ntu": (0.0, None),
    "water_temperature_c": (-5.0, 100.0),
    "water_salinity_psu": (0.0, None),
    "water_velocity_m_s": (0.0, None),
    "electrical_conductivity_us_cm": (0.0, None),
    "ambient_temperature_c": (-90.0, 70.0),
    "relative_humidity_percent": (0.0, 100.0),
    "barometric_pressure_hpa": (300.0, 1100.0),
    "nitrate_mg_l": (0.0, None),
    "phosphate_mg_l": (0.0, None),
    "ammonia_mg_l": (0.0, None),
    "pollutant_concentration_level": (0.0, None),
    "air_quality_level": (1.0, 10.0),
}
MEASUREMENTS = tuple(MEASUREMENT_RANGES)

# Accepted ranges of raw environmental payload fields.
RAW_SENSOR_RANGES = {
    "temperature": (-100.0, 100.0),
    "air_quality_level": (1.0, 10.0),
    "pollutant_concentration_level": (0.0, 100000.0),
    "rainfall": (0.0, 2000.0),
    "humidity": (0.0, 100.0),
    "water_velocity": (0.0, 50.0),
    "water_temperature": (-10.0, 100.0),
    "water_ph": (0.0, 14.0),
    "water_salinity": (0.0, 50.0),
    "water_oxygen_concentration": (0.0, 20.0),
    "water_turbidity": (0.0, 4000.0),
}
# Smoothing factor per raw metric (rainfall is scored but never filtered).
EMA_ALPHAS = {
    "water_turbidity": 0.2,
    "water_velocity": 0.25,
    "water_ph": 0.1,
    "water_salinity": 0.05,
    "water_oxygen_concentration": 0.15,
    "water_temperature": 0.05,
    "temperature": 0.1,
    "humidity": 0.1,
    "air_quality_level": 0.15,
    "pollutant_concentration_level": 0.2,
}

# Enumerations.
FIX_QUALITIES = ("3D_FIX", "2D_FIX", "ARGOS_LOCATION_CLASS", "UNKNOWN")
HARDWARE_STATES = ("BATTERY_OK", "BATTERY_LOW")
QUALITY_FLAGS = ("VALID", "SUSPECT", "INVALID")
CATEGORIES = ("target_wildlife", "immediate_threat", "other")
AGE_CLASSES = ("juvenile", "subadult", "adult", "elder")
ALERT_PRIORITIES = ("INFO", "ROUTINE", "ELEVATED", "HIGH", "CRITICAL")
ESCALATION_TIERS = ("LOW", "GUARDED", "ELEVATED", "HIGH", "CRITICAL")
TRACEABLE_TABLES = (
    "telemetry", "sensor_readings", "detections", "genetics_records",
    "acoustic_events", "camera_ingestion", "edna_samples",
)

EARTH_RADIUS_M = 6371008.8
HOUR_MS = 3_600_000
DAY_MS = 86_400_000
WEEK_MS = 7 * DAY_MS
BUCKET_MS = {"hour": HOUR_MS, "day": DAY_MS, "week": WEEK_MS}
DAYS_PER_YEAR = 365.2425
# The focal species is scored from verified field evidence only.
FOCAL_SPECIES = "Semnopithecus ajax"


@dataclass(frozen=True)
class RiskConfig:
    """Fixed values of the scoring model."""

    missing_score: float = 50.0
    # metric -> (value scored 0, value scored 100)
    bounds: dict = field(default_factory=lambda: {
        "herd_decline": (0.0, 0.5),
        "viability_shortfall": (0.0, 1.0),
        "recruitment_deficit": (0.0, 1.0),
        "range_loss": (0.0, 0.6),
        "crossing_rate": (0.0, 0.1),
        "degradation_z": (0.0, 3.0),
        "threat_pressure": (0.0, 3.0),
        "extreme_days": (0.0, 0.3),
        "heterozygosity_deficit": (0.0, 1.0),
        "corridor_loss": (0.0, 1.0),
        "elder_absence": (0.0, 1.0),
        "heart_rate_deviation": (0.0, 0.5),
    })
    population_weights: dict = field(default_factory=lambda: {"trend": 0.4, "viability": 0.3, "recruitment": 0.3})
    habitat_weights: dict = field(default_factory=lambda: {"range_loss": 0.4, "fragmentation": 0.3, "degradation": 0.3})
    genetic_weights: dict = field(default_factory=lambda: {"effective_population": 0.75, "heterozygosity": 0.25})
    behavior_weights: dict = field(default_factory=lambda: {"corridor": 0.4, "social": 0.4, "physiology": 0.2})
    domain_weights: dict = field(default_factory=lambda: {
        "population": 0.25, "habitat": 0.15, "threat": 0.25, "climate": 0.10, "genetics": 0.15, "behavior": 0.10,
    })
    # species id (as text) or scientific name -> six weights
    species_weights: dict = field(default_factory=dict)
    herd_window: int = 7
    juvenile_ratio: float = 0.3
    box_separation: float = 1.8
    box_minimum: int = 10
    mortality_penalty: float = 5.0
    mortality_growth: float = 2.0
    mortality_radius_m: float = 5000.0
    mortality_days: float = 7.0
    mcp_percent: float = 95.0
    minimum_fixes: int = 5
    # +1 higher is worse, -1 lower is worse, 0 any deviation is worse
    degradation_directions: dict = field(default_factory=lambda: {
        "dissolved_oxygen_mg_l": -1, "water_turbidity_ntu": 1, "water_ph": 0, "water_salinity_psu": 0,
        "electrical_conductivity_us_cm": 1, "nitrate_mg_l": 1, "phosphate_mg_l": 1, "ammonia_mg_l": 1,
        "pollutant_concentration_level": 1, "air_quality_level": 1,
    })
    climate_directions: dict = field(default_factory=lambda: {
        "ambient_temperature_c": 1, "water_temperature_c": 1,
        "barometric_pressure_hpa": 0, "relative_humidity_percent": -1,
    })
    threat_half_life_h: float = 48.0
    threat_window_days: float = 30.0
    threat_weights: dict = field(default_factory=lambda: {
        "gunshot": 1.0, "poaching": 1.0, "snare": 0.9, "chainsaw": 0.7,
        "vessel": 0.6, "engine": 0.5, "vehicle": 0.4,
    })
    default_threat_weight: float = 0.5
    zone_multipliers: dict = field(default_factory=lambda: {
        "BREEDING": 3.0, "WATER_SOURCE": 2.5, "CORE_RANGE": 1.5, "CORRIDOR": 1.5,
    })
    periphery_multiplier: float = 0.5
    zone_search_m: float = 100000.0
    climate_days: float = 30.0
    baseline_years: int = 10
    minimum_baseline_years: int = 3
    minimum_baseline_days: int = 14
    sigma_threshold: float = 2.0
    subthreshold_max: float = 40.0
    escalation_rate: float = 1.5
    extreme_weight: float = 0.25
    heterozygosity_baseline: float = 0.5
    viable_ne: float = 500.0
    critical_ne: float = 50.0
    corridor_share: float = 0.5
    corridor_retention: float = 0.8
    orphan_days: int = 3
    orphan_floor: float = 85.0
    orphan_day_penalty: float = 15.0
    # aggregation
    analysis_radius_m: float = 50000.0
    genetics_lookback_days: float = 365.0
    density_grid: int = 5
    mortality_keywords: tuple = ("carcass", "mortality", "dead")
    # synthesis
    momentum_window_days: float = 30.0
    momentum_tolerance: float = 0.001
    momentum_lookback_days: float = 90.0
    momentum_gain: float = 2.0
    momentum_bounds: tuple = (0.5, 2.0)
    feasibility_radius_m: float = 50000.0
    feasibility: tuple = (1.2, 0.8)
    # (name, latitude, longitude) of each ranger outpost
    outposts: tuple = ()
    trend_threshold: float = 0.05
    inbreeding_generations: float = 10.0
    inbreeding_tolerance: float = 0.1
    drift_weight: float = 0.6
    poaching_weight: float = 0.9
    poaching_confidence: float = 0.6
    poaching_hours: float = 48.0
    critical_cri: float = 0.8
    max_targets: int = 3
    alert_channel: str = "MQTT"
    drone_altitude_m: float = 120.0
    # narrative
    critical_subscore: float = 70.0
    contribution_decimals: int = 1
    contribution_tolerance: float = 0.5
    max_threat_classes: int = 10
    max_target_cells: int = 5
    elder_absence_loss: float = 0.5


@dataclass(frozen=True)
class GeneticConfig:
    """Fixed values of the population-genetics summary."""

    time_bin: str = "year"
    minimum_samples: int = 2
    critical_ne: float = 50.0
    vulnerable_ne: float = 500.0
    generation_years: float | None = None
    generation_years_by_species: dict = field(default_factory=dict)


@dataclass(frozen=True)
class GpsConfig:
    """Fixed values of collar validation."""

    battery_low: float = 30.0
    future_days: float = 1.0
    default_max_speed: float = 400.0


@dataclass(frozen=True)
class AcousticConfig:
    """Fixed values of the audio jobs."""

    rate: int = 16000
    segment_sec: float = 3.0
    overlap_sec: float = 1.0
    n_fft: int = 1024
    hop: int = 256
    mel_bands: int = 64
    confidence: float = 0.65
    threat_confidence: float = 0.4
    debounce_sec: float = 4.0
    wildlife: tuple = ()
    threats: tuple = ()
    class_thresholds: dict = field(default_factory=dict)


@dataclass(frozen=True)
class VisionConfig:
    """Fixed values of the camera jobs."""

    width: int = 640
    height: int = 640
    confidence: float = 0.45
    iou: float = 0.5
    herd_pixels: float = 100.0
    sample_sec: float = 1.0
    max_frames: int = 300
    classes: tuple = ()
    threats: tuple = ()


@dataclass(frozen=True)
class AlertConfig:
    """Fixed values of alert routing."""

    priorities: tuple = ALERT_PRIORITIES
    default_priority: str = "ROUTINE"
    critical_cri: float = 80.0
    high_cri: float = 60.0
    elevated_cri: float = 40.0
    duplicate_sec: float = 30.0
    wake_cooldown_sec: float = 300.0
    replay: int = 10


@dataclass(frozen=True)
class AnalyticsConfig:
    """Fixed values of the dashboards."""

    rolling_rows: int = 7
    summary_metrics: tuple = (
        "ambient_temperature_c", "relative_humidity_percent", "water_ph", "dissolved_oxygen_mg_l",
    )
    flat_percent: float = 1.0
    hourly_max_days: float = 14.0
    daily_max_days: float = 180.0
    max_points: int = 1000
    max_gap: int = 12
    zone_resolution: int = 6
    radar_weights: dict = field(default_factory=lambda: {
        "wildlife_sightings": 0.25, "animal_presence": 0.15, "temperature_variability": -0.15,
        "acoustic_threats": -0.30, "conservation_risk": -0.15,
    })
    max_divisions: int = 256


RISK = RiskConfig()
GENETICS = GeneticConfig()
GPS = GpsConfig()
ACOUSTIC = AcousticConfig()
VISION = VisionConfig()
ALERTS = AlertConfig()
ANALYTICS = AnalyticsConfig()
