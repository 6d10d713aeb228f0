"""Table schemas, natural keys and message shapes."""

from __future__ import annotations

from fieldlake.config import MEASUREMENTS

_MEASURES = ", ".join(f"{m} double" for m in MEASUREMENTS)

SCHEMAS = {
    "species": "id bigint, scientific_name string, common_name string, iucn_status string, minimum_viable_population int, "
               "census_population_estimate int, critical_ne_threshold int, viable_ne_threshold int, generation_time_years double, "
               "resting_heart_rate_min_bpm double, resting_heart_rate_max_bpm double, body_temperature_min_c double, "
               "body_temperature_max_c double, max_speed_kmh double, home_range_km2 double, juvenile_recruitment_ratio double",
    "telemetry": "id bigint, species_id bigint, animal_id string, device_id string, recorded_at timestamp, latitude double, longitude double, "
                 "altitude double, fix_quality string, satellite_count int, hdop double, speed_kmh double, battery_voltage double, physiological_metrics string",
    "sensor_readings": "id bigint, sensor_mac string, device_id string, recorded_at timestamp, h3_cell string, latitude double, longitude double, "
                       f"altitude double, {_MEASURES}, quality_flag string",
    "detections": "id bigint, source_type string, source_record_id bigint, detection_index int, device_id string, asset_path string, species_id bigint, "
                  "class_id int, class_name string, category string, confidence double, detected_at timestamp, ended_at timestamp, frame_width int, "
                  "frame_height int, bbox_left double, bbox_top double, bbox_right double, bbox_bottom double, latitude double, longitude double, "
                  "altitude double, metadata string",
    "habitat_zones": "id bigint, species_id bigint, zone_name string, zone_type string, latitude double, longitude double, radius_m double, "
                     "risk_multiplier double, active boolean",
    "acoustic_devices": "device_id string, location_id string, latitude double, longitude double, altitude double",
    "edna_approved_loci": "target_species string, locus_name string, max_allele_count int",
}

# Natural keys, the targets of deduplication and upserts.
KEYS = {
    "telemetry": ("animal_id", "recorded_epoch_ms"),
    "sensor_readings": ("sensor_mac", "recorded_epoch_ms"),
    "detections": ("source_type", "source_record_id", "detection_index"),
    "genetics_records": ("sample_id", "locus_name"),
    "risk_assessments": ("species_id", "h3_cell", "period_start", "period_end"),
    "acoustic_events": ("device_id", "class_id", "start_timestamp"),
    "acoustic_windows": ("source_id", "window_index"),
    "edna_samples": ("source_hash", "source_row"),
    "population_metrics": ("project_id", "target_species", "h3_cell", "time_bin"),
    "population_alert_outbox": ("project_id", "target_species", "h3_cell", "time_bin", "risk_status"),
    "habitat_zones": ("species_id", "zone_name"),
    "focal_field_evidence": ("species_id", "h3_cell", "period_start", "period_end", "source"),
}
# Keys whose nulls never collide: a row without them is always new.
NULLABLE_KEYS = {"detections": ("source_record_id",)}

COLLAR_FIELDS = ("animal_id", "target_species", "device_model", "device_make", "timestamp", "latitude", "longitude", "altitude", "temperature",
                 "body_temperature", "heart_rate", "battery_percentage", "fix_quality", "gps_fix_quality", "hardware_state")
SENSOR_FIELDS = ("location_id", "target_species", "device_model", "device_make", "timestamp", "latitude", "longitude", "altitude", "temperature",
                 "air_quality_level", "pollutant_concentration_level", "rainfall", "humidity", "water_velocity", "water_temperature", "water_ph",
                 "water_salinity", "water_oxygen_concentration", "water_turbidity", "battery_percentage", "fix_quality", "gps_fix_quality", "hardware_state")

INGEST = ("reading_type string, sensor_id string, timestamp string, latitude double, longitude double, altitude double, threat_detected boolean, "
          "species_id bigint, animal_id string, fix_quality string, satellite_count int, hdop double, speed_kmh double, battery_voltage double, "
          "heart_rate_bpm double, accelerometer_g array<double>, sensor_mac string, h3_cell string, measurements map<string,double>, quality_flag string, "
          "class_name string, category string, confidence double, class_id int, source_record_id bigint, detection_index int, ended_at string, "
          "asset_path string, metadata map<string,string>, frame_width int, frame_height int, bbox_left double, bbox_top double, bbox_right double, bbox_bottom double")
