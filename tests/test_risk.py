"""Worked scenarios of the risk model."""

import pytest
from pyspark.sql import functions as F

from fieldlake.config import RISK
from fieldlake.operators import series, validate
from fieldlake.plans import risk
from fieldlake.session import cut_lineage

DAY = 86_400_000
END = 1_706_659_200_000


@pytest.fixture(scope="module")
def world(spark):
    """One scope with everything a scorer can read, and one scope without any data."""
    scopes = spark.createDataFrame(
        [(1, 1, "cell-a", END - 30 * DAY, END, -2.0, 34.5), (2, 2, "cell-b", END - 30 * DAY, END, 10.0, 20.0)],
        "scope_id long, species_id long, h3_cell string, s long, e long, latitude double, longitude double")
    scopes = scopes.withColumn("period_start", F.timestamp_millis("s")).withColumn("period_end", F.timestamp_millis("e")).drop("s", "e")
    species = spark.createDataFrame(
        [(1, "Loxodonta africana", 500.0, 420.0, 50.0, 500.0, 28.0, 35.0, 150.0, 0.3), (2, "Semnopithecus ajax", 500.0, 100.0, 50.0, 500.0, None, None, None, None)],
        "id long, scientific_name string, minimum_viable_population double, census_population_estimate double, critical_ne_threshold double, "
        "viable_ne_threshold double, resting_heart_rate_min_bpm double, resting_heart_rate_max_bpm double, home_range_km2 double, juvenile_recruitment_ratio double")
    herd = [52, 50, 49, 51, 47, 46, 44, 45, 43, 41, 40, 39, 40, 38]
    rows, n = [], 0
    for day, size in enumerate(herd):
        for k in range(size):
            n += 1
            age = {0: "juvenile", 1: "adult"}.get(k) if day < 9 else ({0: "adult", 1: "adult", 2: "elder"}.get(k) if day < 12 else None)
            rows.append((n, "VISION", 1000 + day, 1, "elephant", "target_wildlife", 0.9, END - (20 - day) * DAY, -2.0, 34.5,
                         f'{{"age_class": "{age}"}}' if age else "{}"))
    rows.append((9001, "ACOUSTIC", 77, None, "gunshot", "immediate_threat", 0.9, END - 2 * 3_600_000, -2.01, 34.51, "{}"))
    rows.append((9002, "ACOUSTIC", 78, None, "chainsaw", "immediate_threat", 0.8, END - 6 * DAY, None, None, "{}"))
    rows.append((9003, "VISION", 5000, 1, "elephant_carcass", "target_wildlife", 0.8, END - 3 * DAY, -2.02, 34.52, "{}"))
    rows.append((9004, "VISION", 5001, 1, "elephant_carcass", "target_wildlife", 0.8, END - 4 * DAY, -2.021, 34.521, "{}"))
    detections = spark.createDataFrame(rows, "id long, source_type string, source_record_id long, species_id long, class_name string, category string, "
                                       "confidence double, detected_epoch_ms long, latitude double, longitude double, metadata string")
    telemetry = spark.createDataFrame(
        [(i, 1, f"a{i % 2}", END - (200 - i) * 3_600_000, -2.0 + 0.001 * (i % 9), 34.5 + 0.001 * (i % 7), 3.0, '{"heart_rate_bpm": 40}') for i in range(1, 121)],
        "id long, species_id long, animal_id string, recorded_epoch_ms long, latitude double, longitude double, speed_kmh double, physiological_metrics string")
    readings = [(i, "cell-a", END - d * DAY, 25.0 + (4.0 if d < 30 else 0.0) + (i % 3) * 0.5, "VALID")
                for i, d in enumerate([*range(1, 30), *range(340, 400), *range(705, 760), *range(1070, 1130)])]
    sensors = spark.createDataFrame(readings, "id long, h3_cell string, recorded_epoch_ms long, ambient_temperature_c double, quality_flag string")
    zones = spark.createDataFrame([(1, None, "well", "WATER_SOURCE", -2.01, 34.51, 3000.0, None, True), (2, 1, "pass", "CORRIDOR", -2.0, 34.5, 5000.0, None, True)],
                                  "id long, species_id long, zone_name string, zone_type string, latitude double, longitude double, radius_m double, risk_multiplier double, active boolean")
    genes = spark.createDataFrame([(1, "s1", 1, "L1", "2023-11-01", "cell-a", {"A": 0.7, "B": 0.3}, 20, 0.41, 2.0, 180.0)],
                                  "id long, sample_id string, species_id long, locus_name string, d string, h3_cell string, allele_frequencies map<string,double>, "
                                  "genotyped_individuals int, expected_heterozygosity double, allelic_richness double, effective_population_size double")
    genes = genes.withColumn("collection_date", F.col("d").cast("date")).drop("d")
    history = spark.createDataFrame([(1, "cell-a", END - 30 * DAY, 40.0, 0.1), (1, "cell-a", END - 10 * DAY, 42.0, 0.2), (1, "cell-a", END, 99.0, 0.0)],
                                    "species_id long, h3_cell string, period_end_epoch_ms long, conservation_risk_index double, risk_momentum_per_day double")
    evidence = spark.createDataFrame([(2, "cell-b", "2024-01-05", "2024-01-20", 250, False, "survey")],
                                     "species_id long, h3_cell string, s string, e string, census_count long, threat_coverage boolean, source string")
    evidence = evidence.selectExpr("species_id", "h3_cell", "cast(s as date) as period_start", "cast(e as date) as period_end", "census_count", "threat_coverage", "source")
    tables = {"species": species, "telemetry": telemetry, "detections": detections, "sensor_readings": sensors, "habitat_zones": zones,
              "genetics_records": genes, "risk_assessments": history, "focal_field_evidence": evidence}
    return scopes, tables


@pytest.fixture(scope="module")
def assessed(world):
    scopes, tables = world
    return cut_lineage(risk.assess(scopes, tables))


def test_worked_population_score(assessed):
    row = assessed.filter("scope_id = 1").first()
    c = row["population_components"]
    assert c["trend"] == pytest.approx(100 * (1 - 286 / 339) / 0.5)
    assert c["viability"] == pytest.approx(16.0)
    # nine juveniles against nine adults, then three days with two adults and an elder
    assert c["recruitment_ratio"] == pytest.approx(9 / 18)
    assert c["recruitment"] == pytest.approx(0.0)
    base = 0.4 * c["trend"] + 0.3 * 16.0
    # two deaths in one cluster: 5 x 2 x 2
    assert row["population_subscore"] == pytest.approx(min(100.0, base + 20.0))
    assert row["population_trend"] == "DECLINING"


def test_threat_and_genetics(assessed):
    row = assessed.filter("scope_id = 1").first()
    import math
    pressure = 1.0 * 0.9 * 2 ** (-2 / 48) * 2.5
    assert row["threat_components"]["event_count"] == 1
    assert row["threat_components"]["decayed_pressure"] == pytest.approx(pressure)
    assert row["threat_subscore"] == pytest.approx(100 * (1 - math.exp(-3 * pressure / 3)))
    assert row["immediate_poaching_threat"] is True and "RANGER_DISPATCH" in row["actions"]
    expected = (0.75 * 100 * (1 - 180 / 500) + 0.25 * 100 * (1 - 0.41 / 0.5)) / 1.0
    assert row["genetics_subscore"] == pytest.approx(expected)
    f = 1 - (1 - 1 / 360) ** 10
    assert row["inbreeding_penalty_index"] == pytest.approx(0.6 * 100 * min(1, f / 0.1) + 0.4 * 100 * (1 - 0.41 / 0.5))


def test_behavior_and_climate(assessed):
    row = assessed.filter("scope_id = 1").first()
    c = row["behavior_components"]
    assert c["corridor_retention"] == 1.0 and c["corridor"] == 0.0
    assert c["physiology"] == pytest.approx(100 * ((40 - 35) / 35) / 0.5)
    assert c["elder_absence"] == pytest.approx(9 * 0.5 / 12)
    assert row["climate_subscore"] > 40 and "climate" not in row["missing_domains"]


def test_momentum_uses_the_newest_strictly_earlier_row(assessed):
    row = assessed.filter("scope_id = 1").first()
    assert row["previous_conservation_risk_index"] == 42.0 and row["momentum_window_days"] == pytest.approx(10.0)
    assert row["risk_momentum_per_day"] == pytest.approx((row["conservation_risk_index"] - 42.0) / 10)
    assert row["acceleration_per_day"] == pytest.approx((row["risk_momentum_per_day"] - 0.2) / 10)


def test_empty_focal_scope(assessed):
    row = assessed.filter("scope_id = 2").first()
    assert row["population_subscore"] == pytest.approx(50.0) and "population" not in row["missing_domains"]
    assert set(row["missing_domains"]) == {"habitat", "threat", "climate", "genetics", "behavior"}
    assert row["actions"] == ["ROUTINE_MONITORING"]
    assert "Insufficient data for assessment" in row["genetics_text"] and "no previous assessment" in row["summary_text"]


def test_rows_are_consistent(assessed):
    checked = validate.check_assessments(assessed)
    assert checked.filter(F.size("reject_reasons") > 0).count() == 0
    shown = assessed.withColumn("reported_shares", F.col("percentages")).withColumn("genetics_missing", F.array_contains("missing_domains", "genetics")).withColumn(
        "behavior_missing", F.array_contains("missing_domains", "behavior")).withColumn("reported_mitigations", F.col("mitigations")).withColumn("reported_cells", F.col("target_cells"))
    assert validate.check_narratives(shown).filter(F.size("reject_reasons") > 0).count() == 0
    lied = shown.withColumn("genetics_text", F.lit("The population is stable.")).withColumn("critical_inbreeding_risk", F.lit(True))
    assert "safe_words" in validate.check_narratives(lied).first()["reject_reasons"]


def test_threat_cells_of_a_real_cell(spark):
    """Cells at the resolution of the scope's own cell; a scope without a real cell keeps its own."""
    from fieldlake.functions.h3grid import cell_like, cell_of
    rows = spark.createDataFrame([(1, "872830828ffffff", 37.77, -122.41), (2, "85283083fffffff", 37.77, -122.41), (3, "cell-a", 37.77, -122.41), (4, "872830828ffffff", None, 1.0)],
                                 "id int, cell string, latitude double, longitude double")
    got = {r["id"]: r for r in rows.select("id", cell_like("latitude", "longitude", "cell").alias("own"), cell_of("latitude", "longitude", 7).alias("seven"),
                                           cell_of("latitude", "longitude", 5).alias("five")).collect()}
    assert got[1]["own"] == got[1]["seven"] and got[2]["own"] == got[2]["five"] and got[3]["own"] is None and got[4]["own"] is None


def test_report_text(assessed):
    row = assessed.filter("scope_id = 1").first()
    text = row["narrative_report"]
    for figure in (row["conservation_risk_index"], row["genetics_contribution"], row["intervention_priority_index"]):
        assert f"{figure:.2f}" in text
    assert text.count("figures: ") == 4 and row["dominant_domain"] in text
    assert all(m.startswith("go to lat ") and "why: signs of poaching" in m for m in row["ranger_messages"])
    bare = assessed.filter("scope_id = 2").first()["narrative_report"]
    assert "Insufficient data for assessment" in bare and bare.count("figures: ") == 4


def test_primary_scores(spark):
    df = spark.createDataFrame([(1, 50.0, 0.0, 12.0, None, ["population"])],
                               "scope_id long, population_subscore double, habitat_subscore double, threat_subscore double, genetics_subscore double, missing_domains array<string>")
    rows = risk.primary_scores(df).collect()
    assert [r["risk"] for r in rows] == [None, 0.0, 12.0, None]
    assert [r["status"] for r in rows] == ["unavailable", "available", "available", "unavailable"]
    assert {r["status"] for r in risk.primary_scores(df, False).collect()} == {"unknown"}


def test_seasonal_baseline_by_hand(spark):
    import statistics
    vals = {d: float(20 + (d * 7) % 5) for d in range(0, 4000)}
    daily = spark.createDataFrame([("c", d, v) for d, v in vals.items()], "h3_cell string, day_index long, ambient_temperature_c double")
    end = 3900 * DAY
    scopes = spark.createDataFrame([(1, "c", end - 30 * DAY, end)], "scope_id long, h3_cell string, window_start_ms long, window_end_ms long")
    got = series.seasonal_baseline(daily, scopes, ["ambient_temperature_c"]).first()
    means, all_days = [], []
    for k in range(1, 11):
        stop = end - int(k * 365.2425 * DAY)
        window = [v for d, v in vals.items() if stop - 30 * DAY < d * DAY <= stop]
        if len(window) >= 14:
            means.append(statistics.fmean(window))
            all_days.extend(window)
    spread = statistics.stdev(all_days)
    assert got["baseline_samples"] == len(means) == 10
    assert got["baseline_mean"] == pytest.approx(statistics.fmean(means))
    assert got["baseline_daily_std"] == pytest.approx(spread)
    assert got["baseline_std"] == pytest.approx(max(statistics.stdev(means), spread / (len(all_days) / len(means)) ** 0.5))


def test_directives_of_a_critical_scope(spark):
    base = {"scope_id": 1, "species_id": 1, "scientific_name": "x", "h3_cell": "c", "latitude": 1.0, "longitude": 2.0}
    cases = [("genetics", False, 85.0, ["GENETIC_RESCUE", "CAPTIVE_BREEDING_PREP"]), ("habitat", False, 80.0, ["CAPTIVE_BREEDING_PREP", "HABITAT_RESTORATION"]),
             ("threat", False, 90.0, ["GENETIC_RESCUE", "RANGER_DISPATCH", "DRONE_DEPLOYMENT"]), ("population", True, 30.0, ["TARGETED_PATROLS", "RANGER_DISPATCH", "DRONE_DEPLOYMENT"])]
    for driver, poaching, cri, want in cases:
        df = spark.createDataFrame([{**base, "conservation_risk_index": cri}]).select(
            "*", F.lit(driver).alias("dominant_domain"), F.lit(poaching).alias("immediate_poaching_threat"), F.lit(False).alias("critical_inbreeding_risk"),
            F.array().cast("array<string>").alias("missing_domains"), F.when(F.col("conservation_risk_index") <= 40, 2).when(F.col("conservation_risk_index") <= 80, 4).otherwise(5).alias("escalation_level"))
        row = risk.interventions(df).first()
        assert row["actions"] == want, driver
        assert bool(row["dispatch_targets"]) == ("RANGER_DISPATCH" in want)
    assert RISK.critical_cri == 0.8
