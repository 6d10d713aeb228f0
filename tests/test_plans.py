"""The physical plans the operators are written for."""

import re

import pytest
from pyspark.sql import functions as F

from fieldlake.operators import aggregates, filters, scale, series, spatial
from fieldlake.registry.views import view


@pytest.fixture(scope="module")
def stored(spark, sf, tmp_path_factory):
    """The stand-in tables written with their own columns, as a lake holds them."""
    out = {}
    for name in ("v_telemetry", "v_detections", "v_sensor_readings", "v_risk_assessments"):
        path = str(tmp_path_factory.mktemp(name))
        view(spark, sf, name).write.mode("overwrite").parquet(path)
        out[name] = spark.read.parquet(path)
    return out


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(stored):
    df = aggregates.bucket_stats(filters.filter_layer(stored["v_detections"], "acoustic", 1704067200000, 1705363200000, species=3), "acoustic", "hour", ["confidence"])
    text = plan(df)
    pushed = re.search(r"PushedFilters: \[(.*?)\]", text).group(1)
    for part in ("EqualTo(source_type,ACOUSTIC)", "GreaterThanOrEqual(detected_epoch_ms,1704067200000)", "LessThan(detected_epoch_ms,1705363200000)", "EqualTo(species_id,3)"):
        assert part in pushed
    schema = re.search(r"ReadSchema: struct<(.*?)>", text).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"source_type", "species_id", "category", "confidence", "detected_epoch_ms"}
    assert "partial_count" in text


def test_latest_rows_are_aggregates(stored):
    text = plan(scale.latest_per(stored["v_risk_assessments"], ["species_id", "h3_cell"], "period_end_epoch_ms", "id"))
    assert "partial_max_by" in text and "Window" not in text


def test_top_n_is_cut_before_the_shuffle(spark, stored):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "5000")
    text = plan(aggregates.environment_summary(stored["v_sensor_readings"], 0, 2 ** 45, ["ambient_temperature_c"]))
    assert text.count("WindowGroupLimit") >= 2


def test_spatial_joins_are_equi_joins(stored):
    points = stored["v_detections"].select("id", "latitude", "longitude")
    centres = stored["v_telemetry"].select(F.col("id").alias("c"), F.col("latitude").alias("centre_lat"), F.col("longitude").alias("centre_lon"))
    for text in (plan(spatial.radius_join(points, centres, 5000)), plan(spatial.herd_flags(stored["v_telemetry"].selectExpr("id as frame", "animal_id as species", "latitude as cx", "longitude as cy")))):
        assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_one_shuffle_per_series(stored):
    text = plan(series.hampel(stored["v_sensor_readings"].select("id", "device_id", "recorded_epoch_ms", "ambient_temperature_c"), ["device_id"], "ambient_temperature_c"))
    assert len(re.findall(r"^\(\d+\) Exchange", text, re.M)) == 1 and "Python" not in text
