import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldlake.functions import geo, h3grid, text, timex
from fieldlake.operators import filters, validate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_known_cells(spark):
    df = spark.createDataFrame([(37.3615593, -122.0553238)], "lat double, lon double")
    assert df.select(h3grid.cell_of("lat", "lon", 7)).first()[0] == "87283472bffffff"
    c = one(spark, h3grid.cell_centre(F.lit("8928308280fffff")))
    assert (round(c["lat"], 6), round(c["lon"], 6)) == (37.776702, -122.418459)
    assert one(spark, h3grid.cell_parent(F.lit("872830828ffffff"), 6)) == "86283082fffffff"
    assert one(spark, h3grid.cell_parent(F.lit("86283082fffffff"), 7)) is None
    for bad in ("cell-1", "8f283082fffffff", "87283082fffffff0", "", "871c00000ffffff"[:14] + "0"):
        assert one(spark, h3grid.is_cell(F.lit(bad))) is False, bad
    assert one(spark, h3grid.cell_res(F.lit(" 8A2A1072B59FFFF "))) == 10
    b = one(spark, h3grid.cell_bounds(F.lit("872830828ffffff")))
    assert b["min_lat"] < 37.78 < b["max_lat"] and 0.01 < b["max_lat"] - b["min_lat"] < 0.05


def test_cells_round_trip():
    rng = np.random.default_rng(0)
    lat, lon = np.degrees(np.arcsin(rng.uniform(-1, 1, 3000))), rng.uniform(-180, 180, 3000)
    for res in (0, 1, 2, 5, 7, 9):
        bits = h3grid.point_to_bits(lat, lon, res)
        back = h3grid.point_to_bits(*h3grid.cell_centres(bits), res)
        assert (bits == back).all()
    assert len(set(h3grid.point_to_bits(*(np.repeat(x, 7) + rng.normal(0, 2, 21000) for x in (lat, lon)), 1).tolist())) <= 842


def test_points_from_blobs(spark):
    wkb = b"\x01" + struct.pack("<Idd", 1, 34.5, -2.25)
    ewkb = b"\x00" + struct.pack(">IIddd", 0xA0000001, 4326, 34.5, -2.25, 12.0)
    lite = b"\x00\x01" + struct.pack("<i4d", 4326, 0, 0, 0, 0) + b"\x7c" + struct.pack("<iddd", 1001, 34.5, -2.25, 7.0) + b"\xfe"
    rows = spark.createDataFrame([(wkb,), (ewkb,), (lite,), (b"junk",)], "b binary").select(geo.point_from_blob("b").alias("p")).select("p.*").collect()
    assert [(r["lon"], r["lat"]) for r in rows[:3]] == [(34.5, -2.25)] * 3
    assert (rows[1]["alt"], rows[2]["alt"], rows[3]["lon"]) == (12.0, 7.0, None)


def test_geodesic(spark):
    # published example: Flinders Peak to Buninyong on GRS80, 54972.271 m
    metres = one(spark, geo.geodesic_m(F.lit(-37.95103341666667), F.lit(144.42486788888888), F.lit(-37.65282113888889), F.lit(143.92649552777777)))
    assert metres == pytest.approx(54972.271, abs=0.01)
    assert one(spark, geo.geodesic_m(F.lit(0.0), F.lit(179.9), F.lit(0.0), F.lit(-179.9))) == pytest.approx(22263.9, abs=1)


def test_frames_cover_the_circle(spark):
    rng = np.random.default_rng(2)
    rows = [(float(a), float(b), float(c), float(d)) for a, b, c, d in zip(rng.uniform(-89, 89, 400), rng.uniform(-180, 180, 400), rng.normal(0, 3, 400), rng.normal(0, 6, 400))]
    df = spark.createDataFrame(rows, "lat double, lon double, dy double, dx double").withColumn("la", F.least(F.lit(90.0), F.greatest(F.lit(-90.0), F.col("lat") + F.col("dy"))))
    df = df.withColumn("lo", F.pmod(F.col("lon") + F.col("dx") + 180, F.lit(360.0)) - 180).withColumn("d", geo.haversine_m("lat", "lon", "la", "lo"))
    missed = df.filter((F.col("d") <= 300_000) & ~geo.in_any_frame("la", "lo", geo.search_frames("lat", "lon", 300_000)))
    assert missed.count() == 0 and df.filter("d <= 300000").count() > 50


def test_segments_and_wkt(spark):
    def cross(*p):
        return one(spark, geo.segments_cross(*[(F.lit(float(x)), F.lit(float(y))) for x, y in p]))
    assert cross((0, 0), (2, 2), (0, 2), (2, 0)) and cross((0, 0), (2, 0), (1, 0), (3, 0)) and cross((0, 0), (1, 0), (1, 0), (1, 5))
    assert not cross((0, 0), (1, 1), (2, 2), (3, 3)) and not cross((0, 0), (1, 0), (0, 1), (1, 1))
    rings = one(spark, geo.wkt_rings(F.lit("POLYGON((0 0, 4 0, 4 4, 0 0),(1 1,2 1,2 2,1 1))")))
    assert len(rings) == 2 and rings[0][1]["lon"] == 4.0


def test_inside_a_polygon_counts_once(spark):
    from fieldlake.operators import spatial
    segments = spark.createDataFrame([(1, 1, 0.5, 0.5, 0.6, 0.6), (2, 1, -1.0, 0.5, 2.0, 0.5), (3, 1, 5.0, 5.0, 6.0, 6.0), (4, 1, 0.11, 0.11, 0.12, 0.12)],
                                     "id long, species_id long, from_longitude double, from_latitude double, longitude double, latitude double")
    features = spark.createDataFrame([("POLYGON((0 0, 1 0, 1 1, 0 1, 0 0),(0.1 0.1, 0.2 0.1, 0.2 0.2, 0.1 0.2, 0.1 0.1))", 0, None)], "geometry_wkt string, detected_epoch_ms long, removed_epoch_ms long")
    assert spatial.crossings(segments, features).first()["crossing_count"] == 2


def test_text_edges(spark):
    assert one(spark, text.split_alleles(F.lit(" A / G;T "))) == ["A", "G", "T"]
    assert one(spark, text.split_alleles(F.lit(" / "))) == ["/"] and one(spark, text.split_alleles(F.lit("  "), F.lit("ACGT"))) == ["ACGT"]
    assert text.normalise_header("Sample-ID") == "sample_id" and text.normalise_header("Collection Datee") == "collection_date" and text.normalise_header("Water Temp") == "water_temp"
    with pytest.raises(ValueError):
        text.normalise_headers(spark.createDataFrame([(1, 2)], "lat int, latitude int"))
    with pytest.raises(KeyError):
        text.render("{{NOPE}}")
    got = one(spark, text.decode_cursor(F.lit("not a cursor")))
    assert got is None or got["epoch_ms"] is None


def test_times(spark):
    assert one(spark, timex.epoch_ms(F.lit("1970-01-01 00:00:00.0006").cast("timestamp"))) == 1
    assert timex.choose_bucket(0, 14 * 86_400_000) == "hour" and timex.choose_bucket(0, 15 * 86_400_000) == "day" and timex.choose_bucket(0, 181 * 86_400_000) == "week"
    with pytest.raises(ValueError):
        timex.choose_bucket(0, 100 * 86_400_000, "hour")
    monday = 1704067200000
    assert one(spark, timex.bucket_start(F.lit(monday + 5 * 86_400_000), "week")) == monday == timex.scalar_bucket_start(monday + 1, "week")
    assert one(spark, timex.time_bin(F.lit("2024-12-05").cast("date"), "season")) == "2025-winter"
    assert one(spark, timex.time_bin(F.lit("2024-12-05").cast("date"), "season", "reference")) == "2023-winter"


def test_invalid_filters(spark):
    df = spark.createDataFrame([(1, 1)], "id int, recorded_epoch_ms long")
    for kw in ({"species": 1}, {"category": "x"}, {"bbox": (1, 0, 0, 0)}):
        with pytest.raises(ValueError):
            filters.filter_layer(df, "environmental", **kw)
    with pytest.raises(ValueError):
        validate.check_weights({"population": 1.0})
    drift = validate.column_drift(df, ["id", "geom"]).first()
    assert drift["missing"] == ["geom"] and drift["unexpected"] == ["recorded_epoch_ms"]
