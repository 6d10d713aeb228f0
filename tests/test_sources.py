"""Readers and writers on small hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from fieldlake.operators import validate
from fieldlake.sources import readers, sinks


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_collar_messages(spark, tmp_path):
    lines = [{"device_id": "d1", "max_speed": 80, "target_species": "elephant", "fields": {"animal_id": "a", "timestamp": "2024 01 02 03 04 05 000600",
              "latitude": "-1.5", "longitude": 35, "battery_percentage": 20, "gps_fix_quality": "3d_fix"}},
             {"fields": {"target_species": "lion", "altitude": "-12000", "heart_rate": ""}, "target_species": "ignored"}, "not json"]
    path = write(tmp_path / "c.jsonl", "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines))
    rows = validate.derive_hardware_state(readers.read_gps(spark, path)).collect()
    first = next(r for r in rows if r["device_id"] == "d1")
    assert (first["target_species"], first["max_speed"], first["latitude"], first["hardware_state"], first["fix_quality"]) == ("elephant", 80.0, -1.5, "BATTERY_LOW", "3D_FIX")
    assert first["recorded_epoch_ms"] == 1704164645001
    second = next(r for r in rows if r["target_species"] == "lion")
    assert second["animal_id"] == "unknown" and second["heart_rate"] is None and second["recorded_epoch_ms"] == 0
    checked = validate.validate_gps(readers.read_gps(spark, path), 1_800_000_000_000)
    assert {r["target_species"]: r["reject_reasons"] for r in checked.collect()}["lion"] == ["altitude"]


def test_environmental_messages(spark, tmp_path):
    path = write(tmp_path / "e.jsonl", json.dumps({"device_id": "s", "fields": {"location_id": "l", "timestamp": "2024 01 02 03 04 05 000000", "temperature": 25, "humidity": 120, "air_quality_level": 3}}))
    row = validate.validate_environmental(readers.read_environmental(spark, path), 1_800_000_000_000).first()
    assert row["water_ph"] == 7.0 and row["temperature"] == 25.0 and row["reject_reasons"] == ["humidity"]


def test_mixed_ingest(spark, tmp_path):
    one = {"reading_type": "environmental", "sensor_id": "s", "timestamp": "2024-01-02T00:00:00Z", "latitude": 37.3615593, "longitude": -122.0553238,
           "sensor_mac": " aa-bb-cc-dd-ee-ff", "measurements": {"ambient_temperature_c": 24.0, "oops": 1.0}}
    two = {"reading_type": "acoustic", "sensor_id": "m", "timestamp": "2024-01-02T01:00:00+01:00", "latitude": 1.0, "longitude": 2.0, "class_name": "gunshot",
           "category": "immediate_threat", "confidence": 0.93}
    path = write(tmp_path / "i.jsonl", json.dumps([one, two]) + "\n" + json.dumps({**two, "reading_type": "gps", "species_id": 1, "animal_id": "a", "heart_rate_bpm": 40.0}))
    parts = readers.route_ingest(readers.parse_ingest(spark.read.text(path)))
    env = parts["environmental"].first()
    assert env["sensor_mac"] == "AA:BB:CC:DD:EE:FF" and env["h3_cell"] == "87283472bffffff" and env["ambient_temperature_c"] == 24.0
    assert parts["environmental"].select(validate.unknown_measurements(F.create_map(F.lit("oops"), F.lit(1.0)))).first()[0] == ["oops"]
    assert parts["acoustic"].first()["detected_epoch_ms"] == env["recorded_epoch_ms"] == 1704153600000
    assert json.loads(parts["gps"].first()["physiological_metrics"])["heart_rate_bpm"] == 40.0 and parts["vision"].count() == 0


def test_edna_files(spark, tmp_path):
    sheet = "﻿Sample ID,Species,Date,Lat,Lon,Marker,Alleles,Genotype\nS1,Panthera_leo,2024-01-02,1.5,36,L1,2,A/G\nS1,Panthera_leo,2024-01-02,1.5,36,L9,2,A\n"
    df = readers.read_edna_tabular(spark, write(tmp_path / "s.csv", sheet))
    loci = readers.loci_from_config(spark, {"panthera leo": {"L1": 2}})
    got = {r["locus_name"]: r["reject_reasons"] for r in validate.validate_edna(df.withColumn("project_id", F.lit("p")), loci).collect()}
    assert got == {"L1": [], "L9": ["unknown_locus"]}
    with pytest.raises(ValueError):
        readers.read_edna_tabular(spark, write(tmp_path / "bad.csv", "sample,species\n1,2\n"))
    fasta = '>r1 species="Panthera leo" locus=L1 lat=1.5 lon=36 date=2024-01-02\nACGT\nNN\n>r2 sample=S9 marker=L1\nAC GT\n'
    rows = {r["sample_id"]: r for r in readers.read_sequences(spark, write(tmp_path / "x.fasta", fasta)).collect()}
    assert rows["r1"]["sequence"] == "ACGTNN" and rows["r1"]["target_species"] == "Panthera leo" and rows["r1"]["latitude"] == "1.5"
    assert rows["S9"]["locus_name"] == "L1" and rows["S9"]["sequence"] == "ACGT"
    fastq = "@q1 sample=S1 locus=L2\nACGT\n+\nIIII\n@q2\nAC\n+\n!I\n"
    quality = {r["sample_id"]: r["mean_quality"] for r in readers.read_sequences(spark, write(tmp_path / "x.fastq", fastq), "fastq").collect()}
    assert quality == {"S1": 40.0, "q2": 20.0}


def test_media_and_maps(spark, tmp_path):
    write(tmp_path / "cams/dev-1/a.JPG", "x")
    write(tmp_path / "cams/dev-2/b.mp4", "x")
    write(tmp_path / "cams/dev-2/c.txt", "x")
    media = {r["device_id"]: r for r in readers.scan_media(spark, str(tmp_path / "cams")).collect()}
    assert media["dev-1"]["source_type"] == "IMAGE" and media["dev-2"]["source_type"] == "VIDEO" and len(media) == 2
    assert media["dev-1"]["file_hash"] == "2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    write(tmp_path / "mics/dev-7/deep/a.wav", "x")
    write(tmp_path / "mics/b.wav", "y")
    audio = {r["device_id"]: r["source_id"] for r in readers.scan_audio(spark, str(tmp_path / "mics")).collect()}
    assert set(audio) == {"dev-7", "unknown"} and audio["dev-7"].startswith("dev-7:2d71")
    assert readers.read_class_map(spark, write(tmp_path / "m.csv", "Index,Display_Name\n0,gunshot\n1,elephant\n")).count() == 2
    with pytest.raises(ValueError):
        readers.read_class_map(spark, write(tmp_path / "n.csv", "index,label\n0,a\n0,b\n"))


def test_habitat_documents(spark, tmp_path):
    doc = {"version": 1, "species": "Semnopithecus ajax", "created_at": "2024-01-01T00:00:00+00:00", "cell_size_m": 1000, "loss_year": 2023,
           "metrics": {"auc": 0.95, "tss": 0.8, "members": [{"auc": 0.92, "tss": 0.71}]},
           "cells": [{"lat": 33.0, "lon": 75.0, "vote": 0.75, "status": "suitable_model_domain", "loss": 0.1}, {"lat": 33.0, "lon": 75.01, "vote": None, "status": "nodata", "loss": None}]}
    cells, meta = readers.read_habitat_cells(spark, write(tmp_path / "b.json", json.dumps(doc, indent=1)))
    assert validate.validate_bundle(cells, meta, "Semnopithecus ajax", 2026).first()["reject_reasons"] == []
    doc["metrics"]["tss"] = 0.69
    cells, meta = readers.read_habitat_cells(spark, write(tmp_path / "c.json", json.dumps(doc)))
    assert validate.validate_bundle(cells, meta, "Semnopithecus ajax", 2026).first()["reject_reasons"] == ["metrics"]
    csv = "scientific_name,longitude,latitude,uncertainty_m,source,approved\nSemnopithecus ajax,75,33,500,survey,TRUE\nSemnopithecus ajax,75,33,1500,survey,true\nother,75,33,1,s,true\n"
    assert readers.read_presences(spark, write(tmp_path / "p.csv", csv)).count() == 1


def test_append_and_upsert(spark, tmp_path):
    table = sinks.ParquetTable(spark, str(tmp_path / "t"))
    first = spark.createDataFrame([("a", 1, 10), ("a", 1, 11), ("b", 2, 20)], "k string, t int, v int")
    assert sinks.append_new(first, table, ["k", "t"], ["v"]) == {"received": 3, "stored": 2, "duplicate": 1}
    assert sinks.append_new(first.unionByName(spark.createDataFrame([("c", 3, 30)], first.schema)), table, ["k", "t"], ["v"]) == {"received": 4, "stored": 1, "duplicate": 3}
    sinks.upsert(spark.createDataFrame([("a", 1, 99), ("d", 4, 40)], first.schema), table, ["k", "t"])
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == [("a", 99), ("b", 20), ("c", 30), ("d", 40)]
    loose = spark.createDataFrame([("V", None, 0), ("V", None, 0), ("V", 1, 0), ("V", 1, 0)], "s string, r int, i int")
    assert sinks.dedupe(loose, ["s", "r", "i"], nullable=["r"]).count() == 3


def test_outbox_and_quarantine(spark, tmp_path):
    metrics = spark.createDataFrame([("p", "s", "c", "2024", "CRITICAL_INBREEDING_RISK", 12.0), ("p", "s", "d", "2024", "LOW_RISK", 900.0)],
                                    "project_id string, target_species string, h3_cell string, time_bin string, risk_status string, ne double")
    box = sinks.ParquetTable(spark, str(tmp_path / "o"))
    assert sinks.emit_outbox(metrics, box)["stored"] == 1
    assert sinks.emit_outbox(metrics, box)["stored"] == 0
    sent = []
    assert sinks.publish_outbox(box, lambda df: sent.extend(df.collect())) == 1
    assert sinks.publish_outbox(box, lambda df: sent.extend(df.collect())) == 0 and len(sent) == 1
    rejected = spark.createDataFrame([("h1", 3, ["latitude"], "S1")], "source_hash string, source_row int, reject_reasons array<string>, sample_id string")
    sinks.write_quarantine(rejected, str(tmp_path / "q"))
    row = spark.read.json(str(tmp_path / "q")).first()
    assert row["reason"] == "latitude" and row["source_data"]["sample_id"] == "S1" and row["source_hash"] == "h1"
    ledger = spark.createDataFrame([("h1",)], "source_hash string")
    assert sinks.skip_processed(rejected, ledger).count() == 0 and sinks.skip_processed(rejected, None).count() == 1


def test_lost_pointer_loses_no_version(spark, tmp_path):
    table = sinks.ParquetTable(spark, str(tmp_path / "t"))
    table.replace(spark.range(5))
    table.replace(spark.range(20))
    assert table.version() == 2
    (tmp_path / "t" / "CURRENT").unlink()  # as after a crash between two steps of a writer
    assert table.version() == 2 and table.read().count() == 20
    table.append(spark.range(3))
    assert table.read().count() == 23
    (tmp_path / "t" / "v=7").mkdir()  # a version that was never finished
    table.replace(spark.range(1))
    assert table.version() == 8 and table.read().count() == 1 and (tmp_path / "t" / "v=2").exists()


def test_same_key_join_keeps_null_keys(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, x int")
    from fieldlake.operators import filters
    got = {r["x"]: r["key_rows"] for r in filters.with_count(rows, ["k"]).collect()}
    assert got == {1: 2, 2: 2, 3: 1}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "997")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\r\n"), (3, "\n")])
def test_one_sequence_file_in_many_tasks(spark, tmp_path, small_splits, seed, end):
    """Qualities that start with the record mark, or are nothing else, at and around the ends of blocks."""
    import random
    r = random.Random(seed)
    want = []
    for n in range(400):
        size = r.choice([1, 2, 30, 100])
        first = "@" if r.random() < 0.6 else "I"
        want.append((f"q{n}", "".join(r.choice("ACGT") for _ in range(size)), first + "".join(r.choice("@+!I") for _ in range(size - 1))))
    body = "".join(f"@{h} sample=S{h}{end}{s}{end}+{r.choice(['', '@x'])}{end}{q}{end}" for h, s, q in want)
    rows = readers.read_sequences(spark, write(tmp_path / "x.fastq", body), "fastq")
    lines = spark.read.option("lineSep", "\n@").text(str(tmp_path / "x.fastq"))
    assert lines.rdd.getNumPartitions() > 20
    got = sorted((x["sample_id"], x["sequence"], round(x["mean_quality"], 9)) for x in rows.collect())
    assert got == sorted((f"S{h}", s, round(sum(map(ord, q)) / len(q) - 33, 9)) for h, s, q in want)
    fasta = "".join(f">{h} sample=S{h}\n{s}\n" for h, s, _ in want)
    rows = readers.read_sequences(spark, write(tmp_path / "x.fasta", fasta))
    assert sorted((x["sample_id"], x["sequence"]) for x in rows.collect()) == sorted((f"S{h}", s) for h, s, _ in want)


@pytest.mark.parametrize("indent", [None, 1])
def test_one_habitat_document_in_many_tasks(spark, tmp_path, small_splits, indent):
    cells = [{"lat": 33.0 + k / 100, "lon": 75.0, "vote": None if k % 5 == 0 else k / 500, "status": "suitable_model_domain", "loss": 0.1} for k in range(500)]
    doc = {"version": 1, "species": "Semnopithecus ajax", "cells": cells, "created_at": "2024-01-01T00:00:00+00:00", "cell_size_m": 1000, "loss_year": 2023,
           "metrics": {"auc": 0.95, "tss": 0.8, "members": [{"auc": 0.92, "tss": 0.71}, {"auc": 0.93, "tss": 0.72}]}}
    got, meta = readers.read_habitat_cells(spark, write(tmp_path / "b.json", json.dumps(doc, indent=indent)))
    assert spark.read.option("lineSep", "{").text(str(tmp_path / "b.json")).rdd.getNumPartitions() > 20
    assert sorted((x["lat"], x["vote"]) for x in got.collect() if x["vote"] is not None) == sorted((c["lat"], c["vote"]) for c in cells if c["vote"] is not None)
    assert got.count() == 500
    row = meta.first().asDict(recursive=True)
    assert meta.count() == 1 and row == {k: v for k, v in doc.items() if k != "cells"}
    doc["cells"] = []
    got, meta = readers.read_habitat_cells(spark, write(tmp_path / "c.json", json.dumps(doc, indent=indent)))
    assert got.count() == 0 and meta.first()["metrics"]["tss"] == 0.8


def test_payloads_that_cannot_be_read(spark, tmp_path):
    good = {"reading_type": "acoustic", "sensor_id": "m", "timestamp": "2024-01-02T00:00:00Z", "confidence": 0.5}
    lines = [json.dumps(good), "{broken", "[1, 2", "7", "", "   ", "[]", json.dumps([good, 5, None, {"reading_type": "sonar"}, "text"]), json.dumps({**good, "confidence": "high"}),
             json.dumps({**good, "reading_type": None}), '{"reading_type": "acoustic", "confidence": NaN}', "null"]
    rows = readers.messages(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = sorted((x["failure"] or "good", x["raw"][:9]) for x in rows.collect())
    assert got == sorted([("good", '{"reading'), ("not_json", "{broken"), ("not_json", "[1, 2"), ("not_an_object", "7"), ("good", '{"reading'), ("not_an_object", "5"),
                          ("not_an_object", "null"), ("unknown_type", '{"reading'), ("not_json", "text"), ("field_type", '{"reading'), ("unknown_type", '{"reading'),
                          ("not_json", '{"reading'), ("not_an_object", "null")])
    assert readers.parse_ingest(spark.createDataFrame([(x,) for x in lines], "value string")).count() == 2
    lines = ['{"device_id": "d", "fields": {"animal_id": "a"}}', "nope", "3", '{"device_id": "d", "fields": 4}', ""]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert sorted(x["failure"] for x in readers.unreadable(df).collect()) == ["field_type", "not_an_object", "not_json"]
    assert readers.parse_gps(df).count() == 1


def test_infrastructure(spark, tmp_path):
    rows = [{"id": 1, "feature_type": "fence", "feature_name": "f", "geometry_wkt": "LINESTRING(0 0, 1 1)", "detected_at": "2024-01-02T00:00:00Z", "removed_at": None, "source": "s"}]
    got = readers.read_infrastructure(spark, write(tmp_path / "i.json", "\n".join(map(json.dumps, rows)))).first()
    assert got["detected_epoch_ms"] == 1704153600000 and got["removed_epoch_ms"] is None and got["geometry_wkt"].startswith("LINESTRING")
