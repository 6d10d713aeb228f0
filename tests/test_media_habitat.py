import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from fieldlake.config import AcousticConfig, VisionConfig
from fieldlake.operators import habitat, media


def test_boxes_and_suppression(spark):
    cfg = VisionConfig(classes=("elephant", "poacher"), threats=("Poacher",))
    raw = [(1, 0, [100, 100, 40, 40, 0.9, 0.1]), (1, 1, [102, 101, 40, 40, 0.8, 0.1]), (1, 2, [300, 100, 40, 40, 0.2, 0.7]), (1, 3, [100, 100, 40, 40, 0.1, 0.6]),
           (1, 4, [100, 100, 0, 40, 0.9, 0.1]), (1, 5, [-90, 0, 40, 40, 0.9, 0.1]), (1, 6, [160, 100, 40, 40, 0.5, 0.1]), (1, 7, [100, 100, 40, 40, 0.44, 0.1])]
    df = spark.createDataFrame([(f, i, [float(v) for v in p], 640, 480, 0.5, 10.0, 20.0) for f, i, p in raw],
                               "frame int, box_id int, prediction array<double>, frame_width int, frame_height int, resize_scale double, pad_x double, pad_y double")
    boxes = media.decode_boxes(df, cfg)
    got = {r["box_id"]: r for r in boxes.collect()}
    assert sorted(got) == [0, 1, 2, 3, 6]
    assert (got[0]["box_left"], got[0]["box_top"], got[0]["box_right"], got[0]["box_bottom"]) == (140.0, 120.0, 220.0, 200.0)
    assert got[2]["species"] == "poacher" and got[2]["confidence"] == 0.7
    kept = media.nms(boxes)
    assert sorted(r["box_id"] for r in kept.collect()) == [0, 2, 3, 6]
    row = media.frame_summary(kept, cfg=cfg).first()
    assert row["total_count"] == 4 and row["species_counts"] == {"elephant": 2, "poacher": 2} and row["threat_detected"] is True
    assert row["herd_behavior"] == {"elephant": False, "poacher": False}
    assert row["herd_density"] == pytest.approx(4 * 80 * 80 / (640 * 480))
    frames = media.frame_summary(kept, cfg=cfg).withColumn("video", F.lit("v"))
    assert media.video_summary(frames).first()["species_counts"] == {"elephant": 2, "poacher": 2}


def test_suppression_against_definition(spark):
    rng = np.random.default_rng(5)
    rows = []
    for f in range(3):
        for i in range(60):
            x, y = rng.uniform(0, 300, 2)
            rows.append((f, int(rng.integers(0, 2)), f * 100 + i, *map(float, (rng.random(), x, y, x + rng.uniform(20, 90), y + rng.uniform(20, 90)))))
    df = spark.createDataFrame(rows, "frame int, class_id int, box_id int, confidence double, box_left double, box_top double, box_right double, box_bottom double")

    def iou(a, b):
        w, h = max(0, min(a[6], b[6]) - max(a[4], b[4])), max(0, min(a[7], b[7]) - max(a[5], b[5]))
        both = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - w * h
        return w * h / both
    want = set()
    for f in range(3):
        for c in range(2):
            left = sorted((r for r in rows if r[0] == f and r[1] == c), key=lambda r: -r[3])
            while left:
                top = left.pop(0)
                want.add(top[2])
                left = [r for r in left if iou(top, r) <= 0.5]
    assert {r["box_id"] for r in media.nms(df).collect()} == want
    assert {r["box_id"] for r in media.nms(df, small=5).collect()} == want
    assert {r["box_id"] for r in media.nms(df, split=True, min_rows=20, chunks=4).collect()} == want


def test_frames_and_scores(spark):
    df = spark.range(1000).selectExpr("'v' as video", "id as frame_index", "2.4D as fps")
    out = media.sample_frames(df, cfg=VisionConfig(max_frames=50)).collect()
    assert len(out) == 50 and sorted(r["frame_index"] for r in out)[:3] == [0, 2, 4] and max(r["frame_index"] for r in out) == 98
    cfg = AcousticConfig(threats=("Gunshot",), wildlife=("elephant", "bird"), class_thresholds={"bird": 0.2})
    classes = spark.createDataFrame([(0, "gunshot"), (1, "elephant"), (2, "bird"), (3, "wind")], "class_id int, class_name string")
    df = spark.createDataFrame([(1, [0.45, 0.6, 0.25, 0.9]), (2, [3.0, -4.0, 0.0, 9.0])], "window_id int, scores array<double>")
    got = {(r["window_id"], r["class_name"]): r["confidence"] for r in media.scores_to_detections(df, classes, cfg).collect()}
    assert set(got) == {(1, "gunshot"), (1, "bird"), (2, "gunshot"), (2, "bird")} and got[(2, "gunshot")] == pytest.approx(1 / (1 + math.exp(-3)))


def test_audio(spark):
    df = spark.createDataFrame([("a", list(range(12)), 1000, 2), ("b", [1, 2, 3], 0, 1)], "source_id string, samples array<int>, origin_ms long, channels int")
    got = media.slice_windows(df, 5, 3, 10).collect()
    assert [(r["source_id"], r["start_sample"], r["window_ms"], r["samples"]) for r in got] == [("a", 0, 1000, [0, 1, 2, 3, 4]), ("a", 3, 1300, [3, 4, 5, 6, 7]), ("a", 6, 1600, [6, 7, 8, 9, 10])]
    mono = {r["source_id"]: r["mono"] for r in media.to_mono(df.withColumn("bits", F.lit(5)), bits="bits").collect()}
    assert mono["a"] == [pytest.approx((2 * i + 0.5) / 16) for i in range(6)] and mono["b"] == [1 / 16, 2 / 16, 3 / 16]
    cfg = AcousticConfig(rate=8000, n_fft=256, hop=64, mel_bands=20)
    tone = np.sin(2 * np.pi * 1000 * np.arange(1024) / 8000)
    spec = np.array(media.log_mel(spark.createDataFrame([("t", tone.tolist())], "source_id string, samples array<double>"), cfg).first()["spectrogram"])
    assert spec.shape == (20, 13)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 256)
    power = np.abs(np.fft.rfft(tone[64:320] * window)) ** 2 / window.sum() ** 2
    want = 10 * np.log10(np.maximum(media.mel_bank(8000, 256, 20) @ power.astype("float32"), np.finfo("float32").eps))
    assert np.allclose(spec[:, 1], want, atol=1e-3) and spec[:, 1].argmax() == want.argmax()


def test_suitability_classes(spark):
    df = spark.createDataFrame([(0.24999,), (0.25,), (0.5,), (0.75,), (None,)], "vote double")
    assert [r[0] for r in df.select(habitat.suitability_class("vote")).collect()] == ["Very Low", "Low", "Moderate", "High", None]


def test_radial_margin(spark):
    """The features' inner products are the kernel, and the margin separates what no line can."""
    rng = np.random.default_rng(1)
    points = rng.normal(0, 1, (40, 3))
    df = spark.createDataFrame([(Vectors.dense(p),) for p in points], ["features"])
    z = np.array([r["radial"].toArray() for r in habitat.FourierFeatures(3, 0.4, 4000).transform(df).collect()])
    want = np.exp(-0.4 * ((points[:, None] - points[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - want).max() < 0.1
    xy = rng.uniform(-2, 2, (600, 2))
    ring = spark.createDataFrame([(Vectors.dense(p), int((p ** 2).sum() < 1.5)) for p in xy], ["features", "label"]).cache()
    scored = habitat.estimate(habitat.RadialMargin().fit(ring), ring)
    assert habitat.evaluate(scored)["auc"] > 0.97 and scored.columns == ["label", "estimate"]


def test_committee(spark):
    """The reference grid: forest bands every ten columns, presences on them."""
    cells = spark.range(3600).selectExpr("cast(id div 60 as bigint) as row", "id % 60 as col", "true as valid")
    grid = cells.withColumn("forest_fraction", F.when(F.col("col") % 10 <= 3, 1.0).otherwise(0.0)).withColumn("elevation", 2000.0 + 2 * F.col("row") + F.col("col"))
    grid = grid.withColumn("ndvi", 10 * F.col("forest_fraction") + (F.col("row") + F.col("col")) / 1000).withColumn("bio1", F.col("ndvi") + 0.5)
    presences = grid.filter("row % 5 = 2 and col % 10 = 2").selectExpr("col * 1000 + 500D as x", "row * 1000 + 500D as y")
    here = habitat.presence_cells(presences, grid)
    assert here.count() == 72
    there = habitat.pseudo_absences(grid, here)
    assert there.filter("forest_fraction > 0").isEmpty()
    predictors = ["forest_fraction", "ndvi", "bio1"]
    labelled = grid.join(here.withColumn("label", F.lit(1)), ["row", "col"]).unionByName(there.withColumn("label", F.lit(0)).select(*grid.columns, "label"))
    split = habitat.spatial_split(labelled).cache()
    members = habitat.fit_committee(split.filter("not is_test"), predictors, repeats=1)
    assert {m.name for m in members} == {"radial_svm", "random_forest", "logistic"} and all(m.auc >= 0.9 and m.tss >= 0.7 for m in members)
    assert habitat.gate(split.filter("is_test"), members)["auc"] >= 0.9
    mapped = habitat.mask_extrapolation(habitat.committee_vote(grid.withColumn("ndvi", F.when(F.col("row") == 0, 99.0).otherwise(F.col("ndvi"))), members), split.filter("not is_test"), predictors)
    got = {(r["status"], r["suitability"]) for r in mapped.filter("row between 5 and 50").select("status", "suitability").distinct().collect()}
    assert ("suitable_model_domain", "High") in got and ("suitable_model_domain", "Very Low") in got
    assert mapped.filter("row = 0").select("status").distinct().first()[0] == "extrapolation"
    with pytest.raises(ValueError):
        habitat.spatial_split(labelled.filter("row < 10"))
