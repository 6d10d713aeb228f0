"""Work that must not grow faster than the input: batches of a stream, candidate pairs, shuffles and repeated passes."""

import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from fieldlake.functions import geo
from fieldlake.operators import genetics, media, scale, spatial
from fieldlake.registry import core, q_streaming
from fieldlake.streaming import late


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_arrival_is_one_batch_however_many_files_it_has(spark, sf):
    log, checkpoint = q_streaming._received(spark, sf, "test-arrivals", lambda stream: late.bucket_log(stream, keep_ms=86_400_000, keys=["device_id"]))
    assert len(spark.read.parquet(f"{checkpoint.removesuffix('/cp')}/in").inputFiles()) > 10
    assert log.agg(F.max("batch")).first()[0] < 10  # five arrivals, each with a batch for the watermark that it has moved
    kinds = {r["kind"] for r in log.select("kind").distinct().collect()}
    assert kinds == {"closed", "corrected", "late"}


def test_closed_intervals_equal_the_table_of_intervals():
    rng = np.random.default_rng(3)
    rows = [(int(s), int(s + 10), None if i % 5 == 0 else float(i % 9), 1) for i, s in enumerate(rng.integers(0, 4000, 200))]
    got = late._merged(rows, 7)
    want = late.joined(late.pd.DataFrame(rows, columns=late.INTERVAL), [], 7)
    assert [r[:2] + r[3:] for r in got] == want[["start_ms", "end_ms", "window_count"]].astype(int).values.tolist()
    assert [-1.0 if r[2] is None else r[2] for r in got] == want["confidence"].astype(float).fillna(-1.0).tolist()


def joined_rows(monkeypatch, seen):
    def spread(left, right, on, how="inner"):
        out = left.join(right, list(on), how)
        seen.append(out.count())
        return out
    monkeypatch.setattr(scale, "spread_join", spread)


def test_few_candidates_of_a_circle_lie_outside(spark, monkeypatch):
    points = spark.range(4000).selectExpr("id", "(id % 63) * 0.03 - 1 as latitude", "(id div 63) * 0.03 + 34 as longitude", "id as at")
    centres = points.filter("id % 40 = 0").selectExpr("id as c", "latitude as centre_lat", "longitude as centre_lon", "0L as start_ms", "1999L as end_ms", "12000D as r")
    for radius in (12_000, "r"):
        seen = []
        joined_rows(monkeypatch, seen)
        found = spatial.radius_join(points, centres, radius, time="at").count()
        assert found and seen[0] <= 4 * found  # the window is applied before the join


def test_a_tile_of_many_pairs_is_cut(spark, monkeypatch):
    monkeypatch.setattr(spatial, "PAIRS_PER_TASK", 2000)
    points = spark.range(900).selectExpr("if(id < 800, id, id - 100) as id", "if(id % 3 = 0, 0D, 0.001D) as latitude", "34D as longitude", "if(id % 9 = 0, null, id % 2) as s", "map('a', id) as m")
    centres = spark.range(40).selectExpr("id as c", "0D as centre_lat", "34D + id % 5 * 1e-4 as centre_lon", "if(id % 8 = 0, null, id % 2) as s", "if(id % 4 = 0, 5000D, 90D) as r")
    for on in ((), ("s",)):
        for radius in (5000, 90, "r"):
            plain, cut = (spatial.radius_join(points, centres, radius, on=on, many=many).drop("m") for many in (False, True))
            assert cut.columns == plain.columns and cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()
    dealt, tiles = spatial._dealt(points.withColumn("t", F.lit(1)), centres.withColumn("t", F.lit(1)), ["t"])
    cuts = {r["__cut"]: r["count"] for r in dealt.groupBy("__cut").count().collect()}
    assert sum(cuts.values()) == 900 and len(cuts) == 18 and max(cuts.values()) * 40 < 6000
    assert {r["count"] for r in tiles.groupBy("__cut").count().collect()} == {40}


def test_pairs_and_distances_are_those_of_the_haversine(spark):
    step = math.degrees(1000 / 6371008.8)
    places = [(x, y) for x in (0.0, step, -step, 45.0, 89.9999, -90.0, 95.0, math.nan, None) for y in (0.0, step, 179.9999, -179.9999, 180.0, math.nan, None)]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id int, latitude double, longitude double")
    radii = [0.0, 0.5, 1000.0, math.nextafter(1000, 0), 1e6, 19.9e6, 20.1e6, None]
    centres = spark.createDataFrame([(i * 100 + j, *p, r) for i, p in enumerate(places) for j, r in enumerate(radii) if None not in p and abs(p[0]) <= 90 and not math.isnan(p[1])], "c int, centre_lat double, centre_lon double, r double")
    metres = geo.haversine_m("latitude", "longitude", "centre_lat", "centre_lon")
    every = points.crossJoin(centres).withColumn("distance_m", metres)
    got = {(r["id"], r["c"]): r["distance_m"] for r in spatial.radius_join(points, centres, "r").select("id", "c", "distance_m").collect()}
    want = {(r["id"], r["c"]): r["distance_m"] for r in every.filter("distance_m <= r").collect()}
    assert got.items() <= want.items() and len(got) > 500
    ordinary = {i for i, (y, x) in enumerate(places) if y is not None and x is not None and abs(y) <= 90 and not math.isnan(x)}
    assert {k for k in want if k[0] in ordinary} <= got.keys()
    text = plan(spatial.radius_join(points, centres, 1000, many=True))
    assert "SortMergeJoin" in text and text.count("ASIN") == 2  # of a pair at the rim, and once of a pair that is kept


def test_rounded_is_round(spark):
    rng = np.random.default_rng(5)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -1e-9, 1.0005, 2.5e-4, 0.125, 1e8 + 0.0625, 12000.0005, 123456789012.3456, 1e22, -1e300, 4.35, 1.005, 0.0005, -0.0005]
    values += [float(x) for x in rng.uniform(-2e4, 2e4, 3000)] + [float(x) for x in (rng.integers(-10 ** 7, 10 ** 7, 3000) * 5) / 10 ** 4]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v double, w int")
    for digits in (0, 2, 3, 6):
        shown = core.rounded(df.selectExpr("v", "v as old", "w", "cast(v as float) as f", "cast(v as float) as g"), "v", "w", "f", digits=digits)
        same = F.col("v").eqNullSafe(F.round("old", digits)) & (F.hex(F.col("v").cast("string").cast("binary")).eqNullSafe(F.hex(F.round("old", digits).cast("string").cast("binary"))))
        assert shown.filter(~same | ~F.col("f").eqNullSafe(F.round("g", digits))).isEmpty()
        assert dict(shown.dtypes)["w"] == "int" and dict(shown.dtypes)["f"] == "float"
    assert "rint" in plan(core.rounded(df, "v"))


def test_cells_of_one_place_make_no_pairs(spark, monkeypatch):
    points = spark.range(300).selectExpr("id as scope_id", "(id % 20) * 0.01 as latitude", "34 + (id div 20) * 0.01 as longitude")
    cells = spark.range(5000).selectExpr("(id % 20) * 0.01 + 0.001 as lat", "34 + (id div 20 % 15) * 0.01 as lon", "id / 5000 as loss", "0.5D as vote")
    seen = []
    joined_rows(monkeypatch, seen)
    got = spatial.nearest_cell(points, cells)
    assert seen == [300]
    assert got.count() == 300 and got.filter("scaled_distance > 0.2 or loss < 0.9").isEmpty()


def test_a_genotype_call_is_shuffled_once(spark):
    calls = spark.range(400).selectExpr("concat('s', id % 50) as sample_id", "'p' as project_id", "'x' as target_species", "concat('c', id % 3) as h3_cell", "'2024' as time_bin",
                                        "concat('l', id % 4) as locus_name", "2 as allele_count", "concat('A/', id % 3) as allele_state")
    text = plan(genetics.sample_alleles(calls, (*genetics.POPULATION, "time_bin")))
    assert text.count("hashpartitioning") == 1


def test_small_frames_are_folded_without_windows(spark):
    boxes = spark.range(400).selectExpr("id div 4 as frame", "0 as class_id", "id as box_id", "id % 4 / 4.0D as confidence", "(id % 2) * 100D as box_left", "0D as box_top",
                                        "(id % 2) * 100D + 50 as box_right", "50D as box_bottom")
    kept = media.nms(boxes)
    assert "Window" not in plan(kept)
    assert kept.count() == 200 and kept.filter("box_id % 4 < 2").isEmpty()


def test_herds_of_few_and_of_many_squares(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(f, "a", float(x), float(y)) for f in range(40) for x, y in rng.uniform(0, 1500, (int(rng.integers(1, 12)), 2))]
    df = spark.createDataFrame(rows, "frame int, species string, cx double, cy double")
    want = {f: any(math.hypot(a[2] - b[2], a[3] - b[3]) <= 100 for a, b in itertools.combinations([r for r in rows if r[0] == f], 2)) for f in range(40)}
    for few in (0, 3, 32):
        monkeypatch.setattr(spatial, "FEW_SQUARES", few)
        assert {r["frame"]: r["is_herd"] for r in spatial.herd_flags(df).collect()} == want
    assert len(set(want.values())) == 2
