"""Stored assessments, map documents, boxes of cells, dispatch ids and merged lineages on small tables."""

import json

from pyspark.sql import functions as F

from fieldlake.operators import joins, topk
from fieldlake.sources import indexed, sinks


def test_assessments_are_stored_once_per_scope(spark, tmp_path):
    columns = ", ".join(f"{n} double" for n in (*sinks.SCORES, "conservation_risk_index", "inbreeding_penalty_index", "intervention_priority_index", "risk_momentum_per_day",
                                                "momentum_window_days", "effective_population_size"))
    schema = f"scope_id long, species_id long, h3_cell string, period_start timestamp, period_end timestamp, {columns}, population_trend string, critical_inbreeding_risk boolean, " \
             "escalation_level int, intervention_priority_tier string, narrative_report string, dominant_domain string"
    import datetime as dt
    day = dt.datetime(2024, 1, 1)
    row = lambda cell, cri: (1, 5, cell, day, day + dt.timedelta(30), *[10.0] * 6, cri, 1.0, 2.0, 0.1, 30.0, None, "STABLE", False, 2, "LOW", "text", "threat")
    plain, table = sinks.ParquetTable(spark, str(tmp_path / "p")), indexed.IndexedTable(spark, str(tmp_path / "i"), ["species_id", "h3_cell", "period_start", "period_end"])
    for target in (plain, table):
        sinks.write_assessments(spark.createDataFrame([row("a", 40.0), row("b", 50.0)], schema), target, "run-1")
        sinks.write_assessments(spark.createDataFrame([row("b", 60.0)], schema), target, "run-2")
        got = {r["h3_cell"]: r for r in target.read().collect()}
        assert {c: r["conservation_risk_index"] for c, r in got.items()} == {"a": 40.0, "b": 60.0} and "scope_id" not in target.read().columns
        summary = json.loads(got["b"]["input_summary"])
        assert summary["run_id"] == "run-2" and summary["dominant_domain"] == "threat" and json.loads(got["a"]["input_summary"])["run_id"] == "run-1"


def test_map_document(spark):
    clusters = spark.createDataFrame([(0, 5, 1.0, 34.5, -2.0, 34.4, 34.6, -2.1, -1.9, 2, 3.0, 4), (1, 1, 0.2, 0.05, -1.0, 0.05, 0.05, -1.0, -1.0, 0, None, 0)],
                                     "cluster_id long, point_count long, weight double, lon_offset double, latitude double, min_lon_offset double, max_lon_offset double, min_latitude double, "
                                     "max_latitude double, threat_count long, metric_sum double, metric_count long")
    doc = json.loads(sinks.to_geojson(clusters, 0.0, threats=True).first()["geojson"])
    assert doc["type"] == "FeatureCollection" and [f["properties"]["cluster_id"] for f in doc["features"]] == [0, 1]
    first, second = doc["features"]
    assert first["geometry"] == {"type": "Point", "coordinates": [34.5, -2.0]} and first["properties"]["bbox"] == [34.4, -2.1, 34.6, -1.9]
    assert first["properties"]["cluster"] is True and first["properties"]["metric_avg"] == 0.75 and first["properties"]["threat_count"] == 2
    assert second["properties"]["cluster"] is False and second["properties"].get("metric_avg") is None
    assert json.loads(sinks.to_geojson(clusters.limit(0), 0.0).first()["geojson"])["features"] == []


def test_cells_in_bounds(spark):
    cells = spark.range(100).selectExpr("id / 10.0D as lat", "id % 7 / 10.0D as lon", "if(id % 5 = 0, null, id / 100.0D) as vote")
    day = 86_400_000
    page, state = topk.cells_in_bounds(cells, (1.0, 2.0, 0.0, 0.3), 4, created_ms=0, now_ms=731 * day)
    rows = [(r["lat"], r["lon"]) for r in page.collect()]
    assert rows == sorted(rows) and len(rows) == 4 and all(1.0 <= a <= 2.0 and b <= 0.3 for a, b in rows) and state == {"status": "stale", "truncated": True}
    page, state = topk.cells_in_bounds(cells, None, 200, created_ms=0, now_ms=day)
    assert page.count() == 100 and state == {"status": "ready", "truncated": False}
    assert {r["suitability"] for r in page.collect()} == {None, "Very Low", "Low", "Moderate", "High"}


def test_dispatch_ids(spark):
    """Every detection at a chosen place is named, also those that came later; other places and unlocated ones are not."""
    rows = [(1, "gunshot", 10, 1.00001, 2.0, 100), (1, "elephant", 30, 1.00002, 2.0, 101), (1, "chainsaw", 20, 3.0, 4.0, 102), (1, "gunshot", 5, None, 2.0, 103), (1, "vehicle", 1, 5.0, 6.0, 104),
            (2, "gunshot", 10, 1.0, 2.0, 100), (2, "gunshot", 11, 1.0, 2.0, None)]
    events = spark.createDataFrame(rows, "scope_id long, class_name string, detected_epoch_ms long, latitude double, longitude double, record_id long")
    targets = topk.dispatch_targets(events, ["scope_id"], 2)
    got = sorted(tuple(r) for r in topk.dispatch_ids(events, targets).collect())
    chosen = {(r["scope_id"], r["target"]): (r["lat4"], r["lon4"]) for r in targets.collect()}
    want = sorted((s, t, i) for (s, t), place in chosen.items() for scope, _, _, la, lo, i in rows if scope == s and la is not None and i is not None and (round(la, 4), lo) == place)
    assert got == want and (1, 1, 100) in got and (1, 1, 101) in got and all(i != 103 for *_, i in got)


def test_lineages_are_merged(spark):
    one = spark.createDataFrame([(1, [1, 3]), (2, [5])], "scope_id long, record_ids array<long>")
    two = spark.createDataFrame([(1, [2, 3]), (3, [9])], "scope_id long, record_ids array<long>")
    got = {r["scope_id"]: sorted(r["record_ids"]) for r in joins.merge_lineage(one, two).collect()}
    assert got == {1: [1, 2, 3], 2: [5], 3: [9]}
    pages = one.select("scope_id", F.lit("t").alias("table_name"), F.lit(0).alias("page"), "record_ids")
    rows = spark.createDataFrame([(1, "a"), (3, "b"), (4, "c")], "id long, v string")
    assert sorted((r["scope_id"], r["v"]) for r in joins.hydrate_pages(pages, {"t": rows})["t"].collect()) == [(1, "a"), (1, "b")]
