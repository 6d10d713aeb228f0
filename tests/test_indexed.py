"""Tables with an index of their keys: same rows as plain tables, and only the files of a batch are read and rewritten."""

import random

import pytest
from pyspark.sql import functions as F

from fieldlake.sources import indexed, sinks

SCHEMA = "animal string, at long, v int"


@pytest.fixture
def large(spark, tmp_path):
    """Forty files of 2 500 rows: each has its own days."""
    table = indexed.IndexedTable(spark, str(tmp_path / "t"), ["animal", "at"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for day in range(10):
            rows = spark.range(10_000).select(F.concat(F.lit("a"), F.col("id") % 50).alias("animal"), (F.lit(day * 100_000) + F.col("id")).alias("at"), F.lit(0).alias("v"))
            assert table.append_new(rows.coalesce(2)) == {"received": 10_000, "stored": 10_000, "duplicate": 0}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return table


def batch(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def listed(table):
    return {r["file"]: r["rows"] for r in table.files().collect()}


def test_a_batch_reads_only_its_files(spark, large):
    before = listed(large)
    assert len(before) == 40 and sum(before.values()) == 100_000
    known = batch(spark, [("a7", 300_007, 1), ("a8", 300_008, 1)])
    touched = large.candidates(known)
    assert 1 <= len(touched) <= 4 and {f.split("/")[1] for f in touched} == {p.rsplit("/", 1)[1] for p in large.read(touched).inputFiles()}
    # keys inside the range of a day, but of no animal at that time: the filters keep nearly all files closed
    absent = batch(spark, [("a9", 300_008, 1)])
    assert len(large.candidates(absent)) <= 1
    assert large.candidates(batch(spark, [("zz", 5, 1)])) == [] and large.candidates(batch(spark, [(None, 5, 1)])) == []


def test_no_key_is_missed(spark, large):
    r = random.Random(4)
    ids = [(d, r.randrange(10_000)) for d in range(10) for _ in range(60)]
    known = batch(spark, [(f"a{i % 50}", d * 100_000 + i, 9) for d, i in ids])
    got = large.append_new(known.unionByName(batch(spark, [("new", 1, 1), ("new", 1, 2), ("a3", 4, 1)])), ["v"])
    assert got == {"received": 603, "stored": 2, "duplicate": 601}
    assert large.read().filter("animal = 'new'").first()["v"] == 1


def test_upsert_rewrites_only_touched_files(spark, large):
    before = listed(large)
    gone = large.upsert(batch(spark, [("a7", 300_007, 5), ("a7", 300_007, 6), ("b", 1, 7)]), ["v"])
    after = listed(large)
    assert len(gone) == 1 and set(before) - set(after) == set(gone) and sum(after.values()) == 100_001
    rows = {(x["animal"], x["at"]): x["v"] for x in large.read().filter("v > 0").collect()}
    assert rows == {("a7", 300_007): 6, ("b", 1): 7}


def test_same_rows_as_a_plain_table(spark, tmp_path):
    r = random.Random(1)
    one, two = indexed.IndexedTable(spark, str(tmp_path / "i"), ["k", "t"]), sinks.ParquetTable(spark, str(tmp_path / "p"))
    for step in range(5):
        rows = [(r.choice(["x", "y", None]), r.randrange(8), step * 100 + n) for n in range(20)]
        df = batch(spark, rows, "k string, t int, v int")
        if step % 2:
            sinks.upsert(df, one, ["k", "t"], ["v"])
            sinks.upsert(df, two, ["k", "t"], ["v"])
        else:
            assert sinks.append_new(df, one, ["k", "t"], ["v"], ["k"]) == sinks.append_new(df, two, ["k", "t"], ["v"], ["k"])
        assert sorted(map(str, one.read().select("k", "t", "v").collect())) == sorted(map(str, two.read().select("k", "t", "v").collect()))
    wider = batch(spark, [("x", 1, 7, "new")], "k string, t int, v int, note string")
    one.upsert(wider, ["v"])
    assert one.read().columns == ["k", "t", "v", "note"] and one.read().filter("note = 'new'").count() == 1


def test_a_write_that_died_changes_nothing(spark, large):
    rows = large.read().count()
    large._write(batch(spark, [("late", 1, 1)]))  # files without a listing
    assert large.read().count() == rows and large.append_new(batch(spark, [("late", 1, 1)]))["stored"] == 1


def test_outbox_and_empty_batches(spark, tmp_path):
    box = indexed.IndexedTable(spark, str(tmp_path / "o"), list(sinks.OUTBOX_KEYS))
    metrics = batch(spark, [("p", "s", c, "2024", "CRITICAL_INBREEDING_RISK", 12.0) for c in "abc"],
                    "project_id string, target_species string, h3_cell string, time_bin string, risk_status string, ne double")
    assert sinks.emit_outbox(metrics, box)["stored"] == 3 and sinks.emit_outbox(metrics, box)["stored"] == 0
    sent = []
    assert sinks.publish_outbox(box, lambda df: sent.extend(df.collect())) == 3
    assert sinks.publish_outbox(box, lambda df: sent.extend(df.collect())) == 0 and len(sent) == 3
    assert box.append_new(metrics.limit(0).transform(sinks.outbox_rows)) == {"received": 0, "stored": 0, "duplicate": 0}
    empty = indexed.IndexedTable(spark, str(tmp_path / "e"), ["animal", "at"])
    assert empty.read() is None and empty.append_new(batch(spark, [])) == {"received": 0, "stored": 0, "duplicate": 0}
