"""The split path must give what one plain window per key gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldlake.operators import joins, scale, series

SPLIT = {"split": True, "min_rows": 200, "chunks": 8}


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds over a third of the rows, with gaps, ties and bursts in time."""
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.4, "hot", np.array([f"k{i}" for i in rng.integers(0, 25, n)]))
    ts = (np.cumsum(rng.integers(0, 4, n)) * 1000 + (rng.random(n) < 0.02).cumsum() * 900_000).astype("int64")
    pdf = pd.DataFrame({"key": key, "ts": ts, "id": np.arange(n), "x": rng.normal(20, 5, n)})
    return spark.createDataFrame(pdf).cache()


def same(a, b, *columns):
    left = a.select("id", *columns).toPandas().sort_values("id").reset_index(drop=True)
    right = b.select("id", *columns).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(left, right, check_dtype=False, rtol=1e-9)
    return left


def test_a_hot_key_is_split(skewed):
    data, was_split = scale.with_chunk(skewed, ["key"], "ts", **SPLIT)
    chunks = {r["key"]: r["n"] for r in data.groupBy("key").agg(F.countDistinct("__chunk").alias("n")).collect()}
    assert was_split and chunks["hot"] >= 6
    assert all(n == 1 for k, n in chunks.items() if k != "hot")
    order = data.filter("key = 'hot'").groupBy("__chunk").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).orderBy("__chunk").collect()
    assert all(x["b"] < y["a"] for x, y in zip(order, order[1:]))


def test_small_inputs_are_not_split(skewed):
    assert scale.with_chunk(skewed, ["key"], "ts")[1] is False


def test_frames(skewed):
    split = series.rolling_mean(skewed, ["key"], "x", order=("ts", "id"), **SPLIT)
    same(split, series.rolling_mean(skewed, ["key"], "x", order=("ts", "id")), "x_rolling")
    split = series.hampel(skewed, ["key"], "x", order=("ts", "id"), **SPLIT)
    same(split, series.hampel(skewed, ["key"], "x", order=("ts", "id")), "x_hampel")


def test_row_numbers(skewed):
    args = (["key"], ["ts", "id"], "ts")
    same(scale.row_numbers(skewed, *args, **SPLIT), scale.row_numbers(skewed, *args), "rn")


@pytest.mark.parametrize("current", [True, False])
def test_running(skewed, current):
    totals = {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "c": ("count", F.col("x")), "l": ("min", F.col("x"))}
    a = scale.running(skewed, ["key"], ["ts", "id"], totals, current, **SPLIT)
    b = scale.running(skewed, ["key"], ["ts", "id"], totals, current)
    b = b.withColumn("c", F.col("c"))
    left = a.fillna(0).toPandas().sort_values("id").reset_index(drop=True)
    right = b.fillna(0).toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(left[right.columns], right, check_dtype=False, rtol=1e-9)


def test_moments(skewed):
    a = scale.moments_before(skewed, ["key"], ["ts", "id"], "x", **SPLIT)
    b = scale.moments_before(skewed, ["key"], ["ts", "id"], "x")
    same(a, b, "prior_n", "prior_mean", "prior_std")


def test_ema(skewed):
    a = series.ema(skewed, ["key"], "x", 0.1, order=("ts", "id"), **SPLIT)
    got = same(a, series.ema(skewed, ["key"], "x", 0.1, order=("ts", "id")), "x_ema")
    pdf = skewed.toPandas().sort_values(["key", "ts", "id"])
    want, last = {}, {}
    for row in pdf.itertuples():
        last[row.key] = row.x if row.key not in last else 0.1 * row.x + 0.9 * last[row.key]
        want[row.id] = last[row.key]
    assert np.allclose(got["x_ema"], [want[i] for i in got["id"]])


def test_cooldown(skewed):
    a = series.cooldown(skewed, ["key"], "ts", "id", 20_000, **SPLIT)
    got = same(a, series.cooldown(skewed, ["key"], "ts", "id", 20_000), "accepted")
    want, last = {}, {}
    for row in skewed.toPandas().sort_values(["key", "ts", "id"]).itertuples():
        want[row.id] = row.key not in last or row.ts - last[row.key] >= 20_000
        if want[row.id]:
            last[row.key] = row.ts
    assert got["accepted"].tolist() == [want[i] for i in got["id"]]
    # every burst dense: the recurrence crosses all chunk borders
    dense = skewed.withColumn("ts", F.col("id") * 1000)
    same(series.cooldown(dense, ["key"], "ts", "id", 7_500, **SPLIT),
         series.cooldown(dense, ["key"], "ts", "id", 7_500), "accepted")


def test_islands_and_suppression(skewed):
    rows = skewed.withColumn("end", F.col("ts") + 3000)
    a = series.islands(rows, ["key"], "ts", "end", 4000, "id", **SPLIT)
    same(a, series.islands(rows, ["key"], "ts", "end", 4000, "id"), "island_start")
    alerts = skewed.selectExpr("id", "id as event_id", "ts as ts_ms", "'t' as event_type", "key as classification",
                               "cast(null as string) as zone", "if(id % 9 = 0, 'CRITICAL', 'HIGH') as priority")
    same(series.suppress_alerts(alerts, window_ms=5000, **SPLIT), series.suppress_alerts(alerts, window_ms=5000), "priority")


def test_top_n_and_spread_join(skewed, spark):
    order = [F.desc("x"), F.asc("id")]
    same(scale.top_n(skewed, ["key"], order, 5), skewed.withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter("rn <= 5"), "rn")
    right = skewed.select("key").distinct().withColumn("label", F.upper("key"))
    same(scale.spread_join(skewed, right, ["key"]), skewed.join(right, ["key"]), "label")


def test_trace_pages_hold_every_id(spark):
    df = spark.range(1, 12_346).withColumn("k", (F.col("id") % 500 == 0).cast("int"))
    df = df.unionAll(df).unionAll(df.limit(1).withColumn("id", F.lit(0).cast("long")))
    pages = joins.trace_pages(df, ["k"], page=1000).orderBy("k", "page").collect()
    assert [len(p["record_ids"]) for p in pages] == [1000] * 12 + [321, 24]
    for k in (0, 1):
        assert [i for p in pages if p["k"] == k for i in p["record_ids"]] == [i for i in range(1, 12_346) if (i % 500 == 0) == k]
