"""Pages, rankings and bounded selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import DAY_MS, RISK, RiskConfig
from fieldlake.functions import text
from fieldlake.operators import scale


def keyset_page(df: DataFrame, time: str, cursor: tuple[int, int] | None = None, n: int = 200, tie: str = "id") -> DataFrame:
    """Newest rows first after a (time, id) cursor; one row more than the page says whether more follow.

    The time bound is a plain predicate for the scan; the pair comparison settles equal times.
    """
    if cursor is not None:
        ms, last = cursor
        df = df.filter((F.col(time) <= ms) & ((F.col(time) < ms) | (F.col(tie) < last)))
    return df.orderBy(F.desc(time), F.desc(tie)).limit(n + 1)


def offset_page(df: DataFrame, order, limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """(page, one-row total)."""
    return df.orderBy(*order).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total"))


def top_zones(df: DataFrame, n: int, activity: str = "activity", zone: str = "zone_id") -> DataFrame:
    return df.orderBy(F.desc(activity), F.asc(zone)).limit(n)


def rank_clusters(clusters: DataFrame, count: str = "point_count", ties=("cell_y", "cell_x")) -> DataFrame:
    """Clusters by size with an id and a weight relative to the largest. A map has at most 65 536 of them."""
    best = clusters.agg(F.max(count)).scalar()
    tied = [t for t in ties if t in clusters.columns]
    ranked = scale.row_numbers(clusters.withColumn("__all", F.lit(0)).withColumn("__neg", -F.col(count)), ["__all"],
                               ["__neg", *tied], "__neg", "cluster_id")
    return (ranked.withColumn("cluster_id", (F.col("cluster_id") - 1).cast("bigint"))
            .withColumn("weight", F.col(count) / best).drop("__all", "__neg"))


def rank_by_risk(df: DataFrame, column: str = "conservation_risk_index") -> DataFrame:
    return df.orderBy(F.desc(column))


def _located(events: DataFrame, cfg: RiskConfig) -> DataFrame:
    return (events.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
            .withColumn("lat4", F.round("latitude", 4)).withColumn("lon4", F.round("longitude", 4))
            .withColumn("weight", text.threat_weight("class_name", cfg)))


def dispatch_targets(events: DataFrame, keys, n: int, time: str = "detected_epoch_ms",
                     cfg: RiskConfig = RISK) -> DataFrame:
    """Up to ``n`` places per scope by severity, then recency; every event at a chosen place joins it."""
    rows = _located(events, cfg)
    place = [*keys, "lat4", "lon4"]
    classes = rows.groupBy(*place, "class_name", "weight").agg(F.max(time).alias("t"), F.count(F.lit(1)).alias("c"),
                                                               F.max_by(F.struct("latitude", "longitude"), time).alias("at"))
    places = classes.groupBy(*place).agg(
        F.max(F.struct("weight", "t")).alias("best"), F.max_by("at", F.struct("weight", "t")).alias("at"), F.sum("c").alias("events"),
        F.reverse(F.array_sort(F.collect_list(F.struct("weight", "t", "class_name")))).alias("names"))
    chosen = scale.top_n(places, list(keys), [F.desc("best"), F.asc("lat4"), F.asc("lon4")], n)
    return chosen.select(*keys, F.col("rn").alias("target"), "at.latitude", "at.longitude", "lat4", "lon4", "events",
                         F.transform("names", lambda x: x["class_name"]).alias("class_names"))


def dispatch_ids(events: DataFrame, targets: DataFrame, keys=("scope_id",), record: str = "record_id", cfg: RiskConfig = RISK) -> DataFrame:
    """Detections behind each target, one row each: a place can hold any number."""
    rows = _located(events, cfg).filter(F.col(record).isNotNull())
    return rows.join(targets.select(*keys, "target", "lat4", "lon4"), [*keys, "lat4", "lon4"]).select(*keys, "target", record).distinct()


def claimable(df: DataFrame, now_ms: int, n: int, lease_sec: int = 600, order=("window_ms", "id")) -> DataFrame:
    """Oldest queued items, and running ones whose lease ran out."""
    expired = F.col("started_ms").isNull() | (F.col("started_ms") <= now_ms - lease_sec * 1000)
    free = F.col("status").isin("PENDING", "STORED_PENDING") | ((F.col("status") == "RUNNING") & expired)
    return df.filter(free).orderBy(*order).limit(n)


def cells_in_bounds(cells: DataFrame, bounds: tuple | None, n: int, created_ms: int | None = None,
                    now_ms: int | None = None) -> tuple[DataFrame, dict]:
    """First ``n`` cells of a box by position, with what the map needs to say about them."""
    from fieldlake.operators.habitat import suitability_class

    if bounds is not None:
        south, north, west, east = bounds
        cells = cells.filter(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    page = cells.orderBy("lat", "lon").limit(n).withColumn("suitability", suitability_class("vote"))
    stale = created_ms is not None and now_ms is not None and (now_ms - created_ms) // DAY_MS > 730
    more = len(cells.limit(n + 1).select(F.lit(1)).take(n + 1)) > n
    return page, {"status": "stale" if stale else "ready", "truncated": more}
