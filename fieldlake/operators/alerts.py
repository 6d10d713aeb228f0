"""Alert records and their routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldlake.config import ALERTS, AlertConfig
from fieldlake.functions.h3grid import cell_ancestors
from fieldlake.operators import scale

EVERY_ZONE, EVERYONE = "*", "**"


def rank(priority, cfg: AlertConfig = ALERTS) -> Column:
    return F.array_position(F.array(*[F.lit(p) for p in cfg.priorities]), F.upper(F.trim(F.col(priority))))


def priority_of(cri, cfg: AlertConfig = ALERTS) -> Column:
    value = F.col(cri) if isinstance(cri, str) else cri
    top = cfg.priorities
    return (F.when(value >= cfg.critical_cri, top[-1]).when(value >= cfg.high_cri, top[-2])
            .when(value >= cfg.elevated_cri, top[-3]).otherwise(cfg.default_priority))


def threat_alerts(df: DataFrame, reading: str = "reading_type", time: str = "detected_epoch_ms", cfg: AlertConfig = ALERTS) -> DataFrame:
    """Readings that took the alert path, at the top of the ladder."""
    return df.select(F.col("id").cast("string").alias("event_id"), F.col(time).alias("ts_ms"), F.lit(cfg.priorities[-1]).alias("priority"),
                     F.concat(F.coalesce(F.col(reading), F.lit("sensor")), F.lit("_anomaly")).alias("event_type"),
                     F.coalesce("class_name", "category", reading, F.lit("threat_detected")).alias("classification"),
                     F.lit(None).cast("double").alias("cri_score"), F.col("confidence").cast("double").alias("confidence"),
                     "latitude", "longitude", F.col("zone"))


def assessment_alerts(df: DataFrame, time: str = "period_end_epoch_ms", cfg: AlertConfig = ALERTS) -> DataFrame:
    tier = F.col("intervention_priority_tier") if "intervention_priority_tier" in df.columns else F.lit(None).cast("string")

    def place(name):
        return F.col(name).cast("double").alias(name) if name in df.columns else F.lit(None).cast("double").alias(name)
    return df.select(F.col("id").cast("string").alias("event_id"), F.col(time).alias("ts_ms"), priority_of("conservation_risk_index", cfg).alias("priority"),
                     F.lit("risk_assessment").alias("event_type"), F.coalesce(tier, F.lit("conservation_risk")).alias("classification"),
                     F.col("conservation_risk_index").alias("cri_score"), F.lit(None).cast("double").alias("confidence"),
                     place("latitude"), place("longitude"), F.col("h3_cell").alias("zone"))


def subscription_keys(subscriptions: DataFrame, cfg: AlertConfig = ALERTS) -> DataFrame:
    """(client_id, key, floor): one row per zone, ``*`` for clients of every zone, ``**`` for alerts without a zone."""
    floor = F.coalesce(rank("min_priority", cfg), F.lit(1).cast("bigint"))
    zones = subscriptions.select("client_id", F.coalesce("zone", F.lit(EVERY_ZONE)).alias("key"), floor.alias("floor"))
    clients = subscriptions.select("client_id", F.lit(EVERYONE).alias("key"), floor.alias("floor"))
    return zones.unionByName(clients).distinct()


def fan_out(alerts: DataFrame, subscriptions: DataFrame, cfg: AlertConfig = ALERTS) -> DataFrame:
    """(alert, client) pairs: same zone, or a watched ancestor cell, or every zone; at or above the client's floor."""
    keys = F.when(F.col("zone").isNull(), F.array(F.lit(EVERYONE))).otherwise(
        F.array_append(cell_ancestors("zone"), F.lit(EVERY_ZONE)))
    rows = alerts.withColumn("__rank", rank("priority", cfg)).withColumn("key", F.explode(F.array_distinct(keys)))
    pairs = scale.spread_join(rows, subscription_keys(subscriptions, cfg), ["key"])
    return pairs.filter(F.col("__rank") >= F.col("floor")).select(*alerts.columns, "client_id").distinct()


def replay(alerts: DataFrame, subscriptions: DataFrame, n: int, cfg: AlertConfig = ALERTS) -> DataFrame:
    """The last ``n`` alerts, as each subscriber would have received them. Alerts without a zone only
    reach clients of every zone here."""
    last = alerts.orderBy(F.desc("ts_ms"), F.desc("event_id")).limit(n)
    subs = subscription_keys(subscriptions, cfg).filter(F.col("key") != EVERYONE)
    keys = F.array_append(F.coalesce(cell_ancestors("zone"), F.array().cast("array<string>")), F.lit(EVERY_ZONE))
    rows = last.withColumn("__rank", rank("priority", cfg)).withColumn("key", F.explode(F.array_distinct(keys)))
    return (rows.join(subs, "key").filter(F.col("__rank") >= F.col("floor")).select(*alerts.columns, "client_id").distinct()
            .withColumn("replayed", F.lit(True)))
