"""Writers on plain Parquet: one writer per table, whole new files, then a switch of the current pointer.

Parquet folders have no transactions, so an upsert writes the next version beside the old one
and moves a pointer file afterwards; a job that dies half-way leaves the old version current.
With a table format that supports it, ``upsert`` is a single MERGE. Large targets belong into
``indexed.IndexedTable``, which all writers here take as well and which touches only the files of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlake.operators import scale


class ParquetTable:
    """Versioned Parquet folder: ``<path>/v=<n>/`` and the current version in ``<path>/CURRENT``.

    The pointer is replaced by one overwriting rename, so it exists at every moment. If it is lost all the same, the
    highest version that was written to its end counts. A new version never takes a number that has a folder.
    """

    def __init__(self, spark: SparkSession, path: str, partition: Sequence[str] = ()):
        self.spark, self.path, self.partition = spark, path.rstrip("/"), list(partition)

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = [entry.getPath().getName() for entry in fs.listStatus(self._path())]
        return sorted(int(name[2:]) for name in names if name.startswith("v=") and name[2:].isdigit())

    def version(self) -> int | None:
        fs = self._fs()
        if fs.exists(self._path("CURRENT")):
            return int(self.spark.read.text(f"{self.path}/CURRENT").first()[0])
        whole = [n for n in self._versions() if fs.exists(self._path(f"v={n}/_SUCCESS"))]
        return max(whole, default=None)

    def read(self) -> DataFrame | None:
        version = self.version()
        return None if version is None else self.spark.read.parquet(f"{self.path}/v={version}")

    def _save(self, df: DataFrame, version: int, mode: str) -> None:
        writer = df.write.mode(mode)
        if self.partition:
            writer = writer.partitionBy(*self.partition)
        writer.parquet(f"{self.path}/v={version}")

    def replace(self, df: DataFrame) -> None:
        """Write the next version, then point at it."""
        version = max([0, *self._versions()]) + 1
        self._save(df, version, "errorifexists")
        self.publish(version)

    def publish(self, version: int) -> None:
        jvm, staged = self.spark._jvm, self._path(f"NEXT{version}")
        out = self._fs().create(staged, True)
        out.write(bytearray(str(version), "utf-8"))
        out.close()
        options = jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark._sc._gateway.new_array(options, 1)
        how[0] = options.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs().getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(context.makeQualified(staged), context.makeQualified(self._path("CURRENT")), how)

    def append(self, df: DataFrame) -> None:
        version = self.version()
        if version is None:
            self.replace(df)
        else:
            self._save(df, version, "append")


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str] = (), nullable: Sequence[str] = ()) -> DataFrame:
    """First row per key. An aggregate: copies of one key are combined before the shuffle.

    Rows with a null in ``nullable`` never collide with anything.
    """
    loose = None
    if nullable:
        test = F.lit(False)
        for name in nullable:
            test = test | F.col(name).isNull()
        loose, df = df.filter(test), df.filter(~test)
    first = scale.latest_per(df, keys, *(order or [F.lit(0)]), newest=False)
    return first if loose is None else first.unionByName(loose)


def new_rows(df: DataFrame, target: DataFrame | None, keys: Sequence[str], order: Sequence[str] = (), nullable: Sequence[str] = ()) -> DataFrame:
    fresh = dedupe(df, keys, order, nullable)
    return fresh if target is None else fresh.join(target.select(*keys), list(keys), "left_anti")


def append_new(df: DataFrame, table: ParquetTable, keys: Sequence[str], order: Sequence[str] = (), nullable: Sequence[str] = ()) -> dict[str, int]:
    """Insert rows whose key is new; repeats are counted, not errors. An ``IndexedTable`` reads only the files it needs."""
    if not isinstance(table, ParquetTable):
        return table.append_new(df, order, nullable)
    received = df.count()
    if not received:
        return {"received": 0, "stored": 0, "duplicate": 0}
    before = table.read()
    had = 0 if before is None else before.count()
    table.append(new_rows(df, before, keys, order, nullable))
    stored = table.read().count() - had
    return {"received": received, "stored": stored, "duplicate": received - stored}


def merged(df: DataFrame, target: DataFrame | None, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Target rows not replaced, plus the newest incoming row per key; columns only one side has become null."""
    latest = scale.latest_per(df, keys, *order) if order else dedupe(df, keys)
    if target is None:
        return latest
    kept = target.join(latest.select(*keys), list(keys), "left_anti")
    return kept.unionByName(latest, allowMissingColumns=True)


def upsert(df: DataFrame, table: ParquetTable, keys: Sequence[str], order: Sequence[str] = ()) -> None:
    if not isinstance(table, ParquetTable):
        table.upsert(df, order)
        return
    table.replace(merged(df, table.read(), keys, order))


OUTBOX_KEYS = ("project_id", "target_species", "h3_cell", "time_bin", "risk_status")


def outbox_rows(metrics: DataFrame) -> DataFrame:
    """Populations at risk as pending alerts."""
    risky = metrics.filter(F.col("risk_status").isin("CRITICAL_INBREEDING_RISK", "VULNERABLE_POPULATION_RISK"))
    return risky.select(*OUTBOX_KEYS, F.to_json(F.struct(*risky.columns)).alias("payload_json"), F.lit("PENDING").alias("status"))


def emit_outbox(metrics: DataFrame, outbox: ParquetTable) -> dict[str, int]:
    """One alert per population and status, ever."""
    return append_new(outbox_rows(metrics), outbox, OUTBOX_KEYS)


def publish_outbox(outbox: ParquetTable, publish) -> int:
    """Hand pending alerts to ``publish(df)``, then mark them queued; a failure leaves them pending."""
    rows = outbox.read()
    pending = rows.filter(F.col("status") == "PENDING")
    n = pending.count()
    if n:
        publish(pending)
        upsert(pending.withColumn("status", F.lit("QUEUED")), outbox, OUTBOX_KEYS)
    return n


def quarantine_rows(rejected: DataFrame) -> DataFrame:
    data = [c for c in rejected.columns if c not in ("source_row", "reject_reasons", "source_hash")]
    return rejected.select("source_hash", "source_row", F.array_join("reject_reasons", "; ").alias("reason"), F.struct(*data).alias("source_data"))


def write_quarantine(rejected: DataFrame, path: str) -> None:
    """Rejected rows as JSON lines, one folder per source."""
    quarantine_rows(rejected).write.mode("append").partitionBy("source_hash").json(path)


def skip_processed(df: DataFrame, ledger: DataFrame | None, key: str = "source_hash") -> DataFrame:
    return df if ledger is None else df.join(ledger.select(key).distinct(), key, "left_anti")


def geojson_features(clusters: DataFrame, west: float, threats: bool = False) -> DataFrame:
    """One GeoJSON feature per cluster, as text."""
    from fieldlake.functions.geo import unwrap_longitude
    props = [F.col("cluster_id"), (F.col("point_count") > 1).alias("cluster"), F.col("point_count"), F.round("weight", 4).alias("weight"),
             F.array(F.round(unwrap_longitude("min_lon_offset", west), 6), F.round("min_latitude", 6), F.round(unwrap_longitude("max_lon_offset", west), 6),
                     F.round("max_latitude", 6)).alias("bbox")]
    if threats:
        props.append(F.col("threat_count"))
    if "metric_sum" in clusters.columns:
        props.append(F.when(F.col("metric_count") > 0, F.round(F.col("metric_sum") / F.nullif("metric_count", F.lit(0)), 4)).alias("metric_avg"))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round(unwrap_longitude("lon_offset", west), 6), F.round("latitude", 6)).alias("coordinates"))
    return clusters.select("cluster_id", F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*props).alias("properties"))).alias("feature"))


def to_geojson(clusters: DataFrame, west: float, threats: bool = False) -> DataFrame:
    """One FeatureCollection. A map grid has at most 256×256 squares, so the document is bounded."""
    features = geojson_features(clusters, west, threats).agg(F.array_sort(F.collect_list(F.struct("cluster_id", "feature"))).alias("f"))
    return features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.transform("f", lambda x: x["feature"]), ","), F.lit("]}")).alias("geojson"))


def alert_frames(alerts: DataFrame) -> DataFrame:
    """Frames for a message sink: key and JSON value."""
    body = F.struct(F.lit("alert").alias("type"), "event_id", F.col("ts_ms").alias("timestamp"), "priority", "event_type", "classification",
                    F.struct("cri_score", "confidence").alias("metrics"), F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lng"), "zone").alias("location"))
    client = [F.col("client_id")] if "client_id" in alerts.columns else []
    return alerts.select(F.col("event_id").alias("key"), *client, F.to_json(body).alias("value"))


SCORES = ("population_subscore", "habitat_subscore", "threat_subscore", "climate_subscore", "genetics_subscore", "behavior_subscore")


def assessment_rows(assessed: DataFrame, run_id: str, model_version: str = "fieldlake-1") -> DataFrame:
    """Stored row: score columns, plus everything without a column as one JSON document."""
    kept = ["species_id", "h3_cell", "period_start", "period_end", *SCORES, "conservation_risk_index", "inbreeding_penalty_index", "intervention_priority_index",
            "risk_momentum_per_day", "momentum_window_days", "population_trend", "effective_population_size", "critical_inbreeding_risk", "escalation_level",
            "intervention_priority_tier", "narrative_report"]
    audit = [c for c in assessed.columns if c not in kept and c != "scope_id"]
    summary = F.to_json(F.struct(F.lit(run_id).alias("run_id"), F.lit("0-100").alias("score_scale"), F.lit(1).alias("focal_evidence_version"), *audit))
    return assessed.select(*kept, summary.alias("input_summary"), F.lit(model_version).alias("model_version"), F.current_timestamp().alias("generated_at"))


def write_assessments(assessed: DataFrame, table: ParquetTable, run_id: str) -> None:
    upsert(assessment_rows(assessed, run_id), table, ("species_id", "h3_cell", "period_start", "period_end"))
