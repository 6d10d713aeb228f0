"""Relational joins between readings, species, assessments and evidence.

No broadcast hint appears here: dimension tables come with a size Catalyst knows, and it
broadcasts them when they are below the threshold and shuffles them otherwise.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.config import RISK, TRACEABLE_TABLES
from fieldlake.functions import jsonx, text
from fieldlake.operators import scale

VALID, NO_LOCATION = "VALID", "MISSING_DEVICE_LOCATION"


def attach_location(windows: DataFrame, devices: DataFrame) -> DataFrame:
    """Audio windows with their device's place; a device without one is flagged, not dropped."""
    place = devices.select("device_id", "location_id", "latitude", "longitude", "altitude")
    out = scale.spread_join(windows, place, ["device_id"], "left")
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return out.withColumn("validation_status", F.when(located, VALID).otherwise(NO_LOCATION))


def with_species(df: DataFrame, species: DataFrame, how: str = "left", columns=("scientific_name",)) -> DataFrame:
    return scale.spread_join(df, species.select(F.col("id").alias("species_id"), *columns), ["species_id"], how)


def semi_species(df: DataFrame, species: DataFrame, name: str) -> DataFrame:
    named = species.filter(text.species_eq("scientific_name", name)).select(F.col("id").alias("species_id"))
    return df.join(named, "species_id", "left_semi")


BASELINES = ("minimum_viable_population", "critical_ne_threshold", "viable_ne_threshold", "resting_heart_rate_min_bpm",
             "resting_heart_rate_max_bpm", "home_range_km2", "juvenile_recruitment_ratio")


def with_baselines(scopes: DataFrame, species: DataFrame) -> DataFrame:
    """Scopes with their species' baselines; a baseline of zero cannot serve and reads as missing."""
    def column(name):
        if name not in species.columns:
            return F.lit(None).cast("double").alias(name)
        value = F.col(name).cast("double")
        return F.when(value > 0, value).alias(name)
    census = (F.col("census_population_estimate").cast("double") if "census_population_estimate" in species.columns
              else F.lit(None).cast("double"))
    side = species.select(F.col("id").alias("species_id"), F.col("scientific_name"), *[column(b) for b in BASELINES],
                          census.alias("census_count"))
    return scopes.drop("scientific_name").join(side, "species_id", "left")


def drop_linked(acoustic: DataFrame, detections: DataFrame) -> DataFrame:
    """Acoustic events that no detection was promoted from."""
    linked = detections.filter((F.col("source_type") == "ACOUSTIC") & F.col("source_record_id").isNotNull())
    return acoustic.join(linked.select(F.col("source_record_id").alias("id")).distinct(), "id", "left_anti")


THREAT_COLUMNS = ("detected_epoch_ms", "class_name", "source_type", "confidence", "latitude", "longitude", "record_id")


def union_threats(detections: DataFrame, acoustic: DataFrame, keep=()) -> DataFrame:
    """Threat detections and the acoustic threats not among them, one schema, half positions dropped."""
    def located(name):
        both = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        return F.when(both, F.col(name)).alias(name)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0)))).alias("confidence")
    tail = [confidence, located("latitude"), located("longitude")]
    seen = detections.filter(F.col("category") == "immediate_threat").select(
        *keep, "detected_epoch_ms", "class_name", "source_type", *tail, F.col("id").alias("record_id"))
    heard = drop_linked(acoustic, detections).filter(F.col("category") == "immediate_threat").select(
        *keep, F.col("start_epoch_ms").alias("detected_epoch_ms"), "class_name", F.lit("ACOUSTIC").alias("source_type"), *tail,
        F.lit(None).cast("bigint").alias("record_id"))
    return seen.unionByName(heard)


def latest_census(scopes: DataFrame, evidence: DataFrame, scope=("scope_id",)) -> DataFrame:
    """Latest verified count of a survey wholly inside the period; newest start, then source name, breaks ties."""
    counts = evidence.filter(F.col("census_count").isNotNull()).select(
        "species_id", "h3_cell", F.col("period_start").alias("s"), F.col("period_end").alias("e"), "source", "census_count")
    asked = scopes.select(*scope, "species_id", "h3_cell", "period_start", "period_end")
    inside = asked.join(counts, ["species_id", "h3_cell"]).filter(
        (F.col("s") >= F.to_date("period_start")) & (F.col("e") <= F.to_date("period_end")))
    # the smallest source name wins, so it is the last step: first the newest period, then its first source
    newest = inside.groupBy(*scope, "s", "e").agg(F.min_by("census_count", "source").alias("verified_census_count"))
    return newest.groupBy(*scope).agg(F.max_by("verified_census_count", F.struct("e", "s")).alias("verified_census_count"))


def has_coverage(scopes: DataFrame, evidence: DataFrame) -> DataFrame:
    """Scopes whose whole period one coverage record spans."""
    cover = evidence.filter(F.col("threat_coverage")).select(
        F.col("species_id").alias("__sp"), F.col("h3_cell").alias("__cell"), F.col("period_start").alias("__s"), F.col("period_end").alias("__e"))
    test = ((F.col("species_id") == F.col("__sp")) & (F.col("h3_cell") == F.col("__cell"))
            & (F.col("__s") <= F.to_date("period_start")) & (F.col("__e") >= F.to_date("period_end")))
    return scopes.join(cover, test, "left_semi")


def hydrate(reports: DataFrame, tables: dict[str, DataFrame], limit: int | None = None) -> dict[str, DataFrame]:
    """Source rows behind reports: ``record_ids`` is a map table -> ids; with ``limit`` the first so many per table and report, as
    one page of a report shows. Ids of unknown tables are skipped.
    """
    out = {}
    for name, df in tables.items():
        if name in TRACEABLE_TABLES:
            ids = F.try_element_at("record_ids", F.lit(name))
            ids = ids if limit is None else F.slice(ids, 1, limit)
            asked = reports.select(F.col("id").alias("report_id"), F.explode(ids).alias("id"))
            out[name] = asked.join(df, "id")
    return out


def drop_neighbours(cells: DataFrame, presences: DataFrame, ring: int = 1) -> DataFrame:
    """Grid cells outside the square of ``ring`` cells around any presence."""
    steps = [F.struct((F.col("row") + a).alias("row"), (F.col("col") + b).alias("col"))
             for a in range(-ring, ring + 1) for b in range(-ring, ring + 1)]
    near = presences.select(F.explode(F.array(*steps)).alias("c")).select("c.row", "c.col").distinct()
    return cells.join(near, ["row", "col"], "left_anti")


def assemble(scopes: DataFrame, *sections: DataFrame, on=("scope_id",)) -> DataFrame:
    """One wide row per scope: each section has at most one row per scope."""
    return reduce(lambda left, right: left.join(right, list(on), "left"), sections, scopes)


def species_with_records(species: DataFrame, records: DataFrame, order: str, columns, page: int = 1000, **kw) -> DataFrame:
    """Each species with its records nested in time order, in pages of bounded size.

    One array per species would put a hot species into one row; pages keep the whole result.
    """
    tie = columns[0]
    ranked = scale.row_numbers(records.select("species_id", order, *[c for c in columns if c != order]), ["species_id"],
                               [order, tie], order, **kw)
    paged = ranked.withColumn("page", F.floor((F.col("rn") - 1) / page).cast("bigint"))
    nested = paged.groupBy("species_id", "page").agg(F.array_sort(F.collect_list(F.struct("rn", order, *[c for c in columns if c != order]))).alias("records"))
    return species.withColumnRenamed("id", "species_id").join(nested, "species_id", "left")


def trace_ids(df: DataFrame, keys, id_col: str = "id") -> DataFrame:
    """Every distinct id per key, one row each (lineage of an assessment)."""
    return df.filter(F.col(id_col) != 0).select(*keys, id_col).distinct()


def hydrate_pages(pages: DataFrame, tables: dict[str, DataFrame], keys=("scope_id",), table: str = "table_name") -> dict[str, DataFrame]:
    """Source rows behind whole lineages in pages (``trace_pages`` by table), per table that is given."""
    return {name: pages.filter(F.col(table) == name).select(*keys, F.explode("record_ids").alias("id")).join(df, "id") for name, df in tables.items()}


def trace_pages(df: DataFrame, keys, id_col: str = "id", page: int = 1000, **kw) -> DataFrame:
    """All distinct ids per key in ascending arrays of at most ``page`` ids: the whole lineage, however hot a key is."""
    ids = trace_ids(df, keys, id_col)
    ranked = scale.row_numbers(ids, list(keys), [id_col], id_col, **kw)
    paged = ranked.withColumn("page", F.floor((F.col("rn") - 1) / page).cast("bigint"))
    return paged.groupBy(*keys, "page").agg(F.array_sort(F.collect_list(id_col)).alias("record_ids"))


def merge_lineage(*parts: DataFrame, on=("scope_id",)) -> DataFrame:
    joined = reduce(lambda a, b: a.join(b, list(on), "full_outer"),
                    [p.withColumnRenamed("record_ids", f"__ids{i}") for i, p in enumerate(parts)])
    return joined.select(*on, jsonx.merge_ids(*[f"__ids{i}" for i in range(len(parts))]).alias("record_ids"))
