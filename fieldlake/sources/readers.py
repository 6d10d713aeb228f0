"""Readers: files and streams to typed rows. Every schema is declared, none is inferred from data."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldlake.config import FOCAL_SPECIES, MEASUREMENTS
from fieldlake.functions import text
from fieldlake.functions.h3grid import cell_of
from fieldlake.functions.timex import epoch_ms, parse_packed, to_utc
from fieldlake.schemas import COLLAR_FIELDS, INGEST, SENSOR_FIELDS
from fieldlake.session import cut_lineage

IMAGES = ("jpg", "jpeg", "png", "bmp", "tif", "tiff", "webp")
VIDEOS = ("mp4", "avi", "mov", "mkv", "m4v")
AUDIO = ("wav", "flac", "mp3", "ogg", "m4a", "aac")


def _lines(spark: SparkSession, path: str, streaming: bool) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    return reader.schema("value string").text(path) if streaming else reader.text(path)


CORRUPT = "_corrupt_record"


def _device_messages(df: DataFrame, fields) -> DataFrame:
    """``raw``, ``failure`` (null for a message that can be read) and the parsed ``m`` of every line that is not blank."""
    inner = ", ".join(f"{f}: string" for f in fields)
    outer = ", ".join(f"{f} string" for f in fields)
    parsed = F.from_json("value", f"device_id string, max_speed string, {outer}, fields struct<{inner}>, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT})
    rows = df.filter(F.trim("value") != "").select(F.col("value").alias("raw"), parsed.alias("m"))
    return rows.withColumn("failure", _failure("raw", F.col(f"m.{CORRUPT}").isNotNull()))


def _failure(raw: str, corrupt: Column) -> Column:
    """Why a text is no message: no JSON, no object, or a field of another type."""
    kind = F.schema_of_variant(F.try_parse_json(raw))
    return (F.when(kind.isNull(), "not_json").when(~kind.startswith("OBJECT"), "not_an_object").when(corrupt, "field_type"))


def _message(df: DataFrame, fields) -> DataFrame:
    """Device message: a field of ``fields`` wins over the same name in the envelope. Unreadable lines are in ``unreadable``."""
    rows = _device_messages(df, fields).filter("failure is null")
    return rows.select(F.coalesce("m.device_id", F.lit("unknown")).alias("device_id"), F.col("m.max_speed").alias("max_speed"),
                       *[F.coalesce(F.col(f"m.fields.{f}"), F.col(f"m.{f}")).alias(f) for f in fields])


def unreadable(df: DataFrame, fields=COLLAR_FIELDS) -> DataFrame:
    """``raw`` and ``failure`` of the device lines that ``parse_gps`` or ``parse_environmental`` cannot read."""
    return _device_messages(df, fields).filter("failure is not null").select("raw", "failure")


def _number(name: str, default: float | None = None) -> Column:
    value = F.nullif(F.trim(name), F.lit("")).try_cast("double")
    return value if default is None else F.when(F.col(name).isNull(), F.lit(default)).otherwise(value)


def parse_gps(df: DataFrame) -> DataFrame:
    """Collar messages in a ``value`` column. A field that is not a number reads as null and is rejected by validation."""
    rows = _message(df, COLLAR_FIELDS)
    rows = rows.withColumns({"recorded_at": parse_packed(F.coalesce("timestamp", F.lit("1970 01 01 00 00 00 000000")))})
    rows = rows.withColumns({c: _number(c, d) for c, d in {"max_speed": 400.0, "latitude": 0.0, "longitude": 0.0, "altitude": 0.0, "temperature": 0.0,
                                                           "battery_percentage": 100.0, "body_temperature": None, "heart_rate": None}.items()})
    rows = rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("animal_id", "target_species", "device_model", "device_make")})
    return rows.withColumn("recorded_epoch_ms", epoch_ms("recorded_at")).drop("timestamp")


def parse_environmental(df: DataFrame) -> DataFrame:
    rows = _message(df, SENSOR_FIELDS).drop("max_speed")
    rows = rows.withColumns({"recorded_at": parse_packed(F.coalesce("timestamp", F.lit("1970 01 01 00 00 00 000000")))})
    defaults = {c: 0.0 for c in SENSOR_FIELDS[5:20]} | {"latitude": 0.0, "water_ph": 7.0, "battery_percentage": 100.0}
    rows = rows.withColumns({c: _number(c, d) for c, d in defaults.items()})
    rows = rows.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("location_id", "target_species", "device_model", "device_make")})
    return rows.withColumn("recorded_epoch_ms", epoch_ms("recorded_at")).drop("timestamp")


def read_gps(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_gps(_lines(spark, path, streaming))


def read_environmental(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return parse_environmental(_lines(spark, path, streaming))


KINDS = ("gps", "environmental", "acoustic", "vision")


def messages(df: DataFrame) -> DataFrame:
    """Every payload of the lines in ``value`` (one object or an array of them): ``raw``, ``failure`` and the parsed ``p``.

    A failure is one of: ``not_json``, ``not_an_object``, ``field_type`` (a field of another type), ``unknown_type`` (no known reading type).
    Blank lines and empty arrays hold no payload. No line is lost: an array that cannot be read is one failed payload.
    """
    body = F.trim("value")
    many = F.from_json(body, "array<string>")
    rows = df.filter(body != "").select(F.explode(F.when(body.startswith("[") & many.isNotNull(), many).otherwise(F.array(body))).alias("raw"))
    rows = rows.withColumn("raw", F.coalesce("raw", F.lit("null")))
    parsed = rows.withColumn("p", F.from_json("raw", f"{INGEST}, {CORRUPT} string", {"columnNameOfCorruptRecord": CORRUPT}))
    broken = _failure("raw", F.col(f"p.{CORRUPT}").isNotNull())
    return parsed.withColumn("failure", F.coalesce(broken, F.when(~F.coalesce(F.col("p.reading_type").isin(*KINDS), F.lit(False)), "unknown_type")))


def readable(payloads: DataFrame) -> DataFrame:
    """Columns of the payloads without a failure, with their time."""
    rows = payloads.filter("failure is null").select("p.*").drop(CORRUPT)
    return rows.withColumn("recorded_at", to_utc("timestamp")).withColumn("recorded_epoch_ms", epoch_ms("recorded_at")).drop("timestamp")


def parse_ingest(df: DataFrame) -> DataFrame:
    """Payloads that can be read and routed, one object or an array of them per ``value``; see ``messages`` for the others."""
    return readable(messages(df))


def route_ingest(rows: DataFrame, cells: bool = True) -> dict[str, DataFrame]:
    """Payload rows by reading type, shaped like their tables; filters on one parsed input, not one parse each."""
    place = ["latitude", "longitude", "altitude"]

    def of(kind):
        return rows.filter(F.col("reading_type") == kind)
    vitals = F.to_json(F.struct(F.col("heart_rate_bpm"), F.col("accelerometer_g")))
    gps = of("gps").select("species_id", "animal_id", F.col("sensor_id").alias("device_id"), "recorded_at", "recorded_epoch_ms", *place,
                           F.coalesce("fix_quality", F.lit("UNKNOWN")).alias("fix_quality"), "satellite_count", "hdop", "speed_kmh", "battery_voltage",
                           vitals.alias("physiological_metrics"), F.coalesce("threat_detected", F.lit(False)).alias("threat_detected"))
    cell = text.norm_text("h3_cell")
    if cells:
        cell = F.coalesce(cell, cell_of("latitude", "longitude", 7))
    env = of("environmental").select(text.normalise_mac("sensor_mac").alias("sensor_mac"), F.col("sensor_id").alias("device_id"), "recorded_at", "recorded_epoch_ms",
                                     cell.alias("h3_cell"), *place, *[F.try_element_at("measurements", F.lit(m)).alias(m) for m in MEASUREMENTS],
                                     F.map_keys("measurements").alias("reported"), F.coalesce("quality_flag", F.lit("VALID")).alias("quality_flag"),
                                     F.coalesce("threat_detected", F.lit(False)).alias("threat_detected"))

    def seen(kind, source, frame):
        boxes = ["frame_width", "frame_height", "bbox_left", "bbox_top", "bbox_right", "bbox_bottom"]
        return of(kind).select(F.lit(source).alias("source_type"), "source_record_id", F.coalesce("detection_index", F.lit(0)).alias("detection_index"),
                               F.col("sensor_id").alias("device_id"), "asset_path", "species_id", "class_id", "class_name", "category", "confidence",
                               F.col("recorded_at").alias("detected_at"), F.col("recorded_epoch_ms").alias("detected_epoch_ms"), epoch_ms(to_utc("ended_at")).alias("ended_epoch_ms"),
                               *[F.col(b) if frame else F.lit(None).cast("double").alias(b) for b in boxes], *place, F.to_json("metadata").alias("metadata"),
                               F.coalesce("threat_detected", F.lit(False)).alias("threat_detected"))
    return {"gps": gps, "environmental": env, "acoustic": seen("acoustic", "ACOUSTIC", False), "vision": seen("vision", "VISION", True)}


def _binary(spark: SparkSession, path: str, kinds) -> DataFrame:
    pattern = "*.{" + ",".join(x for k in kinds for x in (k, k.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def scan_media(spark: SparkSession, path: str) -> DataFrame:
    """Images and videos with their device (parent folder) and content hash; the bytes stay in the files."""
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return _binary(spark, path, (*IMAGES, *VIDEOS)).select(
        F.col("path").alias("source_path"), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("device_id"),
        F.when(suffix.isin(*VIDEOS), "VIDEO").otherwise("IMAGE").alias("source_type"), "length", F.col("modificationTime").alias("capture_timestamp"),
        F.sha2("content", 256).alias("file_hash"))


def scan_audio(spark: SparkSession, path: str, default_device: str = "unknown") -> DataFrame:
    """Audio files: device is the first folder under the root, source is device:hash, origin is the file time."""
    root = path.rstrip("/").rsplit("/", 1)[-1]
    first = F.regexp_extract("path", rf"/{root}/([^/]+)/[^/]", 1)
    device = F.when(first == "", F.lit(default_device)).otherwise(first)
    return _binary(spark, path, AUDIO).select(F.col("path").alias("source_path"), device.alias("device_id"),
                                              F.concat(device, F.lit(":"), F.sha2("content", 256)).alias("source_id"), F.col("modificationTime").alias("origin_timestamp"))


REQUIRED_EDNA = ("sample_id", "target_species", "collection_date", "latitude", "longitude", "locus_name", "allele_count")


def read_edna_tabular(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Sample sheet as text columns under canonical names; validation types them. One file layout per call."""
    sep = sep or ("\t" if path.lower().endswith(".tsv") else ",")
    df = text.normalise_headers(spark.read.csv(path, header=True, sep=sep, encoding="UTF-8"))
    lacking = [c for c in REQUIRED_EDNA if c not in df.columns]
    if lacking:
        raise ValueError(f"sample sheet lacks {lacking}")
    return df


def _sequence_fields(df: DataFrame) -> DataFrame:
    """Canonical columns from ``key=value`` pairs of the header; the record id names a sample without one."""
    fields = text.header_fields("sequence_header")
    known = {name: text.HEADER_ALIASES[name] for name in ("sample_id", "project_id", "target_species", "collection_date", "latitude", "longitude", "altitude", "locus_name")}
    squeezed = F.transform_keys("__f", lambda k, _: F.regexp_replace(k, "[^a-z0-9]", ""))
    rows = df.withColumn("__f", fields).withColumn("__f", squeezed)
    out = rows
    for name, aliases in known.items():
        keys = dict.fromkeys([name.replace("_", ""), *aliases])
        out = out.withColumn(name, F.coalesce(*[F.try_element_at("__f", F.lit(k)) for k in keys]))
    record = F.regexp_extract("sequence_header", r"^(\S+)", 1)
    return (out.withColumn("sample_id", F.coalesce("sample_id", record)).withColumn("allele_count", F.lit("1")).drop("__f"))


RECORD = "file string, block bigint, part string, header string, sequence string, quality string"


def _fastq_records(batches):
    """Records of one task's pieces (texts between line ends followed by ``@``), and the loose ends of its blocks.

    A piece of four lines is a record. A quality that starts with ``@`` is cut off its record: the piece before it has three lines, the
    last with ``+``, and the one behind is the quality alone. Where a block ends between the two, they leave as ``head`` and
    ``tail``; a block that starts with something else says ``none``. Other pieces lack lines and are no records.
    """
    names = ["file", "block", "part", "header", "sequence", "quality"]
    waiting, place = None, None
    for pdf in batches:
        out = []
        for file, block, piece in zip(pdf["file"], pdf["block"], pdf["value"], strict=True):
            lines = [x for x in piece.replace("\r", "").split("\n") if x]
            first = place != (file, block)
            if first and waiting:
                out.append((*place, "head", *waiting, None))
                waiting = None
            place = (file, block)
            if first and len(lines) > 1:
                out.append((file, block, "none", None, None, None))
            if waiting and len(lines) < 2:
                out.append((file, block, "record", *waiting, "@" + "".join(lines)))
                waiting = None
                continue
            waiting = None
            if len(lines) >= 4 and lines[2].startswith("+"):
                out.append((file, block, "record", lines[0].removeprefix("@"), lines[1], lines[3]))
            elif len(lines) == 3 and lines[2].startswith("+"):
                waiting = (lines[0].removeprefix("@"), lines[1])
            elif first and len(lines) < 2:
                out.append((file, block, "tail", None, None, "@" + "".join(lines)))
        yield pd.DataFrame(out, columns=names)
    if waiting:
        yield pd.DataFrame([(*place, "head", *waiting, None)], columns=names)


def read_sequences(spark: SparkSession, path: str, fmt: str = "fasta") -> DataFrame:
    """FASTA or FASTQ records: header fields, sequence and mean quality.

    Both are split at record marks by Spark's text reader, so one large file is read by many tasks. For FASTQ (four lines a
    record) the mark may also start a quality; the records it cuts are put together again, across tasks by the blocks of the file.
    """
    if fmt == "fasta":
        raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("r"))
        rows = raw.filter(F.trim("r") != "").select(F.trim(F.split("r", "\r?\n", 2)[0]).alias("sequence_header"),
                                                    F.regexp_replace(F.coalesce(F.get(F.split("r", "\r?\n", 2), F.lit(1)), F.lit("")), r"\s+", "").alias("sequence"),
                                                    F.lit(None).cast("double").alias("mean_quality"))
    else:
        pieces = spark.read.option("lineSep", "\n@").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")
        parts = pieces.mapInPandas(_fastq_records, RECORD)
        # at most two loose ends for each block of a file; a tail belongs to the head of the block before it that holds any piece
        before = Window.partitionBy("file").orderBy("block", F.when(F.col("part") == "head", 1).otherwise(0))
        ends = parts.filter("part <> 'record'").withColumns({"__tail": F.lead("part").over(before), "__quality": F.lead("quality").over(before)})
        mended = ends.filter("part = 'head' and __tail = 'tail'").select("header", "sequence", F.col("__quality").alias("quality"))
        whole = parts.filter("part = 'record'").select("header", "sequence", "quality").unionByName(mended)
        rows = whole.select(F.col("header").alias("sequence_header"), "sequence", text.mean_phred("quality").alias("mean_quality"))
    return _sequence_fields(rows)


def read_class_map(spark: SparkSession, path: str) -> DataFrame:
    """Model class index -> label. Headers may be any of the accepted names; bad or repeated indexes are errors."""
    df = spark.read.csv(path, header=True)
    names = {c.lstrip("﻿").strip().casefold(): c for c in df.columns}
    index = next((names[n] for n in ("index", "class_id", "class_index", "id") if n in names), None)
    label = next((names[n] for n in ("class_name", "label", "name", "class", "display_name") if n in names), None)
    if index is None or label is None:
        raise ValueError("a class map needs an index and a label column")
    out = df.select(F.col(index).try_cast("int").alias("class_id"), F.trim(label).alias("class_name"))
    bad = out.filter(F.col("class_id").isNull() | (F.col("class_id") < 0) | (F.coalesce("class_name", F.lit("")) == "")).count()
    twice = out.groupBy("class_id").count().filter("count > 1").count()
    if bad or twice or out.isEmpty():
        raise ValueError(f"class map has {bad} bad and {twice} repeated indexes")
    return out


BUNDLE = ("version int, species string, created_at string, cell_size_m int, loss_year int, "
          "metrics struct<auc: double, tss: double, members: array<struct<auc: double, tss: double>>>, "
          "cells array<struct<lat: double, lon: double, vote: double, status: string, loss: double>>")


CELL = "struct<lat: double, lon: double, vote: double, status: string, loss: double>"


def read_habitat_cells(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cells, metadata) of a habitat document.

    Cells are flat objects, so the document is cut at opening braces by Spark's text reader and one large file is read by many
    tasks. What is not a cell is put together again in file order and read as the metadata; no text of a document holds braces.
    """
    pieces = spark.read.option("lineSep", "{").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("at"), "value")
    is_cell = F.col("value").rlike(r'(?s)^[^{}]*"lat"\s*:[^{}]*\}')
    marked = pieces.select("file", "at", "value", is_cell.alias("is_cell"))
    body = F.concat(F.lit("{"), F.substring_index("value", "}", 1), F.lit("}"))
    cells = marked.filter("is_cell").select(F.from_json(body, CELL).alias("c")).select("c.*")
    rest = F.when(F.col("is_cell"), F.expr("substr(value, instr(value, '}') + 1)")).otherwise(F.concat(F.lit("{"), F.col("value")))
    frame = marked.select("file", "at", rest.alias("rest")).filter(~F.col("rest").rlike(r"^[\s,]*$"))
    joined = frame.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "rest"))), lambda x: x["rest"]), "").alias("doc"))
    # the text before the first brace has none of its own
    doc = joined.select(F.from_json(F.regexp_replace("doc", r"^\{\s*\{", "{"), BUNDLE).alias("d"))
    return cells, cut_lineage(doc.select("d.*").drop("cells"))


def read_presences(spark: SparkSession, path: str, species: str = FOCAL_SPECIES, cell_size: float = 1000.0) -> DataFrame:
    """Reviewed presences of the species, with a source and an uncertainty of at most one cell."""
    df = spark.read.schema("scientific_name string, longitude double, latitude double, uncertainty_m double, source string, approved string").csv(path, header=True)
    return df.filter((F.lower(F.trim("scientific_name")) == species.lower()) & (F.lower(F.trim("approved")) == "true") & (F.trim("source") != "")
                     & F.col("uncertainty_m").between(0, cell_size) & F.col("longitude").between(-180, 180) & F.col("latitude").between(-90, 90))


def read_infrastructure(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("id bigint, feature_type string, feature_name string, geometry_wkt string, detected_at string, removed_at string, source string").json(path)
    return df.withColumn("detected_epoch_ms", epoch_ms(to_utc("detected_at"))).withColumn("removed_epoch_ms", epoch_ms(to_utc("removed_at")))


def dim_from_config(spark: SparkSession, rows, schema: str) -> DataFrame:
    """Small configured dimension: loci, devices, outposts, targets."""
    return spark.createDataFrame(list(rows), schema)


def loci_from_config(spark: SparkSession, approved: dict, default_max: int = 2) -> DataFrame:
    rows = [(species.strip().replace("_", " "), locus, int(limit if limit is not None else default_max))
            for species, loci in approved.items() for locus, limit in (loci.items() if isinstance(loci, dict) else ((x, None) for x in loci))]
    return dim_from_config(spark, rows, "target_species string, locus_name string, max_allele_count int")


