"""Parquet table whose files carry an index of their keys, so a batch reads and rewrites only the files it touches.

``<path>/data/<folder>/`` holds immutable files, ``<path>/files`` (a versioned ``ParquetTable``) lists the live ones with their rows and the
smallest and largest key, and ``<path>/keys/<folder>/`` holds a Bloom filter of the keys of every file: blocks of 32 768 bits, about
``BITS`` bits a row, built by Spark's bitmap aggregates. A key is looked for in the files whose key range meets that of the batch and
whose filter may hold it; only these are opened. An upsert then replaces those that do hold a key. Publishing the next list is the
commit; a job that dies before it leaves the old list current. Files of older lists stay until somebody removes them.

One writer per table. Null keys equal nothing, as in a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.operators import scale
from fieldlake.sources.sinks import ParquetTable, dedupe

BLOCK = 32_768  # bits of a block: the size of Spark's bitmaps
BITS = 12  # bits per row
HASHES = 4


def _block(h: Column, blocks: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), blocks.cast("bigint"))


def _places(h: Column) -> Column:
    return F.array(*[F.pmod(F.xxhash64(h, F.lit(n)), F.lit(BLOCK)) for n in range(HASHES)])


def _is_set(bits: Column, place: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1


class IndexedTable:
    """Table of rows with natural ``keys``; ``order`` columns, given to the writes, settle repeats of a key."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.listing = ParquetTable(spark, f"{self.path}/files")

    def files(self) -> DataFrame | None:
        """``file``, ``rows``, ``blocks``, ``schema`` and the key ranges ``low``, ``high`` of every live file."""
        return self.listing.read()

    def _open(self, names: Sequence[str], schema: T.StructType) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{n}" for n in names])

    def _schema(self, files: DataFrame) -> T.StructType:
        known: dict[str, T.StructField] = {}
        for row in files.select("schema").distinct().orderBy("schema").collect():
            known |= {f.name: f for f in T._parse_datatype_json_string(row["schema"]).fields if f.name not in known}
        return T.StructType([T.StructField(f.name, f.dataType, True) for f in known.values()])

    def read(self, names: Sequence[str] | None = None) -> DataFrame | None:
        """The table, or the rows of some of its files; columns that older files lack are null."""
        files = self.files()
        if files is None:
            return None
        return self._open([r["file"] for r in files.select("file").collect()] if names is None else names, self._schema(files))

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _write(self, df: DataFrame) -> DataFrame:
        """New files in key order, their filters, and their lines of the listing."""
        folder = uuid.uuid4().hex
        df.repartitionByRange(*self.keys).write.parquet(f"{self.path}/data/{folder}")
        rows = self.spark.read.schema(df.schema).parquet(f"{self.path}/data/{folder}")
        rows = rows.select(F.concat(F.lit(f"{folder}/"), "_metadata.file_name").alias("file"), *self.keys)
        ranges = [g(F.col(k)).alias(f"{n}_{k}") for k in self.keys for n, g in (("low", F.min), ("high", F.max))]
        bits = F.greatest(F.lit(1.0), F.count(F.lit(1)) * BITS / BLOCK)
        listed = rows.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.pow(F.lit(2.0), F.ceil(F.log2(bits))).cast("int").alias("blocks"), *ranges)
        listed = listed.withColumn("schema", F.lit(df.schema.json())).select(
            "file", "rows", "blocks", "schema", *[F.struct(*[F.col(f"{n}_{k}").alias(k) for k in self.keys]).alias(n) for n in ("low", "high")])
        listed.write.parquet(f"{self.path}/lines/{folder}")
        listed = self.spark.read.schema(listed.schema).parquet(f"{self.path}/lines/{folder}")
        placed = (rows.withColumn("h", self._hash()).join(listed.select("file", "blocks"), "file")
                  .select("file", "blocks", _block(F.col("h"), F.col("blocks")).alias("block"), F.explode(_places(F.col("h"))).alias("place")))
        (placed.groupBy("file", "blocks", "block").agg(F.bitmap_construct_agg("place").alias("bits"))
         .write.parquet(f"{self.path}/keys/{folder}"))
        return listed

    def candidates(self, wanted: DataFrame) -> list[str]:
        """Files that may hold a key of ``wanted``: by key ranges, then by their filters."""
        files = self.files()
        if files is None:
            return []
        ends = wanted.agg(*[g(k).alias(f"{n}_{k}") for k in self.keys for n, g in (("low", F.min), ("high", F.max))]).first()
        for k in self.keys:
            if ends[f"low_{k}"] is None:
                return []
            files = files.filter((F.col(f"high.{k}") >= F.lit(ends[f"low_{k}"])) & (F.col(f"low.{k}") <= F.lit(ends[f"high_{k}"])))
        found = files.select("file", "blocks").collect()
        if not found:
            return []
        folders = sorted({r["file"].split("/")[0] for r in found})
        filters = (self.spark.read.schema("file string, blocks int, block bigint, bits binary").parquet(*[f"{self.path}/keys/{f}" for f in folders])
                   .join(files.select("file"), "file", "left_semi"))
        sizes = F.array(*[F.lit(n) for n in sorted({r["blocks"] for r in found})])
        probes = (wanted.select(self._hash().alias("h")).distinct().select("h", F.explode(sizes).alias("blocks"))
                  .withColumn("block", _block(F.col("h"), F.col("blocks"))).withColumn("places", _places(F.col("h"))))
        hit = probes.join(filters, ["blocks", "block"]).filter(F.forall("places", lambda p: _is_set(F.col("bits"), p)))
        return sorted(r["file"] for r in hit.select("file").distinct().collect())

    def _publish(self, new: DataFrame, without: Sequence[str] = ()) -> None:
        old = self.files()
        if old is not None:
            new = new.unionByName(old.filter(~F.col("file").isin(list(without))) if without else old)
        self.listing.replace(new.coalesce(1))

    def append(self, df: DataFrame) -> int:
        """Add rows as they are; the number of rows."""
        new = self._write(df)
        stored = new.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        self._publish(new)
        return stored

    def append_new(self, df: DataFrame, order: Sequence[str] = (), nullable: Sequence[str] = ()) -> dict[str, int]:
        """Insert rows whose key is new; repeats are counted, not errors. Rows with a null in ``nullable`` are always new."""
        seen = Observation()
        fresh = dedupe(df.observe(seen, F.count(F.lit(1)).alias("n")), self.keys, order, nullable).persist()
        try:
            fresh.count()
            touched = self.candidates(fresh)
            rows = fresh.join(self.read(touched).select(*self.keys), self.keys, "left_anti") if touched else fresh
            stored = self.append(rows)
        finally:
            fresh.unpersist()
        return {"received": seen.get["n"], "stored": stored, "duplicate": seen.get["n"] - stored}

    def upsert(self, df: DataFrame, order: Sequence[str] = ()) -> list[str]:
        """The newest incoming row per key replaces the row of that key; the files that were replaced."""
        latest = (scale.latest_per(df, self.keys, *order) if order else dedupe(df, self.keys)).persist()
        try:
            touched = self.candidates(latest)
            held, rows = [], latest
            if touched:
                old = self.read(touched)
                named = old.select(*self.keys, F.concat_ws("/", F.element_at(F.split("_metadata.file_path", "/"), -2), "_metadata.file_name").alias("__file"))
                held = [r[0] for r in named.join(latest.select(*self.keys), self.keys, "left_semi").select("__file").distinct().collect()]
            if held:
                rows = self.read(held).join(latest.select(*self.keys), self.keys, "left_anti").unionByName(latest, allowMissingColumns=True)
            self._publish(self._write(rows), held)
        finally:
            latest.unpersist()
        return sorted(held)

    def replace(self, df: DataFrame) -> None:
        """Other rows instead of all that there are."""
        self.listing.replace(self._write(df).coalesce(1))
