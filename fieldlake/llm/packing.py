"""Best-fit packing of documents into token sequences, planned on the histogram of piece lengths.

The plan needs one count per length up to the sequence length, whatever the number of documents. Each planned slot
group says: so many sequences hold a piece of this length at this offset. Pieces then take slots by their rank
within their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.bpe import encode, row_edges, vocabulary_path
from fieldlake.llm.common import raw, slices, stage

CAPACITY = 1024
END = 2  # token after every document
RANK_ROWS = 20_000  # pieces that one task ranks


def _pieces(path: str, capacity: int, end: int, with_ids: bool):
    names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        for batch in slices(batches, "__text"):
            data, offsets = raw(batch.column("__text"))
            ids, each, starts = encode(data, offsets, path)
            edges = row_edges(each, starts, offsets)
            own, piece, begin, size, crc, kept = [], [], [], [], [], []
            for row in range(batch.num_rows):
                mine = np.append(ids[edges[row]:edges[row + 1]], np.uint32(end)).astype("<u4")
                first = len(mine) % capacity or capacity
                stops = np.arange(first, len(mine) + 1, capacity).tolist()
                a = 0
                for k, b in enumerate(stops):
                    part = mine[a:b]
                    own.append(row)
                    piece.append(k)
                    begin.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(part.tobytes()))
                    kept.append(part)
                    a = b
            columns = [batch.column("__id").take(pa.array(own, pa.int64())), pa.array(piece, pa.int32()),
                       pa.array(begin, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.array([p.astype(np.int32) for p in kept], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)
    return run


def pieces(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY,
           end: int = END, with_ids: bool = False) -> DataFrame:
    """Token pieces of every document: ``id, piece, start, length, ids_crc32`` and, if asked for, ``ids``.

    A document is its ids and the end token, so an empty or null text is one piece of length 1. Only longer ones than
    ``capacity`` are cut; all pieces but the first are full then.
    """
    schema = f"id {docs.schema[id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return (docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
            .mapInArrow(_pieces(path or vocabulary_path(), capacity, end, with_ids),
                        schema + (", ids array<int>" if with_ids else "")))


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing over counts: rows ``(length, sequences, first sequence, offset)``.

    All sequences with the same room are alike, so a length's whole count goes into them at once: each takes as many
    as best fit would give it before the next one is touched. Every length splits at most one group, so there are
    at most two groups per length and the plan does not grow with the number of documents.
    """
    groups: dict[int, list[list]] = {}  # room left -> [sequences, contents as (length, times) in order]
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in groups if r >= length):
            if not left:
                break
            times = room // length
            waiting = groups.pop(room)
            while waiting and left:
                n, held = waiting.pop()
                whole = min(n, left // times)
                if whole:
                    groups.setdefault(room - times * length, []).append([whole, (*held, (length, times))])
                    left -= whole * times
                    n -= whole
                if n and left:  # fewer left than one sequence can take
                    groups.setdefault(room - left * length, []).append([1, (*held, (length, left))])
                    n, left = n - 1, 0
                if n:
                    waiting.append([n, held])
            if waiting:
                groups.setdefault(room, []).extend(waiting)
        if left:
            times = capacity // length
            if left // times:
                groups.setdefault(capacity - times * length, []).append([left // times, ((length, times),)])
            if left % times:
                groups.setdefault(capacity - left % times * length, []).append([1, ((length, left % times),)])
    rows, first = [], 0
    for room in sorted(groups):
        for n, held in groups[room]:
            offset = 0
            for length, times in held:
                for _ in range(times):
                    rows.append((length, n, first, offset))
                    offset += length
            first += n
    return rows


def _slots(rows: list[tuple[int, int, int, int]]):
    by: dict[int, tuple[np.ndarray, ...]] = {}
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    for length in np.unique(table[:, 0]).tolist():
        mine = table[table[:, 0] == length]
        by[length] = (np.cumsum(mine[:, 1]) - mine[:, 1], mine[:, 2], mine[:, 3])

    def run(batches):
        for batch in batches:
            lengths = batch.column("length").to_numpy(zero_copy_only=False)
            ranks = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                begin, first, place = by[length]
                k = np.searchsorted(begin, ranks[at], "right") - 1
                sequence[at] = first[k] + ranks[at] - begin[k]
                offset[at] = place[k]
            names = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)],
                                             [*names, "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY,
         end: int = END, with_ids: bool = False) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset`` (gapless from 0).

    Ranks within a length are given per (length, bucket of ids) and raised by the counts of the buckets before, so a
    length that most pieces share is ranked by many tasks. Rows with a null or repeated id are documents like any
    other. No rows give no rows.
    """
    cut = stage(pieces(docs, id, text, path, capacity, end, with_ids), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most ``capacity`` rows
    buckets = max(1, -(-sum(histogram.values()) // RANK_ROWS))
    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("id", "piece"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = (keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
            .select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("length", "bucket").orderBy("id", "piece", "ids_crc32")
    ranked = (keyed.withColumn("k", F.row_number().over(inside)).join(sums, ["length", "bucket"])
              .select(*cut.columns, (F.col("base") + F.col("k") - 1).alias("rank")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return ranked.mapInArrow(_slots(plan(histogram, capacity)), f"{schema}, sequence_id long, offset long")
