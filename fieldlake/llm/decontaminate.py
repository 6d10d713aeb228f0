"""Benchmark items inside documents: size-partitioned MinHash containment search with exact verification.

Items are partitioned by their number of word shingles (powers of two). Each partition has its own bottom-k MinHash
sketch, wide enough that an item of which at least ``threshold`` lies in a document leaves at least ``MARGIN`` of its
sketch values there (all it has, if the item is shorter): at most ``(1 - threshold) * size`` of them can be missing.
So no contained item is missed, however long the document, and few others reach the exact comparison of shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fieldlake.llm.common import LOWER, filtered, prefix_hash, raw, shingles, slices, span_hash, stage, words

SHINGLE = 5
THRESHOLD = 0.8
MARGIN = 4
BLOCK_BYTES = 8 << 20  # benchmark text that one pass over the documents carries


def _texts(body: bytes, n: int) -> set[bytes]:
    """Exact shingles of one lower-cased text."""
    parts = body.split()
    if len(parts) <= n:
        return {b" ".join(parts)} if parts else set()
    return {b" ".join(parts[k:k + n]) for k in range(len(parts) - n + 1)}


def _hashes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, owner = words(data, offsets)
    return shingles(span_hash(prefix_hash(data), starts, ends), owner, len(offsets) - 1, n)


class Sketches:
    """The sketches of one block of items, one table per size partition."""

    def __init__(self, items: list[tuple[object, str | None]], n: int, threshold: float):
        self.n, self.threshold = n, threshold
        self.ids = [i for i, _ in items]
        self.bodies = [LOWER[np.frombuffer((t or "").encode(), np.uint8)].tobytes() for _, t in items]
        sizes, found = [], []
        for body in self.bodies:
            h, _ = _hashes(np.frombuffer(body, np.uint8), np.array([0, len(body)]), n)
            found.append(np.unique(h))
            sizes.append(len(found[-1]))
        self.tables = []
        for part in sorted({math.ceil(math.log2(q)) for q in sizes if q}):
            width = math.floor((1 - threshold) * 2 ** part + 1e-9) + MARGIN
            keys, owner, need = [], [], np.zeros(len(items), np.int64)
            for k, h in enumerate(found):
                if len(h) and math.ceil(math.log2(len(h))) == part:
                    keys.append(h[:width])
                    owner.append(np.full(len(keys[-1]), k))
                    need[k] = len(keys[-1]) - math.floor((1 - threshold) * len(h) + 1e-9)
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 16, bool)
            seen[(keys & np.uint64(0xFFFF)).astype(np.int64)] = True
            self.tables.append((keys[order], owner[order], need, seen))

    def candidates(self, h: np.ndarray, row: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs with enough distinct sketch values in common."""
        out = set()
        for keys, owner, need, seen in self.tables:
            near = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
            low, high = np.searchsorted(keys, h[near]), np.searchsorted(keys, h[near], "right")
            hit = np.flatnonzero(high > low)
            if not len(hit):
                continue
            times = (high - low)[hit]
            slot = np.repeat(low[hit], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            pair = np.unique(np.stack([np.repeat(row[near[hit]], times), slot]), axis=1)
            both, count = np.unique(np.stack([pair[0], owner[pair[1]]]), axis=1, return_counts=True)
            for k in np.flatnonzero(count >= need[both[1]]):
                out.add((int(both[0, k]), int(both[1, k])))
        return out


def _search(sketches: Sketches, item_type: pa.DataType):
    def run(batches):
        matcher = Matcher(sketches)
        for batch in slices(batches, "__text"):
            hits = matcher.hits(*raw(batch.column("__text")))
            rows, items, shared, size = ([h[k] for h in hits] for k in range(4))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id").take(pa.array(rows, pa.int64())), pa.array([sketches.ids[k] for k in items], item_type),
                 pa.array(shared, pa.int64()), pa.array(size, pa.int64())], ["id", "item_id", "n_shared", "n_item"])
    return run


class Matcher:
    """Exact hits of one block of items in the rows of a chunk."""

    def __init__(self, sketches: Sketches):
        self.sketches, self.exact = sketches, {}

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(row, item, shingles in common, shingles of the item)."""
        s, out, last, body = self.sketches, [], None, set()
        data = LOWER[data]
        for row, item in sorted(s.candidates(*_hashes(data, offsets, s.n))):
            if row != last:
                last, body = row, _texts(data[offsets[row]:offsets[row + 1]].tobytes(), s.n)
            if item not in self.exact:
                self.exact[item] = _texts(s.bodies[item], s.n)
            both, size = len(self.exact[item] & body), len(self.exact[item])
            if both >= s.threshold * size - 1e-9:
                out.append((row, item, both, size))
        return out


def blocks(items: DataFrame, item_id: str, item_text: str, shingle: int, threshold: float):
    """The items' sketches, block by block; each block is bounded by BLOCK_BYTES on average."""
    own = items.select(F.col(item_id).alias("i"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    count = max(1, -(-total // BLOCK_BYTES))
    for block in range(count):
        part = own.filter(F.pmod(F.xxhash64("i", "t"), F.lit(count)) == block).distinct().collect()
        sketches = Sketches([(r["i"], r["t"]) for r in part], shingle, threshold)
        if sketches.tables:
            yield sketches


def contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """``id, item_id, n_shared, n_item, containment`` of every (document, item) with enough of the item inside.

    Shingles are sets of ``shingle`` lower-cased words; a shorter text is one shingle. The items are a query set that is
    passed over the documents in blocks of bounded size, so neither side is shuffled and no pairs are formed. Items
    or documents without words, also null ones, match nothing. Rows that share an id count with their best one.
    """
    kind, item_kind = docs.schema[id].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"id {kind}, item_id {item_kind.simpleString()}, n_shared long, n_item long"
    source = docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for sketches in blocks(items, item_id, item_text, shingle, threshold):
        found = found.unionAll(stage(source.mapInArrow(_search(sketches, to_arrow_type(item_kind)), schema), "hits"))
    best = found.groupBy("id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n_item"), "n_shared", "n_item")).alias("best"))
    return best.select("id", "item_id", "best.n_shared", "best.n_item", (F.col("best.n_shared") / F.col("best.n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
          shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; each row is judged by its own text."""
    for sketches in blocks(items, item_id, item_text, shingle, threshold):
        docs = filtered(docs, text, _free(sketches))
    return docs


def _free(sketches: Sketches):
    matcher = Matcher(sketches)

    def mask(data, offsets):
        free = np.ones(len(offsets) - 1, bool)
        free[[h[0] for h in matcher.hits(data, offsets)]] = False
        return free

    return mask
