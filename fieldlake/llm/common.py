"""Shared pieces: staging on the cluster's shared folder, byte buffers of Arrow columns, words and rolling hashes.

Words are runs of bytes other than space and 0x09-0x0D; lower case means A-Z only. A null text counts as empty.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

CHUNK_BYTES = 2 << 20  # text handled by one vectorised pass
BATCH_ROWS = 500  # rows of an Arrow batch: bounds a worker's memory when texts are long

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_random = np.random.default_rng(20240607)
_MIX = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 5
_POWERS: dict[int, np.ndarray] = {}
WORD_FACTORS = _random.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a session without it (tests on one machine) gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="fieldlake-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors, computes ``df`` once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def prepare(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, b"")
    _, ends, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, np.int64, len(column) + 1, column.offset * 8)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return body[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = raw(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def squeezed(column: pa.Array) -> pa.Array:
    """Every text on its own as its length in bytes (eight bytes) and its zstd frame; a third smaller than what a shuffle or Parquet makes of texts."""
    data, offsets = raw(column)
    body = data.tobytes()
    return pa.array([squeeze(body[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary())


def squeeze(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def unsqueezed(batches: Iterable[pa.RecordBatch], texts: list[str], limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches with the columns ``texts``, made by ``squeezed``, as plain bytes; each has at most ``limit`` bytes of them, or one row."""
    for batch in batches:
        held = [batch.column(t).to_pylist() for t in texts]
        sizes = [[int.from_bytes(x[:8], "little") for x in column] for column in held]
        ends = np.cumsum(np.sum(sizes, axis=0, dtype=np.int64))
        first = 0
        while first < batch.num_rows:
            done = int(ends[first - 1]) if first else 0
            last = max(int(np.searchsorted(ends, done + limit, "right")), first + 1)
            part = batch.slice(first, last - first)
            for t, column in zip(texts, held, strict=True):
                plain = [unsqueeze(x) for x in column[first:last]]
                part = part.set_column(part.schema.get_field_index(t), t, pa.array(plain, pa.large_binary()))
            yield part
            first = last


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; ``space`` says which bytes lie between words."""
    solid = ~space[data]
    before = np.empty_like(solid)
    before[1:] = solid[:-1]
    before[:1] = False
    heads = offsets[:-1]
    before[heads[heads < len(data)]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty_like(solid)
    after[:-1] = solid[1:]
    after[-1:] = False
    tails = offsets[1:]
    after[tails[tails > 0] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        for slot, base in ((0, _BASE), (1, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[slot] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Polynomial sums modulo 2^64 of all prefixes, for ``span_hash``."""
    up, _ = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * up[:len(data)], out=sums[1:])
    return sums


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes in each span, whatever its place."""
    _, down = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_ids(owners: np.ndarray, rows: int) -> np.ndarray:
    """Start of each row's run in a sorted list of owners, with the end of the last."""
    return np.searchsorted(owners, np.arange(rows + 1))


def shingles(hashes: np.ndarray, owners: np.ndarray, rows: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a row and their rows; a row of fewer words gives its whole sequence."""
    edges = run_ids(owners, rows)
    counts = np.diff(edges)
    if len(hashes) >= n:
        total = len(hashes) - n + 1
        out = np.zeros(total, np.uint64)
        for k in range(n):
            out += hashes[k:k + total] * WORD_FACTORS[k]
        inside = owners[:total] == owners[n - 1:]
        out, own = mixed(out[inside]), owners[:total][inside]
    else:
        out, own = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([
            (hashes[edges[r]:edges[r + 1]] * WORD_FACTORS[:counts[r]]).sum(dtype=np.uint64) for r in short], np.uint64)
        out, own = np.concatenate([out, mixed(extra)]), np.concatenate([own, short])
        order = np.argsort(own, kind="stable")
        out, own = out[order], own[order]
    return out, own


def filtered(docs: DataFrame, text: str, mask) -> DataFrame:
    """Rows of ``docs`` for which ``mask(data, offsets)`` holds, judged row by row without a shuffle; all columns stay."""
    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(mask(*raw(batch.column(text)))))

    return docs.mapInArrow(run, docs.schema)
