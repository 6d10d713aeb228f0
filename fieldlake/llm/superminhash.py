"""Near duplicates by SuperMinHash signatures, banding, verification on whole sets and connected components.

Every element of a set deals its own random permutation of the signature's slots, slot by slot: at rank j it offers the
value j + r (r random in [0, 1)) to the j-th slot of its permutation, and a slot keeps its smallest offer. The ranks of one
element are those of one permutation, so its offers are spread over the slots instead of falling independently, which
lowers the variance of the signature. Offers of rank j are smaller than all of rank j + 1, so ranks are dealt in step for
all elements and a set is finished as soon as no slot is empty: long sets after one or two ranks.

Signatures are cut into bands, sets that agree in a band are candidates, and ``copies.grouped`` compares the whole sets of
candidates and joins the similar ones to components. Which bands two sets share is chance: at the threshold of 0.8,
``BANDS`` bands of ``ROWS`` values miss a pair once in 4 * 10^8. Beyond that no two similar sets end in different components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm import copies
from fieldlake.llm.common import mixed, slices, squeezed, stage

BANDS = 50
ROWS = 5  # values of a band
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(h: np.ndarray, row: np.ndarray, rows: int, slots: int) -> np.ndarray:
    """SuperMinHash signature of every row's distinct element hashes; slots of a row without elements stay ``EMPTY``.

    A value is rank * 2^32 + a random number of 32 bits.
    """
    kept = np.full((rows, slots), EMPTY, np.uint64)
    flat = kept.reshape(-1)
    dealt = np.tile(np.arange(slots, dtype=np.uint16), (len(h), 1))
    element, base = np.arange(len(h)), row.astype(np.int64) * slots
    for rank in range(slots):
        if not len(h):
            break
        g = mixed(h + np.uint64((rank + 1) * int(STEP) & int(EMPTY)))
        swap = rank + ((g >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
        slot = dealt[element, swap]
        dealt[element, swap] = dealt[element, rank]
        np.minimum.at(flat, base + slot, (g & np.uint64(0xFFFFFFFF)) | np.uint64(rank) << np.uint64(32))
        full = (kept != EMPTY).all(axis=1)
        open_ = ~full[row]
        if not open_.all():
            h, row, base, dealt = h[open_], row[open_], base[open_], dealt[open_]
            element = np.arange(len(h))
    return kept


def _prints(n: int, bands: int, width: int):
    def run(batches):
        for batch in slices(batches, "__text", copies.SLICE):
            rows = batch.num_rows
            h, row = copies.sets(batch.column("__text"), n)
            size, mark = copies.marks(h, row, rows)
            signed = signatures(h, row, rows, bands * width).reshape(rows, bands, width)
            keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (rows, bands)).copy()
            for k in range(width):
                keys = mixed(keys * STEP + signed[:, :, k])
            keys = copies.lists(keys[size > 0].view(np.int64).ravel(), np.where(size > 0, bands, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), squeezed(batch.column("__text")), batch.column("__at"), pa.array(size.astype(np.int64)), mark, keys],
                ["id", "text", "at", "n", "mark", "keys"])
    return run


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 2, percent: int = 80) -> DataFrame:
    """One row per document: ``id``, ``n_shingles`` (size of its set) and ``component``, the smallest id reachable over links.

    A set holds the distinct shingles of ``shingle`` words, A-Z lower-cased; fewer words give one shingle, no words or a null text an
    empty set, which links with nothing. Sets link when 100 * intersection >= ``percent`` * union, with 50 <= ``percent`` <= 100.
    Rows that share an id give a row each and are judged by their own texts. A row without an id takes part; a component without
    any id is null. Texts are read whole at any length (a pass holds one text and the permutations of about 1 MB of text). No rows
    give no rows; other columns are not read.
    """
    kind = docs.schema[id].dataType.simpleString()
    prints = stage(docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"), F.monotonically_increasing_id().alias("__at"))
                   .mapInArrow(_prints(shingle, BANDS, ROWS), f"id {kind}, text binary, at long, n long, mark binary, keys array<long>"), "prints")
    named = copies.grouped(prints, shingle, percent)
    size = F.col("n").alias("n_shingles")
    found = prints.filter("n > 0").join(named, "mark").select("id", size, F.col("least").alias("component"))
    return found.unionAll(prints.filter("n = 0").select("id", size, F.col("id").alias("component")))
