"""Token counts that follow edits without encoding a text again.

A document's pre-tokens are grouped into leaves of ``LEAF`` pieces (see ``bpe.cuts``), each with its number of tokens; a
segment tree holds the sums. An edit dirties the leaves it touches and, because a cut depends on the character before
it, a neighbour whose cut the edit reaches. Only dirty regions are cut and encoded again; their leaf is replaced and
the sums above it are updated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.bpe import encode, row_edges, vocabulary_path
from fieldlake.llm.common import raw, slices

LEAF = 32  # pieces of a leaf
CONTEXT = 3  # bytes before a cut that it depends on
EDIT = "struct<start:long,length:long,replacement:string>"


class SegmentTree:
    """Sums over leaves: node 1 is the root, the children of node k are 2k and 2k + 1."""

    def __init__(self, counts: np.ndarray):
        self.width = 1 << max(0, len(counts) - 1).bit_length()
        self.sums = np.zeros(2 * self.width, np.int64)
        self.sums[self.width:self.width + len(counts)] = counts
        level = self.width
        while level > 1:
            self.sums[level // 2:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level //= 2

    @property
    def total(self) -> int:
        return int(self.sums[1])

    def set(self, leaf: int, count: int) -> None:
        node = leaf + self.width
        change = count - self.sums[node]
        while node and change:
            self.sums[node] += change
            node //= 2


def merged_edits(edits: list[dict] | None, places: np.ndarray) -> list[tuple[int, int, bytes]]:
    """Edits as (first byte, end byte, new bytes) in order; ``places`` are the byte offsets of the characters and the end.

    Nulls are passed over and places beyond the text are drawn in. Of edits that overlap an earlier one, those that
    start later are left out; of several at one place the first given counts, but an insertion before it stays.
    """
    out: list[tuple[int, int, bytes]] = []
    n = len(places) - 1
    for edit in sorted((e for e in edits or [] if e and e["start"] is not None), key=lambda e: e["start"]):
        a = min(max(edit["start"], 0), n)
        b = min(max(a, a + (edit["length"] or 0)), n)
        first, stop = int(places[a]), int(places[b])
        if out and (first < out[-1][1] or (first == out[-1][0] and out[-1][1] == out[-1][0] and first == stop)):
            continue
        out.append((first, stop, (edit["replacement"] or "").encode()))
    return out


def dirty_regions(edits: list[tuple[int, int, bytes]], bounds: np.ndarray) -> list[tuple[int, int, list]]:
    """(first leaf, last leaf, edits) of the leaf ranges to encode again; ``bounds`` are the leaves' starts and the end."""
    last = len(bounds) - 2
    out: list[tuple[int, int, list]] = []
    for edit in edits:
        a = max(0, int(np.searchsorted(bounds, max(edit[0] - 1, 0), "right")) - 1)
        b = min(last, int(np.searchsorted(bounds, edit[1] + CONTEXT, "right")) - 1)
        a = min(a, last)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]), [*out[-1][2], edit])
        else:
            out.append((a, max(a, b), [edit]))
    return out


def _counted(path: str, leaf: int):
    def run(batches):
        for batch in slices(batches, "__text"):
            data, offsets = raw(batch.column("__text"))
            ids, each, starts = encode(data, offsets, path)
            before = np.diff(row_edges(each, starts, offsets))
            sums = np.concatenate([[0], np.cumsum(each)])
            firsts = np.searchsorted(starts, offsets)
            edits = batch.column("__edits").to_pylist()
            after, n_leaves, n_edits = before.copy(), np.zeros(len(before), np.int64), np.zeros(len(before), np.int64)
            redone, changed = np.zeros(len(before), np.int64), []
            for row in range(batch.num_rows):
                own = starts[firsts[row]:firsts[row + 1]]
                n_leaves[row] = max(1, -(-len(own) // leaf))
                if not edits[row]:
                    continue
                text = data[offsets[row]:offsets[row + 1]]
                places = np.append(np.flatnonzero((text & 0xC0) != 0x80), len(text))
                todo = merged_edits(edits[row], places)
                if not todo:
                    continue
                bounds = np.append(own[::leaf] - offsets[row], len(text)) if len(own) else np.array([0, len(text)])
                marks = np.append(np.arange(firsts[row], firsts[row + 1], leaf), firsts[row + 1]) if len(own) else np.array([0, 0])
                tree = SegmentTree(np.diff(sums[marks]))
                n_edits[row] = len(todo)
                for a, b, inside in dirty_regions(todo, bounds):
                    at, fresh = int(bounds[a]), []
                    for first, stop, new in inside:
                        fresh += [text[at:first].tobytes(), new]
                        at = stop
                    fresh.append(text[at:bounds[b + 1]].tobytes())
                    redone[row] += b - a + 1
                    changed.append((row, tree, a, b, b"".join(fresh)))
            if changed:  # all regions of the chunk are encoded in one go
                again, edges = raw(pa.array([c[4] for c in changed], pa.large_binary()))
                _, each, starts = encode(again, edges, path)
                counts = np.diff(row_edges(each, starts, edges))
                for (row, tree, a, b, _), count in zip(changed, counts.tolist(), strict=True):
                    tree.set(a, count)
                    for k in range(a + 1, b + 1):
                        tree.set(k, 0)
                    after[row] = tree.total
            yield pa.RecordBatch.from_arrays(
                [batch.column("__id"), *map(pa.array, (before, after, n_edits, n_leaves, redone))],
                ["id", "n_tokens", "n_tokens_after", "n_edits", "n_segments", "n_segments_redone"])
    return run


def count_edited(docs: DataFrame, edits: str, id: str = "doc_id", text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """Tokens of every row before and after its edits.

    ``edits`` is a column of ``array<struct<start, length, replacement>>`` in characters of the text. Result: ``id,
    n_tokens, n_tokens_after, n_edits`` (those that count, see ``merged_edits``)``, n_segments, n_segments_redone``.
    Null texts and edits count as empty; every row is judged by itself, so ids may be null or repeated. Rows stay
    where they are: nothing is shuffled.
    """
    kind = docs.schema[id].dataType.simpleString()
    names = "n_tokens", "n_tokens_after", "n_edits", "n_segments", "n_segments_redone"
    return (docs.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"), F.col(edits).cast(f"array<{EDIT}>").alias("__edits"))
            .mapInArrow(_counted(path or vocabulary_path(), leaf), f"id {kind}, " + ", ".join(f"{n} long" for n in names)))
