"""Stretches of words that repeat with a period, by seeds and extension along the diagonals (lags) of each text.

Words q apart are identical over at least m(q) = max(``least`` - q, (``times`` - 1) q) places in a run of period q. Lags are taken
in classes (2^(e-1), 2^e], and each class indexes the k-grams of its own guaranteed overlap, k = the smallest m(q) of the class. As
``times`` is at least 3, k is no smaller than any lag of the class, and then only neighbouring occurrences of a k-gram matter: if q
is the smallest period of a run, a k-gram inside it (which holds a whole period) cannot recur sooner than after q words,
since a word that equals one of its own rotations has a smaller period. So a class enumerates at most one pair of
places per word instead of all pairs of occurrences, which would be quadratic in a run of one repeated word.

A pair (i, i + q) is extended to both sides while the words q apart agree. The furthest place covered so far is kept per
text and lag; pairs before it belong to a stretch that has been extended already and are passed over.

k-grams get exact names by doubling (a gram of 2^j is named by the names of its halves), and a gram that occurs once in
its text is dropped from all longer ones, so texts without repeats cost a single pass.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import raw, slices, words

LEAST = 6  # words of a run
TIMES = 4  # periods of a run
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _names(keys: np.ndarray) -> np.ndarray:
    """Equal positive numbers for equal keys, 0 for a key that occurs once."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    return np.where(count > 1, np.arange(1, len(count) + 1), 0)[name]


def _joined(left: np.ndarray, right: np.ndarray, to: int) -> np.ndarray:
    """Names of grams made of a gram named in ``left`` and one named in ``right``; 0 where either is 0."""
    named = np.zeros(to, np.int64)
    both = np.flatnonzero((left[:to] > 0) & (right[:to] > 0))
    named[both] = _names(left[both] * (int(right.max(initial=0)) + 1) + right[both])
    return named


def _reach(ids: np.ndarray, i: int, j: int, low: int, high: int) -> tuple[int, int]:
    """Largest stretch around place ``i`` in [``low``, ``high``) whose words equal those ``j - i`` further on."""
    lag, width, end = j - i, 64, i
    while end + lag < high:
        to = min(end + width, high - lag)
        differ = np.flatnonzero(ids[end:to] != ids[end + lag:to + lag])
        if len(differ):
            end += int(differ[0])
            break
        end, width = to, 2 * width
    start, width = i, 64
    while start > low:
        to = max(start - width, low)
        differ = np.flatnonzero(ids[to:start] != ids[to + lag:start + lag])
        if len(differ):
            start = to + int(differ[-1]) + 1
            break
        start, width = to, 2 * width
    return start, end


def runs_of(ids: np.ndarray, edges: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, by text, start and period.

    ``ids`` numbers the words of all texts so that equal numbers are equal words of one text; text t has those from
    ``edges[t]`` to ``edges[t + 1]``.
    """
    found: list[tuple[int, int, int, int]] = []
    counts = np.diff(edges)
    longest = int(counts.max(initial=0))
    # names of the grams of ``size`` words, at their first word; those that pass the end of their text occur once
    size, named = 1, _names(ids)
    text = np.repeat(np.arange(len(counts)), counts)
    level = 0
    while longest >= max(least, times * ((1 << level >> 1) + 1)):
        low, high = (1 << level >> 1) + 1, 1 << level
        k = min(max(least - q, (times - 1) * q) for q in range(low, high + 1))
        while 2 * size <= k:
            named, size = _joined(named, named[size:], max(len(ids) - 2 * size + 1, 0)), 2 * size
        if not named.any():
            break
        grams = _joined(named, named[k - size:], max(len(ids) - k + 1, 0)) if k > size else named
        place = np.flatnonzero(grams)
        place = place[np.argsort(grams[place], kind="stable")]
        lag = place[1:] - place[:-1]
        seed = np.flatnonzero((grams[place[1:]] == grams[place[:-1]]) & (lag >= low) & (lag <= high))
        start, lag = place[:-1][seed], lag[seed]
        order = np.lexsort((start, lag))
        start, lag = start[order], lag[order]
        n, covered, of = 0, -1, 0
        while n < len(start):
            if lag[n] != of:
                of, covered = int(lag[n]), -1
            i = int(start[n])
            if i < covered:
                # on to the first seed of this lag behind the stretch
                n += max(int(np.searchsorted(start[n:np.searchsorted(lag, of, "right")], covered)), 1)
                continue
            t = int(text[i])
            a, b = _reach(ids, i, i + of, int(edges[t]), int(edges[t + 1]))
            covered = b
            if b - a + of >= max(least, times * of):
                found.append((t, a - int(edges[t]), b - a + of, of))
            n += 1
        level += 1
    rows = np.array(found, np.int64).reshape(-1, 4)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def _numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Numbers of words: equal for equal bytes in one text."""
    length = ends - starts
    to = np.concatenate([[0], np.cumsum(length)])
    flat = data[np.repeat(starts - to[:-1], length) + np.arange(to[-1])]
    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat.tobytes())])
    index = body.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return owner * (int(index.max(initial=0)) + 1) + index


def _run(least: int, times: int):
    def run(batches):
        for batch in slices(batches, "__text"):
            data, offsets = raw(batch.column("__text"))
            starts, ends, owner = words(data, offsets)
            rows = batch.num_rows
            edges = np.searchsorted(owner, np.arange(rows + 1))
            found = runs_of(_numbered(data, starts, ends, owner), edges, least, times)
            # a word is dropped if it lies in a run behind its first period
            step = np.zeros(len(starts) + 1, np.int64)
            first = edges[found[:, 0]] + found[:, 1]
            np.add.at(step, first + found[:, 3], 1)
            np.add.at(step, first + found[:, 2], -1)
            kept = np.cumsum(step)[:-1] == 0
            ends_, starts_, left = ends[kept], starts[kept], np.searchsorted(owner[kept], np.arange(rows + 1))
            # kept words with a space behind each; the last one of a text is cut off
            length = ends_ - starts_ + 1
            to = np.concatenate([[0], np.cumsum(length)])
            source = np.repeat(starts_ - to[:-1], length) + np.arange(to[-1])
            body = np.append(data, np.uint8(32))[np.minimum(source, len(data))]
            body[to[1:] - 1] = 32
            text = body.tobytes()
            texts = [text[to[a]:max(to[b] - 1, to[a])] for a, b in zip(left, left[1:], strict=False)]
            per_row = np.bincount(found[:, 0], minlength=rows)
            spans = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(np.diff(edges)), lists, pa.array(texts, pa.binary()).cast(pa.string())],
                                             ["id", "n_words", "runs", "collapsed"])
    return run


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per document: ``id``, ``n_words``, ``runs`` (start, length and smallest period in words, by start, then period) and
    ``collapsed``, the text without the words behind the first period of any run, joined by one space.

    A run is a longest stretch of words with smallest period q and at least max(``least``, ``times`` * q) words; ``times`` is at
    least 3. Words are runs of bytes other than space and 0x09-0x0D and are compared as bytes. A null text has no words. Rows are
    judged one by one: repeated ids and null ids give a row each, no rows give no rows, other columns are not read. A text of any
    length is read whole in one task, in memory that grows with its length.
    """
    if times < 3 or least < 1:
        raise ValueError("a run has at least three periods and one word")
    kind = docs.schema[id].dataType.simpleString()
    return (docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
            .mapInArrow(_run(least, times), f"id {kind}, n_words long, runs {RUNS}, collapsed string"))
