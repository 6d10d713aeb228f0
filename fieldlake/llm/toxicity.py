"""Severity grades by cumulative-link (proportional odds) regression on sparse word features.

``P(grade <= k) = 1 / (1 + exp(w.x - t_k))`` with one weight vector for all ordered thresholds t_0 < t_1 < ...; the
expected severity is the sum of ``P(grade > k)``. The labels only say toxic or not, so the grades of toxic rows are
derived: the number of distinct marker words (words that toxic rows hold far more often than others), up to ``GRADES``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.llm.common import LOWER, filtered, prefix_hash, raw, slices, span_hash, stage, words

FIT_ROWS = 4000  # labelled rows of each class that the fit uses at most, those with the smallest hash of their id
GRADES = 3  # grades above zero
Z_SCORE = 4.0  # a word is a feature if its rates in the two classes differ by this many standard errors
REJECT = 0.5  # expected severity from which a document is toxic

#: Bytes between words: all of ASCII but letters and digits.
BETWEEN = np.ones(256, bool)
BETWEEN[0x80:] = False
BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def _word_rows(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the words of all rows, and their rows."""
    data = LOWER[data]
    starts, ends, owner = words(data, offsets, BETWEEN)
    return span_hash(prefix_hash(data), starts, ends), owner


def _features(batches):
    for batch in slices(batches, "__text"):
        h, row = _word_rows(*raw(batch.column("__text")))
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        edges = np.searchsorted(row[new], np.arange(batch.num_rows + 1))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h[new].view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__toxic"), lists], ["id", "toxic", "words"])


@dataclass
class Model:
    words: np.ndarray  # sorted word hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending

    def severity(self, score: np.ndarray) -> np.ndarray:
        return (1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))).sum(axis=1)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, penalty: float = 1e-3,
                rounds: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds for a sparse 0/1 matrix by full-batch gradient steps with moment estimates."""
    n, top = len(grades), int(grades.max())
    share = np.array([(grades <= k).mean() for k in range(top)])
    start = np.log(share / (1 - share))
    # thresholds as a first value and logarithms of the gaps, so that they stay ordered
    theta = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, gaps = theta[:n_features], np.exp(theta[n_features + 1:])
        t = theta[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        score = np.bincount(rows, w[columns], n)
        upper = np.where(grades == top, 1.0, _sigmoid(t[np.minimum(grades, top - 1)] - score))
        lower = np.where(grades == 0, 0.0, _sigmoid(t[np.maximum(grades - 1, 0)] - score))
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # d log p / d t_upper, - d log p / d t_lower
        dt = np.bincount(np.minimum(grades, top - 1), du * (grades < top), top) - np.bincount(
            np.maximum(grades - 1, 0), dl * (grades > 0), top)
        dw = np.bincount(columns, (dl - du)[rows], n_features)
        tail = np.cumsum(dt[::-1])[::-1]
        g = -np.concatenate([dw, tail[:1], gaps * tail[1:]]) / n
        g[:n_features] += penalty * w
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        theta = theta - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-9)
    gaps = np.exp(theta[n_features + 1:])
    return theta[:n_features], theta[n_features] + np.concatenate([[0], np.cumsum(gaps)])


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        fit_rows: int = FIT_ROWS, grades: int = GRADES) -> Model | None:
    """Model from at most ``fit_rows`` labelled documents of each class; None if a class or all features are missing.

    Labels with a null id or value are passed over; of several labels of one id the toxic one counts.
    """
    own = (labels.select(F.col(id).alias("__l"), F.col(toxic).cast("int").alias("__toxic")).filter("__l is not null and __toxic is not null")
           .groupBy("__l").agg(F.max("__toxic").alias("__toxic")))
    present = own.join(docs.select(F.col(id).alias("__l")), "__l", "left_semi")
    order = F.xxhash64("__l")
    sample = stage(present.filter("__toxic = 0").orderBy(order, "__l").limit(fit_rows)
                   .unionAll(present.filter("__toxic <> 0").orderBy(order, "__l").limit(fit_rows)), "labelled")
    held = stage(docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
                 .join(F.broadcast(sample), F.col("__id") == F.col("__l"))  # at most 2 * fit_rows rows
                 .select("__id", "__toxic", "__text")
                 .mapInArrow(_features, f"id {docs.schema[id].dataType.simpleString()}, toxic int, words array<long>"), "features")
    totals = {int(r["toxic"] != 0): r["count"] for r in held.groupBy("toxic").count().collect()}
    if len(totals) < 2:
        return None
    a, b = totals[1], totals[0]
    rate, other = F.col("t") / a, F.col("o") / b
    pooled = (F.col("t") + F.col("o")) / (a + b)
    z = (rate - other) / F.sqrt(pooled * (1 - pooled) * (1 / a + 1 / b))
    chosen = (held.select(F.explode("words").alias("word"), (F.col("toxic") != 0).cast("int").alias("t")).groupBy("word")
              .agg(F.sum("t").alias("t"), F.sum(1 - F.col("t")).alias("o")).filter("t + o >= 4").withColumn("z", z)
              .filter(F.abs("z") >= Z_SCORE))
    features = sorted((r["word"], r["z"]) for r in chosen.select("word", "z").collect())
    if not features:
        return None
    names = np.array([w for w, _ in features], np.int64)
    marker = np.array([s > 0 for _, s in features])
    names = names.view(np.uint64)
    order = np.argsort(names)
    names, marker = names[order], marker[order]
    wanted = F.array(*[F.lit(w) for w, _ in features])
    rows = held.select("toxic", F.array_intersect("words", wanted).alias("words")).collect()  # only chosen words of the sample
    counts = [len(r["words"]) for r in rows]
    columns = np.searchsorted(names, np.array([w for r in rows for w in r["words"]], np.int64).view(np.uint64))
    index = np.repeat(np.arange(len(rows)), counts)
    hits = np.bincount(index, marker[columns], len(rows)).astype(np.int64)
    grade = np.where(np.array([r["toxic"] for r in rows]) != 0, np.clip(hits, 1, grades), 0)
    _, grade = np.unique(grade, return_inverse=True)  # grades that occur, without gaps
    weights, thresholds = fit_ordinal(index, columns, grade, len(names))
    return Model(names, weights, thresholds)


def severities(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Expected severity of every row; without a model it is zero."""
    rows = len(offsets) - 1
    if model is None:
        return np.zeros(rows)
    h, row = _word_rows(data, offsets)
    seen = np.zeros(1 << 16, bool)
    seen[(model.words & np.uint64(0xFFFF)).astype(np.int64)] = True
    near = np.flatnonzero(seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(model.words, h[near]), len(model.words) - 1)
    hit = model.words[at] == h[near]
    pair = np.unique(row[near[hit]] * len(model.words) + at[hit])
    return model.severity(np.bincount(pair // len(model.words), model.weights[pair % len(model.words)], rows))


def score(docs: DataFrame, model: Model | None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``expected_severity`` of every row; a text without words, also a null one, has the score of no features.

    The model holds chosen words only and travels with the task.
    """
    def run(batches):
        for batch in slices(batches, "__text"):
            yield pa.RecordBatch.from_arrays([batch.column("__id"), pa.array(severities(model, *raw(batch.column("__text"))))],
                                             ["id", "expected_severity"])

    return (docs.select(F.col(id).alias("__id"), F.col(text).alias("__text"))
            .mapInArrow(run, f"id {docs.schema[id].dataType.simpleString()}, expected_severity double"))


def reject(docs: DataFrame, model: Model | None, text: str = "text", limit: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose expected severity stays below ``limit``, with all their columns."""
    return filtered(docs, text, lambda data, offsets: severities(model, data, offsets) < limit)
