"""Hard negatives for pairs of an anchor and a positive, by slots between the positives' upper limits.

The negatives of a positive with score p are the first ones, by descending score, whose scores lie in the window from ``low`` to
``high`` percent of p. The windows of one anchor overlap; their upper limits cut the scores below the highest one into
disjoint slots. Every task keeps the best few of each slot while it reads its rows, the shuffled results are cut again
to the best few of a slot, and a suffix merge from the lowest slot upwards gives, for every slot, the best few below its
upper limit: the lists of the slots are disjoint in score, so they are put behind one another and cut. Each window is answered
by the merge at its own limit, cut off at its lower limit, so rows are scored once whatever number of windows they are in.

Anchors are a stated set and are scored against all rows in blocks. They travel in rounds of at most ``ROUND_BYTES``, which
bounds what is sent to a task, and every round reads the rows once for the positives and once for the negatives.
Scores are exact integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import stage

ROUND_BYTES = 8 << 20  # vectors of the anchors of one round
TILE = 1 << 21  # scores held at once
PENDING = 1 << 18  # entries gathered before they are cut to the best
EXACT = 1 << 53  # sums below are exact in double precision
LONG = (1 << 63) - 1


class Best:
    """The first ``k`` entries of every group by descending score, ties by smaller id."""

    def __init__(self, groups: int, k: int):
        self.k, self.worst = k, np.full(groups, -LONG, np.int64)  # lower scores cannot enter a full group
        self.parts, self.pending, self.limit = [], 0, max(PENDING, 2 * groups * k)

    def add(self, group: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        use = score >= self.worst[group]
        self.parts.append((group[use], score[use], id[use]))
        self.pending += int(use.sum())
        if self.pending > self.limit:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries kept: group, score, id."""
        group, score, id = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*self.parts) if self.parts else ((), (), ())))
        order = np.lexsort((id, -score, group))
        group, score, id = group[order], score[order], id[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        last, kept = place == self.k - 1, place < self.k
        self.worst[group[last]] = score[last]
        self.parts, self.pending = [(group[kept], score[kept], id[kept])], 0
        return self.parts[0]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` numbers; missing places are zero, further ones are cut (they meet zeros)."""
    flat, counts = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    if len(counts) and (counts == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(counts), width), np.int64)
    row = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    inside = place < width
    out[row[inside], place[inside]] = flat[inside]
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of ``a`` with all of ``b``; outside 64 bits is an error."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    high = [max(abs(int(x.max())), abs(int(x.min()))) for x in (a, b)]
    bound = high[0] * high[1] * a.shape[1]
    if bound < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if bound <= LONG // 100:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if max(abs(int(exact.max())), abs(int(exact.min()))) > LONG // 100:
        raise OverflowError("a hundred times an inner product does not fit into 64 bits")
    return exact.astype(np.int64)


def _scored(anchors, slots: int, k: int):
    """Best ``k`` rows of every slot of every anchor; ``anchors`` is a broadcast (key, id, label, vectors, limits).

    Without limits the rows wanted are those of the anchor's label but not its id, all in one slot. With limits they are
    those of other labels; the columns are the upper limits of the slots, descending, and the lowest score wanted.
    """
    def run(batches):
        key, id, label, vectors, limits = anchors.value
        best = Best(len(key) * slots, k)
        for batch in batches:
            step = max(TILE // max(len(key), 1), 1)
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, labels = (part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "label"))
                score = _products(vectors, _matrix(part.column("vector"), vectors.shape[1]))
                wanted = label[:, None] == labels[None, :]
                if limits is None:
                    wanted &= id[:, None] != ids[None, :]
                    least = best.worst
                else:
                    wanted = ~wanted & (score <= limits[:, :1])
                    least = np.maximum(limits[:, -1], best.worst.reshape(-1, slots).min(axis=1))
                row, column = np.nonzero(wanted & (score >= least[:, None]))
                found = score[row, column]
                slot = np.zeros(len(row), np.int64)
                for s in range(1, slots):
                    slot += found <= limits[row, s]
                best.add(row * slots + slot, found, ids[column])
        group, score, id = best.cut()
        yield pa.RecordBatch.from_arrays([pa.array(key[group // slots]), pa.array((group % slots).astype(np.int32)), pa.array(score), pa.array(id)],
                                         ["key", "slot", "score", "id"])
    return run


def _best(rows: DataFrame, anchors: DataFrame, rounds: int, slots: int, k: int, name: str) -> DataFrame:
    """``key``, ``slot`` and ``best``, the first ``k`` rows (score, id) of every slot, a round of anchors at a time."""
    spark, parts = rows.sparkSession, None
    width = anchors.agg(F.max(F.size("vector"))).first()[0] or 0
    for n in range(rounds):
        held = anchors.filter(F.col("round") == n).drop("round").toArrow().combine_chunks()
        if not held.num_rows:
            continue
        key, id, label = (held.column(c).to_numpy().astype(np.int64) for c in ("key", "id", "label"))
        limits = np.array(held.column("limits").to_pylist(), np.int64) if "limits" in held.column_names else None
        sent = spark.sparkContext.broadcast((key, id, label, _matrix(held.column("vector").combine_chunks(), width), limits))
        found = stage(rows.mapInArrow(_scored(sent, slots, k), "key long, slot int, score long, id long"), name)
        parts = found if parts is None else parts.unionAll(found)
    if parts is None:
        parts = spark.createDataFrame([], "key long, slot int, score long, id long")
    place = F.row_number().over(Window.partitionBy("key", "slot").orderBy(F.desc("score"), "id"))
    first = parts.withColumn("__place", place).filter(F.col("__place") <= k)
    order = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id")))
    return first.groupBy("key", "slot").agg(F.transform(order, lambda x: F.struct((-x["down"]).alias("score"), x["id"].alias("id"))).alias("best"))


def mine(rows: DataFrame, is_anchor: Column, id: str = "vec_id", vector: str = "vector", label: str = "label", positives: int = 5,
         negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score`` of every anchor (rows where
    ``is_anchor`` holds), each of its first ``positives`` rows of the same label, and the first ``negatives`` rows of another
    label with ``low`` * positive score <= 100 * negative score <= ``high`` * positive score.

    ``vector`` is an array of longs; scores are integer inner products, higher first, ties by smaller id. Vectors of different
    lengths meet as if the shorter one were filled with zeros. Rows with a null id, label, vector or component take no part.
    Rows that share an id are rows of their own, but never positives of an anchor with that id. A positive below zero has an
    empty window. Anchors without positives or negatives give no rows, and so does an empty table. A score above about
    9 * 10^16 is an error. Other columns are not read.
    """
    used = (rows.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"), is_anchor.alias("anchor"))
            .filter("id is not null and label is not null and vector is not null and not exists(vector, x -> x is null)"))
    candidates = used.select("id", "label", "vector")
    anchors = stage(used.filter("anchor").select("id", "label", "vector").withColumn("key", F.monotonically_increasing_id()), "anchors")
    size = anchors.agg(F.sum(8 * F.size("vector") + 32)).first()[0] or 0
    rounds = -(-size // ROUND_BYTES)
    anchors = anchors.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(max(rounds, 1))))

    near = _best(candidates, anchors, rounds, 1, positives, "positives")
    windows = (near.select("key", F.inline("best")).withColumns({"low": F.expr(f"({low} * score + 99) div 100"), "high": F.expr(f"({high} * score) div 100")})
               .filter("score >= 0 and low <= high"))
    windows = stage(windows, "windows")
    # the upper limits of the slots, filled up with one below every score, and the lowest score of any window
    limits = (windows.groupBy("key").agg(F.reverse(F.array_sort(F.collect_set("high"))).alias("high"), F.min("low").alias("low"))
              .withColumn("limits", F.concat(F.col("high"), F.array_repeat(F.lit(-LONG), F.lit(positives) - F.size("high")), F.array("low"))))
    limits = stage(limits, "limits")
    wanted = stage(anchors.join(limits.select("key", "limits"), "key"), "wanted")
    slots = _best(candidates, wanted, rounds, positives, negatives, "negatives")
    merged = slots.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("slot", "best"))).alias("slots"))

    named = windows.join(limits.select("key", F.col("high").alias("tops")), "key").withColumn("slot", F.array_position("tops", F.col("high")) - 1)
    below = F.flatten(F.transform(F.filter("slots", lambda x: x["slot"] >= F.col("slot")), lambda x: x["best"]))
    chosen = named.join(merged, "key").withColumn("below", F.slice(below, 1, negatives))
    ids = anchors.select("key", F.col("id").alias("anchor_id"))
    return (chosen.join(ids, "key").select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "low", F.posexplode("below").alias("place", "n"))
            .filter(F.col("n.score") >= F.col("low"))
            .select("anchor_id", "positive_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
                    "positive_score", F.col("n.score").alias("negative_score")))
