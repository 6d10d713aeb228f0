"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its ``KEPT`` nearest of ``PIVOTS`` pivots, in order. Vectors lie in blocks of bounded
size; within a block each pivot has an inverted file of (vector, place of the pivot in the vector's order). A query
reads the files of its own pivots, which gives the footrule distance of the truncated orders, and reranks the
``RERANK`` share of each block with the smallest footrule by exact distance. The share is of the block, so recall
does not fall as the table grows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldlake.llm.common import stage

PIVOTS = 128  # the usable vectors with the smallest hash of their id: a bounded sample
KEPT = 64
BLOCK = 8192  # vectors of a block, on average
QUERY_BLOCK = 2048  # queries compared with a block at a time, on average
RERANK = 0.1


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """``vec_id, v`` of the vectors that take part: not null, not zero, only finite components, the usual dimension.

    The usual dimension is the most frequent one, the smallest of several. Rows without an id take no part.
    """
    v = F.col("v")
    fine = (v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = (vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
            .filter(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False))))
    top = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    return rows.filter(F.size("v") == (top["dim"] if top else 0))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.empty((0, 0))


def _orders(pivots: np.ndarray, kept: int):
    norms = (pivots ** 2).sum(axis=1)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            distance = norms[None, :] - 2 * _matrix(batch.column("v")) @ pivots.T
            order = np.argsort(distance, axis=1, kind="stable")[:, :kept].astype(np.int16)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(order.ravel()), order.shape[1]).cast(pa.list_(pa.int16()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "pivots"])
    return run


def _cell(k: int, n_pivots: int, share: float):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if data.num_rows and queries.num_rows:
            ids = data.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")  # ties of footrule and of distance go to the smaller id
            ids, v = ids[order], _matrix(data.column("v"))[order]
            perms = _matrix(data.column("pivots"))[order]
            kept = perms.shape[1]
            # inverted files: for each pivot the vectors that hold it and its place there
            by = np.argsort(perms.ravel(), kind="stable")
            edges = np.searchsorted(perms.ravel()[by], np.arange(n_pivots + 1))
            member, place = by // kept, by % kept
            depth = max(20 * k, int(np.ceil(share * len(ids))))
            qid, qv, qp = queries.column("vec_id").to_numpy(), _matrix(queries.column("v")), _matrix(queries.column("pivots"))
            for row in range(len(qid)):
                files = [slice(edges[p], edges[p + 1]) for p in qp[row]]
                near = np.concatenate([member[f] for f in files])
                # the footrule is a constant less twice the sum of kept - max(place, place) over shared pivots
                gain = np.concatenate([kept - np.maximum(place[f], j) for j, f in enumerate(files)])
                shared = np.bincount(near, gain, len(ids))
                key = -shared * len(ids) + np.arange(len(ids))
                found = np.argpartition(key, depth)[:depth] if depth < len(ids) else np.arange(len(ids))
                found = np.sort(found[ids[found] != qid[row]])
                distance = np.sqrt(((v[found] - qv[row]) ** 2).sum(axis=1))
                best = np.argsort(distance, kind="stable")[:k]
                out["query_id"].append(np.full(len(best), qid[row]))
                out["vec_id"].append(ids[found[best]])
                out["score"].append(distance[best])
        return pa.table({n: pa.array(np.concatenate(x) if x else np.empty(0, t), pa.from_numpy_dtype(t))
                         for (n, x), t in zip(out.items(), (np.int64, np.int64, np.float64), strict=True)})
    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding",
            pivots: int = PIVOTS, kept: int = KEPT, share: float = RERANK) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of every query row, by Euclidean distance.

    ``queries`` are rows of ``vectors``. A query never finds its own id. Rows with a repeated id are vectors of their
    own; as a query, such an id stands for the smallest of its vectors. Queries that take no part, and tables without usable vectors, give no rows. Queries are a stated set: they
    meet all blocks of vectors in blocks of their own.
    """
    good = stage(usable(vectors, id, vector), "usable")
    sample = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    empty = "query_id long, rank int, vec_id long, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], empty)
    points = np.array([r["v"] for r in sample], np.float64)
    kind = "vec_id long, v array<double>, pivots array<short>"
    index = stage(good.mapInArrow(_orders(points, min(kept, len(points))), kind), "index")
    asked = stage(index.join(queries.select(F.col(id).cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")
             .groupBy("vec_id").agg(F.min(F.struct("v", "pivots")).alias("x")).select("vec_id", "x.v", "x.pivots"), "queries")
    n, n_asked = index.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    left = (index.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
            .withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long")))))
    right = (asked.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(query_blocks)))
             .withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    found = (left.groupBy("b", "q").cogroup(right.groupBy("b", "q"))
             .applyInArrow(_cell(k, len(points), share), "query_id long, vec_id long, score double"))
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
