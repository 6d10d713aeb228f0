"""Exact per-key ordered operators that do not need a whole key in one task.

A window partition is one task, so a key that holds a third of the rows would be one
task too. Every helper here therefore splits such *hot* keys into time chunks first:

* a key is hot when it holds more than ROWS_PER_TASK rows, counted, whatever its share, and it is
  cut into as many chunks as its rows need. There are at most as many hot keys as the input has
  multiples of ROWS_PER_TASK; their tables carry no broadcast hint;
* cut points are approximate quantiles of the order column (a mergeable sketch), so
  chunks are balanced whatever the distribution; they only decide where work is split,
  never what the answer is;
* what a chunk needs from its predecessors (a halo of rows, a prefix total, a state) is
  computed from per-chunk summaries, one row per chunk.

Keys are counted on every input, by a partial aggregate; no size estimate decides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.session import cut_lineage

ROWS_PER_TASK = 1_000_000
CHUNK = "__chunk"


def _match(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys],
                  F.lit(True))


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int = ROWS_PER_TASK) -> DataFrame:
    """Keys with more than ``min_rows`` rows, and their number of rows ``__n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > min_rows)


def with_chunk(df: DataFrame, keys: Sequence[str], order: str, split: bool | None = None,
               min_rows: int = ROWS_PER_TASK, chunks: int | None = None) -> tuple[DataFrame, bool]:
    """Adds ``__chunk`` (0 for ordinary keys) and says whether any key was split.

    ``order`` must be numeric; rows with equal order stay in one chunk, so tie breakers
    keep their meaning inside it. The number of chunks follows the largest key. Only a caller
    that knows its keys to be small passes ``split=False``.
    """
    if split is False:
        return df.withColumn(CHUNK, F.lit(0)), False
    hot = hot_keys(df, keys, min_rows)
    largest = hot.agg(F.max("__n")).first()[0]
    if largest is None:
        return df.withColumn(CHUNK, F.lit(0)), False
    chunks = chunks or -(-largest // min_rows)
    probabilities = [(i + 1) / chunks for i in range(chunks - 1)]
    rows = df.select(*keys, order).alias("d").join(
        hot.select(*keys).alias("h"), _match("d", "h", keys), "left_semi")
    cuts = rows.groupBy(*keys).agg(F.array_sort(F.array_distinct(
        F.percentile_approx(order, probabilities, max(10_000, 20 * chunks)))).alias("__cuts"))
    joined = df.alias("d").join(cuts.alias("c"), _match("d", "c", keys), "left")
    steps = F.array(*[F.lit(1 << p) for p in reversed(range(max(1, (chunks - 1).bit_length())))])
    value, edges = F.col(f"d.{order}"), F.col("c.__cuts")
    position = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(
        (pos + step <= F.size(edges)) & (F.get(edges, pos + step - 1) <= value), pos + step).otherwise(pos))
    chunk = F.when(edges.isNull() | value.isNull(), F.lit(0)).otherwise(position)
    return joined.select("d.*", chunk.cast("int").alias(CHUNK)), True


def _window(keys, order):
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def _prefix(summary: DataFrame, keys) -> Window:
    """Chunks before this one; a hot key has one per ROWS_PER_TASK of its rows."""
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _attach(df: DataFrame, carry: DataFrame, keys) -> DataFrame:
    """Join the per-chunk carry: one row per chunk of a hot key."""
    right = carry.filter(F.col(CHUNK) > 0)
    names = [c for c in carry.columns if c not in (*keys, CHUNK)]
    return (df.alias("d").join(right.alias("k"),
                               _match("d", "k", [*keys, CHUNK]), "left")
            .select("d.*", *[F.col(f"k.{n}") for n in names]))


def with_frame(df: DataFrame, keys: Sequence[str], order: Sequence[str], back: int, columns: dict[str, Callable],
               split: bool | None = None, **chunking) -> DataFrame:
    """Window expressions that look at most ``back`` rows behind.

    ``columns`` maps a name to ``f(window) -> Column``, the window being ordered and
    partitioned but without a frame. ``order`` starts with a numeric column.
    """
    data, was_split = with_chunk(df, keys, order[0], split, **chunking)
    if not was_split:
        window = Window.partitionBy(*keys).orderBy(*order)
        return data.drop(CHUNK).select("*", *[f(window).alias(n) for n, f in columns.items()])
    names = df.columns
    row = F.struct(*names)
    newest = Window.partitionBy(*keys, CHUNK).orderBy(*[F.desc(c) for c in order])
    tails = (data.withColumn("__r", F.row_number().over(newest)).filter(F.col("__r") <= back)
             .groupBy(*keys, CHUNK).agg(F.sort_array(F.collect_list(F.struct(F.lit(-1) * F.col("__r"), row.alias("row")))
                                                     ).alias("__tail")))
    behind = _prefix(tails, keys).rowsBetween(-back, -1)
    halo = (tails.withColumn("__halo", F.flatten(F.collect_list("__tail").over(behind)))
            .select(*keys, CHUNK, F.explode(F.slice("__halo", F.greatest(F.lit(1), F.size("__halo") - back + 1),
                                                    back)).alias("h"))
            .select(CHUNK, "h.row.*").select(*names, CHUNK, F.lit(True).alias("__halo")))
    every = data.select(*names, CHUNK, F.lit(False).alias("__halo")).unionByName(halo)
    window = _window(keys, order)
    return (every.select("*", *[f(window).alias(n) for n, f in columns.items()])
            .filter(~F.col("__halo")).drop(CHUNK, "__halo"))


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence, by: str, name: str = "rn",
                split: bool | None = None, **chunking) -> DataFrame:
    """``row_number`` per key, ordered by ``order`` whose leading column is the numeric ``by`` ascending."""
    data, was_split = with_chunk(df, keys, by, split, **chunking)
    if not was_split:
        return data.drop(CHUNK).withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    sizes = data.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    before = _prefix(sizes, keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, CHUNK, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    local = data.withColumn("__rn", F.row_number().over(_window(keys, order)))
    return (_attach(local, carry, keys)
            .withColumn(name, (F.col("__rn") + F.coalesce("__before", F.lit(0))).cast("bigint"))
            .drop(CHUNK, "__rn", "__before"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: dict[str, tuple[str, Column]],
            include_current: bool = True, split: bool | None = None, **chunking) -> DataFrame:
    """Running ``sum``/``max``/``min``/``count`` per key: local prefix plus the total of earlier chunks."""
    data, was_split = with_chunk(df, keys, order[0], split, **chunking)
    functions = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
    end = 0 if include_current else -1
    frame = _window(keys, order).rowsBetween(Window.unboundedPreceding, end)
    local = data.select("*", *[functions[kind](expr).over(frame).alias(n) for n, (kind, expr) in totals.items()])
    if not was_split:
        return local.drop(CHUNK)
    parts = data.groupBy(*keys, CHUNK).agg(*[functions[k](e).alias(f"__{n}") for n, (k, e) in totals.items()])
    before = _prefix(parts, keys).rowsBetween(Window.unboundedPreceding, -1)
    merge = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}
    carry = parts.select(*keys, CHUNK, *[merge[k](f"__{n}").over(before).alias(f"__{n}") for n, (k, _) in totals.items()])
    out = _attach(local, carry, keys)
    for n, (kind, _) in totals.items():
        a, b = F.col(n), F.col(f"__{n}")
        if kind in ("sum", "count"):
            both = F.when(a.isNull() & b.isNull(), None).otherwise(
                F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
        else:
            both = F.greatest(a, b) if kind == "max" else F.least(a, b)
        out = out.withColumn(n, both).drop(f"__{n}")
    return out.drop(CHUNK)


def moments_before(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   split: bool | None = None, **chunking) -> DataFrame:
    """Count, mean and sample deviation of ``value`` over the rows before the current one.

    Chunk summaries merge by Chan's formula, so the result does not lose digits the way
    running sums of squares would.
    """
    data, was_split = with_chunk(df, keys, order[0], split, **chunking)
    frame = _window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    v = F.col(value)
    if not was_split:
        return data.select("*", F.count(v).over(frame).alias("prior_n"), F.avg(v).over(frame).alias("prior_mean"),
                           F.stddev_samp(v).over(frame).alias("prior_std")).drop(CHUNK)
    local = data.select("*", F.count(v).over(frame).alias("__n"), F.avg(v).over(frame).alias("__m"),
                        (F.var_pop(v).over(frame) * F.count(v).over(frame)).alias("__s"))
    parts = data.groupBy(*keys, CHUNK).agg(F.count(v).alias("n"), F.avg(v).alias("m"),
                                           (F.var_pop(v) * F.count(v)).alias("s"))
    before = _prefix(parts, keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (parts.withColumn("__parts", F.collect_list(F.struct("n", "m", "s")).over(before))
             .select(*keys, CHUNK, F.aggregate(
                 F.filter("__parts", lambda p: p["n"] > 0), _moments(F.lit(0), F.lit(0.0), F.lit(0.0)),
                 lambda a, p: _merge(a, p)).alias("__carry")))
    out = _attach(local, carry, keys)
    here = _moments(F.col("__n"), F.coalesce("__m", F.lit(0.0)), F.coalesce("__s", F.lit(0.0)))
    prior = F.coalesce(F.col("__carry"), _moments(F.lit(0), F.lit(0.0), F.lit(0.0)))
    out = out.withColumn("__all", _merge(prior, here))
    n = F.col("__all.n")
    return out.select(*df.columns, n.alias("prior_n"), F.when(n > 0, F.col("__all.m")).alias("prior_mean"),
                      F.when(n > 1, F.sqrt(F.col("__all.s") / F.nullif(n - 1, F.lit(0)))).alias("prior_std"))


def _moments(n, m, s):
    return F.struct(n.cast("bigint").alias("n"), m.cast("double").alias("m"), s.cast("double").alias("s"))


def _merge(a, b):
    n = a["n"] + b["n"]
    gap = b["m"] - a["m"]
    share = b["n"] / F.nullif(n.cast("double"), F.lit(0.0))
    return _moments(n, F.coalesce(a["m"] + gap * share, F.lit(0.0)),
                    F.coalesce(a["s"] + b["s"] + gap * gap * a["n"] * share, F.lit(0.0)))


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
         step: Callable[[pd.DataFrame, object], tuple[pd.DataFrame, tuple | None]],
         schema: T.StructType, state: str, split: bool | None = None, **chunking) -> DataFrame:
    """A recurrence per key: ``step(rows, state) -> (rows out, state)`` in row order.

    ``state`` is the DDL of the state tuple; ``None`` starts a key. Rows stream through Python in
    sorted Arrow batches and the state is carried from slice to slice, so memory does not grow
    with a key. Hot keys are solved by fixed-point iteration: all chunks run in parallel from the
    state their predecessor last ended in, until no chunk's entry state changes. Each round makes
    at least one more chunk final, and recurrences that forget their past settle in two or three,
    so the result is the sequential one. Each round re-reads the hot keys only.
    """
    data, was_split = with_chunk(df, keys, order[0], split, **chunking)
    keys, order, names = list(keys), list(order), list(df.columns)
    fields = T.StructType.fromDDL(state).fields
    slots = [f"__s_{f.name}" for f in fields]
    group = "__group"

    def sorted_rows(rows: DataFrame) -> DataFrame:
        return (rows.withColumn(group, F.xxhash64(*keys, CHUNK)).repartition(*keys, CHUNK)
                .sortWithinPartitions(group, *keys, CHUNK, *order))

    def slices(batches):
        """(group, rows, is it a new group) over consecutive batches."""
        last = None
        for pdf in batches:
            if not len(pdf):
                continue
            marks = pdf[group].to_numpy()
            edges = np.flatnonzero(np.append(True, marks[1:] != marks[:-1])).tolist() + [len(pdf)]
            for start, end in zip(edges, edges[1:]):
                yield marks[start], pdf.iloc[start:end], marks[start] != last
                last = marks[start]

    def entry_of(part: pd.DataFrame):
        if "__known" not in part or part["__known"].iloc[0] is not True and part["__known"].iloc[0] != 1:
            return None
        return tuple(part[c].iloc[0] for c in slots)

    def output(batches):
        current = None
        for _, part, fresh in slices(batches):
            current = entry_of(part) if fresh else current
            out, current = step(part[names], current)
            yield out[schema.fieldNames()]

    if not was_split:
        return sorted_rows(data).mapInPandas(output, schema)

    exit_schema = T.StructType([*[df.schema[k] for k in keys], T.StructField(CHUNK, T.IntegerType()),
                                *[T.StructField(c, f.dataType) for c, f in zip(slots, fields)], T.StructField("__known", T.BooleanType())])

    def exits(batches):
        head, current = None, None

        def row():
            values = current if current is not None else [None] * len(slots)
            return pd.DataFrame([[*head, *values, current is not None]], columns=exit_schema.fieldNames())
        for _, part, fresh in slices(batches):
            if fresh:
                if head is not None:
                    yield row()
                head, current = [part[k].iloc[0] for k in keys] + [int(part[CHUNK].iloc[0])], entry_of(part)
            _, current = step(part[names], current)
        if head is not None:
            yield row()

    def with_entries(rows: DataFrame, entries: DataFrame) -> DataFrame:
        return (rows.alias("d").join(entries.alias("e"), _match("d", "e", [*keys, CHUNK]), "left")
                .select("d.*", *[F.col(f"e.{c}") for c in [*slots, "__known"]]))

    hot = hot_keys(df, keys, chunking.get("min_rows", ROWS_PER_TASK)).select(*keys)
    hot_rows = data.alias("d").join(hot.alias("h"), _match("d", "h", keys), "left_semi")
    blank = [F.lit(None).cast(f.dataType).alias(c) for c, f in zip(slots, fields)]
    entries = cut_lineage(hot_rows.select(*keys, CHUNK).distinct().select("*", *blank, F.lit(False).alias("__known")))
    after = Window.partitionBy(*keys).orderBy(CHUNK)
    while True:  # every round settles at least one more chunk of every key
        ended = sorted_rows(with_entries(hot_rows, entries)).mapInPandas(exits, exit_schema)
        moved = cut_lineage(ended.select(*keys, CHUNK, *[F.lag(c).over(after).alias(c) for c in slots],
                                         F.coalesce(F.lag("__known").over(after), F.lit(False)).alias("__known")))
        same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in slots],
                      F.col("a.__known") == F.col("b.__known"))
        changed = moved.alias("a").join(entries.alias("b"), _match("a", "b", [*keys, CHUNK])).filter(~same)
        entries = moved
        if changed.isEmpty():
            break
    return sorted_rows(with_entries(data, entries)).mapInPandas(output, schema)


def decayed(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, alpha: float, name: str, split: bool | None = None, **chunking) -> DataFrame:
    """Adds y with y = alpha x + (1 - alpha) y of the row before, per key in row order, seeded by the first x.

    The step is affine, so a chunk as a whole is too: it leaves (1 - alpha)^n of what enters it plus its own part. Chunks behind the
    first are smoothed from zero in the same pass, the chunks of a key are composed from one row per chunk, and what enters a chunk is
    added to its rows with the weight that is left. No rounds: Python reads every row once.
    """
    data, was_split = with_chunk(df, keys, order[0], split, **chunking)
    keys, group = list(keys), "__group"
    schema = T.StructType([*data.schema.fields, T.StructField(name, T.DoubleType()), T.StructField("__k", T.LongType())])
    rows = (data.withColumn(group, F.xxhash64(*keys, CHUNK)).repartition(*keys, CHUNK).sortWithinPartitions(group, *keys, CHUNK, *order))

    def smooth(batches):
        last, y, k = None, None, 0
        for pdf in batches:
            marks, out = list(pdf[[*keys, CHUNK]].astype(str).itertuples(index=False, name=None)), []
            edges = [n for n in range(len(pdf)) if not n or marks[n] != marks[n - 1]] + [len(pdf)]
            for a, b in zip(edges, edges[1:], strict=False):
                part = pdf.iloc[a:b]
                if marks[a] != last:
                    last, y, k = marks[a], None if part[CHUNK].iloc[0] == 0 else 0.0, 0
                x = part[value].to_numpy("float64")
                z = pd.Series(x if y is None else np.append(y, x)).ewm(alpha=alpha, adjust=False).mean().to_numpy()[-len(x):]
                out.append(part.assign(**{name: z, "__k": np.arange(k + 1, k + 1 + len(x))}))
                y, k = float(z[-1]), k + len(x)
            if out:
                yield pd.concat(out)[schema.fieldNames()]

    local = rows.mapInPandas(smooth, schema)
    if not was_split:
        return local.select(*df.columns, name)
    left = lambda n: F.pow(F.lit(1.0 - alpha), n)  # noqa: E731  weight of what was there n rows before
    chunks = local.groupBy(*keys, CHUNK).agg(F.min_by(value, "__k").cast("double").alias("first"), F.max("__k").alias("n"), F.max_by(name, "__k").alias("part"))
    before = F.collect_list(F.struct(F.col(CHUNK).alias("chunk"), "first", "n", "part")).over(_prefix(chunks, keys).rowsBetween(Window.unboundedPreceding, -1))
    # what comes first of a key enters with its first value
    step = lambda y, c: F.when(c["chunk"] == 0, c["part"]).otherwise(left(c["n"]) * F.coalesce(y, c["first"]) + c["part"])
    carry = chunks.withColumn("__before", before).select(*keys, CHUNK, F.coalesce(F.aggregate("__before", F.lit(None).cast("double"), step), "first").alias("__in"))
    added = F.when(F.col(CHUNK) > 0, left(F.col("__k")) * F.col("__in")).otherwise(0.0)
    return _attach(local, carry, keys).withColumn(name, F.col(name) + added).select(*df.columns, name)


def same_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys of which a null equals a null; the keys come from the left side."""
    added = [c for c in right.columns if c not in keys]
    return (left.alias("l").join(right.alias("r"), _match("l", "r", keys), how)
            .select("l.*", *[F.col(f"r.{c}") for c in added]))


def latest_per(df: DataFrame, keys: Sequence[str], *order, newest: bool = True) -> DataFrame:
    """First or last row per key by ``order``: an aggregate, so map tasks keep one row per key."""
    rank = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if newest else F.min_by
    return df.groupBy(*keys).agg(pick(F.struct(*df.columns), rank).alias("__row")).select("__row.*")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. Every map task keeps n rows of a key before the shuffle (a window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= n)


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join of a left side with hot keys: adaptive execution splits their partitions by measured size.

    ``forceOptimizeSkewedJoin`` (see ``session.SETTINGS``) lets it do so below an aggregate on the same keys too.
    """
    return left.join(right, list(on), how)
