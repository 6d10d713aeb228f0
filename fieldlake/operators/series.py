"""Ordered series per device, animal or scope."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.config import ALERTS, ANALYTICS, DAY_MS, RISK, RiskConfig
from fieldlake.operators import scale


def rolling_mean(df: DataFrame, keys, value: str, n: int = ANALYTICS.rolling_rows,
                 order=("recorded_epoch_ms", "id"), name: str | None = None, **kw) -> DataFrame:
    """Mean of the current row and the ``n - 1`` before it, per key."""
    return scale.with_frame(df, keys, order, n - 1, {
        name or f"{value}_rolling": lambda w: F.avg(value).over(w.rowsBetween(-(n - 1), 0))}, **kw)


def hampel(df: DataFrame, keys, value: str, order=("recorded_epoch_ms", "id"), window: int = 11, k: float = 3.0,
           name: str | None = None, **kw) -> DataFrame:
    """Hampel filter over a trailing window that includes the row itself.

    Raw until the window is full; the window median when the deviation is zero or the row
    lies more than ``k`` scaled deviations away. Rows without a value do not enter windows.
    """
    half = window // 2

    def median(arr):
        s = F.array_sort(arr)
        return F.get(s, F.lit(half)) if window % 2 else (F.get(s, F.lit(half - 1)) + F.get(s, F.lit(half))) / 2.0

    tmp = "__recent"
    rows = scale.with_frame(df.filter(F.col(value).isNotNull()), keys, order, window - 1, {
        tmp: lambda w: F.collect_list(value).over(w.rowsBetween(-(window - 1), 0))}, **kw)
    rows = rows.withColumn("__mid", median(F.col(tmp)))
    rows = rows.withColumn("__mad", F.lit(1.4826) * median(F.transform(F.col(tmp), lambda x: F.abs(x - F.col("__mid")))))
    x = F.col(value)
    out = (F.when(F.size(tmp) < window, x).when(F.col("__mad") == 0, F.col("__mid"))
           .when(F.abs(x - F.col("__mid")) > F.lit(k) * F.col("__mad"), F.col("__mid")).otherwise(x))
    return rows.withColumn(name or f"{value}_hampel", out).drop(tmp, "__mid", "__mad")


def ema(df: DataFrame, keys, value: str, alpha: float, order=("recorded_epoch_ms", "id"), name: str | None = None,
        **kw) -> DataFrame:
    """Exponential smoothing seeded by the first value of each key."""
    return scale.decayed(df.filter(F.col(value).isNotNull()), keys, order, value, alpha, name or f"{value}_ema", **kw)


def stress_scores(df: DataFrame, metrics, location: str = "location_id", time: str = "recorded_at",
                  order=("recorded_epoch_ms", "id"), **kw) -> DataFrame:
    """One row per reading and metric: z against the readings before it at the same place and month."""
    long = df.select(location, F.month(time).alias("month"), *order, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("p"))
    long = long.select(location, "month", *order, "p.metric", "p.value").filter(F.col("value").isNotNull())
    base = scale.moments_before(long, [location, "month", "metric"], list(order), "value", **kw)
    std = F.coalesce("prior_std", F.lit(0.0))
    z = F.when(std == 0, F.lit(0.0)).otherwise((F.col("value") - F.coalesce("prior_mean", F.lit(0.0))) / F.nullif(std, F.lit(0.0)))
    return base.withColumn("z", z)


def stress_flags(df: DataFrame, metrics, location: str = "location_id", time: str = "recorded_at",
                 order=("recorded_epoch_ms", "id"), threshold: float = 2.5, **kw) -> DataFrame:
    """Reading-level flag: any metric more than ``threshold`` deviations from its own history."""
    scores = stress_scores(df, metrics, location, time, order, **kw)
    hit = F.abs("z") > threshold
    return scores.groupBy(location, *order).agg(
        F.max(hit.cast("int")).cast("boolean").alias("stress"),
        F.count(F.when(hit, 1)).alias("triggered_metrics"))


def impute(df: DataFrame, keys, axis: str, value: str, method: str = "forward_fill", max_gap: int = ANALYTICS.max_gap) -> DataFrame:
    """Fill gaps of a dense series, ``data`` and ``imputed`` beside the raw value.

    Leading gaps and gaps longer than ``max_gap`` stay null; a trailing gap carries the last
    value under either method. A series has at most the chart's point budget.
    """
    if method == "none":
        return df.withColumn("data", F.col(value)).withColumn("imputed", F.lit(False))
    window = Window.partitionBy(*keys).orderBy(axis)
    back, ahead = window.rowsBetween(Window.unboundedPreceding, 0), window.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*keys)
    known = F.col(value).isNotNull()
    rows = df.withColumn("__i", F.row_number().over(window))
    rows = rows.select("*", F.last(value, True).over(back).alias("__l"), F.last(F.when(known, F.col("__i")), True).over(back).alias("__li"),
                       F.first(value, True).over(ahead).alias("__r"), F.first(F.when(known, F.col("__i")), True).over(ahead).alias("__ri"),
                       F.max("__i").over(whole).alias("__last"))
    gap = F.coalesce("__ri", F.col("__last") + 1) - F.col("__li") - 1
    fillable = ~known & F.col("__li").isNotNull() & (gap <= max_gap)
    if "aggregate" in df.columns:
        fillable = fillable & (F.col("aggregate") == "avg")
    carried = F.col("__l")
    if method == "linear":
        share = (F.col("__i") - F.col("__li")) / F.nullif((F.col("__ri") - F.col("__li")).cast("double"), F.lit(0.0))
        carried = F.coalesce(F.col("__l") + (F.col("__r") - F.col("__l")) * share, F.col("__l"))
    elif method != "forward_fill":
        raise ValueError(f"unknown imputation {method!r}")
    return (rows.withColumn("data", F.when(known, F.col(value)).when(fillable, carried)).withColumn("imputed", fillable)
            .drop("__i", "__l", "__li", "__r", "__ri", "__last"))


def track_segments(df: DataFrame, keys=("animal_id",), order=("recorded_epoch_ms", "id"), **kw) -> DataFrame:
    """Consecutive fixes as segments; a fix that did not move starts none."""
    names = ("latitude", "longitude", order[0])
    located = df.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    rows = scale.with_frame(located, keys, order, 1, {
        f"from_{n}": (lambda w, n=n: F.lag(n).over(w)) for n in names}, **kw)
    moved = (F.col("from_latitude") != F.col("latitude")) | (F.col("from_longitude") != F.col("longitude"))
    return rows.filter(F.col("from_latitude").isNotNull() & moved)


def herd_decline(series: DataFrame, keys=("species_id",), axis: str = "day_index", value: str = "herd_count",
                 longest: int = RISK.herd_window) -> DataFrame:
    """1 - last/first of the moving averages (full windows of min(7, n/2) days), floored at 0."""
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(axis)
    rows = series.select(*keys, axis, value, F.count(F.lit(1)).over(whole).alias("n"), F.row_number().over(ordered).alias("i"))
    size = F.least(F.lit(longest), F.floor(F.col("n") / 2)).cast("int")
    rows = rows.withColumn("size", size).filter(F.col("size") >= 1)
    ends = rows.groupBy(*keys).agg(
        F.avg(F.when(F.col("i") <= F.col("size"), F.col(value))).alias("first_average"),
        F.avg(F.when(F.col("i") > F.col("n") - F.col("size"), F.col(value))).alias("last_average"))
    fall = F.when(F.col("first_average") > 0, F.greatest(
        F.lit(0.0), F.lit(1.0) - F.col("last_average") / F.nullif("first_average", F.lit(0.0))))
    return ends.withColumn("decline", fall)


def population_trend(series: DataFrame, keys=("species_id",), axis: str = "day_index", value: str = "herd_count",
                     cfg: RiskConfig = RISK) -> DataFrame:
    """First half against last half, ±5 %, from four points on."""
    whole, ordered = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy(axis)
    rows = series.select(*keys, value, F.count(F.lit(1)).over(whole).alias("n"), F.row_number().over(ordered).alias("i"))
    half = F.floor(F.col("n") / 2)
    means = rows.groupBy(*keys).agg(
        F.max("n").alias("points"), F.avg(F.when(F.col("i") <= half, F.col(value))).alias("earlier"),
        F.avg(F.when(F.col("i") > F.col("n") - half, F.col(value))).alias("later"))
    change = (F.col("later") - F.col("earlier")) / F.nullif("earlier", F.lit(0.0))
    trend = (F.when(F.col("points") < 4, None)
             .when(F.col("earlier") <= 0, F.when(F.col("later") > 0, "INCREASING").otherwise("STABLE"))
             .when(change <= -cfg.trend_threshold, "DECLINING").when(change >= cfg.trend_threshold, "INCREASING")
             .otherwise("STABLE"))
    return means.withColumn("population_trend", trend)


def seasonal_baseline(daily: DataFrame, scopes: DataFrame, metrics, key: str = "h3_cell", scope_cols=("scope_id",),
                      cfg: RiskConfig = RISK) -> DataFrame:
    """Mean and spread of each metric in the same season of earlier years, per scope.

    ``daily`` has (key, day_index, metrics); scopes have (scope_cols, key, window_start_ms,
    window_end_ms). Scopes are exploded over the years, never the readings. Short histories
    fall back to the spread of all earlier days.
    """
    day = F.col("day_index") * DAY_MS
    long = daily.select(key, day.alias("day_ms"), F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("p")
                        ).select(key, "day_ms", "p.*").filter(F.col("value").isNotNull())
    span = int(cfg.climate_days * DAY_MS)
    reach = int((cfg.baseline_years * 365.2425 + cfg.climate_days) * DAY_MS)
    keyed = scopes.select(*scope_cols, key, "window_start_ms", "window_end_ms")
    history = long.join(keyed, key).filter(
        (F.col("day_ms") >= F.col("window_end_ms") - reach - DAY_MS) & (F.col("day_ms") < F.col("window_start_ms")))
    offsets = F.array(*[F.lit(int(k * 365.2425 * DAY_MS)) for k in range(1, cfg.baseline_years + 1)])
    year = F.filter(F.transform(offsets, lambda o, i: F.when(
        (F.col("day_ms") <= F.col("window_end_ms") - o) & (F.col("day_ms") > F.col("window_end_ms") - o - span), i)),
        lambda i: i.isNotNull())
    history = history.withColumn("years", year)
    everything = history.groupBy(*scope_cols, "metric").agg(
        F.count(F.lit(1)).alias("all_n"), F.avg("value").alias("all_mean"), F.stddev_samp("value").alias("all_std"))
    windows = (history.withColumn("year", F.explode("years")).groupBy(*scope_cols, "metric", "year")
               .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), (F.var_pop("value") * F.count(F.lit(1))).alias("ss"),
                    F.sum("value").alias("total"))
               .filter(F.col("n") >= cfg.minimum_baseline_days))
    seasons = windows.groupBy(*scope_cols, "metric").agg(
        F.count(F.lit(1)).alias("years"), F.avg("m").alias("mean"), F.stddev_samp("m").alias("spread"),
        F.sum("n").alias("days"), F.sum("total").alias("total"), F.sum("ss").alias("within"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("square"))
    grand = F.col("total") / F.col("days")
    daily_std = F.sqrt(F.greatest(F.lit(0.0), F.col("within") + F.col("square") - F.col("days") * grand * grand)
                       / F.nullif(F.col("days") - 1, F.lit(0)))
    seasons = seasons.withColumn("daily_std", daily_std)
    out = everything.filter(F.col("all_n") >= cfg.minimum_baseline_days).join(seasons, [*scope_cols, "metric"], "left")
    enough = F.coalesce(F.col("years") >= cfg.minimum_baseline_years, F.lit(False))
    floor = F.col("daily_std") / F.sqrt(F.col("days") / F.nullif(F.col("years").cast("double"), F.lit(0.0)))
    out = out.select(*scope_cols, "metric",
                     F.when(enough, F.col("mean")).otherwise(F.col("all_mean")).alias("baseline_mean"),
                     F.when(enough, F.greatest("spread", floor)).otherwise(F.col("all_std")).alias("baseline_std"),
                     F.when(enough, F.col("daily_std")).otherwise(F.col("all_std")).alias("baseline_daily_std"),
                     F.when(enough, F.col("years")).otherwise(F.col("all_n")).alias("baseline_samples"))
    return (out.filter(F.col("baseline_std") > 1e-9)
            .withColumn("baseline_daily_std", F.when(F.col("baseline_daily_std") > 1e-9, F.col("baseline_daily_std"))))


def islands(df: DataFrame, keys, start: str, end: str, gap_ms: int, tie: str, **kw) -> DataFrame:
    """Adds ``island_start``: rows whose start is within ``gap_ms`` of the latest end so far share one."""
    seen = scale.running(df, keys, [start, tie], {"__reach": ("max", F.col(end))}, include_current=False, **kw)
    fresh = F.col("__reach").isNull() | (F.col(start) - F.lit(gap_ms) > F.col("__reach"))
    opened = seen.withColumn("__open", F.when(fresh, F.col(start)))
    return (scale.running(opened, keys, [start, tie], {"island_start": ("max", F.col("__open"))}, **kw)
            .drop("__reach", "__open"))


def debounce_events(df: DataFrame, keys, seg_ms: int, gap_ms: int, start: str = "detected_epoch_ms", window_id: str = "id",
                    **kw) -> DataFrame:
    """Windows of one sound merged into events: a window within ``gap_ms`` of the event's end extends it."""
    rows = df.withColumn("__end", F.col(start) + F.lit(seg_ms))
    marked = islands(rows, keys, start, "__end", gap_ms, window_id, **kw)
    return marked.groupBy(*keys, "island_start").agg(
        F.min(start).alias("start_ms"), F.max("__end").alias("end_ms"), F.max("confidence").alias("confidence"),
        F.countDistinct(window_id).alias("window_count")).drop("island_start")


def suppress_alerts(df: DataFrame, keys=("event_type", "classification", "zone"), time: str = "ts_ms", tie: str = "event_id",
                    window_ms: int = int(ALERTS.duplicate_sec * 1000), top: str = ALERTS.priorities[-1], **kw) -> DataFrame:
    """Drop repeats of an alert within 30 s of the last one of its kind, suppressed ones included.

    Top-priority alerts always pass and never touch the timer.
    """
    rows = df.withColumn("__zone", F.coalesce(F.col(keys[-1]), F.lit("*")))
    group = [*keys[:-1], "__zone"]
    calm = scale.with_frame(rows.filter(F.col("priority") != top), group, [time, tie], 1, {
        "__last": lambda w: F.lag(time).over(w)}, **kw)
    passed = calm.filter(F.col("__last").isNull() | (F.col(time) - F.col("__last") >= window_ms)).drop("__last")
    return passed.unionByName(rows.filter(F.col("priority") == top)).drop("__zone")


def cooldown(df: DataFrame, keys, time: str = "ts_ms", tie: str = "id", window_ms: int = int(ALERTS.wake_cooldown_sec * 1000),
             **kw) -> DataFrame:
    """Greedy rate limit: a row is accepted when ``window_ms`` have passed since the last *accepted* one.

    A row that follows its predecessor by at least the window is accepted whatever came
    before, so a key falls apart into independent bursts; only bursts are replayed in order.
    """
    gaps = scale.with_frame(df, keys, [time, tie], 1, {"__gap": lambda w: F.col(time) - F.lag(time).over(w)}, **kw)
    first = F.col("__gap").isNull() | (F.col("__gap") >= window_ms)
    bursts = scale.running(gaps.withColumn("__first", F.when(first, F.col(time))), keys, [time, tie],
                           {"__burst": ("max", F.col("__first"))}, **kw).drop("__gap", "__first")
    schema = T.StructType([*bursts.schema.fields, T.StructField("accepted", T.BooleanType())])

    def step(pdf: pd.DataFrame, state):
        times = pdf[time].to_numpy("int64")
        keep = np.zeros(len(times), bool)
        last, at = (state[0] if state else None), 0
        while at < len(times):
            if last is not None:
                at = int(np.searchsorted(times, last + window_ms, side="left"))
                if at >= len(times):
                    break
            keep[at] = True
            last = int(times[at])
        return pdf.assign(accepted=keep), ((last,) if last is not None else None)

    return scale.scan(bursts, [*keys, "__burst"], [time, tie], step, schema, "accepted_at bigint", **kw).drop("__burst")


def previous_assessment(df: DataFrame, keys=("species_id", "h3_cell"), max_days: float = RISK.momentum_lookback_days,
                        time: str = "period_end_epoch_ms", tie: str = "id", carry=("conservation_risk_index",), **kw) -> DataFrame:
    """Each row with the newest assessment of its (species, cell) that ended strictly earlier, at most 90 days."""
    ends = df.groupBy(*keys, time).agg(F.max_by(F.struct(*carry), tie).alias("__row"))
    pairs = scale.with_frame(ends, keys, [time], 1, {
        "__prev_row": lambda w: F.lag("__row").over(w), "__prev_ms": lambda w: F.lag(time).over(w)}, **kw)
    near = F.col(time) - F.col("__prev_ms") <= int(max_days * DAY_MS)
    pairs = pairs.select(*keys, time, F.when(near, F.col("__prev_ms")).alias("previous_end_ms"),
                         *[F.when(near, F.col(f"__prev_row.{c}")).alias(f"previous_{c}") for c in carry])
    return df.join(pairs, [*keys, time], "left")


def momentum(df: DataFrame, cfg: RiskConfig = RISK, cri: str = "conservation_risk_index", prev: str = "previous_conservation_risk_index",
             time: str = "period_end_epoch_ms", previous_slope: str | None = None) -> DataFrame:
    """ΔCRI, slope per day over the real gap, acceleration and trajectory. Indices run 0-100."""
    days = F.coalesce((F.col(time) - F.col("previous_end_ms")) / F.lit(float(DAY_MS)), F.lit(cfg.momentum_window_days))
    delta = F.coalesce(F.col(cri) - F.col(prev), F.lit(0.0))
    rows = df.withColumn("momentum_window_days", days).withColumn("delta_cri", delta)
    slope = F.col("delta_cri") / F.nullif("momentum_window_days", F.lit(0.0))
    rows = rows.withColumn("risk_momentum_per_day", slope)
    if previous_slope is not None:
        rows = rows.withColumn("acceleration_per_day", (F.col("risk_momentum_per_day") - F.col(previous_slope))
                               / F.nullif("momentum_window_days", F.lit(0.0)))
    unit = F.col("risk_momentum_per_day") / 100.0
    return rows.withColumn("trajectory", F.when(unit > cfg.momentum_tolerance, "ACCELERATING")
                           .when(unit < -cfg.momentum_tolerance, "DECAYING").otherwise("STABLE"))


def last_known(df: DataFrame, keys, axis: str, value: str) -> DataFrame:
    """Newest point of each series that has a value."""
    return (df.filter(F.col(value).isNotNull()).groupBy(*keys)
            .agg(F.max(axis).alias(axis), F.max_by(value, axis).alias(value)))


def minmax(df: DataFrame, value: str, keys=(), name: str | None = None) -> DataFrame:
    """(v - min) / (max - min); all equal gives 0.5, null stays null."""
    name = name or f"{value}_norm"
    low, high = F.col("__low"), F.col("__high")
    ends = df.groupBy(*keys).agg(F.min(value).alias("__low"), F.max(value).alias("__high"))
    if keys:
        rows = df.join(ends, list(keys), "left")
    else:
        rows = df.withColumn("__low", ends.select("__low").scalar()).withColumn("__high", ends.select("__high").scalar())
    v = F.col(value)
    scaled = F.when(v.isNull(), None).when(high == low, F.lit(0.5)).otherwise((v - low) / F.nullif(high - low, F.lit(0.0)))
    return rows.withColumn(name, scaled).drop("__low", "__high")


