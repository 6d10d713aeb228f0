"""Per-key state of the streaming jobs. Each gives what its batch operator gives on the same rows in order.

Rows of one micro-batch are put in event order per key; rows that arrive later than their
successors are judged against the state of the moment, and a batch run corrects them. State is updated by arrays, and
``ttl_ms`` drops that of keys which have fallen silent.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fieldlake.config import EMA_ALPHAS, GPS
from fieldlake.operators import tracking
from fieldlake.operators.tracking import judge, with_ecef
from fieldlake.operators.validate import TOO_FAST, VALID_FIX

# Spark asks a processor for its state in a Python process of the driver that does not see shipped packages
for _module in (__name__, tracking.__name__):
    cloudpickle.register_pickle_by_value(sys.modules[_module])

HELPERS = ["ecef_x", "ecef_y", "ecef_z", "speed_limit"]


def _in_order(rows: Iterator[pd.DataFrame], order) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(list(order), kind="mergesort")


class Expiring(StatefulProcessor):
    """State that is dropped when a key has been silent for ``ttl_ms`` of event time: the watermark has passed its last row by that much.

    One timer per key is open; it moves on when it finds that the key has been heard since.
    """

    states: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        if self.ttl_ms is not None:
            self.heard = handle.getValueState("heard", "at bigint")

    def touch(self, times: np.ndarray) -> None:
        if self.ttl_ms is None or not len(times):
            return
        known = self.heard.exists()
        latest = int(times.max())
        if known:
            latest = max(latest, int(self.heard.get()[0]))
        else:
            self.handle.registerTimer(latest + self.ttl_ms)
        self.heard.update((latest,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = int(self.heard.get()[0]) + self.ttl_ms if self.heard.exists() else 0
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            for name in (*self.states, "heard"):
                getattr(self, name).clear()
        return iter([])

    def close(self) -> None:
        pass


def run(df: DataFrame, keys, processor: Expiring, schema: T.StructType, time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """A processor whose state expires needs the ``time`` (epoch ms) its watermark follows; rows behind it are judged all the same."""
    if processor.ttl_ms is not None:
        df = df.withColumn("__event", F.timestamp_millis(time)).withWatermark("__event", delay).drop("__event")
    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append",
                                                        timeMode="None" if processor.ttl_ms is None else "EventTime")


class SpeedVerdicts(Expiring):
    """Newest accepted fix of an animal."""

    states = ("fix",)

    def __init__(self, columns, order, ttl_ms=None):
        self.columns, self.order, self.ttl_ms = columns, order, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fix = handle.getValueState("fix", "at bigint, x double, y double, z double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.order)
        self.touch(pdf["recorded_epoch_ms"].to_numpy("int64"))
        state = self.fix.get() if self.fix.exists() else None
        fast, after = judge(pdf["recorded_epoch_ms"].to_numpy("int64"), *(pdf[c].to_numpy("float64") for c in HELPERS),
                            (pdf["validation_status"] == VALID_FIX).to_numpy(), tuple(state) if state is not None else None)
        if after is not None:
            self.fix.update(tuple(after))
        yield pdf.assign(validation_status=np.where(fast, TOO_FAST, pdf["validation_status"]))[self.columns]


def speed_verdicts(stream: DataFrame, key: str = "animal_id", order=("recorded_epoch_ms", "id"), limit: float = GPS.default_max_speed, ttl_ms: int | None = None) -> DataFrame:
    rows = with_ecef(stream).withColumn("speed_limit", F.coalesce("max_speed", F.lit(limit)).cast("double") if "max_speed" in stream.columns else F.lit(float(limit)))
    if "validation_status" not in stream.columns:
        rows = rows.withColumn("validation_status", F.lit(VALID_FIX))
    schema = T.StructType([f for f in rows.schema.fields if f.name not in HELPERS])
    return run(rows, [key], SpeedVerdicts(schema.fieldNames(), order, ttl_ms), schema, "recorded_epoch_ms")


def hampel_values(recent: np.ndarray, values: np.ndarray, window: int, k: float) -> np.ndarray:
    """``values`` after the filter, given the ``recent`` ones before them; none is null."""
    every = np.concatenate([recent, values])
    out = values.copy()
    if len(every) >= window:
        framed = np.lib.stride_tricks.sliding_window_view(every, window)[-len(values):]
        middle = np.median(framed, axis=1)
        spread = 1.4826 * np.median(np.abs(framed - middle[:, None]), axis=1)
        at = out[-len(framed):]
        odd = (spread == 0) | (np.abs(at - middle) > k * spread)
        at[odd] = middle[odd]
    return out


class Smoothing(Expiring):
    """Hampel window and exponential mean of every metric of a device."""

    states = ("memory",)

    def __init__(self, metrics, columns, order, window=11, k=3.0, ttl_ms=None):
        self.metrics, self.columns, self.order, self.window, self.k, self.ttl_ms = metrics, columns, order, window, k, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.memory = handle.getMapState("memory", "metric string", "recent array<double>, smooth double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.order)
        self.touch(pdf[self.order[0]].to_numpy("int64"))
        for metric in self.metrics:
            slot, values = (metric,), pdf[metric].to_numpy("float64")
            known = ~np.isnan(values)
            out = np.full(len(values), np.nan)
            if known.any():
                recent, smooth = np.empty(0), []
                if self.memory.containsKey(slot):
                    kept = self.memory.getValue(slot)
                    recent, smooth = np.array(kept[0], "float64"), [kept[1]]
                clean = hampel_values(recent[-self.window + 1:], values[known], self.window, self.k)
                out[known] = pd.Series(np.concatenate([smooth, clean])).ewm(alpha=EMA_ALPHAS[metric], adjust=False).mean().to_numpy()[-len(clean):]
                recent = np.concatenate([recent, values[known]])[-self.window:]
                self.memory.updateValue(slot, (recent.tolist(), float(out[known][-1])))
            pdf[f"{metric}_filtered"] = out
        yield pdf[self.columns]


def filter_stream(stream: DataFrame, metrics, key: str = "device_id", order=("recorded_epoch_ms", "id"), ttl_ms: int | None = None) -> DataFrame:
    """Hampel then exponential smoothing per device, as the two batch operators in sequence."""
    schema = T.StructType([*stream.schema.fields, *[T.StructField(f"{m}_filtered", T.DoubleType()) for m in metrics]])
    return run(stream, [key], Smoothing(list(metrics), schema.fieldNames(), order, ttl_ms=ttl_ms), schema, order[0])


def moments_before(values: np.ndarray, state: tuple[int, float, float]) -> tuple[np.ndarray, np.ndarray, tuple[int, float, float]]:
    """Mean and sample deviation of all earlier values at each place, and the state (n, mean, squares) behind the last.

    Sums are taken about the mean so far, or the first value, so they do not lose digits.
    """
    n, mean, m2 = state
    origin = mean if n else float(values[0])
    shifted = values - origin
    counts = n + np.arange(len(values) + 1)
    total = np.concatenate([[0.0], np.cumsum(shifted)])
    square = m2 + np.concatenate([[0.0], np.cumsum(shifted * shifted)])
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(counts > 0, total / counts, 0.0)
        spread = np.maximum(square - counts * gap * gap, 0.0)
        std = np.where(counts > 1, np.sqrt(spread / (counts - 1)), 0.0)
    return origin + gap[:-1], std[:-1], (int(counts[-1]), float(origin + gap[-1]), float(spread[-1]))


class Stress(Expiring):
    """Running moments per month and metric of a place."""

    states = ("moments",)

    def __init__(self, metrics, columns, order, threshold, ttl_ms=None):
        self.metrics, self.columns, self.order, self.threshold, self.ttl_ms = metrics, columns, order, threshold, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.moments = handle.getMapState("moments", "slot string", "n bigint, mean double, m2 double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.order)
        self.touch(pdf[self.order[0]].to_numpy("int64"))
        hits = np.zeros(len(pdf), "int64")
        months = pd.to_datetime(pdf[self.order[0]], unit="ms", utc=True).dt.month.to_numpy()
        for metric in self.metrics:
            values = pdf[metric].to_numpy("float64")
            for month in np.unique(months):
                at = np.flatnonzero((months == month) & ~np.isnan(values))
                if not len(at):
                    continue
                slot = (f"{month}|{metric}",)
                state = tuple(self.moments.getValue(slot)) if self.moments.containsKey(slot) else (0, 0.0, 0.0)
                mean, std, after = moments_before(values[at], state)
                hits[at] += (std > 0) & (np.abs(values[at] - mean) > self.threshold * std)
                self.moments.updateValue(slot, after)
        yield pdf.assign(triggered_metrics=hits, stress=hits > 0)[self.columns]


def stress_stream(stream: DataFrame, metrics, location: str = "location_id", order=("recorded_epoch_ms", "id"), threshold: float = 2.5, ttl_ms: int | None = None) -> DataFrame:
    schema = T.StructType([*stream.schema.fields, T.StructField("triggered_metrics", T.LongType()), T.StructField("stress", T.BooleanType())])
    return run(stream, [location], Stress(list(metrics), schema.fieldNames(), order, threshold, ttl_ms), schema, order[0])


def accepted(times: np.ndarray, last: int | None, window_ms: int, sliding: bool) -> tuple[np.ndarray, int | None]:
    """Which of the ordered ``times`` lie ``window_ms`` behind the last one (sliding) or the last accepted one, and the last one."""
    keep = np.zeros(len(times), bool)
    if not len(times):
        return keep, last
    if sliding:
        keep[1:] = np.diff(times) >= window_ms
        keep[0] = last is None or times[0] - last >= window_ms
        return keep, int(times[-1])
    # from one accepted time on to the next; times may lie before the last accepted one, so every later one is asked
    at = 0
    while at < len(times):
        if last is not None:
            free = np.flatnonzero(times[at:] - last >= window_ms)
            if not len(free):
                break
            at += int(free[0])
        keep[at], last = True, int(times[at])
        at += 1
    return keep, last


class Throttle(Expiring):
    """Last time of a kind of alert: of any (sliding) or of an accepted one (greedy)."""

    states = ("last",)

    def __init__(self, time, columns, order, window_ms, sliding, top, ttl_ms=None):
        self.time, self.columns, self.order, self.ttl_ms = time, columns, order, ttl_ms
        self.window_ms, self.sliding, self.top = window_ms, sliding, top

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, self.order)
        self.touch(pdf[self.time].to_numpy("int64"))
        last = self.last.get()[0] if self.last.exists() else None
        keep = (pdf["priority"] == self.top).to_numpy() if self.top is not None else np.zeros(len(pdf), bool)
        calm = np.flatnonzero(~keep)
        keep[calm], after = accepted(pdf[self.time].to_numpy("int64")[calm], last, self.window_ms, self.sliding)
        if after is not None:
            self.last.update((after,))
        yield pdf.assign(accepted=keep)[self.columns]


def throttle(stream: DataFrame, keys, window_ms: int, time: str = "ts_ms", tie: str = "id", sliding: bool = False, top: str | None = None,
             ttl_ms: int | None = None) -> DataFrame:
    """``accepted`` per row: alert suppression (``sliding``, with a priority that always passes) or greedy cooldown.

    A ``ttl_ms`` of at least the window loses nothing: after so long a silence a key's next row is accepted anyway.
    """
    schema = T.StructType([*stream.schema.fields, T.StructField("accepted", T.BooleanType())])
    return run(stream, keys, Throttle(time, schema.fieldNames(), (time, tie), window_ms, sliding, top, ttl_ms), schema, time)


class AudioWindows(Expiring):
    """Samples of a live source not yet cut into a window."""

    states = ("buffer",)

    def __init__(self, segment, stride, rate, ttl_ms=None):
        self.segment, self.stride, self.rate, self.ttl_ms = segment, stride, rate, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.buffer = handle.getValueState("buffer", "samples array<float>, start bigint, window bigint, origin bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ("chunk",))
        self.touch(pdf["origin_ms"].to_numpy("int64"))
        samples, start, window, origin = np.empty(0, "float32"), 0, 0, None
        if self.buffer.exists():
            kept = self.buffer.get()
            samples, start, window, origin = np.array(kept[0], "float32"), int(kept[1]), int(kept[2]), int(kept[3])
        out = []
        for row in pdf.itertuples():
            if origin is None or row.discontinuity:
                # a gap drops what was buffered and restarts the clock, but window numbers go on
                samples, start, origin = np.empty(0, "float32"), 0, int(row.origin_ms)
            samples = np.concatenate([samples, np.asarray(row.samples, "float32")])
            while len(samples) >= self.segment:
                out.append((key[0], window, start, origin + int(round(start * 1000 / self.rate)), samples[:self.segment].tolist()))
                samples, start, window = samples[self.stride:], start + self.stride, window + 1
        self.buffer.update((samples.tolist(), start, window, origin))
        yield pd.DataFrame(out, columns=["source_id", "window_index", "start_sample", "window_ms", "samples"])


def audio_windows(stream: DataFrame, segment: int, stride: int, rate: int, ttl_ms: int | None = None) -> DataFrame:
    """Windows of live audio chunks (source_id, chunk, origin_ms, discontinuity, samples)."""
    long, real = T.LongType(), T.ArrayType(T.FloatType())
    schema = T.StructType([T.StructField(n, t) for n, t in (("source_id", T.StringType()), ("window_index", long), ("start_sample", long),
                                                            ("window_ms", long), ("samples", real))])
    return run(stream, ["source_id"], AudioWindows(segment, stride, rate, ttl_ms), schema, "origin_ms")
