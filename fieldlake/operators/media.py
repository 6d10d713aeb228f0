"""Camera and microphone jobs over arrays: model scores, boxes, windows and spectrograms.

Codecs stay outside: jobs start from frames, samples or raw model output.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.config import ACOUSTIC, VISION, AcousticConfig, VisionConfig
from fieldlake.operators import scale, spatial
from fieldlake.session import cut_lineage

REAL = "array<double>"


def score_onnx(df: DataFrame, model_path: str, input_col: str, shape: tuple[int, ...], output_col: str = "scores", batch: int = 64) -> DataFrame:
    """Scores of a model file over an array column, in Arrow batches, one session per Python worker.

    ``model_path`` must be readable on the executors: a shared folder, or a file sent with ``addFile``.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(output_col, T.ArrayType(T.DoubleType()))])

    def run(batches):
        import onnxruntime
        session = onnxruntime.InferenceSession(model_path, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch):
                rows = np.stack([np.asarray(v, "float32").reshape(shape) for v in pdf[input_col].iloc[start:start + batch]])
                out.extend(session.run(None, {name: rows})[0].reshape(len(rows), -1).astype("float64").tolist())
            yield pdf.assign(**{output_col: out})
    return df.mapInPandas(run, schema)


def decode_boxes(df: DataFrame, cfg: VisionConfig = VISION, objectness: bool = False) -> DataFrame:
    """Raw predictions (centre x, y, width, height[, objectness], class scores) to clipped frame boxes.

    Needs ``prediction`` (array), frame_width, frame_height and the letterbox (resize_scale, pad_x, pad_y).
    """
    first = 6 if objectness else 5
    def step(rows, name, **values):  # an exploded row keeps the optimizer from writing the values out again in every later filter
        return rows.withColumn(name, F.explode(F.array(F.struct(*[v.alias(k) for k, v in values.items()]))))

    scores = F.slice("prediction", first, F.greatest(F.size("prediction") - (first - 1), F.lit(0)))
    cx, cy, w, h = (F.col(f"__p.{n}") for n in ("cx", "cy", "w", "h"))
    rows = step(df, "__p", s=scores, best=F.array_max(scores), **{n: F.get("prediction", F.lit(i)) for i, n in enumerate(("cx", "cy", "w", "h"))},
                objectness=F.get("prediction", F.lit(4)) if objectness else F.lit(1.0)).filter(F.size("__p.s") > 0)
    rows = rows.withColumn("class_id", (F.array_position("__p.s", F.col("__p.best")) - 1).cast("int")).withColumn("confidence", F.col("__p.best") * F.col("__p.objectness"))
    finite = ~F.isnan(cx + cy + w + h) & (F.abs(cx + cy + w + h) < float("inf"))
    rows = rows.filter((F.col("confidence") >= cfg.confidence) & ~F.isnan("confidence") & finite & (w > 0) & (h > 0))

    def edge(centre, size, sign, pad, limit):
        value = (centre + sign * size / 2 - F.col(pad)) / F.col("resize_scale")
        return F.least(F.greatest(value, F.lit(0.0)), F.col(limit).cast("double"))
    rows = step(rows, "__e", box_left=edge(cx, w, -1, "pad_x", "frame_width"), box_top=edge(cy, h, -1, "pad_y", "frame_height"),
                box_right=edge(cx, w, 1, "pad_x", "frame_width"), box_bottom=edge(cy, h, 1, "pad_y", "frame_height"))
    rows = rows.withColumns({n: F.col(f"__e.{n}") for n in ("box_left", "box_top", "box_right", "box_bottom")})
    names = F.array(*[F.lit(c) for c in cfg.classes]) if cfg.classes else F.array().cast("array<string>")
    label = F.coalesce(F.get(names, F.col("class_id")), F.concat(F.lit("class_"), F.col("class_id").cast("string")))
    return (rows.filter((F.col("box_right") > F.col("box_left")) & (F.col("box_bottom") > F.col("box_top"))).withColumn("species", label)
            .withColumn("cx", (F.col("box_left") + F.col("box_right")) / 2).withColumn("cy", (F.col("box_top") + F.col("box_bottom")) / 2).drop("__p", "__e"))


def _suppress(boxes: np.ndarray, scores: np.ndarray, limit: float) -> np.ndarray:
    """Indexes kept by greedy suppression, best first."""
    left, kept = np.argsort(-scores, kind="stable"), []
    area = np.maximum(0, boxes[:, 2] - boxes[:, 0]) * np.maximum(0, boxes[:, 3] - boxes[:, 1])
    while len(left):
        top, left = left[0], left[1:]
        kept.append(top)
        inner = (np.maximum(0, np.minimum(boxes[left, 2], boxes[top, 2]) - np.maximum(boxes[left, 0], boxes[top, 0]))
                 * np.maximum(0, np.minimum(boxes[left, 3], boxes[top, 3]) - np.maximum(boxes[left, 1], boxes[top, 1])))
        union = area[left] + area[top] - inner
        left = left[np.where(union > 0, inner / np.where(union > 0, union, 1), 0.0) <= limit]
    return np.array(kept, int)


def nms(df: DataFrame, iou: float = VISION.iou, keys=("frame", "class_id"), tie: str = "box_id", small: int = 32,
        **kw) -> DataFrame:
    """Class-wise non-maximum suppression.

    A (frame, class) of at most ``small`` boxes is folded in the JVM. Boxes of a class only meet when they overlap, so larger ones
    first fall apart into runs of boxes that overlap along x; a run, not a frame, is what one task holds. Short runs
    are folded too, long ones go to numpy. Boxes without a key or a left edge are left out.
    """
    columns = list(df.columns)

    def folded(boxes: DataFrame, group) -> DataFrame:
        lists = boxes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(
            (-F.col("confidence")).alias("order"), F.col(tie).alias("tie"), F.struct(*columns).alias("box")))).alias("__boxes"))
        kept = F.aggregate("__boxes", F.slice("__boxes", 1, 0), lambda kept, b: F.when(
            F.exists(kept, lambda k: overlap(k["box"], b["box"]) > iou), kept).otherwise(F.array_append(kept, b)))
        return lists.select(F.explode(kept).alias("k")).select("k.box.*")

    edges = [F.col("box_left").cast("double"), F.col("box_right").cast("double")]
    plain = reduce(lambda a, b: a & b, [e.isNotNull() & ~F.isnan(e) for e in edges])  # others do not overlap along x only
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count(F.when(plain, 1)).alias("__p"))
    few = (F.col("__n") <= small) & (F.col("__p") == F.col("__n")) & F.lit(iou >= 0)
    if counts.filter(~few).isEmpty():
        return folded(df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))), keys)
    counted = scale.spread_join(df, counts, keys)
    whole = folded(counted.filter(few), keys)
    rows = cut_lineage(counted.filter(~few).select(*columns))
    rows = rows.withColumn("__x", F.col("box_left"))
    reach = scale.running(rows, keys, ["__x", tie], {"__reach": ("max", F.col("box_right"))}, include_current=False, **kw)
    opened = reach.withColumn("__open", F.when(F.col("__reach").isNull() | (F.col("__x") >= F.col("__reach")), F.col("__x")))
    runs = scale.running(opened, keys, ["__x", tie], {"__run": ("max", F.col("__open"))}, **kw).drop("__reach", "__open", "__x")
    group = [*keys, "__run"]
    runs = runs.join(runs.groupBy(*group).agg(F.count(F.lit(1)).alias("__n")), group)
    first = whole.unionByName(folded(runs.filter(F.col("__n") <= small), group))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(tie, kind="mergesort")
        kept = _suppress(pdf[["box_left", "box_top", "box_right", "box_bottom"]].to_numpy("float64"), pdf["confidence"].to_numpy("float64"), iou)
        return pdf.iloc[kept][columns]
    many = runs.filter(F.col("__n") > small).groupBy(*group).applyInPandas(keep, df.schema)
    return first.unionByName(many)


def overlap(a, b) -> Column:
    """Intersection over union of two box structs."""
    def side(low, high):
        return F.greatest(F.lit(0.0), F.least(a[high], b[high]) - F.greatest(a[low], b[low]))
    inner = side("box_left", "box_right") * side("box_top", "box_bottom")

    def area(x):
        return F.greatest(F.lit(0.0), x["box_right"] - x["box_left"]) * F.greatest(F.lit(0.0), x["box_bottom"] - x["box_top"])
    return F.coalesce(inner / F.nullif(area(a) + area(b) - inner, F.lit(0.0)), F.lit(0.0))


def frame_summary(df: DataFrame, keys=("frame",), cfg: VisionConfig = VISION) -> DataFrame:
    """Per frame: detections, box density, best confidence, threat flag; per species: counts and herd flag."""
    area = (F.col("box_right") - F.col("box_left")) * (F.col("box_bottom") - F.col("box_top"))
    threat = F.lower("species").isin(*[t.casefold() for t in cfg.threats]) if cfg.threats else F.lit(False)
    totals = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_count"), F.max("confidence").alias("highest_confidence"), F.max(threat.cast("int")).cast("boolean").alias("threat_detected"),
        F.least(F.lit(1.0), F.sum(F.greatest(area, F.lit(0.0))) / F.greatest(F.lit(1), F.max(F.col("frame_width") * F.col("frame_height")))).alias("herd_density"))
    kinds = df.groupBy(*keys, "species").agg(F.count(F.lit(1)).alias("n")).join(spatial.herd_flags(df, (*keys, "species"), cfg.herd_pixels), [*keys, "species"])
    # at most one entry per class of the model
    maps = kinds.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "n")))).alias("species_counts"),
                                    F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "is_herd")))).alias("herd_behavior"))
    return totals.join(maps, list(keys))


def video_summary(frames: DataFrame, key: str = "video", max_frames: int = VISION.max_frames) -> DataFrame:
    """Per video: largest counts of any frame, any herd, peaks."""
    totals = frames.groupBy(key).agg(
        F.count(F.lit(1)).alias("sampled_frame_count"), F.max("total_count").alias("total_count"), F.max("herd_density").alias("herd_density"),
        F.max("highest_confidence").alias("highest_confidence"), F.max(F.col("threat_detected").cast("int")).cast("boolean").alias("threat_detected"))
    kinds = (frames.select(key, F.explode("species_counts").alias("species", "n"), "herd_behavior")
             .groupBy(key, "species").agg(F.max("n").alias("n"), F.max(F.element_at("herd_behavior", F.col("species")).cast("int")).cast("boolean").alias("h")))
    maps = kinds.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "n")))).alias("species_counts"),
                                  F.map_from_entries(F.array_sort(F.collect_list(F.struct("species", "h")))).alias("herd_behavior"))
    return totals.join(maps, key, "left").withColumn("video_truncated", F.col("sampled_frame_count") == max_frames)


def sample_frames(df: DataFrame, key: str = "video", index: str = "frame_index", fps: str = "fps", cfg: VisionConfig = VISION) -> DataFrame:
    """Every n-th frame by the sampling interval, at most ``max_frames`` per video (the cap is the feature)."""
    rate = F.col(fps)
    known = rate.isNotNull() & ~F.isnan(rate) & (rate > 0) & (rate < float("inf"))
    every = F.when(known, F.greatest(F.lit(1), F.bround(rate * cfg.sample_sec).cast("bigint"))).otherwise(F.lit(1))
    rows = df.withColumn("__n", every).filter(F.col(index) % F.col("__n") == 0)
    # the k-th sample has index (k - 1) * n: the cap is a filter, no ranking needed
    rows = rows.filter(F.col(index) < F.col("__n") * cfg.max_frames)
    return rows.withColumn("timestamp_offset_sec", F.when(known, F.col(index) / rate)).drop("__n")


def scores_to_detections(df: DataFrame, classes: DataFrame, cfg: AcousticConfig = ACOUSTIC, key: str = "window_id", scores: str = "scores") -> DataFrame:
    """Class scores of a window to detections; a vector outside [0, 1] is taken as logits.

    ``classes`` is (class_id, class_name). Classes that are neither threat nor wildlife are ignored.
    """
    name = F.lower("class_name")
    threat, wild = name.isin(*[c.casefold() for c in cfg.threats]), name.isin(*[c.casefold() for c in cfg.wildlife])
    own = F.create_map(*[F.lit(x) for k, v in cfg.class_thresholds.items() for x in (k.casefold(), float(v))]) if cfg.class_thresholds else None
    chosen = classes.filter(threat | wild).withColumn("category", F.when(threat, "immediate_threat").otherwise("target_wildlife"))
    default = F.when(F.col("category") == "immediate_threat", cfg.threat_confidence).otherwise(cfg.confidence)
    chosen = chosen.withColumn("threshold", F.coalesce(F.try_element_at(own, name), default) if own is not None else default)
    values = F.col(scores)
    logits = F.exists(values, lambda s: (s < 0) | (s > 1))
    squashed = F.transform(values, lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-F.least(F.greatest(s.cast("double"), F.lit(-80.0)), F.lit(80.0)))))
    flat = df.select(key, F.when(logits, squashed).otherwise(F.transform(values, lambda s: s.cast("double"))).alias("__p"))
    rows = flat.select(key, F.posexplode("__p").alias("class_id", "confidence")).join(chosen, "class_id")
    return rows.filter(F.col("confidence") >= F.col("threshold")).select(key, "class_id", "class_name", "category", "confidence", "threshold")


def slice_windows(df: DataFrame, segment: int, stride: int, rate: int, key: str = "source_id", samples: str = "samples", origin: str = "origin_ms") -> DataFrame:
    """Overlapping windows with index, start sample and time; a source shorter than one segment gives none."""
    last = ((F.size(samples) - segment) / F.lit(stride)).cast("int")
    starts = F.when(F.size(samples) >= segment, F.sequence(F.lit(0), last))
    rows = df.withColumn("window_index", F.explode(starts)).withColumn("start_sample", F.col("window_index") * stride)
    at = F.col(origin) + F.round(F.col("start_sample") * 1000.0 / rate).cast("bigint")
    return rows.select(key, "window_index", "start_sample", at.alias("window_ms"), F.slice(samples, F.col("start_sample") + 1, segment).alias("samples"))


def to_mono(df: DataFrame, channels: str = "channels", samples: str = "samples", bits: str | None = None) -> DataFrame:
    """Interleaved samples to one clipped channel: integers are scaled by their bit depth, channels averaged."""
    value = F.col(samples)
    if bits is not None:
        full = F.pow(F.lit(2.0), F.col(bits) - 1)
        value = F.transform(value, lambda s: s.cast("double") / full)
    limited = F.transform(value, lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s.cast("double"))))
    n = F.col(channels)
    frames = F.sequence(F.lit(0), F.greatest((F.size(samples) / n).cast("int") - 1, F.lit(0)))
    mono = F.transform(frames, lambda i: F.aggregate(F.slice("__v", i * n + 1, n), F.lit(0.0), lambda a, s: a + s) / n)
    return df.withColumn("__v", limited).withColumn("mono", F.when(F.size("__v") >= n, mono).otherwise(F.array().cast(REAL))).drop("__v")


@lru_cache(maxsize=8)
def mel_bank(rate: int, n_fft: int, bands: int) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale (2595 log10(1 + f/700))."""
    top = 2595.0 * math.log10(1.0 + rate / 2.0 / 700.0)
    edges = 700.0 * (10.0 ** (np.linspace(0.0, top, bands + 2) / 2595.0) - 1.0)
    freqs = np.fft.rfftfreq(n_fft, 1.0 / rate)
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    bank = np.maximum(0.0, np.minimum((freqs - low) / np.maximum(mid - low, 1e-12), (high - freqs) / np.maximum(high - mid, 1e-12)))
    if (bank.sum(axis=1) == 0).any():
        raise ValueError("the FFT is too small for that many mel bands")
    return bank.astype("float32")


def _log_mel(x: np.ndarray, cfg: AcousticConfig) -> np.ndarray:
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(cfg.n_fft) / cfg.n_fft)
    frames = np.lib.stride_tricks.sliding_window_view(x, cfg.n_fft)[::cfg.hop]
    power = np.abs(np.fft.rfft(frames * window, axis=1) / window.sum()) ** 2
    mel = mel_bank(cfg.rate, cfg.n_fft, cfg.mel_bands) @ power.T.astype("float32")
    return 10.0 * np.log10(np.maximum(mel, np.finfo("float32").eps))


def log_mel(df: DataFrame, cfg: AcousticConfig = ACOUSTIC, samples: str = "samples") -> DataFrame:
    """Log-mel spectrogram (bands × frames, decibels) of each window."""
    keep = [f for f in df.schema.fields if f.name != samples]
    schema = T.StructType([*keep, T.StructField("spectrogram", T.ArrayType(T.ArrayType(T.FloatType())))])

    def run(batches):
        for pdf in batches:
            spectra = [_log_mel(np.asarray(s, "float64"), cfg).astype("float32").tolist() for s in pdf[samples]]
            yield pdf.drop(columns=[samples]).assign(spectrogram=spectra)
    return df.mapInPandas(run, schema)


