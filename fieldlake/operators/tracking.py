"""Speed verdicts of collar fixes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldlake.config import GPS, GpsConfig
from fieldlake.functions import geo
from fieldlake.operators import scale
from fieldlake.operators.validate import TOO_FAST, VALID_FIX


def with_ecef(df: DataFrame) -> DataFrame:
    x, y, z = geo._ecef("latitude", "longitude", F.coalesce("altitude", F.lit(0.0)))
    return df.withColumn("ecef_x", x).withColumn("ecef_y", y).withColumn("ecef_z", z)


def judge(t, x, y, z, limit, usable, state):
    """Verdicts in order: too fast against the newest fix accepted so far; no test when time does not advance.

    As long as every fix is accepted, each one is judged against the one before it, by arrays. From the first that is not (too
    fast, or earlier than the one before it) single steps find the next fix that is accepted, and arrays go on from there.
    """
    fast = np.zeros(len(t), bool)
    rows = np.flatnonzero(usable)
    if not len(rows):
        return fast, state
    t, x, y, z, limit = (np.asarray(v)[rows] for v in (t, x, y, z, limit))
    with np.errstate(divide="ignore", invalid="ignore"):
        seconds = np.diff(t) / 1000.0
        speed = 3.6 * np.sqrt(np.diff(x) ** 2 + np.diff(y) ** 2 + np.diff(z) ** 2) / seconds
    plain = np.append(True, (seconds == 0) | ((seconds > 0) & ~(speed > limit[1:])))  # accepted if the one before is
    stops = np.append(np.flatnonzero(~plain), len(t))
    at = 0
    while at < len(t):
        taken = True
        if state is not None:
            passed = (t[at] - state[0]) / 1000.0
            chord = ((x[at] - state[1]) ** 2 + (y[at] - state[2]) ** 2 + (z[at] - state[3]) ** 2) ** 0.5
            fast[rows[at]] = passed > 0 and 3.6 * chord / passed > limit[at]
            taken = passed >= 0 and not fast[rows[at]]
        if taken:  # and so are all up to the next stop
            at = int(stops[np.searchsorted(stops, at, "right")]) - 1
            state = (int(t[at]), float(x[at]), float(y[at]), float(z[at]))
        at += 1
    return fast, state


def speed_verdicts(df: DataFrame, key: str = "animal_id", order=("recorded_epoch_ms", "id"), cfg: GpsConfig = GPS, **kw) -> DataFrame:
    """Adds the speed verdict to ``validation_status``.

    Each verdict depends on the verdicts before it: a rejected fix is no reference. ``order``
    is arrival order when that differs from time. Fixes rejected for other reasons are skipped.
    """
    rows = with_ecef(df)
    rows = rows.withColumn("speed_limit", F.coalesce("max_speed", F.lit(cfg.default_max_speed)).cast("double")
                           if "max_speed" in df.columns else F.lit(cfg.default_max_speed))
    if "validation_status" not in df.columns:
        rows = rows.withColumn("validation_status", F.lit(VALID_FIX))
    helpers = ["ecef_x", "ecef_y", "ecef_z", "speed_limit"]
    schema = T.StructType([f for f in rows.schema.fields if f.name not in helpers])

    def step(pdf: pd.DataFrame, state):
        fast, after = judge(pdf["recorded_epoch_ms"].to_numpy("int64"), *(pdf[c].to_numpy("float64") for c in helpers),
                            (pdf["validation_status"] == VALID_FIX).to_numpy(), state)
        status = np.where(fast, TOO_FAST, pdf["validation_status"])
        return pdf.assign(validation_status=status)[schema.fieldNames()], after

    return scale.scan(rows, [key], list(order), step, schema, "at bigint, x double, y double, z double", **kw)
