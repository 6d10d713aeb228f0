"""Scoring formulas as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldlake.config import ANALYTICS, RISK, RiskConfig
from fieldlake.functions.timex import col

UNIT_SLACK = 1e-6


def clamp(c, low: float = 0.0, high: float = 100.0) -> Column:
    """Null stays null: ``least``/``greatest`` skip nulls, so the test is explicit."""
    value = col(c).cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def positive_part(c) -> Column:
    value = col(c).cast("double")
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), value))


def ratio(a, b) -> Column:
    """a / b, null when b is zero or null (ANSI mode would raise)."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def scale_to_risk(metric: str, c, cfg: RiskConfig = RISK) -> Column:
    best, worst = cfg.bounds[metric]
    return clamp(F.lit(100.0) * (col(c) - F.lit(best)) / F.lit(worst - best))


def weighted_score(components: dict, weights: dict) -> Column:
    """Weighted mean over the components that are not null; null when none is."""
    used = [(col(c).cast("double"), float(weights[name])) for name, c in components.items() if weights.get(name, 0) > 0]
    total = reduce(lambda a, b: a + b, [F.coalesce(c * F.lit(w), F.lit(0.0)) for c, w in used])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in used])
    return clamp(ratio(total, weight))


def adverse_z(value, mean, std, direction) -> Column:
    """z in the harmful direction: +1 high is bad, -1 low is bad, 0 both."""
    z = ratio(col(value) - col(mean), std)
    if isinstance(direction, int):
        direction = F.lit(direction)
    return F.when(direction > 0, positive_part(z)).when(direction < 0, positive_part(-z)).otherwise(F.abs(z))


def decay(age_s, half_life_s: float) -> Column:
    return F.pow(F.lit(2.0), -col(age_s) / F.lit(half_life_s))


def mean_decay(span_s, half_life_s: float) -> Column:
    """Mean of ``decay`` over ages spread evenly on [0, span]."""
    span = col(span_s)
    return ratio(F.lit(half_life_s), span * F.log(F.lit(2.0))) * (F.lit(1.0) - decay(span, half_life_s))


def saturate(pressure, ceiling: float) -> Column:
    return clamp(F.lit(100.0) * (F.lit(1.0) - F.exp(F.lit(-3.0) * col(pressure) / F.lit(ceiling))))


def escalate_climate(z, cfg: RiskConfig = RISK) -> Column:
    value = col(z)
    top = F.lit(cfg.subthreshold_max)
    above = top + (F.lit(100.0) - top) * (
        F.lit(1.0) - F.exp(F.lit(-cfg.escalation_rate) * (value - F.lit(cfg.sigma_threshold)))
    )
    return (F.when(value <= 0.0, F.lit(0.0))
            .when(value < cfg.sigma_threshold, top * F.pow(value / F.lit(cfg.sigma_threshold), F.lit(2.0)))
            .when(value.isNotNull(), clamp(above)))


def projected_f(ne, generations: float = RISK.inbreeding_generations) -> Column:
    """Expected inbreeding after ``generations`` of drift at size ``ne``."""
    value = col(ne)
    return F.when(value <= 0.5, F.lit(1.0)).otherwise(
        F.lit(1.0) - F.pow(F.lit(1.0) - ratio(F.lit(1.0), F.lit(2.0) * value), F.lit(generations))
    )


def delta_trend(current, previous, flat: float = ANALYTICS.flat_percent) -> tuple[Column, Column]:
    """(percent change, trend). A rise from zero has a direction but no percentage."""
    cur, prev = col(current).cast("double"), col(previous).cast("double")
    known = cur.isNotNull() & prev.isNotNull()
    percent = F.when(known, F.when(prev != 0, (cur - prev) / F.nullif(F.abs(prev), F.lit(0.0)) * 100.0)
                     .when(cur == 0, F.lit(0.0)))
    trend = (F.when(~known, "unknown")
             .when((prev == 0) & (cur > 0), "up").when((prev == 0) & (cur < 0), "down")
             .when(F.abs(percent) < flat, "flat").when(percent > 0, "up").otherwise("down"))
    return percent, trend


def clamp_unit(c) -> Column:
    """Absorb float noise just outside [0, 1]; larger excursions stay visible to validation."""
    value = col(c).cast("double")
    return (F.when((value < 0) & (value >= -UNIT_SLACK), F.lit(0.0))
            .when((value > 1) & (value <= 1 + UNIT_SLACK), F.lit(1.0)).otherwise(value))


def escalation_level(cri) -> Column:
    """1-5 from a 0-100 index; 80 itself is still level 4."""
    value = col(cri)
    return (F.when(value < 20, 1).when(value < 40, 2).when(value < 60, 3).when(value <= 80, 4)
            .when(value.isNotNull(), 5)).cast("int")


def priority_tier(ipi) -> Column:
    value = col(ipi)
    return (F.when(value >= 80, "IMMEDIATE").when(value >= 60, "HIGH").when(value >= 40, "ELEVATED")
            .when(value >= 20, "ROUTINE").when(value.isNotNull(), "MONITOR"))
