"""Scalar functions over scores, probabilities and counts. Undefined results are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRANSFORMS = ("RAW", "SIGNED", "ABS", "SIGNED_POSITIVE", "POSITIVE_PART")


def ranking_score(raw: Column, transform: str) -> Column:
    if transform not in TRANSFORMS:
        raise ValueError(transform)
    if transform == "ABS":
        return F.abs(raw)
    return F.greatest(F.lit(0.0), raw) if transform in ("SIGNED_POSITIVE", "POSITIVE_PART") else raw


def risk_contrast(logit_0: Column, logit_1: Column) -> Column:
    return logit_1 - logit_0


def probability(logit_0: Column, logit_1: Column) -> Column:
    """Two-class softmax; the exponent is never positive, so it can't overflow."""
    d = logit_1 - logit_0
    e = F.exp(-F.abs(d))
    return F.when(d >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_odds(p: Column, eps: float = 1e-12) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q) - F.ln(1 - q)


def odds_identity_holds(logit_0: Column, logit_1: Column, atol: float = 1e-9, rtol: float = 1e-9) -> Column:
    d = risk_contrast(logit_0, logit_1)
    return F.abs(log_odds(probability(logit_0, logit_1)) - d) <= atol + rtol * F.abs(d)


def top_fraction(n: Column, fraction: float) -> Column:
    """Items in a top fraction, rounded up, one at least; none of none."""
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(float(fraction)) * n))).cast("bigint")


def effort_items(n: Column, fraction: float = 0.2) -> Column:
    """Items that an effort allows to inspect, rounded down, one at least."""
    return F.greatest(F.lit(1), F.floor(F.lit(float(fraction)) * n)).cast("bigint")


def polarity_epsilon(max_abs: Column) -> Column:
    """The width of zero: relative to the largest score, 0 if all are 0, a constant if there are none."""
    return F.when(max_abs.isNull(), F.lit(1e-8)).when(max_abs == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(1e-8), 1e-6 * max_abs))


def polarity(score: Column, max_abs: Column) -> Column:
    eps = polarity_epsilon(max_abs)
    return F.when(max_abs == 0, "NEAR_ZERO").when(score > eps, "POSITIVE").when(score < -eps, "NEGATIVE").otherwise("NEAR_ZERO")


def mcc(tp: Column, tn: Column, fp: Column, fn: Column) -> Column:
    tp, tn, fp, fn = (c.cast("double") for c in (tp, tn, fp, fn))
    below = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return F.when(below <= 0, 0.0).otherwise((tp * tn - fp * fn) / F.sqrt(below))


def format_p(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "NA").when(p < 0.001, "p < 0.001").otherwise(F.concat(F.lit("p = "), F.format_number(p, 3)))


def better_direction(mean_difference: Column, metric_direction: str) -> Column:
    """Which of two methods does better; a zero difference counts for the second."""
    first = mean_difference > 0 if metric_direction == "HIGHER_BETTER" else ~(mean_difference > 0)
    return F.when(first, "FIRST").otherwise("SECOND")


def standardized_difference(mean_a: Column, mean_b: Column, sd_a: Column, sd_b: Column) -> Column:
    """Difference of means over the pooled deviation; 0 for equal constants, null for different ones."""
    pooled = F.sqrt((sd_a * sd_a + sd_b * sd_b) / 2)
    return F.when(pooled > 0, (mean_a - mean_b) / pooled).when(mean_a == mean_b, 0.0)


def completeness_holds(error: Column, delta: Column, floor: float = 1e-3, factor: float = 0.05) -> Column:
    return error <= F.greatest(F.lit(floor), factor * F.abs(delta))


def score_from_logits(logit_0: Column, logit_1: Column, space: str = "logit_contrast") -> Column:
    """The score in one of the two spaces."""
    if space == "logit_contrast":
        return risk_contrast(logit_0, logit_1)
    if space == "probability":
        return probability(logit_0, logit_1)
    raise ValueError(space)


def completeness_by_mode(error_abs: Column, error_rel: Column, delta: Column, mode: str = "COMBINED", tolerance: float = 0.05) -> Column:
    """Whether attributions add up: by the larger of an absolute and a relative limit (COMBINED) or by the relative error alone (RELATIVE)."""
    if mode == "COMBINED":
        return completeness_holds(error_abs, delta, factor=tolerance)
    if mode == "RELATIVE":
        return error_rel <= tolerance
    raise ValueError(mode)
