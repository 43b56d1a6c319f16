"""Numeric column expressions: labels, vectors, routes, risk, latency."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewell import config as cfg
from tracewell.functions.text import fixed, strip


def is_normal(label: Column, normal_value: str) -> Column:
    return F.coalesce(label == F.lit(normal_value), F.lit(False))


def binary_label(normal: Column) -> Column:
    return (~normal).cast("int")


def hit_label(label: Column) -> Column:
    """Label class of a retrieved record: everything but ``Normal`` counts as 1."""
    return F.when(label == cfg.NORMAL, 0).otherwise(1)


def pred_label(label: Column) -> Column:
    """1 only for the word *anomalous*, in any case."""
    return F.when(F.lower(strip(label)) == "anomalous", 1).otherwise(0)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def squared_distance(v: Column, centre: Column) -> Column:
    gaps = F.zip_with(v, centre, lambda x, c: F.pow(x.cast("double") - c, F.lit(2.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def over_threshold(score: Column, threshold: Column) -> Column:
    """Strictly above: the threshold itself still counts as normal."""
    return F.when(score > threshold, 1).otherwise(0)


def route(distance: Column, lower: Column, upper: Column) -> Column:
    return (
        F.when(distance < lower, cfg.ROUTES[0])
        .when(distance > upper, cfg.ROUTES[2])
        .otherwise(cfg.ROUTES[1])
    )


def distance_confidence(distance: Column, threshold: Column, anomalous: Column) -> Column:
    """Share of twice the threshold, turned round for normals, kept in bounds."""
    span = F.when(threshold > 0, threshold * 2.0).otherwise(F.lit(1.0))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), distance / span))
    raw = F.when(anomalous, share).otherwise(F.lit(1.0) - share)
    kept = F.greatest(F.lit(cfg.CONFIDENCE_FLOOR), F.least(F.lit(cfg.CONFIDENCE_CEILING), raw))
    return F.round(kept, 4)


def score_for_auc(label: Column, confidence: Column, distance: Column | None = None,
                  mode: str = "by_label") -> Column:
    """``by_label``: confidence, turned round for normals; or the raw measure."""
    if mode == "distance":
        return distance
    if mode == "confidence":
        return confidence
    return F.when(label == cfg.ANOMALOUS, confidence).otherwise(1.0 - confidence)


def risk_total(impact: Column, error: Column, cascade: Column) -> Column:
    """Weighted sum of the three factors, each kept in 1..4 (2 when missing)."""
    total = F.lit(0.0)
    for weight, factor in zip(cfg.RISK_WEIGHTS, (impact, error, cascade)):
        bounded = F.greatest(F.lit(1), F.least(F.lit(4), F.coalesce(factor, F.lit(2))))
        total = total + F.lit(weight) * bounded
    return F.round(total, 3)


def risk_level(total: Column) -> Column:
    return (
        F.when(total >= cfg.RISK_HIGH, "High")
        .when(total >= cfg.RISK_MEDIUM, "Medium")
        .otherwise("Low")
    )


def generation_share(total_ms: Column, prompt_tokens: Column, completion_tokens: Column) -> Column:
    """Part of the time spent writing the answer; no tokens divide by one."""
    spent = F.coalesce(prompt_tokens, F.lit(0)) + F.coalesce(completion_tokens, F.lit(0))
    return total_ms * completion_tokens / F.when(spent == 0, F.lit(1)).otherwise(spent)


def time_decay(gap_seconds: Column) -> Column:
    return F.exp(-F.abs(gap_seconds) / F.lit(float(cfg.TIME_DECAY_SECONDS)))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient with 0 for an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def round_exact(c: Column, digits: int) -> Column:
    """Round by the exact binary value, as Python does: the fused scores and
    hour gaps hit decimal ties often, where the usual rounding differs.
    """
    return fixed(c, digits).cast("double")
