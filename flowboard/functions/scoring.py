"""Absolute score components in [0, 100] as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScoreConfig:
    """Weights (normalised by their sum), reference points and the correctness gate."""

    # Fixed default values of the scoring contract.
    weight_latency: float = 0.35
    weight_throughput: float = 0.30
    weight_correctness: float = 0.25
    weight_stability: float = 0.10
    best_p99_us: float = 100.0
    worst_p99_us: float = 50_000.0
    target_tps: float = 100_000.0
    correctness_gate: float = 0.5


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def round2(x: Column) -> Column:
    """Half away from zero on the scaled value; scores are never negative."""
    return F.floor(x * 100 + 0.5).cast("double") / 100


def latency_score(p99_us: Column, best: float = 100.0, worst: float = 50_000.0) -> Column:
    """Log-interpolated between the two reference latencies; 0 without samples."""
    best = best if best > 0 else 1.0
    worst = worst if worst > best else best * 100
    x = F.greatest(F.lit(best), F.least(F.lit(worst), p99_us.cast("double")))
    span = math.log10(worst) - math.log10(best)
    share = (F.lit(math.log10(worst)) - F.log10(x)) / F.lit(span)
    return F.when(p99_us <= 0, 0.0).otherwise(100 * clamp01(share))


def throughput_score(tps: Column, target: float = 100_000.0) -> Column:
    if target <= 0:
        return F.lit(0.0)
    return 100 * clamp01(tps / F.lit(target))


def stability_score(cov: Column, error_rate: Column) -> Column:
    return 100 * clamp01(1.0 - clamp01(cov) - clamp01(error_rate))


def score_columns(
    tps: Column, p99_us: Column, error_rate: Column, correctness: Column, cov: Column,
    config: ScoreConfig = ScoreConfig(),
) -> dict[str, Column]:
    """Four rounded components and the gated composite of the unrounded ones."""
    c = config
    latency = latency_score(p99_us, c.best_p99_us, c.worst_p99_us)
    throughput = throughput_score(tps, c.target_tps)
    right = 100 * clamp01(correctness)
    stability = stability_score(cov, error_rate)
    weights = c.weight_latency + c.weight_throughput + c.weight_correctness + c.weight_stability
    weights = weights if weights > 0 else 1.0
    composite = (
        c.weight_latency * latency + c.weight_throughput * throughput
        + c.weight_correctness * right + c.weight_stability * stability
    ) / weights
    if c.correctness_gate > 0:
        composite = composite * ((1 - c.correctness_gate) + c.correctness_gate * clamp01(correctness))
    return {
        "latency_score": round2(latency),
        "throughput_score": round2(throughput),
        "correctness_score": round2(right),
        "stability_score": round2(stability),
        "composite": round2(composite),
    }
