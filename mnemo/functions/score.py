"""Scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights (relevance, recency, importance, access) by kind.
KIND_WEIGHTS = {"episodic": (0.30, 0.40, 0.15, 0.15), "procedural": (0.35, 0.05, 0.15, 0.45), "semantic": (0.45, 0.10, 0.30, 0.15)}
TIER_MULTIPLIER = {"ltm": 1.0, "stm": 0.8, "dormant": 0.15, "archived": 0.15, "sensory": 0.1}
TIER_RANK = {"sensory": 1, "stm": 2, "ltm": 3}
PRIORITY_SCORE = {"critical": 1.0, "high": 0.75, "normal": 0.5}
PRIORITY_LEVEL = {"critical": 4, "high": 3, "normal": 2}


def choose(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in reversed(values.items()):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def dot(a: Column, b: Column) -> Column:
    """Inner product in doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(F.lit(0.0))


def rrf(rank: Column, k: int = 20) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def recency(age_days: Column) -> Column:
    return F.exp(F.lit(-0.1) * age_days)


def access_frequency(n: Column) -> Column:
    return F.when(n > 0, F.least(F.ln(n + F.lit(1.0)) / F.ln(F.lit(100.0)), F.lit(1.0))).otherwise(F.lit(0.0))


def priority_score(priority: Column) -> Column:
    return choose(priority, PRIORITY_SCORE, 0.25)


def tier_multiplier(tier: Column) -> Column:
    return choose(tier, TIER_MULTIPLIER, 0.8)


def tier_rank(tier: Column) -> Column:
    return choose(tier, TIER_RANK, 0)


def relevance_gate(relevance: Column) -> Column:
    return F.when(relevance < 0.45, F.greatest((relevance - 0.15) / 0.30, F.lit(0.05))).otherwise(F.lit(1.0))


def composite(relevance: Column, age_days: Column, importance: Column, access: Column, kind: Column, tier: Column, boost: Column | None = None) -> Column:
    """Weighted by kind, gated by relevance, scaled by tier and an optional boost."""
    w = [choose(kind, {k: v[i] for k, v in KIND_WEIGHTS.items()}, KIND_WEIGHTS["semantic"][i]) for i in range(4)]
    base = relevance * w[0] + recency(age_days) * w[1] + importance * w[2] + access_frequency(access) * w[3]
    out = base * relevance_gate(relevance) * tier_multiplier(tier)
    return out if boost is None else out * boost


def utility_ratio(utility: Column, access: Column) -> Column:
    return F.when(access > 0, F.least(utility / access, F.lit(1.0))).otherwise(F.lit(0.0))


def ease(utility: Column) -> Column:
    return F.least(F.lit(1.0) + F.lit(0.2) * utility, F.lit(4.0))


def hebbian(weight: Column, times: Column) -> Column:
    """``times`` steps of w + 0.05 (1 - w)."""
    return F.lit(1.0) - (F.lit(1.0) - weight) * F.pow(F.lit(0.95), times)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def activation_exact(age_hours: Column, access_ages: Column, decay: float = 0.5) -> Column:
    """Retrieval probability from the creation and all accesses (ages in hours, a minute at least)."""
    least = 1.0 / 60.0
    power = lambda h: F.pow(F.greatest(h.cast("double"), F.lit(least)), F.lit(-decay))
    total = F.aggregate(access_ages, F.lit(0.0), lambda s, h: s + power(h))
    return sigmoid(F.ln(power(age_hours) + total))


def activation_approximate(life_hours: Column, last_hours: Column, accesses: Column, decay: float = 0.5) -> Column:
    """The same from the last access and the number of accesses, others spread evenly over the life."""
    least = F.lit(1.0 / 60.0)
    life = F.greatest(life_hours.cast("double"), least)
    last = F.when(accesses < 1, life).otherwise(F.least(F.greatest(F.coalesce(last_hours.cast("double"), life), least), life))
    n = F.greatest(accesses, F.lit(1)) - 1
    p = 1.0 - decay
    spread = F.when(life > last, n * (F.pow(life, F.lit(p)) - F.pow(last, F.lit(p))) / (F.lit(p) * (life - last))).otherwise(n * F.pow(last, F.lit(-decay)))
    return sigmoid(F.ln(F.pow(last, F.lit(-decay)) + spread))


def window_proximity(age_hours: Column, from_hours: Column, to_hours: Column) -> Column:
    """1 inside the window (hours before now), halving with every half width of distance."""
    width = F.when(from_hours > to_hours, from_hours - to_hours).otherwise(F.lit(24))
    away = F.greatest(age_hours - from_hours, to_hours - age_hours, F.lit(0))
    return F.pow(F.lit(2.0), -away / (width / 2.0))


def bm25(tf: Column, df: Column, n_docs: Column, length: Column, mean_length: Column, k1: float = 1.2, b: float = 0.75) -> Column:
    idf = F.ln(F.lit(1.0) + (n_docs - df + 0.5) / (df + 0.5))
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean_length))


def tfidf(tf: Column, length: Column, df: Column, n_docs: Column) -> Column:
    return tf / length * F.ln(F.lit(1.0) + n_docs / (F.lit(1.0) + df))
