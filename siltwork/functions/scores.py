"""Score expressions: vectors, recency, weighted signals, decision values."""

from __future__ import annotations

import math
import statistics
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default weights of the signals (the last one counts against) and of the rank score.
SIGNAL_WEIGHTS = {"is_building": 0.25, "thesis_fit": 0.30, "founder_quality": 0.25, "timing": 0.15, "reachable": 0.05, "too_late": -0.30}
RANK_WEIGHTS = {"similarity": 0.3, "thesis_match": 0.5, "recency": 0.2}
HALF_LIFE_DAYS = 90
#: Rivals per channel, how alike they err, and spreads of error and quality.
AUDIENCE = {"whatsapp": 3, "inbound": 8, "linkedin": 25, "reddit": 60, "substack": 80, "github": 120, "hackernews": 200}
CORRELATION = {"whatsapp": 0.10, "inbound": 0.20, "linkedin": 0.35, "reddit": 0.45, "substack": 0.50, "github": 0.50, "hackernews": 0.60}
OTHER_AUDIENCE, OTHER_CORRELATION, SIGMA_E, SIGMA_V = 100, 0.4, 0.15, 0.25
REWARD, LOSS, BASE_RATE, LINK_SLOPE, REVIEW_POWER, PANELS = 30.0, 1.0, 0.02, 7.2, 1.5, 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for zero vectors and for vectors of different lengths."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def recency(age_days: Column, half_life: float = HALF_LIFE_DAYS) -> Column:
    """Half after each half life; 0.5 for an unknown age and 1 for the future."""
    return F.when(age_days.isNull(), 0.5).when(age_days < 0, 1.0).otherwise(F.pow(F.lit(0.5), age_days / half_life))


def decay(age_days: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0.25), F.least(F.lit(1.0), F.exp(-age_days / 180))), F.lit(0.25))


def commit_recency(age_days: Column) -> Column:
    return F.when(age_days.isNull(), 0.4).when(age_days < 30, 1.0).when(age_days < 180, 0.85).when(age_days < 365, 0.6).otherwise(0.3)


def combine(signals: Mapping[str, Column], weights: Mapping[str, float] = SIGNAL_WEIGHTS) -> Column:
    """Weighted sum over the positive weights, held in 0 to 1; without positive weights 0."""
    total = sum(w for w in weights.values() if w > 0)
    if not total:
        return F.lit(0.0)
    terms = sum((F.coalesce(signals[k], F.lit(0.0)) * w for k, w in weights.items()), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), terms / total))


def explain(signals: Mapping[str, Column], weights: Mapping[str, float] = SIGNAL_WEIGHTS) -> Column:
    """Array of (size, name, contribution), the largest absolute contribution first."""
    total = sum(w for w in weights.values() if w > 0) or 1.0
    parts = []
    for name, w in weights.items():
        value = F.coalesce(signals[name], F.lit(0.0)) * w / total
        parts.append(F.struct((-F.round(F.abs(value), 9)).alias("size"), F.lit(name).alias("signal"), F.round(value, 9).alias("contribution")))
    return F.array_sort(F.array(*parts))


def rank_score(similarity: Column, match: Column, fresh: Column, weights: Mapping[str, float] = RANK_WEIGHTS) -> Column:
    return sum((F.coalesce(c, F.lit(0.0)) * weights[k] for k, c in (("similarity", similarity), ("thesis_match", match), ("recency", fresh))), F.lit(0.0))


def corroboration(sources: Column) -> Column:
    return F.when(sources == 2, 1.12).when(sources == 3, 1.2).when(sources > 3, 1.25).otherwise(1.0)


def expected_max_normal(n: int) -> float:
    """Mean of the largest of n standard normal draws: the integral of 1 - F(x)^n - F(-x)^n.

    A mean is the integral of the upper tail over x > 0 less that of the lower one. The
    trapezoid rule is exact here to rounding, as the integrand and its slopes vanish at 12
    and its odd slopes at 0 are taken in by Richardson's step.
    """
    normal = statistics.NormalDist()

    def area(panels: int) -> float:
        xs = [12.0 * i / panels for i in range(panels + 1)]
        tails = [1.0 - normal.cdf(x) ** n - normal.cdf(-x) ** n for x in xs]
        return 12.0 / panels * (math.fsum(tails) - (tails[0] + tails[-1]) / 2)

    return (4 * area(4096) - area(2048)) / 3 if n > 1 else 0.0


def curse_penalty(audience: int, rho: float = 0.0, sigma_e: float = SIGMA_E, sigma_v: float = SIGMA_V) -> float:
    """What winning against an audience overstates a score by."""
    beta = sigma_v**2 / (sigma_v**2 + sigma_e**2)
    return beta * sigma_e * math.sqrt(1 - min(max(rho, 0.0), 1.0)) * expected_max_normal(max(1, audience))


def curse_by_channel(correlated: bool = False) -> dict[str, float]:
    """Penalty of each channel; under "" that of any other."""
    found = {c: curse_penalty(n, CORRELATION[c] if correlated else 0.0) for c, n in AUDIENCE.items()}
    return found | {"": curse_penalty(OTHER_AUDIENCE, OTHER_CORRELATION if correlated else 0.0)}


def posterior(score: Column, base_rate: float = BASE_RATE, slope: float = LINK_SLOPE) -> Column:
    return 1 / (1 + F.exp(-(F.lit(math.log(base_rate / (1 - base_rate))) + (score - 0.5) * slope)))


def decision_value(p: Column, reward: float = REWARD, loss: float = LOSS) -> Column:
    return F.greatest(p * reward - (1 - p) * loss, F.lit(0.0))


def evpi(p: Column, reward: float = REWARD, loss: float = LOSS) -> Column:
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p))
    return F.when(p < loss / (reward + loss), p * reward).otherwise((1 - p) * loss)


def evsi(p: Column, power: float = REVIEW_POWER, panels: int = PANELS) -> Column:
    """Value of one noisy review, by Simpson's rule over its outcome; 0 where nothing is open."""
    low = -6.0 - power
    step = -2 * low / panels

    def add(total: Column, i: Column) -> Column:
        x = low + i * step
        good, bad = p * F.exp(-0.5 * (x - power / 2) * (x - power / 2)), (1 - p) * F.exp(-0.5 * (x + power / 2) * (x + power / 2))
        weight = F.when((i == 0) | (i == panels), 1).when(i % 2 == 1, 4).otherwise(2)
        return total + weight * F.greatest(good * REWARD - bad * LOSS, F.lit(0.0))

    integral = F.aggregate(F.sequence(F.lit(0), F.lit(panels)), F.lit(0.0), add) * (step / 3 / math.sqrt(2 * math.pi))
    return F.when((p > 0) & (p < 1), F.greatest(F.lit(0.0), integral - decision_value(p))).otherwise(0.0)


def launch_strength(votes: Column, comments: Column, makers: Column, tagline: Column) -> Column:
    points = F.least(votes, F.lit(1000)) * 0.055 + F.least(comments, F.lit(200)) * 0.16 + F.when(makers > 0, 8).otherwise(0) + F.when(F.length(tagline) > 20, 6).otherwise(0)
    return F.floor(F.round(F.least(F.lit(100.0), points), 9) + 0.5).cast("long")
