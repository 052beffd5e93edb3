"""Decision models as expressions and small tables: selection, exclusivity, tails, screening."""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltwork.functions import scores as S
from siltwork.operators.calibration import hit_rate

#: The share of all founders that each channel reaches, the neutral and any other share.
CHANNEL_SHARE = {"whatsapp": 0.70, "linkedin": 0.60, "github": 0.50, "hackernews": 0.45, "reddit": 0.35, "substack": 0.30, "inbound": 0.25}
OTHER_SHARE, NEUTRAL_SHARE, SELECTION_STRENGTH, MOST_AUDIENCE = 0.40, 0.5, 0.5, 10_000


def probit(p: float) -> float:
    """The standard normal quantile."""
    return statistics.NormalDist().inv_cdf(p)


def inverse_mills(z: float) -> float:
    """Density over distribution of the standard normal; far left, where both vanish, it is -z."""
    below = 0.5 * math.erfc(-z / math.sqrt(2))
    return -z if z < -30 or below < 1e-300 else statistics.NormalDist().pdf(z) / below


def selection_penalty(share: float, sigma: float = S.SIGMA_V, strength: float = SELECTION_STRENGTH) -> float:
    """How much worse founders of a channel are than those of a neutral one; below 0 they are better."""
    held = min(max(share, 1e-6), 1 - 1e-6)
    return strength * sigma * (inverse_mills(probit(held)) - inverse_mills(probit(NEUTRAL_SHARE)))


def selection_by_channel() -> dict[str, float]:
    """Penalty of each channel; under "" that of any other."""
    return {c: selection_penalty(q) for c, q in CHANNEL_SHARE.items()} | {"": selection_penalty(OTHER_SHARE)}


def adjusted(score: Column, channel: Column, penalties: dict[str, float]) -> Column:
    """A score less its channel's penalty, 0 at least."""
    less = F.lit(penalties[""])
    for name, value in penalties.items():
        if name:
            less = F.when(channel == name, value).otherwise(less)
    return F.greatest(F.lit(0.0), score - less)


def exclusivity_edge(private: str, public: str) -> float:
    """How much more a public score must show to equal a private one, each with its own likeness of errors."""
    alike = S.curse_by_channel(correlated=True)
    return alike.get(public, alike[""]) - alike.get(private, alike[""])


def break_even_audience(edge: float) -> int:
    """The largest audience at which a score with such an edge still wins.

    The expected maximum rises with the audience, so the answer is bracketed by doubling and
    then halved down.
    """
    beta = S.SIGMA_V**2 / (S.SIGMA_V**2 + S.SIGMA_E**2)
    target = edge / (beta * S.SIGMA_E)
    if edge <= 0 or S.expected_max_normal(2) > target:
        return 1
    low, high = 2, 4
    while high < MOST_AUDIENCE and S.expected_max_normal(high) <= target:
        low, high = high, 2 * high
    high = min(high, MOST_AUDIENCE + 1)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if S.expected_max_normal(middle) <= target else (low, middle)
    return low


def moments_exist(alpha: Column) -> Column:
    """Which moments a tail index leaves: struct(mean, variance); the Sharpe ratio and the central limit need the variance."""
    return F.struct((alpha > 1).alias("mean"), (alpha > 2).alias("variance"))


def any_hit(places: int, skill: Column | float, alpha: float = 1.8, pipeline: int = 200) -> Column:
    """Odds that one of so many positions returns the fund, by ranking skill (0 blind, 1 perfect)."""
    rates = F.transform(F.sequence(F.lit(1), F.lit(pipeline)), lambda i: hit_rate(i))
    mean = F.aggregate(rates, F.lit(0.0), lambda s, x: s + x) / pipeline
    top = F.slice(rates, 1, places)
    miss = F.aggregate(top, F.lit(0.0), lambda s, x: s + F.log1p(-(skill * x + (1 - skill) * mean) * places ** (-alpha)))
    return 1 - F.exp(miss)
