"""Formulas on plain numbers."""

from __future__ import annotations

import math
from statistics import NormalDist

from tidemark.config import ValidationError, one_of

#: Two-sided normal quantiles by confidence; fixed values.
Z = {0.90: 1.645, 0.95: 1.960, 0.99: 2.576}
#: Euler-Mascheroni.
GAMMA = 0.5772156649015329


def volatility_scale(periods_per_year: float) -> float:
    """Factor from one period's volatility to a year's."""
    if periods_per_year <= 0:
        raise ValidationError(f"periods_per_year must be positive, not {periods_per_year}")
    return math.sqrt(periods_per_year)


def newey_west_lags(n: int) -> int:
    """Lags for n observations."""
    return math.floor(4 * (n / 100) ** (2 / 9)) if n > 0 else 0


def bias_confidence_interval(n: int, *, confidence: float = 0.95) -> tuple[float, float]:
    """Band around 1 in which a bias statistic of n observations lies for a right risk model."""
    one_of("confidence", confidence, Z)
    if n < 1:
        raise ValidationError(f"n must be at least 1, not {n}")
    half = Z[confidence] / math.sqrt(2 * n)
    return 1 - half, 1 + half


def expected_max_sharpe(n_trials: int, *, variance: float) -> float:
    """Expected largest of n independent Sharpe ratios of that variance and no skill."""
    if n_trials < 2 or variance < 0:
        raise ValidationError("n_trials must be at least 2 and variance at least 0")
    z = NormalDist().inv_cdf
    return math.sqrt(variance) * ((1 - GAMMA) * z(1 - 1 / n_trials) + GAMMA * z(1 - 1 / (n_trials * math.e)))
