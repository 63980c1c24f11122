"""Column expressions: spectral densities, Whittle terms, scores. All of it stays in generated JVM code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2 * math.pi


def half_angle(omega: Column) -> Column:
    """q = 4 sin^2(omega / 2)."""
    return 4 * F.pow(F.sin(omega / 2), 2)


def coefficients(partial: Sequence[float], moving_average: bool = False) -> list[float]:
    """Durbin-Levinson: partial coefficients to ordinary ones."""
    sign, out = (1.0 if moving_average else -1.0), []
    for k in partial:
        out = [a + sign * k * b for a, b in zip(out, reversed(out), strict=True)] + [float(k)]
    return out


def _polynomial_power(omega: Column, coef: Sequence[float], sign: float) -> Column:
    """|1 + sign * sum c_j exp(-i j omega)|^2; for one coefficient the form without cancellation."""
    if len(coef) == 1:
        c = sign * coef[0]
        q, p = half_angle(omega), 4 * F.pow(F.cos(omega / 2), 2)
        return (1 + c) ** 2 - c * q if c < 0 else (1 - c) ** 2 + c * p
    re, im = F.lit(1.0), F.lit(0.0)
    for j, c in enumerate(coef, 1):
        re, im = re + sign * c * F.cos(j * omega), im + sign * c * F.sin(j * omega)
    return re * re + im * im


def spectral_density(omega: Column, phi: Sequence[float] = (), theta: Sequence[float] = (), sigma2: float = 1.0, d: float = 0.0, lam: float = 0.0) -> Column:
    """Density of an ARMA process, tempered and fractionally integrated where d is not zero."""
    out = F.lit(sigma2 / TWO_PI)
    if theta:
        out = out * _polynomial_power(omega, list(theta), 1.0)
    if phi:
        out = out / _polynomial_power(omega, list(phi), -1.0)
    if d:
        out = out * F.pow(math.expm1(-lam) ** 2 + math.exp(-lam) * half_angle(omega), -d)
    return out


def whittle_term(power: Column, density: Column) -> Column:
    """A frequency's part of the log-likelihood: -(ln f + I / f)."""
    return -(F.log(density) + power / density)


def array_quantile(ordered: Column, p: float) -> Column:
    """Linear-interpolation quantile of a sorted array."""
    at = (F.size(ordered) - 1) * F.lit(p)
    low = F.floor(at).cast("int")
    a = F.element_at(ordered, low + 1)
    b = F.element_at(ordered, F.least(low + 2, F.size(ordered)))
    return a + (at - low) * (b - a)


def crps(ordered: Column, actual: Column) -> Column:
    """Sample CRPS from sorted draws: mean |x - a| - sum (2i - n - 1) x_(i) / n^2."""
    n = F.size(ordered).cast("double")
    spread = F.aggregate(F.transform(ordered, lambda x, i: (2 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x)
    away = F.aggregate(ordered, F.lit(0.0), lambda a, x: a + F.abs(x - actual))
    return away / n - spread / (n * n)


def interval_score(actual: Column, lower: Column, upper: Column, alpha: float) -> Column:
    """Width plus 2 / alpha times what the actual value lies outside."""
    below = F.when(actual < lower, lower - actual).otherwise(0.0)
    above = F.when(actual > upper, actual - upper).otherwise(0.0)
    return upper - lower + (below + above) * (2 / alpha)


def scores_of(actual: Column, point: Column, sample_crps: Column, lo95: Column, lo80: Column, hi80: Column, hi95: Column) -> dict[str, Column]:
    """Scores of a forecast from its CRPS and quantiles; null where the actual value is, while the forecast itself stays."""
    known = actual.isNotNull() & ~F.isnan(actual)
    only = lambda c: F.when(known, c)
    return {
        "ae": only(F.abs(point - actual)),
        "se": only(F.pow(point - actual, 2)),
        "crps": only(sample_crps),
        "lower80": lo80,
        "upper80": hi80,
        "lower95": lo95,
        "upper95": hi95,
        "cover80": only(((lo80 <= actual) & (actual <= hi80)).cast("double")),
        "cover95": only(((lo95 <= actual) & (actual <= hi95)).cast("double")),
        "interval80": only(interval_score(actual, lo80, hi80, 0.2)),
        "interval95": only(interval_score(actual, lo95, hi95, 0.05)),
    }


def score_columns(actual: Column, point: Column, ordered: Column) -> dict[str, Column]:
    """Scores of a forecast whose draws are a sorted array."""
    return scores_of(actual, point, crps(ordered, actual), *(array_quantile(ordered, p) for p in (0.025, 0.1, 0.9, 0.975)))


def arma11_sums(q: Column, power: Column, phi: float, theta: float) -> dict[str, Column]:
    """Energy of an ARMA(1,1) at (phi, theta) and its derivatives, as terms to add up over frequencies."""
    ma, ar = (1 + theta) ** 2 - theta * q, (1 - phi) ** 2 + phi * q
    dma, dar = 2 * (1 + theta) - q, q - 2 * (1 - phi)
    return {
        "energy": power * ar / ma,
        "d_phi": power * dar / ma,
        "d_theta": -power * ar * dma / (ma * ma),
        "d_phi_phi": 2 * power / ma,
        "d_phi_theta": -power * dar * dma / (ma * ma),
        "d_theta_theta": power * ar * (2 * dma * dma / (ma * ma * ma) - 2 / (ma * ma)),
    }
