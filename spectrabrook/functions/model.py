"""Model specifications, parameter layouts, transforms and priors. NumPy only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np

from spectrabrook.functions.columns import coefficients

LN2 = float(np.log(2.0))


@dataclass(frozen=True)
class Spec:
    """ARMA(p, q), tempered fractional where `tempered`, with `covariates` regression coefficients.

    Parameters lie in one vector: partial AR, partial MA, betas, then log
    sigma2, or log lambda, log sigma2, d where tempered, and mu last where
    `mean` is set.
    """

    ar: int = 0
    ma: int = 0
    tempered: bool = False
    covariates: int = 0
    mean: bool = False
    #: "core": standard normal tails; "wide": normal tails of sd 10, log lambda N(-2.3, 0.4).
    prior: str = "core"

    def __post_init__(self):
        if min(self.ar, self.ma, self.covariates) < 0:
            raise ValueError("orders can't be negative")
        if self.prior not in ("core", "wide"):
            raise ValueError("prior must be core or wide")

    @property
    def bounded(self) -> int:
        return self.ar + self.ma

    @property
    def tail(self) -> int:
        return 3 if self.tempered else 1

    @property
    def size(self) -> int:
        return self.bounded + self.covariates + self.tail + self.mean

    def names(self, transformed: bool = True) -> list[str]:
        """phi1.. theta1.. beta1.. [lambda] sigma2 [d] [mu]; log_ in front of scales that aren't transformed."""
        log = "" if transformed else "log_"
        out = [f"phi{i + 1}" for i in range(self.ar)] + [f"theta{i + 1}" for i in range(self.ma)] + [f"beta{i + 1}" for i in range(self.covariates)]
        out += [f"{log}lambda", f"{log}sigma2", "d"] if self.tempered else [f"{log}sigma2"]
        return out + ["mu"] * self.mean

    def split(self, x: Sequence) -> dict:
        """Named parts; works for complex parameters too, so derivatives can use complex steps."""
        x = np.asarray(x)
        b = self.bounded
        tail = x[b + self.covariates :]
        log_lambda, log_sigma2, d = (tail[0], tail[1], tail[2]) if self.tempered else (None, tail[0], 0.0)
        return {"ar": x[: self.ar], "ma": x[self.ar : b], "beta": x[b : b + self.covariates], "log_lambda": log_lambda, "log_sigma2": log_sigma2, "d": d, "mu": x[-1] if self.mean else 0.0}

    def transformed(self, draws: np.ndarray) -> np.ndarray:
        """Draws on the reporting scale: ordinary coefficients, lambda and sigma2."""
        draws = np.atleast_2d(np.asarray(draws, float))
        out = draws.copy()
        for i, row in enumerate(draws):
            out[i, : self.ar] = coefficients(row[: self.ar])
            out[i, self.ar : self.bounded] = coefficients(row[self.ar : self.bounded], True)
        at = self.bounded + self.covariates
        for j in (at, at + 1) if self.tempered else (at,):
            out[:, j] = np.exp(draws[:, j])
        return out

    def supported(self, x: Sequence[float]) -> bool:
        x = np.asarray(x, float)
        return bool(np.isfinite(x).all() and (np.abs(x[: self.bounded]) < 1).all())

    def log_prior(self, x, shards: int = 1):
        """Log prior divided by the number of shards; -inf outside the support."""
        x = np.asarray(x)
        if not self.supported(x.real if np.iscomplexobj(x) else x):
            return -np.inf
        rest = x[self.bounded :]
        sd, centre = np.full(len(rest), 1.0 if self.prior == "core" else 10.0), np.zeros(len(rest))
        if self.covariates and self.prior == "core":
            sd[: self.covariates] = 10.0
        if self.tempered and self.prior == "wide":
            centre[self.covariates], sd[self.covariates] = -2.3, np.sqrt(0.4)
        return (-self.bounded * LN2 - (0.5 * ((rest - centre) / sd) ** 2 + np.log(sd) + 0.5 * np.log(2 * np.pi)).sum()) / shards

    def start(self, seed: int) -> np.ndarray:
        rng = np.random.default_rng(seed)
        return 0.1 + rng.normal(0, 0.05, self.size) if self.covariates else 0.01 + rng.normal(0, 0.1, self.size)

    def without_mean(self) -> Spec:
        return replace(self, mean=False)


def complex_coefficients(partial, moving_average: bool = False) -> list:
    """coefficients() for complex numbers."""
    sign, out = (1.0 if moving_average else -1.0), []
    for k in partial:
        out = [a + sign * k * b for a, b in zip(out, reversed(out), strict=True)] + [k]
    return out


@dataclass(frozen=True)
class Settings:
    """Sampling: draws kept after burn draws, chains, and the proposal's scale (None: 2.38^2 / d)."""

    draws: int = 1000
    burn: int = 500
    chains: int = 1
    seed: int = 1
    scale: float | None = None
    optimise: bool = True
    basins: int = 0
