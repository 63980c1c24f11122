"""Finite-history Gaussian predictors: weights on a context and the covariance of the future."""

from __future__ import annotations

import numpy as np


def spectrum_covariance(density, n: int, tolerance: float = 1e-7, first: int = 65_536, most: int = 4_194_304) -> np.ndarray:
    """Autocovariances 0..n-1 of a density on [0, pi] (without 1/2pi), on grids refined until nothing changes.

    A refinement evaluates the density half way between the points it has: the
    mean of both grids' sums is the finer grid's, half their difference the change.
    """
    size = max(first, 1 << (2 * n - 1).bit_length())
    lags = np.arange(n)
    found = np.fft.irfft(density(2 * np.pi * np.arange(size // 2 + 1) / size), n=size)[:n]
    while size < most:
        # Points half a step on, mirrored at pi, where a density is symmetric.
        half = density(2 * np.pi * (np.arange(size // 2) + 0.5) / size)
        between = (np.fft.ifft(np.concatenate([half, half[::-1]]))[:n] * np.exp(1j * np.pi * lags / size)).real
        change = np.abs(between - found).max() / 2
        found, size = (found + between) / 2, 2 * size
        if change <= tolerance * max(abs(found[0]), 1e-12):
            return found
    raise ValueError("the covariance doesn't settle on the largest grid")


def gaussian_predictor(gamma: np.ndarray, context: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (horizon x context, oldest first) and covariance of the future given the context."""
    i = np.arange(context + horizon)
    full = gamma[np.abs(i[:, None] - i)]
    past, cross = full[:context, :context], full[context:, :context]
    weights = np.linalg.solve(past, cross.T).T
    cov = full[context:, context:] - weights @ cross.T
    return weights, (cov + cov.T) / 2


def tempered_density(sigma2: float, lam: float, d: float, phi: float = 0.0, theta: float = 0.0):
    def density(w: np.ndarray) -> np.ndarray:
        q = 4 * np.sin(w / 2) ** 2
        out = sigma2 * (np.expm1(-lam) ** 2 + np.exp(-lam) * q) ** -d
        return out * ((1 + theta) ** 2 - theta * q) / ((1 - phi) ** 2 + phi * q)

    return density


def arma_predictor(phi: float, theta: float, sigma2: float, context: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and covariance for an ARMA(1,1), from its state (next value, theta times the last shock).

    The filter runs on unit vectors in place of data, so its state is a matrix
    of weights on the context. Future values are then written in terms of the
    state's error and the shocks to come.
    """
    move, load = np.array([[phi, 1.0], [0.0, 0.0]]), np.array([1.0, theta])
    shock = sigma2 * np.outer(load, load)
    stationary = sigma2 * (1 + 2 * phi * theta + theta * theta) / (1 - phi * phi)
    error = np.array([[stationary, sigma2 * theta], [sigma2 * theta, sigma2 * theta * theta]])
    state = np.zeros((2, context))
    for seen in np.eye(context):
        gain = error[:, 0] / error[0, 0]
        state = move @ (state + np.outer(gain, seen - state[0]))
        error = move @ (error - np.outer(gain, error[0])) @ move.T + shock
    weights, response = np.zeros((horizon, context)), np.zeros((horizon, 2 + horizon))
    carry = np.zeros((2, 2 + horizon))
    carry[:, :2] = np.eye(2)
    for h in range(horizon):
        weights[h], response[h] = state[0], carry[0]
        state, carry = move @ state, move @ carry
        carry[:, 2 + h] += load
    source = np.zeros((2 + horizon, 2 + horizon))
    source[:2, :2] = error
    source[2:, 2:] = sigma2 * np.eye(horizon)
    cov = response @ source @ response.T
    return weights, (cov + cov.T) / 2


def on_levels(weights: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From increments predicted by increments to levels predicted by levels, one more of them."""
    sums, cov = cumulated(weights, cov)
    edge = np.zeros((len(sums), 1))
    out = np.hstack([edge, sums]) - np.hstack([sums, edge])
    out[:, -1] += 1
    return out, cov


#: Which models are ARMA of the values, and which of their increments.
DIFFERENCES = {"ar1": 0, "arma11": 0, "arima110": 1, "arima011": 1, "arima111": 1}


def predictor(model: str, p: dict, context: int, horizon: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights on a context, oldest first, and covariance of the future.

    ar1 and the arima models predict levels by levels, arma11 and artfima01
    increments by increments, artfima10 values by its covariance.
    """
    if model in DIFFERENCES:
        d = DIFFERENCES[model]
        found = arma_predictor(p.get("phi", 0.0), p.get("theta", 0.0), p["sigma2"], context - d, horizon)
        return on_levels(*found) if d else found
    if model in ("artfima10", "artfima01"):
        density = tempered_density(p["sigma2"], p["lambda"], p["d"], phi=p.get("phi", 0.0), theta=p.get("theta", 0.0))
        return gaussian_predictor(spectrum_covariance(density, context + horizon), context, horizon)
    raise ValueError(f"no model {model}")


def cumulated(weights: np.ndarray, cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From predicted increments to predicted sums of them."""
    add = np.tril(np.ones((len(weights), len(weights))))
    return np.cumsum(weights, axis=0), add @ cov @ add.T


def sum_variances(cov: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Diagonal of R diag(s) C diag(s) R' for R the running sum: variances of scaled running sums."""
    return np.diag(np.cumsum(np.cumsum(cov * np.outer(scale, scale), axis=0), axis=1)).copy()
