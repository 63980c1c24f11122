"""Whittle posteriors, optimisation and Metropolis samplers in NumPy; no Spark here."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from spectrabrook.functions.model import Settings, Spec, complex_coefficients


class Whittle:
    """A shard's log posterior: -sum(ln f + I / f) plus the prior's share, with derivatives.

    power holds the periodogram; with covariates, y and x hold spectra (x one
    column each) and n the series length, and the periodogram is that of the
    residual. mean is (sample mean, n) where the model has a mean term.
    """

    def __init__(self, spec: Spec, omega: np.ndarray, power: np.ndarray | None = None, shards: int = 1, y: np.ndarray | None = None, x: np.ndarray | None = None, n: int | None = None, mean: tuple[float, int] | None = None):
        self.spec, self.omega, self.power, self.shards = spec, np.asarray(omega, float), power, shards
        self.y, self.x, self.n, self.mean = y, x, n, mean
        self.q, self.p = 4 * np.sin(self.omega / 2) ** 2, 4 * np.cos(self.omega / 2) ** 2
        k = np.arange(1, max(spec.ar, spec.ma, 1) + 1)
        self.cos, self.sin = np.cos(np.outer(self.omega, k)), np.sin(np.outer(self.omega, k))
        if spec.mean and (mean is None or not np.isfinite(mean[0]) or mean[1] < 1):
            raise ValueError("a mean term needs the sample mean and the series length")
        if spec.mean:
            w, self.mean_weight = mean_rule(mean[1])
            self.mean_density = Whittle(spec.without_mean(), w)

    def _log_polynomial(self, coef: list, sign: float) -> np.ndarray:
        if len(coef) == 1:
            c = sign * coef[0]
            # (1 + c)^2 - c q near omega = 0, (1 - c)^2 + c p near pi: neither cancels.
            near_zero = (1 + c) ** 2 - c * self.q
            near_pi = (1 - c) ** 2 + c * self.p
            return np.log(np.where(np.real(c) < 0, near_zero, near_pi))
        c = sign * np.array(coef)
        m = len(coef)
        return np.log((1 + self.cos[:, :m] @ c) ** 2 + (self.sin[:, :m] @ c) ** 2)

    def log_density(self, theta) -> np.ndarray:
        s = self.spec.split(theta)
        out = np.zeros(len(self.omega), dtype=np.asarray(theta).dtype) + s["log_sigma2"] - np.log(2 * np.pi)
        if self.spec.ma:
            out = out + self._log_polynomial(complex_coefficients(s["ma"], True), 1.0)
        if self.spec.ar:
            out = out - self._log_polynomial(complex_coefficients(s["ar"]), -1.0)
        if self.spec.tempered:
            lam = np.exp(s["log_lambda"])
            out = out - s["d"] * np.log(np.expm1(-lam) ** 2 + np.exp(-lam) * self.q)
        return out

    def residual(self, beta) -> np.ndarray:
        if self.x is None:
            return self.power
        # Real arithmetic, so that complex steps in beta stay analytic.
        re, im = self.y.real - self.x.real @ beta, self.y.imag - self.x.imag @ beta
        return (re * re + im * im) / (2 * np.pi * self.n)

    def log_likelihood(self, theta):
        f = self.log_density(theta)
        return -(f + self.residual(self.spec.split(theta)["beta"]) * np.exp(-f)).sum()

    def log_mean(self, theta):
        """ln N(sample mean; mu, v) with v the mean's variance under the spectrum."""
        ybar, _ = self.mean
        v = (self.mean_weight * np.exp(self.mean_density.log_density(np.asarray(theta)[:-1]))).sum()
        return -0.5 * (np.log(2 * np.pi * v) + (ybar - theta[-1]) ** 2 / v)

    def __call__(self, theta):
        prior = self.spec.log_prior(theta, self.shards)
        if np.real(prior) == -np.inf:
            return -np.inf
        out = self.log_likelihood(theta) + prior
        return out + self.log_mean(theta) / self.shards if self.spec.mean else out

    def gradient(self, theta: np.ndarray) -> np.ndarray:
        step = 1e-30
        out = np.empty(len(theta))
        for j in range(len(theta)):
            z = theta.astype(complex)
            z[j] += 1j * step
            out[j] = np.imag(self(z)) / step
        return out

    def hessian(self, theta: np.ndarray, step: float = 1e-5) -> np.ndarray:
        out = np.empty((len(theta), len(theta)))
        for j in range(len(theta)):
            h = step * max(1.0, abs(theta[j]))
            if j < self.spec.bounded:
                h = min(h, (1 - abs(theta[j])) / 4)
            a, b = theta.copy(), theta.copy()
            a[j] += h
            b[j] -= h
            out[j] = (self.gradient(a) - self.gradient(b)) / (2 * h)
        return (out + out.T) / 2


def mean_rule(n: int, lobes: int = 256, each: int = 32, tail: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and weights that give the variance of a mean of n values from their density; at most some 12,000 of them.

    The variance is the density's integral against a kernel that oscillates with
    period 2 pi / n. A short series takes the midpoint rule on 8n points. A long
    one takes it on the first lobes alone, where nearly all the mass lies; beyond
    them the squared sine averages to a half over each lobe, and a geometric grid
    serves for the rest.
    """
    if 8 * n <= lobes * each:
        size = 1 << (max(1024, 8 * n) - 1).bit_length()
        w = (np.arange(size) + 0.5) * np.pi / size
        return w, 2 * np.pi / size * (np.sin(n * w / 2) / np.sin(w / 2)) ** 2 / n**2
    cut = 2 * np.pi * min(lobes, n // 4) / n
    count = min(lobes, n // 4) * each
    near = (np.arange(count) + 0.5) * cut / count
    edges = np.geomspace(cut, np.pi, tail + 1)
    # The kernel's part of a cell has a closed form: the integral of 1 / sin^2(w / 2) is -2 cot(w / 2).
    cot = -2 / np.tan(edges / 2)
    far = np.sqrt(edges[1:] * edges[:-1])
    w = np.concatenate([near, far])
    return w, 2 * np.concatenate([cut / count * (np.sin(n * near / 2) / np.sin(near / 2)) ** 2, np.diff(cot) / 2]) / n**2


def positive_definite(matrix: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """The matrix with eigenvalues raised to at least `least`."""
    w, v = np.linalg.eigh((matrix + matrix.T) / 2)
    return (v * np.maximum(w, least)) @ v.T


@dataclass
class Fit:
    theta: np.ndarray
    log_p: float
    covariance: np.ndarray
    newton_distance: float
    proper: bool

    @property
    def accepted(self) -> bool:
        """A stationary point with a definite Hessian, whatever the optimiser said."""
        return self.proper and self.newton_distance <= 0.01


def newton(target: Whittle, start: np.ndarray, rounds: int = 100) -> Fit:
    """Damped Newton in unconstrained coordinates: atanh for partial coefficients, identity otherwise."""
    b = target.spec.bounded
    theta = np.array(start, float)
    theta[:b] = np.clip(theta[:b], -0.999, 0.999)
    value = target(theta)
    for _ in range(rounds):
        g, h = target.gradient(theta), target.hessian(theta)
        jac = np.ones(len(theta))
        jac[:b] = 1 - theta[:b] ** 2
        gu, hu = g * jac, h * np.outer(jac, jac) - np.diag(np.r_[2 * theta[:b] * jac[:b] * g[:b], np.zeros(len(theta) - b)])
        w, v = np.linalg.eigh(-hu)
        move = v @ ((v.T @ gu) / np.maximum(np.abs(w), 1e-8 * max(1.0, np.abs(w).max())))
        decrement = float(gu @ move)
        if decrement < 1e-12:
            break
        u, step = theta.copy(), 1.0
        u[:b] = np.arctanh(theta[:b])
        for _ in range(40):
            trial = u + step * move
            trial[:b] = np.tanh(np.clip(trial[:b], -17, 17))
            new = target(trial) if np.isfinite(trial).all() else -np.inf
            if np.isfinite(new) and new >= value + 1e-4 * step * decrement:
                break
            step /= 2
        else:
            break
        theta, value = trial, float(new)
    h = -target.hessian(theta)
    w = np.linalg.eigvalsh(h)
    g = target.gradient(theta)
    fixed = positive_definite(h)
    return Fit(theta, float(value), np.linalg.inv(fixed), float(np.sqrt(max(0.0, g @ np.linalg.solve(fixed, g)))), bool(w.min() > 0))


def fit_map(target: Whittle, settings: Settings, group: int = 0, starts: int = 1) -> Fit:
    """The best of several starts and basin steps; without optimisation the start and a small fixed covariance."""
    spec = target.spec
    first = spec.start(settings.seed + group)
    if not settings.optimise:
        return Fit(first, float(target(first)), 0.02 * np.eye(spec.size), np.inf, False)
    rng = np.random.default_rng(settings.seed + 5000 + group)
    best = newton(target, first)
    for i in range(starts - 1 + settings.basins):
        begin = spec.start(settings.seed + 7919 * (i + 1) + group) if i < starts - 1 else best.theta + rng.normal(0, 0.3, spec.size)
        begin[: spec.bounded] = np.clip(begin[: spec.bounded], -0.95, 0.95)
        other = newton(target, begin)
        best = other if np.isfinite(other.log_p) and other.log_p > best.log_p else best
    return best


def pilot_fit(spec: Spec, omega: np.ndarray, power: np.ndarray, shards: int, settings: Settings, every: int = 64, starts: int = 5) -> Fit:
    """Several starts on every 64th ordinate, then Newton on all of them from the best two."""
    if len(omega) < 64 * every:
        return fit_map(Whittle(spec, omega, power, shards), settings, starts=starts)
    pilot = Whittle(spec, omega[::every], power[::every], shards)
    found = sorted((newton(pilot, spec.start(settings.seed + i)) for i in range(starts)), key=lambda f: -f.log_p)
    full = Whittle(spec, omega, power, shards)
    return max((newton(full, f.theta) for f in found[:2]), key=lambda f: f.log_p)


@dataclass
class Chain:
    """Draws, their log densities, which were accepted, and the generator's state for going on."""

    draws: np.ndarray
    log_p: np.ndarray
    accepted: np.ndarray
    state: str


def random_walk(target: Callable, spec_bounded: int, start: np.ndarray, covariance: np.ndarray, n: int, rng: np.random.Generator) -> Chain:
    """Metropolis with one normal vector and then one uniform each step; outside the support nothing is evaluated."""
    theta, value = np.array(start, float), float(target(np.array(start, float)))
    draws, log_p, accepted = np.empty((n, len(theta))), np.empty(n), np.zeros(n, bool)
    zero = np.zeros(len(theta))
    for i in range(n):
        trial = theta + rng.multivariate_normal(zero, covariance, method="cholesky")
        u = rng.random()
        if (np.abs(trial[:spec_bounded]) < 1).all():
            new = float(target(trial))
            if np.log(u) < min(0.0, new - value):
                theta, value, accepted[i] = trial, new, True
        draws[i], log_p[i] = theta, value
    return Chain(draws, log_p, accepted, json.dumps(rng.bit_generator.state))


def adaptive_walk(target: Callable, spec_bounded: int, start: np.ndarray, covariance: np.ndarray, burn: int, n: int, rng: np.random.Generator, goal: float = 0.234, every: int = 100) -> Chain:
    """A random walk whose scale moves towards the goal while burning in, and is fixed after that."""
    scale, theta = 1.0, np.array(start, float)
    for _ in range(burn // every):
        part = random_walk(target, spec_bounded, theta, scale**2 * covariance, every, rng)
        theta = part.draws[-1]
        scale *= float(np.exp(part.accepted.mean() - goal))
    return random_walk(target, spec_bounded, theta, scale**2 * covariance, n, rng)


def mixture_walk(target: Callable, centre: np.ndarray, covariance: np.ndarray, start: np.ndarray, n: int, rng: np.random.Generator, independent: float = 0.8, widen: float = 1.2) -> Chain:
    """Independence proposals around centre mixed with random-walk ones, with the full Hastings ratio for the former."""
    d = len(centre)
    wide = np.linalg.cholesky(widen**2 * covariance)
    narrow = np.linalg.cholesky(2.38**2 / d * covariance)
    log_q = lambda x: -0.5 * (np.linalg.solve(wide, x - centre) ** 2).sum()
    theta, value = np.array(start, float), float(target(np.array(start, float)))
    draws, log_p, accepted = np.empty((n, d)), np.empty(n), np.zeros(n, bool)
    for i in range(n):
        jump, z, u = rng.random() < independent, rng.standard_normal(d), rng.random()
        trial = centre + wide @ z if jump else theta + narrow @ z
        new = float(target(trial))
        ratio = new - value + (log_q(theta) - log_q(trial) if jump else 0.0)
        if np.isfinite(new) and np.log(u) < min(0.0, ratio):
            theta, value, accepted[i] = trial, new, True
        draws[i], log_p[i] = theta, value
    return Chain(draws, log_p, accepted, json.dumps(rng.bit_generator.state))


def mode_jumps(target: Callable, spec_bounded: int, modes: list[Fit], start: np.ndarray, n: int, rng: np.random.Generator, jump: float = 0.1) -> Chain:
    """A random walk with occasional exact draws from a Gaussian mixture over modes."""
    d = len(start)
    roots = [np.linalg.cholesky(m.covariance) for m in modes]

    def log_mix(x: np.ndarray) -> float:
        parts = [-0.5 * (np.linalg.solve(r, x - m.theta) ** 2).sum() - np.log(np.diag(r)).sum() for m, r in zip(modes, roots, strict=True)]
        return float(np.logaddexp.reduce(parts))

    walk = np.linalg.cholesky(2.38**2 / d * modes[0].covariance)
    theta, value = np.array(start, float), float(target(np.array(start, float)))
    draws, log_p, accepted = np.empty((n, d)), np.empty(n), np.zeros(n, bool)
    for i in range(n):
        far, which, z, u = rng.random() < jump, int(rng.integers(len(modes))), rng.standard_normal(d), rng.random()
        trial = modes[which].theta + roots[which] @ z if far else theta + walk @ z
        if (np.abs(trial[:spec_bounded]) < 1).all():
            new = float(target(trial))
            if np.log(u) < min(0.0, new - value + (log_mix(theta) - log_mix(trial) if far else 0.0)):
                theta, value, accepted[i] = trial, new, True
        draws[i], log_p[i] = theta, value
    return Chain(draws, log_p, accepted, json.dumps(rng.bit_generator.state))


def distinct_modes(fits: list[Fit], least: float = 1.0) -> list[Fit]:
    """Fits that lie at least `least` apart in units of the first one's scale, best first."""
    out: list[Fit] = []
    for f in sorted(fits, key=lambda f: -f.log_p):
        scale = np.sqrt(np.diag((out[0] if out else f).covariance))
        if all(np.linalg.norm((f.theta - g.theta) / scale) >= least for g in out):
            out.append(f)
    return out


# Coordinates of the tempered MA(1) model near its boundary.


def to_coordinates(theta: np.ndarray) -> np.ndarray:
    """(theta, log lambda, log sigma2, d) to (atanh theta, sqrt lambda, log sigma2, d)."""
    return np.array([np.arctanh(theta[0]), np.exp(theta[1] / 2), theta[2], theta[3]])


def from_coordinates(x: np.ndarray) -> np.ndarray:
    return np.array([np.tanh(x[0]), 2 * np.log(x[1]), x[2], x[3]])


def log_jacobian(x: np.ndarray) -> float:
    """ln |d theta / d x|; a shard gets its share of it as of the prior."""
    return float(-2 * np.log(np.cosh(x[0])) + np.log(2 / x[1]))


def coordinate_target(target: Whittle) -> Callable[[np.ndarray], float]:
    def value(x: np.ndarray) -> float:
        if not x[1] > 0:
            return -np.inf
        return float(target(from_coordinates(x))) + log_jacobian(x) / target.shards

    return value


def numeric_hessian(f: Callable, x: np.ndarray, step: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian by central differences."""
    d = len(x)
    e = np.eye(d) * step * np.maximum(1.0, np.abs(x))
    g, h = np.empty(d), np.empty((d, d))
    at = f(x)
    for i in range(d):
        a, b = f(x + e[i]), f(x - e[i])
        g[i], h[i, i] = (a - b) / (2 * e[i, i]), (a - 2 * at + b) / e[i, i] ** 2
        for j in range(i):
            h[i, j] = h[j, i] = (f(x + e[i] + e[j]) - f(x + e[i] - e[j]) - f(x - e[i] + e[j]) + f(x - e[i] - e[j])) / (4 * e[i, i] * e[j, j])
    return g, h


def polish(f: Callable, x: np.ndarray, rounds: int = 21, halvings: int = 25, least: float = 1e-3) -> tuple[np.ndarray, np.ndarray, float]:
    """Newton to a decrement of at most `least`, halving steps that don't rise: point, inverse negative Hessian, decrement."""
    x = np.array(x, float)
    for _ in range(rounds):
        g, h = numeric_hessian(f, x)
        fixed = positive_definite(-h)
        move = np.linalg.solve(fixed, g)
        decrement = float(np.sqrt(max(0.0, g @ move)))
        if decrement <= least:
            break
        step, at = 1.0, f(x)
        for _ in range(halvings):
            if f(x + step * move) > at:
                break
            step /= 2
        x = x + step * move
    return x, np.linalg.inv(positive_definite(-numeric_hessian(f, x)[1])), decrement


# Closed forms that need no pass over frequencies.


def ar1_target(n: int, sum_power: float, sum_q_power: float, phi: float, log_sigma2: float, shards: int = 1) -> float:
    """-sum(ln f + I / f) + prior for AR(1) on frequencies 1..n/2-1 of an even n, from two sums.

    The product of |1 - phi e^{-iw}|^2 over all n-th roots of unity is
    (1 - phi^n)^2; the roots 1 and -1 are taken out.
    """
    half = n // 2 - 1
    log_product = np.log1p(-(phi**n)) - np.log1p(-phi) - np.log1p(phi)
    energy = 2 * np.pi * np.exp(-log_sigma2) * ((1 - phi) ** 2 * sum_power + phi * sum_q_power)
    return float(-half * (log_sigma2 - np.log(2 * np.pi)) + log_product - energy + Spec(ar=1).log_prior(np.array([phi, log_sigma2]), shards))


def fit_ar1(n: int, sum_power: float, sum_q_power: float) -> tuple[np.ndarray, np.ndarray, float]:
    """MAP of AR(1) from the two sums: (phi, log sigma2), covariance, Newton decrement."""
    phi = 1 - sum_q_power / (2 * sum_power) if sum_power else 0.0
    start = np.array([np.arctanh(np.clip(phi, -0.99, 0.99)), np.log(max(2 * np.pi * sum_power / max(1, n // 2 - 1), 1e-300))])
    f = lambda u: ar1_target(n, sum_power, sum_q_power, float(np.tanh(u[0])), float(u[1]))
    x, cov, dec = polish(f, start, rounds=60, least=1e-6)
    jac = np.diag([1 - np.tanh(x[0]) ** 2, 1.0])
    return np.array([np.tanh(x[0]), x[1]]), jac @ cov @ jac, dec


def half_log_product(c: float, n: int) -> tuple[float, float, float]:
    """sum of ln |1 - c e^{-iw}|^2 over the positive frequencies below pi of n points, with two derivatives in c.

    All n roots of unity multiply to 1 - c^n; those at 0 and, if n is even, at
    pi are taken off, and the rest come in conjugate pairs.
    """
    z = c**n
    terms = [(2 * np.log1p(-z), -2 * n * z / c / (1 - z) if c else 0.0, -2 * n * ((n - 1) * z + z * z) / (c * (1 - z)) ** 2 if c else 0.0)]
    terms.append((-2 * np.log1p(-c), 2 / (1 - c), 2 / (1 - c) ** 2))
    if n % 2 == 0:
        terms.append((-2 * np.log1p(c), -2 / (1 + c), 2 / (1 + c) ** 2))
    return tuple(float(sum(t)) / 2 for t in zip(*terms, strict=True))


def fit_arma11(sums: Callable[[float, float], dict[str, float]], n: int, start: tuple[float, float] = (0.1, -0.1), rounds: int = 60, enough: float = 1e-8) -> tuple[np.ndarray, np.ndarray, float]:
    """MAP of an ARMA(1,1) from its energy sums: (phi, theta, log sigma2), covariance, Newton decrement.

    sums(phi, theta) gives arma11_sums added up over the positive frequencies:
    one aggregate for each step, however long the series. The logarithms need
    none, they have closed forms; coefficients are uniform, log sigma2 is
    standard normal. Steps are damped until the posterior rises.
    """
    m = (n - 1) // 2

    def at(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        phi, theta, s = x
        e, (la, da, daa), (lm, dm, dmm) = sums(phi, theta), half_log_product(phi, n), half_log_product(-theta, n)
        scale = 2 * np.pi * np.exp(-s)
        value = m * (s - np.log(2 * np.pi)) + lm - la + scale * e["energy"] + s * s / 2
        grad = np.array([scale * e["d_phi"] - da, scale * e["d_theta"] - dm, m - scale * e["energy"] + s])
        cross = [-scale * e["d_phi"], -scale * e["d_theta"]]
        hess = np.array([[scale * e["d_phi_phi"] - daa, scale * e["d_phi_theta"], cross[0]], [scale * e["d_phi_theta"], scale * e["d_theta_theta"] + dmm, cross[1]], [*cross, scale * e["energy"] + 1]])
        return value, grad, hess

    x = np.array([*start, 0.0])
    x[2] = np.log(2 * np.pi * max(sums(*start)["energy"], 1e-300) / max(m, 1))
    value, grad, hess = at(x)
    for _ in range(rounds):
        w, v = np.linalg.eigh(hess)
        step = -v @ ((v.T @ grad) / np.maximum(np.abs(w), 1e-8))
        decrement = float(-grad @ step)
        if decrement <= enough:
            break
        size = 1.0
        while (np.abs(x[:2] + size * step[:2]) >= 1).any():
            size /= 2
        while True:
            trial = x + size * step
            new = at(trial)
            if new[0] <= value - 1e-4 * size * decrement or size < 1e-8:
                break
            size /= 2
        x, (value, grad, hess) = trial, new
    return x, np.linalg.inv(positive_definite(hess)), decrement


def log_root_product(c: float, n: int, shards: int = 1, shard: int = 0) -> float:
    """sum of ln |1 - c e^{-iw}|^2 over one systematic shard of all n-th roots of unity, n divisible by shards."""
    m = n // shards
    turn = 2 * np.pi * shard * m / n
    z = c**m
    return float(np.log(1 - 2 * z * np.cos(turn) + z * z))


def sine_power(x: np.ndarray) -> np.ndarray:
    """Squares of the orthonormal sine transform of x: the part of x along each eigenvector of a tridiagonal Toeplitz matrix."""
    n = len(x)
    odd = np.concatenate([[0.0], x, [0.0], -x[::-1]])
    return np.fft.rfft(odd).imag[1 : n + 1] ** 2 / (2 * (n + 1))


def ma1_profile(theta: np.ndarray | float, x: np.ndarray, power: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Exact Gaussian MA(1) likelihood with sigma2 profiled out, at one theta or many: mean negative log-likelihood, sigma2.

    The covariance of n values is tridiagonal and Toeplitz: sine waves are its
    eigenvectors whatever theta is, and its eigenvalues have a closed form. One
    transform of x, or its power if known, serves every theta.
    """
    n = len(x)
    power = sine_power(np.asarray(x, float)) if power is None else power
    theta = np.asarray(theta, float)[..., None]
    eigen = (1 + theta) ** 2 - 4 * theta * np.sin(np.pi * np.arange(1, n + 1) / (2 * n + 2)) ** 2
    sigma2 = (power / eigen).sum(axis=-1) / n
    return (np.log(sigma2) + np.log(eigen).mean(axis=-1)) / 2, sigma2


def exact_arma(x: np.ndarray, phi: list[float], theta: list[float], sigma2: float) -> float:
    """Exact Gaussian ARMA log-likelihood by a Kalman filter from the stationary state."""
    r = max(len(phi), len(theta) + 1)
    t = np.zeros((r, r))
    t[: len(phi), 0] = phi
    t[:-1, 1:] = np.eye(r - 1)
    load = np.r_[1.0, theta, np.zeros(r - 1 - len(theta))]
    noise = sigma2 * np.outer(load, load)
    p = np.linalg.solve(np.eye(r * r) - np.kron(t, t), noise.ravel()).reshape(r, r)
    a, out = np.zeros(r), 0.0
    for v in x:
        e, f = v - a[0], p[0, 0]
        out -= 0.5 * (np.log(2 * np.pi * f) + e * e / f)
        k = p[:, 0] / f
        a, p = t @ (a + k * e), t @ (p - np.outer(k, p[0])) @ t.T + noise
    return float(out)


def conditional_ar2(y: np.ndarray, x: np.ndarray, beta: float, phi: tuple[float, float], sigma2: float) -> float:
    """Gaussian log-likelihood of a regression with AR(2) errors, given the first two errors."""
    e = y - beta * x
    u = e[2:] - phi[0] * e[1:-1] - phi[1] * e[:-2]
    return float(-0.5 * (len(u) * np.log(2 * np.pi * sigma2) + (u @ u) / sigma2))


# Covariance regularisation of a shard.


def quadrature_moments(f: Callable, centre: np.ndarray, covariance: np.ndarray, orders: tuple[int, ...] = (5, 7, 9), tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of exp(f) by Gauss-Hermite rules of rising order, until two agree; refused if none do."""
    d, root, last = len(centre), np.linalg.cholesky(covariance), None
    for order in orders:
        z, w = np.polynomial.hermite.hermgauss(order)
        grid = np.stack(np.meshgrid(*[np.sqrt(2) * z] * d, indexing="ij"), -1).reshape(-1, d)
        weight = np.prod(np.stack(np.meshgrid(*[w] * d, indexing="ij"), -1).reshape(-1, d), axis=1)
        points = centre + grid @ root.T
        log = np.array([f(p) for p in points]) + 0.5 * (grid**2).sum(1)
        m = weight * np.exp(log - log[np.isfinite(log)].max())
        m = np.where(np.isfinite(m), m, 0.0)
        m /= m.sum()
        mean = m @ points
        cov = (points - mean).T @ ((points - mean) * m[:, None])
        if last is not None and np.abs(cov - last[1]).max() <= tolerance * np.abs(cov).max() and np.abs(mean - last[0]).max() <= tolerance * np.sqrt(np.diag(cov)).max():
            return mean, cov
        last = (mean, cov)
    raise ValueError(f"Gauss-Hermite rules up to order {orders[-1]} don't agree within {tolerance}")


def shrink_covariance(draws: np.ndarray, prior: np.ndarray, batches: int = 20, most: float = 6.0) -> np.ndarray:
    """The draws' covariance shrunk towards `prior` by its batch-means variance; refused beyond `most` standard errors.

    All is measured in units of the prior, where it is the identity, so that no
    parameter's scale decides. Each batch needs more draws than parameters.
    """
    n, d = draws.shape
    if n < batches * (d + 2):
        raise ValueError(f"{n} draws of {d} parameters are too few for {batches} batches")
    root = np.linalg.cholesky(prior)
    white = np.linalg.solve(root, (draws - draws.mean(axis=0)).T)
    size = n // batches
    parts = white[:, : size * batches].reshape(d, batches, size)
    each = np.einsum("ibt,jbt->bij", parts, parts) / size
    cov = white @ white.T / (n - 1)
    error2 = each.var(axis=0, ddof=1) / batches
    gap2 = (cov - np.eye(d)) ** 2
    if (gap2 > most**2 * error2 + 1e-24).any():
        raise ValueError(f"draws and quadrature disagree by more than {most} standard errors")
    share = float(np.clip(error2.sum() / max(gap2.sum() + error2.sum(), 1e-300), 0, 1))
    return positive_definite(root @ ((1 - share) * cov + share * np.eye(d)) @ root.T, 1e-300)
