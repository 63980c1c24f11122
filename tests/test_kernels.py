import json

import numpy as np
import pytest

from spectrabrook.functions import diagnostics, kernels, predict, stein
from spectrabrook.functions.columns import coefficients
from spectrabrook.functions.model import Settings, Spec

CASES = [Spec(1, 0), Spec(0, 1), Spec(2, 1), Spec(1, 0, True), Spec(0, 1, True), Spec(2, 2, True)]


def grid(n):
    k = np.arange(1, n // 2)
    return 2 * np.pi * k / n


@pytest.fixture
def power():
    return np.random.default_rng(8).exponential(size=255)


@pytest.mark.parametrize("spec", CASES)
def test_shards_add_up_and_gradient(spec, power):
    w = grid(512)
    theta = np.r_[np.full(spec.bounded, 0.3), np.full(spec.tail, -0.4)]
    whole = kernels.Whittle(spec, w, power)
    parts = sum(kernels.Whittle(spec, w[g::4], power[g::4], 4)(theta) for g in range(4))
    assert parts == pytest.approx(whole(theta), rel=1e-12)
    e = np.eye(spec.size) * 1e-6
    numeric = [(whole(theta + d) - whole(theta - d)) / 2e-6 for d in e]
    np.testing.assert_allclose(whole.gradient(theta), numeric, rtol=1e-6, atol=1e-5)


def test_density_has_no_cancellation_at_the_ends():
    w = np.array([1e-7, 1e-4, 1.0, np.pi - 1e-4, np.pi - 1e-7])
    for sign in (1, -1):
        for spec in (Spec(1, 0), Spec(0, 1)):
            f = kernels.Whittle(spec, w).log_density(np.array([sign * (1 - 1e-8), 0.0]))
            assert np.isfinite(f).all()


def test_layout_names_and_transforms():
    s = Spec(2, 1)
    assert s.names() == ["phi1", "phi2", "theta1", "sigma2"] and s.names(False)[-1] == "log_sigma2"
    np.testing.assert_allclose(s.transformed(np.array([[0.2, 0.3, 0.4, np.log(2)]])), [[0.14, 0.3, 0.4, 2.0]])
    assert Spec(1, 1, True, mean=True).names() == ["phi1", "theta1", "lambda", "sigma2", "d", "mu"]
    assert coefficients([0.5, -0.3]) == pytest.approx([0.65, -0.3])
    assert Spec(1, 0).log_prior([1.5, 0.0]) == -np.inf
    with pytest.raises(ValueError):
        Spec(-1, 0)


def test_recovers_known_spectra():
    w = grid(8192)
    z = np.exp(-1j * w)
    for phi, theta in ((0.7, -0.25), (-0.6, 0.2)):
        f = np.abs(1 + theta * z) ** 2 / np.abs(1 - phi * z) ** 2 / (2 * np.pi)
        fit = kernels.fit_map(kernels.Whittle(Spec(1, 1), w, f), Settings(), starts=3)
        assert fit.accepted
        np.testing.assert_allclose(fit.theta, [phi, theta, 0], atol=2e-3)


@pytest.mark.parametrize("phi", [-0.9, 0.0, 0.4, 0.99])
def test_ar1_closed_form(phi):
    n = 512
    w = grid(n)
    power = np.random.default_rng(1).exponential(size=len(w))
    want = kernels.Whittle(Spec(1), w, power)(np.array([phi, 0.2]))
    q = 4 * np.sin(w / 2) ** 2
    assert kernels.ar1_target(n, power.sum(), (q * power).sum(), phi, 0.2) == pytest.approx(want, rel=1e-10)


def test_root_products():
    n, c = 120, 0.8
    for shards in (1, 2, 3):
        for s in range(shards):
            w = 2 * np.pi * np.arange(s, n, shards) / n
            got = kernels.log_root_product(c, n, shards, s)
            assert got == pytest.approx(np.log(np.abs(1 - c * np.exp(-1j * w)) ** 2).sum(), rel=1e-9)


def test_samplers_reproduce_a_gaussian():
    cov = np.array([[1.0, 0.6], [0.6, 2.0]])
    inv = np.linalg.inv(cov)
    target = lambda x: -0.5 * x @ inv @ x
    rng = np.random.default_rng(4)
    for chain in (kernels.random_walk(target, 0, np.zeros(2), 2.38**2 / 2 * cov, 6000, rng), kernels.mixture_walk(target, np.zeros(2), cov, np.zeros(2), 4000, rng), kernels.adaptive_walk(target, 0, np.zeros(2), cov / 50, 3000, 6000, rng), kernels.mode_jumps(target, 0, [kernels.Fit(np.zeros(2), 0.0, cov, 0.0, True)], np.zeros(2), 6000, rng)):
        np.testing.assert_allclose(np.cov(chain.draws.T), cov, atol=0.35)
    a = kernels.random_walk(target, 0, np.zeros(2), cov, 50, np.random.default_rng(1))
    b = kernels.random_walk(target, 0, np.zeros(2), cov, 20, np.random.default_rng(1))
    rng = np.random.default_rng()
    rng.bit_generator.state = json.loads(b.state)
    c = kernels.random_walk(target, 0, b.draws[-1], cov, 30, rng)
    np.testing.assert_array_equal(a.draws, np.r_[b.draws, c.draws])


def test_outside_the_support_nothing_is_evaluated():
    def target(x):
        assert abs(x[0]) < 1
        return 0.0

    chain = kernels.random_walk(target, 1, np.array([0.9]), np.array([[25.0]]), 100, np.random.default_rng(0))
    assert (np.abs(chain.draws) < 1).all()


def test_coordinates_share_the_jacobian(power):
    spec, w = Spec(0, 1, True), grid(512)
    x = kernels.to_coordinates(np.array([0.3, -1.0, 0.1, 0.2]))
    np.testing.assert_allclose(kernels.from_coordinates(x), [0.3, -1.0, 0.1, 0.2])
    whole = kernels.coordinate_target(kernels.Whittle(spec, w, power))(x)
    parts = sum(kernels.coordinate_target(kernels.Whittle(spec, w[g::3], power[g::3], 3))(x) for g in range(3))
    assert parts == pytest.approx(whole, rel=1e-12)
    point, cov, decrement = kernels.polish(lambda v: -((v - 1) ** 2).sum(), np.zeros(3))
    np.testing.assert_allclose(point, 1, atol=1e-3)
    assert decrement <= 1e-3 and np.allclose(cov, np.eye(3) / 2, atol=1e-4)


def test_exact_likelihoods_agree():
    x = np.random.default_rng(5).normal(size=60)
    for theta in (-0.5, 0.3):
        value, s2 = kernels.ma1_profile(theta, x)
        n = len(x)
        assert -n * value - n / 2 * (1 + np.log(2 * np.pi)) == pytest.approx(kernels.exact_arma(x, [], [theta], s2), rel=1e-9)
    gamma = predict.spectrum_covariance(predict.tempered_density(1.0, 1.0, 0.0, phi=0.5, theta=0.2), 60, first=4096)
    i = np.arange(60)
    cov = gamma[np.abs(i[:, None] - i)]
    want = -0.5 * (x @ np.linalg.solve(cov, x) + np.linalg.slogdet(cov)[1] + 60 * np.log(2 * np.pi))
    assert kernels.exact_arma(x, [0.5], [0.2], 1.0) == pytest.approx(want, rel=1e-6)


def test_quadrature_and_shrinkage():
    cov = np.diag([0.01, 1e-5, 0.001])
    mean, got = kernels.quadrature_moments(lambda x: -0.5 * x @ np.linalg.solve(cov, x), np.zeros(3), 1.2 * cov)
    np.testing.assert_allclose(got, cov, atol=1e-6)
    assert np.abs(mean).max() < 1e-9
    draws = np.random.default_rng(0).multivariate_normal(np.zeros(3), cov, 8192)
    out = kernels.shrink_covariance(draws, cov)
    assert np.abs(out - cov).max() <= np.abs(np.cov(draws.T) - cov).max()
    with pytest.raises(ValueError):
        kernels.shrink_covariance(draws, 4 * cov)


def test_predictors_match_dense_conditioning():
    m, h = 6, 3
    for model, p, phi, theta in (("ar1", {"phi": 0.6, "sigma2": 1.5}, 0.6, 0.0), ("arma11", {"phi": 0.6, "theta": -0.3, "sigma2": 1.5}, 0.6, -0.3)):
        gamma = predict.spectrum_covariance(predict.tempered_density(1.5, 1.0, 0.0, phi=phi, theta=theta), m + h, first=8192)
        want = predict.gaussian_predictor(gamma, m, h)
        got = predict.predictor(model, p, m, h)
        np.testing.assert_allclose(got[0], want[0], atol=1e-7)
        np.testing.assert_allclose(got[1], want[1], atol=1e-6)
    w, cov = predict.predictor("arima011", {"theta": 0.0, "sigma2": 2.0}, m, h)
    np.testing.assert_allclose(w, np.tile(np.r_[np.zeros(m - 1), 1.0], (h, 1)), atol=1e-12)
    np.testing.assert_allclose(cov, 2.0 * np.minimum.outer(np.arange(1, h + 1), np.arange(1, h + 1)))
    w, _ = predict.predictor("arima110", {"phi": 0.5, "sigma2": 1.0}, m, h)
    np.testing.assert_allclose(w.sum(1), 1)
    c = np.cov(np.random.default_rng(0).normal(size=(4, 30)))
    s = np.array([1.0, 2.0, 0.5, 3.0])
    r = np.tril(np.ones((4, 4)))
    np.testing.assert_allclose(predict.sum_variances(c, s), np.diag(r @ np.diag(s) @ c @ np.diag(s) @ r.T))


def test_convergence_diagnostics():
    rng = np.random.default_rng(0)
    good = rng.normal(size=(4, 1000, 2))
    rhat, bulk, tail = diagnostics.chain_quality(good)
    assert (rhat < 1.01).all() and (bulk > 2000).all() and (tail > 1000).all()
    rhat, _, _ = diagnostics.chain_quality(good + np.arange(4)[:, None, None])
    assert (rhat > 1.1).all()
    rhat, bulk, _ = diagnostics.chain_quality(np.zeros((4, 100, 1)))
    assert np.isinf(rhat).all() and (bulk == 0).all()
    assert diagnostics.average_ranks(np.array([3.0, 1.0, 3.0])).tolist() == [2.5, 1.0, 2.5]


def test_stein():
    x = np.array([[0.3, -1.0, 2.0, 0.5]])
    assert stein.discrepancy(x, -x) == pytest.approx(4 + np.abs(x).sum(), rel=1e-6)
    p = np.random.default_rng(0).normal(size=(40, 2))
    assert stein.discrepancy(p, -p) < stein.discrepancy(p + 1, -(p + 1))
    w = np.array([2.0, 1.0, 1.0])
    q = np.array([[0.0], [1.0], [-1.0]])
    assert stein.discrepancy(q, -q, w) == pytest.approx(stein.discrepancy(np.r_[q[:1], q[:1], q[1:]], -np.r_[q[:1], q[:1], q[1:]]), rel=1e-4)


def test_effective_sizes_match_known_chains():
    """AR(1) chains of coefficient a have an effective share of (1 - a) / (1 + a)."""
    rng = np.random.default_rng(4)
    share = []
    for a in (0.0, 0.5, 0.8):
        e = rng.normal(size=(4, 20_000))
        x = np.zeros_like(e)
        for t in range(1, e.shape[1]):
            x[:, t] = a * x[:, t - 1] + e[:, t]
        share.append(x[:, 500:])
    x = np.stack(share, axis=-1)
    got = diagnostics.effective_sizes(x) / (x.shape[0] * x.shape[1])
    np.testing.assert_allclose(got, [1.0, 1 / 3, 1 / 9], rtol=0.12)
    np.testing.assert_allclose(diagnostics.effective_sizes(x, block=3), diagnostics.effective_sizes(x), rtol=1e-12)


def test_moment_quality_ignores_units_and_correlations():
    x = np.random.default_rng(5).normal(size=(4, 600, 3))
    mixed = x @ np.array([[1e-3, 2.0, 0.0], [0.0, 30.0, 1.0], [0.0, 0.0, 1e4]])
    a, b = diagnostics.moment_quality(mixed), diagnostics.moment_quality(mixed * [5.0, 1e3, 1e-5] + 7.0)
    for u, v in zip(a, b, strict=True):
        np.testing.assert_allclose(u, v, rtol=1e-3)  # the two middle values tie up to rounding
    stuck = mixed.copy()
    stuck[..., 2] = stuck[..., 0] * 3
    assert np.isinf(diagnostics.moment_quality(stuck)[0]).all()


def test_predictors_match_dense_algebra_of_levels():
    """Integrated models against conditioning a long random walk's dense covariance; near unit roots too."""
    m, h = 7, 4
    for model, p in (("arima110", {"phi": 0.7, "sigma2": 2.0}), ("arima011", {"theta": -0.4, "sigma2": 0.5}), ("arima111", {"phi": 0.3, "theta": 0.5, "sigma2": 1.0})):
        phi, theta, s2 = p.get("phi", 0.0), p.get("theta", 0.0), p["sigma2"]
        n = m - 1 + h
        gamma = predict.spectrum_covariance(predict.tempered_density(s2, 1.0, 0.0, phi=phi, theta=theta), n, first=8192, tolerance=1e-13)
        w, cov = predict.gaussian_predictor(gamma, m - 1, h)
        y = np.random.default_rng(1).normal(size=m).cumsum()
        got = predict.predictor(model, p, m, h)
        add = np.tril(np.ones((h, h)))
        np.testing.assert_allclose(got[0] @ y, y[-1] + add @ w @ np.diff(y), atol=1e-8)
        np.testing.assert_allclose(got[1], add @ cov @ add.T, atol=1e-8)
    w, cov = predict.predictor("ar1", {"phi": 0.9999999, "sigma2": 1.0}, 50, 3)
    np.testing.assert_allclose(w[:, -1], 0.9999999 ** np.arange(1, 4), rtol=1e-9)
    assert np.abs(w[:, :-1]).max() < 1e-9 and cov[0, 0] == pytest.approx(1.0)


def test_moments_that_do_not_settle_are_refused():
    with pytest.raises(ValueError):
        kernels.quadrature_moments(lambda x: -abs(float(x[0])) ** 0.3 * 5, np.zeros(1), np.eye(1) * 0.01, orders=(3, 5))
    with pytest.raises(ValueError):
        kernels.shrink_covariance(np.random.default_rng(0).normal(size=(40, 3)), np.eye(3))


@pytest.mark.parametrize("n", [300, 1500, 60_001])
def test_mean_rule_integrates_the_kernel(n):
    """Against the autocovariances' closed sum: var = (g0 + 2 sum (1 - h/n) g_h) / n, for an AR(1) of 0.9."""
    w, weight = kernels.mean_rule(n)
    f = np.exp(kernels.Whittle(Spec(ar=1), w).log_density(np.array([0.9, 0.0])))
    h = np.arange(1, n)
    want = (1 + 2 * ((1 - h / n) * 0.9**h).sum()) / (1 - 0.81) / n
    assert len(w) <= 13_000 and (weight * f).sum() == pytest.approx(want, rel=1e-7)


def test_half_log_products_and_their_derivatives():
    for n in (8, 9, 64):
        w = 2 * np.pi * np.arange(1, (n - 1) // 2 + 1) / n
        f = lambda c, w=w: np.log(np.abs(1 - c * np.exp(-1j * w)) ** 2).sum()
        for c in (-0.9, -0.2, 0.3, 0.95):
            value, first, second = kernels.half_log_product(c, n)
            h = 1e-4
            assert value == pytest.approx(f(c), abs=1e-10)
            assert first == pytest.approx((f(c + h) - f(c - h)) / (2 * h), rel=1e-5, abs=1e-5)
            assert second == pytest.approx((f(c + h) - 2 * f(c) + f(c - h)) / h**2, rel=1e-3, abs=1e-3)


def test_arma11_map_equals_the_general_fit():
    n = 4097
    w = 2 * np.pi * np.arange(1, (n - 1) // 2 + 1) / n
    q = 4 * np.sin(w / 2) ** 2
    f = 2.0 / (2 * np.pi) * np.abs(1 - 0.3 * np.exp(-1j * w)) ** 2 / np.abs(1 - 0.7 * np.exp(-1j * w)) ** 2
    power = f * np.random.default_rng(3).exponential(size=len(w))

    def sums(phi, theta):
        ma, ar = (1 + theta) ** 2 - theta * q, (1 - phi) ** 2 + phi * q
        dma, dar = 2 * (1 + theta) - q, q - 2 * (1 - phi)
        parts = (power * ar / ma, power * dar / ma, -power * ar * dma / ma**2, 2 * power / ma, -power * dar * dma / ma**2, power * ar * (2 * dma**2 / ma**3 - 2 / ma**2))
        return dict(zip(("energy", "d_phi", "d_theta", "d_phi_phi", "d_phi_theta", "d_theta_theta"), (float(p.sum()) for p in parts), strict=True))

    theta, cov, decrement = kernels.fit_arma11(sums, n)
    want = kernels.fit_map(kernels.Whittle(Spec(1, 1), w, power), Settings(seed=1), starts=3)
    np.testing.assert_allclose(theta, want.theta, atol=2e-4)
    np.testing.assert_allclose(np.sqrt(np.diag(cov)), np.sqrt(np.diag(want.covariance)), rtol=1e-2)
    assert decrement <= 1e-8
