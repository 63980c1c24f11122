import datetime

import numpy as np
import pytest

from spectrabrook.functions import diagnostics, kernels
from spectrabrook.functions.model import Spec
from spectrabrook.operators import panel, scores
from spectrabrook.plans import experiment


def test_folds_and_sampled_days(spark):
    days = spark.createDataFrame([(i, datetime.date(2024, 1, 1) + datetime.timedelta(days=i)) for i in range(200)], "day_index int, date date")
    got = {r["fold"]: r for r in experiment.quarterly_folds(days, first_test="2024-04-01").collect()}
    assert set(got) == {"2024Q2", "2024Q3"} and got["2024Q2"]["first_test"] == 91 and got["2024Q2"]["last_train"] == 90
    picked = experiment.sample_days(range(50), [3, 7], 10, 1)
    assert len(picked) == 10 and {3, 7} <= set(picked) and picked == experiment.sample_days(range(50), [3, 7], 10, 1)
    with pytest.raises(ValueError):
        experiment.sample_days(range(5), [9], 2, 0)


def test_benchmarks_are_least_squares(spark):
    y = np.cumsum(np.random.default_rng(0).normal(size=400)) * 0.1
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
    got = experiment.train_benchmarks(df)
    a, b, d = y[2:], y[1:-1], np.diff(y)
    phi = a @ b / (b @ b)
    assert got["ar1"]["phi"] == pytest.approx(phi) and got["ar1"]["sigma2"] == pytest.approx(((a - phi * b) ** 2).mean())
    rho = d[1:] @ d[:-1] / (d[:-1] @ d[:-1])
    assert got["arima110"]["phi"] == pytest.approx(rho) and got["arima110"]["sigma2"] == pytest.approx(((d[1:] - rho * d[:-1]) ** 2).mean())


def test_arima011_fits_agree(spark):
    rng = np.random.default_rng(3)
    e = rng.normal(size=1025)
    y = np.cumsum(e[1:] - 0.4 * e[:-1])
    theta, s2 = experiment.exact_ma1(np.diff(y))
    got = experiment.train_arima011(spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double"), 1024, 1)
    assert theta == pytest.approx(-0.4, abs=0.08) and got["theta"] == pytest.approx(theta, abs=0.03) and got["sigma2"] == pytest.approx(s2, rel=0.05) and got["newton_distance"] <= 0.01


def test_level_forecasts_and_reasons(spark):
    phases = (panel.Phase("am", 0, 40), panel.Phase("pm", 40, 80))
    rows = [(d, s, float(np.exp(0.1 * np.sin(s + d)))) for d in range(2) for s in range(80) if (d, s) not in {(1, 12), (1, 62)}]
    p = spark.createDataFrame(rows, "day_index int, second int, spread double")
    profile = spark.createDataFrame([(s, 0.0) for s in range(80)], "second int, profile double")
    fits = {"last_value": {"sigma2": 0.01}, "ar1": {"phi": 0.5, "sigma2": 0.01}, "arima110": {"phi": 0.1, "sigma2": 0.01}, "arima011": {"theta": -0.2, "sigma2": 0.01}}
    out = experiment.forecast_levels(p, profile, 1.0, fits, 10, (15, 20, 38), (2, 5), 64, phases=phases).collect()
    why = {(r["day_index"], r["phase"], r["elapsed"]): r["reason"] for r in out}
    assert why[0, "am", 38] == "session_boundary" and why[1, "am", 15] == "missing_history" and why[1, "pm", 20] == "missing_target" and why[0, "am", 15] is None
    good = [r for r in out if r["reason"] is None]
    assert {r["model"] for r in good} == set(fits) and all(len(r["draws"]) == 64 and r["draws"] == sorted(r["draws"]) for r in good)
    scored = scores.score_samples(spark.createDataFrame([(r["actual"], r["prediction"], r["draws"]) for r in good], "actual double, prediction double, draws array<double>"))
    assert scored.filter("crps is null or crps < 0").isEmpty()


def test_gates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4, 2000, 2))
    assert diagnostics.passes(diagnostics.moment_quality(x), 4) and not diagnostics.passes(diagnostics.moment_quality(np.zeros((4, 100, 2))), 4)
    assert not diagnostics.passes(diagnostics.chain_quality(x[:, :100] + np.arange(4)[:, None, None]), 4)
    w = 2 * np.pi * np.arange(1, 256) / 512
    target = kernels.Whittle(Spec(1), w, np.exp(target_log(w)))
    mode = np.array([0.5, 0.0])
    assert experiment.stable_consensus(target, mode + 0.001, mode, 1) and not experiment.stable_consensus(target, np.array([1.2, 0.0]), mode, 1)
    assert experiment.compatible_modes([mode] * 3, mode + 0.1, [np.eye(2)] * 3) and not experiment.compatible_modes([mode], mode + 100, [np.eye(2)])
    assert experiment.targets_agree(1.0, 1.0 + 1e-9) and not experiment.targets_agree(1.0, 1.1)


def target_log(w):
    return kernels.Whittle(Spec(1), w).log_density(np.array([0.5, 0.0]))
