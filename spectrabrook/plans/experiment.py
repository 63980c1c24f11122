"""Rolling experiments: folds, benchmark models, gates and audits around the sampler."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.functions import kernels
from spectrabrook.functions.model import Settings, Spec
from spectrabrook.functions.predict import predictor
from spectrabrook.operators import panel as panels
from spectrabrook.operators import spectrum


def quarterly_folds(days: DataFrame, date: str = "date", first_test: str | None = None) -> DataFrame:
    """fold, first and last test day, and the last training day: quarters, each trained on all days before it.

    days has day_index and date; one row per day, so the result is small.
    """
    rows = days.select("day_index", F.date_trunc("quarter", F.to_date(date)).alias("quarter"))
    rows = rows.filter(F.col("quarter") >= F.lit(first_test).cast("timestamp")) if first_test else rows
    out = rows.groupBy("quarter").agg(F.min("day_index").alias("first_test"), F.max("day_index").alias("last_test"), F.count(F.lit(1)).alias("test_days"))
    return out.select(F.concat(F.year("quarter"), F.lit("Q"), F.quarter("quarter")).alias("fold"), "first_test", "last_test", "test_days", (F.col("first_test") - 1).alias("last_train")).filter("last_train >= 0")


def sample_days(available: Sequence, references: Sequence, count: int, seed: int) -> list:
    """count days that hold all references and a seeded choice of the others, in order."""
    missing = sorted(set(references) - set(available))
    others = sorted(set(available) - set(references))
    if missing or not len(set(references)) <= count <= len(set(available)):
        raise ValueError(f"references that aren't available: {missing}, or a wrong count")
    picked = np.random.default_rng(seed).choice(len(others), count - len(set(references)), replace=False)
    return sorted({*references, *(others[i] for i in picked)})


def with_lags(series: DataFrame, lags: int, y: str = "y", t: str = "t") -> DataFrame:
    """t, y0..y<lags>: each value beside its predecessors, by one shuffle on the shifted index; incomplete rows go."""
    shifted = series.select(F.explode(F.array(*[F.lit(j) for j in range(lags + 1)])).alias("j"), (F.col(t)).alias("t"), F.col(y).alias("y")).select((F.col("t") + F.col("j")).alias("t"), "j", "y")
    wide = shifted.groupBy("t").agg(*[F.max(F.when(F.col("j") == j, F.col("y"))).alias(f"y{j}") for j in range(lags + 1)])
    return wide.dropna()


def train_benchmarks(series: DataFrame, t: str = "t", y: str = "y") -> dict[str, dict]:
    """ar1, arima110 and last_value by least squares, from one aggregate over lagged rows."""
    rows = with_lags(series, 2, y, t)
    d0, d1 = F.col("y0") - F.col("y1"), F.col("y1") - F.col("y2")
    s = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(a * b).alias(k) for k, a, b in (("xy", F.col("y0"), F.col("y1")), ("xx", F.col("y1"), F.col("y1")), ("yy", F.col("y0"), F.col("y0")), ("dd1", d0, d1), ("d1", d1, d1), ("d0", d0, d0))],
    ).first()
    n = int(s["n"])
    clip = lambda v: float(np.clip(v, -0.999999, 0.999999))
    a, b = clip(s["xy"] / s["xx"]), clip(s["dd1"] / s["d1"])
    return {
        "ar1": {"phi": a, "sigma2": (s["yy"] - 2 * a * s["xy"] + a * a * s["xx"]) / n},
        "arima110": {"phi": b, "sigma2": (s["d0"] - 2 * b * s["dd1"] + b * b * s["d1"]) / n},
        "last_value": {"sigma2": s["d0"] / n},
    }


def train_arima011(series: DataFrame, n: int, blocks: int | None = None, t: str = "t", y: str = "y") -> dict:
    """MA(1) of the differences by its Whittle MAP: the sums come from the whole spectrum, the search is one task's."""
    rows = with_lags(series, 1, y, t).select((F.col("t") - 1).alias("t"), (F.col("y0") - F.col("y1")).alias("y"))
    m = n - 1
    p = spectrum.periodogram(spectrum.fft(rows, m, blocks) if blocks else spectrum.transform(rows, m), m)
    from spectrabrook.plans.inference import sample_shards

    best = sample_shards(p.withColumn("shard_id", F.lit(0)), Spec(ma=1), 1, Settings(draws=1, burn=0)).first()
    return {"theta": float(best["map"][0]), "sigma2": float(np.exp(best["map"][1])), "newton_distance": float(best["newton_distance"])}


def exact_ma1(x: np.ndarray, rounds: int = 7, points: int = 33) -> tuple[float, float]:
    """theta and sigma2 of the exact likelihood, on grids that close in on the best point; for series that fit a task."""
    power = kernels.sine_power(np.asarray(x, float))
    lo, hi = -0.999999, 0.999999
    for _ in range(rounds):
        grid = np.linspace(lo, hi, points)
        best = int(np.argmin(kernels.ma1_profile(grid, x, power)[0]))
        lo, hi = grid[max(best - 1, 0)], grid[min(best + 1, points - 1)]
    theta = float((lo + hi) / 2)
    return theta, float(kernels.ma1_profile(theta, x, power)[1])


LEVEL_FORECAST = "day_index int, phase string, elapsed int, horizon int, model string, reason string, actual double, prediction double, draws array<double>"


def forecast_levels(panel: DataFrame, profile: DataFrame, scale: float, fits: dict[str, dict], context: int, elapsed: Sequence[int] = (1800, 3600, 5400), horizons: Sequence[int] = (60, 300), draws: int = 512, seed: int = 0, phases: Sequence[panels.Phase] = panels.DAY) -> DataFrame:
    """Level forecasts of the benchmark models at fixed seconds of each phase, a row for each model and horizon.

    A window that can't be scored has its reason and no forecast: outside the
    phase, a gap in the history, or a gap in the target, in this order. profile
    (second, profile) has a row a second and goes to every task.
    """
    table = profile.select("second", "profile").toPandas()
    top = max(p.stop for p in phases)
    level = np.full(top, np.nan)
    level[table["second"].to_numpy().astype(int)] = table["profile"]
    longest = max(horizons)
    known = {m: predictor(m, p, context, longest) for m, p in fits.items() if m != "last_value"}
    columns = [c.split()[0] for c in LEVEL_FORECAST.split(", ")]

    def run(key, pdf):
        day, raw, rows = int(key[0]), np.full(top, np.nan), []
        raw[pdf["second"].to_numpy().astype(int)] = pdf["spread"]
        for p in phases:
            for e in elapsed:
                end = p.start + e
                past, future = raw[max(end - context, 0) : end], raw[end : end + longest]
                reason = "session_boundary" if end - context < p.start or end + longest > p.stop else "missing_history" if not np.isfinite(past).all() else "missing_target" if not np.isfinite(future).all() else None
                if reason:
                    rows.append((day, p.name, e, longest, None, reason, None, None, None))
                    continue
                rng = np.random.default_rng([seed, day, end])
                half = rng.normal(size=(draws // 2, longest))
                z = np.r_[half, -half]
                x = (np.log(past) - level[end - context : end]) / scale
                for m, f in fits.items():
                    if m == "last_value":
                        sim, point = past[-1] * np.exp(scale * np.sqrt(f["sigma2"]) * np.cumsum(z, axis=1)), np.full(longest, past[-1])
                    else:
                        w, cov = known[m]
                        mean = level[end : end + longest] + scale * (w @ x)
                        root = np.linalg.cholesky(cov + 1e-12 * np.eye(longest))
                        sim, point = np.exp(mean + scale * (z @ root.T)), np.exp(mean + 0.5 * scale**2 * np.diag(cov))
                    rows += [(day, p.name, e, h, m, None, float(future[:h].mean()), float(point[:h].mean()), np.sort(sim[:, :h].mean(1)).tolist()) for h in horizons]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    return panel.select("day_index", "second", "spread").filter("spread is not null").groupBy("day_index").applyInPandas(run, LEVEL_FORECAST)


def audit_maps(summary: DataFrame, most: float = 0.01) -> DataFrame:
    """Shards' MAPs by the optimiser-free rule: a definite Hessian and a Newton distance of at most `most`."""
    return summary.select("shard_id", "newton_distance", "proper", (F.col("proper") & (F.col("newton_distance") <= most)).alias("passed"))


def compatible_modes(maps: Sequence[np.ndarray], full: np.ndarray, covariances: Sequence[np.ndarray], most: float = 1000) -> bool:
    """Each shard's mode against the full one: squared Mahalanobis distance over the number of shards below `most`."""
    g = len(maps)
    return all(float((m - full) @ np.linalg.solve(c, m - full)) / g < most for m, c in zip(maps, covariances, strict=True))


def stable_consensus(target, consensus: np.ndarray, mode: np.ndarray, bounded: int, gap: tuple[float, float] = (-1.0, 50.0)) -> bool:
    """The consensus mean lies in the support, and the target falls from the mode to it by no more than the range."""
    inside = bool((np.abs(consensus[:bounded]) < 1).all())
    return inside and gap[0] <= float(target(mode)) - float(target(consensus)) <= gap[1]


def targets_agree(a: float, b: float, rtol: float = 1e-12, atol: float = 1e-7) -> bool:
    """Two evaluations of one target."""
    return abs(a - b) <= atol + rtol * abs(b)
