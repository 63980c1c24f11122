"""The production path: histories of a panel, fitted in shards, merged by consensus, gated, and handed to forecasts.

Every (history, shard) is one group of one job. A shard's task finds its MAP
from a pilot on few ordinates, looks for competing modes, samples with
independence proposals around the MAP (or with jumps between modes), and
regularises its covariance by quadrature. What fails in a shard is said in its
row, not raised, so that one history's trouble doesn't stop the others; the
gates then refuse that history.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.functions import diagnostics, kernels
from spectrabrook.functions.model import Settings, Spec
from spectrabrook.operators import spectrum
from spectrabrook.operators.combine import consensus_weights
from spectrabrook.plans import forecast

#: MA(1) of tempered fractional increments, the model of the forecasts.
SPEC = Spec(ma=1, tempered=True)
FITS = "history_id int, shard_id int, draws array<array<double>>, log_p array<double>, cov array<double>, map array<double>, newton_distance double, modes int, acceptance_rate double, rhat double, least_ess double, moment_ess double, reason string"


def histories(panel: DataFrame, last_days: Sequence[int], shards: int, most_blocks: int = 256) -> DataFrame:
    """history_id, scale, shard_id, k, omega, q, periodogram of each history, which ends before its last day."""
    parts = []
    for i, day in enumerate(last_days):
        found, _, scale = forecast.history_spectrum(panel, day, most_blocks)
        parts.append(spectrum.systematic(found, shards).select(F.lit(i).alias("history_id"), F.lit(scale).alias("scale"), "shard_id", "k", "omega", "q", "periodogram"))
    return reduce(DataFrame.unionByName, parts)


def competing(target: kernels.Whittle, fit: kernels.Fit, settings: Settings, starts: int = 3, within: float = 10.0) -> list[kernels.Fit]:
    """The fit and other accepted modes whose log posterior lies within reach of its own."""
    others = [kernels.newton(target, target.spec.start(settings.seed + 101 * (i + 1))) for i in range(starts)]
    close = [f for f in others if f.accepted and np.isfinite(f.log_p) and f.log_p >= fit.log_p - within]
    return kernels.distinct_modes([fit, *close])


def fit_shard(spec: Spec, omega: np.ndarray, power: np.ndarray, shards: int, settings: Settings, seed: Sequence[int], goal: float = 400, orders: tuple[int, ...] = (5, 7, 9), tolerance: float = 0.02) -> dict:
    """MAP, draws, regularised covariance and their quality of one shard; reason says what failed, if anything."""
    target = kernels.Whittle(spec, omega, power, shards)
    fit = kernels.pilot_fit(spec, omega, power, shards, settings)
    modes = competing(target, fit, settings)
    chains = []
    for c in range(settings.chains):
        rng = np.random.default_rng([settings.seed, *seed, c])
        if len(modes) == 1:
            walk = lambda start, n, rng=rng: kernels.mixture_walk(target, fit.theta, fit.covariance, start, n, rng)
        else:
            walk = lambda start, n, rng=rng: kernels.mode_jumps(target, spec.bounded, modes, start, n, rng)
        begin = walk(fit.theta, max(settings.burn, 1)).draws[-1]
        chains.append(walk(begin, settings.draws))
    draws = np.stack([c.draws for c in chains])
    quality, moments = diagnostics.chain_quality(draws), diagnostics.moment_quality(draws)
    flat, reason = draws.reshape(-1, spec.size), None
    cov = np.atleast_2d(np.cov(flat.T))
    if not fit.accepted:
        reason = "map"
    elif not diagnostics.passes(quality, settings.chains, least_ess=goal):
        reason = "sampling"
    elif len(modes) == 1:
        try:
            _, exact = kernels.quadrature_moments(target, fit.theta, fit.covariance, orders, tolerance)
            cov = kernels.shrink_covariance(flat, exact)
        except (ValueError, np.linalg.LinAlgError):
            reason = "covariance"
    return {
        "draws": flat.tolist(),
        "log_p": np.concatenate([c.log_p for c in chains]).tolist(),
        "cov": cov.ravel().tolist(),
        "map": fit.theta.tolist(),
        "newton_distance": float(fit.newton_distance),
        "modes": np.int32(len(modes)),
        "acceptance_rate": float(np.mean([c.accepted.mean() for c in chains])),
        "rhat": float(quality[0].max()),
        "least_ess": float(min(quality[1].min(), quality[2].min())),
        "moment_ess": float(moments[1].min()),
        "reason": reason,
    }


def fit_histories(frequencies: DataFrame, shards: int, settings: Settings, spec: Spec = SPEC, goal: float = 400) -> DataFrame:
    """One row for each history and shard: draws of all chains one after another, covariance, MAP, quality, reason."""

    def run(key, pdf):
        pdf = pdf.sort_values("omega", kind="stable")
        h, g = int(key[0]), int(key[1])
        found = fit_shard(spec, pdf["omega"].to_numpy(), pdf["periodogram"].to_numpy(), shards, settings, (h, g), goal)
        return pd.DataFrame([{"history_id": np.int32(h), "shard_id": np.int32(g), **found}])

    return frequencies.select("history_id", "shard_id", "omega", "periodogram").groupBy("history_id", "shard_id").applyInPandas(lambda key, pdf: run(key, pdf), FITS)


def gate_table(fits: DataFrame, shards: int) -> DataFrame:
    """By history: shards held, those that failed and why, the worst figures, and whether the history may forecast."""
    out = fits.groupBy("history_id").agg(
        F.countDistinct("shard_id").alias("shards"),
        F.count("reason").alias("failed"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),  # three names at most
        F.max("newton_distance").alias("newton_distance"),
        F.max("rhat").alias("rhat"),
        F.min("least_ess").alias("least_ess"),
        F.min("moment_ess").alias("moment_ess"),
    )
    return out.withColumn("passed", (F.col("shards") == shards) & (F.col("failed") == 0))


def consensus(fits: DataFrame, dims: int, ridge: float = 1e-8) -> DataFrame:
    """history_id, draw, theta: the precision-weighted sum over shards of each draw, by the shards' regularised covariances."""

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard_id")
        w = consensus_weights([np.array(c).reshape(dims, dims) for c in pdf["cov"]], ridge)
        return pd.DataFrame({"history_id": pdf["history_id"], "shard_id": pdf["shard_id"], "w": [x.ravel().tolist() for x in w]})

    weights = fits.select("history_id", "shard_id", "cov").groupBy("history_id").applyInPandas(weigh, "history_id int, shard_id int, w array<double>")
    each = fits.select("history_id", "shard_id", F.posexplode("draws").alias("draw", "theta")).join(weights, ["history_id", "shard_id"])
    part = [sum((F.col("w")[a * dims + b] * F.col("theta")[b] for b in range(1, dims)), F.col("w")[a * dims] * F.col("theta")[0]) for a in range(dims)]
    return each.groupBy("history_id", "draw").agg(F.array(*[F.sum(p) for p in part]).alias("theta"))


def posterior(merged: DataFrame, scales: DataFrame, spec: Spec = SPEC, chain_draws: int | None = None) -> DataFrame:
    """history_id, chain, draw, theta on the forecasts' scale: coefficient, lambda, the increments' sigma2, d.

    scales (history_id, scale) takes a history's standardisation back. Consensus
    draws outside the coefficient's support go. Without tempering d is zero.
    """
    if (spec.ar, spec.ma, spec.covariates, spec.mean) != (0, 1, 0, False):
        raise ValueError("forecasts need an MA(1) of the increments")
    t = F.col("theta")
    chain = F.floor(F.col("draw") / chain_draws).cast("int") if chain_draws else F.lit(0)
    variance = F.exp(t[2 if spec.tempered else 1]) * F.pow("scale", F.lit(2))
    parts = [t[0], F.exp(t[1]), variance, t[3]] if spec.tempered else [t[0], F.lit(1.0), variance, F.lit(0.0)]
    inside = merged.filter(F.abs(t[0]) < 1).join(scales, "history_id")
    return inside.select("history_id", chain.alias("chain"), F.col("draw").cast("long").alias("draw"), F.array(*parts).alias("theta"))


def fitted_posterior(panel: DataFrame, last_day: int, shards: int, settings: Settings, spec: Spec = SPEC, goal: float = 400, most_blocks: int = 256) -> tuple[DataFrame, DataFrame]:
    """(posterior, gates) of the history before last_day; a history that the gates refuse has no posterior."""
    found, _, scale = forecast.history_spectrum(panel, last_day, most_blocks)
    rows = spectrum.systematic(found, shards).withColumn("history_id", F.lit(0))
    # A row for each shard, read three times; its draws are the job's work.
    fits = fit_histories(rows, shards, settings, spec, goal).persist()
    gates = gate_table(fits, shards)
    scales = panel.sparkSession.createDataFrame([(0, scale)], "history_id int, scale double")
    passed = consensus(fits, spec.size).join(gates.filter("passed").select("history_id"), "history_id", "left_semi")
    return posterior(passed, scales, spec, settings.draws), gates
