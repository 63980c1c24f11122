"""Divide-and-conquer inference: shards fitted and sampled in parallel, then merged."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.functions import diagnostics, kernels
from spectrabrook.functions.columns import arma11_sums
from spectrabrook.functions.model import Settings, Spec
from spectrabrook.operators import combine, diagnose, spectrum

DRAWS = "shard_id int, chain int, draw long, theta array<double>, log_p double, accepted boolean, map array<double>, newton_distance double, proper boolean"


def sample_shards(frequencies: DataFrame, spec: Spec, shards: int, settings: Settings, n: int | None = None, covariates: list[str] | None = None, mean: tuple[float, int] | None = None, prior_shards: int | None = None) -> DataFrame:
    """Fit and sample every shard: one row per draw, the fit itself on the first row of each shard.

    frequencies has shard_id, omega and periodogram, or with covariates their
    joint spectrum. Each shard is one partition and one task, found by its id.
    Seeds come from the shard's number, so a task run again gives the same rows.
    """
    names = covariates or []
    used = ["re_y", "im_y", *[p + x for x in names for p in ("re_", "im_")]] if names else ["periodogram"]
    parts = prior_shards or shards

    def run(key, pdf):
        g = int(key[0])
        pdf = pdf.sort_values("omega", kind="stable")
        w = pdf["omega"].to_numpy()
        if names:
            y = pdf["re_y"].to_numpy() + 1j * pdf["im_y"].to_numpy()
            x = np.stack([pdf[f"re_{c}"].to_numpy() + 1j * pdf[f"im_{c}"].to_numpy() for c in names], 1)
            target = kernels.Whittle(spec, w, shards=parts, y=y, x=x, n=n)
        else:
            target = kernels.Whittle(spec, w, pdf["periodogram"].to_numpy(), parts, mean=mean)
        fit = kernels.fit_map(target, settings, g)
        cov = (settings.scale if settings.scale is not None else 2.38**2 / spec.size) * fit.covariance
        out = []
        for c in range(settings.chains):
            rng = np.random.default_rng([settings.seed, 10_000, g, c])
            start = fit.theta
            if settings.burn:
                start = kernels.random_walk(target, spec.bounded, start, cov, settings.burn, rng).draws[-1]
            chain = kernels.random_walk(target, spec.bounded, start, cov, settings.draws, rng)
            out.append(pd.DataFrame({"shard_id": np.int32(g), "chain": np.int32(c), "draw": np.arange(settings.draws), "theta": chain.draws.tolist(), "log_p": chain.log_p, "accepted": chain.accepted, "map": None, "newton_distance": np.nan, "proper": None}))
        found = pd.concat(out, ignore_index=True).astype({"map": object, "proper": object})
        # The fit goes with the shard's first draw only.
        found.at[0, "map"], found.at[0, "newton_distance"], found.at[0, "proper"] = fit.theta.tolist(), fit.newton_distance, fit.proper
        found["newton_distance"] = found["newton_distance"].astype(object).where(found["proper"].notna(), None)
        return found

    rows = frequencies.select("shard_id", "omega", *used)
    return rows.repartitionById(shards, "shard_id").groupBy("shard_id").applyInPandas(lambda key, pdf: run(key, pdf), DRAWS)


def shard_summary(draws: DataFrame) -> DataFrame:
    """One row per shard: MAP, its quality, acceptance and the number of draws."""
    return draws.groupBy("shard_id").agg(F.first("map", True).alias("map"), F.max("newton_distance").alias("newton_distance"), F.bool_and("proper").alias("proper"), F.avg(F.col("accepted").cast("double")).alias("acceptance_rate"), F.max("log_p").alias("best_log_p"), F.count(F.lit(1)).alias("draws"))


@dataclass
class Merged:
    """Results of a divide-and-conquer fit, as tables."""

    shards: DataFrame
    average: DataFrame
    consensus: DataFrame
    full: DataFrame | None


def _serial(draws: DataFrame, settings: Settings) -> DataFrame:
    """Chains of a shard one after another, so that draws have one number."""
    return draws.withColumn("draw", F.col("draw") + F.col("chain") * settings.draws)


def fit_frequency_shards(series: DataFrame, n: int, spec: Spec, shards: int, settings: Settings, partition: str = "systematic", blocks: int | None = None, full: bool = False) -> Merged:
    """FFT, frequency shards, a sampler per shard, average and consensus; with full also the fit without shards."""
    mean = None
    if spec.mean:
        m = series.agg(F.avg("y")).first()[0]
        mean = (float(m), n)
    found = spectrum.periodogram(spectrum.fft(series, n, blocks) if blocks else spectrum.transform(series, n), n).cache()
    total = spectrum.positive_frequencies(n)
    cut = {"systematic": lambda: spectrum.systematic(found, shards), "sequential": lambda: spectrum.sequential(found, shards, total), "random": lambda: spectrum.random_groups(found, shards, settings.seed)}
    if partition not in cut:
        raise ValueError("partition must be systematic, sequential or random")
    draws = sample_shards(cut[partition](), spec, shards, settings, mean=mean)
    whole = sample_shards(found.withColumn("shard_id", F.lit(0)), spec, 1, settings, mean=mean) if full else None
    return merge(draws, spec, settings, whole)


def fit_regression_shards(series: DataFrame, n: int, spec: Spec, covariates: list[str], shards: int, settings: Settings, blocks: int | None = None, full: bool = False) -> Merged:
    """The same for a regression: all columns go through one transform."""
    columns = ["y", *covariates]
    joint = (spectrum.fft(series, n, blocks, columns) if blocks else spectrum.transform(series, n, columns)).withColumn("omega", F.col("k") * F.lit(2 * np.pi / n)).cache()
    draws = sample_shards(spectrum.systematic(joint, shards), spec, shards, settings, n, covariates)
    whole = sample_shards(joint.withColumn("shard_id", F.lit(0)), spec, 1, settings, n, covariates) if full else None
    return merge(draws, spec, settings, whole)


def fit_time_segments(series: DataFrame, n: int, spec: Spec, segments: int, settings: Settings) -> Merged:
    """Consecutive time segments as shards, each with its own periodogram and its share of the prior."""
    mean = (float(series.agg(F.avg("y")).first()[0]), n) if spec.mean else None
    return merge(sample_shards(spectrum.time_segments(series, n, segments), spec, segments, settings, mean=mean), spec, settings, None)


def merge(draws: DataFrame, spec: Spec, settings: Settings, full: DataFrame | None) -> Merged:
    draws = draws.cache()
    one = _serial(draws, settings)
    return Merged(draws, combine.simple_average(one, spec.size), combine.consensus(one, spec.size), full)


def gates(result: Merged, spec: Spec) -> DataFrame:
    """The accuracy gate of consensus draws against the full fit's."""
    a = diagnose.summary(diagnose.long_draws(result.consensus, spec.size), "parameter")
    b = diagnose.summary(diagnose.long_draws(result.full.select("draw", "theta"), spec.size), "parameter")
    return diagnose.accuracy_gate(a, b)


def sample_until(target, bounded: int, fit: kernels.Fit, goal: float = 400, block: int = 1000, most: int = 20_000, seed: int = 0, state: dict | None = None) -> tuple[np.ndarray, str, bool]:
    """Blocks of draws with a fixed proposal until every effective size reaches the goal or `most` is drawn.

    Returns draws, the generator's state as JSON, and whether the goal was
    met. state ({"draws", "rng"}) goes on where an earlier call stopped: the
    chain is the one that a single longer call would have drawn.
    """
    import json

    rng = np.random.default_rng(seed)
    draws = np.zeros((0, len(fit.theta)))
    cov = 2.38**2 / len(fit.theta) * fit.covariance
    theta = fit.theta
    if state:
        draws = np.asarray(state["draws"], float)
        rng.bit_generator.state = json.loads(state["rng"])
        theta = draws[-1]
    else:
        theta = kernels.random_walk(target, bounded, theta, cov, block, rng).draws[-1]
    met = False
    while len(draws) < most and not met:
        chain = kernels.random_walk(target, bounded, theta, cov, block, rng)
        draws, theta = np.concatenate([draws, chain.draws]), chain.draws[-1]
        _, bulk, tail = diagnostics.chain_quality(draws[None])
        met = bool(min(bulk.min(), tail.min()) >= goal)
    return draws, json.dumps(rng.bit_generator.state), met


BLOCK_STATE = "history_id int, shard_id int, draws array<array<double>>, rng string, n int, met boolean"


def sample_blocks(frequencies: DataFrame, spec: Spec, shards: int, settings: Settings, goal: float = 400, block: int = 1000, most: int = 20_000, state: DataFrame | None = None) -> DataFrame:
    """Histories and shards in one wide job, each sampled until its goal: draws and generator state per (history, shard).

    frequencies has history_id, shard_id, omega and periodogram. A state table
    from an earlier call is joined to its shard and gone on with.
    """

    def work(h: int, g: int, pdf: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("omega", kind="stable")
        target = kernels.Whittle(spec, pdf["omega"].to_numpy(), pdf["periodogram"].to_numpy(), shards)
        fit = kernels.fit_map(target, settings, g)
        before = {"draws": np.stack([np.asarray(x) for x in held["draws"].iloc[0]]), "rng": held["rng"].iloc[0]} if len(held) else None
        draws, rng, met = sample_until(target, spec.bounded, fit, goal, block, most, settings.seed + 1000 * h + g, before)
        return pd.DataFrame({"history_id": [np.int32(h)], "shard_id": [np.int32(g)], "draws": [draws.tolist()], "rng": [rng], "n": [np.int32(len(draws))], "met": [met]})

    keys = ["history_id", "shard_id"]
    state = state if state is not None else frequencies.sparkSession.createDataFrame([], BLOCK_STATE)
    return frequencies.groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(lambda key, a, b: work(int(key[0]), int(key[1]), a, b), BLOCK_STATE)


def full_grid_start(frequencies: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """AR(1) MAP of a whole series from one aggregate over its spectrum: theta, covariance, Newton decrement."""
    s = frequencies.filter(F.col("k") < n // 2).agg(F.sum("periodogram").alias("p"), F.sum(F.col("q") * F.col("periodogram")).alias("qp")).first()
    return kernels.fit_ar1(n, float(s["p"]), float(s["qp"]))


def fit_arma11(frequencies: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """ARMA(1,1) MAP of a whole series, one aggregate over its spectrum for each Newton step; frequencies should be staged or cached."""
    held = frequencies.filter(F.col("k") <= (n - 1) // 2)

    def sums(phi: float, theta: float) -> dict[str, float]:
        return held.agg(*[F.sum(c).alias(name) for name, c in arma11_sums(F.col("q"), F.col("periodogram"), phi, theta).items()]).first().asDict()

    return kernels.fit_arma11(sums, n)
