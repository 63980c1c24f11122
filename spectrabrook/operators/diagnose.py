"""Posterior summaries and distances, as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.functions import diagnostics as kernel


def long_draws(draws: DataFrame, dims: int) -> DataFrame:
    """One row for each draw and parameter; other columns stay."""
    keep = [c for c in draws.columns if c != "theta"]
    return draws.select(*keep, F.posexplode(F.slice("theta", 1, dims)).alias("parameter", "value"))


def summary(long: DataFrame, *keys: str, probs: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """n, mean, sd and exact quantiles by keys."""
    q = F.percentile("value", F.array(*map(F.lit, probs)))
    out = long.groupBy(*keys).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), q.alias("q"))
    return out.select(*keys, "n", "mean", "sd", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))])


def acceptance(draws: DataFrame, *keys: str) -> DataFrame:
    return draws.groupBy(*keys).agg(F.avg(F.col("accepted").cast("double")).alias("acceptance_rate"), F.count(F.lit(1)).alias("draws"))


def atoms(draws: DataFrame, dims: int) -> DataFrame:
    """Distinct draws with their multiplicities as weights that add up to one."""
    n = draws.agg(F.count(F.lit(1)).alias("total"))
    return draws.groupBy(F.slice("theta", 1, dims).alias("theta")).agg(F.count(F.lit(1)).alias("copies")).join(F.broadcast(n)).select("theta", "copies", (F.col("copies") / F.col("total")).alias("weight"))


def accuracy_gate(candidate: DataFrame, full: DataFrame, most_shift: float = 0.1, sd_range: tuple[float, float] = (0.9, 1.1)) -> DataFrame:
    """By parameter: the mean's shift in full sds, the ratio of sds, and whether both pass. Inputs are summaries."""
    a, b = candidate.select("parameter", F.col("mean").alias("m1"), F.col("sd").alias("s1")), full.select("parameter", F.col("mean").alias("m0"), F.col("sd").alias("s0"))
    out = a.join(b, "parameter").select("parameter", (F.abs(F.col("m1") - F.col("m0")) / F.col("s0")).alias("mean_shift"), (F.col("s1") / F.col("s0")).alias("sd_ratio"))
    return out.withColumn("passed", (F.col("mean_shift") < most_shift) & F.col("sd_ratio").between(*sd_range))


def quantile_distance(a: DataFrame, b: DataFrame, points: int = 200, normalise: bool = True) -> DataFrame:
    """Wasserstein-1 distance by parameter on a grid of mid-point quantiles, over the second's sd."""
    p = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    qa = a.groupBy("parameter").agg(F.percentile("value", p).alias("qa"))
    qb = b.groupBy("parameter").agg(F.percentile("value", p).alias("qb"), F.stddev_samp("value").alias("sd"))
    gap = F.aggregate(F.zip_with("qa", "qb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / points
    return qa.join(qb, "parameter").select("parameter", (gap / F.col("sd") if normalise else gap).alias("w1"))


def percentile_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """W1 on percentiles 1..99 by the trapezoid rule, relative to the second's mean absolute deviation from its median."""
    p = F.array(*[F.lit(i / 100) for i in range(1, 100)])
    qa = a.groupBy("parameter").agg(F.percentile("value", p).alias("qa"))
    qb = b.groupBy("parameter").agg(F.percentile("value", p).alias("qb"))
    mid = b.groupBy("parameter").agg(F.percentile("value", F.lit(0.5)).alias("mid"))
    mad = b.join(F.broadcast(mid), "parameter").groupBy("parameter").agg(F.avg(F.abs(F.col("value") - F.col("mid"))).alias("mad"))
    g = F.zip_with("qa", "qb", lambda x, y: F.abs(x - y))
    total = F.aggregate(g, F.lit(0.0), lambda s, x: s + x) - (F.element_at(g, 1) + F.element_at(g, 99)) / 2
    return qa.join(qb, "parameter").join(mad, "parameter").select("parameter", (total / 100).alias("w1"), (total / 100 / F.col("mad")).alias("relative_w1"))


def convergence(draws: DataFrame, dims: int, *keys: str, one_chain: bool = False) -> DataFrame:
    """keys, parameter, rhat, bulk_ess, tail_ess, passed. draws has chain and draw beside theta.

    A group's chains go to one task together: they are one sampler's output.
    """

    def run(key, pdf):
        chains = [np.stack(g.sort_values("draw")["theta"].to_numpy())[:, :dims] for _, g in pdf.groupby("chain", sort=True)]
        n = min(map(len, chains))
        x = np.stack([c[:n] for c in chains])
        rhat, bulk, tail = kernel.chain_quality(x)
        single = one_chain or len(chains) == 1
        out = pd.DataFrame({"parameter": np.arange(dims), "rhat": np.full(dims, np.nan) if single else rhat, "bulk_ess": bulk, "tail_ess": tail})
        out["passed"] = (bulk >= 400) & (tail >= 400) & (np.ones(dims, bool) if single else rhat <= 1.01)
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out[[*keys, "parameter", "rhat", "bulk_ess", "tail_ess", "passed"]]

    kinds = dict(draws.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "parameter int", "rhat double", "bulk_ess double", "tail_ess double", "passed boolean"])
    return draws.groupBy(*keys).applyInPandas(lambda key, pdf: run(key, pdf), schema)
