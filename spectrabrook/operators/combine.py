"""Merging shard posteriors. Draws are long: shard_id, draw, theta (an array)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def aligned(draws: DataFrame) -> DataFrame:
    """Draws up to the shortest shard's number, so that every draw has all shards."""
    shortest = draws.groupBy("shard_id").agg(F.max("draw").alias("last")).agg(F.min("last").alias("last"))
    return draws.join(F.broadcast(shortest), F.col("draw") <= F.col("last")).drop("last")  # one row


def thinned(draws: DataFrame) -> DataFrame:
    """Every shard thinned evenly to the shortest shard's length instead of cut; draws numbered anew from 0."""
    sizes = draws.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n").alias("keep"))
    rows = draws.join(F.broadcast(sizes), "shard_id").join(F.broadcast(least))
    # Draw floor(i (n - 1) / (keep - 1)) is the i-th kept; i is found from the draw.
    i = F.ceil(F.col("draw") * (F.col("keep") - 1) / F.greatest(F.col("n") - 1, F.lit(1)))
    picks = F.floor(i * (F.col("n") - 1) / F.greatest(F.col("keep") - 1, F.lit(1))) == F.col("draw")
    return rows.withColumn("_i", i.cast("long")).filter(picks & (F.col("_i") < F.col("keep"))).select(*[F.col("_i").alias("draw") if c == "draw" else F.col(c) for c in draws.columns])


def simple_average(draws: DataFrame, dims: int) -> DataFrame:
    """The mean over shards of each aligned draw."""
    return aligned(draws).groupBy("draw").agg(F.array(*[F.avg(F.col("theta")[j]) for j in range(dims)]).alias("theta"))


def covariances(draws: DataFrame, dims: int) -> DataFrame:
    """shard_id, n, means and the sample covariance as a flat row-major array, in one aggregate."""
    x = [F.col("theta")[j] for j in range(dims)]
    cells = [F.covar_samp(x[min(a, b)], x[max(a, b)]) for a in range(dims) for b in range(dims)]
    return draws.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in x]).alias("means"), F.array(*cells).alias("cov"))


def consensus_weights(covs: Sequence[np.ndarray], ridge: float = 1e-8) -> np.ndarray:
    """(sum W)^-1 W for each shard, W the inverse of its covariance with a ridge."""
    checked = []
    for c in covs:
        c = np.asarray(c, float)
        if not np.isfinite(c).all() or not np.allclose(c, c.T, rtol=0, atol=1e-10 * max(1.0, np.abs(c).max())):
            raise ValueError("covariances must be finite and symmetric")
        c = c + ridge * np.eye(len(c))
        np.linalg.cholesky(c)
        checked.append(np.linalg.inv(c))
    total = np.sum(checked, axis=0)
    return np.stack([np.linalg.solve(total, w) for w in checked])


def consensus(draws: DataFrame, dims: int, ridge: float = 1e-8, given: dict[int, np.ndarray] | None = None, undefined: str = "raise") -> DataFrame:
    """Precision-weighted sum over shards of each aligned draw.

    One weight matrix per shard, from all its draws or given, goes out to the
    tasks; a shard's matrix is dims x dims, so this is small. Where a covariance
    isn't finite there are no weights: that raises, or with undefined "nan"
    every draw is NaN.
    """
    if given is None:
        given = {r["shard_id"]: np.array(r["cov"]).reshape(dims, dims) for r in covariances(draws, dims).collect()}
    ids = sorted(given)
    if undefined == "nan" and not all(np.isfinite(given[i]).all() for i in ids):
        weights = np.full((len(ids), dims, dims), np.nan)
    else:
        weights = consensus_weights([given[i] for i in ids], ridge)
    table = draws.sparkSession.createDataFrame([(int(i), w.ravel().tolist()) for i, w in zip(ids, weights, strict=True)], "shard_id int, w array<double>")
    rows = aligned(draws).join(F.broadcast(table), "shard_id")
    part = [sum((F.col("w")[a * dims + b] * F.col("theta")[b] for b in range(1, dims)), F.col("w")[a * dims] * F.col("theta")[0]) for a in range(dims)]
    return rows.groupBy("draw").agg(F.array(*[F.sum(p) for p in part]).alias("theta"))


def quantile_grid(n: int) -> list[float]:
    """n probabilities at the middles of equal parts of (0, 1)."""
    return [(i + 0.5) / n for i in range(n)]


def barycenter(draws: DataFrame, dims: int, points: int = 200) -> DataFrame:
    """Marginal Wasserstein barycenters: quantiles averaged over shards. Rows are marginals, not joint draws."""
    p = F.array(*map(F.lit, quantile_grid(points)))
    long = draws.select("shard_id", F.posexplode(F.slice("theta", 1, dims)).alias("parameter", "value"))
    per_shard = long.groupBy("shard_id", "parameter").agg(F.percentile("value", p).alias("q"))
    return per_shard.select("parameter", F.posexplode("q").alias("point", "value")).groupBy("parameter", "point").agg(F.avg("value").alias("value"))


def interval_average(draws: DataFrame, dims: int, probs: Sequence[float] = (0.025, 0.5, 0.975)) -> DataFrame:
    """Quantiles of each shard, averaged over shards: parameter and one column per probability."""
    long = draws.select("shard_id", F.posexplode(F.slice("theta", 1, dims)).alias("parameter", "value"))
    q = long.groupBy("shard_id", "parameter").agg(F.percentile("value", F.array(*map(F.lit, probs))).alias("q"))
    return q.groupBy("parameter").agg(*[F.avg(F.col("q")[i]).alias(f"q{i}") for i in range(len(probs))])


def parametric_product(draws: DataFrame, dims: int, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, covariance and n draws of the product of Gaussians fitted to the shards."""
    rows = covariances(draws, dims).collect()
    inv = [np.linalg.inv(np.array(r["cov"]).reshape(dims, dims)) for r in rows]
    cov = np.linalg.inv(np.sum(inv, axis=0))
    mean = cov @ np.sum([w @ np.array(r["means"]) for w, r in zip(inv, rows, strict=True)], axis=0)
    return mean, cov, np.random.default_rng(seed).multivariate_normal(mean, cov, n)


def kernel_product(draws: DataFrame, dims: int, n: int, seed: int = 0, semi: bool = False, burn: int = 50) -> DataFrame:
    """Draws of the product of kernel estimates by independent Metropolis within Gibbs.

    One index per shard is moved at a time; the bandwidth falls with the draw
    number as T^(-1/(4+d)). semi multiplies each component by the ratio of the
    shards' Gaussian fits, which are sums over all draws. The sampler needs all
    shards together: it runs in one task. The indices it will try, n + burn + 1
    a shard, are drawn beforehand over all draws, and only those draws go there.
    Draws with a null or non-finite component have no density and take no part.
    """
    draws = draws.filter(F.forall(F.slice("theta", 1, dims), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    fits = sorted(covariances(draws.filter("shard_id is not null"), dims).collect(), key=lambda r: r["shard_id"])
    if not fits:
        return draws.sparkSession.createDataFrame([], "draw long, theta array<double>")
    m, steps = len(fits), n + burn + 1
    tries = [np.random.default_rng([seed, j]).integers(r["n"], size=steps) for j, r in enumerate(fits)]
    gauss = [(np.array(r["means"], float), np.array(r["cov"], float).reshape(dims, dims)) for r in fits]
    of_shard = {r["shard_id"]: j for j, r in enumerate(fits)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        sets: list[dict[int, np.ndarray]] = [{} for _ in range(m)]
        for shard, k, theta in zip(pdf["shard_id"], pdf["k"], pdf["theta"], strict=True):
            sets[of_shard[shard]][int(k)] = np.asarray(theta, float)
        prec = [np.linalg.inv(c) for _, c in gauss]
        joint = np.linalg.inv(np.sum(prec, axis=0))
        centre = joint @ np.sum([p @ g[0] for p, g in zip(prec, gauss, strict=True)], axis=0)

        def score(rows: np.ndarray, h: float) -> float:
            mid = rows.mean(0)
            out = -((rows - mid) ** 2).sum() / (2 * h * h)
            if semi:
                c = joint + np.eye(dims) * h * h / m
                out -= 0.5 * (mid - centre) @ np.linalg.solve(c, mid - centre)
                out += 0.5 * sum((r - g[0]) @ p @ (r - g[0]) for r, g, p in zip(rows, gauss, prec, strict=True))
            return out

        index = [int(t[0]) for t in tries]
        out = []
        for i in range(n + burn):
            h = float((max(1, i - burn) + 1) ** (-1 / (4 + dims))) * float(np.mean([np.sqrt(np.diag(g[1])).mean() for g in gauss]))
            rows = np.stack([s[k] for s, k in zip(sets, index, strict=True)])
            now = score(rows, h)
            for j in range(m):
                k = int(tries[j][i + 1])
                trial = rows.copy()
                trial[j] = sets[j][k]
                new = score(trial, h)
                if np.log(rng.random()) < new - now:
                    rows, now, index[j] = trial, new, k
            if i >= burn:
                mid, spread = rows.mean(0), np.eye(dims) * h * h / m
                if semi:
                    cov = np.linalg.inv(np.linalg.inv(spread) + np.linalg.inv(joint))
                    mid = cov @ (np.linalg.solve(spread, mid) + np.linalg.solve(joint, centre))
                    spread = cov
                out.append((i - burn, rng.multivariate_normal(mid, spread).tolist()))
        return pd.DataFrame(out, columns=["draw", "theta"])

    wanted = [(r["shard_id"], int(k)) for r, t in zip(fits, tries, strict=True) for k in np.unique(t)]
    table = draws.sparkSession.createDataFrame(wanted, f"shard_id {draws.schema['shard_id'].dataType.simpleString()}, k long")
    k = (F.row_number().over(Window.partitionBy("shard_id").orderBy("draw")) - 1).cast("long")
    picked = draws.withColumn("k", k).join(F.broadcast(table), ["shard_id", "k"])  # n + burn + 1 rows a shard at most
    return picked.select("shard_id", "k", "theta", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: run(pdf), "draw long, theta array<double>")


def surrogate_importance(draws: DataFrame, dims: int, n: int, seed: int = 0, scale: float = 1.5, dof: int = 5, most: int = 400) -> DataFrame:
    """Importance sampling on Gaussian-process surrogates of the shards' log densities.

    draws also holds log_p, each shard's log density at its draws. Per shard a
    process lies on at most `most` evenly spaced draws, a documented bound; its
    quadratic mean, the covariances and the centre are of all draws. Proposals are a t of dof degrees around the
    consensus, weights are the summed surrogates less the proposal, by
    log-sum-exp, and n draws are resampled. Returns draw, theta and ess.
    """

    def quadratic(x: np.ndarray) -> np.ndarray:
        pairs = [x[:, a] * x[:, b] for a in range(dims) for b in range(a, dims)]
        return np.column_stack([np.ones(len(x)), x, *pairs])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        shards = []
        for _, g in pdf.groupby("shard_id", sort=True):
            g = g.sort_values("draw")
            shards.append((np.stack(g["theta"].to_numpy()), g["log_p"].to_numpy(float)))
        cov = [np.atleast_2d(np.cov(x.T)) + 1e-10 * np.eye(dims) for x, _ in shards]
        prec = [np.linalg.inv(c) for c in cov]
        joint = np.linalg.inv(np.sum(prec, axis=0))
        centre = joint @ np.sum([p @ x.mean(0) for p, (x, _) in zip(prec, shards, strict=True)], axis=0)
        root = np.linalg.cholesky(joint) * scale
        z = rng.standard_normal((4 * n, dims)) / np.sqrt(rng.chisquare(dof, (4 * n, 1)) / dof)
        points = centre + z @ root.T
        log_w = (dof + dims) / 2 * np.log1p((z**2).sum(1) / dof)
        for (x, y), c in zip(shards, cov, strict=True):
            half = np.linalg.inv(np.linalg.cholesky(c))
            u, v = (x - x.mean(0)) @ half.T, (points - x.mean(0)) @ half.T
            beta, *_ = np.linalg.lstsq(quadratic(u), y, rcond=None)
            anchors = np.unique(np.linspace(0, len(u) - 1, min(most, len(u))).astype(int))
            u, y = u[anchors], y[anchors]
            rest = y - quadratic(u) @ beta
            k = np.exp(-0.5 * ((u[:, None] - u[None]) ** 2).sum(2))
            alpha = np.linalg.solve(k + 1e-4 * np.eye(len(u)), rest)
            log_w += quadratic(v) @ beta + np.exp(-0.5 * ((v[:, None] - u[None]) ** 2).sum(2)) @ alpha
        w = np.exp(log_w - log_w.max())
        w /= w.sum()
        pick = rng.choice(len(points), n, p=w)
        return pd.DataFrame({"draw": np.arange(n), "theta": points[pick].tolist(), "ess": 1 / (w**2).sum()})

    return draws.select("shard_id", "draw", "theta", "log_p", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: run(pdf), "draw long, theta array<double>, ess double")
