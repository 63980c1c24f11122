"""Density forecasts of a day from posterior draws, and experiments over rolling histories."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectrabrook.functions.predict import predictor, sum_variances
from spectrabrook.operators import panel as panels
from spectrabrook.operators import spectrum

FORECAST = "day_index int, event string, origin string, horizon int, context_levels int, model string, target_ok boolean, actual double, prediction double, draws array<double>"
MODELS = ("spectral", "null", "last_value", "clock")


def balanced(draws: np.ndarray, per_chain: int, rng: np.random.Generator) -> np.ndarray:
    """The same number of draws from each chain, without replacement."""
    return np.concatenate([c[rng.choice(len(c), min(per_chain, len(c)), replace=False)] for c in draws])


def paths(weights: np.ndarray, cov: np.ndarray, history: np.ndarray, anchor: float, offset: np.ndarray, scale: np.ndarray, count: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Point forecasts and antithetic paths of levels, from predicted standardised increments."""
    h = len(offset)
    root = np.linalg.cholesky(cov[:h, :h] + 1e-12 * np.eye(h))
    mean = anchor + offset + np.cumsum(scale * (weights[:h] @ history))
    half = rng.normal(size=(count // 2, h))
    z = np.r_[half, -half]
    return np.exp(mean + 0.5 * sum_variances(cov[:h, :h], scale)), np.exp(mean + np.cumsum(scale * (z @ root.T), axis=1))


def forecast_days(tasks: DataFrame, panel: DataFrame, clock: DataFrame, posterior: DataFrame, kind: str = "artfima01", parameters: tuple[str, ...] = ("theta", "lambda", "sigma2", "d"), null: dict | None = None, draws: int = 64, paths_per_draw: int = 8, seed: int = 0) -> DataFrame:
    """Forecasts of issued tasks, a row for each task and model.

    panel: day_index, second, spread. clock: second, profile, mean, scale (one
    row a second; it goes to every task). posterior: day_index, chain, draw,
    theta (on the scale of `parameters`). Averages over a horizon are taken
    after exponentiation. A task whose target is missing keeps its forecast.
    """
    table = clock.select("second", "profile", "mean", "scale").toPandas().sort_values("second")  # bounded by the seconds of a day
    top = int(table["second"].max()) + 1
    fill = lambda name, v: np.where(np.isin(np.arange(top), table["second"]), np.interp(np.arange(top), table["second"], table[name]), v)
    profile, centre, scale = fill("profile", np.nan), fill("mean", 0.0), fill("scale", 1.0)
    null = null or {"theta": 0.0, "lambda": 1.0, "sigma2": 1.0, "d": 0.0}

    def run(key, todo, data):
        todo = todo[todo["issued"]] if len(todo) else todo
        levels = data[data["kind"] == 0]
        theta = data[data["kind"] == 1]
        if not len(todo) or not len(levels) or not len(theta):
            return pd.DataFrame([], columns=[n.split()[0] for n in FORECAST.split(", ")], dtype=object)
        day = int(key[0])
        rng = np.random.default_rng([seed, day])
        raw = np.full(top, np.nan)
        raw[levels["second"].to_numpy().astype(int)] = levels["spread"].to_numpy()
        chains = [np.stack(g.sort_values("draw")["theta"].to_numpy()) for _, g in theta.groupby("chain", sort=True)]
        chosen = balanced(chains, max(1, draws // len(chains)), rng)
        rows, longest = [], int(todo["horizon"].max())
        cache = {c: [predictor(kind, dict(zip(parameters, t, strict=True)), c - 1, longest) for t in chosen] for c in sorted(set(todo["context_levels"].astype(int)))}
        for _, group in todo.groupby("origin", sort=True):
            r = group.iloc[0]
            end, context, h = int(r["end"]), int(r["context_levels"]), int(group["horizon"].max())
            past = np.log(raw[end - context : end])
            history = (np.diff(past) - centre[end - context + 1 : end]) / scale[end - context + 1 : end]
            anchor, offset, ahead = past[-1], profile[end : end + h] - profile[end - 1], scale[end : end + h]
            found = [paths(w, c, history, anchor, offset, ahead, paths_per_draw, rng) for w, c in cache[context]]
            many = paths_per_draw * len(chosen)
            w0, c0 = predictor(kind, null, context - 1, h)
            flat = (np.zeros_like(w0), np.eye(h) * null["sigma2"])
            out = {
                "spectral": (np.mean([p for p, _ in found], axis=0), np.concatenate([x for _, x in found])),
                "null": paths(w0, c0, history, anchor, offset, ahead, many, rng),
                "last_value": (np.full(h, np.exp(anchor)), paths(*flat, history, anchor, np.zeros(h), ahead, many, rng)[1]),
                "clock": (np.exp(anchor + offset), paths(*flat, history, anchor, offset, ahead, many, rng)[1]),
            }
            for _, t in group.iterrows():
                n = int(t["horizon"])
                actual = float(raw[end : end + n].mean()) if t["target_ok"] else None
                for m in MODELS:
                    point, sim = out[m]
                    rows.append((day, t["event"], t["origin"], n, context, m, bool(t["target_ok"]), actual, float(point[:n].mean()), np.sort(sim[:, :n].mean(axis=1)).tolist()))
        return pd.DataFrame(rows, columns=[n.split()[0] for n in FORECAST.split(", ")])

    lo = F.when(F.col("phase") == panels.DAY[0].name, panels.DAY[0].start).otherwise(panels.DAY[1].start)
    todo = tasks.withColumn("end", F.col("end") if "end" in tasks.columns else lo + F.col("elapsed")).select("day_index", "event", "origin", "horizon", "context_levels", "issued", "target_ok", "end")
    none = F.lit(None)
    levels = panel.filter(F.col("spread").isNotNull()).select("day_index", F.lit(0).alias("kind"), "second", "spread", none.cast("int").alias("chain"), none.cast("long").alias("draw"), none.cast("array<double>").alias("theta"))
    fits = posterior.select("day_index", F.lit(1).alias("kind"), none.cast("int").alias("second"), none.cast("double").alias("spread"), "chain", "draw", "theta")
    return todo.groupBy("day_index").cogroup(levels.unionByName(fits).groupBy("day_index")).applyInPandas(lambda key, a, b: run(key, a, b), FORECAST)


def history_spectrum(panel: DataFrame, last_day: int, most_blocks: int = 256) -> tuple[DataFrame, int, float]:
    """(periodogram, n, scale) of the standardised changes of days strictly before last_day.

    Calibration sees those days alone. The earliest change goes if their number
    is odd, and all are divided by one population sd. Positions come from
    counts per day and phase, so only one row of each is put in order globally.
    """
    past = panel.filter(F.col("day_index") < last_day)
    z = panels.standardised(past, panels.calibration(past)).select("day_index", "phase", "second", "z")
    from pyspark.sql import Window

    sizes = z.groupBy("day_index", "phase").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("day_index", "phase").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy("day_index", "phase").orderBy("second")) - 1
    rows = z.withColumn("i", place).join(before, ["day_index", "phase"]).select((F.col("start") + F.col("i")).cast("long").alias("t"), "z")
    s = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("z").alias("sd")).first()
    n, odd = int(s["n"]), int(s["n"]) % 2
    series = rows.filter(F.col("t") >= odd).select((F.col("t") - odd).alias("t"), (F.col("z") / float(s["sd"])).alias("y"))
    n -= odd
    return spectrum.periodogram(spectrum.transform(series, n, most_blocks=most_blocks), n), n, float(s["sd"])
