"""Forecast scores, comparisons of models, paired bootstraps and timing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spectrabrook.functions.columns import score_columns, scores_of
from spectrabrook.operators.quantiles import exact_quantiles


def score_samples(forecasts: DataFrame) -> DataFrame:
    """Score forecasts with actual, prediction and draws (an array in any order)."""
    ordered = forecasts.withColumn("draws", F.array_sort("draws"))
    return ordered.withColumns(score_columns(F.col("actual"), F.col("prediction"), F.col("draws")))


def score_rows(rows: DataFrame, keys: Sequence[str], value: str = "value", actual: str = "actual", prediction: str = "prediction") -> DataFrame:
    """score_samples for draws that are rows: keys, actual, prediction and the scores of each group.

    Ranks and counts in one sorted window give what an array of draws would, so
    a group may hold any number of draws; null draws don't count.
    """
    whole = Window.partitionBy(*keys)
    v, a = F.col("_v"), F.col("_a")
    ranked = rows.select(*keys, F.col(value).cast("double").alias("_v"), F.col(actual).alias("_a"), F.col(prediction).alias("_p")).filter(F.col("_v").isNotNull())
    ranked = ranked.withColumn("_i", F.row_number().over(whole.orderBy("_v"))).withColumn("_n", F.count(F.lit(1)).over(whole))

    def quantile(p):
        at = (F.col("_n") - 1) * F.lit(p)
        low, high = (F.max(F.when(F.col("_i") == f(at) + 1, v)) for f in (F.floor, F.ceil))
        return low + F.max(at - F.floor(at)) * (high - low)

    n = F.max("_n").cast("double")
    crps = F.sum(F.abs(v - a)) / n - F.sum((2 * F.col("_i") - F.col("_n") - 1) * v) / (n * n)
    names = {"lo95": 0.025, "lo80": 0.1, "hi80": 0.9, "hi95": 0.975}
    sums = ranked.groupBy(*keys).agg(F.max("_a").alias(actual), F.max("_p").alias(prediction), crps.alias("_crps"), *[quantile(p).alias(f"_{k}") for k, p in names.items()])
    found = scores_of(F.col(actual), F.col(prediction), F.col("_crps"), *[F.col(f"_{k}") for k in names])
    return sums.select(*keys, actual, prediction, *[c.alias(k) for k, c in found.items()])


def window_reason(end: Column, context: int, horizon: int, lo: Column, hi: Column, past: Column, future: Column) -> Column:
    """Why a window can't be scored, in this order; null if it can. past and future count its usable values."""
    return F.when((end - context < lo) | (end + horizon > hi), "session_boundary").when(past < context, "missing_history").when(future < horizon, "missing_target")


def measures() -> list[Column]:
    """n, days, rmse and means of the scores."""
    return [
        F.count("se").alias("n"),
        F.countDistinct("day_index").alias("days"),
        F.sqrt(F.avg("se")).alias("rmse"),
        F.avg("ae").alias("mae"),
        F.avg("crps").alias("crps"),
        F.avg("cover80").alias("cover80"),
        F.avg("cover95").alias("cover95"),
        F.avg("interval80").alias("interval80"),
        F.avg("interval95").alias("interval95"),
    ]


def score_table(scores: DataFrame, *keys: str) -> DataFrame:
    return scores.groupBy(*keys).agg(*measures())


def comparison(forecasts: DataFrame, benchmark: str, keys: Sequence[str] = ("horizon",)) -> DataFrame:
    """By keys and model: n, bias, rmse, mae, mean width and score of the 95% interval, and the gain over a benchmark model.

    forecasts has model, actual, error, lower95 and upper95. The gain is how much
    smaller the RMSE is than the benchmark's of the same keys, in percent.
    """
    lo, hi, a = F.col("lower95"), F.col("upper95"), F.col("actual")
    outside = F.greatest(lo - a, F.lit(0.0)) + F.greatest(a - hi, F.lit(0.0))
    table = forecasts.groupBy(*keys, "model").agg(
        F.count("error").alias("n"),
        F.avg("error").alias("bias"),
        F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        F.avg(F.abs("error")).alias("mae"),
        F.avg(hi - lo).alias("width95"),
        F.avg(hi - lo + 40 * outside).alias("interval95"),
    )
    # The benchmark's row of each key beside the others, in a window of as many rows as models.
    base = F.max(F.when(F.col("model") == benchmark, F.col("rmse"))).over(Window.partitionBy(*keys))
    return table.withColumn("gain_pct", 100 * (1 - F.col("rmse") / base))


def score_grouping_sets(scores: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """The same measures at several levels in one pass; a key outside a row's level is null, and level numbers the set."""
    keys = list(dict.fromkeys(k for s in sets for k in s))
    found = scores.groupingSets([[F.col(k) for k in s] for s in sets], *[F.col(k) for k in keys]).agg(*measures(), F.grouping_id(*keys).alias("gid"))
    level = F.lit(None).cast("int")
    for i, s in enumerate(sets):
        bits = sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s)
        level = F.when(F.col("gid") == bits, i).otherwise(level)
    return found.withColumn("level", level).drop("gid")


def origin_errors(forecasts: DataFrame, grid: DataFrame) -> DataFrame:
    """n, bias, mae and rmse for each model, horizon and origin of the grid, present or not."""
    keys = ["model", "horizon", "origin"]
    found = forecasts.groupBy(*keys).agg(F.count("error").alias("n"), F.avg("error").alias("bias"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") ** 2)).alias("rmse"))
    return grid.join(found, keys, "left").fillna(0, ["n"])


def paired(forecasts: DataFrame, models: Sequence[str], keys: Sequence[str] = ("day_index", "origin", "horizon"), value: str = "se") -> DataFrame:
    """One row for each key with each model's value in a column of its own; keys without all models go."""
    wide = forecasts.filter(F.col("model").isin(list(models))).groupBy(*keys).pivot("model", list(models)).agg(F.first(value))
    return wide.dropna(subset=list(models))


def one_to_one(new: DataFrame, old: DataFrame, keys: Sequence[str], same: str = "actual") -> DataFrame:
    """Join on keys, refused unless each side's rows match one for one with equal values of `same`."""
    other = old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in old.columns if c not in keys])
    both = new.join(other, list(keys))
    checks = both.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col(same).eqNullSafe(F.col(f"old_{same}"))), F.lit(True)).alias("equal")).first()
    if not (checks["n"] == new.count() == old.count()) or not checks["equal"]:
        raise ValueError("rows don't match one for one with equal values")
    return both


def integrity(forecasts: DataFrame, models: int, keys: Sequence[str] = ("day_index", "origin", "horizon")) -> DataFrame:
    """Keys that break the rules: another number of models, repeated rows, or differing actual values."""
    c = forecasts.groupBy(*keys).agg(F.countDistinct("model").alias("models"), F.count(F.lit(1)).alias("rows"), F.countDistinct("actual").alias("actuals"))
    return c.filter((F.col("models") != models) | (F.col("rows") != models) | (F.col("actuals") > 1))


def cluster_sums(wide: DataFrame, candidate: str, benchmark: str, block_days: int = 20, keys: Sequence[str] = ("horizon", "origin")) -> DataFrame:
    """Squared errors of both models by key and cluster of the original calendar index."""
    cluster = F.floor(F.col("day_index") / block_days).cast("int")
    return wide.groupBy(*keys, cluster.alias("cluster")).agg(F.sum(candidate).alias("candidate"), F.sum(benchmark).alias("benchmark"), F.count(F.lit(1)).alias("n"))


#: A prime; all of scattered()'s steps stay below its square, within a long.
PRIME = 2147483647


def scattered(replicate: Column, slot: Column, seed: int, n: Column | int) -> Column:
    """A number below n for each replicate and slot: two squarings modulo a prime, so that any engine can make it."""
    x = F.pmod(replicate * F.lit(48271) + slot * F.lit(69621) + F.lit(seed), F.lit(PRIME))
    x = F.pmod(x * x + slot, F.lit(PRIME))
    x = F.pmod(x * F.lit(16807) + replicate, F.lit(PRIME))
    return F.pmod(F.pmod(x * x, F.lit(PRIME)), n if isinstance(n, Column) else F.lit(n))


def bootstrap_weights(units: DataFrame, unit: str, n: int, replicates: int, seed: int) -> DataFrame:
    """replicate, unit and its multiplicity w: n of the n units drawn in each replicate, with replacement.

    units numbers them from 0 in a column place. Executors make the draws, so
    that neither the driver nor a broadcast holds replicates times units.
    """
    at = units.sparkSession.range(replicates * n).select(F.floor(F.col("id") / n).alias("replicate"), F.pmod("id", F.lit(n)).alias("slot"))
    drawn = at.select("replicate", scattered(F.col("replicate"), F.col("slot"), seed, n).alias("place"))
    return drawn.groupBy("replicate", "place").agg(F.count(F.lit(1)).alias("w")).join(units.select("place", unit), "place").select("replicate", unit, "w")


def moving_block_weights(spark, days: int, block: int, replicates: int, seed: int) -> DataFrame:
    """replicate, day and its multiplicity w under circular moving blocks, the last one cut so that each replicate has `days` days."""
    blocks = -(-days // block)
    at = spark.range(replicates * blocks).select(F.floor(F.col("id") / blocks).alias("replicate"), F.pmod("id", F.lit(blocks)).alias("slot"))
    start = at.withColumn("start", scattered(F.col("replicate"), F.col("slot"), seed, days))
    each = start.select("replicate", "slot", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("step")).filter(F.col("slot") * block + F.col("step") < days)
    return each.groupBy("replicate", F.pmod(F.col("start") + F.col("step"), F.lit(days)).alias("day")).agg(F.count(F.lit(1)).alias("w"))


def paired_gains(sums: DataFrame, replicates: int = 10_000, seed: int = 20261014, keys: Sequence[str] = ("horizon", "origin"), least_valid: float = 0.99) -> DataFrame:
    """RMSE reduction in percent with percentile intervals, by key and pooled over origins.

    sums is cluster_sums()'s. Clusters drawn in a replicate are counted first and
    meet the sums by cluster, so work grows with clusters times replicates and
    no row of the input is resampled.
    """
    places = sums.select("cluster").distinct().withColumn("place", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("long"))
    clusters = places.count()
    if clusters < 2:
        raise ValueError("at least two clusters are needed")
    pooled = sums.groupBy(*[k for k in keys if k != "origin"], "cluster").agg(F.sum("candidate").alias("candidate"), F.sum("benchmark").alias("benchmark"), F.sum("n").alias("n")).withColumn("origin", F.lit("Pooled"))
    both = sums.unionByName(pooled)
    parts = both.join(bootstrap_weights(places, "cluster", clusters, replicates, seed), "cluster")
    reps = parts.groupBy(*keys, "replicate").agg(F.sum(F.col("w") * F.col("candidate")).alias("c"), F.sum(F.col("w") * F.col("benchmark")).alias("b"))
    gain = F.when(F.col("b") > 0, 100 * (1 - F.sqrt(F.col("c") / F.col("b"))))
    limits = reps.groupBy(*keys).agg(F.percentile(gain, F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(gain).alias("bootstrap_valid"))
    totals = both.groupBy(*keys).agg(F.sum("n").alias("n"), F.countDistinct("cluster").alias("clusters"), F.sum("candidate").alias("c"), F.sum("benchmark").alias("b"))
    out = totals.join(limits, list(keys)).select(*keys, "n", "clusters", F.sqrt(F.col("c") / F.col("n")).alias("rmse_candidate"), F.sqrt(F.col("b") / F.col("n")).alias("rmse_benchmark"), (100 * (1 - F.sqrt(F.col("c") / F.col("b")))).alias("rmse_reduction_pct"), F.col("q")[0].alias("lower_pct"), F.col("q")[1].alias("upper_pct"), "bootstrap_valid")
    checked = out.withColumn("excludes_zero", (F.col("lower_pct") > 0) | (F.col("upper_pct") < 0))
    return checked.filter(F.when(F.col("bootstrap_valid") >= least_valid * replicates, True).otherwise(F.raise_error(F.lit("too few replicates with positive benchmark errors")).cast("boolean")))


def block_differences(daily: DataFrame, block: int = 5, replicates: int = 10_000, seed: int = 0) -> DataFrame:
    """Mean daily difference with a circular moving-block interval; daily has day (0..n-1) and difference."""
    n = daily.count()
    drawn = moving_block_weights(daily.sparkSession, n, block, replicates, seed)
    reps = daily.join(drawn, "day").groupBy("replicate").agg((F.sum(F.col("w") * F.col("difference")) / n).alias("m"))
    q = reps.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return daily.agg(F.avg("difference").alias("mean_difference")).join(F.broadcast(q)).select("mean_difference", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def timing_table(times: DataFrame, *keys: str, seconds: str = "seconds") -> DataFrame:
    """Median, quartiles and range of repeated timings, exact for groups of any size."""
    ends = times.groupBy(*keys).agg(F.count(seconds).alias("runs"), F.min(seconds).alias("fastest"), F.max(seconds).alias("slowest"))
    q = exact_quantiles(times, keys, seconds, (0.25, 0.5, 0.75)).select(*[F.col(k).alias(f"_q_{k}") for k in keys], "q")
    same = F.lit(True)
    for k in keys:
        same = same & ends[k].eqNullSafe(q[f"_q_{k}"])
    out = ends.join(q, same, "left")
    return out.select(*keys, "runs", F.col("q")[1].alias("median"), F.col("q")[0].alias("q25"), F.col("q")[2].alias("q75"), "fastest", "slowest")


def scaling(table: DataFrame, slots: str = "slots", *keys: str) -> DataFrame:
    """Speed-up and efficiency against the row with the fewest slots of each key."""
    base = table.groupBy(*keys).agg(F.min_by("median", slots).alias("base"), F.min(slots).alias("base_slots"))
    joined = table.join(F.broadcast(base), list(keys)) if keys else table.join(F.broadcast(base))
    up = F.col("base") / F.col("median")
    return joined.withColumn("speedup", up).withColumn("efficiency", up * F.col("base_slots") / F.col(slots)).drop("base", "base_slots")
