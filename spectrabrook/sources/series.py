"""Readers and generators of series, regressions, panels and draws."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrabrook.operators.timeindex import dense_index, require_columns, require_finite


def hourly(events: DataFrame, hours: int = 720, start: str = "2024-01-01 00:00:00", time: str = "ts", value: str = "value", outside: str = "raise") -> DataFrame:
    """Counts y and sums x1 of events by hour since start, on a grid of all hours: t, y, x1.

    Events before or after the grid are refused when the rows are read, or with
    outside "drop" left out. Events without a time count for no hour.
    """
    t = F.floor(F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{start}', {time})") / 3_600_000_000)
    found = events.filter(F.col(time).isNotNull()).groupBy(t.cast("long").alias("t")).agg(F.count(F.lit(1)).cast("double").alias("y"), F.sum(value).alias("x1"))
    inside = (F.col("t") >= 0) & (F.col("t") < hours)
    if outside != "drop":
        inside = F.when(inside, True).otherwise(F.raise_error(F.concat(F.lit(f"events outside the {hours} hours since {start}: hour "), F.col("t"))).cast("boolean"))
    grid = events.sparkSession.range(hours).select(F.col("id").alias("t"))
    return grid.join(found.filter(inside), "t", "left").fillna(0.0, ["y", "x1"])


def daily(orders: DataFrame, time: str = "o_orderdate", value: str = "o_totalprice") -> DataFrame:
    """Sums by day on a grid from the first to the last day: t, y."""
    days = orders.groupBy(F.to_date(time).alias("day")).agg(F.sum(value).alias("y"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = ends.select(F.explode(F.sequence("a", "b")).alias("day"), "a").select("day", F.datediff("day", "a").cast("long").alias("t"))
    return grid.join(days, "day", "left").select("t", F.coalesce("y", F.lit(0.0)).alias("y"))


def load_array(spark: SparkSession, path: str, column: str = "y") -> DataFrame:
    """A one-dimensional .npy, or a text file with a value on each line, as t and the column, in file order."""
    if path.endswith(".npy"):
        x = np.load(path)
        if x.ndim != 1:
            raise ValueError("a series is one-dimensional")
    else:
        x = np.loadtxt(path, ndmin=1)
    return require_finite(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], f"t long, {column} double"), column)


def load_table(spark: SparkSession, path: str, value: str | None = None, time: str | None = None) -> DataFrame:
    """A CSV with a header or a Parquet table as t, y.

    value names the column; by default the last one. With time the rows are
    numbered in its order, and refused if it is irregular; without it the
    table must hold t already, for the order of a table's rows means nothing.
    """
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    value = value or df.columns[-1]
    require_columns(df, value, time or "t")
    df = require_finite(df, value, time or "t")
    out = dense_index(df, time) if time else df.withColumn("t", F.col("t").cast("long"))
    return out.select("t", F.col(value).alias("y"))


def load_regression(spark: SparkSession, path: str, y: str = "y", covariates: Sequence[str] = ("x",), time: str = "time") -> DataFrame:
    """t, y, x1.. from a CSV or Parquet table with named columns, or rows x, y of a .npy."""
    if path.endswith(".npy"):
        a = np.load(path)
        rows = [(i, float(v), *map(float, a[:-2, i] if len(a) > 3 else a[:1, i])) for i, v in enumerate(a[1] if len(a) <= 3 else a[-2])]
        n = len(rows[0]) - 2
        return spark.createDataFrame(rows, "t long, y double, " + ", ".join(f"x{j + 1} double" for j in range(n)))
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    df = dense_index(require_finite(df, y, time, *covariates), time)
    return df.select("t", F.col(y).alias("y"), *[F.col(c).alias(f"x{j + 1}") for j, c in enumerate(covariates)])


def sinusoids(spark: SparkSession, n: int) -> DataFrame:
    """t, y: a deterministic sum of sinusoids made by the executors."""
    t = F.col("id")
    y = F.sin(t * 0.01) + 0.5 * F.cos(t * 0.037) + 0.25 * F.sin(t * 0.11)
    return spark.range(n).select(t.alias("t"), y.alias("y"))


def congruential(spark: SparkSession, n: int) -> DataFrame:
    """t, y: 48271 t mod (2^31 - 1), scaled to [-0.5, 0.5)."""
    y = F.pmod(F.col("id") * F.lit(48271), F.lit(2147483647)) / F.lit(2147483647.0) - 0.5
    return spark.range(n).select(F.col("id").alias("t"), y.alias("y"))


def stationary(phi: Sequence[float]) -> bool:
    """True if the AR polynomial's roots lie outside the unit circle."""
    return bool((np.abs(np.roots([*(-np.asarray(phi, float)[::-1]), 1.0])) > 1).all()) if len(phi) else True


def simulate_regression(spark: SparkSession, n: int, beta: float, phi: tuple[float, float], sigma2: float, burn: int = 1000, seed: int = 0) -> tuple[DataFrame, str]:
    """t, y, x1, residual with AR(2) errors, and the true parameters as JSON."""
    if n < 4 or sigma2 <= 0 or not stationary(phi):
        raise ValueError("n must be 4 or more, sigma2 positive and the errors stationary")
    rng = np.random.default_rng(seed)
    noise = rng.normal(0, np.sqrt(sigma2), n + burn)
    e = np.zeros(n + burn)
    for i in range(2, n + burn):
        e[i] = phi[0] * e[i - 1] + phi[1] * e[i - 2] + noise[i]
    x, e = rng.normal(size=n), e[burn:]
    rows = list(zip(range(n), (beta * x + e).tolist(), x.tolist(), e.tolist(), strict=True))
    truth = json.dumps({"n": n, "beta": beta, "phi1": phi[0], "phi2": phi[1], "sigma2": sigma2, "seed": seed})
    return spark.createDataFrame(rows, "t long, y double, x1 double, residual double"), truth


def event_panel(events: DataFrame, slots: int = 288, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """A panel from events: day_index, phase (am, pm), second (the day's slot), spread (mean value of the slot)."""
    per = 86_400 // slots
    s = F.expr(f"timestampdiff(SECOND, timestamp_ntz'{start}', ts)").cast("long")
    slot = F.floor(F.pmod(s, F.lit(86_400)) / per).cast("int")
    rows = events.select(F.floor(s / 86_400).cast("int").alias("day_index"), slot.alias("second"), "value")
    return rows.groupBy("day_index", "second").agg(F.avg("value").alias("spread")).select("day_index", F.when(F.col("second") < slots // 2, "am").otherwise("pm").alias("phase"), "second", "spread")


def read_panel(spark: SparkSession, path: str, manifest: str | None = None) -> DataFrame:
    """A long panel table with NaN as null; a manifest (JSON with days and rows) is checked against it."""
    df = spark.read.parquet(path)
    require_columns(df, "day_index", "phase", "second", "spread")
    df = df.withColumn("spread", F.when(~F.isnan("spread"), F.col("spread")))
    if manifest:
        said = json.loads("\n".join(r[0] for r in spark.read.text(manifest).collect()))
        held = df.agg(F.countDistinct("day_index").alias("days"), F.count(F.lit(1)).alias("rows")).first().asDict()
        wrong = {k: v for k, v in said.items() if k in held and held[k] != v}
        if wrong:
            raise ValueError(f"the panel doesn't hold what its manifest says: {wrong}")
    return df


def event_draws(events: DataFrame, most: int = 10_000, run_rows: int = 1 << 20) -> DataFrame:
    """Events as draws: shard_id by type in order of name, draw by event_id from 0, theta the value and its logarithm.

    Events without a type are a type of their own; more than most types are refused.
    The logarithm of zero is minus infinity, that of a negative value null. Ids are
    cut into ranges of about run_rows events; a draw's number is its rank in its
    range after the counts of the ranges before, so no task orders a whole type.
    """
    from pyspark.sql import Window

    types = events.select("event_type").distinct().orderBy("event_type").limit(most + 1).collect()
    if len(types) > most:
        raise ValueError(f"event_draws: more than {most} event types")
    ids = events.sparkSession.createDataFrame([(r[0], i) for i, r in enumerate(types)], "_type string, shard_id int")
    ends = events.agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    log = F.when(F.col("value") == 0, F.lit(float("-inf"))).otherwise(F.log("value"))
    width = max(1, -(-(int(ends["b"]) - int(ends["a"]) + 1) // max(1, int(ends["n"]) // run_rows))) if ends["a"] is not None else 1
    run = F.coalesce(F.floor((F.col("event_id") - F.lit(ends["a"])) / width), F.lit(-1)).cast("long")
    rows = events.join(F.broadcast(ids), F.col("event_type").eqNullSafe(F.col("_type"))).select("shard_id", run.alias("run"), "event_id", F.array(F.col("value"), log).alias("theta"))
    sizes = rows.groupBy("shard_id", "run").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard_id", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard_id", "run").orderBy("event_id")) - 1
    return rows.withColumn("place", place).join(starts, ["shard_id", "run"]).select("shard_id", (F.col("start") + F.col("place")).cast("long").alias("draw"), "theta")
