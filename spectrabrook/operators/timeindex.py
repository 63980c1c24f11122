"""Time indices: validation, dense numbering, trimming, and grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_finite(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns as doubles; refused if any value is null, NaN or infinite."""
    require_columns(df, *names)
    out = df.withColumns({c: F.col(c).cast("double") for c in names})
    bad = F.lit(False)
    for c in names:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    if not out.filter(bad).limit(1).isEmpty():
        raise ValueError(f"null or non-finite values in {', '.join(names)}")
    return out


def time_stats(df: DataFrame, time: str = "time") -> DataFrame:
    """n, distinct, first, last and the step of a regular index with these ends."""
    t = F.col(time).cast("double")
    stats = df.agg(F.count(t).alias("n"), F.countDistinct(t).alias("distinct"), F.min(t).alias("first"), F.max(t).alias("last"))
    return stats.withColumn("step", F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / (F.col("n") - 1)))


def validate_time(df: DataFrame, time: str = "time", tolerance: float = 1e-7) -> tuple[int, float, float]:
    """(n, first, step) of an index that is unique and regular within tolerance of a step."""
    s = time_stats(df, time).first()
    if s["n"] < 2 or s["n"] != s["distinct"] or s["n"] != df.count():
        raise ValueError("the time index must be unique, without nulls, and have two values or more")
    place = (F.col(time).cast("double") - s["first"]) / s["step"]
    worst = df.agg(F.max(F.abs(place - F.round(place)))).first()[0]
    if worst > tolerance:
        raise ValueError("the time index must be regularly spaced")
    return int(s["n"]), float(s["first"]), float(s["step"])


def dense_index(df: DataFrame, time: str = "time", out: str = "t") -> DataFrame:
    """Number the rows of a regular index from 0 in time order, by arithmetic: no sort, no single partition."""
    _, first, step = validate_time(df, time)
    return df.withColumn(out, F.round((F.col(time).cast("double") - first) / step).cast("long"))


def trim(df: DataFrame, n: int, divisor: int, keep: str = "newest", t: str = "t") -> tuple[DataFrame, int]:
    """(rows, length) for a length that divisor divides: the oldest rows go unless keep is "oldest"."""
    if keep not in ("newest", "oldest"):
        raise ValueError("keep must be newest or oldest")
    over = n % divisor
    if keep == "oldest":
        return df.filter(F.col(t) < n - over), n - over
    return df.filter(F.col(t) >= over).withColumn(t, F.col(t) - over), n - over


def window_rows(df: DataFrame, n: int, length: int, end: str = "head", t: str = "t") -> DataFrame:
    """The first or the last length rows, numbered from 0."""
    start = 0 if end == "head" else max(0, n - length)
    return df.filter((F.col(t) >= start) & (F.col(t) < start + length)).withColumn(t, F.col(t) - start)


def fft_blocks(n: int, most: int) -> int:
    """The largest power of two up to most that divides n."""
    p = 1
    while p * 2 <= most and n % (p * 2) == 0:
        p *= 2
    return p


def divisor_blocks(n: int, most: int) -> int:
    """The largest number up to most that divides n."""
    return next(p for p in range(min(n, most), 0, -1) if n % p == 0)


def on_grid(df: DataFrame, n: int, fill: float | None = 0.0, t: str = "t") -> DataFrame:
    """All of 0..n-1, other columns filled where a value is missing."""
    grid = df.sparkSession.range(n).select(F.col("id").alias(t))
    out = grid.join(df, t, "left")
    return out if fill is None else out.fillna(fill)
