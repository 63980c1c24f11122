"""Exact quantiles of large groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], accuracy: int = 10_000) -> DataFrame:
    """keys and q, the linear-interpolation quantiles of value at probs, for groups of any size.

    A sketch brackets each quantile between two values; what lies below is
    counted, and only the rows inside the bracket, some 1 / accuracy of a group,
    are put in order. So no task holds a group's values, as F.percentile does.
    A group of at most accuracy rows is its own bracket.
    Null values don't count; a group without any has null quantiles.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    margin = 3.0 / accuracy
    ends = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", F.array(*map(F.lit, ends)), F.lit(accuracy)).alias("_e"))
    m = len(probs)
    whole = F.array(*[F.lit(float("-inf"))] * m, *[F.lit(float("inf"))] * m)
    sketch = sketch.withColumn("_e", F.when(F.col("_n") <= accuracy, whole).otherwise(F.col("_e")))
    place = lambda p: F.lit(p) * (F.col("_n") - 1)
    brackets = sketch.select(*keys, F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("_e")[j].alias("lo"), F.col("_e")[m + j].alias("hi"), place(p).alias("at")) for j, p in enumerate(probs)])).alias("_b"))
    flat = brackets.select(*keys, "_b.j", "_b.lo", "_b.hi", "_b.at")
    wide = sketch.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_e")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & rows[k].eqNullSafe(wide[f"_k{i}"])
    met = rows.join(wide, same)  # a row for each group, broadcast while it is small
    # Of every quantile: whether the row lies below its bracket or inside.
    marks = F.array(*[F.struct(F.lit(j).alias("j"), (F.col("_v") < F.col("_e")[j]).alias("under"), F.col("_v").between(F.col("_e")[j], F.col("_e")[m + j]).alias("inside")) for j in range(m)])
    below = met.groupBy(*keys).agg(*[F.count(F.when(F.col("_v") < F.col("_e")[j], 1)).alias(f"u{j}") for j in range(m)])
    inside = met.select(*keys, "_v", F.explode(F.filter(marks, lambda x: x["inside"])).alias("_m")).groupBy(*keys, F.col("_m.j").alias("j"), "_v").agg(F.count(F.lit(1)).alias("c"))
    # Equal values are one row: a cumulative count places them.
    upto = F.sum("c").over(Window.partitionBy(*keys, "j").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counts = below.select(*keys, F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"u{j}").alias("u")) for j in range(m)])).alias("_u")).select(*keys, "_u.j", "_u.u")
    on = [*keys, "j"]
    placed = _null_safe_join(_null_safe_join(inside.withColumn("upto", upto), flat.select(*on, "at"), on), counts, on)
    first, last = F.col("u") + F.col("upto") - F.col("c"), F.col("u") + F.col("upto") - 1
    holds = lambda i: F.max(F.when((first <= i) & (i <= last), F.col("_v")))
    ends_of = placed.groupBy(*on).agg(holds(F.floor("at")).alias("a"), holds(F.ceil("at")).alias("b"), F.max(F.col("at") - F.floor("at")).alias("part"))
    one = ends_of.select(*keys, F.struct("j", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).alias("q")).alias("s"))
    return one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["q"]).alias("q"))  # as many as probs


def _null_safe_join(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    named = b.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & a[k].eqNullSafe(named[f"_r_{k}"])
    return a.join(named, same).drop(*[f"_r_{k}" for k in keys])
