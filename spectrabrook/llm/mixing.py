"""Mixing sources to target weights by fitting each source's budget as a subset sum.

Every document of a source is taken as often as its target allows in full; the
rest of the budget is fitted exactly. Documents are counted by length; a
proportional share of each length comes first, and bounded-knapsack dynamic
programming over what is left of each length closes the gap. A seeded hash of
the document then decides which documents of a length are taken: hash buckets
split hot lengths, and only one bucket of a length needs an order.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrabrook.llm.common import WORD, stage


def targets(sizes: list[int], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, total: float | None = None) -> list[float]:
    """Each source's target: the total shared by weight, at most `most` times a size, the excess reshared."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    left = float(sum(sizes) if total is None else total)
    target = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    while free:
        share = left / sum(weight[i] for i in free)
        over = [i for i in free if share * weight[i] > most * sizes[i]]
        for i in over or free:
            target[i] = most * sizes[i] if over else share * weight[i]
        if not over:
            break
        left -= sum(target[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return target


def fit_budget(length: np.ndarray, count: np.ndarray, budget: int, least_window: int = 1 << 16, most_window: int = 1 << 22) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to budget as can be.

    At most count of each. Exact within the window: the sum is budget wherever
    the documents that the proportional share leaves can make up the gap. The
    window, and with it memory, is bounded: lengths beyond most_window fill the
    gap while they fit into it, and the shorter ones close it.
    """
    length, count = np.asarray(length, np.int64), np.asarray(count, np.int64)
    take = np.zeros(len(length), np.int64)
    total = int((length * count).sum())
    if budget >= total:
        return count.copy()
    if budget <= 0 or not len(length):
        return take
    take = np.minimum(count, [int(c) * budget // total for c in count])
    gap = budget - int((length * take).sum())
    window = min(most_window, max(least_window, 4 * int(length.max())))
    order = np.argsort(-length)
    for i in order:
        if gap <= window:
            break
        n = int(length[i])
        more = min(int(count[i] - take[i]), gap // n if n > window else (gap - window) // n + 1)
        take[i] += more
        gap -= more * n
    spare = count - take
    if gap > window:
        # All short documents are in, and those left are longer than the gap: the shortest may come nearer.
        left = np.flatnonzero(spare > 0)
        if len(left):
            i = left[np.argmin(length[left])]
            take[i] += int(length[i]) < 2 * gap
        return take
    # Subset sums of what is left, as bits of a number; parent holds the bundle that first reached a sum.
    short = length[(spare > 0) & (length <= window)]
    most = max(gap, 0) + int(short.max() if len(short) else 0)
    reach, mask = 1, (1 << (most + 1)) - 1
    bundles: list[tuple[int, int]] = []
    parent = np.full(most + 1, -1, np.int32)
    for i in order:
        left, k = min(int(spare[i]), most // int(length[i])), 1
        while left > 0 and not (reach >> gap) & 1:
            n = min(k, left)
            new = (reach << (n * int(length[i]))) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), np.uint8), bitorder="little")
                parent[np.flatnonzero(bits)] = len(bundles)
                bundles.append((int(i), n))
                reach |= new
            left, k = left - n, 2 * k
    below = reach & ((1 << (gap + 1)) - 1)
    best = below.bit_length() - 1
    above = reach >> (gap + 1)
    if above:
        up = gap + 1 + ((above & -above).bit_length() - 1)
        best = up if up - gap < gap - best else best
    while best > 0:
        i, n = bundles[parent[best]]
        take[i] += n
        best -= n * int(length[i])
    return take


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """sizes (source, source_size) with src, its place in order, and target; a table, however many sources there are.

    A target is the lesser of most times the size and a level times the weight.
    The level that shares all words rises from pass to pass, each an aggregate,
    until it leaves no further source below it.
    """
    order = F.col("source").asc_nulls_last()
    ranged = stage(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "mix-sources")
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row for each of the range's partitions
    starts, at = [], 0
    for r in before:
        starts.append((r["part"], at))
        at += r["n"]
    first = F.broadcast(sizes.sparkSession.createDataFrame(starts, "part int, first long"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1 + F.col("first")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod("src", F.lit(len(weights))).cast("int")]
    table = stage(ranged.join(first, "part").withColumn("src", place.cast("long")).withColumn("weight", weight).select("source", "source_size", "src", "weight"), "mix-weights")
    full = F.col("source_size") * most
    total = int(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, capped = 0.0, -1
    while True:
        under = (F.col("source_size") > 0) & (full >= F.col("weight") * level)
        r = table.agg(F.coalesce(F.sum(F.when(under, F.col("weight"))), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.when(~under, full)), F.lit(0)).alias("spent"), F.count(F.when(~under, 1)).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        level, capped = (total - r["spent"]) / r["w"], r["n"]
    return table.withColumn("target", F.least(full.cast("double"), F.col("weight") * F.lit(level))).drop("weight")


def _planned(docs: DataFrame, text: str, doc_id: str, source: str, weights: tuple[float, ...], most: int, seed: int, broadcast_rows: int, salts: int) -> DataFrame:
    """A row for each of docs: doc_id, source, tie (a seeded hash of id and text), size, source_size, target, times."""
    sized = stage(
        docs.select(
            docs[doc_id].alias("doc_id"),
            docs[source].alias("source"),
            F.regexp_count(F.coalesce(docs[text], F.lit("")), F.lit(WORD)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), docs[doc_id], docs[text]).alias("tie"),
        ),
        "mix-sizes",
    )
    goal = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    size, whole = F.col("source_size"), F.col("source_size") > 0
    times = F.when(whole, F.least(F.lit(most), F.floor(F.col("target") / size))).otherwise(0).cast("int")
    rest = F.greatest(F.round("target").cast("long") - F.col("times") * size, F.lit(0))
    of_source = stage(goal.withColumn("times", times).withColumn("rest", rest).withColumnRenamed("source", "_source"), "mix-plan")
    # A source may hold a third of the rows: few sources go to the rows, many are spread over salts.
    if of_source.count() <= broadcast_rows:
        joined = sized.join(F.broadcast(of_source), F.col("source").eqNullSafe(F.col("_source")))
    else:
        spread = of_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = sized.join(spread, F.col("source").eqNullSafe(F.col("_source")) & (F.pmod("tie", F.lit(salts)) == F.col("_salt")))
    rows = joined.select("doc_id", "source", "src", "size", "source_size", "target", "times", "rest", "tie", F.shiftrightunsigned("tie", 52).alias("bucket"))

    by_bucket = stage(rows.filter("size > 0").groupBy("src", "size", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("rest").alias("rest")), "mix-buckets")

    def fit(key, pdf):
        pdf = pdf.sort_values("size", kind="stable")
        take = fit_budget(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]))
        return pd.DataFrame({"src": np.int64(key[0]), "size": pdf["size"].to_numpy(), "chosen": take})

    chosen = by_bucket.groupBy("src", "size").agg(F.sum("n").alias("n"), F.max("rest").alias("rest")).groupBy("src").applyInPandas(fit, "src long, size long, chosen long")
    # Which bucket of a length the cut falls in: first among 64 runs of buckets, then inside each run.
    earlier = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fine = by_bucket.withColumn("run", F.shiftright("bucket", 6))
    runs = fine.groupBy("src", "size", "run").agg(F.sum("n").alias("n")).join(chosen, ["src", "size"])
    left = runs.select("src", "size", "run", (F.col("chosen") - earlier("src", "size", "run")).alias("left")).filter("left > 0")
    cut = fine.join(left, ["src", "size", "run"]).withColumn("part", F.least(F.col("n"), F.col("left") - earlier("src", "size", "run", "bucket"))).filter("part > 0").select("src", "size", "bucket", "part")
    place = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("tie", "doc_id"))
    placed = rows.withColumn("place", place).join(cut, ["src", "size", "bucket"], "left")
    extra = F.when(F.col("place") <= F.coalesce("part", F.lit(0)), 1).otherwise(0)
    return placed.select("doc_id", "source", "tie", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("times") + extra).otherwise(0).alias("times"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 42, broadcast_rows: int = 50_000, salts: int = 64) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    size counts the words of the text (null: 0), of very long ones too. Sources
    in code point order, null last, weigh as weights in turn; there may be any
    number of them. taken is a multiple of size, at most `most` times. Rows that
    repeat are documents of their own. Sizes of zero take nothing. An empty
    table gives an empty result; other columns, whatever their names, are not
    read.
    """
    planned = _planned(docs, text, doc_id, source, weights, most, seed, broadcast_rows, salts)
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def mixed_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 42, broadcast_rows: int = 50_000, salts: int = 64) -> DataFrame:
    """The rows of docs as the mix takes them: each as many times as it is taken, all its columns kept, whatever their names.

    Rows that share doc_id, text and source share what the mix takes of them;
    rows that share doc_id alone are documents of their own.
    """
    tag = f"_m{uuid.uuid4().hex}"
    one, two, three, four, five = (f"{tag}{i}" for i in range(5))
    planned = _planned(docs, text, doc_id, source, weights, most, seed, broadcast_rows, salts)
    keyed = planned.groupBy(F.col("doc_id").alias(one), F.col("source").alias(two), F.col("tie").alias(three)).agg(F.sum("times").alias(four), F.count(F.lit(1)).alias(five)).filter(F.col(four) > 0)
    taken = stage(keyed, "mix-taken")
    same = docs[doc_id].eqNullSafe(taken[one]) & docs[source].eqNullSafe(taken[two]) & (F.xxhash64(F.lit(seed), docs[doc_id], docs[text]) == taken[three])
    # One row for almost every document: the same exchange at every size, rather than a broadcast while it is small.
    joined = docs.join(taken.hint("merge"), same)
    times = F.col(four)
    if not taken.filter(F.col(five) > 1).isEmpty():
        at = F.row_number().over(Window.partitionBy(one, two, three).orderBy(F.lit(0)))
        joined = joined.withColumn(f"{tag}6", at)
        times = (F.floor(F.col(four) / F.col(five)) + F.when(F.col(f"{tag}6") <= F.pmod(F.col(four), F.col(five)), 1).otherwise(0)).cast("int")
    # Rows in place of copies: as many as the row is taken times, none for zero.
    copied = joined.withColumn(f"{tag}7", F.explode(F.array_repeat(F.lit(0), times.cast("int"))))
    return copied.select(*docs.columns)
