"""Fourier transforms of series and their periodograms.

A transform takes two exchanges: by remainder of the index, then by frequency
block. Its result stays in blocks and is never sorted. Several columns go
through together, so spectra of covariates need no join.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spectrabrook.functions.columns import TWO_PI, half_angle
from spectrabrook.operators.timeindex import divisor_blocks


def direct_dft(series: DataFrame, n: int, columns: Sequence[str] = ("y",), t: str = "t") -> DataFrame:
    """The transform by definition, for positive frequencies k < n/2: work grows with n^2, so for short series and checks.

    Rows meet frequencies in an exploded range and are summed map-side, so at
    most one row for each frequency and task is exchanged.
    """
    k = F.explode(F.sequence(F.lit(1).cast("long"), F.lit((n - 1) // 2).cast("long")))
    rows = series.select(t, *columns, k.alias("k"))
    angle = F.pmod(F.col("k") * F.col(t), F.lit(n)) * F.lit(TWO_PI / n)
    parts = []
    for c in columns:
        parts += [F.sum(F.col(c) * F.cos(angle)).alias(f"re_{c}"), (-F.sum(F.col(c) * F.sin(angle))).alias(f"im_{c}")]
    return rows.groupBy("k").agg(*parts)


def fft(series: DataFrame, n: int, blocks: int, columns: Sequence[str] = ("y",), t: str = "t", imaginary: dict[str, str] | None = None, positive: bool = True) -> DataFrame:
    """The exact transform as (k, re_<column>, im_<column>), for n that blocks divides.

    Refuses a series whose rows aren't each index from 0 to n-1 once. imaginary
    names the columns with imaginary parts. With positive only frequencies 1 to
    (n-1)//2 are returned; the others are cut inside the kernel.
    """
    if blocks < 1 or n % blocks:
        raise ValueError(f"{blocks} blocks don't divide a series of {n}")
    m, names, other = n // blocks, list(columns), imaginary or {}
    bounds = [b * m // blocks for b in range(blocks + 1)]

    def inner(key, pdf):
        r = int(key[0])
        pdf = pdf.sort_values(t, kind="stable")
        if len(pdf) != m or not np.array_equal(pdf[t].to_numpy(), np.arange(m) * blocks + r):
            raise ValueError(f"remainder {r} must hold each of its {m} time indices once")
        turn = np.exp(-2j * np.pi * r * np.arange(m) / n)
        out = []
        for i, c in enumerate(names):
            x = pdf[c].to_numpy(float)
            if c in other:
                x = x + 1j * pdf[other[c]].to_numpy(float)
            z = np.fft.fft(x) * turn
            out += [(b, r, i, z[bounds[b] : bounds[b + 1]].real, z[bounds[b] : bounds[b + 1]].imag) for b in range(blocks)]
        return pd.DataFrame(out, columns=["b", "r", "c", "re", "im"])

    def outer(key, pdf):
        b = int(key[0])
        j = np.arange(bounds[b], bounds[b + 1])
        k = (np.arange(blocks)[:, None] * m + j).ravel()
        keep = (k >= 1) & (k <= (n - 1) // 2) if positive else np.ones(len(k), bool)
        out = {"k": k[keep]}
        for i, c in enumerate(names):
            part = pdf[pdf["c"] == i].sort_values("r", kind="stable")
            if not np.array_equal(part["r"].to_numpy(), np.arange(blocks)):
                raise ValueError(f"block {b} must get one piece from each of {blocks} remainders")
            z = np.fft.fft(np.stack([a + 1j * e for a, e in zip(part["re"], part["im"], strict=True)]), axis=0).ravel()[keep]
            out[f"re_{c}"], out[f"im_{c}"] = z.real, z.imag
        return pd.DataFrame(out)

    rows = series.select(F.pmod(F.col(t), F.lit(blocks)).cast("int").alias("r"), F.col(t).cast("long").alias(t), *{*names, *other.values()})
    # An id for each partition: else small groups end up in one task.
    pieces = rows.repartitionById(blocks, "r").groupBy("r").applyInPandas(inner, "b int, r int, c int, re array<double>, im array<double>")
    schema = "k long, " + ", ".join(f"re_{c} double, im_{c} double" for c in names)
    found = pieces.repartitionById(blocks, "b").groupBy("b").applyInPandas(outer, schema)
    return found


def chirp_fft(series: DataFrame, n: int, blocks: int, columns: Sequence[str] = ("y",), t: str = "t") -> DataFrame:
    """The same as fft for real columns of any length, prime ones too: (k, re_<column>, im_<column>) for 0 < k < n/2.

    With jk = (j^2 + k^2 - (k - j)^2) / 2 a transform is a convolution with a
    chirp, done on a power of two of at least 2n - 1 points by two transforms:
    one of the columns and the chirp together, one back. Squares are reduced
    modulo 2n as integers, so that angles stay exact.
    """
    size = 1 << (2 * n - 2).bit_length()
    spark = series.sparkSession

    def angle(i):
        return F.pmod(i * i, F.lit(2 * n)) * F.lit(np.pi / n)

    i = F.col("t")
    near = F.when(i < n, i).when(i > size - n, F.lit(size) - i)
    held = series.select(F.col(t).cast("long").alias("t"), *[F.col(c).cast("double").alias(f"v{m}") for m, c in enumerate(columns)], F.lit(1).alias("own"))
    grid = spark.range(size).select(F.col("id").alias("t")).join(held, "t", "left")
    known = F.when(F.col("own").isNotNull() | (i >= n), True).otherwise(F.raise_error(F.concat(F.lit("the series lacks time index "), i)).cast("boolean"))
    parts, imaginary = [F.coalesce(F.cos(angle(near)), F.lit(0.0)).alias("c"), F.coalesce(F.sin(angle(near)), F.lit(0.0)).alias("ci")], {"c": "ci"}
    for m in range(len(columns)):
        v = F.when(i < n, F.col(f"v{m}")).otherwise(0.0)
        turn = F.when(i < n, angle(i)).otherwise(0.0)
        parts += [(v * F.cos(turn)).alias(f"a{m}"), (-v * F.sin(turn)).alias(f"ai{m}")]
        imaginary[f"a{m}"] = f"ai{m}"
    both = fft(grid.filter(known).select("t", *parts), size, blocks, ["c", *[f"a{m}" for m in range(len(columns))]], "t", imaginary, positive=False)
    # The conjugate of the product; its transform is the conjugate of the inverse's.
    product, back = [F.col("k").alias("t")], {}
    for m in range(len(columns)):
        re = F.col("re_c") * F.col(f"re_a{m}") - F.col("im_c") * F.col(f"im_a{m}")
        im = F.col("re_c") * F.col(f"im_a{m}") + F.col("im_c") * F.col(f"re_a{m}")
        product += [re.alias(f"p{m}"), (-im).alias(f"pi{m}")]
        back[f"p{m}"] = f"pi{m}"
    found = fft(both.select(*product), size, blocks, list(back), "t", back, positive=False).filter((F.col("k") > 0) & (F.col("k") <= (n - 1) // 2))
    cos, sin = F.cos(angle(F.col("k"))), F.sin(angle(F.col("k")))
    out = ["k"]
    for m, c in enumerate(columns):
        re, im = F.col(f"re_p{m}") / size, -F.col(f"im_p{m}") / size
        out += [(re * cos + im * sin).alias(f"re_{c}"), (im * cos - re * sin).alias(f"im_{c}")]
    return found.select(*out)


def transform(series: DataFrame, n: int, columns: Sequence[str] = ("y",), t: str = "t", most_blocks: int = 4096, block_rows: int = 1 << 16, task_rows: int = 1 << 22) -> DataFrame:
    """fft with as many blocks as the length asks for: about block_rows rows each, any divisor of n.

    Where no divisor keeps a task below task_rows rows, the chirp transform does.
    """
    wanted = min(most_blocks, max(1, -(-n // block_rows)))
    if n <= task_rows:
        wanted = min(n, max(16, wanted))
    blocks = divisor_blocks(n, wanted)
    if n // blocks <= task_rows:
        return fft(series, n, blocks, columns, t)
    return chirp_fft(series, n, 1 << (wanted - 1).bit_length(), columns, t)


def periodogram(spectrum: DataFrame, n: int, column: str = "y") -> DataFrame:
    """k, omega, q, periodogram, re, im: |X|^2 / (2 pi n), no mean taken off."""
    re, im = F.col(f"re_{column}"), F.col(f"im_{column}")
    omega = F.col("k") * F.lit(TWO_PI / n)
    return spectrum.select("k", omega.alias("omega"), half_angle(omega).alias("q"), ((re * re + im * im) / F.lit(TWO_PI * n)).alias("periodogram"), re.alias("re"), im.alias("im"))


def positive_frequencies(n: int) -> int:
    return (n - 1) // 2


def systematic(df: DataFrame, shards: int, k: str = "k") -> DataFrame:
    """Every shards-th frequency to a shard: (k - 1) mod shards."""
    return df.withColumn("shard_id", F.pmod(F.col(k) - 1, F.lit(shards)).cast("int"))


def sequential(df: DataFrame, shards: int, total: int, k: str = "k") -> DataFrame:
    """Runs of frequencies 1..total as even as can be, the first ones longer: ntile by arithmetic, without a sort."""
    size, longer = divmod(total, shards)
    i = F.col(k) - 1
    late = F.floor((i - longer * (size + 1)) / max(1, size)) + longer
    return df.withColumn("shard_id", F.when(i < longer * (size + 1), F.floor(i / (size + 1))).otherwise(late).cast("int"))


def random_groups(df: DataFrame, shards: int, seed: int = 0, key: str = "k") -> DataFrame:
    """A seeded group for each row, by a hash of its key: reruns agree whatever the partitioning."""
    return df.withColumn("shard_id", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(shards)).cast("int"))


def shard_completeness(df: DataFrame, shards: int, total: int) -> DataFrame:
    """For each shard of a systematic partition: rows held and due, its ends, and whether it is complete.

    A complete shard holds each of its frequencies once, from its first to its
    last, with finite positive ordinates if there is a periodogram.
    """
    power = F.col("periodogram") if "periodogram" in df.columns else F.lit(1.0)
    usable = F.coalesce((power > 0) & (power < float("inf")), F.lit(False))  # NaN is above infinity
    held = df.groupBy("shard_id").agg(F.count(F.lit(1)).alias("held"), F.countDistinct("k").alias("distinct_k"), F.min("k").alias("first_k"), F.max("k").alias("last_k"), F.bool_and(usable).alias("usable"))
    due = df.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard_id")).withColumn("due", F.floor((F.lit(total - 1) - F.col("shard_id")) / shards) + 1)
    joined = due.join(held, "shard_id", "left").fillna(0, ["held", "distinct_k"])
    whole = (F.col("held") == F.col("due")) & (F.col("distinct_k") == F.col("due"))
    ends = (F.col("due") == 0) | ((F.col("first_k") == F.col("shard_id") + 1) & (F.col("last_k") == F.col("shard_id") + 1 + (F.col("due") - 1) * shards) & F.col("usable"))
    return joined.withColumn("complete", F.coalesce(whole & ends, F.lit(False)))


def residual_periodogram(spectrum: DataFrame, n: int, beta: Sequence[float], covariates: Sequence[str], column: str = "y") -> DataFrame:
    """Periodogram of y - X beta, from their joint spectrum."""
    re, im = F.col(f"re_{column}"), F.col(f"im_{column}")
    for b, x in zip(beta, covariates, strict=True):
        re, im = re - b * F.col(f"re_{x}"), im - b * F.col(f"im_{x}")
    omega = F.col("k") * F.lit(TWO_PI / n)
    return spectrum.select("k", omega.alias("omega"), half_angle(omega).alias("q"), ((re * re + im * im) / F.lit(TWO_PI * n)).alias("periodogram"))


def time_segments(series: DataFrame, n: int, segments: int, columns: Sequence[str] = ("y",), t: str = "t") -> DataFrame:
    """Consecutive segments as even as can be, each with its own periodogram: shard_id, k, omega, q, periodogram, n."""
    cut = [i * (n // segments) + min(i, n % segments) for i in range(segments + 1)]
    y = columns[0]

    def local(key, pdf):
        x = pdf.sort_values(t, kind="stable")[y].to_numpy(float)
        k = np.arange(1, (len(x) - 1) // 2 + 1)
        w = 2 * np.pi * k / len(x)
        power = np.abs(np.fft.rfft(x)[k]) ** 2 / (2 * np.pi * len(x))
        return pd.DataFrame({"shard_id": np.int32(key[0]), "k": k, "omega": w, "q": 4 * np.sin(w / 2) ** 2, "periodogram": power, "n": len(x)})

    size, longer = divmod(n, segments)
    i = F.col(t)
    of = F.when(i < longer * (size + 1), F.floor(i / (size + 1))).otherwise(F.floor((i - cut[longer]) / max(1, size)) + longer)
    return series.select(of.cast("int").alias("shard_id"), t, y).repartitionById(segments, "shard_id").groupBy("shard_id").applyInPandas(local, "shard_id int, k long, omega double, q double, periodogram double, n long")


def autocorrelation(series: DataFrame, lags: int, y: str = "y", t: str = "t", block_rows: int = 1 << 16) -> DataFrame:
    """(lag, acf): products within blocks of the index, each with a halo of the `lags` rows before it.

    One exchange of little more than the series; an index that is missing adds
    nothing to any lag.
    """
    m = series.agg(F.avg(y).alias("m"), F.sum((F.col(y) * F.col(y))).alias("s2"), F.count(y).alias("n")).first()
    mean, total = float(m["m"]), float(m["s2"]) - int(m["n"]) * float(m["m"]) ** 2
    size = max(block_rows, lags + 1)
    at, place = F.floor(F.col(t) / size), F.pmod(F.col(t), F.lit(size))
    own, halo = F.struct(at.alias("b"), place.alias("i")), F.struct((at + 1).alias("b"), (place - size).alias("i"))
    to = F.when(place >= size - lags, F.array(own, halo)).otherwise(F.array(own))
    rows = series.filter(F.col(y).isNotNull()).select(F.explode(to).alias("to"), (F.col(y) - mean).alias("v")).select("to.b", "to.i", "v")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(lags + size)
        x[pdf["i"].to_numpy() + lags] = pdf["v"].to_numpy()
        return pd.DataFrame({"lag": np.arange(lags + 1), "s": [float(x[lags:] @ x[lags - j : len(x) - j]) for j in range(lags + 1)]})

    return rows.groupBy("b").applyInPandas(run, "lag int, s double").groupBy("lag").agg((F.sum("s") / total).alias("acf"))


def lagged(series: DataFrame, lags: int, y: str = "y", order: str = "t", keys: Sequence[str] = ()) -> DataFrame:
    """Columns <y>_1..<y>_lags of earlier values within each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return series.withColumns({f"{y}_{j}": F.lag(y, j).over(w) for j in range(1, lags + 1)})
