import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabrook.functions.columns import coefficients, spectral_density, whittle_term
from spectrabrook.operators import spectrum, timeindex
from spectrabrook.sources import series


def frame(spark, x, name="y"):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], f"t long, {name} double")


@pytest.mark.parametrize("n,blocks", [(64, 1), (256, 4), (1024, 8), (1024, 128), (360, 6)])
def test_fft_equals_numpy(spark, n, blocks):
    x = np.random.default_rng(20260804 + n + blocks).normal(size=n)
    got = spectrum.fft(frame(spark, x).orderBy(F.rand(3)), n, blocks, positive=False).toPandas().sort_values("k")
    want = np.fft.fft(x)
    assert got["k"].tolist() == list(range(n))
    np.testing.assert_allclose(got["re_y"] + 1j * got["im_y"], want, rtol=1e-11, atol=1e-11)


def test_fft_complex_and_columns(spark):
    rng = np.random.default_rng(271828)
    n, re, im, w = 2048, *rng.normal(size=(3, 2048))
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(re, im, w, strict=True))], "t long, re double, im double, w double")
    got = spectrum.fft(df, n, 8, ["re", "w"], imaginary={"re": "im"}, positive=False).toPandas().sort_values("k")
    np.testing.assert_allclose(got["re_re"] + 1j * got["im_re"], np.fft.fft(re + 1j * im), rtol=1e-11, atol=1e-11)
    np.testing.assert_allclose(got["re_w"] + 1j * got["im_w"], np.fft.fft(w), rtol=1e-11, atol=1e-11)


@pytest.mark.parametrize("bad", [[0, 1, 2, 2], [0, 1, 2, 4], [0, 1, 2]])
def test_fft_refuses_broken_indices(spark, bad):
    df = spark.createDataFrame([(i, 1.0) for i in bad], "t long, y double")
    with pytest.raises(Exception, match="time indices|pieces|piece"):
        spectrum.fft(df, 4, 2).collect()
    with pytest.raises(ValueError):
        spectrum.fft(df, 6, 4)


def test_direct_dft_and_energy(spark):
    x = np.random.default_rng(1).normal(size=180)
    a = spectrum.direct_dft(frame(spark, x), 180).toPandas().sort_values("k")
    b = spectrum.fft(frame(spark, x), 180, 4).toPandas().sort_values("k")
    np.testing.assert_allclose(a[["re_y", "im_y"]], b[["re_y", "im_y"]], atol=1e-9)


def test_shards_partition_frequencies_and_likelihoods_add_up(spark):
    n, g = 360, 7
    x = np.random.default_rng(2).normal(size=n)
    p = spectrum.periodogram(spectrum.fft(frame(spark, x), n, 8), n).cache()
    total = spectrum.positive_frequencies(n)
    term = whittle_term(F.col("periodogram"), spectral_density(F.col("omega"), phi=coefficients([0.4, -0.2]), theta=[0.3], sigma2=1.3, d=0.2, lam=0.1))
    whole = p.agg(F.sum(term)).first()[0]
    for cut in (spectrum.systematic(p, g), spectrum.sequential(p, g, total), spectrum.random_groups(p, g)):
        parts = cut.groupBy("shard_id").agg(F.sum(term).alias("l"), F.count(F.lit(1)).alias("n")).collect()
        assert sum(r["l"] for r in parts) == pytest.approx(whole, rel=1e-12) and sum(r["n"] for r in parts) == total
    split = {r["k"]: r["shard_id"] for r in spectrum.sequential(p, g, total).collect()}
    want = [s for s, part in enumerate(np.array_split(np.arange(1, total + 1), g)) for _ in part]
    assert [split[k] for k in range(1, total + 1)] == want
    assert spectrum.shard_completeness(spectrum.systematic(p, g), g, total).filter("not complete").isEmpty()
    assert spectrum.shard_completeness(spectrum.systematic(p.filter("k <> 9"), g), g, total).filter("not complete").count() == 1


def test_residual_periodogram_identity(spark):
    rng = np.random.default_rng(71)
    x, e = rng.normal(size=(2, 64))
    df = spark.createDataFrame([(i, float(0.7 * a + b), float(a)) for i, (a, b) in enumerate(zip(x, e, strict=True))], "t long, y double, x1 double")
    got = spectrum.residual_periodogram(spectrum.fft(df, 64, 4, ["y", "x1"]), 64, [0.7], ["x1"]).toPandas().sort_values("k")
    np.testing.assert_allclose(got["periodogram"], np.abs(np.fft.fft(e)[1:32]) ** 2 / (2 * np.pi * 64), rtol=1e-9)


def test_time_segments(spark):
    x = np.random.default_rng(3).normal(size=100)
    got = spectrum.time_segments(frame(spark, x), 100, 3).toPandas()
    for s, part in enumerate(np.array_split(x, 3)):
        mine = got[got["shard_id"] == s].sort_values("k")
        k = np.arange(1, (len(part) - 1) // 2 + 1)
        np.testing.assert_allclose(mine["periodogram"], np.abs(np.fft.fft(part)[k]) ** 2 / (2 * np.pi * len(part)), rtol=1e-9)


def test_time_validation_and_trimming(spark):
    ok = spark.createDataFrame([(t, t * t / 10) for t in reversed(range(18))], "time long, value double")
    n, _, _ = timeindex.validate_time(ok)
    got, kept = timeindex.trim(timeindex.dense_index(ok), n, 4)
    assert kept == 16 and [r["value"] for r in got.orderBy("t").collect()] == [t * t / 10 for t in range(2, 18)]
    got, kept = timeindex.trim(timeindex.dense_index(ok), n, 4, "oldest")
    assert [r["time"] for r in got.orderBy("t").collect()] == list(range(16))
    for times, message in (((0, 1, 1, 2), "unique"), ((0, 1, 3, 4), "regularly spaced"), ((0,), "unique")):
        with pytest.raises(ValueError, match=message):
            timeindex.validate_time(spark.createDataFrame([(float(t), 0.0) for t in times], "time double, value double"))
    with pytest.raises(ValueError, match="missing"):
        timeindex.require_columns(ok, "nothing")
    for v in (None, float("nan"), float("inf")):
        with pytest.raises(ValueError, match="finite"):
            timeindex.require_finite(spark.createDataFrame([(v,), (1.0,)], "y double"), "y")
    assert [timeindex.fft_blocks(n, 256) for n in (720, 7, 1 << 20, 2)] == [16, 1, 256, 2]


def test_sources(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.arange(5.0))
    assert [r["y"] for r in series.load_array(spark, str(tmp_path / "a.npy")).orderBy("t").collect()] == list(range(5))
    (tmp_path / "a.csv").write_text("time,x,y\n3,1,9\n1,2,8\n2,3,7\n")
    assert [r["y"] for r in series.load_table(spark, str(tmp_path / "a.csv"), time="time").orderBy("t").collect()] == [8, 7, 9]
    assert series.load_regression(spark, str(tmp_path / "a.csv")).columns == ["t", "y", "x1"]
    df, truth = series.simulate_regression(spark, 64, 0.7, (0.4, -0.6), 1.0, seed=5)
    again, _ = series.simulate_regression(spark, 64, 0.7, (0.4, -0.6), 1.0, seed=5)
    assert df.exceptAll(again).isEmpty() and '"beta": 0.7' in truth
    with pytest.raises(ValueError):
        series.simulate_regression(spark, 64, 0.7, (1.1, 0.0), 1.0)
    assert series.stationary([1.942, -0.943]) and not series.stationary([0.5, 0.6])


def test_streaming_ingest(spark, tmp_path):
    from spectrabrook.streaming import ingest

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = ingest.append_series(ingest.hourly_stream(stream), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    last = src.agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    want = src.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour")).count()
    assert got.count() == got.select("hour").distinct().count() and last is not None
    assert got.join(want, "hour").filter("y <> count").isEmpty() and got.count() > 0


@pytest.mark.parametrize("n", [719, 101, 64, 7])
def test_chirp_transform_equals_numpy(spark, n):
    rng = np.random.default_rng(n)
    y, x = rng.normal(size=n), rng.normal(size=n)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))], "t long, y double, x double")
    got = spectrum.chirp_fft(df, n, 8, ["y", "x"]).toPandas().sort_values("k")
    k = np.arange(1, (n - 1) // 2 + 1)
    assert got["k"].tolist() == k.tolist()
    for c, v in (("y", y), ("x", x)):
        want = np.fft.fft(v)[k]
        np.testing.assert_allclose(got[f"re_{c}"], want.real, rtol=1e-9, atol=1e-10)
        np.testing.assert_allclose(got[f"im_{c}"], want.imag, rtol=1e-9, atol=1e-10)
    with pytest.raises(Exception, match="lacks time index"):
        spectrum.chirp_fft(df.filter("t <> 3"), n, 8).collect()


def test_transform_picks_blocks_or_the_chirp(spark):
    for n in (719, 720, 1000):
        y = np.random.default_rng(n).normal(size=n)
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double")
        want = np.fft.fft(y)[1 : (n - 1) // 2 + 1]
        for rows in (1 << 22, 100):
            got = spectrum.transform(df, n, block_rows=50, task_rows=rows).toPandas().sort_values("k")
            np.testing.assert_allclose(got["re_y"] + 1j * got["im_y"], want, rtol=1e-8, atol=1e-9)
    assert [timeindex.divisor_blocks(n, 256) for n in (720, 7, 719, 1 << 20)] == [240, 7, 1, 256]


def test_autocorrelation_across_blocks_and_gaps(spark):
    y = np.random.default_rng(2).normal(size=500)
    here = np.delete(np.arange(500), [3, 99, 100, 250])
    df = spark.createDataFrame([(int(i), float(y[i])) for i in here], "t long, y double")
    got = {r["lag"]: r["acf"] for r in spectrum.autocorrelation(df, 12, block_rows=40).collect()}
    v = np.zeros(500)
    v[here] = y[here] - y[here].mean()
    assert got == pytest.approx({j: float(v[j:] @ v[: 500 - j]) / float(v @ v) for j in range(13)})
