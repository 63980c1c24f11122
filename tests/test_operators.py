import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabrook.functions.model import Settings, Spec
from spectrabrook.operators import combine, diagnose, panel, scores, spectrum
from spectrabrook.plans import forecast, inference
from spectrabrook.sources import series, sinks


def draws_frame(spark, sets):
    rows = [(g, i, [float(v) for v in x]) for g, s in enumerate(sets) for i, x in enumerate(s)]
    return spark.createDataFrame(rows, "shard_id int, draw long, theta array<double>")


def test_consensus_weights_precision(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(400, 1)), rng.normal(size=(300, 1))
    a, b = a / a.std(ddof=1), 2 * b / b.std(ddof=1)
    got = combine.consensus(draws_frame(spark, [a, b]), 1, ridge=0.0).orderBy("draw").collect()
    assert len(got) == 300
    np.testing.assert_allclose([r["theta"][0] for r in got], (0.8 * a[:300] + 0.2 * b)[:, 0], rtol=1e-9)
    mean = combine.simple_average(draws_frame(spark, [a, b]), 1).orderBy("draw").collect()
    np.testing.assert_allclose([r["theta"][0] for r in mean], (a[:300, 0] + b[:, 0]) / 2)
    with pytest.raises(ValueError):
        combine.consensus_weights([np.array([[1.0, 0.5], [0.4, 1.0]])])
    with pytest.raises(np.linalg.LinAlgError):
        combine.consensus_weights([-np.eye(2)])


def test_combiners_recover_a_gaussian_product(spark):
    rng = np.random.default_rng(1)
    sets = [rng.multivariate_normal([m, 0], np.diag([1.0, 0.5]), 300) for m in (-0.2, 0.0, 0.2)]
    df = draws_frame(spark, sets)
    mean, cov, sample = combine.parametric_product(df, 2, 100)
    assert np.abs(mean).max() < 0.15 and np.allclose(cov, np.diag([1 / 3, 1 / 6]), atol=0.06) and sample.shape == (100, 2)
    for semi in (False, True):
        got = np.stack([r["theta"] for r in combine.kernel_product(df, 2, 400, semi=semi).collect()])
        assert np.abs(got.mean(0)).max() < 0.35 and got.std(0)[0] < 1.0
    with_p = df.withColumn("log_p", -0.5 * (F.pow(F.col("theta")[0], 2) + 2 * F.pow(F.col("theta")[1], 2)))
    got = combine.surrogate_importance(with_p, 2, 500).collect()
    x = np.stack([r["theta"] for r in got])
    np.testing.assert_allclose(x.var(0), [1 / 3, 1 / 6], rtol=0.35)
    assert got[0]["ess"] > 100


def test_thinning_keeps_even_picks(spark):
    got = combine.thinned(draws_frame(spark, [np.arange(100)[:, None], np.arange(31)[:, None]])).toPandas()
    for g, n in ((0, 100), (1, 31)):
        mine = got[got["shard_id"] == g].sort_values("draw")
        want = (np.arange(31) * (n - 1)) // 30
        assert [t[0] for t in mine["theta"]] == want.tolist()


def test_distances_and_gate(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 2))
    a, b = (diagnose.long_draws(draws_frame(spark, [v]), 2) for v in (x, x + 0.5))
    got = diagnose.quantile_distance(a, b, normalise=False).collect()
    assert all(r["w1"] == pytest.approx(0.5) for r in got)
    assert all(r["w1"] == pytest.approx(0.5 * 98 / 100) for r in diagnose.percentile_distance(a, b).collect())
    gate = diagnose.accuracy_gate(diagnose.summary(a, "parameter"), diagnose.summary(b, "parameter")).collect()
    assert not any(r["passed"] for r in gate)
    same = diagnose.accuracy_gate(diagnose.summary(a, "parameter"), diagnose.summary(a, "parameter")).collect()
    assert all(r["passed"] for r in same)


def day_panel(spark, values):
    """values: day -> {second: spread}"""
    rows = [(d, "am" if s < 7200 else "pm", s, v) for d, m in values.items() for s, v in m.items()]
    return spark.createDataFrame(rows, "day_index int, phase string, second int, spread double")


def test_changes_never_cross_lunch(spark):
    p = day_panel(spark, {0: {7198: 1.0, 7199: 2.0, 7200: 8.0, 7201: 4.0, 7204: 2.0}, 1: {0: 1.0}})
    inside = {(r["day_index"], r["second"]): r["change"] for r in panel.changes(p).collect() if r["change"] is not None}
    assert set(inside) == {(0, 7199), (0, 7201)} and inside[0, 7201] == pytest.approx(np.log(0.5))
    kinds = {(r["day_index"], r["second"]): r["boundary"] for r in panel.observed_changes(p).collect()}
    assert kinds == {(0, 7198): "start", (0, 7199): "none", (0, 7200): "lunch", (0, 7201): "none", (0, 7204): "gap", (1, 0): "date"}
    assert sorted((r["start"], r["stop"], r["n"]) for r in panel.runs(p).filter("day_index = 0").collect()) == [(7198, 7200, 2), (7200, 7202, 2), (7204, 7205, 1)]


def test_plan_rules(spark):
    days = {d: {s: 1.0 + s % 3 for s in range(14220)} for d in range(2)}
    del days[1][7200 + 60 + 10]  # a target of 13:01, and history of 13:05
    p = day_panel(spark, days)
    daily = spark.createDataFrame([(0, 10_000_001), (1, 19)], "day_index int, changes long")
    tasks = panel.rolling_plan(p, daily, 10_000_000)
    rows = tasks.collect()
    assert len(rows) == 28 and {r["status"] for r in rows if r["day_index"] == 0} == {"short_training"}
    second = {(r["origin"], r["horizon"]): r for r in rows if r["day_index"] == 1}
    assert second["13:01", 60]["status"] == "missing_target" and second["13:01", 60]["issued"]
    assert second["13:05", 60]["status"] == "missing_history" and not second["13:05", 60]["issued"]
    assert second["09:31", 300]["status"] == "scorable" and second["09:31", 60]["context_levels"] == 60
    assert second["11:25", 300]["context_levels"] == 600 and ("11:29", 300) not in second and ("14:56", 300) not in second
    assert {r["train_fft_observations"] for r in second.values()} == {10_000_000}
    assert panel.last_days(tasks, 1).select("day_index").distinct().collect() == [(1,)]
    with pytest.raises(ValueError):
        panel.last_days(tasks, 2)


def test_calibration_sees_earlier_days_only(spark):
    rng = np.random.default_rng(0)
    days = {d: {s: float(np.exp(rng.normal())) for s in [*range(40), *range(7200, 7240)]} for d in range(6)}
    a = panel.calibration(day_panel(spark, {d: v for d, v in days.items() if d < 5})).toPandas().sort_values(["phase", "second"])
    found, n, sd = forecast.history_spectrum(day_panel(spark, days), 5)
    x = np.array([[np.log(days[d][s]) - np.log(days[d][s - 1]) for s in [*range(1, 40), *range(7201, 7240)]] for d in range(5)])
    np.testing.assert_allclose(a["mean"], x.mean(0), rtol=1e-9)
    for i in (0, 1):
        part = x[:, 39 * i : 39 * (i + 1)]
        floor = max(1e-6, 0.05 * np.median(part.std(0)))
        np.testing.assert_allclose(a["scale"][39 * i : 39 * (i + 1)], np.maximum(part.std(0), floor), rtol=1e-9)
    z = ((x - x.mean(0)) / np.array(a["scale"])).ravel()
    z = z[len(z) % 2 :]
    assert n == len(z)
    k = np.arange(1, n // 2)
    got = found.toPandas().sort_values("k")
    np.testing.assert_allclose(got["periodogram"], np.abs(np.fft.fft(z / sd)[k]) ** 2 / (2 * np.pi * n), rtol=1e-6, atol=1e-12)


def test_scores(spark):
    rows = [(2.4, 2.5, [4.0, 1.0, 3.0, 2.0]), (None, 2.5, [4.0, 1.0, 3.0, 2.0])]
    got = scores.score_samples(spark.createDataFrame(rows, "actual double, prediction double, draws array<double>")).collect()
    d = np.array([1.0, 2, 3, 4])
    want = np.abs(d - 2.4).mean() - np.abs(d[:, None] - d).mean() / 2
    assert got[0]["crps"] == pytest.approx(want) and got[0]["lower80"] == pytest.approx(np.quantile(d, 0.1)) and got[0]["cover95"] == 1
    assert got[1]["crps"] is None and got[1]["se"] is None and got[1]["upper95"] == pytest.approx(np.quantile(d, 0.975))


def test_bootstrap_of_a_fixed_ratio_is_exact(spark):
    rng = np.random.default_rng(0)
    rows = []
    for day in range(915, 995):
        for origin in ("09:31", "09:35"):
            if day < 930 and origin == "09:31":
                continue
            for h in (60, 300):
                e = float(rng.normal())
                rows += [(day, origin, h, "new", (0.8 * e) ** 2), (day, origin, h, "old", e * e)]
    f = spark.createDataFrame(rows, "day_index int, origin string, horizon int, model string, se double")
    got = scores.paired_gains(scores.cluster_sums(scores.paired(f, ["new", "old"]), "new", "old"), 300).collect()
    assert len(got) == 6 and {r["origin"] for r in got} == {"09:31", "09:35", "Pooled"}
    for r in got:
        assert (r["rmse_reduction_pct"], r["lower_pct"], r["upper_pct"]) == pytest.approx((20, 20, 20)) and r["excludes_zero"]
    w = scores.moving_block_weights(spark, 33, 5, 50, 0).toPandas()
    assert (w.groupby("replicate")["w"].sum() == 33).all() and w["day"].between(0, 32).all() and w["replicate"].nunique() == 50


def test_scattered_draws_look_uniform_and_independent(spark):
    """Multiplicities of 12 units over many replicates have a multinomial's mean, variance and covariance."""
    units = spark.createDataFrame([(i, i) for i in range(12)], "place long, unit long")
    w = scores.bootstrap_weights(units, "unit", 12, 4000, 20261014).toPandas().pivot(index="replicate", columns="unit", values="w").reindex(index=range(4000), columns=range(12)).fillna(0).to_numpy()
    assert (w.sum(1) == 12).all()
    np.testing.assert_allclose(w.mean(0), 1, atol=0.08)
    np.testing.assert_allclose(w.var(0), 11 / 12, atol=0.1)
    c = np.corrcoef(w.T)[np.triu_indices(12, 1)]
    np.testing.assert_allclose(c, -1 / 11, atol=0.08)


def test_one_to_one_refuses_differences(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, actual double")
    assert scores.one_to_one(a, a, ["k"]).count() == 2
    for other in ([(1, 1.0)], [(1, 1.0), (2, 3.0)], [(1, 1.0), (2, 2.0), (2, 2.0)]):
        with pytest.raises(ValueError):
            scores.one_to_one(a, spark.createDataFrame(other, "k int, actual double"), ["k"])


def ar1(n, phi, seed=0):
    e = np.random.default_rng(seed).normal(size=n)
    x = np.zeros(n)
    for i in range(1, n):
        x[i] = phi * x[i - 1] + e[i]
    return x


def test_divide_and_conquer_recovers_ar1(spark):
    n = 2048
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(ar1(n, 0.6))], "t long, y double")
    settings = Settings(draws=600, burn=200, chains=1, seed=5)
    for part in ("systematic", "sequential"):
        got = inference.fit_frequency_shards(df, n, Spec(1), 4, settings, part, full=part == "systematic")
        shards = inference.shard_summary(got.shards).collect()
        assert len(shards) == 4 and all(r["proper"] and r["newton_distance"] <= 0.01 for r in shards)
        theta = np.stack([r["theta"] for r in got.consensus.collect()])
        assert abs(theta[:, 0].mean() - 0.6) < 0.08 and abs(theta[:, 1].mean()) < 0.15
    gate = inference.gates(inference.fit_frequency_shards(df, n, Spec(1), 4, settings, full=True), Spec(1)).collect()
    assert all(0.6 < r["sd_ratio"] < 1.6 for r in gate)
    again = inference.sample_shards(spectrum.systematic(spectrum.periodogram(spectrum.fft(df, n, 8), n), 4), Spec(1), 4, settings)
    other = inference.sample_shards(spectrum.systematic(spectrum.periodogram(spectrum.fft(df.repartition(5), n, 8), n), 4), Spec(1), 4, settings)
    assert again.select("shard_id", "draw", "theta").exceptAll(other.select("shard_id", "draw", "theta")).isEmpty()
    seg = inference.fit_time_segments(df, n, Spec(1), 4, settings)
    assert abs(np.mean([r["theta"][0] for r in seg.average.collect()]) - 0.6) < 0.1
    mean = inference.fit_frequency_shards(df, n, Spec(1, mean=True), 2, Settings(draws=50, burn=20))
    assert len(mean.consensus.first()["theta"]) == 3


def test_regression_recovers_beta(spark):
    df, _ = series.simulate_regression(spark, 1024, 0.7, (0.4, -0.6), 1.0, seed=20260802)
    got = inference.fit_regression_shards(df, 1024, Spec(2, covariates=1), ["x1"], 4, Settings(draws=400, burn=200, seed=2))
    theta = np.stack([r["theta"] for r in got.consensus.collect()])
    out = Spec(2, covariates=1).transformed(theta).mean(0)
    np.testing.assert_allclose(out, [0.4, -0.6, 0.7, 1.0], atol=0.12)


def test_blocks_go_on_where_they_stopped(spark):
    n = 512
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(ar1(n, 0.3))], "t long, y double")
    rows = spectrum.systematic(spectrum.periodogram(spectrum.fft(df, n, 8), n), 2).withColumn("history_id", F.lit(7))
    one = inference.sample_blocks(rows, Spec(1), 2, Settings(seed=4), goal=1e9, block=100, most=200)
    two = inference.sample_blocks(rows, Spec(1), 2, Settings(seed=4), goal=1e9, block=100, most=400, state=one)
    whole = inference.sample_blocks(rows, Spec(1), 2, Settings(seed=4), goal=1e9, block=100, most=400)
    get = lambda t: {r["shard_id"]: np.array(r["draws"]) for r in t.collect()}
    a, b = get(two), get(whole)
    assert all(np.array_equal(a[g], b[g]) and len(a[g]) == 400 for g in (0, 1))


def test_sinks(spark, tmp_path):
    d = draws_frame(spark, [np.zeros((3, 1))] * 2)
    assert sinks.complete_shards(d, 2).count() == 6
    with pytest.raises(ValueError):
        sinks.complete_shards(d, 3)
    path = str(tmp_path / "done")
    work = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert sinks.unfinished(work, path, "k").count() == 3
    sinks.write_table(work.filter("k < 3"), path)
    assert [r["k"] for r in sinks.unfinished(work, path, "k").collect()] == [3]
    sinks.write_manifest(spark, str(tmp_path / "m"), {"rows": 2})
    assert sinks.read_manifest(spark, str(tmp_path / "m")) == json.loads('{"rows": 2}')
    sinks.append_summary(work, str(tmp_path / "s"), method="a")
    sinks.append_summary(work, str(tmp_path / "s"), method="b")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 6


def test_kernel_product_draws_from_all_draws(spark, tmp_path):
    from spectrabrook.plans import queries

    rng = np.random.default_rng(8)
    rows = [(i, f"type{i % 2}", float((1.0 if i < 700 else 3.0) + 0.1 * rng.normal())) for i in range(8000)]
    spark.createDataFrame(rows, "event_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = np.stack([r["theta"] for r in queries.kernel_product_draws(spark, str(tmp_path)).collect()])
    assert got.shape == (200, 2) and np.median(got[:, 0]) > 2


def test_surrogate_uses_all_draws(spark):
    rng = np.random.default_rng(9)
    sets = [np.where(np.arange(199)[:, None] % 2 == 0, 3 + 0.05 * rng.normal(size=(199, 1)), rng.normal(size=(199, 1))) for _ in range(2)]
    df = draws_frame(spark, sets).withColumn("log_p", -0.5 * F.pow(F.col("theta")[0], 2))
    got = [r["theta"][0] for r in combine.surrogate_importance(df, 1, 500, most=100).collect()]
    assert abs(np.mean(got)) < 1



def test_event_draws_lose_no_type(spark):
    df = spark.createDataFrame([(1, "b", 1.0), (2, None, 2.0), (3, "a", 3.0)], "event_id long, event_type string, value double")
    assert sorted(r["theta"][0] for r in series.event_draws(df).collect()) == [1.0, 2.0, 3.0]
    with pytest.raises(ValueError):
        series.event_draws(df, most=2)


def test_a_zero_has_an_infinite_logarithm_and_no_consensus(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i // 2)) for i in range(20)], "event_id long, event_type string, value double")
    draws = series.event_draws(df)
    assert sorted(r["theta"][1] for r in draws.collect())[:3] == [-np.inf, -np.inf, 0.0]
    got = combine.consensus(draws, 2, undefined="nan").collect()
    assert len(got) == 10 and all(np.isnan(r["theta"]).all() for r in got)
    with pytest.raises(ValueError):
        combine.consensus(draws, 2)
    kept = combine.kernel_product(draws, 2, 30, seed=4).collect()
    assert len(kept) == 30 and np.isfinite([r["theta"] for r in kept]).all()


def test_events_and_runs_outside_their_calendar_are_refused(spark):
    rows = [("2024-01-01 00:30:00", 1.0), ("2023-12-31 23:45:00", 2.0)]
    events = spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="outside the 24 hours"):
        series.hourly(events, 24).collect()
    kept = series.hourly(events, 24, outside="drop").filter("y > 0").collect()
    assert [(r["t"], r["y"], r["x1"]) for r in kept] == [(0, 1.0, 1.0)]
    run_rows = spark.createDataFrame([(0, 3), (7, 2)], "day_index int, n long")
    with pytest.raises(Exception, match="calendar of 5 days"):
        panel.daily_changes(run_rows, 5).collect()


def test_completeness_looks_at_ends_and_values(spark):
    good = spark.createDataFrame([(k, 1.0) for k in range(1, 10)], "k long, periodogram double")
    state = lambda df: [r["complete"] for r in spectrum.shard_completeness(spectrum.systematic(df, 3), 3, 9).orderBy("shard_id").collect()]
    assert state(good) == [True, True, True]
    assert state(good.withColumn("k", F.when(F.col("k") == 9, 12).otherwise(F.col("k")))) == [True, True, False]
    for bad in (0.0, float("inf"), float("nan")):
        assert state(good.withColumn("periodogram", F.when(F.col("k") == 2, bad).otherwise(1.0))) == [True, False, True]


def test_exact_quantiles_equal_numpy_in_groups_of_any_shape(spark):
    from spectrabrook.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=5000), "b": np.repeat([1.0, 2.0], 700), "c": np.array([3.5]), None: np.round(rng.exponential(size=900), 1)}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.025, 0.5, 0.9, 1.0]
    for accuracy in (10_000, 50):
        got = {r["g"]: r["q"] for r in exact_quantiles(df, ["g"], "v", probs, accuracy).collect()}
        assert set(got) == set(groups)
        for g, x in groups.items():
            np.testing.assert_allclose(got[g], np.quantile(x, probs), rtol=1e-12, err_msg=str(g))


def test_ranked_scores_equal_those_of_arrays(spark):
    rng = np.random.default_rng(3)
    rows = [(u, float(v), a, 0.5) for u, a in ((1, 0.3), (2, None), (3, 9.0)) for v in rng.normal(size=40 + u)]
    df = spark.createDataFrame(rows, "u int, value double, actual double, prediction double")
    a = scores.score_rows(df, ["u"]).orderBy("u").toPandas()
    b = scores.score_samples(df.groupBy("u", "actual", "prediction").agg(F.collect_list("value").alias("draws"))).orderBy("u").toPandas()
    for c in ("ae", "se", "crps", "lower80", "upper80", "lower95", "upper95", "cover80", "cover95", "interval80", "interval95"):
        np.testing.assert_allclose(a[c].astype(float), b[c].astype(float), rtol=1e-10, err_msg=c)


def test_draws_are_numbered_alike_in_runs_of_any_length(spark):
    rows = [(int(i) * 7 % 1009, "abc"[i % 3], float(i + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "event_id long, event_type string, value double")
    key = lambda f: sorted((r["shard_id"], r["draw"], r["theta"][0]) for r in f.collect())
    whole = key(series.event_draws(df))
    assert key(series.event_draws(df, run_rows=10)) == whole
    assert [d for s, d, _ in whole if s == 0] == list(range(100))
    ordered = [v for i, t, v in sorted(rows) if t == "a"]
    assert [v for s, _, v in whole if s == 0] == ordered
