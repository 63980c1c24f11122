import numpy as np
import pytest
from pyspark.sql import functions as F

from spectrabrook.functions.model import Settings, Spec
from spectrabrook.plans import production

SETTINGS = Settings(draws=1500, burn=200, chains=2, seed=2)


def ma1_power(n, theta, sigma2, seed):
    """Ordinates 1..n/2-1 of an MA(1)'s periodogram, exponential around its density."""
    w = 2 * np.pi * np.arange(1, n // 2) / n
    f = sigma2 / (2 * np.pi) * (1 + theta * theta + 2 * theta * np.cos(w))
    return w, f * np.random.default_rng(seed).exponential(size=len(w))


def frequencies(spark, n=4096, theta=-0.4, shards=4, histories=2):
    rows = []
    for h in range(histories):
        w, p = ma1_power(n, theta, 1.0, h)
        rows += [(h, i % shards, float(a), float(b)) for i, (a, b) in enumerate(zip(w, p, strict=True))]
    return spark.createDataFrame(rows, "history_id int, shard_id int, omega double, periodogram double")


def test_production_recovers_a_known_model_and_passes_its_gates(spark):
    fits = production.fit_histories(frequencies(spark), 4, SETTINGS, Spec(ma=1)).cache()
    gates = {r["history_id"]: r for r in production.gate_table(fits, 4).collect()}
    assert set(gates) == {0, 1} and all(r["passed"] and r["failed"] == 0 and r["least_ess"] >= 400 for r in gates.values())
    merged = production.consensus(fits, 2)
    scales = spark.createDataFrame([(0, 2.0), (1, 1.0)], "history_id int, scale double")
    found = production.posterior(merged, scales, Spec(ma=1), SETTINGS.draws)
    got = found.groupBy("history_id").agg(*[F.avg(F.col("theta")[i]).alias(f"t{i}") for i in range(4)], F.countDistinct("chain").alias("chains"), F.count(F.lit(1)).alias("n")).collect()
    for r in got:
        assert (r["chains"], r["n"], r["t1"], r["t3"]) == (2, 3000, 1.0, 0.0)
        assert r["t0"] == pytest.approx(-0.4, abs=0.06)
        assert r["t2"] == pytest.approx(4.0 if r["history_id"] == 0 else 1.0, rel=0.1)


def test_consensus_weights_shards_by_their_covariances(spark):
    rows = [(0, 0, [[1.0], [2.0]], [1.0]), (0, 1, [[5.0], [6.0]], [4.0]), (1, 0, [[3.0], [3.5]], [1.0])]
    fits = spark.createDataFrame(rows, "history_id int, shard_id int, draws array<array<double>>, cov array<double>")
    got = {(r["history_id"], r["draw"]): r["theta"][0] for r in production.consensus(fits, 1, ridge=0.0).collect()}
    assert got == pytest.approx({(0, 0): 0.8 * 1 + 0.2 * 5, (0, 1): 0.8 * 2 + 0.2 * 6, (1, 0): 3.0, (1, 1): 3.5})


def test_gates_refuse_short_chains_and_lost_shards(spark):
    rows = frequencies(spark, n=512, histories=1)
    short = production.fit_histories(rows, 4, Settings(draws=60, burn=10, chains=2, seed=1), Spec(ma=1))
    r = production.gate_table(short, 4).first()
    assert not r["passed"] and r["reasons"] == "sampling" and r["failed"] == 4
    some = production.fit_histories(rows.filter("shard_id < 3"), 4, SETTINGS, Spec(ma=1))
    assert not production.gate_table(some, 4).first()["passed"]
