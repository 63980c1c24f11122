"""Every query with an oracle against DuckDB on the smallest tables, and the others for rows."""

import math

import pytest

from spectrabrook.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(f"{v:.9g}") if isinstance(v, float) else v

    return sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_duckdb(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in got.collect()], got.columns) == rows(want.fetchall(), want.columns)


#: Rows of the queries that SQL can't express, on the smallest tables: shards, draws, histories.
ROWS = {
    "ar1_map": 1, "arma11_map": 1, "audited_maps": 4, "block_sampling": 4, "dc_consensus_draws": 400, "dc_map_shards": 4, "dc_regression_draws": 400, "dc_time_segments": 400,
    "forecast_paths": 0, "kernel_product_draws": 200, "production_gates": 1, "split_rhat_ess": 8, "surrogate_draws": 300,
}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_without_sql_has_its_rows_and_finite_numbers(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    assert len(found) == ROWS[name]  # no forecasts there: the gates refuse that short history
    for r in found:
        assert all(math.isfinite(v) for v in r if isinstance(v, float))
        assert all(math.isfinite(x) for v in r if isinstance(v, list) for x in v if isinstance(x, float))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == queries.SHARDS
    assert set(entry.oracle_sql()) <= set(entry.queries())
