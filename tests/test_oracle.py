"""Every SQL-checked query equals its DuckDB oracle at sf0.01."""

import pytest

from wearcast.plans.check import compare, duck
from wearcast.plans.queries import NO_ORACLE, QUERIES, oracle_sql

from conftest import SF01

SQL = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF01).toPandas()
    want = con.sql(SQL[name]).df()
    r = compare(got, want)
    assert r["cols_match"], (r["cols_spark"], r["cols_oracle"])
    assert r["rows_match"], (r["rows_spark"], r["rows_oracle"])
    assert r["values_match"], r["first_diff"]


# Spark type -> DuckDB type of the same values (a count must not come back
# as HUGEINT, which pandas turns into float).
DUCK_TYPE = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN"}


def test_result_types_match_oracle(spark, con):
    bad = {}
    for name in sorted(SQL):
        spark_types = {f.name: f.dataType.simpleString()
                       for f in QUERIES[name](spark, SF01).schema.fields}
        rel = con.sql(SQL[name])
        duck_types = dict(zip(rel.columns, (str(t) for t in rel.types)))
        for col, t in spark_types.items():
            if DUCK_TYPE.get(t, t) != duck_types.get(col):
                bad[(name, col)] = (t, duck_types.get(col))
    assert not bad, bad


def test_every_query_has_oracle_or_is_model_backed():
    assert set(QUERIES) == set(SQL) | NO_ORACLE


# The sampling chain and what is fitted on all rows, at ten times the rows too.
SAMPLING = ["strata_sizes", "stratified_sample", "train_test_split", "sample_report",
            "impute_fit", "encode_fit", "metrics_by_target", "efficiency"]


@pytest.fixture(scope="module")
def con_big():
    return duck("/root/testdata/sf0.1")


@pytest.mark.parametrize("name", SAMPLING)
def test_sampling_chain_matches_oracle_at_sf01(spark, con_big, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.1").toPandas()
    want = con_big.sql(SQL[name]).df()
    r = compare(got, want)
    assert r["cols_match"] and r["rows_match"], r
    assert r["values_match"], r["first_diff"]
