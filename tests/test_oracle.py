"""Every registered query with an SQL oracle agrees with DuckDB on the smallest test tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import canon, digest  # noqa: E402
from tallyspark.plans import registry  # noqa: E402
from tallyspark.sources.tables import TABLES, table_path  # noqa: E402

SF = os.environ.get("TALLY_TEST_SF", "/root/testdata/sf0.001")
# The optional training-data queries have tests of their own.
SQL = {k: v for k, v in entry.oracle_sql().items() if k in registry.ORACLE}
QUERIES = {k: v for k, v in entry.queries().items() if k in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(SF, t)}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(SQL[name]).df()
    c1, r1 = canon(got)
    c2, r2 = canon(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert digest(r1) == digest(r2)


# Queries that SQL cannot express, and the tests that hold their results.
OTHERWISE = {"es2_es4_feols_two_effects_clustered": "test_models", "es7_event_study": "test_models", "es8_logit": "test_models",
             "es9_es10_es11_conditional_logit": "test_clogit", "es14_kernel_bootstrap_band": "test_kernel_quantile", "es16_pca_explained_variance": "test_models",
             "es16_pca_scores": "test_models", "es17_es18_boosted_trees_vs_linear": "test_models", "ag27_feature_importance_groups": "test_models",
             "prj13_quantile_slice_sample": "test_models", "sf12_sanitize": "test_edges", "sf13_uuid5": "test_edges"}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == set(OTHERWISE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["o_orderkey", "sats48", "zappers48"]
    assert df.count() > 0
