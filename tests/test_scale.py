"""Plan-shape checks: push-down, pruning, no Python in hot paths, bucketed scans over facts."""

import os

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TALLY_TEST_SF", "/root/testdata/sf0.001")
Q = entry.queries()


def plan(spark, name):
    df = Q[name](spark, SF)
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


HOT = ["ag3_sats48_attribution", "jn4_asof_owner", "wn16_strictly_prior_totals", "wn6_wn7_activity_spells",
       "wn4_rolling_sum_lagged", "wn21_prior_category_mean_decayed", "wn1_burst_counter", "dt4_dt5_posts",
       "sf1_sf2_image_link_features", "sf6_word_blank_link_only", "sf13_uuid5"]


@pytest.mark.parametrize("name", HOT)
def test_no_python_udf_in_hot_paths(spark, name):
    p = plan(spark, name)
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_filters_and_columns_reach_the_scan(spark):
    df = Q["src2_scan_pruned_filtered"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), IsNotNull(o_orderstatus), GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double" in text
    assert "o_orderpriority" not in text


@pytest.mark.parametrize("name", ["jn4_asof_owner", "wn16_strictly_prior_totals", "wn23_global_prefix_sum"])
def test_fact_scans_are_dealt_by_ranges(spark, name):
    # the running scans deal facts by ranges of (key, time), never by the key or the day alone
    assert "rangepartitioning" in plan(spark, name)


def test_attribution_aggregates_in_two_levels(spark):
    p = plan(spark, "ag3_sats48_attribution")
    assert p.count("HashAggregate") >= 4
