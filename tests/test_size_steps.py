"""Steps that must hold as tables grow: levels taken out in the tasks, hubs in components, stored tables, partitions of a fit."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.config import ForumConfig
from tallyspark.estimators import linear, ml
from tallyspark.operators import graph
from tallyspark.plans import forum
from tallyspark.session import stored


@pytest.mark.parametrize("two", [True, False])
def test_the_largest_effect_is_taken_out_in_the_tasks(spark, monkeypatch, two):
    """Unbalanced rows, a hot level and a NULL one: levels as by the driver's way, and no rounds of conjugate gradients."""
    rng = np.random.default_rng(5)
    rows = [(int(u) if u else None, int(w), f"s{s}", float(y), float(x)) for u, w, s, y, x in
            zip(np.where(rng.random(3000) < 0.3, 1, rng.integers(0, 400, 3000)), rng.integers(0, 12, 3000), rng.integers(0, 5, 3000),
                rng.normal(size=3000), rng.normal(size=3000))]
    df = spark.createDataFrame(rows, "user long, week int, sub string, y double, x double").repartition(5)
    fes = ["week", "user"] if two else ["week", "sub", "user"]
    cells = linear.cell_table(df, ["y", "x"], fes).persist()
    want = linear.solve_levels(cells, fes, 2, direct=True)
    monkeypatch.setattr(linear, "DIRECT_LEVELS", 10)
    seen = {}
    got = linear.solve_levels(cells, fes, 2, seen=seen)
    assert "rounds" not in seen
    for f in fes:
        a = {r[f]: (r["__n"], *r["__a"]) for r in want[f].collect()}
        b = {r[f]: (r["__n"], *r["__a"]) for r in got[f].collect()}
        assert a.keys() == b.keys()
        assert all(np.allclose(a[level], b[level], atol=1e-8) for level in a)


@pytest.mark.parametrize("hub", [2, 100_000])
def test_components_do_not_depend_on_hubs(spark, hub):
    star = [(i, 500) for i in range(400, 901) if i != 500] + [(7, i) for i in range(8, 60)]
    chain = [(i, i + 1) for i in range(1000, 1010)] + [(1010, 900), (900, 899)]
    edges = spark.createDataFrame(star + chain + [(2000, 2001), (2001, 2000), (3000, 3000), (None, 7)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(edges, hub=hub).collect()}
    want = {i: 400 for i in [*range(400, 901), *range(1000, 1011)]} | {i: 7 for i in range(7, 60)} | {2000: 2000, 2001: 2000}
    assert got == want


def test_labels_of_hubs_do_not_go_by_node(spark):
    """All edges of a star are at its centre: none of them is dealt by the centre once that is a hub."""
    edges = spark.range(1, 2000).select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    plan = graph._large_star(edges, hub=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan.lower()


def test_stored_tables_are_read_by_column(spark):
    df = stored(spark.range(100).select("id", F.repeat(F.lit("x"), 50).alias("text"), F.lit("2024-01-05 01:02:03.123456").cast("timestamp").alias("t")), "t")
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan
    assert df.agg(F.min("t")).first()[0].microsecond == 123456 and df.count() == 100


def test_owners_are_looked_up_for_eligible_posts_only(spark, monkeypatch):
    cfg = ForumConfig()
    t = "2024-01-05 10:00:00"
    cols = "itemId long, subName string, userId long, created_at string, cost double, invoiceActionState string, bio boolean, freebie boolean, " \
           "saloon boolean, cost_modifier long, n_uploads long, hasImageOrLink boolean, text string"
    rows = [(900001, "a", 910001, t, 5.0, "PAID", False, False, False, 0, 0, False, "x"), (900002, "a", 910002, t, 5.0, "PAID", False, False, False, 0, 0, False, "x"),
            (900003, "a", 910001, t, 5.0, "FAILED", False, False, False, 0, 0, False, "x"), (900004, "a", 910001, t, 5.0, None, False, False, False, 1, 0, False, "x"),
            (900005, None, 910001, t, 5.0, None, False, False, False, 0, 0, False, "x")]
    posts = spark.createDataFrame(rows, cols).withColumn("created_at", F.col("created_at").cast("timestamp"))
    moves = spark.createDataFrame([("2024-01-01 00:00:00", "a", 0, 910002)], "timeStamp string, subName string, userIdFrom long, userIdTo long").withColumn(
        "timeStamp", F.col("timeStamp").cast("timestamp"))
    looked, plain = [], forum.find_subowner
    monkeypatch.setattr(forum, "find_subowner", lambda df, *a: looked.append(df) or plain(df, *a))
    assert sorted(r["itemId"] for r in forum.fee_eligible_posts(posts, moves, cfg).collect()) == [900001, 900005]
    assert looked[0].count() == 3 and "text" not in looked[0].columns


def test_a_small_fit_has_few_partitions(spark):
    df = spark.range(100).repartition(16)
    assert ml.few_partitions(df).rdd.getNumPartitions() == 1 and ml.few_partitions(df).count() == 100
    assert ml.few_partitions(spark.range(0, 3 * ml.ROWS_A_TASK, 1, 16)).rdd.getNumPartitions() == 3
