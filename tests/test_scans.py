"""Ordered scans split by size (operators/scan.py) against loops: hot days, hot instants, carries over partition edges."""

import math
import random
import re
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import scan
from tallyspark.operators import sequences as sq
from test_loops import kernel_model

T0 = datetime(2024, 1, 1)


def rows_of(kind, n=700, seed=1):
    rng = random.Random(seed)
    users = [None, 1, 2, 3]
    at = {"spread": lambda: T0 + timedelta(hours=rng.randrange(24 * 40)), "one_day": lambda: T0 + timedelta(seconds=rng.randrange(3600)),
          "one_instant": lambda: T0, "null_times": lambda: rng.choice([None, T0, T0 + timedelta(days=1)])}[kind]
    # one user holds most of the rows
    return [(i, users[0] if rng.random() < 0.1 else rng.choices(users[1:], [8, 1, 1])[0], at(), rng.choice("abc"), round(rng.random() * 9, 3)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, user long, t timestamp, cat string, y double").repartition(5)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2] is not None, r[2] or T0, r[0]))


KINDS = ["spread", "one_day", "one_instant", "null_times"]


@pytest.mark.parametrize("kind", KINDS)
@pytest.mark.parametrize("by", [[], ["user"]])
def test_prefix_sums_match_a_loop(spark, kind, by):
    rows = rows_of(kind)
    got = {r["id"]: r for r in scan.prefix_sums(frame(spark, rows), by, "t", {"v": F.col("y"), "n": F.lit(1.0)}, strict=False, tiebreak=["id"],
                                                strict_suffix="_strict").collect()}
    strict = {r["id"]: r["v"] for r in scan.prefix_sums(frame(spark, rows), by, "t", {"v": F.col("y")}, strict=True).collect()}
    assert len(got) == len(rows)
    seen: dict = {}
    for r in in_order(rows):
        earlier = seen.setdefault(r[1] if by else 0, [])
        before = [x for x in earlier if x[2] != r[2]]
        g = got[r[0]]
        assert g["n"] == len(earlier) and g["n_strict"] == len(before)
        assert abs(g["v"] - sum(x[4] for x in earlier)) < 1e-9
        assert abs(g["v_strict"] - sum(x[4] for x in before)) < 1e-9 and abs(strict[r[0]] - g["v_strict"]) < 1e-9
        earlier.append(r)


@pytest.mark.parametrize("kind", ["spread", "one_day", "one_instant"])
@pytest.mark.parametrize("half_life", [3600.0, 28 * 86400.0, 0.5])
def test_decayed_means_match_a_loop(spark, kind, half_life):
    rows = rows_of(kind)
    for by in ([], ["user"]):
        got = {r["id"]: r for r in scan.decayed_means(frame(spark, rows), by, "t", ["id"], "cat", "y", ["a", "b", "c"], half_life, "m_").collect()}
        seen: dict = {}
        for r in in_order(rows):
            for c in "abc":
                earlier = [x for x in seen.get(r[1] if by else 0, []) if x[3] == c]
                if not earlier:
                    assert got[r[0]]["m_" + c] is None
                    continue
                w = [math.exp(-math.log(2) / half_life * (earlier[-1][2] - x[2]).total_seconds()) for x in earlier]
                want = sum(a * x[4] for a, x in zip(w, earlier)) / sum(w)
                assert abs(got[r[0]]["m_" + c] - want) < 1e-9
            seen.setdefault(r[1] if by else 0, []).append(r)


def test_one_hour_half_life_over_ten_years(spark):
    """Weights of 2^-87600: the mean is that of the latest rows, not 0/0."""
    rows = [(i, 1, T0 + timedelta(days=36 * i), "a", float(i)) for i in range(100)] + [(100, 1, T0 + timedelta(days=3650), "b", 1.0)]
    got = {r["id"]: r["m_a"] for r in scan.decayed_means(frame(spark, rows), [], "t", ["id"], "cat", "y", ["a"], 3600.0, "m_").collect()}
    assert got[0] is None and [got[i] for i in range(1, 101)] == [float(i - 1) for i in range(1, 101)]


@pytest.mark.parametrize("kind", KINDS[:3])
def test_asof_matches_a_loop(spark, kind):
    left, right = rows_of(kind, 400, 2), rows_of(kind, 300, 3)
    right = [(r[0] + 5000, *r[1:]) for r in right]
    got = {r["id"]: r["rid"] for r in scan.asof_join(frame(spark, left), frame(spark, right).selectExpr("user", "t AS rt", "id AS rid"), ["user"], "t", "rt", ["rid"]).collect()}
    assert len(got) == len(left)
    for r in left:
        hits = [(x[2], x[0]) for x in right if x[1] == r[1] and x[2] <= r[2]]
        assert got[r[0]] == (max(hits)[1] if hits else None)


def test_scans_of_nothing(spark):
    none = frame(spark, rows_of("spread")).where("false")
    assert scan.prefix_sums(none, ["user"], "t", {"v": F.col("y")}).collect() == []
    assert scan.decayed_means(none, [], "t", ["id"], "cat", "y", ["a"], 1.0, "m_").collect() == []
    some = frame(spark, rows_of("spread", 9))
    right = none.selectExpr("user", "t AS rt", "id AS rid")
    assert [r["rid"] for r in scan.asof_join(some, right, ["user"], "t", "rt", ["rid"]).collect()] == [None] * 9


def test_all_rows_on_one_day_are_spread_over_tasks(spark):
    rows = frame(spark, rows_of("one_day", 4000)).withColumn("__tmicros", F.unix_micros("t"))
    sizes = [r["n"] for r in scan.in_order(rows, ["user", "__tmicros", "id"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2.5 * 4000 / len(sizes)


def test_facts_are_read_and_moved_once(spark, tmp_path):
    frame(spark, rows_of("spread")).write.parquet(str(tmp_path / "facts"))
    facts = spark.read.parquet(str(tmp_path / "facts"))
    for out in (scan.prefix_sums(facts, ["user"], "t", {"v": F.col("y")}), scan.prefix_sums(facts, [], "t", {"v": F.col("y")}, strict=False, tiebreak=["id"]),
                scan.decayed_means(facts, [], "t", ["id"], "cat", "y", ["a", "b"], 60.0, "m_")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        final = plan[:plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert len(re.findall(r"FileScan parquet", final)) == 1 and len(re.findall(r"\+- Exchange rangepartitioning", final)) == 1, final


def test_kernel_series_keeps_its_tolerance():
    d = np.linspace(-43200, 43200, 20001)
    for tolerance in (1e-3, 1e-4, 2e-5):
        a = sq.kernel_series(3 * 3600.0, 86400.0, tolerance)
        series = a[0] + sum(2 * x * np.cos(2 * np.pi * m * d / 86400) for m, x in enumerate(a[1:], 1))
        assert np.abs(series - np.exp(-(d * math.log(2) / 10800) ** 2)).max() <= tolerance
    with pytest.raises(ValueError):
        sq.kernel_series(3 * 3600.0, 86400.0, 1e-9)


def test_kernel_means_stay_within_the_stated_bound(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(5), T0 + timedelta(seconds=rng.randrange(20 * 86400)), rng.choice([0, 1]), rng.random() * 3) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, user long, t timestamp, cat long, y double")
    tolerance = 1e-4
    got = {r["id"]: r for r in sq.kernel_prior_category_means(df, "user", "t", "id", "cat", "y", [0, 1], tolerance=tolerance).collect()}
    want = kernel_model(rows, [0, 1])
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    peak = {u: np.mean([r[2].hour * 3600 + r[2].minute * 60 + r[2].second for r in rows if r[1] == u]) for u in range(5)}
    first = {}
    for r in ordered:
        first.setdefault(r[1], r[2])
    for i, r in enumerate(ordered):
        for c, v in want[r[0]].items():
            g = got[r[0]][f"prior_kernel_mean_{c}"]
            if v is None:
                assert g is None
                continue
            s = np.array([x[2].hour * 3600 + x[2].minute * 60 + x[2].second for x in ordered[:i] if x[3] == c and x[2] >= first[r[1]]])
            weight = np.exp(-((((peak[r[1]] - s + 43200) % 86400) - 43200) * math.log(2) / 10800) ** 2).mean()
            assert abs(g - v) <= 2 * 3 * tolerance / weight + 1e-9


def test_own_kernel_means_are_exact(spark):
    rows = [r for r in rows_of("spread", 300, 9)]
    got = {r["id"]: r for r in sq.kernel_prior_category_means(frame(spark, rows), "user", "t", "id", "cat", "y", ["a", "b", "c"], own_only=True).collect()}
    for user in (None, 1, 2, 3):
        mine = [(i, 0, t, c, y) for i, u, t, c, y in rows if u == user]
        for i, vals in kernel_model(mine, "abc").items():
            for c, v in vals.items():
                g = got[i][f"prior_kernel_mean_{c}"]
                assert (g is None) == (v is None) and (v is None or abs(g - v) < 1e-9)
