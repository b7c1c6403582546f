"""Steps of the fee queries: bursts as one ordered scan, root items on one key, a spell's posts by day."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import scan
from tallyspark.operators import sequences as sq
from tallyspark.plans import forum, q_derived, views
from tallyspark.sources.tables import Tables

GAP = 600


def bursts_by_loop(rows, anon):
    out, last, n = {}, {}, {}
    for user, t, item, bio in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or dt.datetime.min, r[2])):
        if bio or user == anon:
            out[item] = 0 if bio else 1
            continue
        before = last.get(user)
        goes_on = before is not None and t is not None and (t - before).total_seconds() <= GAP
        n[user] = n[user] + 1 if goes_on else 0
        last[user] = t
        out[item] = n[user]
    return out


@pytest.mark.parametrize("batch,partitions", [(3, 7), (10000, 40), (10000, 1)])
def test_bursts_over_edges_of_ranges(spark, batch, partitions):
    """A hot user with bursts longer than a range or a batch, one without a name, posts without a time, skipped posts between."""
    rng = random.Random(11)
    rows, start = [], dt.datetime(2024, 1, 5)
    for item in range(900):
        user = rng.choice([5, 5, 5, 5, 5, 5, 3, 3, 8, None, *range(20, 60)])
        step = rng.randrange(25_000) if user == 5 else rng.choice([60, 600]) * rng.randrange(400)
        t = None if rng.random() < 0.03 else start + dt.timedelta(seconds=step)
        rows.append((user, t, item, None if rng.random() < 0.1 else rng.random() < 0.15))
    df = spark.createDataFrame(rows, "user long, t timestamp, id long, bio boolean").repartition(3)
    conf = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(batch), "spark.sql.shuffle.partitions": str(partitions)}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = sq.burst_counter(df, "user", "t", "id", GAP * 1_000_000, skip="bio", always_one=(3,)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = bursts_by_loop(rows, 3)
    assert max(want.values()) > 20
    assert len(got) == len(rows) and {r["id"]: r["cost_modifier"] for r in got} == want


def test_bursts_move_rows_once(spark):
    df = spark.range(100).select(F.col("id").alias("user"), F.timestamp_seconds("id").alias("t"), "id")
    plan = sq.burst_counter(df, "user", "t", "id", 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan
    # the scan and the summary of a partition look at one exchange; the other deals one row a partition
    assert plan.count("RepartitionByExpression") == 2 and plan.count("Repartition 1") == 1


def test_root_items_are_those_of_all_items(spark, tmp_path):
    """Ids that repeat, an id and a text that are missing: the rows of the whole items' table, by one key."""
    t0 = dt.datetime(1996, 1, 1)
    item = spark.createDataFrame(
        [(1, 1, "A", None, 1, "4-NOT SPECIFIED", "see https://x.y", t0), (1, 2, "B", None, 1, None, None, t0), (2, 1, None, None, 2, "t", "plain", t0),
         (None, 3, "A", None, None, "t", None, t0), (9, 4, None, 1, 1, None, "c", t0)],
        "itemId long, userId long, subName string, parentId long, rootId long, title string, text string, created_at timestamp")
    item = item.withColumn("cost", F.lit(1.0)).withColumn("bio", F.lit(False)).withColumn("freebie", F.lit(False)).withColumn(
        "invoiceActionState", F.lit("PAID"))
    up = spark.createDataFrame([(1, 5), (1, 6), (9, 7), (None, 8)], "itemId long, uploadId long")
    acts = spark.createDataFrame([], "itemId long, userId long, created_at timestamp, act string, msats double, invoiceActionState string")
    cfg = q_derived.CFG
    whole = forum.items(item, up, forum.zaps(acts, cfg), forum.downzaps(acts, cfg), cfg).where(F.col("parentId").isNull())
    cols = q_derived.FEE_COLUMNS
    key = lambda r: str(tuple(r))
    got, want = (sorted(x.select(cols).collect(), key=key) for x in (forum.root_items(item, up, cfg), whole))
    assert got == want and len(got) == 6


def test_posts_of_a_spell_are_counted_by_day(spark, monkeypatch):
    """A third of the posts on one day: what is looked up in the spells is a row a day, not a row a post."""
    day = dt.datetime(2024, 1, 5)
    fees = spark.createDataFrame([("a", day.date(), 1.0), ("a", dt.date(2024, 1, 8), 2.0), ("b", day.date(), 1.0)], "subName string, date date, posting_fee double")
    posts = [("a", day + dt.timedelta(hours=i % 100, seconds=i), i) for i in range(300)] + [("a", day - dt.timedelta(microseconds=1), 900),
             ("a", dt.datetime(2024, 1, 10), 901), ("a", dt.datetime(2024, 1, 9, 23, 59, 59, 999999), 902), ("a", None, 903), (None, day, 904)]
    p = spark.createDataFrame(posts, "subName string, created_at timestamp, itemId long")
    looked, plain = [], scan.asof_join
    monkeypatch.setattr(scan, "asof_join", lambda left, *a, **k: looked.append(left) or plain(left, *a, **k))
    out = forum.fee_spells(fees, p, F.lit("2024-01-10 05:00:00").cast("timestamp")).collect()
    inside = lambda s, e: sum(1 for sub, t, _ in posts if sub == "a" and t is not None and s <= t < e)
    got = {(r.subName, r.spell_start): (r.n_posts, r.days) for r in out}
    mid, end = dt.datetime(2024, 1, 8), dt.datetime(2024, 1, 10)
    assert got == {("a", day): (inside(day, mid), 3.0), ("a", mid): (inside(mid, end), 2.0), ("b", day): (0, 5.0)}
    assert looked[0].count() < 12


def test_a_territory_joins_customers_not_orders(spark):
    """The territories' first post is taken from one row a customer."""
    sub = views.forum_sub(Tables(spark, "/root/testdata/sf0.001"))
    plan = sub._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Aggregate [o_custkey") > plan.index("Join")
