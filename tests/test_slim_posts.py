"""The post queries move what they need: root items with the measures asked for, raw acts cut before they are collapsed, no stored items."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyspark.functions import predicates as pr
from tallyspark.operators import attribution as attr
from tallyspark.operators import sequences as sq
from tallyspark.plans import forum, q_derived, q_users

CFG = q_derived.CFG
SF = "/root/testdata/sf0.001"
T0 = dt.datetime(1996, 1, 1)


@pytest.fixture(scope="module")
def raw(spark):
    """Items, uploads and acts: ids that several posts have, ids, users, times and states that are missing, acts on comments."""
    rng = random.Random(3)
    when = lambda: None if rng.random() < 0.04 else T0 + dt.timedelta(hours=rng.randrange(200))
    state = lambda: rng.choice(["PAID", "FAILED", None, None])
    items = []
    for i in [*range(60), 4, 4, 9, None, None]:
        items.append((i, rng.randrange(8), rng.choice(["A", "B", "nation_1", "", None]), None, i, rng.choice(["4-NOT SPECIFIED", "1-URGENT", "t", None]),
                      rng.choice(["see https://x.y " + "word " * 60, "plain " * 55, "short", None]), rng.choice([None, "", "http://u"]),
                      rng.choice([0.0, 2.0, None]), rng.random() < 0.1, rng.random() < 0.1, state(), when()))
    for i in range(400):
        root = rng.choice([4, 4, 4, 9, None, 500, *range(60)])
        items.append((1000 + i, rng.randrange(8), None, root if root is not None else 7, root, None, None, None, 0.0, False, False, state(), when()))
    item = spark.createDataFrame(items, "itemId long, userId long, subName string, parentId long, rootId long, title string, text string, url string, "
                                        "cost double, bio boolean, freebie boolean, invoiceActionState string, created_at timestamp")
    up = spark.createDataFrame([(rng.choice([4, 9, 11, 1001, None]), k) for k in range(20)], "itemId long, uploadId long")
    acts = spark.createDataFrame(
        [(rng.choice([4, 4, 4, 9, None, 1000, 1001, *range(60)]), rng.choice([None, *range(5)]), when(), rng.choice(["TIP", "FEE", "DONT_LIKE_THIS", None]),
          rng.choice([None, 1000.0, 5000.0, 250.0]), state()) for _ in range(1500)],
        "itemId long, userId long, created_at timestamp, act string, msats double, invoiceActionState string")
    return item.cache(), up.cache(), acts.cache()


def rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def names(monkeypatch):
    """Frames as they are stored, by name."""
    seen = {}
    for module in (q_derived, forum, q_users):
        plain = module.stored
        monkeypatch.setattr(module, "stored", lambda df, name, plain=plain: seen.setdefault(name, df) is not None and plain(df, name))
    return seen


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


@pytest.fixture()
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# ---------------------------------------------------------------- F1
def test_zaps_of_the_sample_are_those_of_all_zaps(spark, raw):
    item, up, acts = raw
    roots = forum.root_items(item, up, CFG, measured=forum.in_v4v_sample(CFG))
    out = forum.v4v_sample(roots, acts, CFG)
    p = forum.posts(forum.items(item, up, forum.zaps(acts, CFG), forum.downzaps(acts, CFG), CFG), CFG)
    p = forum.text_metrics(p.where(pr.analysis_sample(CFG, title="title")))
    p = p.withColumn("hi_quality", (F.col("num_words") > 50) & (~F.col("is_link_post") | (F.col("num_img_or_links") > 0)))
    z = forum.zaps(acts, CFG).join(p.select("itemId", F.col("hi_quality").alias("h"), F.col("userId").alias("posterId")), "itemId")
    want = sq.strictly_prior_totals(p, z, "userId", "created_at", "hi_quality", "sats", "posterId", "zap_time", "h")
    cols = ["itemId", "hi_quality", "prior_zaps", "prior_zaps_from_hi_quality", "prior_posts", "prior_hi_quality_posts"]
    assert rows(out, *cols) == rows(want, *cols) and out.count() > 10


def test_v4v_sample_stores_its_posts_only(spark, monkeypatch):
    seen = names(monkeypatch)
    entry.queries()["dt18_v4v_sample"](spark, SF)
    assert set(seen) == {"v4v_posts"} and "text" not in seen["v4v_posts"].columns


def test_acts_move_once(spark, raw, no_broadcast):
    """One exchange of acts and one of parents: acts are collapsed and added up where the join left them."""
    _, _, acts = raw
    parents = spark.range(50).select(F.col("id").alias("itemId"), F.lit(T0).alias("created_at"))
    assert exchanges(forum.zaps48(acts, parents, CFG)) == 2 and exchanges(forum.downzaps48(acts, parents, CFG)) == 2


# ---------------------------------------------------------------- F4
def test_quality_sample_moves_no_texts(spark, monkeypatch):
    seen = names(monkeypatch)
    looked, plain = [], forum.find_subowner
    monkeypatch.setattr(forum, "find_subowner", lambda df, *a: looked.append(df) or plain(df, *a))
    entry.queries()["dt15_post_quality_sample"](spark, SF)
    assert {"quality_posts", "quality_sample"} <= set(seen) and not {"items", "posts"} & set(seen)
    assert set(looked[0].columns) == {"itemId", "subName", "userId", "created_at", "cost", *forum.TEXT_METRICS}


# ---------------------------------------------------------------- F5
def test_root_items_with_text_metrics(spark, raw):
    item, up, _ = raw
    got = forum.root_items(item, up, CFG, measured=pr.eligible_post(CFG))
    zaps = forum.zaps(spark.createDataFrame([], raw[2].schema), CFG)
    downs = forum.downzaps(spark.createDataFrame([], raw[2].schema), CFG)
    want = forum.text_metrics(forum.items(item, up, zaps, downs, CFG).where(F.col("parentId").isNull()).where(pr.eligible_post(CFG)))
    cols = ["itemId", "userId", "subName", "root_subName", "root_is_saloon", "n_uploads", "hasImageOrLink", *forum.TEXT_METRICS]
    assert rows(got, *cols) == rows(want, *cols) and got.count() > 20


def test_degrees_store_no_items(spark, monkeypatch):
    seen = names(monkeypatch)
    entry.queries()["dt23_degree_enriched_posts"](spark, SF)
    assert not {"items", "posts"} & set(seen)


# ---------------------------------------------------------------- F6
def test_moments_read_the_sample_s_measures_only(spark, monkeypatch):
    seen = names(monkeypatch)
    entry.queries()["ag21_mean_std_summary"](spark, SF)
    assert not {"items", "posts"} & set(seen)
    plan = seen["quality_posts"]._jdf.queryExecution().optimizedPlan().toString()
    assert "__s_sats48" in plan and "__s_downsats48" not in plan and seen["quality_posts"].columns == [
        "itemId", "subName", "userId", "created_at", "cost", "sats48", "comments48"]


# ---------------------------------------------------------------- F7
def test_measured_posts_are_the_posts(spark, raw):
    item, up, acts = raw
    roots = forum.root_items(item, up, CFG).cache()
    got = forum.measured_posts(forum.posts(item, CFG, roots).drop("comments48"), roots, item, acts, CFG)
    want = forum.posts(forum.items(item, up, forum.zaps(acts, CFG), forum.downzaps(acts, CFG), CFG), CFG)
    cols = ["itemId", "userId", "created_at", "comments48", "sats48", "zappers48", "downsats48", "downzappers48", "n_uploads", "hasImageOrLink", "root_subName"]
    assert rows(got, *cols) == rows(want, *cols) and want.agg(F.max("comments48")).first()[0] > 9
    assert dict(got.dtypes)["comments48"] == "bigint"


def test_posts_store_root_items_only(spark, monkeypatch):
    seen = names(monkeypatch)
    entry.queries()["dt4_dt5_posts"](spark, SF)
    assert set(seen) == {"root_items", "slim_posts"} and not {"text", "title", "url"} & set(seen["slim_posts"].columns)


# ---------------------------------------------------------------- F8
def test_items_from_raw_acts(spark, raw):
    item, up, acts = raw
    got = forum.items(item, up, cfg=CFG, itemact=acts)
    want = forum.items(item, up, forum.zaps(acts, CFG), forum.downzaps(acts, CFG), CFG)
    assert rows(got, *want.columns) == rows(want, *want.columns) and got.columns == want.columns


def test_item_downzaps_are_not_stored(spark, monkeypatch):
    seen = names(monkeypatch)
    df = entry.queries()["dt4_items_downzaps"](spark, SF)
    assert not seen and "zappers48" not in df._jdf.queryExecution().optimizedPlan().toString().replace("downzappers48", "")


def test_events_in_a_window_by_parent(spark):
    ev = spark.createDataFrame([(1, T0, 2.0), (1, T0 + dt.timedelta(hours=49), 3.0), (None, T0, 5.0), (2, None, 7.0)], "k long, t timestamp, v double")
    pa = spark.createDataFrame([(1, T0, 10), (1, T0 + dt.timedelta(hours=1), 20), (2, T0, 30)], "k long, t0 timestamp, n int")
    near = attr.in_window(ev, pa, event_key="k", parent_key="k", event_time="t", parent_time="t0", carry=("n",))
    assert rows(near, "k", "v", "n") == [(1, 2.0, 10), (1, 2.0, 20), (1, 3.0, 20)]


# ---------------------------------------------------------------- F2
def test_pretrend_quality_stores_slim_posts(spark, monkeypatch):
    seen = names(monkeypatch)
    entry.queries()["dt22_pretrend_quality"](spark, SF)
    assert {"fee_posts", "quality_posts", "quality_sample"} <= set(seen) and not {"items", "posts"} & set(seen)
    assert set(seen["fee_posts"].columns) == {*q_derived.FEE_COLUMNS, "n_roots", "cost_modifier"}
    assert seen["quality_posts"].columns == ["itemId", "subName", "userId", "created_at", "cost", "sats48"]
