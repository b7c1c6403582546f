"""Panels made in the tasks against loops, and what the fee queries read and store."""
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.config import ForumConfig
from tallyspark.operators import panel
from tallyspark.plans import forum

CFG = ForumConfig(data_end="2021-12-29 00:00:00")
SUNDAY = dt.date(2021, 1, 3)
MONEY = ["tipped", "rewards", "referrals", "one_day_referrals", "stacked", "fees", "spent"]


def week(d):
    return d - dt.timedelta(days=(d.weekday() + 1) % 7)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    items, stats = [], []
    for user in [None, *range(1, 60)]:
        for _ in range(rng.choice([1, 1, 3])):
            items.append((user, dt.datetime(2021, 1, 1) + dt.timedelta(days=rng.randrange(420))))
        for _ in range(rng.choice([0, 1, 5, 40])):
            quiet = rng.random() < 0.3
            stats.append((user, SUNDAY + dt.timedelta(days=rng.randrange(-60, 420)), 0 if quiet else rng.randrange(3), 0 if quiet else 1,
                          *[0.0 if quiet else float(rng.randrange(100)) for _ in MONEY]))
    stats.append((999, SUNDAY, 1, 1, *[5.0] * len(MONEY)))  # no item: no rows
    i = spark.createDataFrame(items, "userId long, created_at timestamp")
    s = spark.createDataFrame(stats, "userId long, date date, posts long, comments long, " + ", ".join(f"sats_{c} double" for c in MONEY))
    return items, stats, i, s


def loop_panel(items, stats):
    """{(user, week): row} by plain loops."""
    first, sums, out = {}, {}, {}
    for u, t in items:
        first[u] = min(first.get(u, t), t)
    for u, d, *v in stats:
        if u is not None:
            k = (u, week(d))
            sums[k] = [a + b for a, b in zip(sums.get(k, [0] * len(v)), v)]
    last = week(dt.date(2021, 12, 29))
    codes = {}
    for u in sorted(first, key=lambda x: x or 0):
        rows, w = [], week(first[u].date())
        while w <= last:
            v = sums.get((u, w), [0] * (2 + len(MONEY)))
            m = dict(zip(MONEY, v[2:]))
            rows.append({"week": w, "posts": v[0], "comments": v[1], "activity": v[0] > 0 or v[1] > 0 or m["spent"] > 0,
                         "profit0": m["stacked"] - m["spent"],
                         "profit1": m["tipped"] + m["rewards"] + m["referrals"] + m["one_day_referrals"] - m["fees"]})
            codes.setdefault(w, len(codes))
            w += dt.timedelta(days=7)
        since = 0
        for n, r in enumerate(rows):
            since = 0 if n == 0 or r["activity"] else since + 1
            r["age"], r["since"], r["code"] = n + 1, since, codes[r["week"]]
            full = n >= 8
            r["roll1"] = sum(x["profit1"] for x in rows[n - 8:n]) if full else None
            r["rollp"] = sum(x["posts"] for x in rows[n - 8:n]) if full else None
        length = 0
        for n in range(len(rows) - 1, -1, -1):
            if rows[n]["activity"]:
                length = 0
            elif n == len(rows) - 1 or rows[n + 1]["activity"]:
                length = rows[n]["since"]
            rows[n]["length"] = length
        for r in rows:
            out[u or 0, r["week"]] = r
    return out


@pytest.mark.parametrize("made", [1, 7, 1 << 16])
def test_user_week_panel_is_the_loop(tables, made, monkeypatch):
    items, stats, i, s = tables
    monkeypatch.setattr(panel, "_ROWS", made)
    want = loop_panel(items, stats)
    rows = forum.user_week_panel(s, i, CFG).collect()
    assert len(rows) == len(want)
    for r in rows:
        w = want[r.userId, r.week]
        assert (r.account_age, r.weeks_since_last_activity, r.length_of_inactivity, r.activity, r.weekId) == (
            w["age"], w["since"], w["length"], w["activity"], w["code"])
        assert (r.posts, r.comments, r["items"], r.profit0, r.profit1) == (w["posts"], w["comments"], w["posts"] + w["comments"], w["profit0"], w["profit1"])
        assert (r.rolling_profit1, r.rolling_posts) == (w["roll1"], w["rollp"])


def test_null_user_joins_user_zero(tables, spark):
    """A NULL user's weeks are user 0's, beside the weeks of a user 0, whose columns they take."""
    _, _, _, s = tables
    i = spark.createDataFrame([(None, dt.datetime(2021, 11, 30)), (0, dt.datetime(2021, 12, 7)), (5, dt.datetime(2021, 12, 20))],
                              "userId long, created_at timestamp")
    u = spark.createDataFrame([(0, 7), (5, 8)], "userId long, x long")
    rows = forum.user_week_panel(s.where("userId > 900"), i, CFG, users_df=u).orderBy("userId", "account_age").collect()
    got = [(r.userId, r.week.day, r.account_age, r.weeks_since_last_activity, r.length_of_inactivity, r.x) for r in rows]
    days = [28, 5, 5, 12, 12, 19, 19, 26, 26]
    assert got == [(0, d, n + 1, n, 8, 7) for n, d in enumerate(days)] + [(5, 19, 1, 0, 1, 8), (5, 26, 2, 1, 1, 8)]


def test_user_week_panel_shuffles_its_input_only(tables, spark):
    """No window, sort or exchange above the rows of the panel: these are hundreds a user."""
    _, _, i, s = tables
    plan = forum.user_week_panel(s, i, CFG)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("MapInArrow")]
    # the window is that of the codes, a row a week, which are joined
    assert not [x for x in ("Sort", "Repartition", "Generate", "Aggregate", "Window") if x in above.split("ResolvedHint")[0]]


def test_users_columns_ride_along(tables, spark):
    items, _, i, s = tables
    u = spark.createDataFrame([(n, n * 10) for n in range(1, 40)], "userId long, tenfold long")
    got = forum.user_week_panel(s, i, CFG, users_df=u, columns=["tenfold", "posts"])
    assert got.columns == ["week", "userId", "posts", "tenfold", "weekId"]
    assert all(r.tenfold == (r.userId * 10 if 0 < r.userId < 40 else None) for r in got.collect())


def test_fee_posts_leave_out_what_they_do_not_need(spark, monkeypatch):
    """The fee queries store posts only, with the fee's columns; comments, zaps and downzaps stay unread."""
    from tallyspark.plans import q_derived
    seen = {}

    def held(df, name):
        seen[name] = df
        return q_derived_stored(df, name)
    q_derived_stored = q_derived.stored
    monkeypatch.setattr(q_derived, "stored", held)
    fo = q_derived.Forum(spark, "/root/testdata/sf0.001")
    mine = fo.fee_posts()
    assert "items" not in seen and "posts" not in seen
    zaps = "__s_sats48"  # the zaps' sats on the way to their item
    assert zaps in fo.unstored_items()._jdf.queryExecution().optimizedPlan().toString()
    assert not any(zaps in seen[n]._jdf.queryExecution().optimizedPlan().toString() for n in ("root_items", "fee_posts"))
    whole = q_derived.Forum(spark, "/root/testdata/sf0.001").posts().select(*mine.columns)
    assert mine.exceptAll(whole).isEmpty() and whole.exceptAll(mine).isEmpty()
