"""Loop-model tests: the study's row loops as plain Python, compared with the window forms."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallyspark.operators import scan
from tallyspark.operators import sequences as sq

T0 = datetime(2024, 1, 1)


def _rows(df, key):
    return {r[key]: r for r in df.collect()}


def burst_model(rows, gap, anon):
    """Sequential scan over (user, time, id) order; bio rows skipped; anon always 1."""
    rows = sorted(rows, key=lambda r: (r[1], r[2], r[0]))
    out = {r[0]: 0 for r in rows}
    cur_user, cur_time, mod = None, None, 0
    for rid, user, t, bio in rows:
        if bio:
            continue
        if user == anon:
            cur_user, cur_time, mod = user, t, 0
            out[rid] = 1
        if user != cur_user or (t - cur_time) > gap:
            cur_user, cur_time, mod = user, t, 0
            continue
        cur_time = t
        mod += 1
        out[rid] = mod
    return out


def test_burst_counter_matches_loop(spark):
    rng = random.Random(1)
    for trial in range(5):
        rows = []
        for rid in range(300):
            user = rng.randrange(8)
            t = T0 + timedelta(minutes=rng.choice([0, 5, 10, 11, 30, 600]) * rng.randrange(40))
            rows.append((rid, user, t, rng.random() < 0.15))
        df = spark.createDataFrame(rows, "id long, user long, t timestamp, bio boolean")
        got = _rows(sq.burst_counter(df, "user", "t", "id", 10 * 60 * 1_000_000, skip="bio", always_one=(3,)), "id")
        want = burst_model(rows, timedelta(minutes=10), 3)
        assert {k: v["cost_modifier"] for k, v in got.items()} == want


def smooth_model(groups):
    out = {}
    for key, vals in groups.items():
        v = list(vals)
        for i in range(1, len(v) - 1):
            if v[i] > v[i - 1] and v[i] > v[i + 1]:
                v[i] = v[i + 1]
            if v[i] < v[i - 1] and v[i] < v[i + 1]:
                v[i] = v[i + 1]
        for i, x in enumerate(v):
            out[(key, i)] = x
    return out


def test_extrema_smoothing_matches_loop(spark):
    rng = random.Random(2)
    groups = {k: [rng.choice([1, 5, 3, 9]) for _ in range(rng.randrange(1, 40))] for k in range(12)}
    groups[100] = [1, 5, 1, 5, 1]
    groups[101] = [5, 5, 1]
    rows = [(k, i, float(x)) for k, v in groups.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "k long, i long, fee double")
    got = {(r["k"], r["i"]): r["fee"] for r in sq.smooth_local_extrema(df, ["k"], ["i"], "fee").collect()}
    assert got == {k: float(v) for k, v in smooth_model(groups).items()}
    assert [got[(100, i)] for i in range(5)] == [1.0] * 5


def spells_model(acts):
    w, age = [], []
    for i, a in enumerate(acts):
        w.append(0 if i == 0 or a else w[-1] + 1)
        age.append(i + 1)
    ln = [0] * len(acts)
    cur = None
    for i in reversed(range(len(acts))):
        if i == len(acts) - 1:
            cur = w[i]
        elif acts[i]:
            cur = 0
        elif cur == 0:
            cur = w[i]
        ln[i] = cur
    return w, age, ln


def test_activity_spells_match_loops(spark):
    rng = random.Random(3)
    users = {u: [rng.random() < 0.3 for _ in range(rng.randrange(1, 25))] for u in range(40)}
    users[100] = [False] * 6
    users[101] = [False]
    users[102] = [False, False, True, False]
    rows = [(u, i, a) for u, v in users.items() for i, a in enumerate(v)]
    df = spark.createDataFrame(rows, "u long, p long, act boolean")
    got = {(r["u"], r["p"]): r for r in sq.activity_spells(df, "u", "p", "act").collect()}
    for u, v in users.items():
        w, age, ln = spells_model(v)
        for i in range(len(v)):
            r = got[(u, i)]
            assert (r["weeks_since_last_activity"], r["account_age"], r["length_of_inactivity"]) == (w[i], age[i], ln[i])


def test_strictly_prior_totals_match_quadratic_scan(spark):
    rng = random.Random(4)
    posts = [(i, rng.randrange(5), T0 + timedelta(hours=rng.randrange(200)), rng.random() < 0.4) for i in range(120)]
    zaps = []
    for j in range(400):
        p = rng.choice(posts)
        zaps.append((p[1], T0 + timedelta(hours=rng.randrange(200)), float(rng.randrange(1, 50)), p[3]))
    pdf = spark.createDataFrame(posts, "itemId long, userId long, created_at timestamp, hi boolean")
    zdf = spark.createDataFrame(zaps, "poster long, zt timestamp, sats double, zhi boolean")
    got = _rows(sq.strictly_prior_totals(pdf, zdf, "userId", "created_at", "hi", "sats", "poster", "zt", "zhi"),
                "itemId")
    for i, u, t, hi in posts:
        r = got[i]
        assert r["prior_zaps"] == sum(s for pu, zt, s, h in zaps if pu == u and zt < t)
        assert r["prior_zaps_from_hi_quality"] == sum(s for pu, zt, s, h in zaps if pu == u and zt < t and h)
        assert r["prior_posts"] == sum(1 for _, pu, pt, _ in posts if pu == u and pt < t)
        assert r["prior_hi_quality_posts"] == sum(1 for _, pu, pt, ph in posts if pu == u and pt < t and ph)


def prior_model(rows, cats, decay=None):
    """rows sorted by (t, id): (id, user, t, cat, y). Returns id -> {cat: value} for the
    uniform-since-first-post variant (decay None) or the global decayed variant."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    first = {}
    for _, u, t, _, _ in rows:
        first.setdefault(u, t)
    out = {}
    for idx, (i, u, t, c, y) in enumerate(rows):
        vals = {}
        for k in cats:
            num = den = 0.0
            for j in range(idx):
                _, _, tj, cj, yj = rows[j]
                if cj != k:
                    continue
                if decay is None:
                    if tj < first[u]:
                        continue
                    w = 1.0
                else:
                    w = math.exp(-decay * (t - tj).total_seconds())
                num += w * yj
                den += w
            vals[k] = num / den if den > 0 else None
        out[i] = vals
    return out


def test_prior_category_means_match_models(spark):
    rng = random.Random(5)
    cats = [0, 1, 2]
    rows = [(i, rng.randrange(6), T0 + timedelta(days=rng.randrange(60)), rng.choice(cats), rng.random() * 3)
            for i in range(150)]
    df = spark.createDataFrame(rows, "id long, user long, t timestamp, cat long, y double")
    for decay_days in (None, 28.0):
        res = sq.prior_category_means(df, "user", "t", "id", "cat", "y", cats, decay_half_life_days=decay_days,
                                      since_user_first=decay_days is None)
        got = _rows(res, "id")
        lam = None if decay_days is None else math.log(2) / (decay_days * 86400)
        want = prior_model(rows, cats, lam)
        for i, vals in want.items():
            for k, v in vals.items():
                g = got[i][f"prior_mean_{k}"]
                if v is None:
                    assert g is None
                else:
                    assert abs(g - v) < 1e-9 * max(1, abs(v))


def test_asof_join_matches_bisect(spark):
    import bisect
    rng = random.Random(6)
    right = sorted({(rng.randrange(4), T0 + timedelta(seconds=rng.randrange(5 * 86400))) for _ in range(300)})
    left = [(i, rng.randrange(4), T0 + timedelta(seconds=rng.randrange(-3600, 5 * 86400))) for i in range(400)]
    left += [(1000 + i, k, t) for i, (k, t) in enumerate(right[:20])]  # exact matches
    rdf = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(right)], "k long, rt timestamp, n long")
    ldf = spark.createDataFrame(left, "id long, k long, t timestamp")
    got = _rows(scan.asof_join(ldf, rdf, ["k"], "t", "rt", ["n"]), "id")
    for i, k, t in left:
        times = [rt for kk, rt in right if kk == k]
        pos = bisect.bisect_right(times, t)
        want = None if pos == 0 else [n for n, (kk, rt) in enumerate(right) if kk == k][pos - 1]
        assert got[i]["n"] == want


def test_prefix_sums_global_matches_cumsum(spark):
    rng = random.Random(7)
    rows = [(i, T0 + timedelta(hours=rng.randrange(24 * 20)), float(rng.randrange(100))) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, t timestamp, v double")
    got = _rows(scan.prefix_sums(df, [], "t", {"before": F.col("v")}, strict=False, tiebreak=["id"]), "id")
    acc = 0.0
    for i, t, v in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[i]["before"] == acc
        acc += v


def kernel_model(rows, cats, hl=3 * 3600.0, period=86400.0):
    """Brute force: for each post, every earlier post since the user's first one, exact kernel."""
    rows = sorted(rows, key=lambda r: (r[2], r[0]))
    sigma = hl / math.log(2)
    first, sods = {}, {}
    for _, u, t, _, _ in rows:
        first.setdefault(u, t)
        sods.setdefault(u, []).append(t.hour * 3600 + t.minute * 60 + t.second)
    peak = {u: sum(v) / len(v) for u, v in sods.items()}
    out = {}
    for idx, (i, u, t, c, y) in enumerate(rows):
        vals = {}
        for k in cats:
            num = den = 0.0
            for j in range(idx):
                _, _, tj, cj, yj = rows[j]
                if cj != k or tj < first[u]:
                    continue
                s = tj.hour * 3600 + tj.minute * 60 + tj.second
                dd = (peak[u] - s + period / 2) % period - period / 2
                w = math.exp(-(dd / sigma) ** 2)
                num += w * yj
                den += w
            vals[k] = num / den if den > 0 else None
        out[i] = vals
    return out


def test_kernel_prior_means_match_brute_force(spark):
    rng = random.Random(8)
    cats = [0, 1]
    rows = [(i, rng.randrange(5), T0 + timedelta(seconds=rng.randrange(20 * 86400)), rng.choice(cats),
             rng.random() * 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, user long, t timestamp, cat long, y double")
    got = _rows(sq.kernel_prior_category_means(df, "user", "t", "id", "cat", "y", cats, tolerance=1e-4), "id")
    want = kernel_model(rows, cats)
    for i, vals in want.items():
        for k, v in vals.items():
            g = got[i][f"prior_kernel_mean_{k}"]
            if v is None:
                assert g is None
            else:
                assert abs(g - v) < 2e-3 * max(1.0, abs(v))


# ---- rows with NULL keys, first rows, fee changes, owners ---------------------------------------------------------

def test_null_users_are_kept(spark):
    rows = [(1, 7, T0), (2, 7, T0 + timedelta(minutes=5)), (3, None, T0), (4, None, T0 + timedelta(days=2)),
            (5, None, T0 + timedelta(days=2, minutes=3))]
    df = spark.createDataFrame(rows, "id long, user long, t timestamp")
    got = {r["id"]: r["cost_modifier"] for r in sq.burst_counter(df, "user", "t", "id", 10 * 60 * 1_000_000).collect()}
    assert got == {1: 0, 2: 1, 3: 0, 4: 0, 5: 1}
    seq = {r["id"]: r["experience_posts"] for r in sq.sequence_number(df, "user", "t", "id").collect()}
    assert seq == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2}
    ch = sq.count_changes(df.withColumn("v", F.col("id") % 2), ["user"], ["t", "id"], "v").collect()
    assert {r["user"]: r["n_changes"] for r in ch} == {7: 1, None: 2}
    sp = sq.constant_spells(df.withColumn("v", F.col("id") % 2), ["user"], "t", "v", F.lit(T0 + timedelta(days=9)), ["id"])
    assert sorted((r["user"] or 0, r["spell_value"]) for r in sp.collect()) == [(0, 0), (0, 1), (0, 1), (7, 0), (7, 1)]


def test_lagged_running_first_row_is_null(spark):
    rows = [(1, 7, T0, 2.0), (2, 7, T0 + timedelta(days=1), 4.0), (3, 7, T0 + timedelta(days=2), 1.0)]
    df = spark.createDataFrame(rows, "id long, user long, t timestamp, x double")
    got = {r["id"]: r for r in sq.lagged_running(df, "user", ["t", "id"], "x").collect()}
    assert got[1]["prior_mean_x"] is None and got[1]["log_prior_x"] is None and got[1]["prior_n"] is None
    assert math.isclose(got[3]["log_prior_x"], math.log(1 + 2.0 + 4.0)) and got[3]["prior_mean_x"] == 3.0
    assert got[3]["prior_n"] == 2 and math.isclose(got[3]["log_prior_n"], math.log(3))


def test_two_fee_changes_in_one_week(spark):
    from tallyspark.plans import forum
    fees = [10.0, 12.0, 11.0] + [11.0] * 11
    df = spark.createDataFrame([("a", datetime(2024, 1, 7) + timedelta(days=i), f) for i, f in enumerate(fees)],
                               "subName string, date timestamp, fee double")
    got = forum.event_study_sample(df, "subName", "date", "fee", k=1).orderBy("week").collect()
    assert [(r["fee_chg_pos"], r["fee_chg_neg"], r["fee_chg_pos_L1"], r["fee_chg_pos_F1"]) for r in got] == \
        [(1, 1, None, 0), (0, 0, 1, None)]


def test_fee_spells_end_at_the_date(spark):
    from tallyspark.plans import forum
    fees = spark.createDataFrame([("a", T0, 5.0)], "subName string, date timestamp, posting_fee double")
    posts = spark.createDataFrame([("a", T0 + timedelta(hours=1), 1)], "subName string, created_at timestamp, itemId long")
    end = F.lit(T0 + timedelta(days=3, hours=7)).cast("timestamp")
    r = forum.fee_spells(fees, posts, end).first()
    assert r["days"] == 3.0 and r["n_posts"] == 1


def test_quantile_with_one_value_holding_half(spark):
    from tallyspark.operators.quantile import exact_quantile
    import numpy as np
    x = [3.0] * 500 + [float(i) for i in range(499)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    for q in (0.0, 0.25, 0.5, 0.731, 1.0):
        assert exact_quantile(df, "x", q) == np.quantile(x, q)


def test_two_chained_effects_are_recovered(spark):
    """Exact-fit data whose effects meet in one chain: the slowest case for the sweeps."""
    import numpy as np
    from tallyspark.estimators import linear
    a, b = {i: 0.5 * i for i in range(6)}, {i: (-1.0) ** i for i in range(6)}
    rows = [(i, j, a[i] + b[j]) for i in range(6) for j in (i, i + 1) if j < 6]
    df = spark.createDataFrame(rows, "f long, g long, y double")
    fit = linear.Fit("m", [], np.zeros(0), np.zeros((0, 0)), 0, 0.0, 0)
    eff = linear.fixed_effects(df, fit, "y", ["f", "g"], tol=1e-7)
    ef, eg = ({r[k]: r["effect"] for r in eff[k].collect()} for k in ("f", "g"))
    assert max(abs(ef[i] + eg[j] - y) for i, j, y in rows) < 1e-5
    assert abs(sum(eg.values())) < 1e-9


def test_no_convergence_is_an_error(spark):
    import pytest
    from tallyspark.operators.graph import connected_components
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "src long, dst long")
    with pytest.raises(RuntimeError, match="still change"):
        connected_components(edges, max_rounds=1)


def test_stream_reads_a_folder_of_part_files(spark, tmp_path):
    from tallyspark.sources.tables import read_table
    from tallyspark.streaming import jobs
    events = read_table(spark, "/root/testdata/sf0.001", "events")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    out = jobs.run_available_now(jobs.table_stream(spark, str(tmp_path), "events").select("event_id"))
    assert spark.read.parquet(out).count() == events.count()
