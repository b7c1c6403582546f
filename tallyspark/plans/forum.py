"""Derived tables of the forum study (DT1-DT24), one function per table.

Inputs use the raw forum schema (``item``, ``itemact``, ``itemupload``, ``sub``,
``subact``, ``territorytransfer``, ``user_stats_days``, ...; see FIXTURES.md).
Each function returns a lazy DataFrame with the declared grain; nothing is
collected.  Materialise with :func:`tallyspark.sources.io.materialize` where a
table is reused (the study caches the same tables).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, ForumConfig
from ..functions import predicates as pr
from ..functions import textfn as tx
from ..functions import timefn as tf
from ..operators import aggregates as ag
from ..operators import attribution as attr
from ..operators import intervals, panel, scan
from ..operators import sequences as sq
from ..session import cut_lineage, stored


def _ts(s: str) -> Column:
    return F.lit(s).cast("timestamp")


def factorize(df: DataFrame, col: str, order: list[str], out: str, *, rows: DataFrame | None = None,
              calendar: bool = False) -> DataFrame:
    """Integer codes by first appearance in ``order`` (pandas ``factorize``), NULL -> -1 (N9).

    The code table has one row per distinct value; its window is over that
    small table only.  It may be taken from other ``rows`` with the same values
    and order; one of calendar periods is broadcast.
    """
    first = (df if rows is None else rows).where(F.col(col).isNotNull()).groupBy(col).agg(F.min(F.struct(*order)).alias("__first"))
    codes = first.select(col, (F.dense_rank().over(Window.orderBy("__first")) - 1).alias(out))
    return df.join(F.broadcast(codes) if calendar else codes, col, "left").fillna({out: -1})


# ---------------------------------------------------------------- DT1-DT3
def territories(sub: DataFrame, item: DataFrame) -> DataFrame:
    """DT1 (subName): lower-cased name, birth = min(declared, first item), current owner."""
    s = sub.select(F.lower("name").alias("subName"), "created_at", F.col("userId").alias("currentOwner"))
    i = item.select(F.lower(F.coalesce("subName", F.lit(""))).alias("subName"), "created_at")
    return ag.entity_birth(s.withColumnRenamed("created_at", "declared"), i, "subName", "declared",
                           "created_at").drop("declared")


def territory_transfers(terr: DataFrame, transfer: DataFrame) -> DataFrame:
    """DT2 (subName, timeStamp): synthetic first-owner row plus every transfer."""
    t = transfer.select(F.lower("subName").alias("subName"), "created_at", "oldUserId", "newUserId")
    return ag.ownership_history(terr, t)


def billing_cycles(subact: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT3 (subName, userId, billing_cycle_start): tier by price and cut-over, calendar end."""
    b = (subact.where(F.col("type") == "BILLING")
         .select(F.lower("subName").alias("subName"), "userId", (F.col("msats") / 1000).alias("sats"),
                 F.col("created_at").alias("billing_cycle_start")))
    b = b.withColumn("period", pr.billing_period("billing_cycle_start", "sats", cfg.sub_cost_drop_date,
                                                 cfg.sub_cost_monthly_pre, cfg.sub_cost_yearly_pre,
                                                 cfg.sub_cost_monthly_post, cfg.sub_cost_yearly_post))
    return b.withColumn("billing_cycle_end", pr.period_end("billing_cycle_start", "period", key="subName",
                                                           override_keys=cfg.perpetual_override_subs))


# ---------------------------------------------------------------- DT9, DT10
def zaps(itemact: DataFrame, cfg: ForumConfig = DEFAULT, carry: tuple = ()) -> DataFrame:
    """DT9 (itemId, userId, zap_time), also by the columns ``carry`` that were joined to the acts."""
    return attr.collapse_acts(itemact, ["itemId", "userId", *carry, "created_at"], "act", F.col("msats") / 1000,
                              state_col="invoiceActionState", failed=cfg.failed_state, time_name="zap_time")


def downzaps(itemact: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT10 (itemId, userId, downzap_time)."""
    d = attr.collapse_single_act(itemact, ["itemId", "userId", "created_at"], "act", F.col("msats") / 1000,
                                 "DONT_LIKE_THIS", "downzap_sats", state_col="invoiceActionState",
                                 failed=cfg.failed_state)
    return d.withColumnRenamed("created_at", "downzap_time")


# ---------------------------------------------------------------- DT4-DT6
def acts_near(itemact: DataFrame, parents: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """The acts on ``parents`` up to 48 hours after them."""
    return attr.in_window(itemact, parents, event_key="itemId", parent_key="itemId", event_time="created_at",
                          parent_time="created_at", hours=cfg.attribution_hours)


def zaps48(itemact: DataFrame, parents: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """The 48-hour sats and zappers of ``parents`` (itemId), from the raw acts."""
    return attr.totals(zaps(acts_near(itemact, parents, cfg), cfg), "itemId", sums={"sats48": "sats"}, distinct=("zappers48", "userId"))


def downzaps48(itemact: DataFrame, parents: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """The 48-hour downzaps of ``parents`` (itemId), from the raw acts."""
    return attr.totals(downzaps(acts_near(itemact, parents, cfg), cfg), "itemId", sums={"downsats48": "downzap_sats"},
                       distinct=("downzappers48", "userId"))


def items(item: DataFrame, itemupload: DataFrame, zap: DataFrame | None = None, downzap: DataFrame | None = None,
          cfg: ForumConfig = DEFAULT, *, itemact: DataFrame | None = None) -> DataFrame:
    """DT4 (itemId): root attributes, uploads, link flag, 48-hour sats and zappers (up and down).

    Zaps and downzaps are given collapsed, or as the raw acts (``itemact``), which are then cut to the 48 hours first and move once."""
    it = (item.withColumn("subName", F.lower("subName"))
          .withColumn("saloon", F.coalesce(F.col("title") == cfg.saloon_title, F.lit(False))))
    roots = it.where(F.col("parentId").isNull()).select(
        F.col("itemId").alias("rootId"), F.col("subName").alias("root_subName"),
        F.col("saloon").alias("root_is_saloon"))
    it = it.join(roots, "rootId", "left")
    up = itemupload.groupBy("itemId").agg(F.count("uploadId").alias("n_uploads"))
    it = attr.attach(it, up, "itemId", {"n_uploads": 0})
    it = it.withColumn("hasImageOrLink", tx.has_image_or_link("text"))
    h = cfg.attribution_hours
    if itemact is not None:
        up48, dn48 = zaps48(itemact, it, cfg), downzaps48(itemact, it, cfg)
    else:
        up48 = attr.windowed_attribution(zap, it, event_key="itemId", parent_key="itemId", event_time="zap_time",
                                         parent_time="created_at", hours=h, sums={"sats48": "sats"},
                                         distinct=("zappers48", "userId"))
        dn48 = attr.windowed_attribution(downzap, it, event_key="itemId", parent_key="itemId",
                                         event_time="downzap_time", parent_time="created_at", hours=h,
                                         sums={"downsats48": "downzap_sats"}, distinct=("downzappers48", "userId"))
    it = attr.attach(it, up48, "itemId", {"sats48": 0.0, "zappers48": 0})
    return attr.attach(it, dn48, "itemId", {"downsats48": 0.0, "downzappers48": 0})


def root_items(item: DataFrame, itemupload: DataFrame, cfg: ForumConfig = DEFAULT, *, measured: Column | None = None) -> DataFrame:
    """The root items of DT4 (:func:`items`) without the 48-hour measures, and ``n_roots``: how many have the item's id.

    A root's root is itself, so root attributes are those of the rows with its id, which lie together once they are dealt by it
    for the uploads, and texts stay behind.  An id that several roots have gives a row for each pair of them, as there.
    ``measured``: only the root items for which this holds, with their text metrics."""
    it = (item.where(F.col("parentId").isNull()).withColumn("subName", F.lower("subName"))
          .withColumn("saloon", F.coalesce(F.col("title") == cfg.saloon_title, F.lit(False)))
          .withColumn("hasImageOrLink", tx.has_image_or_link("text")))
    if measured is not None:  # texts of the others are not measured
        it = text_metrics(it.withColumn("text", F.when(measured, F.col("text"))))
    it = it.drop("text")
    cols = it.columns
    own = F.struct(F.col("subName").alias("root_subName"), F.col("saloon").alias("root_is_saloon"))
    it = it.withColumn("__roots", F.when(F.col("itemId").isNotNull(), F.collect_list(own).over(Window.partitionBy("itemId"))))
    it = it.select(*cols, F.when(F.col("__roots").isNotNull(), F.size("__roots")).otherwise(1).alias("n_roots"), F.explode_outer("__roots").alias("__root"))
    it = it.select(*cols, "__root.*", "n_roots")
    if measured is not None:
        it = it.where(measured)
    up = itemupload.groupBy("itemId").agg(F.count("uploadId").alias("n_uploads"))
    return attr.attach(it, up, "itemId", {"n_uploads": 0})


def measured_posts(posts_df: DataFrame, roots: DataFrame, item: DataFrame, itemact: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """Posts with the 48-hour measures of DT4 and DT5 (:func:`items`, :func:`posts`).

    ``posts_df`` are all or some of ``roots`` (:func:`root_items`), whose acts and comments are counted; comments are read with their root and
    time only.  An item's id is its key: no comment has that of a post.  A comment counts once for each root of its root's id, as there.
    A measure that is not asked for is not made, as its rows are one an item."""
    c = comments(item).where(pr.not_failed("invoiceActionState", cfg.failed_state))
    c = attr.in_window(c, roots, event_key="rootId", parent_key="itemId", event_time="created_at", parent_time="created_at",
                       hours=cfg.attribution_hours, carry=("n_roots",))
    c48 = c.groupBy(F.col("rootId").alias("itemId")).agg(F.sum("n_roots").cast("bigint").alias("comments48"))
    p = attr.attach(posts_df, zaps48(itemact, roots, cfg), "itemId", {"sats48": 0.0, "zappers48": 0})
    p = attr.attach(p, downzaps48(itemact, roots, cfg), "itemId", {"downsats48": 0.0, "downzappers48": 0})
    return attr.attach(p, c48, "itemId", {"comments48": 0})


def comments(items_df: DataFrame) -> DataFrame:
    """DT6 (itemId): items with a parent."""
    return items_df.where(F.col("parentId").isNotNull())


def posts(items_df: DataFrame, cfg: ForumConfig = DEFAULT, root_items: DataFrame | None = None) -> DataFrame:
    """DT5 (itemId): root items with the burst cost modifier and 48-hour comment counts.  ``root_items``: the root items, if
    they are at hand (the burst scan reads them several times)."""
    p = items_df.where(F.col("parentId").isNull()) if root_items is None else root_items
    p = sq.burst_counter(p, "userId", "created_at", "itemId", cfg.burst_gap_minutes * 60 * 1_000_000,
                         skip="bio", always_one=(cfg.anon_id,))
    c = comments(items_df).where(pr.not_failed("invoiceActionState", cfg.failed_state))
    c48 = attr.windowed_attribution(c, p, event_key="rootId", parent_key="itemId", event_time="created_at",
                                    parent_time="created_at", hours=cfg.attribution_hours,
                                    count_name="comments48")
    return attr.attach(p, c48, "itemId", {"comments48": 0})


def find_subowner(df: DataFrame, transfers: DataFrame, time_col: str = "created_at") -> DataFrame:
    """JN4: the territory owner at ``time_col`` (both times cut to whole seconds, N14)."""
    right = transfers.select("subName", F.col("timeStamp").alias("__t"), F.col("userIdTo").alias("subOwner"))
    return scan.asof_join(df, right, ["subName"], time_col, "__t", ["subOwner"], truncate_seconds=True)


# ---------------------------------------------------------------- DT7, DT8
def fee_eligible_posts(posts_df: DataFrame, transfers: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """PRJ7 (itemId): the fee-eligible posts.  The owner is looked up for the posts that the eleven conjuncts on a post's own
    columns leave, and only the columns needed go through the look-up."""
    p = posts_df.where(pr.fee_eligible(cfg, is_owner=F.lit(False))).select("itemId", "subName", "userId", "created_at", "cost")
    p = find_subowner(p, transfers)
    p = p.withColumn("user_is_subOwner", F.coalesce(F.col("userId") == F.col("subOwner"), F.lit(False)))
    return p.where(~F.col("user_is_subOwner"))


def fee_history(posts_df: DataFrame, transfers: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT7 (subName, date): daily minimum fee of fee-eligible posts, local extrema smoothed."""
    p = fee_eligible_posts(posts_df.where(F.col("subName").isNotNull()), transfers, cfg)
    fees = p.groupBy("subName", tf.as_date("created_at").alias("date")).agg(F.min("cost").alias("posting_fee"))
    return sq.smooth_local_extrema(fees, ["subName"], ["date"], "posting_fee")


def territory_day_panel(fees: DataFrame, posts_df: DataFrame, cycles: DataFrame, transfers: DataFrame,
                        cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT8 (subName, date): calendar from each territory's first post to the data end, billing cycle
    as of the day (days past a cycle end with no posts are dropped, a NULL end is never past),
    daily posts, fee as of the day then back-filled, owner as of the day then back-filled."""
    p = posts_df.withColumn("subName", F.coalesce("subName", F.lit("")))
    sk = panel.skeleton(p, "subName", "created_at", step="day", end=cfg.data_end, out="date")
    start = tf.as_date(_ts(cfg.data_start))
    sk = sk.where(F.col("date") >= start)
    cyc = cycles.select(F.coalesce("subName", F.lit("")).alias("subName"),
                        tf.as_date("billing_cycle_start").alias("billing_cycle_start"),
                        tf.as_date("billing_cycle_end").alias("billing_cycle_end"))
    sk = sk.withColumn("__dt", F.col("date").cast("timestamp"))
    cyc = cyc.withColumn("__ct", F.col("billing_cycle_start").cast("timestamp"))
    t = scan.asof_join(sk, cyc, ["subName"], "__dt", "__ct", ["billing_cycle_end"],
                       right_order=["billing_cycle_end"])
    n = (p.where(pr.not_failed("invoiceActionState", cfg.failed_state))
         .groupBy("subName", tf.as_date("created_at").alias("date")).agg(F.count("itemId").alias("n_posts")))
    t = attr.attach(t, n, ["subName", "date"], {"n_posts": 0})
    past = pr.is_true(F.col("date") > F.col("billing_cycle_end"))
    t = t.where(~(past & (F.col("n_posts") == 0))).drop("billing_cycle_end")
    t = t.where(F.col("subName") != "")
    # a scan's plan holds its input twice, so chained scans start from checkpoints (of panel rows)
    t = cut_lineage(panel.keep_groups_with_total(t, ["subName"], "n_posts", 0))
    f = fees.withColumn("__ft", F.col("date").cast("timestamp")).select("subName", "__ft", "posting_fee")
    t = scan.asof_join(t, f, ["subName"], "__dt", "__ft", ["posting_fee"])
    t = scan.backfill(t, ["subName"], ["date"], ["posting_fee"]).where(F.col("posting_fee").isNotNull())
    t = find_subowner(cut_lineage(t), transfers, "__dt")
    t = scan.backfill(t, ["subName"], ["date"], ["subOwner"])
    return t.drop("__dt")


# ---------------------------------------------------------------- DT11-DT14
def price_daily(raw: DataFrame) -> DataFrame:
    """DT11: renamed daily prices with the mid price."""
    return raw.select("timeOpen", "timeClose", F.col("open").alias("price_open"),
                      F.col("close").alias("price_close"), F.col("low").alias("price_low"),
                      ((F.col("low") + F.col("high")) / 2).alias("price_mid"), F.col("high").alias("price_high"))


def price_weekly(daily: DataFrame) -> DataFrame:
    return daily.groupBy(tf.as_week("timeOpen").alias("week")).agg(F.avg("price_mid").alias("btc_price"))


STAT_COLS = ("tipped", "rewards", "referrals", "one_day_referrals", "revenue", "stacked", "fees", "donated",
             "billing", "zaps", "spent")


def user_stats_days(raw: DataFrame) -> DataFrame:
    """DT13 (userId, date): msats columns to sats, NULL to 0."""
    d = raw.where(F.col("id").isNotNull()).select(
        F.col("id").alias("userId"), tf.as_date("t").alias("date"), "posts", "comments",
        *[(F.col(f"msats_{c}") / 1000).alias(f"sats_{c}") for c in STAT_COLS if f"msats_{c}" in raw.columns])
    return d.fillna(0)


def users(items_df: DataFrame, cfg: ForumConfig = DEFAULT, withdrawal: DataFrame | None = None,
          itemact: DataFrame | None = None, invoice: DataFrame | None = None,
          wallet: DataFrame | None = None, walletprotocol: DataFrame | None = None) -> DataFrame:
    """DT12 (userId): first item, post/comment counts, first auto-withdrawal, first p2p tip,
    wallet lists by priority."""
    it = items_df.where(pr.not_failed("invoiceActionState", cfg.failed_state))
    u = it.groupBy("userId").agg(F.min("created_at").alias("first_item_date"),
                                 F.count_if(F.col("parentId").isNull()).alias("n_posts"),
                                 F.count_if(F.col("parentId").isNotNull()).alias("n_comments"))
    if withdrawal is not None:
        w = (withdrawal.where(F.col("autoWithdraw") & (F.col("status") == "CONFIRMED"))
             .groupBy("userId").agg(F.min("created_at").alias("first_autowithdraw_date")))
        u = u.join(w, "userId", "left")
    if itemact is not None and invoice is not None:
        inv = invoice.select(F.col("id").alias("invoiceId"), "confirmedAt")
        z = (itemact.join(inv, "invoiceId", "left")
             .where(F.col("invoiceId").isNotNull() & F.col("confirmedAt").isNotNull() & (F.col("act") == "TIP"))
             .groupBy("userId").agg(F.min("created_at").alias("first_p2p_zap_date")))
        u = u.join(z, "userId", "left")
    if wallet is not None and walletprotocol is not None:
        send = (walletprotocol.where(F.col("send")).groupBy("walletId").agg(F.bool_or("send").alias("can_send")))
        wl = wallet.join(send, "walletId", "left").fillna({"can_send": False})
        g = wl.groupBy("userId").agg(F.array_sort(F.collect_list(
            F.struct("priority", "walletId", "walletName", "can_send"))).alias("__w"))
        names = F.transform("__w", lambda s: s["walletName"])
        sends = F.transform(F.filter("__w", lambda s: s["can_send"]), lambda s: s["walletName"])
        g = g.select("userId", F.element_at("__w", 1)["walletName"].alias("main_wallet"),
                     F.concat_ws(",", sends).alias("send_wallets"), F.concat_ws(",", names).alias("wallets"),
                     F.size("__w").alias("n_wallets"), F.size(sends).alias("n_send_wallets"))
        u = u.join(g, "userId", "left").fillna({"main_wallet": "", "send_wallets": "", "wallets": "",
                                                "n_wallets": 0, "n_send_wallets": 0})
    return u


def user_week_panel(stats: DataFrame, items_df: DataFrame, cfg: ForumConfig = DEFAULT,
                    window: int = 8, lag: int = 1, step: str = "week", users_df: DataFrame | None = None,
                    columns: list[str] | None = None) -> DataFrame:
    """DT14 (userId, week): skeleton from the user's first item to the data end, weekly sums,
    activity, weeks since activity, inactive-spell length, two profit measures, lagged rolling
    sums and a first-appearance week code.  ``step='day'`` builds the user x day variant.

    The panel has hundreds of rows a user, most without activity, so only the weekly sums and one row a user are
    shuffled (:func:`panel.filled`).  ``users_df``: columns of the user (one row each) that its rows carry on;
    ``columns``: those wanted beside user, week and code (all, if not given)."""
    trunc = tf.as_week if step == "week" else tf.as_date
    sp = panel.spans(items_df, "userId", "created_at", step=step, end=cfg.data_end)
    num = [c for c in stats.columns if c not in ("userId", "date")]
    wk = stats.groupBy("userId", trunc(F.col("date").cast("timestamp")).alias("week")).agg(
        *[F.sum(c).alias(c) for c in num])

    def add(c, place):
        active = (c["comments"] > 0) | (c["posts"] > 0) | (c["sats_spent"] > 0)
        sums = {"profit0": c["sats_stacked"] - c["sats_spent"],
                "profit1": c["sats_tipped"] + c["sats_rewards"] + c["sats_referrals"] + c["sats_one_day_referrals"] - c["sats_fees"],
                "posts": c["posts"], "items": c["posts"] + c["comments"]}
        return {"activity": pa.array(active), "items": pa.array(sums["items"]), **sq.activity_spells_along(active, place),
                "profit0": pa.array(sums["profit0"]), "profit1": pa.array(sums["profit1"]),
                **panel.rolling_sums_along(sums, place, window, lag)}

    kind = {f.name: f.dataType.simpleString() for f in wk.schema}
    count = kind["posts"]
    carried = sp
    if users_df is not None:  # a NULL user is the panel's user 0
        carried = (sp.withColumn("__user", F.col("userId")).fillna(0, subset=["__user"])
                   .join(users_df.withColumnRenamed("userId", "__user"), "__user", "left").drop("__user"))
    df = panel.filled(carried, wk, "userId", step, "week", add,
                      f"activity boolean, items {count}, account_age int, weeks_since_last_activity int, length_of_inactivity int, "
                      f"profit0 double, profit1 double, rolling_profit0 double, rolling_profit1 double, rolling_posts {count}, rolling_items {count}", columns)
    # a week is first met with the least user that has it: one span for all users with the same one is enough
    least = sp.fillna(0, subset=["userId"]).groupBy("__first", "__last").agg(F.min("userId").alias("userId"))
    weeks = panel.periods(least, "userId", step, "week")
    return factorize(df, "week", ["userId", "week"], "weekId", rows=weeks, calendar=True)


# ---------------------------------------------------------------- DT15-DT18
#: What :func:`text_metrics` adds.
TEXT_METRICS = ("num_img_or_links", "num_words", "is_link_post", "link_only")


def text_metrics(df: DataFrame, text: str = "text", url: str = "url") -> DataFrame:
    return (df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
            .withColumn("num_img_or_links", tx.count_image_or_links(text))
            .withColumn("num_words", tx.word_count(text))
            .withColumn("is_link_post", tx.is_link_post(url))
            .withColumn("link_only", tx.link_only(url, text)))


def quality_posts(posts_df: DataFrame, cfg: ForumConfig = DEFAULT, data_end: Column | None = None) -> DataFrame:
    """The posts of DT15 as far as their own columns tell."""
    return posts_df.where(in_quality_sample(cfg, data_end))


def in_quality_sample(cfg: ForumConfig = DEFAULT, data_end: Column | None = None) -> Column:
    return pr.analysis_sample(cfg, data_end=data_end) & (F.col("cost") > 0)


def in_v4v_sample(cfg: ForumConfig = DEFAULT, data_end: Column | None = None) -> Column:
    return pr.analysis_sample(cfg, data_end=data_end, title="title")


def post_quality_sample(posts_df: DataFrame, transfers: DataFrame, weekly_prices: DataFrame, cfg: ForumConfig = DEFAULT,
                        data_end: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """DT15 (itemId): analysis sample, owner at post time, poster not owner, positive cost,
    weekly price, territory/week/territory-owner codes, text metrics.

    Texts, if they were not yet, are measured before the rows move for the owner's look-up, and only the sample's rows are stored: before it, as it
    looks at them twice, and after it, as the codes do.  ``columns``: columns of the posts wanted beside item, territory, user,
    time and cost (all, if not given)."""
    p = quality_posts(posts_df, cfg, data_end)
    if "text" in p.columns:
        p = text_metrics(p)
    if columns is not None:
        p = p.select(*dict.fromkeys(["itemId", "subName", "userId", "created_at", "cost", *columns]))
    p = find_subowner(stored(p, "quality_posts"), transfers)
    # a post of a territory without a known owner is nobody's own (rule N1: a comparison with NULL is "differs")
    p = stored(p.where(~pr.is_true(F.col("userId") == F.col("subOwner"))), "quality_sample")
    p = p.withColumn("week", tf.as_week("created_at")).withColumn(
        "sub_subOwner", F.concat_ws("_", "subName", F.coalesce(F.col("subOwner").cast("string"), F.lit("nan"))))
    order, rows = ["created_at", "itemId"], p
    p = p.join(F.broadcast(weekly_prices), "week", "left")  # a row a week
    p = factorize(p, "week", order, "weekId", rows=rows, calendar=True)
    p = factorize(p, "subName", order, "subId", rows=rows)
    return factorize(p, "sub_subOwner", order, "sub_subOwner_id", rows=rows)


def post_quantity_sample(panel_df: DataFrame, weekly_prices: DataFrame) -> DataFrame:
    """DT16 (subName, week, subOwner): weekly posts and mean fee with codes."""
    # fees are sats with at most 6 decimals: the mean is an exact decimal sum over a count
    fee = F.col("posting_fee").cast("decimal(24,6)")
    d = (panel_df.groupBy("subName", tf.as_week("date").alias("week"), "subOwner")
         .agg(F.sum("n_posts").alias("n_posts"),
              (F.sum(fee).cast("double") / F.count(fee)).alias("posting_fee")))
    d = d.join(weekly_prices, "week", "left")
    order = ["subName", "week", "subOwner"]
    d = factorize(d, "subName", order, "subId")
    d = factorize(d, "week", order, "weekId")
    d = d.withColumn("sub_subOwner", F.concat_ws("_", "subName", F.coalesce(F.col("subOwner").cast("string"), F.lit("nan"))))
    return factorize(d, "sub_subOwner", order, "sub_subOwner_id")


def v4v_sample(posts_df: DataFrame, itemact: DataFrame, cfg: ForumConfig = DEFAULT,
               data_end: Column | None = None) -> DataFrame:
    """DT18 (itemId): sample without deleted posts, quality classes, strictly-prior totals.

    The sample is stored without texts, as it is read for itself, its zaps and its codes.  The raw acts are joined with it and
    collapsed where they lie, so that each moves once."""
    p = posts_df.withColumn("week", tf.as_week("created_at"))
    p = p.where(in_v4v_sample(cfg, data_end))
    if "text" in p.columns:
        p = text_metrics(p)
    for k, v in tx.quality_flags("num_words", "num_img_or_links", "is_link_post", cfg.hi_words).items():
        p = p.withColumn(k, v)
    p = stored(p.select("itemId", "userId", "subName", "created_at", "week", "hi_quality"), "v4v_posts")
    on = p.select(F.col("itemId").alias("__on"), F.col("hi_quality").alias("__zhi"), F.col("userId").alias("posterId"))
    z = zaps(itemact.join(on, F.col("itemId") == F.col("__on")).drop("__on"), cfg, carry=("posterId", "__zhi"))
    out = sq.strictly_prior_totals(p, z, "userId", "created_at", "hi_quality", "sats", "posterId", "zap_time",
                                   "__zhi")
    out = factorize(out, "subName", ["created_at", "itemId"], "subId", rows=p)
    return factorize(out, "week", ["created_at", "itemId"], "weekId", rows=p, calendar=True)


def internal_digraph(items_df: DataFrame, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT17: distinct internal-link edges between existing, distinct items."""
    from ..operators import graph
    it = items_df.where(pr.not_failed("invoiceActionState", cfg.failed_state) & F.col("text").isNotNull()
                        & (F.length("text") > 0))
    src = it.withColumn("__targets", tx.internal_link_ids("text", cfg.internal_link_pattern))
    return graph.link_edges(src, it, "itemId", "__targets", "itemId")


# ---------------------------------------------------------------- DT19-DT24
def exit_sample(panel_df: DataFrame, weekly_prices: DataFrame, owners: DataFrame,
                cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT19 (userId, week): price growth, staff/anon/owner exclusions, at-risk rows only."""
    g = sq.growth(weekly_prices, "week", "btc_price")
    inactive = (F.col("weeks_since_last_activity") >= 1) & (F.col("length_of_inactivity") >= 4)
    became = (F.col("weeks_since_last_activity") == 1) & (F.col("length_of_inactivity") >= 4)
    # rows not at risk go first, so that only the others are joined with the owners; the prices have a row a week
    d = panel_df.withColumn("inactive", inactive).withColumn("became_inactive", became).where(~inactive | became)
    d = d.where(pr.not_in("userId", cfg.staff_ids) & pr.differs("userId", cfg.anon_id))
    d = d.join(F.broadcast(g), "week", "left")
    return pr.exclude_keys(d, owners, "userId", "userIdTo")


def adoption_week(users_df: DataFrame, first_col: str) -> DataFrame:
    """The user's first adoption week, as :func:`adoption_sample` expects it on the panel's rows (``users_df`` of the panel)."""
    return users_df.select("userId", tf.as_week(first_col).alias("first_week"))


def adoption_sample(panel_df: DataFrame, regime_date: str, cfg: ForumConfig = DEFAULT) -> DataFrame:
    """DT20 (userId, week): regime on, and not after the user's first adoption week (PRJ14, PRJ15)."""
    from ..functions import mathfn as mf
    d = panel_df
    d = d.withColumn("regime", F.col("week") >= tf.as_week(_ts(regime_date)))
    d = d.withColumn("adopted", pr.is_true(F.col("week") >= F.col("first_week")))
    for c in ("rolling_profit1", "rolling_profit0", "rolling_posts", "rolling_items"):
        if c in d.columns:
            d = d.withColumn("log_" + c, mf.signed_log(c))
    d = d.where(pr.not_in("userId", cfg.staff_ids) & pr.differs("userId", cfg.anon_id))
    return d.where(F.col("regime") & pr.is_true(F.col("week") <= F.col("first_week")))


def adoption_weeks(users_df: DataFrame) -> DataFrame:
    """The user's weeks of first use, as :func:`adoption_samples` expects them on the panel's rows (``users_df`` of the panel)."""
    return users_df.select("userId", tf.as_week("first_autowithdraw_date").alias("first_autowithdraw_week"),
                           tf.as_week("first_p2p_zap_date").alias("first_p2p_zap_week"))


def adoption_samples(panel_df: DataFrame, recv_date: str, send_date: str, only_date: str,
                     cfg: ForumConfig = DEFAULT) -> dict[str, DataFrame]:
    """DT20 (userId, week), both samples of the study: user-weeks in which a receiving (sending) wallet could be attached, up to
    the week of the user's first auto-withdrawal (first tip paid by invoice); staff and the anonymous user left out."""
    from ..functions import mathfn as mf
    d = panel_df
    for c, day in (("can_attach_recv", recv_date), ("can_attach_send", send_date), ("only_own_wallets", only_date)):
        d = d.withColumn(c, F.col("week") >= tf.as_week(_ts(day)))
    d = d.withColumn("attached_recv_wallet", pr.is_true(F.col("week") >= F.col("first_autowithdraw_week")))
    d = d.withColumn("attached_send_wallet", pr.is_true(F.col("week") >= F.col("first_p2p_zap_week")))
    for c in ("rolling_profit1", "rolling_profit0", "rolling_posts", "rolling_items"):
        if c in d.columns:
            d = d.withColumn("log_" + c, mf.signed_log(c))
    d = d.where(pr.not_in("userId", cfg.staff_ids) & pr.differs("userId", cfg.anon_id))
    return {"receiving": d.where(F.col("can_attach_recv") & pr.is_true(F.col("week") <= F.col("first_autowithdraw_week"))),
            "sending": d.where(F.col("can_attach_send") & pr.is_true(F.col("week") <= F.col("first_p2p_zap_week")))}


def choice_set(df: DataFrame, user: str, time: str, key: str, cat: str, categories: list,
               history: dict[str, str]) -> DataFrame:
    """DT21: one row per (post, alternative); drops posts with any NULL history value.

    ``history`` maps output name -> per-category column prefix (``{prefix}{c}``).
    """
    d = sq.sequence_number(df, user, time, key)
    cols = [f"{p}{c}" for p in history.values() for c in categories]
    d = d.dropna(subset=cols)
    alts = F.array(*[F.struct(F.lit(c).alias("alternative"),
                              *[F.col(f"{p}{c}").alias(n) for n, p in history.items()]) for c in categories])
    return (d.select(user, time, key, cat, "experience_posts", "experience_days", F.explode(alts).alias("__a"))
            .select(user, time, key, F.col(cat).alias("choice"), "experience_posts", "experience_days", "__a.*")
            .withColumn("chosen", F.col("alternative") == F.col("choice")))


def event_study_sample(panel_df: DataFrame, key: str, date: str, col: str, k: int = 12) -> DataFrame:
    """DT22 (key, week): whether ``col`` rose or fell on any day of the key's week (first differences of the
    daily panel), and the same of the k weeks before (``_L``) and after (``_F``)."""
    d = sq.first_difference(panel_df, [key], [date], col, out="d")
    w = d.groupBy(key, tf.as_week(date).alias("week")).agg(F.max(F.col("d_up").cast("int")).alias("fee_chg_pos"),
                                                           F.max(F.col("d_down").cast("int")).alias("fee_chg_neg"))
    win = Window.partitionBy(key).orderBy("week")  # one row a week
    return w.select("*", *[f(c, i).over(win).alias(f"{c}_{s}{i}") for c in ("fee_chg_pos", "fee_chg_neg")
                           for s, f in (("F", F.lead), ("L", F.lag)) for i in range(1, k + 1)])


def pretrend_quantity(quantity: DataFrame, changes: DataFrame) -> DataFrame:
    """DT22 (subName, week, subOwner): the quantity sample with the week's fee changes, and WN11: the growth control,
    log posts one row before minus log posts twelve rows before, in the territory's order of weeks."""
    w = Window.partitionBy("subName").orderBy("week", "subOwner")  # one row a week and owner
    d = quantity.join(changes, ["subName", "week"], "left")
    return d.withColumn("L12_growth", F.log1p(F.lag("n_posts", 1).over(w)) - F.log1p(F.lag("n_posts", 12).over(w)))


def pretrend_quality(quality: DataFrame, changes: DataFrame) -> DataFrame:
    """DT22 (itemId): the quality sample with the fee changes of its territory's week and of the weeks around it."""
    return quality.join(changes.withColumn("week", F.col("week").cast(quality.schema["week"].dataType)), ["subName", "week"], "left")


def fee_spells(fees: DataFrame, posts_df: DataFrame, data_end: Column) -> DataFrame:
    """DT24: constant-fee spells with days, posts inside [start, end) and the posting rate; the last
    spell of a territory ends at the *date* of the data end."""
    s = sq.constant_spells(fees.withColumn("__t", F.col("date").cast("timestamp")), ["subName"], "__t",
                           "posting_fee", F.date_trunc("day", data_end))
    # spells begin and end at midnight, so a day's posts lie in the same one
    p = (posts_df.groupBy("subName", F.date_trunc("day", F.col("created_at")).alias("__day"))
         .agg(F.count(F.lit(1)).alias("__n")))
    c = intervals.count_in_contiguous_spells(s, p, ["subName"], "spell_start", "spell_end", "__day", "__days",
                                             {"n_posts": F.sum("__n")}).drop("__days").fillna({"n_posts": 0})
    days = tf.micros_between("spell_end", "spell_start") / 86_400_000_000.0
    return c.withColumn("days", days).withColumn("rate", F.try_divide(F.col("n_posts"), F.col("days")))
