"""Reusable row predicates with the study's null rules (PRJ5-PRJ11, N1-N4).

pandas keeps NULL rows under ``col != value`` and ``~isin``; SQL drops them.  Every
negation here is null-safe so the sample sizes agree with the study.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, ForumConfig


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def differs(col, value) -> Column:
    """``col != value`` with pandas semantics: NULL counts as different (N1)."""
    return ~_c(col).eqNullSafe(F.lit(value))


def not_in(col, values) -> Column:
    """``~isin`` keeping NULL rows (N4); for short literal lists only (PRJ8)."""
    return ~F.coalesce(_c(col).isin(list(values)), F.lit(False))


def is_true(cond: Column) -> Column:
    """Comparisons with NULL count as False (N2)."""
    return F.coalesce(cond, F.lit(False))


def not_failed(state="invoiceActionState", failed: str = "FAILED") -> Column:
    return differs(state, failed)


def exclude_keys(df: DataFrame, deny: DataFrame, on: str, deny_on: str | None = None) -> DataFrame:
    """Large deny lists (PRJ8/PRJ9) as a left anti join; NULL keys are kept like ``~isin``."""
    deny_on = deny_on or on
    keys = deny.select(F.col(deny_on).alias("__deny_key")).where(F.col("__deny_key").isNotNull()).distinct()
    return df.join(keys, df[on] == keys["__deny_key"], "left_anti")


def eligible_post(cfg: ForumConfig = DEFAULT, *, state="invoiceActionState", bio="bio", freebie="freebie",
                  saloon="saloon", sub="subName") -> Column:
    """PRJ6, the short form of the degree table: not failed, not bio/freebie/saloon, not in an excluded
    territory; posts without a territory and posts of the last two days stay."""
    return (not_failed(state, cfg.failed_state) & ~_c(bio) & ~_c(freebie) & ~_c(saloon)
            & (_c(sub).isNull() | not_in(sub, cfg.excluded_subs)))


def analysis_sample(cfg: ForumConfig = DEFAULT, *, state="invoiceActionState", bio="bio",
                    freebie="freebie", saloon="saloon", sub="subName", created="created_at",
                    data_end=None, min_age_hours: float = 48, title: str | None = None) -> Column:
    """PRJ6: not failed, not bio/freebie/saloon, has a territory outside the excluded ones,
    posted at least ``min_age_hours`` before the data end; optionally not deleted."""
    end = _c(data_end) if data_end is not None else F.lit(cfg.data_end).cast("timestamp")
    cond = (not_failed(state, cfg.failed_state) & ~_c(bio) & ~_c(freebie) & ~_c(saloon)
            & _c(sub).isNotNull() & (_c(sub) != "") & not_in(sub, cfg.excluded_subs)
            & (F.unix_micros(end) - F.unix_micros(_c(created)) >= int(min_age_hours * 3_600_000_000)))
    if title is not None:
        cond = cond & differs(title, cfg.deleted_title)
    return cond


def fee_eligible(cfg: ForumConfig = DEFAULT, *, state="invoiceActionState", bio="bio",
                 freebie="freebie", saloon="saloon", cost="cost", is_owner="user_is_subOwner",
                 cost_modifier="cost_modifier", n_uploads="n_uploads", item="itemId",
                 user="userId", has_link="hasImageOrLink") -> Column:
    """PRJ7: the posts whose cost is the territory's base posting fee (12 conjuncts)."""
    return (not_failed(state, cfg.failed_state) & ~_c(bio) & ~_c(freebie) & ~_c(saloon)
            & (_c(cost) > 0) & ~_c(is_owner) & (_c(cost_modifier) == 0) & (_c(n_uploads) == 0)
            & not_in(item, cfg.perennial_item_ids) & differs(user, cfg.spammer_id)
            & differs(user, cfg.anon_id) & ~_c(has_link))


def billing_period(ts, amount, cutover, monthly_pre, yearly_pre, monthly_post, yearly_post) -> Column:
    """PRJ10: tier by amount with a price cut-over; an event exactly at the cut-over gets NULL (D9)."""
    t, a, cut = _c(ts), _c(amount), F.lit(cutover).cast("timestamp") if isinstance(cutover, str) else cutover

    def tier(m, y):
        return F.when(a <= m, "MONTHLY").when(a <= y, "YEARLY").otherwise("PERPETUAL")
    return F.when(t < cut, tier(monthly_pre, yearly_pre)).when(t > cut, tier(monthly_post, yearly_post))


def period_end(ts, period, key=None, override_keys=(), grace_days: int = 5) -> Column:
    """PRJ11: +1 month +5 d, +1 year +5 d, +100 years; override keys are perpetual.

    Calendar steps keep the time of day (``add_months`` would drop it).
    """
    t, p = _c(ts), _c(period)
    month = t + F.make_interval(F.lit(0), F.lit(1)) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(grace_days))
    year = t + F.make_interval(F.lit(1)) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(grace_days))
    century = t + F.make_interval(F.lit(100))
    out = F.when(p == "MONTHLY", month).when(p == "YEARLY", year).when(p == "PERPETUAL", century)
    if key is not None and override_keys:
        out = F.when(F.coalesce(_c(key).isin(list(override_keys)), F.lit(False)), century).otherwise(out)
    return out
