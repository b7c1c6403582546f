"""Ordered-scan operators rewritten from row loops into windows (WN1-WN15, WN17-WN21).

Per-key windows here run over panels (rows per key bounded by the calendar
span) or over per-user event rows; running sums over raw facts go through
:mod:`scan`, which deals rows by ranges of (key, time), so hot keys and hot days are split.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import scan

U = Window.unboundedPreceding
UF = Window.unboundedFollowing


def burst_counter(df: DataFrame, user: str, time: str, tiebreak: str, gap_us: int, skip: str | None = None,
                  always_one: tuple = (), out: str = "cost_modifier") -> DataFrame:
    """WN1: posts within ``gap_us`` of the user's previous (non-skipped) post count 1, 2, 3...

    A longer gap (or a new user) resets to 0; skipped rows get 0 and do not
    move the clock; users in ``always_one`` always get 1 (and do not take part).

    Rows are dealt by ranges of (user, time), so a hot user or day is split, and moved
    once; a burst goes on over the edge of a range (:func:`scan.run_positions`).
    """
    skipped = F.lit(False) if skip is None else F.coalesce(F.col(skip), F.lit(False))
    fixed_one = F.coalesce(F.col(user).isin(list(always_one)), F.lit(False)) if always_one else F.lit(False)
    d = scan.run_positions(df, [user], time, [tiebreak], gap_us, ~skipped & ~fixed_one, "__pos")
    n = F.when(skipped, F.lit(0)).when(fixed_one, F.lit(1)).otherwise(F.col("__pos"))
    return d.select(*df.columns, n.cast("long").alias(out))


def smooth_local_extrema(df: DataFrame, by: list[str], order: list[str], col: str) -> DataFrame:
    """WN2: a strict peak or trough takes the next value, scanning forward in place.

    Because a replaced row equals its next value, the following row is then
    never an extremum; so in each run of consecutive raw extrema the 1st,
    3rd, ... are replaced.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    prev, nxt, x = F.lag(col).over(w), F.lead(col).over(w), F.col(col)
    ext = prev.isNotNull() & nxt.isNotNull() & (((x > prev) & (x > nxt)) | ((x < prev) & (x < nxt)))
    d = df.withColumn("__e", ext).withColumn("__next", nxt)
    d = d.withColumn("__grp", F.sum((~F.col("__e")).cast("int")).over(w.rowsBetween(U, 0)))
    wr = Window.partitionBy(*by, "__grp").orderBy(*order)
    d = d.withColumn("__pos", F.row_number().over(wr))
    return (d.withColumn(col, F.when(F.col("__e") & (F.col("__pos") % 2 == 0), F.col("__next")).otherwise(x))
            .drop("__e", "__next", "__grp", "__pos"))


def activity_spells(df: DataFrame, user: str, period: str, activity: str) -> DataFrame:
    """WN6 + WN7 on a user x period panel.

    ``account_age`` = 1..n; ``weeks_since_last_activity`` = rows since the last
    active row (the first row is always 0); ``length_of_inactivity`` = for an
    inactive row, the value above at the last row of its inactive run (the row
    before the next active row, else the user's last row); 0 on active rows.
    """
    w = Window.partitionBy(user).orderBy(period)
    d = df.withColumn("account_age", F.row_number().over(w))
    reset = F.when(F.col(activity) | (F.col("account_age") == 1), F.col("account_age"))
    d = d.withColumn("weeks_since_last_activity",
                     F.col("account_age") - F.max(reset).over(w.rowsBetween(U, 0)))
    d = d.withColumn("__n_after", F.sum(F.col(activity).cast("int")).over(w.rowsBetween(0, UF)))
    wg = Window.partitionBy(user, "__n_after")
    inactive = ~F.col(activity)
    last_w = F.max_by(F.when(inactive, F.col("weeks_since_last_activity")),
                      F.when(inactive, F.col("account_age"))).over(wg)
    return (d.withColumn("length_of_inactivity", F.when(F.col(activity), F.lit(0)).otherwise(last_w))
            .drop("__n_after"))


def activity_spells_along(active: np.ndarray, place: np.ndarray) -> dict[str, pa.Array]:
    """:func:`activity_spells` of rows in order, ``place`` being a row's number in its user's panel, which is there whole."""
    n = len(active)
    at = np.arange(n)
    since = at - np.maximum.accumulate(np.where(active | (place == 0), at, 0))
    # an inactive run ends before the next active row or the next user's first one
    stop = np.append(active | (place == 0), True)
    following = np.minimum.accumulate(np.where(stop, np.arange(n + 1), n)[::-1])[::-1][1:]
    length = np.where(active, 0, since[following - 1]) if n else since
    return {"account_age": pa.array((place + 1).astype(np.int32)), "weeks_since_last_activity": pa.array(since.astype(np.int32)),
            "length_of_inactivity": pa.array(length.astype(np.int32))}


def leads_lags(df: DataFrame, by: list[str], order: list[str], col: str, k: int, prefix: str | None = None) -> DataFrame:
    """WN10: ``col`` shifted by 1..k rows both ways, in one shared window (one sort)."""
    w = Window.partitionBy(*by).orderBy(*order)
    p = prefix or col
    cols = [F.lag(col, i).over(w).alias(f"{p}_lag{i}") for i in range(1, k + 1)]
    cols += [F.lead(col, i).over(w).alias(f"{p}_lead{i}") for i in range(1, k + 1)]
    return df.select("*", *cols)


def first_difference(df: DataFrame, by: list[str], order: list[str], col: str, out: str = "diff") -> DataFrame:
    """WN9: ``x - lag(x)`` with increase/decrease flags (NULL compare is False)."""
    w = Window.partitionBy(*by).orderBy(*order)
    d = df.withColumn(out, F.col(col) - F.lag(col).over(w))
    return (d.withColumn(out + "_up", F.coalesce(F.col(out) > 0, F.lit(False)))
            .withColumn(out + "_down", F.coalesce(F.col(out) < 0, F.lit(False))))


def count_changes(df: DataFrame, by: list[str], order: list[str], col: str, out: str = "n_changes",
                  bucket_us: int = scan.DAY_US) -> DataFrame:
    """WN12: number of value changes within each key, in (time, tie-break) order.

    Two-level: the previous value inside a (key, day) bucket comes from a
    window over that bucket; the first row of a bucket compares with the last
    value of the key's previous non-empty bucket (a per-bucket summary).
    """
    time, tiebreak = order[0], order[1:]
    d = (df.withColumn("__t", F.unix_micros(F.col(time)))
         .withColumn("__b", F.floor(F.col("__t") / F.lit(bucket_us))))
    w = Window.partitionBy(*by, "__b").orderBy("__t", *tiebreak)
    d = d.withColumn("__prev_in", F.lag(col).over(w)).withColumn("__rn", F.row_number().over(w))
    summ = d.groupBy(*by, "__b").agg(F.max_by(col, F.struct("__t", *tiebreak)).alias("__last"))
    summ = summ.withColumn("__prev_b", F.lag("__last").over(Window.partitionBy(*by).orderBy("__b")))
    d = scan.join_on(d, summ.select(*by, "__b", "__prev_b"), by + ["__b"])
    prev = F.when(F.col("__rn") == 1, F.col("__prev_b")).otherwise(F.col("__prev_in"))
    ch = F.coalesce(F.col(col) != prev, F.lit(False)).cast("int")
    return d.withColumn("__ch", ch).groupBy(*by).agg(F.sum("__ch").alias(out))


def constant_spells(df: DataFrame, by: list[str], time: str, col: str, data_end: Column,
                    tiebreak: list[str] | None = None, bucket_us: int = scan.DAY_US) -> DataFrame:
    """WN13: runs of a constant value: start, value, end = next run's start or the data end.

    Two-level, like :func:`count_changes`: the previous value and the next run
    start cross (key, day) bucket edges through per-bucket summaries, so a key
    with a third of the rows is still spread over its days.
    """
    tb = tiebreak or []
    d = (df.withColumn("__cs_t", F.unix_micros(F.col(time)))
         .withColumn("__cs_b", F.floor(F.col("__cs_t") / F.lit(bucket_us))))
    part = by + ["__cs_b"]
    w = Window.partitionBy(*part).orderBy("__cs_t", *tb)
    wb = Window.partitionBy(*by).orderBy("__cs_b")
    d = d.withColumn("__prev_in", F.lag(col).over(w)).withColumn("__rn", F.row_number().over(w))
    summ = d.groupBy(*part).agg(F.max_by(col, F.struct("__cs_t", *tb)).alias("__last"))
    summ = summ.withColumn("__prev_b", F.lag("__last").over(wb))
    d = scan.join_on(d, summ.select(*part, "__prev_b"), part)
    prev = F.when(F.col("__rn") == 1, F.col("__prev_b")).otherwise(F.col("__prev_in"))
    starts = (d.withColumn("__ch", F.coalesce(F.col(col) != prev, F.lit(True)))
              .where(F.col("__ch"))
              .select(*by, "__cs_b", "__cs_t", *tb, F.col(time).alias("spell_start"), F.col(col).alias("spell_value")))
    ws = Window.partitionBy(*part).orderBy("__cs_t", *tb)
    starts = starts.withColumn("__next_in", F.lead("spell_start").over(ws))
    firsts = starts.groupBy(*part).agg(F.min_by("spell_start", F.struct("__cs_t", *tb)).alias("__first"))
    firsts = firsts.withColumn("__next_b", F.lead("__first").over(wb))
    out = scan.join_on(starts, firsts.select(*part, "__next_b"), part)
    return out.select(*by, "spell_start", "spell_value",
                      F.coalesce("__next_in", "__next_b", data_end).alias("spell_end"))


def growth(df: DataFrame, order: str, col: str, lags: tuple = (1, 4, 8, 52)) -> DataFrame:
    """WN8: ln x_t - ln x_{t-k} on a small ordered series (one row per period)."""
    w = Window.orderBy(order)
    for k in lags:
        df = df.withColumn(f"growth_{k}", F.log(col) - F.log(F.lag(col, k).over(w)))
    return df


def cumulative_count(df: DataFrame, period: Column, out: str = "cumulative") -> DataFrame:
    """WN14: count per period, then the running total over the (small) period table."""
    g = df.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn(out, F.sum("n").over(Window.orderBy("period").rowsBetween(U, 0)))


def sequence_number(df: DataFrame, user: str, time: str, tiebreak: str) -> DataFrame:
    """WN15: 0-based post number per user and days since the user's first post.

    The position is a two-level prefix count over (user, day) buckets and the
    first time a grouped minimum, so a hot user is not one task.
    """
    d = scan.prefix_sums(df, [user], time, {"experience_posts": F.lit(1.0)}, strict=False, tiebreak=[tiebreak])
    first = df.groupBy(user).agg(F.min(time).alias("__first"))
    d = scan.join_on(d, first, [user])
    return (d.withColumn("experience_posts", F.col("experience_posts").cast("int"))
            .withColumn("experience_days", (F.unix_micros(F.col(time)) - F.unix_micros("__first")) / 86_400_000_000.0)
            .drop("__first"))


def lagged_running(df: DataFrame, user: str, order: list[str], col: str) -> DataFrame:
    """WN17: mean and log of the running sum, ``log(1 + sum)``, over the user's earlier rows, and how many
    these are, plain and as ``log(1 + n)``; all NULL on the user's first row (two-level prefix sums)."""
    time, tiebreak = order[0], order[1:]
    present = F.col(col).isNotNull().cast("double")
    d = scan.prefix_sums(df, [user], time, {"__n": F.lit(1.0), "__c": present, "__s": F.col(col)},
                         strict=False, tiebreak=tiebreak)
    has, later = F.col("__c") > 0, F.col("__n") > 0
    return (d.withColumn(f"prior_mean_{col}", F.when(has, F.col("__s") / F.col("__c")))
            .withColumn(f"log_prior_{col}", F.when(later, F.log1p("__s")))
            .withColumn("prior_n", F.when(later, F.col("__n").cast("int")))
            .withColumn("log_prior_n", F.when(later, F.log1p("__n")))
            .drop("__n", "__c", "__s"))


def prior_category_means(df: DataFrame, user: str, time: str, tiebreak: str, cat: str, y: str,
                         categories: list, *, decay_half_life_days: float | None = None,
                         since_user_first: bool = True, own_only: bool = False) -> DataFrame:
    """WN19-WN21: for each post and category c, the mean of y over earlier posts of category c.

    * uniform, all users since this user's first post (WN19): prefix sums
      once, difference at the user's first time;
    * own posts only (WN20): ``own_only=True``;
    * exponentially decayed (WN21), of all users or with ``own_only`` of the
      user: ``decay_half_life_days`` (:func:`scan.decayed_means`).

    Earlier = before in (time, tiebreak) order (rule N8).  No earlier post of
    the category gives NULL (0/0).
    """
    by = [user] if own_only else []
    if decay_half_life_days is not None:
        return scan.decayed_means(df, by, time, [tiebreak], cat, y, categories, decay_half_life_days * 86400.0, "prior_mean_")
    vals = {}
    for c in categories:
        is_c = (F.col(cat) == F.lit(c)).cast("double")
        vals[f"__num_{c}"] = is_c * F.col(y).cast("double")
        vals[f"__den_{c}"] = is_c
    use_base = not own_only and since_user_first
    d = scan.prefix_sums(df, by, time, vals, strict=False, tiebreak=[tiebreak],
                         strict_suffix="_strict" if use_base else None)
    if use_base:
        d = _subtract_user_first(d, user, time, tiebreak, list(vals))
    res = [F.try_divide(F.col(f"__num_{c}"), F.nullif(F.col(f"__den_{c}"), F.lit(0.0))).alias(f"prior_mean_{c}")
           for c in categories]
    return d.select(*df.columns, *res)


def _subtract_user_first(d: DataFrame, user: str, time: str, tiebreak: str, cols: list[str]) -> DataFrame:
    """Subtract, per user, the strict prefix sums at the user's first row (rows before the user's
    first time).  The first row is found by a min_by aggregation (partial, skew-safe), not a window."""
    first = d.groupBy(user).agg(F.min_by(F.struct(*[F.col(c + "_strict").alias(c) for c in cols]),
                                         F.struct(time, tiebreak)).alias("__base"))
    d = scan.join_on(d, first, [user], "left")
    return d.select(*[c for c in d.columns if c not in cols and not c.endswith("_strict") and c != "__base"],
                    *[(F.col(c) - F.col("__base")[c]).alias(c) for c in cols])


def strictly_prior_totals(posts: DataFrame, zaps: DataFrame, user: str, time: str, flag: str, sats: str,
                          zap_user: str, zap_time: str, zap_flag: str) -> DataFrame:
    """WN16: per post, sats its author received strictly before it (all / from flagged posts)
    and the number of the author's strictly earlier posts (all / flagged).

    Posts and zaps are unioned per author and scanned once with a strict
    time window (range ``< t``) in the two-level prefix template.
    """
    p = posts.select("*", F.lit(1).alias("__is_post"))
    z = zaps.select(F.col(zap_user).alias(user), F.col(zap_time).alias(time),
                    F.col(sats).cast("double").alias("__sats"), F.col(zap_flag).alias("__zflag"),
                    F.lit(0).alias("__is_post"))
    u = p.unionByName(z, allowMissingColumns=True)
    vals = {"prior_zaps": F.col("__sats"),
            "prior_zaps_from_hi_quality": F.when(F.coalesce(F.col("__zflag"), F.lit(False)), F.col("__sats")),
            "prior_posts": F.col("__is_post").cast("double"),
            "prior_hi_quality_posts": F.when((F.col("__is_post") == 1) & F.col(flag), F.lit(1.0))}
    out = scan.prefix_sums(u, [user], time, vals, strict=True)
    return out.where(F.col("__is_post") == 1).drop("__is_post", "__sats", "__zflag")


def kernel_weight(distance: Column, half_life_s: float, period: float) -> Column:
    """The activity kernel exp(-(d / sigma)^2) of a distance wrapped to half a period; sigma = half-life / ln 2."""
    wrapped = F.pmod(distance + period / 2, F.lit(period)) - period / 2
    return F.exp(-F.pow(wrapped * F.lit(math.log(2) / half_life_s), F.lit(2.0)))


def kernel_series(half_life_s: float, period: float, tolerance: float) -> list[float]:
    """Cosine coefficients a_0, ..., a_M of the activity kernel, M the least with 2 (|a_M+1| + |a_M+2| + ...) <= tolerance.

    So the series a_0 + 2 sum a_m cos(2 pi m d / period) is within ``tolerance`` of the kernel everywhere.  The
    coefficients fall as 1 / m^2, as the kernel w has a corner half a period away.  Those up to 2^14 are added up; by
    parts four times, the ones beyond come to at most period |w'(period / 2)| / (2 pi^2 2^14) and a term in 2^-42.  A mean
    of values in [-Y, Y] is off by at most 2 Y tolerance / (mean weight of the posts it is over)."""
    import numpy as np
    sigma, n, top = half_life_s / math.log(2), 1 << 18, 1 << 14
    d = np.arange(n) * (period / n)
    a = np.fft.rfft(np.exp(-(np.minimum(d, period - d) / sigma) ** 2)).real / n
    slope = abs(period / sigma ** 2 * math.exp(-(period / 2 / sigma) ** 2))
    rest = period * slope / (2 * math.pi ** 2 * top) + (period / sigma / top) ** 3
    tail = 2 * (np.append(np.cumsum(np.abs(a[top:0:-1]))[::-1], 0.0) + rest)  # tail[m]: what terms beyond m come to
    enough = np.flatnonzero(tail <= tolerance)
    if not len(enough):
        raise ValueError(f"tolerance {tolerance} needs more than {top} terms")
    return a[:enough[0] + 1].tolist()


def _second_of_day(time: str) -> Column:
    return (F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)).cast("double")


def with_peak(df: DataFrame, user: str, time: str, out: str = "__peak") -> DataFrame:
    """Add the mean second of the day at which the row's user posts."""
    peak = df.groupBy(user).agg(F.avg(_second_of_day(time)).alias(out))
    return scan.join_on(df, peak, [user], "left")


def kernel_prior_category_means(df: DataFrame, user: str, time: str, tiebreak: str, cat: str, y: str,
                                categories: list, *, half_life_hours: float = 3.0, tolerance: float = 1e-4,
                                own_only: bool = False, period: float = 86400.0, uniform: str | None = None) -> DataFrame:
    """WN22: prior category means weighted by closeness of each earlier post's time of day to the
    user's mean posting time (circular distance, kernel exp(-(d/sigma)^2)).

    * ``own_only``: the user's own earlier posts.  Their weights depend on the
      user alone, so plain prefix sums of weighted values are exact;
    * else all users' posts since this user's first one.  The kernel is periodic in (peak - s), so it is
      expanded in a cosine series (:func:`kernel_series`, within ``tolerance``) and cos(m(a - b)) splits into
      products: the weighted sums become one vector of prefix sums a category, which a task evaluates at each
      post with its user's peak -- linear work instead of users x posts, and the vectors stay in the task.

    No earlier post of the category (an exact count) gives NULL.  ``uniform``: also add the unweighted means under
    this prefix, from the same pass.
    """
    half, names = half_life_hours * 3600.0, [f"prior_kernel_mean_{c}" for c in categories]
    d = with_peak(df, user, time)
    if own_only:
        w = kernel_weight(F.col("__peak") - _second_of_day(time), half, period)
        vals = {}
        for i, c in enumerate(categories):
            is_c = (F.col(cat) == F.lit(c)).cast("double")
            vals |= {f"__kn{i}": is_c * F.col(y).cast("double") * w, f"__kd{i}": is_c * w, f"__n{i}": is_c * F.col(y).cast("double"), f"__d{i}": is_c}
        out = scan.prefix_sums(d, [user], time, vals, strict=False, tiebreak=[tiebreak])
    else:
        a, k = kernel_series(half, period, tolerance), len(categories)
        terms = len(a) - 1
        turn = 2 * math.pi / period
        code = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in categories]), F.col(cat)), F.lit(0))
        compact = F.array(F.when(F.col(time).isNull(), 0).otherwise(code).cast("double"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)),
                          F.coalesce(_second_of_day(time), F.lit(0.0)) * turn)
        order = F.array(*[F.struct(F.lit(float(m)).alias("m"), F.lit(2 * x).alias("x")) for m, x in enumerate(a[1:], 1)])
        angle = F.coalesce(F.col("__peak"), F.lit(0.0)) * turn
        coefficients = F.concat(F.array(F.lit(a[0])), F.transform(order, lambda t: t["x"] * F.cos(angle * t["m"])),
                                F.transform(order, lambda t: t["x"] * F.sin(angle * t["m"])))

        def expand(v):
            """Kernel numerator and denominator, and the plain ones (first coefficient only), of each category."""
            import numpy as np
            waves = np.empty((len(v), 2 * terms + 1))
            waves[:, 0] = 1.0
            angles = v[:, 2:] * np.arange(1, terms + 1)
            np.cos(angles, out=waves[:, 1:terms + 1])
            np.sin(angles, out=waves[:, terms + 1:])
            out = np.zeros((len(v), 4 * k, 2 * terms + 1))
            for c in range(k):
                at = np.flatnonzero(v[:, 0] == c + 1)
                out[at, 4 * c] = waves[at] * v[at, 1:2]
                out[at, 4 * c + 1] = waves[at]
                out[at, 4 * c + 2, 0] = v[at, 1]
                out[at, 4 * c + 3, 0] = 1.0
            return out.reshape(len(v), -1)

        out = scan.prefix_vectors(d, [], time, compact, tiebreak=[tiebreak], strict=True, expand=expand, width=4 * k * (2 * terms + 1),
                                  project=coefficients, groups=4 * k)
        cols = [f"__{kind}{i}" for i in range(k) for kind in ("kn", "kd", "n", "d")]
        out = out.select("*", *[F.col("__before")[j].alias(c) for j, c in enumerate(cols)],
                         *[F.col("__earlier")[j].alias(c + "_strict") for j, c in enumerate(cols)])
        out = _subtract_user_first(out, user, time, tiebreak, cols)
        out = out.withColumns({f"__{kind}{i}": F.col(f"__{kind}{i}") / F.lit(a[0]) for i in range(k) for kind in ("n", "d")})
    res = [F.when(F.col(f"__d{i}") > 0.5, F.col(f"__kn{i}") / F.col(f"__kd{i}")).alias(n) for i, n in enumerate(names)]
    if uniform is not None:
        res += [F.when(F.col(f"__d{i}") > 0.5, F.col(f"__n{i}") / F.round(f"__d{i}")).alias(f"{uniform}{c}") for i, c in enumerate(categories)]
    return out.select(*df.columns, *res)


def prior_histories(df: DataFrame, user: str, time: str, tiebreak: str, cat: str, y: str, categories: list, *,
                    decay_half_life_days: float = 28.0, kernel_half_life_hours: float = 3.0, tolerance: float = 1e-4) -> DataFrame:
    """The seven history families of the choice set, ``{family}_{category}``: means of y over earlier posts of

    * all users since the user's first post: ``cum_avg``, ``cum_avg_activity`` (time-of-day weights);
    * all users: ``cum_avg_recent`` (decayed);
    * the user: ``cum_avg_u`` and ``cum_avg_user`` (unweighted), ``cum_avg_recent_u``, ``cum_avg_activity_u``.

    Four scans: for each information set one of plain and time-of-day sums and one of decayed ones.  Each is
    stored, as the next one's plan would hold it twice, and read by column.
    """
    keys = (user, time, tiebreak, cat, y, categories)
    out = kernel_prior_category_means(df, *keys, half_life_hours=kernel_half_life_hours, tolerance=tolerance, uniform="cum_avg_")
    out = out.withColumnsRenamed({f"prior_kernel_mean_{c}": f"cum_avg_activity_{c}" for c in categories})
    out = prior_category_means(stored(out, "histories"), *keys, decay_half_life_days=decay_half_life_days)
    out = out.withColumnsRenamed({f"prior_mean_{c}": f"cum_avg_recent_{c}" for c in categories})
    out = kernel_prior_category_means(stored(out, "histories"), *keys, half_life_hours=kernel_half_life_hours, own_only=True, uniform="cum_avg_u_")
    out = out.withColumnsRenamed({f"prior_kernel_mean_{c}": f"cum_avg_activity_u_{c}" for c in categories})
    out = prior_category_means(stored(out, "histories"), *keys, decay_half_life_days=decay_half_life_days, own_only=True)
    out = out.withColumnsRenamed({f"prior_mean_{c}": f"cum_avg_recent_u_{c}" for c in categories})
    out = stored(out, "histories")
    return out.withColumns({f"cum_avg_user_{c}": F.col(f"cum_avg_u_{c}") for c in categories})
