"""Prior-history queries over posts with real times of day (WN21 own, WN22, DT21): ``events`` as posts.

An event is a post of its user, its type the post's category, ln(1 + value) the
outcome.  The SQL weighs every earlier post against every user or post, without
any running carry; only the global time-of-day means take the kernel from the
same cosine series (the series against the kernel itself: ``tests``).
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..estimators import clogit
from ..functions import timefn as tf
from ..operators import sequences as sq
from ..session import cut_lineage
from ..sources.tables import Tables
from . import forum
from .q_windows import CATS, prior_posts
from .registry import r6, register

TYPES = ["click", "error", "purchase", "signup", "view"]
HALF_LIFE_S, PERIOD, TOLERANCE = 3 * 3600.0, 86400.0, 1e-4
DECAY_DAYS = 28.0


def event_posts(t):
    return t.events.select("event_id", "user_id", "ts", F.col("event_type").alias("cat"), F.log1p("value").alias("y"))


def _posts_sql() -> str:
    return """e AS (SELECT event_id, user_id, ts, event_type AS cat, ln(1 + value) AS y,
                     hour(ts) * 3600.0 + minute(ts) * 60.0 + floor(second(ts)) AS s FROM events),
u AS (SELECT user_id, avg(s) AS peak, min(ts) AS first_ts FROM e GROUP BY user_id)"""


def _series_sql(angle: str) -> str:
    a = sq.kernel_series(HALF_LIFE_S, PERIOD, TOLERANCE)
    return repr(a[0]) + "".join(f" + {2 * x!r}::DOUBLE * cos({m} * ({angle}))" for m, x in enumerate(a[1:], 1))


KERNEL_SQL = f"exp(-power((((peak - s + 43200.0) % 86400.0 + 86400.0) % 86400.0 - 43200.0) * {math.log(2) / HALF_LIFE_S!r}::DOUBLE, 2))"
BEFORE = "ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _means_sql(weight: str, name: str, prefix: str, own: bool) -> str:
    """CTEs ``{name}``: event_id and the weighted mean of every type's earlier posts since the user's first one."""
    on = "e.user_id = u.user_id" if own else "e.ts >= u.first_ts"
    sums = ", ".join(f"SUM(CASE WHEN cat = '{c}' THEN k * y END) OVER w AS n{i}, SUM(CASE WHEN cat = '{c}' THEN k END) OVER w AS d{i}"
                     for i, c in enumerate(TYPES))
    means = ", ".join(f"n{i} / d{i} AS \"{prefix}{c}\"" for i, c in enumerate(TYPES))
    return f"""{name}_w AS (SELECT u.user_id, e.user_id AS poster, e.event_id, e.ts, e.cat, e.y, {weight} AS k FROM u JOIN e ON {on}),
{name}_s AS (SELECT user_id, poster, event_id, {sums} FROM {name}_w WINDOW w AS (PARTITION BY user_id {BEFORE})),
{name} AS (SELECT event_id, {means} FROM {name}_s WHERE poster = user_id)"""


def _rounded(prefix: str) -> str:
    return ", ".join(f'ROUND("{prefix}{c}", 6) AS "{prefix}{c}"' for c in TYPES)


def _kernel_query(spark, d, own):
    p = event_posts(Tables(spark, d))
    out = sq.kernel_prior_category_means(p, "user_id", "ts", "event_id", "cat", "y", TYPES, tolerance=TOLERANCE, own_only=own)
    return out.select("event_id", *[r6(f"prior_kernel_mean_{c}").alias(f"prior_kernel_mean_{c}") for c in TYPES])


SERIES_SQL = _series_sql(f"(peak - s) * {2 * math.pi / PERIOD!r}::DOUBLE")


@register("wn22_prior_category_mean_kernel",
          f"WITH {_posts_sql()}, {_means_sql(SERIES_SQL, 'm', 'prior_kernel_mean_', False)} SELECT event_id, {_rounded('prior_kernel_mean_')} FROM m")
def wn22_prior_kernel(spark, d):
    """All users' posts since the user's first, weighted by closeness to the user's mean time of day."""
    return _kernel_query(spark, d, False)


@register("wn22_prior_category_mean_kernel_own",
          f"WITH {_posts_sql()}, {_means_sql(KERNEL_SQL, 'm', 'prior_kernel_mean_', True)} SELECT event_id, {_rounded('prior_kernel_mean_')} FROM m")
def wn22_prior_kernel_own(spark, d):
    """The user's own earlier posts, weighted by closeness to the user's mean time of day (the kernel itself)."""
    return _kernel_query(spark, d, True)


@register("wn21_prior_category_mean_decayed_own_hourly", """
WITH pp AS (SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority AS cat, ln(1 + o_totalprice / 1000) AS y FROM orders),
pairs AS (SELECT i.o_orderkey, j.cat, j.y, j.o_orderdate AS t, max(j.o_orderdate) OVER (PARTITION BY i.o_orderkey, j.cat) AS last
          FROM pp i JOIN pp j ON i.o_custkey = j.o_custkey
           AND (j.o_orderdate < i.o_orderdate OR (j.o_orderdate = i.o_orderdate AND j.o_orderkey < i.o_orderkey))),
w AS (SELECT *, exp(-ln(2) / 3600.0 * (epoch_us(last) - epoch_us(t)) / 1e6) AS k FROM pairs),
m AS (SELECT o_orderkey, cat, SUM(k * y) / SUM(k) AS mean FROM w GROUP BY ALL)
SELECT pp.o_orderkey, """ + ", ".join(f"ROUND(max(CASE WHEN m.cat = '{c}' THEN mean END), 6) AS \"prior_mean_{c}\"" for c in CATS) + """
FROM pp LEFT JOIN m USING (o_orderkey) GROUP BY pp.o_orderkey
""")
def wn21_prior_decayed_own_hourly(spark, d):
    """The user's own earlier posts with a half-life of one hour over a span of years: weights of 2^-60000 and less."""
    p = prior_posts(Tables(spark, d))
    out = sq.prior_category_means(p, "o_custkey", "o_orderdate", "o_orderkey", "cat", "y", CATS, decay_half_life_days=1 / 24, own_only=True)
    return out.select("o_orderkey", *[r6(f"prior_mean_{c}").alias(f"prior_mean_{c}") for c in CATS])


#: The choice set's history columns, as the study names them: output -> column prefix of :func:`sequences.prior_histories`.
FAMILIES = {"cum_avg": "cum_avg_", "cum_avg_u": "cum_avg_u_", "cum_avg_recent": "cum_avg_recent_", "cum_avg_recent_u": "cum_avg_recent_u_",
            "cum_avg_activity": "cum_avg_activity_", "cum_avg_activity_u": "cum_avg_activity_u_", "cum_avg_user": "cum_avg_user_"}


def histories(spark, d):
    """One row per post with its 35 history means."""
    p = event_posts(Tables(spark, d))
    return sq.prior_histories(p, "user_id", "ts", "event_id", "cat", "y", TYPES, decay_half_life_days=DECAY_DAYS,
                              kernel_half_life_hours=HALF_LIFE_S / 3600, tolerance=TOLERANCE)


def choice_set(spark, d):
    """DT21: one row per post and alternative, the seven history means of the alternative; posts that lack any of the 35 go."""
    return forum.choice_set(histories(spark, d), "user_id", "ts", "event_id", "cat", TYPES, FAMILIES)


def _decayed_sql(name: str, prefix: str, own: bool) -> str:
    part = "PARTITION BY user_id " if own else ""
    k = f"exp({math.log(2) / (DECAY_DAYS * 86400)!r}::DOUBLE * (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM e)) / 1e6)"
    sums = ", ".join(f"SUM(CASE WHEN cat = '{c}' THEN {k} * y END) OVER w / SUM(CASE WHEN cat = '{c}' THEN {k} END) OVER w AS \"{prefix}{c}\"" for c in TYPES)
    return f"{name} AS (SELECT event_id, {sums} FROM e WINDOW w AS ({part}{BEFORE}))"


_PARTS = [("uni", "cum_avg_", _means_sql("1.0", "uni", "cum_avg_", False)), ("own", "cum_avg_u_", _means_sql("1.0", "own", "cum_avg_u_", True)),
          ("rec", "cum_avg_recent_", _decayed_sql("rec", "cum_avg_recent_", False)), ("recu", "cum_avg_recent_u_", _decayed_sql("recu", "cum_avg_recent_u_", True)),
          ("act", "cum_avg_activity_", _means_sql(SERIES_SQL, "act", "cum_avg_activity_", False)),
          ("actu", "cum_avg_activity_u_", _means_sql(KERNEL_SQL, "actu", "cum_avg_activity_u_", True))]
_COLUMN = {prefix: out for out, prefix in FAMILIES.items()} | {"cum_avg_u_": "cum_avg_u"}
CHOICE_SQL = (f"{_posts_sql()}, {', '.join(p[2] for p in _PARTS)}, "
              "seq AS (SELECT event_id, user_id, ts, cat, row_number() OVER w - 1 AS experience_posts, "
              "(epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id))) / 86400000000.0 AS experience_days "
              "FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
              "joined AS (SELECT * FROM seq " + " ".join(f"JOIN {n} USING (event_id)" for n, *_ in _PARTS) + " WHERE "
              + " AND ".join(f'"{prefix}{c}" IS NOT NULL' for _, prefix, _ in _PARTS for c in TYPES) + "), cs AS ("
              + " UNION ALL ".join(
                  f"SELECT event_id, user_id, ts, cat AS choice, '{c}' AS alternative, cat = '{c}' AS chosen, experience_posts, experience_days, "
                  + ", ".join(f'"{prefix}{c}" AS {_COLUMN[prefix]}' for _, prefix, _ in _PARTS) + f', "cum_avg_u_{c}" AS cum_avg_user FROM joined' for c in TYPES)
              + ")")


@register("dt21_choice_set", f"WITH {CHOICE_SQL} SELECT event_id, alternative, choice, chosen, CAST(experience_posts AS INTEGER) AS experience_posts, "
          "ROUND(experience_days, 6) AS experience_days, " + ", ".join(f"ROUND({c}, 6) AS {c}" for c in FAMILIES) + " FROM cs")
def dt21_choice_set(spark, d):
    cs = choice_set(spark, d)
    return cs.select("event_id", "alternative", "choice", "chosen", F.col("experience_posts").cast("int").alias("experience_posts"),
                     r6("experience_days").alias("experience_days"), *[r6(c).alias(c) for c in FAMILIES])


#: The study's six models: signal family and, where surprise is in, the family of the user's own history.
MODELS = {"r0": ("cum_avg_", None), "r1": ("cum_avg_recent_", None), "r2": ("cum_avg_activity_", None), "r3": ("cum_avg_", "cum_avg_u_"),
          "r4": ("cum_avg_recent_", "cum_avg_recent_u_"), "r5": ("cum_avg_activity_", "cum_avg_activity_u_")}


@register("es9_es10_es11_conditional_logit")
def es9_clogit(spark, d):
    """Six conditional logits of the type chosen: signal, signal x ln(1 + posts so far) and, in three, surprise (own history less
    signal), with constants and a time trend by type; errors clustered by user, pseudo R²."""
    h = sq.sequence_number(histories(spark, d), "user_id", "ts", "event_id").dropna(subset=[p + c for p in FAMILIES.values() for c in TYPES])
    first = h.agg(F.min(tf.as_week("ts")).alias("__w0"), F.max(tf.as_week("ts")).alias("__w1"))  # one row
    weeks = lambda a, b: F.datediff(a, b) / 7
    h = cut_lineage(h.crossJoin(F.broadcast(first)).withColumn("time", weeks(tf.as_week("ts"), F.col("__w0")) / F.greatest(weeks(F.col("__w1"), F.col("__w0")), F.lit(1.0))))
    chosen = F.array_position(F.array(*[F.lit(c) for c in TYPES]), F.col("cat")) - 1
    out = None
    for model, (signal, own) in MODELS.items():
        s = [F.col(signal + c) for c in TYPES]
        x, generic = clogit.utilities(s, F.col("time"), F.log1p("experience_posts"), [F.col(own + c) - F.col(signal + c) for c in TYPES] if own else None)
        names = generic + [f"{kind}:{c}" for kind in ("(Intercept)", "time") for c in TYPES[1:]]
        table, _ = clogit.fit(h, x, chosen, names, cluster=F.col("user_id"), name=model)
        out = table if out is None else out.unionByName(table)
    return out.select("regression_name", "coef_name", r6("estimate").alias("estimate"), r6("serr").alias("serr"))
