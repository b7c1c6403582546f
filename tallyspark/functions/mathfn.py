"""Numeric helpers (SF7-SF10, SF24, SF25)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def signed_log(x) -> Column:
    v = _c(x)
    return F.signum(v) * F.log1p(F.abs(v))


def signed_log10(x) -> Column:
    v = _c(x)
    return F.signum(v) * F.log10(F.abs(v) + 1)


# FIXED VALUES: two-sided normal critical values for 1 %, 5 %, 10 %.
STAR_LEVELS = ((2.576, "***"), (1.96, "**"), (1.645, "*"))


def stars(coef, serr) -> Column:
    c, s = _c(coef), _c(serr)
    t = F.abs(c / s)
    out = F.when(s == 0, F.lit("***"))
    for crit, mark in STAR_LEVELS:
        out = out.when(t > crit, F.lit(mark))
    return out.otherwise(F.lit(""))


def double_effect(beta) -> Column:
    """Change in the outcome from doubling a logged regressor: e^{b ln 2} - 1."""
    return F.exp(_c(beta) * F.lit(math.log(2.0))) - 1


def normal_ci(est, se, z: float = 1.96) -> tuple[Column, Column]:
    return _c(est) - z * _c(se), _c(est) + z * _c(se)


def logistic(x) -> Column:
    return 1.0 / (1.0 + F.exp(-_c(x)))


def interaction(*cols) -> Column:
    out = None
    for c in cols:
        v = _c(c).cast("double")
        out = v if out is None else out * v
    return out
