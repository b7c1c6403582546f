"""Exact linear-interpolation quantiles by radix selection (N12).

``percentile`` keeps every value of a group in one buffer; for a global
quantile over a fact table that is the whole column.  Here a double becomes a
64-bit integer of the same order (its bits, negated for negative numbers), and
each round counts the rows by the next 16 bits of those that agree with the
target rank so far: one grouped count, at most 65,536 rows to the driver, at
most four rounds, whatever the number of rows or of equal values.

Once the two ranks that a quantile interpolates between part, the lower one is
the greatest value of its bin and the upper one the least of its, so one
aggregation ends the search.  NULL and NaN take no part; -0.0 equals 0.0.
"""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT_BITS = 16


def ordered_key(x: Column) -> Column:
    """A long that orders as the double does: the bits of |x| (exponent, then mantissa), with the sign of x.

    Powers of two and the divisions by them are exact, so the mantissa is too; ``log2`` only proposes an exponent."""
    two, size = F.lit(2.0), F.abs(x)
    guess = F.floor(F.log2(size))
    exponent = F.when(size < F.pow(two, guess), guess - 1).when(size >= F.pow(two, guess + 1), guess + 1).otherwise(guess)
    one = F.lit(1 << 52).cast("long")
    normal = (exponent + 1023) * one + ((size / F.pow(two, exponent) - 1.0) * F.lit(float(1 << 52))).cast("long")
    bits = (F.when(size == 0.0, F.lit(0).cast("long")).when(size == F.lit(math.inf), F.lit(2047).cast("long") * one)
            .when(size < F.lit(2.0 ** -1022), (size / F.lit(2.0 ** -1074)).cast("long")).otherwise(normal.cast("long")))
    return F.when(x < 0.0, -bits).otherwise(bits)


def key_value(key: int) -> float:
    """The double of an ordered key."""
    x = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -x if key < 0 else x


def exact_quantile(df: DataFrame, col: str | Column, q: float, seen: list[int] | None = None) -> float | None:
    """The q-quantile of a column with linear interpolation between ranks; None without values.  ``seen`` takes the
    number of counts that each round brought to the driver."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    keys = df.select(c.alias("__x")).where(F.col("__x").isNotNull() & ~F.isnan("__x")).select(ordered_key(F.col("__x")).alias("__k"))
    below, prefix, shift, low, high, part = 0, None, 64 - DIGIT_BITS, 0, 0, 0.0
    while True:
        # the next digit of the keys that agree on all digits so far; the first one keeps the sign
        digit = F.shiftright("__k", shift) if prefix is None else F.shiftright("__k", shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1).cast("long"))
        alike = keys if prefix is None else keys.where(F.shiftright("__k", shift + DIGIT_BITS) == F.lit(prefix).cast("long"))
        counts = sorted((r["d"], r["n"]) for r in alike.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        if seen is not None:
            seen.append(len(counts))
        if prefix is None:
            n = sum(m for _, m in counts)
            if not n:
                return None
            position = q * (n - 1)
            low = int(math.floor(position))
            part = position - low
            high = low + 1 if part > 0 and low + 1 < n else low
        bins = []
        for want in (low, high):
            at = below
            for d, m in counts:
                if want < at + m:
                    bins.append((d, at))
                    break
                at += m
        whole = [d if prefix is None else (prefix << DIGIT_BITS) | d for d, _ in bins]
        if whole[0] != whole[1]:
            here = F.shiftright("__k", shift)
            ends = keys.agg(F.max(F.when(here == F.lit(whole[0]).cast("long"), F.col("__k"))).alias("a"),
                            F.min(F.when(here == F.lit(whole[1]).cast("long"), F.col("__k"))).alias("b")).first()
            a, b = key_value(ends["a"]), key_value(ends["b"])
            return a + (b - a) * part
        if shift == 0:
            return key_value(whole[0])
        prefix, below, shift = whole[0], bins[0][1], shift - DIGIT_BITS


def quantile_frame(df: DataFrame, col: str | Column, q: float, name: str) -> DataFrame:
    """One-row DataFrame holding the exact quantile, for a broadcast cross join (one row)."""
    val = exact_quantile(df, col, q)
    return df.sparkSession.range(1).select(F.lit(val).cast("double").alias(name))
