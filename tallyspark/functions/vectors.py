"""Array-vector expressions (SF15-SF17): higher-order built-ins, no Python per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalize(v) -> Column:
    n = l2_norm(v)
    return F.transform(_c(v), lambda x: x.cast("double") / n)


def cosine_distance(a, b) -> Column:
    return 1.0 - dot(a, b) / (l2_norm(a) * l2_norm(b))


def weighted_mean_vectors(df: DataFrame, key: str, vec: str, weight: str, out: str = "mean_vec") -> DataFrame:
    """SF17: per key, the weight-averaged vector of its chunk vectors.

    Exploded by position so each (key, position) sum is a plain partial
    aggregate; the vector is reassembled in position order.
    """
    exploded = df.select(key, weight, F.posexplode(vec).alias("__pos", "__x"))
    per_pos = (exploded.groupBy(key, "__pos")
               .agg((F.sum(F.col("__x") * F.col(weight)) / F.sum(weight)).alias("__m")))
    return (per_pos.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct("__pos", "__m"))).alias("__s"))
            .select(key, F.transform("__s", lambda s: s["__m"]).alias(out)))
