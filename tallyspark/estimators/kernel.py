"""Kernel regression on a grid (ES13), bootstrap band (ES14), moving-window means (ES15).

Sums that merge: a task turns its rows into one table of grid points by
replicates (kernel-weighted sums of y and of weights) and Spark adds the tasks'
tables up.  Rows of equal x are put together first, every row's replicate counts
are drawn once into a vector, and the rest is two matrix products a batch; no
row is ever copied per grid point or replicate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows whose replicate counts a task holds at a time.
_ROWS = 2_048


def poisson_counts(hashes: np.ndarray, nboot: int) -> np.ndarray:
    """Poisson(1) draws, rows x replicates, from 64-bit row hashes: a mixed hash of (row, replicate) as a uniform, inverted."""
    x = hashes.view(np.uint64)[:, None] + np.arange(1, nboot + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    cdf = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(18)])
    return np.searchsorted(cdf, u, side="right").astype(np.float64)


def weighted_kreg(df: DataFrame, x: str, y: str, bw: float, grid: list[float], w: str | None = None,
                  nboot: int = 0, seed: int = 42, key: str | None = None) -> DataFrame:
    """Gaussian-kernel weighted mean of y at each grid point: sum K w y / sum K w.

    With ``nboot`` > 0, adds a 95 % percentile band from ``nboot`` reweighted
    replicates; row weights are Poisson(1) draws from a seeded hash of
    (row key, replicate), i.e. a Poisson bootstrap: the same role as the
    study's multinomial resampling, not bit-identical.  Rows without x or weight
    take no part; a row without y has weight but adds nothing.
    """
    if nboot > 0 and not key:
        raise ValueError("bootstrap needs a row key")
    points = np.array(grid, float)
    wt = F.col(w).cast("double") if w else F.lit(1.0)
    d = df.select(F.col(x).cast("double").alias("x"), F.coalesce(F.col(y).cast("double"), F.lit(0.0)).alias("y"), wt.alias("w"),
                  (F.xxhash64(F.lit(seed), F.col(key)) if nboot > 0 else F.lit(0).cast("long")).alias("h"))
    d = d.where(F.col("x").isNotNull() & F.col("w").isNotNull())

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, len(points), nboot + 1))
        some = False
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                xs, ys, ws, h = (np.asarray(c) for c in batch.slice(at, _ROWS).columns)
                some = True
                counts = np.ones((len(xs), nboot + 1))  # column 0: the estimate itself
                if nboot > 0:
                    counts[:, 1:] = poisson_counts(h, nboot)
                distinct, place = np.unique(xs, return_inverse=True)
                order = np.argsort(place, kind="stable")
                starts = np.searchsorted(place[order], np.arange(len(distinct)))
                kernel = np.exp(-0.5 * ((points[:, None] - distinct) / bw) ** 2)
                for j, weight in enumerate((ws * ys, ws)):
                    sums[j] += kernel @ np.add.reduceat((counts * weight[:, None])[order], starts, axis=0)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(points)), pa.int32()), pa.array(list(sums[0]), pa.list_(pa.float64())),
                                              pa.array(list(sums[1]), pa.list_(pa.float64()))], ["gi", "num", "den"])

    cells = d.mapInArrow(tables, "gi int, num array<double>, den array<double>").select("gi", F.posexplode(F.arrays_zip("num", "den")).alias("b", "s"))
    means = cells.groupBy("gi", "b").agg((F.sum("s.num") / F.sum("s.den")).alias("mean"))
    means = means.withColumn("grid_x", F.element_at(F.array(*[F.lit(float(g)) for g in grid]), F.col("gi") + 1))
    out = [F.max(F.when(F.col("b") == 0, F.col("mean"))).alias("y_hat")]
    if nboot > 0:
        draws = F.when(F.col("b") > 0, F.col("mean"))
        out += [F.percentile(draws, 0.025).alias("ci_lower"), F.percentile(draws, 0.975).alias("ci_upper")]
    return means.groupBy("gi", "grid_x").agg(*out)


def moving_window_means(df: DataFrame, x: str, y: str, grid_start: float, step: float, n_grid: int,
                        bw: float) -> DataFrame:
    """ES15: mean of y over x in [g - bw, g + bw) at each grid point g = start + i * step.

    Each row is sent only to the grid points whose window holds it (an
    ``explode(sequence(...))`` of indexes), so the work is linear in n.
    """
    xi = (F.col(x).cast("double") - F.lit(grid_start)) / F.lit(step)
    lo = F.greatest(F.lit(0), F.floor(xi - bw / step) - 1).cast("int")
    hi = F.least(F.lit(n_grid - 1), F.ceil(xi + bw / step) + 1).cast("int")
    d = df.select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"),
                  F.explode(F.sequence(lo, F.greatest(lo, hi))).alias("gi"))
    d = d.withColumn("grid_x", F.lit(grid_start) + F.col("gi") * F.lit(step))
    d = d.where((F.col("__x") >= F.col("grid_x") - bw) & (F.col("__x") < F.col("grid_x") + bw)
                & (F.col("gi") <= n_grid - 1))
    return d.groupBy("gi", "grid_x").agg(F.avg("__y").alias("window_mean"), F.count(F.lit(1)).alias("n"))
