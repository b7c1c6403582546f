"""Radix quantiles and mergeable kernel sums against numpy."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tallyspark.estimators import kernel
from tallyspark.operators import quantile

HARD = [0.0, -0.0, 1.0, -1.0, 2.0 ** -1074, -2.0 ** -1074, 2.0 ** -1022, 2.0 ** 1023, -1.7e308, 1.7976931348623157e308, math.inf, -math.inf, 0.1, 0.1 + 2 ** -56,
        3.0, math.nextafter(3.0, 4), math.nextafter(8.0, 0), 8.0, 5e-320, 2.2250738585072e-308]


def test_keys_keep_the_order_and_the_value(spark):
    rng = random.Random(1)
    values = HARD + [s * math.ldexp(rng.random() + 1, rng.randrange(-1070, 1023)) for s in (1, -1) for _ in range(400)]
    got = spark.createDataFrame([(x,) for x in values], "x double").select("x", quantile.ordered_key(F.col("x")).alias("k")).collect()
    for r in got:
        assert quantile.key_value(r["k"]) == r["x"]
    ordered = sorted(got, key=lambda r: r["k"])
    assert [r["x"] for r in ordered] == sorted(values)


def test_quantiles_match_numpy(spark):
    rng = random.Random(2)
    cases = {"ties": [3.0] * 500 + [float(i) for i in range(499)], "signs": [rng.gauss(0, 1e3) for _ in range(700)], "one": [4.25],
             "two": [-1.0, 2.0], "hard": [x for x in HARD if math.isfinite(x)] * 3, "close": [1 + i * 2.0 ** -52 for i in range(300)]}
    for name, x in cases.items():
        df = spark.createDataFrame([(v,) for v in x] + [(None,), (float("nan"),)], "x double").repartition(3)
        for q in (0.1, 0.731, 1.0) if len(x) > 2 else (0.5,):
            seen = []
            got = quantile.exact_quantile(df, "x", q, seen)
            s = sorted(x)
            at = q * (len(s) - 1)
            low = int(at)
            want = s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (at - low) if at > low else s[low]
            assert got == want, (name, q)
            assert len(seen) <= 4 and max(seen) <= 65_536
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert quantile.exact_quantile(none, "x", 0.5) is None


def test_kernel_means_and_band_match_numpy(spark):
    rng = np.random.default_rng(3)
    n, grid, bw, nboot = 3000, [0.0, 2.5, 5.0, 9.0], 1.5, 60
    x, y, w = np.round(rng.random(n) * 10, 1), rng.random(n), rng.random(n) + 0.5
    df = spark.createDataFrame([(int(i), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, y, w))], "id long, x double, y double, w double").repartition(4)
    got = sorted(kernel.weighted_kreg(df, "x", "y", bw, grid, w="w", nboot=nboot, seed=5, key="id").collect(), key=lambda r: r["gi"])
    hashes = np.array([r["h"] for r in df.select("id", F.xxhash64(F.lit(5), "id").alias("h")).orderBy("id").collect()], np.int64)
    counts = kernel.poisson_counts(hashes, nboot)
    assert abs(counts.mean() - 1) < 0.02 and abs(counts.var() - 1) < 0.05
    for r, g in zip(got, grid):
        k = np.exp(-0.5 * ((g - x) / bw) ** 2) * w
        boot = (counts * (k * y)[:, None]).sum(0) / (counts * k[:, None]).sum(0)
        assert r["grid_x"] == g and abs(r["y_hat"] - (k * y).sum() / k.sum()) < 1e-12
        np.testing.assert_allclose([r["ci_lower"], r["ci_upper"]], np.quantile(boot, [0.025, 0.975]), rtol=1e-10)


def test_kernel_rows_without_values(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 9.0), (3, 1.0, None)], "id long, x double, y double")
    (r,) = kernel.weighted_kreg(df, "x", "y", 1.0, [1.0]).collect()
    assert r["y_hat"] == 1.0  # the row without y has weight
    assert kernel.weighted_kreg(df.where("false"), "x", "y", 1.0, [1.0]).collect() == []
