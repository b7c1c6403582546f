"""Fixed effects are taken off in the tasks, without tables of the largest effect."""

import numpy as np
import pytest

from tallyspark.estimators import linear


@pytest.mark.parametrize("hot", [50, 100_000])
def test_rows_are_demeaned_in_the_tasks(spark, monkeypatch, hot):
    """Hot levels, NULL ones and batches that end inside a level: residuals as by the driver's way, without a table of the largest effect."""
    rng = np.random.default_rng(8)
    n = 2500
    rows = [(int(u) if u else None, int(w), f"s{s}", float(y), int(x)) for u, w, s, y, x in
            zip(np.where(rng.random(n) < 0.3, 1, rng.integers(0, 400, n)), rng.integers(0, 12, n), rng.integers(0, 5, n), rng.normal(size=n), rng.integers(0, 3, n))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, user long, week int, sub string, y double, x int").repartition(5)
    want = linear.demean(df, ["y", "x"], ["week", "sub", "user"], direct=True).toPandas().sort_values("id")
    monkeypatch.setattr(linear, "DIRECT_LEVELS", 10)
    monkeypatch.setattr(linear, "HOT_ROWS", hot)
    tables, plain = [], linear._largest_levels
    monkeypatch.setattr(linear, "_largest_levels", lambda cells, *a: tables.append(cells) or plain(cells, *a))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = linear.demean(df, ["y", "x"], ["week", "sub", "user"])
        made = got.toPandas().sort_values("id")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert got.columns == ["id", "user", "week", "sub", "y", "x"] and made["user"].isna().sum() == want["user"].isna().sum() > 0
    assert np.allclose(made[["y", "x"]], want[["y", "x"]], atol=1e-8) and len(made) == n
    assert tables[0].select("user").distinct().count() == (1 if hot == 50 else 0)
