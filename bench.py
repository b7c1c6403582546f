"""Headline-query bench: prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs in full (written to Spark's ``noop`` sink, so every row is
computed and nothing is collected); the first query also warms the JVM and
is run once untimed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspark.plans import registry  # noqa: E402
from tallyspark.session import local_session  # noqa: E402

HEADLINE = {
    "attribution_48h": "ag3_sats48_attribution",
    "asof_owner": "jn4_asof_owner",
    "strictly_prior_totals": "wn16_strictly_prior_totals",
    "user_day_spells": "wn6_wn7_activity_spells",
    "rolling_sum": "wn4_rolling_sum_lagged",
    "decayed_prior_means": "wn21_prior_category_mean_decayed",
    "two_fe_clustered": "es2_es4_feols_two_effects_clustered",
    "connected_components": "gr2_connected_components",
    "pca": "es16_pca_explained_variance",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")))
    registry.load_all()
    registry.QUERIES[HEADLINE["attribution_48h"]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for label, name in HEADLINE.items():
        t0 = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[label] = round(time.perf_counter() - t0, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
