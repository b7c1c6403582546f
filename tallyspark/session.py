"""Spark session helpers.

The library never builds its own cluster session: operators take the caller's
``SparkSession``.  ``local_session`` exists for tests, the bench and the driver
smoke check, and sets the few knobs every job here relies on:

* UTC session time zone (all reference timestamps are naive UTC);
* AQE with skew-join splitting, also where the split adds a shuffle, because
  attribution joins are followed by an aggregation on the same key;
* no UI server.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

SCALE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.ansi.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "tallyspark", extra: dict | None = None) -> SparkSession:
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName(app)
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("TALLY_DRIVER_MEM", "16g")))
    for k, v in {**SCALE_CONF, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k, v in SCALE_CONF.items():
        if k not in ("spark.ui.enabled", "spark.ui.showConsoleProgress"):
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (a shared file
    system); it is read from the session.  Only a local-mode session without
    one (tests, bench) gets a fresh scratch folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) \
        or sc.getConf().get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    path = tempfile.mkdtemp(prefix="tally-ckpt-", dir=os.environ.get("TALLY_SCRATCH", "/tmp"))
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never a local one).

    The frame is persisted first: an eager checkpoint runs one job to count
    and one to write, and both then read the persisted blocks instead of
    recomputing the plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist()
    out = held.checkpoint(eager=eager)
    if eager:
        held.unpersist()
    return out


def stored(df, name: str):
    """The frame, written once as Parquet into the shared checkpoint folder and read back.

    Lineage ends there as with :func:`cut_lineage`, but the plan runs once, nothing is
    held in the executors' memory, and later readers take only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-scratch/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
