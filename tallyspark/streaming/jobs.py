"""Streaming forms of two batch operators (optional extras, SURVEY section 2.12).

* 48-hour attribution as a stream-stream interval join: both sides carry a
  watermark and the join condition bounds the time range on both sides, so
  the state of either side can be dropped once the watermark passes it.  A
  stream needs a lower bound; the batch operator (no lower bound) is the
  reference semantics.
* Posting bursts as session windows: consecutive acts of a user at most
  ``gap`` apart form a session (inclusive gap, by adding one microsecond to
  Spark's exclusive session gap).

``run_available_now`` drives a query over the files present and stops; the
sink and its checkpoint are folders under the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.tables import SCHEMAS, table_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files: int | None = None) -> DataFrame:
    """The table as a stream of its files: a folder of part files, or one file beside the other tables."""
    r, path = spark.readStream.schema(SCHEMAS[name]), table_path(sf_dir, name)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    files = spark.read.schema(SCHEMAS[name]).parquet(path).inputFiles()
    if len(files) == 1 and files[0].rstrip("/").endswith(f"/{name}.parquet"):
        return r.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return r.parquet(path)


def attribution_pairs(zaps: DataFrame, posts: DataFrame, *, zap_key: str, zap_time: str, post_key: str,
                      post_time: str, hours: float = 48, lower_hours: float = 0,
                      watermark: str = "3 days") -> DataFrame:
    """Joined (zap, post) rows with post_time + lower <= zap_time <= post_time + hours."""
    z = zaps.withWatermark(zap_time, watermark)
    p = posts.withWatermark(post_time, watermark)
    cond = ((F.col(zap_key) == F.col(post_key))
            & (F.col(zap_time) >= F.col(post_time) + F.expr(f"INTERVAL {int(lower_hours * 3600)} SECONDS"))
            & (F.col(zap_time) <= F.col(post_time) + F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")))
    return z.join(p, cond, "inner")


def burst_sessions(acts: DataFrame, user: str, time: str, gap_seconds: int, watermark: str = "1 day") -> DataFrame:
    """Per user: session start, end (last act + gap) and number of acts.

    In a long-running job use append mode: a session is emitted once the
    watermark passes its end and its state is dropped.  Complete mode (used on
    the finite test input to flush the last sessions) keeps every session."""
    gap = f"{gap_seconds} seconds 1 microsecond"
    return (acts.withWatermark(time, watermark)
            .groupBy(user, F.session_window(time, gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("n_acts")))


def run_available_now(df: DataFrame, output_mode: str = "append", fmt: str = "parquet") -> str:
    """Run a streaming DataFrame over everything available, into a fresh sink folder; return its path."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-streams/{uuid.uuid4().hex[:12]}"
    q = (df.writeStream.format(fmt).outputMode(output_mode).option("checkpointLocation", base + "/_chk")
         .option("path", base + "/out").trigger(availableNow=True).start())
    q.awaitTermination()
    return base + "/out"


def run_complete(df: DataFrame) -> DataFrame:
    """Run over everything available in complete mode; each micro-batch replaces the result's files, and the
    last one is returned: nothing of the result stands on the driver."""
    spark = df.sparkSession
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tally-streams/{uuid.uuid4().hex[:12]}"
    q = (df.writeStream.outputMode("complete").option("checkpointLocation", base + "/_chk").trigger(availableNow=True)
         .foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(base + "/out")).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(base + "/out")
