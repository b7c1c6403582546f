"""A keyed table of Parquet files that is merged in place (SRC8).

Rows lie in ``partitions`` folders by a hash of their key, so a key is found in
one folder.  An upsert reads and rewrites only the folders that the new rows
touch:

1. the touched folders' rows and the new ones are merged (the last write of a
   key wins) into a staging folder beside the table, in full;
2. its ``_SUCCESS`` mark commits the upsert;
3. the staged folders replace those of the table (dynamic partition overwrite),
   and the staging folder goes.

A writer that is lost before the mark leaves the table as it was; one lost after
it leaves a committed stage, which the next ``read`` or ``upsert`` of the table
replays.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import store_upsert

_PART = "__part"


class KeyedStore:
    """The table at ``path``; ``key`` is its key column and ``ts`` the time of a row's last write."""

    def __init__(self, spark: SparkSession, path: str, *, key: str = "text_hash", ts: str = "last_updated_at", partitions: int = 256):
        self.spark, self.path, self.key, self.ts, self.partitions = spark, path.rstrip("/"), key, ts, partitions
        self.stages = f"{self.path}__staging"

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def _drop(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.partitions)).cast("int")

    def recover(self) -> int:
        """Replays committed stages, drops uncommitted ones; the number replayed."""
        if not self._exists(self.stages):
            return 0
        fs, p = self._fs(self.stages)
        done = 0
        for name in sorted(s.getPath().getName() for s in fs.listStatus(p)):
            stage = f"{self.stages}/{name}"
            if self._exists(f"{stage}/_SUCCESS"):
                self._replace(stage)
                done += 1
            else:
                self._drop(stage)
        return done

    def _replace(self, stage: str) -> None:
        staged = self.spark.read.parquet(stage)
        staged.write.partitionBy(_PART).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        self._drop(stage)

    def read(self, keys: DataFrame | None = None) -> DataFrame | None:
        """The table's rows, or those of the given keys; None where nothing was ever written."""
        self.recover()
        if not self._exists(self.path):
            return None
        rows = self.spark.read.parquet(self.path)
        if keys is None:
            return rows.drop(_PART)
        wanted = keys.select(self.key).distinct().withColumn(_PART, self._part())
        return rows.join(wanted, [_PART, self.key], "left_semi").drop(_PART)

    def lookup(self, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows of the keys that are there, keys that are not)."""
        wanted = keys.select(self.key).distinct()
        rows = self.read(keys)
        if rows is None:
            return wanted.where(F.lit(False)), wanted
        return rows, wanted.join(rows.select(self.key), self.key, "left_anti")

    def touched(self, new: DataFrame) -> list[int]:
        """The folders that the new rows fall into: at most ``partitions`` numbers."""
        return sorted(r[0] for r in new.select(self._part()).distinct().collect())

    def stage(self, new: DataFrame) -> str | None:
        """Merges the new rows with those of the folders they touch into a committed stage; its path, None without rows."""
        parts = self.touched(new)
        if not parts:
            return None
        merged = new
        if self._exists(self.path):
            old = self.spark.read.parquet(self.path).where(F.col(_PART).isin(parts)).drop(_PART)  # only these folders are read
            merged = store_upsert(old, new, key=self.key, ts=self.ts)
        else:
            merged = store_upsert(new.where(F.lit(False)), new, key=self.key, ts=self.ts)
        stage = f"{self.stages}/{uuid.uuid4().hex}"
        merged.withColumn(_PART, self._part()).repartition(_PART).write.partitionBy(_PART).parquet(stage)
        return stage

    def upsert(self, new: DataFrame) -> list[int]:
        """Writes rows, the last write of each key winning; the folders rewritten."""
        self.recover()
        parts = self.touched(new)
        if (stage := self.stage(new)) is not None:
            self._replace(stage)
        return parts
