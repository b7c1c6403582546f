"""What jobs of several passes share: written tables, and columns of numbers packed into binary rows."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ensure_checkpoint_dir

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ZSTD = pa.Codec("zstd", 1)


def written(df: DataFrame, name: str, batch_rows: int = 0) -> DataFrame:
    """The frame, written once into the shared folder of ``spark.checkpoint.dir`` and read back.

    Lineage ends there: every executor sees the files, whichever wrote them.
    The job's shuffle files are dropped as soon as it has ended.  ``batch_rows``: its Arrow batches hold at most so many rows
    (as the session says, if 0); executor and Python worker hold them beside their heaps."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, "false")
    usual = spark.conf.get(_BATCH, "10000")
    spark.conf.set(_CLEAN, "true")
    try:
        spark.conf.set(_BATCH, str(batch_rows or usual))
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
        spark.conf.set(_BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The frame with columns c0, c1, ..., and the new names of ``columns``: whatever the frame's own names are,
    they clash with nothing that is added on the way.  ``toDF(*docs.columns)`` brings them back."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{docs.columns.index(c)}" for c in columns]


def pack(numbers: np.ndarray, ascending: bool = False) -> bytes:
    """Unsigned numbers as compressed byte planes; ascending ones by their differences."""
    x = numbers.astype(np.uint64)
    if ascending and len(x):
        x = np.concatenate((x[:1], x[1:] - x[:-1]))
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    planes = x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    small = _ZSTD.compress(planes, asbytes=True) if planes else b""
    return len(x).to_bytes(4, "little") + bytes([width]) + small


def unpack(blob: bytes, ascending: bool = False) -> np.ndarray:
    n, width = int.from_bytes(blob[:4], "little"), blob[4]
    out = np.zeros((n, 8), np.uint8)
    if n:
        out[:, :width] = np.frombuffer(_ZSTD.decompress(blob[5:], n * width, asbytes=True), np.uint8).reshape(width, n).T
    x = out.view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if ascending else x


def squeeze(data: bytes) -> bytes:
    return _ZSTD.compress(data, asbytes=True)


def restore(blob: bytes, size: int) -> bytes:
    return _ZSTD.decompress(blob, size, asbytes=True) if size else b""
