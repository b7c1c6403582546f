"""Sharding by extendible hashing (operator 5, DataFrame functions only).

Documents go by the leading bits of a 60-bit hash of their id.  The directory
starts at depth 0, one bucket for all; only a bucket over the byte limit splits
on the next bit, until every shard fits.  A bucket of one document (or of rows
that share an id) cannot split further: a document over the limit is a shard of
its own, told apart by ``over_limit``.

One aggregation sums bytes per cell of a fine prefix grid (about
``CELLS_PER_SHARD`` cells a shard, so the grid follows the bytes, not the
rows); the splits are then decided on that small table, level by level up the
tree, and only cells that are themselves too large are read again at a finer
grid.  A document finds its shard by an equi-join on its cell.

Defined cases: a null text has 0 bytes; a null id hashes as the empty text;
repeated ids share a shard; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import id_hash

HASH_BITS = 60
CELLS_PER_SHARD = 16
#: Bits by which a cell that is too large is refined.
STEP_BITS = 8


def _prefix(depth: int):
    return F.shiftrightunsigned(F.col("h"), HASH_BITS - depth)


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, list[int]]:
    """(cell_depth, cell, shard_depth, shard_prefix, shard_bytes, shard_docs): one row per cell that has rows; and the grids' depths.

    ``rows`` has (h, n_bytes)."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(1.0, CELLS_PER_SHARD * total / limit)))))
    top, grids, shards, todo = 0, [], [], rows
    while True:
        grids.append(depth)
        cells = (todo.groupBy(_prefix(depth).alias("prefix"))
                 .agg(F.sum("n_bytes").alias("b"), F.count(F.lit(1)).alias("n"),
                      F.min("h").alias("lo"), F.max("h").alias("hi")).persist())
        # Sums of every level between this grid and the last: the table halves at each step.
        levels, level = [cells.withColumn("d", F.lit(depth))], cells
        for d in range(depth - 1, top - (not top), -1):
            level = (level.groupBy(F.shiftrightunsigned(F.col("prefix"), 1).alias("prefix"))
                     .agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
            levels.append(level.withColumn("d", F.lit(d)))
        tree = levels[0]
        for x in levels[1:]:
            tree = tree.unionByName(x)
        # A bucket is final where it fits or cannot split; a cell's shard is its first final ancestor.
        final = tree.where((F.col("b") <= F.lit(limit)) | (F.col("lo") == F.col("hi")) | (F.col("d") == F.lit(HASH_BITS)))
        up = cells.select(F.col("prefix").alias("cell"),
                          F.explode(F.sequence(F.lit(top if top == 0 else top + 1), F.lit(depth))).alias("d"))
        up = up.withColumn("prefix", F.expr(f"shiftrightunsigned(cell, {depth} - d)"))
        found = (up.join(final, ["d", "prefix"]).groupBy("cell")
                 .agg(F.min_by(F.struct("d", "prefix", "b", "n"), "d").alias("s")))
        shards.append(found.select(F.lit(depth).alias("cell_depth"), "cell", F.col("s.d").alias("shard_depth"),
                                   F.col("s.prefix").alias("shard_prefix"), F.col("s.b").alias("shard_bytes"),
                                   F.col("s.n").alias("shard_docs")))
        large = cells.where((F.col("b") > F.lit(limit)) & (F.col("lo") != F.col("hi"))).select(F.col("prefix").alias("large"))
        if depth >= HASH_BITS or large.isEmpty():
            break
        todo = todo.join(large, _prefix(depth) == F.col("large"), "left_semi")
        top, depth = depth, min(HASH_BITS, depth + STEP_BITS)
    out = shards[0]
    for x in shards[1:]:
        out = out.unionByName(x)
    return out, grids


def shard(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, shard, shard_depth, shard_bytes, shard_docs, over_limit) per document.

    ``shard`` is the bucket's bits as text, most significant first ('' is the undivided corpus)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), id_hash(id_col).alias("h"),
                       F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("n_bytes"))
    cells, grids = directory(rows.select("h", "n_bytes"), limit)
    # A row has a cell in each grid; the directory names the one grid where its shard was found.
    keyed = rows.withColumn("k", F.explode(F.array(*[F.struct(F.lit(d).alias("cell_depth"), _prefix(d).alias("cell"))
                                                     for d in grids]))) if len(grids) > 1 else \
        rows.withColumn("k", F.struct(F.lit(grids[0]).alias("cell_depth"), _prefix(grids[0]).alias("cell")))
    keyed = keyed.select("doc_id", "n_bytes", "k.cell_depth", "k.cell")
    name = F.when(F.col("shard_depth") == 0, F.lit("")).otherwise(
        F.expr("lpad(bin(shard_prefix), shard_depth, '0')"))
    return (keyed.join(cells, ["cell_depth", "cell"])
            .select("doc_id", "n_bytes", name.alias("shard"), "shard_depth", "shard_bytes", "shard_docs",
                    (F.col("shard_bytes") > F.lit(limit)).alias("over_limit")))


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes each document under ``path/shard=<bits>``; a shard is one task's work, bounded by its byte limit."""
    s = shards.select(F.col("doc_id").alias("__id"), F.concat(F.lit("s"), F.col("shard")).alias("shard")).distinct()
    out = docs.drop("shard").join(s, F.col(id_col).eqNullSafe(F.col("__id"))).drop("__id")
    out.repartition(F.col("shard")).write.mode("overwrite").partitionBy("shard").parquet(path)
