"""Mixing sources to target weights by systematic sampling (operator 9, DataFrame functions only).

A source's target is a share of ``budget`` x all words by its weight, stopped at
``max_copies`` x its own words, the excess shared again by weight (water
filling).  Every document of a source then expects ``target / source words``
copies; with the documents laid in a row and their expected copies summed up
from the left, one offset u in [0, 1) drawn per source, a document is taken
once for each integer boundary that its stretch crosses:
``floor(S_i + u) - floor(S_(i-1) + u)`` times, never more than
``ceil(max_copies)``.  The row is laid by (size, hash of id, id), so each run
of similar sizes is sampled in proportion and the words taken come near the
target, not only the number of documents.

The running sum is a rank times a constant, and the rank needs no window over a
whole source: rows are counted per (source, size, hash bucket), the counts are
summed up over those small tables in two steps, and only the rows of one
bucket, of bounded expected size, are ranked one by one.

Defined cases: a null text has size 0; a null source is a source of its own,
last in order; a null id sorts first in its bucket; repeated rows are rows of
their own; an empty table gives no rows; other columns are ignored.  A source
without words has target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import numbered
from .textblocks import WORD_PATTERN

WEIGHTS = (3, 1, 2)
#: Rows that a hash bucket holds on average, within one source and size.
BUCKET_ROWS = 500


def id_hash(id_col: str = "doc_id"):
    """60 bits of the md5 of the id's text, as a long; a null id hashes as the empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = 1.5, max_copies: float = 2.0) -> DataFrame:
    """(source, source_size, target, offset) from one row per source (source, source_size).

    The loop lowers no target: each round finds the level at which the sources
    still open share what is left, and closes those that it would take past
    their stop.  Three sums a round reach the driver."""
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("weight"),
                     (F.col("source_size") * F.lit(float(max_copies))).alias("stop")).persist()
    total = s.agg(F.sum("source_size")).first()[0] or 0
    level, closed = 0.0, -1
    while True:
        shut = F.col("weight") * F.lit(level) > F.col("stop")
        n, gone, open_w = s.agg(F.sum(shut.cast("long")), F.sum(F.when(shut, F.col("stop"))),
                                F.sum(F.when(~shut, F.col("weight")))).first()
        if n is None or n == closed or not open_w:
            break
        closed, level = n, (budget * total - (gone or 0.0)) / open_w
    u = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("source"), F.lit("\0")))), 1, 12),
               16, 10).cast("double") / F.lit(float(1 << 48))
    return s.select("source", "source_size", F.least(F.col("weight") * F.lit(level), F.col("stop")).alias("target"),
                    u.alias("offset"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple = WEIGHTS, budget: float = 1.5, max_copies: float = 2.0, keep: tuple = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) per document, and the columns of ``keep``."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
                       id_hash(id_col).alias("h"), *([F.struct(*keep).alias("kept")] if keep else []))
    strata = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")).persist()
    targets = source_targets(strata.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                             weights, budget, max_copies)
    # Buckets of a stratum: a power of two that follows its row count, so that no bucket grows with the input.
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(float(BUCKET_ROWS))))).cast("int")
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)  # one row per size
    strata = strata.select("source", "size", bits.alias("bits"),
                           F.coalesce(F.sum("n").over(by_size), F.lit(0)).alias("before"))
    strata = strata.join(targets, strata["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    s = strata.select(F.col("source").alias("s_source"), F.col("size").alias("s_size"), "bits", "before", "source_size",
                      "target", "offset")
    dealt = rows.join(s, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")))
    dealt = dealt.withColumn("bucket", F.call_function("shiftrightunsigned", F.col("h"), F.lit(60) - F.col("bits")))
    # Rank within the bucket; the buckets of strata with only one need no further offset.
    in_bucket = Window.partitionBy("source", "size", "bucket").orderBy("h", "doc_id")
    dealt = dealt.withColumn("rank", F.row_number().over(in_bucket))
    tall = (rows.join(s.where("bits > 0"), F.col("source").eqNullSafe(F.col("s_source")) & (F.col("size") == F.col("s_size")))
            .groupBy("source", "size", F.call_function("shiftrightunsigned", F.col("h"), F.lit(60) - F.col("bits")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))
    by_bucket = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    tall = tall.select(F.col("source").alias("t_source"), F.col("size").alias("t_size"), F.col("bucket").alias("t_bucket"),
                       F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("skip"))
    dealt = dealt.join(tall, F.col("source").eqNullSafe(F.col("t_source")) & (F.col("size") == F.col("t_size"))
                       & (F.col("bucket") == F.col("t_bucket")), "left")
    upto = F.col("before") + F.coalesce(F.col("skip"), F.lit(0)) + F.col("rank")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = (F.floor(upto * rate + F.col("offset")) - F.floor((upto - 1) * rate + F.col("offset"))).cast("long")
    out = dealt.select("doc_id", "size", "source", "source_size", "target", crossed.alias("copies"),
                       (crossed * F.col("size")).alias("taken"), *(["kept"] if keep else []))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", "taken", "kept.*") if keep else out


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: each document once per copy taken, with its own columns."""
    rows, (own_id, text, source) = numbered(docs, id_col, text_col, source_col)
    out = mix(rows, own_id, text, source, keep=tuple(rows.columns), **options)
    return (out.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*rows.columns).toDF(*docs.columns))
