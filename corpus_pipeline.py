"""The training-data pipeline: five stages over ``documents``, each on all that the one before kept.

1. quality: documents that any quality rule rejects go (operator 6);
2. near_duplicates: of each class of near-duplicates the document with the smallest id stays (operator 10);
3. repeats: byte strings that also start in a document with a smaller id are cut out (operator 4); a text may become empty;
4. mixture: documents are taken zero, one or two times so that the sources come to their target shares (operator 9);
5. tokens: texts become token ids, which are decoded again: ids and the digest of the decoded text (operator 1).

A stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``, ``n_chars`` following the text.  Each stage's result is written as
Parquet in the shared folder and read again as the next one's ``docs``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, mixing, neardup, quality, suffixes
from tallyspark.llm.shared import written
from tallyspark.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffixes.cut_documents(docs)
    if "n_chars" not in docs.columns:
        return cut
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.tokens(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("repeats", repeat_stage),
          ("mixture", mixture_stage), ("tokens", token_stage)]

#: Byte-pair encoding has no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
