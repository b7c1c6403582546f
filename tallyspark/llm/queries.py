"""The operators over their whole tables, with production parameters; importing this module registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bpe, idfiles, langid, lm, mixing, neardup, quality, ranking, secretscan, sharding, suffixes, topk, whitening
from .registry import register
from .textblocks import crc_remainder

#: Bytes of text that a shard may hold (operator 5).
SHARD_BYTES = 4 << 20

_HASH_SQL = "('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15))::BIGINT"


@register("op5_sharding", f"""
WITH rows AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes, {_HASH_SQL} AS h FROM documents),
tree AS (
  SELECT d, h >> (60 - d) AS prefix, sum(n_bytes)::BIGINT AS b, count(*)::BIGINT AS n, min(h) = max(h) AS single
  FROM rows, range(0, 61) r(d) GROUP BY ALL),
found AS (
  SELECT rows.doc_id, rows.n_bytes, tree.*,
         row_number() OVER (PARTITION BY rows.doc_id, rows.h ORDER BY tree.d) AS k
  FROM rows JOIN tree ON tree.prefix = rows.h >> (60 - tree.d) AND (tree.b <= {SHARD_BYTES} OR tree.single OR tree.d = 60))
SELECT doc_id, n_bytes, CASE WHEN d = 0 THEN '' ELSE lpad(bin(prefix), d::INT, '0') END AS shard, d::INT AS shard_depth,
       b AS shard_bytes, n AS shard_docs, b > {SHARD_BYTES} AS over_limit
FROM found WHERE k = 1
""")
def op5_sharding(spark, sf_dir):
    return sharding.shard(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


@register("op9_mixing", f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size, {_HASH_SQL} AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT] AS weight
  FROM rows GROUP BY source),
total AS (SELECT sum(source_size)::DOUBLE AS t FROM s),
fill(level, closed, step) AS (
  SELECT 0.0::DOUBLE, -1::BIGINT, 0
  UNION ALL
  SELECT (1.5::DOUBLE * t - gone) / open_w, n, step + 1
  FROM (SELECT any_value(level) AS level, any_value(closed) AS closed, any_value(step) AS step, any_value(t) AS t,
               count(*) FILTER (weight * level > 2.0::DOUBLE * source_size) AS n,
               coalesce(sum(2.0::DOUBLE * source_size) FILTER (weight * level > 2.0::DOUBLE * source_size), 0) AS gone,
               sum(weight) FILTER (NOT weight * level > 2.0::DOUBLE * source_size) AS open_w
        FROM fill, s, total)
  WHERE n <> closed AND open_w > 0),
goal AS (
  SELECT source, source_size,
         least(weight * (SELECT level FROM fill ORDER BY step DESC LIMIT 1), 2.0::DOUBLE * source_size) AS target,
         ('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM s),
laid AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, h, doc_id) AS i FROM rows),
cut AS (
  SELECT doc_id, size, source_size, target, i, u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate
  FROM laid JOIN goal ON laid.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, ((floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT * size)::BIGINT AS taken
FROM cut
""")
def op9_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op1_bpe")
def op1_bpe(spark, sf_dir):
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op6_quality")
def op6_quality(spark, sf_dir):
    return quality.measures(read_table(spark, sf_dir, "documents"))


@register("op8_langid")
def op8_langid(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    held = crc_remainder("doc_id", 4) == 2
    model = langid.train(docs.where(~held))
    return langid.predict(docs.withColumn("held_out", held), model, keep=("held_out",))


@register("op7_topk", """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
flat AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS d FROM v),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
  FROM flat q JOIN flat c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op7_topk(spark, sf_dir):
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@register("op10_neardup")
def op10_neardup(spark, sf_dir):
    return neardup.classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


@register("op3_lm")
def op3_lm(spark, sf_dir):
    return lm.score(read_table(spark, sf_dir, "documents"))


@register("op4_repeats")
def op4_repeats(spark, sf_dir):
    return suffixes.digests(read_table(spark, sf_dir, "documents"))


@register("op2_idfiles")
def op2_idfiles(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    return idfiles.read_files(idfiles.write_files(docs, public_tokenizers.path("byte_bpe_50k.json")))


@register("op11_whitening")
def op11_whitening(spark, sf_dir):
    return whitening.whitened(read_table(spark, sf_dir, "embeddings"))


@register("op12_secrets")
def op12_secrets(spark, sf_dir):
    return secretscan.scan(read_table(spark, sf_dir, "documents"))


@register("op13_ranking", """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS d,
         list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                        lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS t
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT *, len(t)::BIGINT AS n FROM words WHERE len(t) > 0),
asked AS (
  SELECT item_id, i, t, count(*)::BIGINT AS times
  FROM (SELECT item_id, row_number() OVER () AS i,
               unnest(list_transform(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
                      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS t
        FROM benchmark WHERE text IS NOT NULL)
  GROUP BY ALL),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
postings AS (
  SELECT doc_id, d, n, t, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, d, n, unnest(t) AS t FROM docs) WHERE t IN (SELECT t FROM asked) GROUP BY ALL),
weights AS (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, total GROUP BY t, n_docs),
scored AS (
  SELECT item_id, i, d, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (t) JOIN postings USING (t), total GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
""")
def op13_ranking(spark, sf_dir):
    return ranking.rank(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
