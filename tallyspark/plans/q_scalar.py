"""Scalar-function queries (SF1-SF25) over whole texts and tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import IMG_LINK_PATTERN
from ..functions import mathfn as mf
from ..functions import textfn as tx
from ..functions import timefn as tf
from ..functions import vectors as vx
from ..operators.quantile import quantile_frame
from ..sources.tables import Tables
from .registry import r6, register

WS = tx.WS_CLASS
LINK_RE = IMG_LINK_PATTERN.replace("'", "''")
INTERNAL = r"https://site\.example/items/(\d+)(?:[/?#][^\s]*)?"


def linked_texts(t):
    """Documents as they are, plus markdown built from page URLs (the test texts hold no links)."""
    p = t.pages
    md = F.when(F.length("url") > 40,
                F.concat(F.lit("Intro "), F.col("url"), F.lit(" see [page]("), F.col("url"), F.lit(") and ![pic]("),
                         F.col("url"), F.lit("/img.png) end")))
    md = md.otherwise(F.concat(F.lit("Only [one]("), F.col("url"), F.lit(")")))
    docs = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = p.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), md.alias("text"))
    return docs.unionByName(pages)


LINKED_SQL = """texts AS (
  SELECT 'd' || CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL
  SELECT 'p' || CAST(page_id AS VARCHAR) AS id,
         CASE WHEN length(url) > 40 THEN 'Intro ' || url || ' see [page](' || url || ') and ![pic](' || url || '/img.png) end'
              ELSE 'Only [one](' || url || ')' END AS text FROM pages)"""


@register("sf1_sf2_image_link_features", f"""
WITH {LINKED_SQL}
SELECT id, regexp_matches(COALESCE(text, ''), '{LINK_RE}') AS has_link,
       len(regexp_extract_all(COALESCE(text, ''), '{LINK_RE}', 0)) AS n_links
FROM texts
""")
def sf1_sf2_links(spark, d):
    x = linked_texts(Tables(spark, d))
    return x.select("id", tx.has_image_or_link("text").alias("has_link"),
                    tx.count_image_or_links("text").alias("n_links"))


def internal_link_texts(t):
    o = t.orders
    return o.select(F.col("o_orderkey").alias("itemId"),
                    F.concat(F.lit("ref https://site.example/items/"), F.col("o_custkey").cast("string"),
                             F.lit("?x=1 and https://site.example/items/"),
                             (F.col("o_orderkey") + 1).cast("string"), F.lit(" done")).alias("text"))


@register("sf3_internal_link_ids", r"""
WITH x AS (SELECT o_orderkey AS itemId,
  'ref https://site.example/items/' || CAST(o_custkey AS VARCHAR) || '?x=1 and https://site.example/items/'
  || CAST(o_orderkey + 1 AS VARCHAR) || ' done' AS text FROM orders),
y AS (SELECT itemId, regexp_extract_all(text, 'https://site\.example/items/(\d+)(?:[/?#][^\s]*)?', 1) AS ids FROM x)
SELECT itemId, CAST(u.pos AS BIGINT) AS pos, CAST(u.target AS BIGINT) AS target
FROM y, LATERAL (SELECT unnest(ids) AS target, unnest(range(len(ids))) AS pos) u
""")
def sf3_internal_links(spark, d):
    x = internal_link_texts(Tables(spark, d))
    return (x.select("itemId", F.posexplode(tx.internal_link_ids("text", INTERNAL)).alias("pos", "target"))
            .select("itemId", F.col("pos").cast("bigint").alias("pos"), "target"))


@register("sf4_calendar_periods", """
SELECT event_id,
  CAST(CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS TIMESTAMP) AS week,
  CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day,
  CAST(date_trunc('month', ts) AS TIMESTAMP) AS month,
  CAST(date_trunc('quarter', ts) AS TIMESTAMP) AS quarter
FROM events
""")
def sf4_calendar(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", tf.as_week("ts").cast("timestamp").alias("week"),
                    tf.as_date("ts").cast("timestamp").alias("day"),
                    tf.as_month("ts").cast("timestamp").alias("month"),
                    tf.as_quarter("ts").cast("timestamp").alias("quarter"))


@register("sf5_ceil_hours_between", """
SELECT l.l_orderkey, l.l_linenumber,
       CAST(ceil((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 3600000000.0) AS BIGINT) AS hours_after
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
""")
def sf5_ceil_hours(spark, d):
    t = Tables(spark, d)
    li, o = t.lineitem, t.orders
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select("l_orderkey", "l_linenumber",
                    tf.ceil_hours_between("l_shipdate", "o_orderdate").cast("bigint").alias("hours_after"))


@register("sf6_word_blank_link_only", f"""
SELECT doc_id,
  len(list_filter(regexp_split_to_array(COALESCE(text, ''), '{WS}+'), lambda x: x <> '')) AS num_words,
  regexp_matches(COALESCE(text, ''), '^{WS}*$') AS blank,
  (NULLIF(source, 'src0') IS NOT NULL AND NULLIF(source, 'src0') <> '')
    AND regexp_matches(COALESCE(text, ''), '^{WS}*$') AS link_only
FROM documents
""")
def sf6_words(spark, d):
    doc = Tables(spark, d).documents.withColumn("url", F.nullif("source", F.lit("src0")))
    return doc.select("doc_id", tx.word_count("text").alias("num_words"), tx.is_blank("text").alias("blank"),
                      tx.link_only("url", "text").alias("link_only"))


@register("sf7_sf8_logs_and_signed_logs", """
SELECT event_id, ROUND(ln(1 + value), 6) AS log1p_value, ROUND(sqrt(value), 6) AS sqrt_value,
       ROUND(sign(value - 25) * ln(1 + abs(value - 25)), 6) AS signed_log,
       ROUND(sign(value - 25) * log10(1 + abs(value - 25)), 6) AS signed_log10
FROM events
""")
def sf7_sf8_logs(spark, d):
    e = Tables(spark, d).events
    return e.select("event_id", r6(F.log1p("value")).alias("log1p_value"), r6(F.sqrt("value")).alias("sqrt_value"),
                    r6(mf.signed_log(F.col("value") - 25)).alias("signed_log"),
                    r6(mf.signed_log10(F.col("value") - 25)).alias("signed_log10"))


COEF_SQL = """c AS (SELECT l_suppkey, AVG(l_discount) - 0.05 AS coef, STDDEV_SAMP(l_discount) / sqrt(COUNT(*)) AS serr
                 FROM lineitem GROUP BY l_suppkey)"""


def coef_table(t):
    li = t.lineitem
    return li.groupBy("l_suppkey").agg((F.avg("l_discount") - 0.05).alias("coef"),
                                       (F.stddev_samp("l_discount") / F.sqrt(F.count(F.lit(1)))).alias("serr"))


@register("sf9_sf10_stars_and_effects", f"""
WITH {COEF_SQL}
SELECT l_suppkey,
  CASE WHEN serr = 0 THEN '***' WHEN abs(coef / serr) > 2.576 THEN '***' WHEN abs(coef / serr) > 1.96 THEN '**'
       WHEN abs(coef / serr) > 1.645 THEN '*' ELSE '' END AS stars,
  ROUND(exp(coef * ln(2)) - 1, 6) AS double_effect,
  ROUND(coef - 1.96 * serr, 6) AS ci_low, ROUND(coef + 1.96 * serr, 6) AS ci_high
FROM c
""")
def sf9_sf10_stars(spark, d):
    c = coef_table(Tables(spark, d))
    lo, hi = mf.normal_ci("coef", "serr")
    return c.select("l_suppkey", mf.stars("coef", "serr").alias("stars"),
                    r6(mf.double_effect("coef")).alias("double_effect"), r6(lo).alias("ci_low"),
                    r6(hi).alias("ci_high"))


@register("sf11_sha256", "SELECT doc_id, sha256(text) AS text_hash FROM documents")
def sf11_sha256(spark, d):
    return Tables(spark, d).documents.select("doc_id", tx.sha256_hex("text").alias("text_hash"))


@register("sf12_sanitize")
def sf12_sanitize(spark, d):
    """NFKD accent strip of whole texts (Arrow-batched pandas UDF: NFKD has no built-in)."""
    doc = Tables(spark, d).documents
    return doc.select("doc_id", tx.sanitize("text").alias("clean_text"))


@register("sf13_uuid5")
def sf13_uuid5(spark, d):
    return Tables(spark, d).documents.select("doc_id", tx.uuid5_dns("text").alias("uuid"))


@register("sf14_chunk_tokens", r"""
WITH t AS (SELECT doc_id, len(regexp_extract_all(COALESCE(text, ''), '\w+|[^\w\s]', 0)) AS n FROM documents),
c AS (SELECT doc_id, n, unnest(range(CAST(greatest(1, ceil(n / 128.0)) AS BIGINT))) AS chunk FROM t)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, CAST(greatest(0, least(128, n - chunk * 128)) AS INTEGER) AS n_tokens
FROM c
""")
def sf14_chunks(spark, d):
    doc = Tables(spark, d).documents
    ch = doc.select("doc_id", F.posexplode(tx.chunk_tokens(tx.token_array("text"), 128)).alias("chunk", "toks"))
    return ch.select("doc_id", F.col("chunk").cast("int").alias("chunk"), F.size("toks").cast("int").alias("n_tokens"))


@register("sf15_cosine_distance", """
SELECT a.vec_id, ROUND(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)
  AS cos_dist
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def sf15_cosine(spark, d):
    e = Tables(spark, d).embeddings
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2"))
    return e.join(b, "vec_id").select("vec_id", r6(vx.cosine_distance("embedding", "e2")).alias("cos_dist"))


@register("sf16_l2_normalize", """
WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) /
             sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS u
           FROM embeddings)
SELECT vec_id, ROUND(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, ROUND(list_max(u), 6) AS max_component
FROM n
""")
def sf16_l2_normalize(spark, d):
    e = Tables(spark, d).embeddings.select("vec_id", vx.l2_normalize("embedding").alias("u"))
    return e.select("vec_id", r6(vx.l2_norm("u")).alias("norm"), r6(F.array_max("u")).alias("max_component"))


@register("sf17_weighted_mean_vectors", """
WITH x AS (SELECT label, vec_id, 1.0 + CAST(embedding[1] AS DOUBLE) * CAST(embedding[1] AS DOUBLE) AS w,
                  unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, ROUND(SUM(CAST(v AS DOUBLE) * w) / SUM(w), 6) AS mean_value
FROM x GROUP BY label, pos
""")
def sf17_weighted_mean(spark, d):
    e = Tables(spark, d).embeddings.withColumn(
        "w", 1.0 + F.col("embedding")[0].cast("double") * F.col("embedding")[0].cast("double"))
    m = vx.weighted_mean_vectors(e, "label", "embedding", "w", "mean_vec")
    return m.select("label", F.posexplode("mean_vec").alias("pos", "mean_value")).select(
        "label", F.col("pos").cast("int").alias("pos"), r6("mean_value").alias("mean_value"))


@register("sf18_sf19_quality_and_post_type", f"""
WITH b AS (SELECT doc_id,
  len(list_filter(regexp_split_to_array(COALESCE(text, ''), '{WS}+'), lambda x: x <> '')) AS num_words,
  len(regexp_extract_all(COALESCE(text, ''), '{LINK_RE}', 0)) AS n_links,
  NULLIF(source, 'src0') IS NOT NULL AND NULLIF(source, 'src0') <> '' AS is_link
  FROM documents),
m AS (SELECT quantile_cont(num_words, 0.5) FILTER (WHERE num_words > 0) AS med FROM b)
SELECT doc_id, num_words > 50 AS hi_words, num_words > 0 AND num_words <= 50 AS lo_words,
  (num_words > 50 AND NOT is_link) OR (is_link AND num_words > 50 AND n_links > 0) AS hi_quality,
  CASE WHEN num_words > 0 AND num_words <= med AND n_links = 0 THEN 1
       WHEN num_words > 0 AND num_words <= med AND n_links > 0 THEN 2
       WHEN num_words > 0 AND num_words > med AND n_links = 0 THEN 3
       WHEN num_words > 0 AND num_words > med AND n_links > 0 THEN 4 ELSE 0 END AS post_type
FROM b, m
""")
def sf18_sf19_quality(spark, d):
    doc = Tables(spark, d).documents
    b = doc.select("doc_id", tx.word_count("text").alias("num_words"),
                   tx.count_image_or_links("text").alias("n_links"),
                   tx.is_link_post(F.nullif("source", F.lit("src0"))).alias("is_link"))
    med = quantile_frame(b.where(F.col("num_words") > 0), "num_words", 0.5, "med")
    q = tx.quality_flags("num_words", "n_links", "is_link")
    x = b.crossJoin(F.broadcast(med))
    return x.select("doc_id", q["hi_words"].alias("hi_words"), q["lo_words"].alias("lo_words"),
                    q["hi_quality"].alias("hi_quality"),
                    tx.post_type("num_words", "n_links", "med").alias("post_type"))


LANGS = ("de", "en", "es", "fr")


@register("sf20_one_hot", "SELECT doc_id, " + ", ".join(
    f"CAST(lang = '{c}' AS INTEGER) AS is_cat_{c}, CASE WHEN lang = '{c}' THEN n_chars ELSE 0 END AS n_chars_{c}"
    for c in LANGS) + " FROM documents")
def sf20_one_hot(spark, d):
    doc = Tables(spark, d).documents
    cols = []
    for c in LANGS:
        cols += [(F.col("lang") == c).cast("int").alias(f"is_cat_{c}"),
                 F.when(F.col("lang") == c, F.col("n_chars")).otherwise(F.lit(0)).alias(f"n_chars_{c}")]
    return doc.select("doc_id", *cols)


@register("sf21_composite_key", """
SELECT o_orderkey, o_orderpriority || '_' || CAST(o_custkey AS VARCHAR) AS sub_owner FROM orders
""")
def sf21_composite_key(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", F.concat_ws("_", "o_orderpriority", F.col("o_custkey").cast("string"))
                    .alias("sub_owner"))


@register("sf22_local_time_fields", """
WITH x AS (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS lt FROM events)
SELECT event_id, CAST((dayofweek(lt) + 6) % 7 AS INTEGER) AS dow, CAST(hour(lt) AS INTEGER) AS hour,
       CAST(((dayofweek(lt) + 6) % 7) * 24 + hour(lt) AS INTEGER) AS hour_of_week
FROM x
""")
def sf22_local_time(spark, d):
    e = Tables(spark, d).events
    lt = tf.to_local("ts", "America/New_York")
    return e.select("event_id", F.weekday(lt).cast("int").alias("dow"), F.hour(lt).cast("int").alias("hour"),
                    tf.hour_of_week("ts", "America/New_York").cast("int").alias("hour_of_week"))


@register("sf23_seconds_of_day_circular", """
WITH x AS (SELECT event_id, user_id, hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS INTEGER) AS sod
           FROM events),
m AS (SELECT user_id, AVG(sod) AS peak FROM x GROUP BY user_id)
SELECT x.event_id, x.sod,
  ROUND(((m.peak - x.sod + 43200) - 86400 * floor((m.peak - x.sod + 43200) / 86400)) - 43200, 6) AS circ_diff
FROM x JOIN m ON x.user_id = m.user_id
""")
def sf23_seconds_circular(spark, d):
    e = Tables(spark, d).events.select("event_id", "user_id", tf.seconds_of_day("ts").alias("sod"))
    m = e.groupBy("user_id").agg(F.avg("sod").alias("peak"))
    return e.join(m, "user_id").select("event_id", "sod",
                                       r6(tf.circular_diff(F.col("peak") - F.col("sod"), 86400)).alias("circ_diff"))


@register("sf24_logistic", """
SELECT event_id, ROUND(1 / (1 + exp(-(value - 25) / 10)), 6) AS p,
       ROUND(1 / (1 + exp(-(value - 20) / 10)) - 1 / (1 + exp(-(value - 25) / 10)), 6) AS dp
FROM events
""")
def sf24_logistic(spark, d):
    e = Tables(spark, d).events
    p0 = mf.logistic((F.col("value") - 25) / 10)
    p1 = mf.logistic((F.col("value") - 20) / 10)
    return e.select("event_id", r6(p0).alias("p"), r6(p1 - p0).alias("dp"))


@register("sf25_interactions", """
SELECT o_orderkey, ROUND(o_totalprice * CAST(o_orderstatus = 'F' AS DOUBLE), 6) AS cost_x_failed,
       ROUND(ln(o_totalprice) * CAST(o_orderpriority = '1-URGENT' AS DOUBLE), 6) AS lncost_x_urgent
FROM orders
""")
def sf25_interactions(spark, d):
    o = Tables(spark, d).orders
    return o.select("o_orderkey", r6(mf.interaction("o_totalprice", F.col("o_orderstatus") == "F")).alias("cost_x_failed"),
                    r6(mf.interaction(F.log("o_totalprice"), F.col("o_orderpriority") == "1-URGENT"))
                    .alias("lncost_x_urgent"))
