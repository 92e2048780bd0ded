"""Training-set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.operators import batches as B

IDS = """
ids AS (SELECT doc_id AS ord, greatest(1, n_chars // 4) AS n_ids, lang,
        len(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 0)) AS n_phones FROM documents)"""


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "documents").select(
        F.col("doc_id").alias("ord"), F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).alias("n_ids"), "lang",
        F.size(A.word_tokens(F.col("text"))).alias("n_phones"))


_REASON = """
SELECT ord, CASE WHEN ord % 40 = 5 THEN 'no phonemes' WHEN n_ids > 1350 THEN 'too long' WHEN ord % 30 = 1 THEN 'no phonemes'
  WHEN n_phones > 540 THEN 'too many phones' WHEN n_phones / (n_ids / 25.0) > 25 OR n_phones / (n_ids / 25.0) < 14 THEN 'phone rate' END AS reason FROM ids"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    x = _ids(spark, d).withColumn("n_phones", F.when(F.col("ord") % 40 != 5, F.col("n_phones"))).withColumn(
        "n_unknown", (F.col("ord") % 30 == 1).cast("int"))
    return x.withColumn("reason", B.phone_rate_reason(lo=14.0))


@query("phone_rate_filter", "FIL-10", oracle="WITH " + IDS + _REASON)
def phone_rate_filter(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("ord", "reason")


@query("drop_reason_counts", "AGG-5", "FIL-10", oracle="WITH " + IDS + ", r AS (" + _REASON + ") SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM r GROUP BY 1")
def drop_reason_counts(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.operators.segments import reason_counts

    return reason_counts(_judged(spark, d), F.col("reason"))


@query("acoustic_length", "FIL-11", oracle="""
SELECT doc_id, n_chars * 640 // 1280 AS length FROM documents WHERE n_chars > 0 AND n_chars * 640 / 64000 > 0.6 AND n_chars * 640 / 64000 < 54""")
def acoustic_length(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "documents").select("doc_id", (F.col("n_chars") * 640).alias("bytes"))
    return B.acoustic_length(rows, 32_000, 640).select("doc_id", "length")


@query("length_buckets_drifting", "DST-5", oracle="WITH RECURSIVE " + IDS + """,
h AS (SELECT n_ids, count(*) AS c, row_number() OVER (ORDER BY n_ids) AS k FROM ids GROUP BY 1),
w AS (SELECT 0::BIGINT AS k, 0::BIGINT AS n_ids, 0::BIGINT AS base, 0::BIGINT AS opened, 0::BIGINT AS bucket, 50::BIGINT AS lim
  UNION ALL SELECT h.k, h.n_ids, w.bucket, o, w.bucket + o, w.lim + o * 50
  FROM w JOIN h ON h.k = w.k + 1, LATERAL (SELECT CASE WHEN h.n_ids >= w.lim THEN least(h.c, (h.n_ids - w.lim) // 50 + 1) ELSE 0 END AS o) z)
SELECT i.ord, i.n_ids, w.base + least(row_number() OVER (PARTITION BY i.n_ids ORDER BY i.ord), w.opened) AS bucket FROM ids i JOIN w ON w.n_ids = i.n_ids AND w.k > 0""")
def length_buckets_drifting(spark: SparkSession, d: str) -> DataFrame:
    return B.drifting_buckets(_ids(spark, d)).select("ord", "n_ids", "bucket")


@query("length_buckets_grid", "DST-5", "DST-13", oracle="WITH " + IDS + "SELECT ord, n_ids // 50 AS bucket, round(n_ids / 25.0, 4)::DOUBLE AS seconds FROM ids")
def length_buckets_grid(spark: SparkSession, d: str) -> DataFrame:
    return B.grid_buckets(_ids(spark, d)).select("ord", "bucket", F.round(B.sample_seconds(F.col("n_ids")), 4).alias("seconds"))


_BOUNDS = """
rb AS (SELECT ord, n_ids AS length, CASE WHEN n_ids > 32 AND n_ids <= 300 THEN 0 WHEN n_ids > 300 AND n_ids <= 1900 THEN (n_ids - 201) // 100 END AS raw FROM ids),
bk AS (SELECT ord, length, dense_rank() OVER (ORDER BY raw) - 1 AS bucket FROM rb WHERE raw IS NOT NULL),
sz AS (SELECT bucket, count(*) AS n, CAST(ceil(count(*) / 8.0) AS BIGINT) * 8 AS total FROM bk GROUP BY 1)"""


def _bounded(spark: SparkSession, d: str) -> DataFrame:
    return B.bounded_buckets(_ids(spark, d).withColumnRenamed("n_ids", "length"))


@query("length_buckets_bounds", "DST-6", oracle="WITH " + IDS + "," + _BOUNDS + "SELECT ord, length, bucket FROM bk")
def length_buckets_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounded(spark, d).select("ord", "length", "bucket")


@query("pad_bucket", "DST-7", oracle="WITH " + IDS + "," + _BOUNDS + """,
p AS (SELECT bk.ord, bk.bucket, row_number() OVER (PARTITION BY bk.bucket ORDER BY ord) - 1 AS i, n, total FROM bk JOIN sz USING (bucket))
SELECT bucket, ord, unnest(range(i, total, n)) AS pos FROM p""")
def pad_bucket(spark: SparkSession, d: str) -> DataFrame:
    return B.pad_buckets(_bounded(spark, d), batch=4, replicas=2).select("bucket", "ord", "pos")


@query("epoch_batches", "DST-8")
def epoch_batches(spark: SparkSession, d: str) -> DataFrame:
    out = B.epoch_batches(_bounded(spark, d), 4, 2, seed=1, epoch=3)
    return out.select("rank", "bucket", "batch_no", "batch_order", "ord", "pos")


@query("epoch_batch_shape", "DST-8", oracle="WITH " + IDS + "," + _BOUNDS + """
SELECT bucket, r AS rank, (total // 8)::BIGINT AS n_batches, (total // 2)::BIGINT AS n_rows FROM sz CROSS JOIN (SELECT unnest([0, 1]) AS r)""")
def epoch_batch_shape(spark: SparkSession, d: str) -> DataFrame:
    return epoch_batches(spark, d).groupBy("bucket", "rank").agg(
        F.countDistinct("batch_no").alias("n_batches"), F.count(F.lit(1)).alias("n_rows"))


@query("divisible_ranks", "DST-8", oracle="""
WITH t AS (SELECT count(*) AS n, CAST(ceil(count(*) / 7.0) AS BIGINT) * 7 AS total FROM documents),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents)
SELECT doc_id AS ord, pos, pos % 7 AS rank FROM (SELECT doc_id, unnest(range(i, total, n)) AS pos FROM p CROSS JOIN t)""")
def divisible_ranks(spark: SparkSession, d: str) -> DataFrame:
    return B.divisible(A.read(spark, d, "documents").select(F.col("doc_id").alias("ord")), 7).select("ord", "pos", "rank")


@query("pad_arrays", "DST-9", oracle="""
WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS a FROM conversations),
m AS (SELECT conv_id, max(len(a)) AS m FROM w GROUP BY 1)
SELECT conv_id, turn, m::INT AS padded, (m - len(a))::INT AS n_pad, (list_sum(list_transform(a, lambda x: length(x))) + 1024 * (m - len(a)))::BIGINT AS total FROM w JOIN m USING (conv_id)""")
def pad_arrays(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), F.length).alias("ids"))
    rows = rows.withColumn("n", F.size("ids"))
    out = B.pad_arrays(rows, ["conv_id"], {"ids": 1024})
    return out.select("conv_id", "turn", F.size("ids").alias("padded"), (F.size("ids") - F.col("n")).alias("n_pad"),
                      F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "documents").select("lang", F.col("doc_id").alias("ord"), "n_chars")


@query("homogeneous_batches", "DST-10", "DST-11", oracle="""
WITH RECURSIVE t AS (SELECT lang, doc_id AS ord, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS p FROM documents),
a AS (SELECT *, list(n_chars) OVER (PARTITION BY lang ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS part FROM t),
h AS (SELECT lang, p, list_max(list_filter(range(1, len(part) + 1), lambda k: k = 1 OR (list_sum(part[1:k]) > 0
        AND part[k // 2 + 1] * k >= 0.75 * list_sum(part[1:k])))) AS take FROM a),
c AS (SELECT lang, p, take, 0::BIGINT AS batch_no FROM h WHERE p = 1
      UNION ALL SELECT h.lang, h.p, h.take, batch_no + 1 FROM c JOIN h ON h.lang = c.lang AND h.p = c.p + c.take)
SELECT t.lang, t.ord, batch_no FROM t JOIN c ON c.lang = t.lang AND t.p >= c.p AND t.p < c.p + c.take""")
def homogeneous_batches(spark: SparkSession, d: str) -> DataFrame:
    return B.original_order(B.homogeneous_batches(_texts(spark, d), ["lang"], 8))


@query("effective_batch", "DST-12", oracle="""
SELECT source, count(*) AS n, greatest(least(8, count(*) // 4), 1) AS batch FROM documents GROUP BY 1""")
def effective_batch(spark: SparkSession, d: str) -> DataFrame:
    n = A.read(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("batch", B.effective_batch(F.col("n"), 8))


@query("asr_manifest", "DST-14", "TXT-13", oracle="""
SELECT '/asr/' || conv_id || '/' || turn || '.wav' AS path, 'anna' AS speaker, 'ja' AS language, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text
FROM conversations WHERE regexp_matches(text, '\\S')""")
def asr_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "conversations")
    raw = c.select(F.concat(F.lit("\\asr\\"), "conv_id", F.lit("\\"), "turn", F.lit(".wav")).alias("wav_path"),
                   F.concat(F.lit("<|ja|><|NEUTRAL|> "), "text").alias("text"))
    return B.asr_manifest(raw, "anna", "ja")


@query("clean_paths", "DST-15", oracle="""
SELECT page_id, regexp_replace(replace(url, '\\', '/'), '[/]+$', '') AS path, string_split(regexp_replace(replace(url, '\\', '/'), '[/]+$', ''), '/')[-1] AS base FROM pages""")
def clean_paths(spark: SparkSession, d: str) -> DataFrame:
    raw = F.concat(F.lit(" \""), F.translate("url", "/", "\\"), F.lit("\"‪\\/"))
    p = A.read(spark, d, "pages").select("page_id", B.clean_path(raw).alias("path"))
    return p.select("page_id", F.regexp_replace("path", "/+$", "").alias("path")).withColumn("base", B.base_name(F.col("path")))


@query("readiness", "DST-16", oracle="""
WITH e AS (SELECT DISTINCT o_custkey AS exp, p AS artefact FROM orders CROSS JOIN (SELECT unnest(['1-URGENT','2-HIGH','3-MEDIUM','5-LOW']) AS p)),
g AS (SELECT o_custkey AS exp, o_orderpriority AS artefact, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS n FROM orders GROUP BY 1, 2)
SELECT e.exp, bool_and(coalesce(n, 0) > 0) AS ready, count(CASE WHEN n IS NULL THEN 1 END) AS missing, count(CASE WHEN n = 0 THEN 1 END) AS empty
FROM e LEFT JOIN g USING (exp, artefact) GROUP BY 1""")
def readiness(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    wanted = F.array(*[F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW")])
    expected = o.select(F.col("o_custkey").alias("exp")).distinct().withColumn("artefact", F.explode(wanted))
    present = o.groupBy(F.col("o_custkey").alias("exp"), F.col("o_orderpriority").alias("artefact")).agg(
        F.count_if(F.col("o_orderstatus") != "F").alias("n_rows"))
    return B.ready(expected, present)
