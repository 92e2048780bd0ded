"""Logical tables of the timeline model, derived from the given driver tables.

Times are integer milliseconds. ``SQL`` holds the same derivations as DuckDB CTE
bodies so that every oracle starts from identical rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.plans.scan import neighbour, number_rows, prefix_scan


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: item, t_ms, dur_ms plus the raw columns used later."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("item_id"),
        F.col("event_id"),
        F.floor(micros / 10_000_000).alias("t_ms"),
        F.round(F.col("value") * 100).cast("long").alias("dur_ms"),
        "event_type",
        "value",
    )


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir)
        .groupBy("item_id")
        .agg(F.max(F.col("t_ms") + F.col("dur_ms")).alias("duration_ms"))
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "item_id",
        F.col("event_id").alias("seg_id"),
        F.col("t_ms").alias("start_ms"),
        (F.col("t_ms") + F.col("dur_ms")).alias("end_ms"),
        F.when(F.col("event_type") == "error", "").otherwise(
            F.concat(F.col("event_type"), F.lit(" "), F.col("event_id").cast("string"))
        ).alias("text"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("character_id"),
        (F.col("event_id") % 7 == 0).alias("locked"),
        (F.col("event_id") % 11 == 0).alias("mixed"),
        F.when(F.col("event_id") % 4 != 0, F.col("value") / 3).alias("q"),
        F.col("event_id").alias("ord"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    nxt = prefix_scan(ev, ["item_id"], ["t_ms", "event_id"], reverse=True,
                      end_ms=neighbour(F.col("t_ms")))
    return nxt.filter(F.col("end_ms").isNotNull()).select(
        "item_id",
        F.col("t_ms").alias("start_ms"),
        "end_ms",
        F.col("event_type").alias("label"),
        F.col("event_id").alias("ord"),
    )


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice: the middle half of every event."""
    return (
        events(spark, sf_dir)
        .filter("dur_ms > 3")
        .select("item_id", (F.col("t_ms") + F.floor(F.col("dur_ms") / 4)).alias("start_ms"),
                (F.col("t_ms") + F.floor(F.col("dur_ms") * 3 / 4)).alias("end_ms"),
                F.col("event_id").alias("ord"))
    )


def silences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short pauses: the first tenth of every event."""
    return events(spark, sf_dir).select(
        "item_id", F.col("t_ms").alias("start_ms"),
        (F.col("t_ms") + F.floor(F.col("dur_ms") / 10)).alias("end_ms"),
    )


def sparse_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments that end after a third of their time, which leaves uncovered voice."""
    return segments(spark, sf_dir).withColumn(
        "end_ms", F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 3)
    )


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-item signal: ordered index and a value in [-1, 1]."""
    ev = events(spark, sf_dir)
    x = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.col("value") - 50) / 150))
    return number_rows(ev, ["item_id"], ["t_ms", "event_id"], "n").select(
        "item_id", (F.col("n") - 1).alias("idx"), x.alias("x")
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns on a clock of 60 ms per character."""
    from clipweave.plans.scan import running_sum

    c = read(spark, sf_dir, "conversations").withColumn("n", F.length("text").cast("long"))
    c = prefix_scan(c, ["conv_id"], ["turn"], _e=running_sum(F.col("n") * 60))
    return c.select(
        F.col("conv_id").alias("item_id"),
        F.col("turn").alias("ord"),
        (F.col("_e") - F.col("n") * 60).alias("start_ms"),
        F.col("_e").alias("end_ms"),
        F.col("text"),
        F.col("role"),
    )


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Export candidates: documents with a quality score where one was given."""
    d = read(spark, sf_dir, "documents")
    lab = read(spark, sf_dir, "labels").select("doc_id", "quality")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").alias("item_id"),
        F.col("source").alias("speaker"),
        F.col("lang").alias("language"),
        "text",
        F.lit(0).cast("long").alias("start_ms"),
        (F.col("n_chars") * 10).alias("end_ms"),
        (F.col("quality") * 60 + 30).cast("double").alias("score"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cue vectors: item, ord, and the embedding with +3 on its label's axis."""
    e = read(spark, sf_dir, "embeddings")
    shifted = F.transform(
        "embedding",
        lambda x, i: x.cast("double") + F.when(i == F.col("label"), 3.0).otherwise(0.0),
    )
    return e.select(
        "vec_id",
        (F.col("vec_id") % 20).alias("item_id"),
        F.floor(F.col("vec_id") / 20).alias("ord"),
        "label",
        shifted.alias("emb"),
    )


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known characters: one centroid per label."""
    from clipweave.operators.vectors import centroids

    made = centroids(vectors(spark, sf_dir), ["label"], "emb", normalise=True)
    return made.select(
        F.lit(0).alias("project_id"),
        F.col("label").alias("ord"),
        F.concat(F.lit("c"), F.col("label").cast("string")).alias("char_id"),
        F.col("centroid").alias("emb"),
        F.col("n").cast("int").alias("emb_count"),
    )


def word_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) > 0)


EV = """
ev AS (
  SELECT user_id AS item_id, event_id,
         (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 10000000 AS t_ms,
         CAST(round(value * 100) AS BIGINT) AS dur_ms, event_type, value
  FROM events)"""
ITEMS = """
items AS (SELECT item_id, max(t_ms + dur_ms) AS duration_ms FROM ev GROUP BY 1)"""
SEGMENTS = """
segments AS (
  SELECT item_id, event_id AS seg_id, t_ms AS start_ms, t_ms + dur_ms AS end_ms,
         CASE WHEN event_type = 'error' THEN '' ELSE event_type || ' ' || event_id END AS text,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS character_id,
         event_id % 7 = 0 AS locked, event_id % 11 = 0 AS mixed,
         CASE WHEN event_id % 4 <> 0 THEN value / 3 END AS q, event_id AS ord
  FROM ev)"""
TURNS = """
turns AS (
  SELECT * FROM (
    SELECT item_id, t_ms AS start_ms,
           lead(t_ms) OVER (PARTITION BY item_id ORDER BY t_ms, event_id) AS end_ms,
           event_type AS label, event_id AS ord FROM ev)
  WHERE end_ms IS NOT NULL)"""
SPEECH = """
speech AS (
  SELECT item_id, t_ms + dur_ms // 4 AS start_ms, t_ms + dur_ms * 3 // 4 AS end_ms, event_id AS ord
  FROM ev WHERE dur_ms > 3)"""
SILENCES = """
silences AS (SELECT item_id, t_ms AS start_ms, t_ms + dur_ms // 10 AS end_ms FROM ev)"""
SPARSE = """
sparse AS (SELECT * REPLACE (start_ms + (end_ms - start_ms) // 3 AS end_ms) FROM segments)"""
SAMPLES = """
samples AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY t_ms, event_id) - 1 AS idx,
         least(1.0::DOUBLE, greatest(-1.0::DOUBLE, (value - 50) / 150)) AS x FROM ev)"""
CUES = """
cues AS (
  SELECT conv_id AS item_id, turn AS ord, e - n * 60 AS start_ms, e AS end_ms, text, role
  FROM (SELECT *, CAST(sum(n * 60) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS e
        FROM (SELECT *, length(text) AS n FROM conversations)))"""
CLIPS = """
clips AS (
  SELECT d.doc_id AS ord, d.doc_id AS item_id, source AS speaker, lang AS language, text,
         0::BIGINT AS start_ms, n_chars * 10 AS end_ms, (quality * 60 + 30)::DOUBLE AS score
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
VECTORS = """
vectors AS (
  SELECT vec_id, vec_id % 20 AS item_id, vec_id // 20 AS ord, label,
         list_transform(embedding, lambda x, i:
           x::DOUBLE + CASE WHEN i - 1 = label THEN 3.0::DOUBLE ELSE 0.0::DOUBLE END) AS emb
  FROM embeddings)"""
#: (vec_id, dim, value) form of the vectors, for aggregates over dimensions
VDIMS = """
vdims AS (
  SELECT vec_id, item_id, ord, label, unnest(range(1, len(emb) + 1)) AS d, unnest(emb) AS v
  FROM vectors)"""
POOL = """
pool_means AS (
  SELECT label, d, avg(v) AS m, count(*) AS n FROM vdims GROUP BY 1, 2),
pool AS (
  SELECT label AS ord, 'c' || label AS char_id, any_value(n)::INT AS emb_count,
         list_transform(list(m ORDER BY d),
           lambda x: x / (sqrt(list_sum(list_transform(list(m ORDER BY d), lambda y: y * y))) + 1e-9)) AS emb
  FROM pool_means GROUP BY label)"""


def sql(*ctes: str, body: str) -> str:
    return "WITH " + ",".join(ctes) + "\n" + body
