"""Streaming queries over the given event table, read as a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.streaming import ingest as IN
from clipweave.streaming import runs as R
from clipweave.streaming import sessions as S
from clipweave.streaming import tasks as K

#: the watermark trails the newest event by this much; younger sessions are still open
LATE = "6 hours"
_NOW = "wm AS (SELECT max(ts) - INTERVAL 6 HOUR AS wm FROM events)"


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = A.read(spark, d, "events").schema
    return R.file_stream(spark, f"{d}/events.parque[t]", schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _states(e: DataFrame) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "view", "pending").when(t == "click", "running").when(t == "purchase", "done").when(t == "error", "error").otherwise("cancelled")
    return e.select(F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"), status.alias("status"))


@query("task_state_stream", "STR-1", "STR-3", oracle="""
WITH e AS (SELECT user_id, ts, event_id, event_type, min(CASE WHEN event_type IN ('purchase', 'error', 'signup') THEN event_id END) OVER (PARTITION BY user_id) AS fin FROM events),
k AS (SELECT * FROM e WHERE fin IS NULL OR event_id <= fin),
f AS (SELECT user_id, min(CASE WHEN event_type = 'view' THEN event_id END) AS v, min(CASE WHEN event_type = 'click' THEN event_id END) AS c, any_value(fin) AS fin FROM k GROUP BY 1)
SELECT user_id AS task_id, CASE WHEN fin IS NOT NULL THEN (SELECT CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'error' ELSE 'cancelled' END FROM events WHERE event_id = fin)
  WHEN c IS NOT NULL THEN 'running' ELSE 'pending' END AS status,
  (CASE WHEN fin IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END + CASE WHEN v IS NOT NULL AND (c IS NULL OR v < c) THEN 1 ELSE 0 END)::BIGINT AS n_changes FROM f""")
def task_state_stream(spark: SparkSession, d: str) -> DataFrame:
    got = R.drain(K.task_states(_states(_stream(spark, d)), late=LATE), "tasks")
    return got.groupBy("task_id").agg(F.max_by("status", "n_changes").alias("status"), F.max("n_changes").alias("n_changes"))


def _progress(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("user_id").alias("task_id"), "ts", F.col("event_id").alias("seq"),
        F.when(F.col("event_type") != "signup", F.col("value") / 500).alias("progress"),
        F.when(F.col("event_type").isin("error", "purchase"), F.col("event_type")).alias("message"))


@query("progress_throttle_stream", "STR-2", oracle="""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'signup' THEN value / 500 END AS p, CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS m,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, 0::DOUBLE AS now, -1::DOUBLE AS st, NULL::VARCHAR AS sm, NULL::VARCHAR AS msg, false AS hit FROM e
 UNION ALL SELECT user_id, k, event_id, now, CASE WHEN hit THEN now ELSE st END, CASE WHEN hit THEN msg ELSE sm END, msg, hit FROM (
  SELECT e.user_id, e.k, e.event_id, CASE WHEN e.p IS NULL THEN w.now ELSE greatest(0, least(1, e.p)) END AS now, w.st, w.sm, coalesce(e.m, w.msg) AS msg,
   e.p IS NULL OR abs(greatest(0, least(1, e.p)) - w.st) >= 0.02 OR (e.m IS NOT NULL AND e.m IS DISTINCT FROM w.sm) AS hit
  FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1))
SELECT user_id AS task_id, event_id AS seq, round(now, 6) AS progress, msg AS message FROM w WHERE hit""")
def progress_throttle_stream(spark: SparkSession, d: str) -> DataFrame:
    got = R.drain(K.throttled_progress(_progress(_stream(spark, d)), late=LATE), "progress")
    return got.select("task_id", "seq", F.round("progress", 6).alias("progress"), "message")


_SESS = """
s AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL {gap}, true)::INT AS opens FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY ts, event_id)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY {key} ORDER BY ts, event_id) AS run FROM s)"""


@query("debounce_stream", "STR-4", oracle="WITH " + _NOW + "," + _SESS.format(gap="4 HOUR", src="events", key="user_id") + """
SELECT user_id AS key, arg_max(event_id, struct_pack(a := ts, b := event_id)) AS value, count(*) AS edits FROM r CROSS JOIN wm GROUP BY user_id, run
HAVING max(ts) + INTERVAL 4 HOUR <= any_value(wm)""")
def debounce_stream(spark: SparkSession, d: str) -> DataFrame:
    """Edits of one key within four hours count as one burst (the table spans a month)."""
    edits = _stream(spark, d).select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), F.col("event_id").alias("value"))
    return R.drain(S.debounce(edits, "4 hours", LATE), "debounce").select("key", "value", "edits")


@query("gap_merge_stream", "STR-9", oracle="WITH " + _NOW + "," + _SESS.format(gap="12 HOUR", src="events", key="user_id, event_type") + """
SELECT user_id || ':' || event_type AS key, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS n FROM r CROSS JOIN wm GROUP BY user_id, event_type, run
HAVING max(ts) + INTERVAL 12 HOUR <= any_value(wm)""")
def gap_merge_stream(spark: SparkSession, d: str) -> DataFrame:
    pieces = _stream(spark, d).select(F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("key"), "ts")
    got = R.drain(S.merge_gaps(pieces, "12 hours", LATE), "gaps")
    return got.select("key", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query("retranscribe_stream", "STR-11", oracle="WITH " + _NOW + ", x AS (SELECT *, user_id % 50 AS seg FROM events)," + _SESS.format(gap="2 HOUR", src="x", key="event_type, seg") + """
SELECT event_type AS item_id, seg AS seg_id, count(*) AS requests, epoch_us(min(ts)) AS first_us FROM r CROSS JOIN wm WHERE seg IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
GROUP BY event_type, seg, run HAVING max(ts) + INTERVAL 2 HOUR <= any_value(wm)""")
def retranscribe_stream(spark: SparkSession, d: str) -> DataFrame:
    edits = _stream(spark, d).select(F.col("event_type").alias("item_id"), (F.col("user_id") % 50).alias("seg_id"), "ts")
    got = R.drain(S.retranscription_requests(edits, "2 hours", LATE), "retranscribe")
    live = A.read(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("seg_id"))
    return got.join(live, "seg_id", "left_semi").select("item_id", "seg_id", "requests", F.unix_micros("first_ts").alias("first_us"))


@query("rerun_stream", "STR-5", oracle="""
WITH RECURSIVE e AS (SELECT user_id, event_id, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'request' WHEN event_type = 'purchase' THEN 'done' ELSE 'failed' END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT DISTINCT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, false AS busy, false AS again, NULL::VARCHAR AS reason FROM e
 UNION ALL SELECT e.user_id, e.k, e.event_id, CASE WHEN kind = 'request' THEN true ELSE w.busy AND w.again AND kind = 'done' END,
  CASE WHEN kind = 'request' THEN w.again OR w.busy ELSE w.again AND NOT w.busy END,
  CASE WHEN kind = 'request' AND NOT w.busy THEN 'request' WHEN kind = 'done' AND w.busy AND w.again THEN 'rerun' END
 FROM w JOIN e ON e.user_id = w.user_id AND e.k = w.k + 1)
SELECT user_id AS project_id, event_id AS seq, reason FROM w WHERE reason IS NOT NULL""")
def rerun_stream(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t.isin("view", "click", "signup"), "request").when(t == "purchase", "done").otherwise("failed")
    ev = _stream(spark, d).select(F.col("user_id").alias("project_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"))
    return R.drain(K.coalesced_runs(ev, LATE), "reruns").select("project_id", "seq", "reason")


@query("readiness_stream", "STR-6", oracle="""
WITH e AS (SELECT user_id, event_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
f AS (SELECT user_id, min(CASE WHEN bad THEN k END) AS b, any_value(n) AS n FROM e GROUP BY 1)
SELECT user_id AS task_id, CASE WHEN b IS NULL THEN 'ready' ELSE 'error' END AS state, coalesce(b - 1, n) AS n_done FROM f""")
def readiness_stream(spark: SparkSession, d: str) -> DataFrame:
    need = A.read(spark, d, "events").groupBy(F.col("user_id").alias("task_id")).agg(F.count(F.lit(1)).alias("n_upstream"))
    fin = _stream(spark, d).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("upstream"), "ts", F.col("event_id").alias("seq"),
                                   F.when(F.col("event_type") == "error", "error").otherwise("done").alias("status"))
    return R.drain(K.readiness_stream(fin.join(need, "task_id"), LATE), "ready").select("task_id", "state", "n_done")


@query("absorb_stream", "STR-7", oracle=A.sql(A.VECTORS, A.VDIMS, body="""
SELECT 'c' || label AS char_id, d - 1 AS d, count(*) AS n, round(avg(v), 5) AS value FROM vdims GROUP BY label, d"""))
def absorb_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = A.read(spark, d, "embeddings").schema
    raw = R.file_stream(spark, f"{d}/embeddings.parque[t]", schema)
    shifted = F.transform("embedding", lambda x, i: x.cast("double") + F.when(i == F.col("label"), 3.0).otherwise(0.0))
    samples = raw.select(F.concat(F.lit("c"), F.col("label").cast("string")).alias("char_id"), shifted.alias("emb"))
    rows = R.drain_latest(S.absorb_stream(samples), "absorb")
    last = rows.groupBy("char_id").agg(F.max_by(F.struct("emb", "n"), "batch_id").alias("r"))
    return last.select("char_id", F.posexplode("r.emb").alias("d", "v"), F.col("r.n").alias("n")).select(
        "char_id", "d", "n", F.round("v", 5).alias("value"))


@query("ingest_stream", "STR-8", "UPD-10", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, start_ms, end_ms, CASE WHEN locked THEN text ELSE 'auto' END AS text, CASE WHEN locked THEN character_id ELSE 'auto' END AS character_id, locked FROM segments"""))
def ingest_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every segment arrives again from the recogniser; locked ones must stay as stored."""
    cols = ["item_id", "seg_id", "start_ms", "end_ms", "text", "character_id", "locked"]
    stored = A.segments(spark, d).select(*cols)
    raw = R.file_stream(spark, f"{d}/events.parque[t]", A.read(spark, d, "events").schema)
    t = F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 10_000_000)
    length = F.round(F.col("value") * 100).cast("long")
    new = raw.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("seg_id"), t.alias("start_ms"), (t + length).alias("end_ms"),
                     F.lit("auto").alias("text"), F.lit("auto").alias("character_id"), F.lit(False).alias("locked"), F.col("event_id").alias("version"))
    return IN.ingest_segments(new, stored)


@query("feedback_queue_stream", "STR-10", oracle="""
SELECT user_id AS item_id, event_type AS seg_id, min(event_id) AS ord FROM events GROUP BY 1, 2""")
def feedback_queue_stream(spark: SparkSession, d: str) -> DataFrame:
    """First sample per (item, segment) within the watermark, which here spans the table."""
    smp = _stream(spark, d).select(F.col("user_id").alias("item_id"), F.col("event_type").alias("seg_id"), "ts", F.col("event_id").alias("ord"))
    return R.drain(S.unique_samples(smp, "60 days"), "feedback").select("item_id", "seg_id", "ord")


@query("feedback_batches_stream", "STR-10", oracle="""
WITH RECURSIVE e AS (SELECT user_id AS p, ts, event_id AS s, event_type = 'purchase' AS fin, event_id % 3 AS i, event_type AS g,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
w AS (SELECT DISTINCT p, 0::BIGINT AS k, false AS busy, 0::BIGINT AS n, []::STRUCT(i BIGINT, g VARCHAR, s BIGINT)[] AS q, []::STRUCT(i BIGINT, g VARCHAR, s BIGINT)[] AS sent FROM e
 UNION ALL SELECT p, k, busy OR len(q) > 0, CASE WHEN NOT busy AND len(q) > 0 THEN n + 1 ELSE n END, CASE WHEN busy THEN q ELSE q[21:] END, CASE WHEN busy THEN [] ELSE q[1:20] END FROM (
  SELECT e.p, e.k, w.busy AND NOT e.fin AS busy, w.n, CASE WHEN e.fin THEN w.q ELSE list_append(w.q, {'i': e.i, 'g': e.g, 's': e.s}) END AS q FROM w JOIN e ON e.p = w.p AND e.k = w.k + 1))
SELECT p AS project_id, n AS batch_no, x.i::VARCHAR AS item_id, x.g AS seg_id, min(x.s) AS seq FROM (SELECT p, n, unnest(sent) AS x FROM w) GROUP BY 1, 2, 3, 4""")
def feedback_batches_stream(spark: SparkSession, d: str) -> DataFrame:
    """Samples of every project in batches of at most twenty; a purchase stands for the end of a job."""
    kind = F.when(F.col("event_type") == "purchase", "finish").otherwise("sample")
    ev = _stream(spark, d).select(F.col("user_id").alias("project_id"), "ts", F.col("event_id").alias("seq"), kind.alias("kind"),
                                  (F.col("event_id") % 3).cast("string").alias("item_id"), F.col("event_type").alias("seg_id"))
    return R.drain(K.feedback_batches(ev, LATE), "batches").select("project_id", "batch_no", "item_id", "seg_id", "seq")
