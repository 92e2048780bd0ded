"""Clip filters, summaries, orderings and the export plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.operators import segments as S
from clipweave.plans import export as X
from clipweave.plans.identify import number_by_appearance

BLANK = "length(regexp_replace(coalesce({c}, ''), '[\\s　]', '', 'g')) = 0"


@query("segment_issues", "FIL-1", oracle=A.sql(A.EV, A.SEGMENTS, body=f"""
SELECT item_id, seg_id, concat_ws(',', CASE WHEN mixed THEN 'mixed' END, CASE WHEN {BLANK.format(c="text")} THEN 'blank' END,
  CASE WHEN end_ms - start_ms < 1000 THEN 'short' END, CASE WHEN end_ms - start_ms > 15000 THEN 'long' END) AS issues FROM segments"""))
def segment_issues(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(spark, d).select("item_id", "seg_id", F.array_join(S.segment_issues(), ",").alias("issues"))


@query("view_filter", "FIL-4", "AGG-7", oracle=A.sql(A.EV, A.SEGMENTS, f"""
j AS (SELECT *, mixed OR {BLANK.format(c="text")} OR end_ms - start_ms < 1000 OR end_ms - start_ms > 15000 AS bad FROM segments)""", body="""
SELECT 'ok' AS status, count(*) AS n FROM j WHERE NOT bad AND contains(lower(text), 'view') UNION ALL
SELECT 'bad', count(*) FROM j WHERE bad AND contains(lower(text), 'view') UNION ALL
SELECT 'locked', count(*) FROM j WHERE locked AND contains(lower(text), 'view') UNION ALL
SELECT 'unassigned', count(*) FROM j WHERE character_id IS NULL AND contains(lower(text), 'view') UNION ALL
SELECT 'all', count(*) FROM j WHERE contains(lower(text), 'view')"""))
def view_filter(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.plans.scan import union_all

    seg = A.segments(spark, d)
    return union_all([
        S.view_filter(seg, " View ", status=s).agg(F.lit(s).alias("status"), F.count(F.lit(1)).alias("n"))
        for s in ("ok", "bad", "locked", "unassigned", "all")
    ])


@query("export_skip_reason", "FIL-3", "AGG-5", oracle=A.sql(A.CLIPS, body=f"""
SELECT CASE WHEN {BLANK.format(c="text")} THEN 'blank' WHEN end_ms - start_ms < 800 THEN 'short'
            WHEN score IS NOT NULL AND score < 50 THEN 'low score' ELSE 'kept' END AS reason, count(*) AS n FROM clips GROUP BY 1"""))
def export_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    return S.reason_counts(A.clips(spark, d), S.skip_reason(min_score=50))


@query("role_clips", "FIL-5", oracle=A.sql(A.EV, A.SEGMENTS, body=f"""
SELECT item_id, seg_id, character_id FROM segments
WHERE character_id IS NOT NULL AND NOT ({BLANK.format(c="text")}) AND end_ms - start_ms >= 500"""))
def role_clips(spark: SparkSession, d: str) -> DataFrame:
    return S.role_clips(A.segments(spark, d)).select("item_id", "seg_id", "character_id")


@query("cues_to_segments", "FIL-6", oracle=A.sql(A.CUES, body="""
SELECT item_id, ord, start_ms, end_ms, text, 'JP' AS language, NULL::VARCHAR AS speaker_label, NULL::VARCHAR AS character_id,
       false AS mixed FROM cues WHERE end_ms > start_ms"""))
def cues_to_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.cues_to_segments(A.cues(spark, d))


@query("asr_filter", "FIL-7", oracle="""
SELECT conv_id, turn, length(text) AS n FROM conversations
WHERE length(text) >= 2 AND NOT regexp_matches(text, '[가-힯]') AND NOT regexp_full_match(text, '[.!?、。！？\\s]+')""")
def asr_filter(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "conversations")
    return c.filter(S.usable_transcript(F.col("text"))).select("conv_id", "turn", F.length("text").alias("n"))


_TRAIN = "CASE WHEN code IN ('ZH','zh') THEN 'zh' WHEN code IN ('JP','jp','JA','ja') THEN 'ja' WHEN code IN ('EN','en','En') THEN 'en' WHEN code IN ('KO','Ko','ko') THEN 'ko' WHEN code IN ('yue','YUE','Yue') THEN 'yue' END"


@query("language_map", "FIL-8", "FIL-9", oracle=f"""
WITH c AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN upper(lang) WHEN 1 THEN 'JP' WHEN 2 THEN lang WHEN 3 THEN 'ja-JP' END AS code FROM documents)
SELECT doc_id, {_TRAIN} AS train_lang, {_TRAIN} IS NULL AS rejected,
       CASE upper(code) WHEN 'JP' THEN 'ja' WHEN 'ZH' THEN 'zh' WHEN 'EN' THEN 'en' WHEN 'JA' THEN 'ja' WHEN 'JA-JP' THEN 'ja'
            ELSE lower(coalesce(code, 'ja')) END AS lenient FROM c""")
def language_map(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 5
    code = F.when(k == 0, F.upper("lang")).when(k == 1, "JP").when(k == 2, F.col("lang")).when(k == 3, "ja-JP")
    c = A.read(spark, d, "documents").select("doc_id", code.alias("code"))
    return c.select(
        "doc_id", S.train_language(F.col("code")).alias("train_lang"),
        S.train_language(F.col("code")).isNull().alias("rejected"), S.lenient_language(F.col("code")).alias("lenient"),
    )


@query("feedback_samples", "FIL-14", "UPD-19", oracle="""
WITH raw AS (SELECT event_id AS ord, user_id % 3 AS item, event_id % 5 AS seg, event_type AS ch, value FROM events),
c AS (SELECT * FROM raw WHERE ord % 4 <> 1), h AS (SELECT *, (row_number() OVER (PARTITION BY item ORDER BY ord) - 1) // 20 AS batch_no FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY item, batch_no, seg ORDER BY ord) AS rk FROM h WHERE ch <> 'error')
SELECT ord, batch_no, item::VARCHAR AS item_id, seg::VARCHAR AS seg_id, ch AS character_id, round(value, 2) AS start, round(value + 1, 2) AS "end" FROM f WHERE rk = 1""")
def feedback_samples(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    raw = e.select(
        F.col("event_id").alias("ord"), (F.col("user_id") % 3).cast("string").alias("item_id"),
        (F.col("event_id") % 5).cast("string").alias("seg_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("character_id"),
        F.when(F.col("event_id") % 4 == 1, "not a number").otherwise(F.col("value").cast("string")).alias("start"),
        (F.col("value") + 1).cast("string").alias("end"),
    )
    return S.clean_samples(raw).select(
        "ord", "batch_no", "item_id", "seg_id", "character_id", F.round("start", 2).alias("start"), F.round("end", 2).alias("end")
    )


@query("media_filter", "FIL-15", oracle="""
SELECT page_id, url AS name FROM pages WHERE contains(lower(url), 'example.com') AND page_id % 3 <> 0""")
def media_filter(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "pages").select(
        "page_id", F.col("url").alias("name"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("path")
    )
    return S.media_filter(p, "Example.COM", playable=True).select("page_id", "name")


@query("pending_transcription", "FIL-16", "AGG-8", oracle=A.sql(A.EV, A.SEGMENTS, body=f"""
SELECT count(CASE WHEN {BLANK.format(c="text")} AND NOT locked THEN 1 END) AS pending,
       count(CASE WHEN character_id IS NULL THEN 1 END) AS unassigned, count(CASE WHEN {BLANK.format(c="text")} THEN 1 END) AS blank,
       count(*) AS total FROM segments"""))
def pending_transcription(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    return S.badges(seg).withColumn("pending", S.pending_transcription(seg).agg(F.count(F.lit(1))).scalar())


@query("best_streams", "FIL-17", oracle="""
WITH f AS (SELECT l_orderkey AS media_id, l_linenumber AS format_id, l_partkey * 10 + l_linenumber AS ord, l_returnflag,
  CASE WHEN l_returnflag = 'A' THEN 'single' WHEN l_returnflag = 'R' THEN 'audio' END AS kind,
  CASE WHEN l_returnflag = 'A' THEN coalesce(CASE WHEN l_linenumber <> 3 THEN l_suppkey END, 0)
       ELSE coalesce(CASE WHEN l_linenumber <> 2 THEN l_quantity END, 0) END AS rank FROM lineitem WHERE l_suppkey % 6 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY media_id, kind ORDER BY rank DESC, ord) AS rk FROM f WHERE kind IS NOT NULL)
SELECT media_id, kind, format_id, rank::DOUBLE AS rank FROM r WHERE rk = 1""")
def best_streams(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("media_id"), F.col("l_linenumber").alias("format_id"),
        (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ord"),
        F.when(F.col("l_returnflag") == "A", "h264").otherwise("none").alias("vcodec"),
        F.when(F.col("l_returnflag") == "N", "none").otherwise("aac").alias("acodec"),
        F.when(F.col("l_linenumber") != 3, F.col("l_suppkey").cast("double")).alias("height"),
        F.when(F.col("l_linenumber") != 2, F.col("l_quantity")).alias("abr"),
        F.when(F.col("l_suppkey") % 6 != 0, "u").alias("url"),
    )
    return S.best_streams(li)


@query("role_stats", "AGG-1", oracle=A.sql(A.EV, A.SEGMENTS, f"""
u AS (SELECT character_id, CASE WHEN ord % 3 = 0 THEN 'en' ELSE 'ja' END AS lang, end_ms - start_ms AS ms, ord FROM segments
      WHERE character_id IS NOT NULL AND NOT ({BLANK.format(c="text")}) AND end_ms - start_ms >= 500),
l AS (SELECT character_id, lang, count(*) AS n, sum(ms) AS ms, min(ord) AS f FROM u GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY n DESC, f) AS rk FROM l)""", body="""
SELECT character_id, sum(n)::BIGINT AS clips, round(sum(ms) / 1000, 1) AS seconds, max(CASE WHEN rk = 1 THEN lang END) AS language
FROM r GROUP BY 1"""))
def role_stats(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d).withColumn("language", F.when(F.col("ord") % 3 == 0, "EN").when(F.col("ord") % 3 == 1, "JP"))
    return S.role_stats(seg)


@query("majority_language", "AGG-1", "UDF-3", oracle=A.sql(A.CLIPS, """
v AS (SELECT speaker, language, count(*) AS votes, min(ord) AS f FROM clips GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY votes DESC, f) AS rk FROM v)""",
    body="SELECT speaker, language, votes FROM r WHERE rk = 1"))
def majority_language(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.operators.vectors import majority

    return majority(A.clips(spark, d), ["speaker"], "language", "ord")


@query("quality_summary", "AGG-2", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, count(*) AS total, count(q) AS scored, round(avg(q), 1) AS mean_q FROM segments GROUP BY 1"""))
def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.quality_summary(A.segments(spark, d), ["item_id"])


@query("identification_summary", "AGG-3", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, count(*) AS total, count(character_id) AS labelled, count(CASE WHEN mixed THEN 1 END) AS mixed,
       count(DISTINCT character_id) AS speakers FROM segments GROUP BY 1"""))
def identification_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.identification_summary(A.segments(spark, d).withColumnRenamed("character_id", "label"), ["item_id"])


@query("label_distribution", "AGG-4", oracle=A.sql(A.EV, A.TURNS, body="""
SELECT label, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share FROM turns GROUP BY 1"""))
def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    return S.label_distribution(A.turns(spark, d)).withColumn("share", F.round("share", 6))


@query("media_totals", "AGG-7", oracle=A.sql(A.EV, A.ITEMS, body="""
SELECT sum(duration_ms)::BIGINT AS total_ms, count(*) AS n, count(CASE WHEN duration_ms > 250000 THEN 1 END) AS long_items FROM items"""))
def media_totals(spark: SparkSession, d: str) -> DataFrame:
    return A.items(spark, d).agg(
        F.sum("duration_ms").alias("total_ms"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("duration_ms") > 250_000).alias("long_items"),
    )


@query("first_appearance", "WIN-1", oracle=A.sql(A.EV, A.TURNS, """
f AS (SELECT item_id, label, min(start_ms * 1000000000 + ord) AS f FROM turns GROUP BY 1, 2)""", body="""
SELECT item_id, label, row_number() OVER (PARTITION BY item_id ORDER BY f) - 1 AS num FROM f"""))
def first_appearance(spark: SparkSession, d: str) -> DataFrame:
    out = number_by_appearance(A.turns(spark, d), ["item_id"], "label", ["start_ms", "ord"], "num")
    return out.select("item_id", "label", "num").distinct()


@query("holdout_lines", "WIN-3", oracle=A.sql(A.CLIPS, f"""
k AS (SELECT ord AS seq FROM clips WHERE NOT ({BLANK.format(c="text")}) AND end_ms - start_ms >= 800),
n AS (SELECT seq, row_number() OVER (ORDER BY seq) AS line_no FROM k)""", body="SELECT seq, line_no, line_no % 10 = 0 AS is_val FROM n"))
def holdout_lines(spark: SparkSession, d: str) -> DataFrame:
    kept = A.clips(spark, d).filter(S.skip_reason().isNull()).select(F.col("ord").alias("seq"))
    return S.holdout_lines(kept, 0.1)


@query("modulo_shard", "WIN-6", oracle="SELECT doc_id, doc_id AS ord FROM documents WHERE doc_id % 7 = 3")
def modulo_shard(spark: SparkSession, d: str) -> DataFrame:
    docs = A.read(spark, d, "documents").select("doc_id", F.col("doc_id").alias("ord"))
    return S.shard(docs, 3, 7)


@query("view_order", "SRT-1", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT seg_id, row_number() OVER (ORDER BY end_ms - start_ms DESC, ord) AS by_duration,
       row_number() OVER (ORDER BY coalesce(q, -1) DESC, ord) AS by_score,
       row_number() OVER (ORDER BY character_id NULLS LAST, start_ms, ord) AS by_character FROM segments"""))
def view_order(spark: SparkSession, d: str) -> DataFrame:
    """Place of every segment in three orders."""
    seg = A.segments(spark, d).withColumn("character_name", F.col("character_id"))
    out = seg.select("seg_id")
    for name, by, up in (("by_duration", "duration", False), ("by_score", "score", False), ("by_character", "character", True)):
        out = out.join(S.view_positions(seg, by, up).select("seg_id", F.col("position").alias(name)), "seg_id")
    return out


@query("reference_clip", "SRT-3", oracle=A.sql(A.EV, A.SEGMENTS, """
c AS (SELECT *, (end_ms - start_ms) / 1000 AS s FROM segments WHERE character_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY character_id ORDER BY abs(s - 4) + CASE WHEN s >= 2 AND s <= 8 THEN 0 ELSE 1000 END, ord) AS rk FROM c)""",
    body="SELECT character_id, seg_id, end_ms - start_ms AS ms FROM r WHERE rk = 1"))
def reference_clip(spark: SparkSession, d: str) -> DataFrame:
    rows = A.segments(spark, d).filter("character_id IS NOT NULL")
    return S.reference_clip(rows, ["character_id"]).select("character_id", "seg_id", (F.col("end_ms") - F.col("start_ms")).alias("ms"))


@query("longest_line", "SRT-4", "TXT-14", oracle="""
WITH r AS (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY length(trim(text, e' \\n\\t\\r　')) DESC, conv_id * 1000 + turn) AS rk FROM conversations)
SELECT role, left(text, 48) AS line FROM r WHERE rk = 1""")
def longest_line(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    return S.longest_line(c, ["role"])


@query("latest_tasks", "SRT-5", oracle="""
SELECT event_id AS task_id, event_type AS status FROM events ORDER BY ts DESC, event_id DESC LIMIT 200""")
def latest_tasks(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events").select(F.col("event_id").alias("task_id"), F.col("event_type").alias("status"), "ts")
    return S.latest(e, "ts").select("task_id", "status")


@query("latest_checkpoint", "SRT-6", oracle="""
WITH f AS (SELECT p_brand AS exp, p_partkey AS ord, p_retailprice AS mtime, p_brand || '-e' || p_size || '.ckpt' AS name, p_size AS epoch FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY exp ORDER BY epoch DESC, mtime DESC, ord) AS rk FROM f)
SELECT exp, name, epoch FROM r WHERE rk = 1""")
def latest_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "part").select(
        F.col("p_brand").alias("exp"), F.col("p_partkey").alias("ord"), F.col("p_retailprice").alias("mtime"),
        F.concat("p_brand", F.lit("-e"), F.col("p_size").cast("string"), F.lit(".ckpt")).alias("name"),
    )
    return S.latest_checkpoint(p, r"-e(\d+)\.")


@query("log_tail", "SRT-7", oracle="""
WITH l AS (SELECT user_id % 10 AS exp, user_id AS log, event_id AS line_no, max(event_id) OVER (PARTITION BY user_id) AS mtime FROM events),
n AS (SELECT exp, arg_max(log, mtime) AS log FROM l GROUP BY 1),
r AS (SELECT l.*, row_number() OVER (PARTITION BY l.exp ORDER BY line_no DESC) AS back FROM l JOIN n USING (exp, log))
SELECT exp, log, line_no, back FROM r WHERE back <= 20""")
def log_tail(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    last = e.groupBy("user_id").agg(F.max("event_id").alias("mtime"))
    lines = e.join(last, "user_id").select(
        (F.col("user_id") % 10).alias("exp"), F.col("user_id").alias("log"), F.col("event_id").alias("line_no"), "mtime"
    )
    return S.log_tail(lines, 20).select("exp", "log", "line_no", "back")


_PLAN = """
sp AS (SELECT *, row_number() OVER (PARTITION BY speaker ORDER BY coalesce(score, -1) DESC, ord) AS place FROM clips),
fs AS (SELECT speaker, row_number() OVER (ORDER BY min(ord)) AS speaker_no FROM clips GROUP BY speaker),
pl AS (SELECT sp.*, speaker_no, CASE WHEN """ + BLANK.format(c="text") + """ THEN 'blank' WHEN end_ms - start_ms < 800 THEN 'short'
         WHEN {ms} > 0 AND score IS NOT NULL AND score < {ms} THEN 'low score' END AS reason, {val} AS is_val FROM sp JOIN fs USING (speaker)),
kp AS (SELECT *, row_number() OVER (ORDER BY speaker_no, place) - 1 AS seq, {folder} AS folder FROM pl WHERE reason IS NULL),
nm AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY seq) AS file_no FROM kp)"""
_FLAT = _PLAN.format(ms=50, val="false", folder="''")
_SPK = _PLAN.format(ms=0, val="place % 5 = 0", folder="speaker || CASE WHEN is_val THEN '/val' ELSE '/train' END")
_PLAN_ROWS = """
SELECT ord, place, reason, seq, folder, path FROM (
SELECT ord, place, NULL::VARCHAR AS reason, seq, folder,
       CASE WHEN folder = '' THEN '' ELSE folder || '/' END || CASE WHEN file_no < 1000 THEN lpad(file_no::VARCHAR, 3, '0') ELSE file_no::VARCHAR END || '.wav' AS path FROM nm
UNION ALL SELECT ord, place, reason, NULL, {f}, NULL FROM pl WHERE reason IS NOT NULL)"""


@query("export_plan_flat", "DST-1", "DST-2", "SRT-2", "WIN-4", oracle=A.sql(A.CLIPS, _FLAT, body=_PLAN_ROWS.format(f="''")))
def export_plan_flat(spark: SparkSession, d: str) -> DataFrame:
    plan = X.export_plan(A.clips(spark, d), min_score=50)
    return plan.select("ord", "place", "reason", "seq", "folder", "path")


@query("export_plan_per_speaker", "DST-2", "WIN-2", "WIN-4", "SNK-3", oracle=A.sql(
    A.CLIPS, _SPK, body=_PLAN_ROWS.format(f="speaker || CASE WHEN is_val THEN '/val' ELSE '/train' END")))
def export_plan_per_speaker(spark: SparkSession, d: str) -> DataFrame:
    plan = X.export_plan(A.clips(spark, d), per_speaker=True, val_ratio=0.2)
    return plan.select("ord", "place", "reason", "seq", "folder", "path")


@query("speaker_summary", "AGG-6", oracle=A.sql(A.CLIPS, _SPK, body="""
SELECT speaker, speaker_no, count(CASE WHEN NOT is_val THEN 1 END) AS train, count(CASE WHEN is_val THEN 1 END) AS val
FROM kp GROUP BY 1, 2"""))
def speaker_summary(spark: SparkSession, d: str) -> DataFrame:
    return X.speaker_summary(X.export_plan(A.clips(spark, d), per_speaker=True, val_ratio=0.2))


@query("export_sources", "JOI-8", oracle=A.sql(A.CLIPS, body="""
SELECT CASE WHEN ord % 50 = 0 THEN 'clip without item' WHEN item_id % 7 = 0 THEN 'item without source' ELSE 'ok' END AS error, count(*) AS n
FROM clips GROUP BY 1"""))
def export_sources(spark: SparkSession, d: str) -> DataFrame:
    clips = A.clips(spark, d).withColumn("item_id", F.when(F.col("ord") % 50 != 0, F.col("item_id")))
    sources = A.read(spark, d, "documents").filter("doc_id % 7 <> 0").select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("/media/"), F.col("doc_id")).alias("path"))
    good, bad = X.resolve_sources(clips, sources)
    both = good.withColumn("error", F.lit("ok")).select("error").unionByName(bad.select("error"))
    return both.groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query("safe_names", "DST-3", oracle="""
SELECT page_id, left(CASE WHEN s = '' THEN 'speaker' ELSE s END, 64) AS dir, left(CASE WHEN s = '' THEN 'speaker' ELSE s END, 48) AS exp
FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[/\\\\:*?"<>|\\s　]', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g') AS s FROM pages)""")
def safe_names(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "pages").select(
        "page_id", X.safe_name(F.col("url")).alias("dir"), X.safe_name(F.col("url"), 48).alias("exp"))


_STAMP = """printf('%02d-%04.1f', {c} // 60000, ((({c} % 60000) // 100) + CASE WHEN {c} % 100 > 50 OR ({c} % 100 = 50 AND ({c} // 100) % 2 = 1) THEN 1 ELSE 0 END) / 10.0)"""


@query("clip_file_names", "DST-4", oracle=A.sql(A.EV, A.SEGMENTS, body=f"""
SELECT seg_id, 'item' || item_id || '_' || {_STAMP.format(c="start_ms")} || '-' || {_STAMP.format(c="end_ms")} || '.wav' AS name FROM segments"""))
def clip_file_names(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(spark, d).select("seg_id", X.clip_file_name(F.concat(F.lit("item"), F.col("item_id"))).alias("name"))


@query("oversample", "SET-6", oracle=A.sql(A.CLIPS, """
n AS (SELECT language, count(*) AS n FROM clips GROUP BY 1)""", body="""
SELECT ord, unnest(range(0, CASE WHEN n < 200 THEN greatest(2, 200 // n) ELSE 1 END)) AS copy FROM clips JOIN n USING (language)"""))
def oversample(spark: SparkSession, d: str) -> DataFrame:
    return S.oversample(A.clips(spark, d), ["language"], 200).select("ord", "copy")


@query("unique_names", "UPD-17", oracle="""
WITH w AS (SELECT c_custkey AS ord, c_nationkey AS grp, c_mktsegment AS base, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) AS r FROM customer),
cand AS (SELECT grp, base, k, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS name
         FROM (SELECT DISTINCT grp, base FROM w) CROSS JOIN (SELECT unnest(range(0, (SELECT max(r) + 10 FROM w))) AS k)),
ex AS (SELECT DISTINCT s_nationkey AS grp, CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'BUILDING_' || (s_suppkey % 5) END AS name FROM supplier),
free AS (SELECT c.grp, c.base, c.name, row_number() OVER (PARTITION BY c.grp, c.base ORDER BY k) AS r FROM cand c
         WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.grp = c.grp AND ex.name = c.name))
SELECT w.ord, w.grp, w.base, f.name FROM w JOIN free f ON f.grp = w.grp AND f.base = w.base AND f.r = w.r""")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    wanted = A.read(spark, d, "customer").select(
        F.col("c_custkey").alias("ord"), F.col("c_nationkey").alias("grp"), F.col("c_mktsegment").alias("base"))
    taken = A.read(spark, d, "supplier").select(F.col("s_nationkey").alias("grp"), F.when(
        F.col("s_suppkey") % 3 == 0, "BUILDING").otherwise(F.concat(F.lit("BUILDING_"), (F.col("s_suppkey") % 5).cast("string"))).alias("name")).distinct()
    return S.unique_names(wanted, taken, ["grp"]).select("ord", "grp", "base", "name")
