"""Signal queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.operators import segments as SG
from clipweave.operators import signals as S

RATE = 100.0  # the adapter's signals have few samples per item
BASE = (A.EV, A.SAMPLES)
SIL = "pow(10, -50.0 / 20)"


@query("peaks", "SIG-1", oracle=A.sql(*BASE, """
n AS (SELECT item_id, CAST(ceil(count(*) / 10.0) AS BIGINT) AS b FROM samples GROUP BY 1)""", body="""
SELECT item_id, idx // b AS block, round(min(x), 6) AS lo, round(max(x), 6) AS hi FROM samples JOIN n USING (item_id) GROUP BY 1, 2"""))
def peaks(spark: SparkSession, d: str) -> DataFrame:
    return S.peaks(A.samples(spark, d), 10).select("item_id", "block", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))


_LEVEL = f"""
lm AS (SELECT item_id, round(20 * log10(sqrt(avg(x * x) + 1e-9)), 2) AS rms_db, round(20 * log10(max(abs(x)) + 1e-9), 2) AS peak_db,
  round(avg(CASE WHEN abs(x) < {SIL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS silence_ratio, bool_or(abs(x) > 0.999) AS clipping,
  round(count(*) / 100.0, 3)::DOUBLE AS duration, count(*) AS samples FROM samples GROUP BY 1)"""


@query("level_metrics", "SIG-2", oracle=A.sql(*BASE, _LEVEL, body="SELECT * FROM lm"))
def level_metrics(spark: SparkSession, d: str) -> DataFrame:
    return S.level_metrics(A.samples(spark, d), ["item_id"], RATE)


@query("clip_validation", "FIL-2", oracle=A.sql(*BASE, _LEVEL, body="""
SELECT item_id, concat_ws(',', CASE WHEN duration < 1 THEN 'short' END, CASE WHEN duration > 15 THEN 'long' END,
  CASE WHEN silence_ratio > 0.5 THEN 'silence' END, CASE WHEN clipping THEN 'clipping' END) AS issues,
  NOT (duration < 1 OR duration > 15 OR silence_ratio > 0.5 OR clipping) AS ok FROM lm"""))
def clip_validation(spark: SparkSession, d: str) -> DataFrame:
    m = level_metrics(spark, d)
    issues = SG.clip_issues(F.col("duration"), F.col("silence_ratio"), F.col("clipping"))
    return m.select("item_id", F.array_join(issues, ",").alias("issues"), (F.size(issues) == 0).alias("ok"))


@query("loudness_gain", "SIG-3", oracle=A.sql(*BASE, """
g AS (SELECT item_id, -16 - 20 * log10(sqrt(avg(x * x) + 1e-9)) AS gain FROM samples GROUP BY 1)""", body="""
SELECT item_id, idx, round(x * pow(10, gain / 20), 5) AS x FROM samples JOIN g USING (item_id)"""))
def loudness_gain(spark: SparkSession, d: str) -> DataFrame:
    return S.normalise_loudness(A.samples(spark, d)).select("item_id", "idx", F.round("x", 5).alias("x"))


@query("peak_blend", "SIG-4", oracle=A.sql(*BASE, """
m AS (SELECT item_id, max(abs(x * 1.5)) AS m FROM samples GROUP BY 1),
s AS (SELECT item_id, idx, m, CASE WHEN m > 1 THEN x * 1.5 / m ELSE x * 1.5 END AS x FROM samples JOIN m USING (item_id))""", body="""
SELECT item_id, idx, round(x / m * (0.9 * 0.25) + 0.75 * x, 9) AS x FROM s"""))
def peak_blend(spark: SparkSession, d: str) -> DataFrame:
    loud = A.samples(spark, d).withColumn("x", F.col("x") * 1.5)
    return S.blend_peak(loud).select("item_id", "idx", F.round("x", 9).alias("x"))


def _frames_sql(frame: int, hop: int) -> str:
    return f"""
n AS (SELECT item_id, count(*) AS n FROM samples GROUP BY 1),
fr AS (SELECT item_id, n, unnest(range(0, greatest(0, (n - {frame}) // {hop}) + 1)) AS frame_no FROM n),
fe AS (SELECT f.item_id, f.frame_no, avg(x * x) AS ms FROM fr f JOIN samples s ON s.item_id = f.item_id
       AND s.idx >= f.frame_no * {hop} AND s.idx < f.frame_no * {hop} + {frame} GROUP BY 1, 2)"""


@query("frame_rms", "SIG-5", oracle=A.sql(*BASE, _frames_sql(8, 2), body="""
SELECT item_id, frame_no, round(sqrt(ms + 1e-10), 6) AS rms FROM fe"""))
def frame_rms(spark: SparkSession, d: str) -> DataFrame:
    fe = S.frame_energy(A.samples(spark, d), 8, 2)
    return fe.select("item_id", "frame_no", F.round(F.sqrt(F.col("ms") + 1e-10), 6).alias("rms"))


@query("frame_energy", "SIG-6", oracle=A.sql(*BASE, _frames_sql(5, 2), body="""
SELECT item_id, frame_no, round(20 * log10(sqrt(ms + 1e-12) + 1e-12), 4) AS db FROM fe"""))
def frame_energy(spark: SparkSession, d: str) -> DataFrame:
    fr = S.frames_db(S.decimate(A.samples(spark, d), 100)[0], 5, 2)
    return fr.select("item_id", "frame_no", F.round("db", 4).alias("db"))


_BANDS = """
fd AS (SELECT item_id, frame_no, 20 * log10(sqrt(ms + {e}) + {e}) AS db FROM fe),
fk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY db, frame_no) AS r, count(*) OVER (PARTITION BY item_id) AS nf,
              avg(db) OVER (PARTITION BY item_id) AS mean FROM fd),
bands AS (SELECT item_id, avg(CASE WHEN r <= greatest(1, floor(nf * 0.1)) THEN db END) AS lo,
       avg(CASE WHEN r > nf - greatest(1, floor(nf * 0.1)) THEN db END) AS hi, any_value(mean) AS mean, any_value(nf) AS nf FROM fk GROUP BY 1)"""


@query("adaptive_threshold", "SIG-7", oracle=A.sql(*BASE, _frames_sql(5, 2), _BANDS.format(e="1e-12"), body="""
SELECT item_id, round(lo, 4) AS lo, round(hi, 4) AS hi, round(CASE WHEN hi - lo >= 8 THEN lo + greatest(6, 0.2 * (hi - lo)) END, 4) AS threshold FROM bands"""))
def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    t = S.adaptive_threshold(S.frames_db(A.samples(spark, d), 5, 2))
    return t.select("item_id", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"), F.round("threshold", 4).alias("threshold"))


@query("quality_components", "SIG-8", "SIG-9", "SIG-10", "SIG-11", "SIG-13", "SIG-14", oracle=A.sql(
    *BASE, _frames_sql(3, 1), _BANDS.format(e="1e-10"), f"""
b AS (SELECT item_id, 20 * log10(sqrt(avg(x * x) + 1e-10) + 1e-10) AS rms_db, avg(CASE WHEN abs(x) >= 0.99 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cr,
      avg(CASE WHEN abs(x) < {SIL} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS si, count(*) AS n FROM samples GROUP BY 1),
c AS (SELECT item_id, n, CASE WHEN nf < 8 OR si < 0.02 OR lo > mean - 6 THEN 0.85 ELSE greatest(0, least(1, (hi - lo) / 30)) END AS snr,
  CASE WHEN cr <= 0.001 THEN 1 WHEN cr >= 0.01 THEN 0 ELSE 1 - (cr - 0.001) / 0.009 END AS clip,
  CASE WHEN rms_db BETWEEN -24 AND -10 THEN 1 WHEN rms_db >= -34 AND rms_db < -24 THEN 1 - (-24 - rms_db) / 10 * 0.7
       WHEN rms_db > -10 AND rms_db <= -4 THEN 1 - (rms_db + 10) / 6 * 0.5 ELSE 0.15 END AS level,
  CASE WHEN si <= 0.30 THEN 1 WHEN si >= 0.70 THEN 0 ELSE 1 - (si - 0.30) / 0.40 END AS activity FROM b JOIN bands USING (item_id)),
q AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE round(40 * snr + 20 * clip + 15 * greatest(0, least(1, level)) + 15 * activity + 7, 1) END AS q FROM c)""",
    body="""SELECT item_id, round(snr, 4) AS snr, round(clip, 4) AS clip, round(level, 4) AS level, round(activity, 4) AS activity, q,
  CASE WHEN q >= 80 THEN 'good' WHEN q >= 60 THEN 'fair' ELSE 'poor' END AS band FROM q"""))
def quality_components(spark: SparkSession, d: str) -> DataFrame:
    x = A.samples(spark, d)
    neutral = S.lengths(x).select("item_id", F.lit(0.7).alias("spectral"))  # too short for a spectrum
    q = S.quality_scores(x, RATE, spectral=neutral)
    r = lambda c: F.round(c, 4).alias(c)
    return q.select("item_id", r("snr"), r("clip"), r("level"), r("activity"), "q", S.score_band(F.col("q")).alias("band"))


@query("score_band", "SIG-14", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT CASE WHEN q IS NULL THEN '' WHEN q >= 80 THEN 'good' WHEN q >= 60 THEN 'fair' ELSE 'poor' END AS band, count(*) AS n FROM segments GROUP BY 1"""))
def score_band(spark: SparkSession, d: str) -> DataFrame:
    return A.segments(spark, d).groupBy(S.score_band(F.col("q")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("spectral_flatness", "SIG-12")
def spectral_flatness(spark: SparkSession, d: str) -> DataFrame:
    s = S.spectral_scores(A.samples(spark, d), 16, 4, min_samples=32)
    return s.select("item_id", F.round("sfm", 5).alias("sfm"), F.round("spectral", 4).alias("spectral"))


@query("quality_scores", "SIG-12", "SIG-13")
def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    q = S.quality_scores(A.samples(spark, d), RATE, frame_s=0.16, hop_s=0.04, min_samples=32)
    return q.select("item_id", "q", S.score_band(F.col("q")).alias("band"))


_CLIPR = """
cl AS (SELECT item_id, k AS clip_id, k * 150 AS start_ms, k * 150 + 200 AS end_ms FROM (SELECT item_id, unnest(range(0, (count(*) * 10) // 150 + 1)) AS k FROM samples GROUP BY 1))"""


def _signal_clips(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of 200 ms every 150 ms over every signal."""
    n = S.lengths(A.samples(spark, d))
    return n.select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") * 10 / 150))).alias("clip_id")).select(
        "item_id", "clip_id", (F.col("clip_id") * 150).alias("start_ms"), (F.col("clip_id") * 150 + 200).alias("end_ms"))


@query("slice_ranges", "SIG-15", oracle=A.sql(*BASE, _CLIPR, body="""
SELECT s.item_id, clip_id, count(*) AS n, round(sum(x), 5) AS total, max(idx - start_ms // 10) AS last_idx
FROM cl JOIN samples s ON s.item_id = cl.item_id AND s.idx >= start_ms // 10 AND s.idx < end_ms // 10 GROUP BY 1, 2"""))
def slice_ranges(spark: SparkSession, d: str) -> DataFrame:
    cut = S.slice_ranges(A.samples(spark, d), _signal_clips(spark, d), RATE, width=64)
    return cut.groupBy("item_id", "clip_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 5).alias("total"), F.max("idx").alias("last_idx"))


@query("mid_window", "SIG-16", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT seg_id, start_ms + (end_ms - start_ms - least(1000, end_ms - start_ms)) // 2 AS ws,
       start_ms + (end_ms - start_ms - least(1000, end_ms - start_ms)) // 2 + least(1000, end_ms - start_ms) AS we FROM segments"""))
def mid_window(spark: SparkSession, d: str) -> DataFrame:
    return S.mid_window(A.segments(spark, d)).select("seg_id", "ws", "we")


@query("window_gate", "FIL-13", oracle=A.sql(*BASE, _CLIPR, """
m AS (SELECT s.item_id, clip_id, count(*) AS n, 20 * log10(sqrt(avg(x * x)) + 1e-9) AS level_db
      FROM cl JOIN samples s ON s.item_id = cl.item_id AND s.idx >= start_ms // 10 AND s.idx < end_ms // 10 GROUP BY 1, 2)""", body="""
SELECT item_id, clip_id, n, round(level_db, 4) AS level_db FROM m WHERE n >= 15 AND level_db >= -12"""))
def window_gate(spark: SparkSession, d: str) -> DataFrame:
    cut = S.slice_ranges(A.samples(spark, d), _signal_clips(spark, d), RATE, width=64)
    return S.window_gate(cut, ["item_id", "clip_id"], 60, min_db=-12).withColumn("level_db", F.round("level_db", 4))


@query("trim_bounds", "SIG-17", oracle=A.sql(*BASE, _frames_sql(3, 1), _BANDS.format(e="1e-12"), """
e AS (SELECT item_id, (max(frame_no) + 1) * 10 AS end_ms, min(CASE WHEN db > -9 THEN frame_no END) AS a, max(CASE WHEN db > -9 THEN frame_no END) AS b FROM fd GROUP BY 1)""",
    body="SELECT item_id, greatest(0, a * 10 - 20) AS start_ms, least(end_ms, (b + 1) * 10 + 20) AS end_ms FROM e WHERE a IS NOT NULL"))
def trim_bounds(spark: SparkSession, d: str) -> DataFrame:
    return S.trim_bounds(S.frames_db(A.samples(spark, d), 3, 1), 10, threshold=-9.0, keep_ms=20)


@query("peak_guard", "FIL-12", oracle=A.sql(A.VECTORS, body="""
SELECT vec_id, CASE WHEN vec_id % 50 = 7 THEN 'again' ELSE 'ok' END AS fate FROM vectors WHERE list_max(list_transform(emb, lambda v: abs(v))) <= 3.1"""))
def peak_guard(spark: SparkSession, d: str) -> DataFrame:
    bad = F.when(F.col("vec_id") % 50 == 7, F.array(F.lit(float("nan")))).otherwise(F.array(F.lit(0.0)))
    rows = A.vectors(spark, d).select("vec_id", F.array_max(F.transform("emb", F.abs)).alias("peak"), F.concat("emb", bad).alias("feature"))
    ok, again = S.peak_guard(rows, 3.1)
    return ok.select("vec_id", F.lit("ok").alias("fate")).unionByName(again.select("vec_id", F.lit("again").alias("fate")))


@query("energy_slicer", "INT-19", oracle="WITH RECURSIVE " + ",".join([*BASE, """
tot AS (SELECT item_id, count(*) AS total FROM samples GROUP BY 1),
q AS (SELECT item_id, idx AS f, abs(x) AS r, abs(x) < 0.2 AS s FROM samples),
o AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY item_id ORDER BY f), false) AS ps FROM q),
g AS (SELECT *, sum((s AND NOT ps)::INT) OVER (PARTITION BY item_id ORDER BY f) AS run FROM o),
ins AS (SELECT * FROM g WHERE s OR ps),
b AS (SELECT item_id, run, min(f) AS s, max(CASE WHEN NOT s THEN f END) AS i FROM ins GROUP BY 1, 2),
c AS (SELECT b.item_id, b.run, b.s, b.i, total, arg_min(n.f, struct_pack(r := n.r, f := n.f)) AS al,
   arg_min(n.f, struct_pack(r := n.r, f := n.f)) FILTER (n.f <= b.s + 2) AS lf,
   arg_min(n.f, struct_pack(r := n.r, f := n.f)) FILTER (n.f >= b.i - 2) AS rt,
   arg_min(n.f, struct_pack(r := n.r, f := n.f)) FILTER (n.f >= b.i - 2 AND n.f <= b.s + 2) AS md
   FROM ins n JOIN b USING (item_id, run) JOIN tot USING (item_id) GROUP BY 1, 2, 3, 4, 5),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s) AS n FROM c),
w AS (
  SELECT item_id, 0::BIGINT AS n, 0::BIGINT AS clip, NULL::BIGINT AS a, NULL::BIGINT AS e FROM tot
  UNION ALL
  SELECT t.item_id, t.n, CASE WHEN t.hit THEN t.e2 ELSE t.clip END, CASE WHEN t.hit OR t.trail THEN t.a2 END, CASE WHEN t.hit THEN t.e2 WHEN t.trail THEN t.total + 1 END
  FROM (SELECT k.item_id, k.n, w.clip, k.total,
      k.i IS NULL AND k.total - k.s >= 2 AS trail,
      k.i IS NOT NULL AND ((k.s = 0 AND k.i > 2) OR (k.i - k.s >= 2 AND k.i - w.clip >= 5)) AS hit,
      CASE WHEN k.i IS NULL THEN k.lf WHEN k.s = 0 THEN 0 WHEN k.i - k.s <= 2 THEN k.al WHEN k.i - k.s <= 4 THEN least(k.lf, k.md) ELSE k.lf END AS a2,
      CASE WHEN k.i - k.s <= 2 THEN k.al WHEN k.i - k.s <= 4 THEN CASE WHEN k.s = 0 THEN k.rt ELSE greatest(k.rt, k.md) END ELSE k.rt END AS e2
    FROM w JOIN k ON k.item_id = w.item_id AND k.n = w.n + 1) t),
tags AS (SELECT item_id, a, e FROM w WHERE a IS NOT NULL),
ch AS (SELECT item_id, lag(e) OVER (PARTITION BY item_id ORDER BY e) AS p, a FROM tags)"""]) + """
SELECT item_id, coalesce(p, 0) AS "begin", a AS "end" FROM ch WHERE p IS NOT NULL OR a > 0
UNION ALL SELECT t.item_id, coalesce(max(e), 0), any_value(total) FROM tot t LEFT JOIN tags USING (item_id) GROUP BY t.item_id HAVING coalesce(max(e), 0) < any_value(total)""")
def energy_slicer(spark: SparkSession, d: str) -> DataFrame:
    frames = A.samples(spark, d).select("item_id", F.col("idx").alias("frame_no"), F.abs("x").alias("rms"))
    return S.energy_slices(frames, threshold=0.2, min_length=5, min_interval=2, max_kept=2)
