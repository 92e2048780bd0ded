"""Interval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.operators import intervals as I
from clipweave.plans.overlap import overlap_join, overlap_ratio

DOMINANT = """
cover AS (
  SELECT s.item_id, s.seg_id, t.label,
         sum(least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms)) AS cover_ms,
         min(t.start_ms) AS first_start, min(t.ord) AS first_ord
  FROM segments s JOIN turns t ON s.item_id = t.item_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms
  GROUP BY 1, 2, 3),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id, seg_id ORDER BY cover_ms DESC, first_start, first_ord) AS rk,
         sum(cover_ms) OVER (PARTITION BY item_id, seg_id) AS total_ms FROM cover),
dominant AS (
  SELECT item_id, seg_id, max(CASE WHEN rk = 1 THEN label END) AS label,
         CAST(max(CASE WHEN rk = 1 THEN cover_ms END) AS BIGINT) AS cover_ms,
         CAST(max(total_ms) AS BIGINT) AS total_ms,
         coalesce(max(CASE WHEN rk = 2 THEN cover_ms END)::DOUBLE / max(total_ms) >= 0.35
                  AND max(CASE WHEN rk = 2 THEN cover_ms END) >= 250, false) AS mixed
  FROM ranked GROUP BY 1, 2)"""


@query("dominant_label", "INT-8",
       oracle=A.sql(A.EV, A.SEGMENTS, A.TURNS, DOMINANT, body="SELECT * FROM dominant"))
def dominant_label(spark: SparkSession, d: str) -> DataFrame:
    return I.dominant_label(A.segments(spark, d), A.turns(spark, d))


@query("clamp_intervals", "INT-1", oracle=A.sql(A.EV, A.ITEMS, A.SILENCES, body="""
SELECT item_id, greatest(0, start_ms - 100000) AS start_ms,
       least(duration_ms, CASE WHEN start_ms % 2 = 0 THEN end_ms - 100000 ELSE duration_ms END) AS end_ms
FROM silences JOIN items USING (item_id)
WHERE least(duration_ms, CASE WHEN start_ms % 2 = 0 THEN end_ms - 100000 ELSE duration_ms END)
      > greatest(0, start_ms - 100000)"""))
def clamp_intervals(spark: SparkSession, d: str) -> DataFrame:
    shifted = A.silences(spark, d).select(
        "item_id",
        (F.col("start_ms") - 100_000).alias("start_ms"),
        F.when(F.col("start_ms") % 2 == 0, F.col("end_ms") - 100_000).alias("end_ms"),
    )
    return I.clamp(shifted, A.items(spark, d))


_GAPS = """
seen AS (
  SELECT item_id, start_ms, end_ms,
         greatest(0, coalesce(max(end_ms) OVER (PARTITION BY item_id ORDER BY start_ms, end_ms
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS reach
  FROM {src} WHERE end_ms > start_ms),
gaps AS (
  SELECT item_id, reach AS start_ms, start_ms AS end_ms FROM seen
  UNION ALL
  SELECT i.item_id, greatest(0, coalesce(max(s.end_ms), 0)), i.duration_ms
  FROM items i LEFT JOIN {src} s ON s.item_id = i.item_id AND s.end_ms > s.start_ms
  GROUP BY i.item_id, i.duration_ms)"""


@query("gap_ranges", "INT-3", oracle=A.sql(A.EV, A.ITEMS, A.SEGMENTS, _GAPS.format(src="segments"), body="""
SELECT item_id, start_ms, end_ms FROM gaps WHERE end_ms - start_ms >= 250"""))
def gap_ranges(spark: SparkSession, d: str) -> DataFrame:
    return I.gaps(A.segments(spark, d), A.items(spark, d))


_CLAMPED = """
clamped AS (SELECT item_id, greatest(0, start_ms) AS start_ms, least(duration_ms, end_ms) AS end_ms
            FROM silences JOIN items USING (item_id)
            WHERE least(duration_ms, end_ms) > greatest(0, start_ms))"""


@query("speech_ranges", "INT-2", oracle=A.sql(
    A.EV, A.ITEMS, A.SILENCES, _CLAMPED, _GAPS.format(src="clamped"),
    body="SELECT item_id, start_ms, end_ms FROM gaps WHERE end_ms > start_ms"))
def speech_ranges(spark: SparkSession, d: str) -> DataFrame:
    return I.speech_from_silence(A.silences(spark, d), A.items(spark, d))


@query("clip_intersection", "INT-4", oracle=A.sql(
    A.EV, A.ITEMS, A.SEGMENTS, A.SPEECH, _GAPS.format(src="segments"), body="""
SELECT g.item_id, greatest(g.start_ms, s.start_ms) AS start_ms, least(g.end_ms, s.end_ms) AS end_ms
FROM (SELECT item_id, start_ms - 400 AS start_ms, end_ms + 400 AS end_ms FROM gaps WHERE end_ms - start_ms >= 250) g
JOIN speech s ON g.item_id = s.item_id
WHERE least(g.end_ms, s.end_ms) - greatest(g.start_ms, s.start_ms) >= 50"""))
def clip_intersection(spark: SparkSession, d: str) -> DataFrame:
    # gaps are widened on both sides: the speech rows are themselves segments
    wide = I.gaps(A.segments(spark, d), A.items(spark, d)).select(
        "item_id", (F.col("start_ms") - 400).alias("start_ms"), (F.col("end_ms") + 400).alias("end_ms")
    )
    return I.intersect(wide, A.speech(spark, d).drop("ord"))


@query("split_by_silence", "INT-5", oracle="WITH RECURSIVE " + ",".join([
    A.EV, A.ITEMS, A.SILENCES, _CLAMPED, _GAPS.format(src="clamped"), """
runs AS (SELECT item_id, start_ms, end_ms,
                row_number() OVER (PARTITION BY item_id ORDER BY start_ms) AS k
         FROM gaps WHERE end_ms > start_ms),
walk AS (
  SELECT item_id, k, start_ms AS begin_ms, end_ms FROM runs WHERE k = 1
  UNION ALL
  SELECT r.item_id, r.k, CASE WHEN w.end_ms - w.begin_ms >= 800 THEN r.start_ms ELSE w.begin_ms END, r.end_ms
  FROM walk w JOIN runs r ON r.item_id = w.item_id AND r.k = w.k + 1),
made AS (SELECT item_id, begin_ms AS s, end_ms AS e,
                greatest(1, CAST(ceil((end_ms - begin_ms) / 15000.0) AS BIGINT)) AS n
         FROM walk WHERE end_ms - begin_ms >= 800)"""]) + """
SELECT item_id, s + ((e - s) * k) // n AS start_ms, s + ((e - s) * (k + 1)) // n AS end_ms
FROM (SELECT *, unnest(range(0, n)) AS k FROM made)""")
def split_by_silence(spark: SparkSession, d: str) -> DataFrame:
    return I.split_by_silence(A.silences(spark, d), A.items(spark, d))


_ALIGN = """
hits AS (
  SELECT s.item_id, s.seg_id, min(p.start_ms) AS a, max(p.end_ms) AS b
  FROM segments s JOIN speech p ON s.item_id = p.item_id AND p.start_ms < s.end_ms AND p.end_ms > s.start_ms
  WHERE NOT s.locked GROUP BY 1, 2),
moved AS (
  SELECT s.*, greatest(s.start_ms, a - 80) AS ns, least(s.end_ms, b + 80) AS ne
  FROM segments s LEFT JOIN hits USING (item_id, seg_id)),
aligned AS (
  SELECT *, coalesce((ns > start_ms OR ne < end_ms) AND ne - ns >= 200, false) AS changed FROM moved)"""


@query("align_to_speech", "INT-6", oracle=A.sql(A.EV, A.ITEMS, A.SEGMENTS, A.SPEECH, _ALIGN, body="""
SELECT item_id, seg_id, CASE WHEN changed THEN ns ELSE start_ms END AS start_ms,
       CASE WHEN changed THEN ne ELSE end_ms END AS end_ms, changed FROM aligned"""))
def align_to_speech(spark: SparkSession, d: str) -> DataFrame:
    out = I.align_to_speech(A.segments(spark, d), A.items(spark, d), A.speech(spark, d))
    return out.select("item_id", "seg_id", "start_ms", "end_ms", "changed")


@query("overlap_ratio_pairs", "INT-7", oracle=A.sql(A.EV, A.SEGMENTS, A.SPEECH, body="""
SELECT s.item_id, s.seg_id, p.ord AS speech_ord,
       round((least(s.end_ms, p.end_ms) - greatest(s.start_ms, p.start_ms))::DOUBLE
             / least(s.end_ms - s.start_ms, p.end_ms - p.start_ms), 6) AS ratio
FROM segments s JOIN speech p ON s.item_id = p.item_id AND s.start_ms < p.end_ms AND p.start_ms < s.end_ms
WHERE s.end_ms > s.start_ms"""))
def overlap_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = overlap_join(
        A.segments(spark, d).select("item_id", "seg_id", "start_ms", "end_ms"), A.speech(spark, d), ["item_id"]
    )
    return pairs.select(
        "item_id", "seg_id", F.col("r_ord").alias("speech_ord"),
        F.round(overlap_ratio("start_ms", "end_ms", "r_start_ms", "r_end_ms"), 6).alias("ratio"),
    )


@query("split_parts", "INT-10", oracle=A.sql(A.EV, A.SEGMENTS, A.TURNS, """
pieces AS (
  SELECT s.item_id, s.seg_id, greatest(s.start_ms, t.start_ms) AS a, least(s.end_ms, t.end_ms) AS b, label
  FROM segments s JOIN turns t ON s.item_id = t.item_id
  WHERE least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) > 10),
marked AS (SELECT *, coalesce(label <> lag(label) OVER w, true)::INT AS opens FROM pieces
           WINDOW w AS (PARTITION BY item_id, seg_id ORDER BY a, b)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY item_id, seg_id ORDER BY a, b) AS part FROM marked)""", body="""
SELECT item_id, seg_id, CAST(part AS BIGINT) AS part, min(a) AS start_ms, max(b) AS end_ms, any_value(label) AS label
FROM runs GROUP BY item_id, seg_id, part"""))
def split_parts(spark: SparkSession, d: str) -> DataFrame:
    return I.split_parts(A.segments(spark, d), A.turns(spark, d))


@query("bind_segments", "INT-11", "TXT-9")
def bind_segments(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d).select(
        "item_id", "seg_id", "start_ms", "end_ms", "text", "character_id", "locked",
        F.lit(False).alias("mixed"), (F.col("seg_id") % 13 == 0).alias("was_split"),
    )
    turns = A.turns(spark, d)
    labels = turns.select("label").distinct().withColumn("character_id", F.concat(F.lit("c:"), "label"))
    return I.bind_segments(seg, turns, labels)


@query("bind_segments_summary", "INT-11", oracle=A.sql(A.EV, A.SEGMENTS, A.TURNS, DOMINANT, """
pieces AS (
  SELECT s.item_id, s.seg_id, greatest(s.start_ms, t.start_ms) AS a, least(s.end_ms, t.end_ms) AS b, label
  FROM segments s JOIN turns t ON s.item_id = t.item_id
  WHERE least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) > 10),
marked AS (SELECT *, coalesce(label <> lag(label) OVER w, true)::INT AS opens FROM pieces
           WINDOW w AS (PARTITION BY item_id, seg_id ORDER BY a, b)),
parts AS (SELECT item_id, seg_id, sum(opens) AS n FROM marked GROUP BY 1, 2),
state AS (
  SELECT s.*, d.label AS dl, coalesce(d.mixed, false) AND NOT s.locked AS mx, coalesce(p.n, 0) AS n
  FROM segments s LEFT JOIN dominant d USING (item_id, seg_id) LEFT JOIN parts p USING (item_id, seg_id))""",
    body="""
SELECT item_id,
       CAST(sum(CASE WHEN mx AND seg_id % 13 <> 0 AND n >= 2 THEN n ELSE 1 END) AS BIGINT) AS n_rows,
       CAST(sum(CASE WHEN mx AND seg_id % 13 <> 0 AND n >= 2 THEN n ELSE 0 END) AS BIGINT) AS n_children,
       CAST(sum(CASE WHEN mx AND seg_id % 13 <> 0 AND n >= 2 THEN 0
                     WHEN mx THEN 1 WHEN locked AND character_id IS NULL THEN 1
                     WHEN NOT locked AND character_id IS NULL AND dl IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unassigned,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM state GROUP BY item_id"""))
def bind_segments_summary(spark: SparkSession, d: str) -> DataFrame:
    return bind_segments(spark, d).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("part") > 0).alias("n_children"),
        F.count_if(F.col("character_id").isNull()).alias("n_unassigned"),
        F.sum(F.length("text")).alias("n_chars"),
    )


@query("normalize_segments", "INT-9", "AGG-9")
def normalize_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments plus a shifted near-copy of every third row, collapsed again; per item report."""
    before = _with_copies(spark, d)
    after = I.normalize_segments(before)
    b = before.groupBy("item_id").agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy("item_id").agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, "item_id").select(
        "item_id", "before", "after", (F.col("before") - F.col("after")).alias("removed")
    )


def _with_copies(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d).select("item_id", "start_ms", "end_ms", "text", "locked", "ord")
    copies = seg.filter("ord % 3 = 0").select(
        "item_id", (F.col("start_ms") + 20).alias("start_ms"), "end_ms", F.lit("").alias("text"),
        F.lit(False).alias("locked"), (F.col("ord") + 1_000_000_000).alias("ord"),
    )
    return seg.unionByName(copies)


@query("auto_label_single_overlap", "INT-12", "JOI-4", oracle=A.sql(A.EV, A.SEGMENTS, A.TURNS, DOMINANT, """
best AS (
  SELECT s.item_id, s.seg_id, t.label, least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) AS ov,
         row_number() OVER (PARTITION BY s.item_id, s.seg_id
           ORDER BY least(s.end_ms, t.end_ms) - greatest(s.start_ms, t.start_ms) DESC, t.start_ms, t.ord) AS rk
  FROM segments s JOIN turns t ON s.item_id = t.item_id AND s.start_ms < t.end_ms AND t.start_ms < s.end_ms
  WHERE t.end_ms > t.start_ms AND s.end_ms > s.start_ms)""", body="""
SELECT b.item_id, b.seg_id, b.label, b.ov AS overlap_ms, d.mixed,
       CASE WHEN NOT d.mixed THEN 'c:' || b.label END AS character_id
FROM best b JOIN dominant d USING (item_id, seg_id) WHERE b.rk = 1"""))
def auto_label(spark: SparkSession, d: str) -> DataFrame:
    turns = A.turns(spark, d)
    labels = turns.select("label").distinct().withColumn("character_id", F.concat(F.lit("c:"), "label"))
    return I.auto_character(A.segments(spark, d), turns, labels)


@query("label_at_instant", "INT-13", oracle=A.sql(A.EV, A.SEGMENTS, A.TURNS, """
pts AS (SELECT item_id, seg_id, (start_ms + end_ms) // 2 AS t_ms FROM segments)""", body="""
SELECT p.item_id, p.seg_id, p.t_ms, arg_min(t.label, t.start_ms) AS label
FROM pts p JOIN turns t ON p.item_id = t.item_id AND t.start_ms <= p.t_ms AND p.t_ms < t.end_ms GROUP BY 1, 2, 3"""))
def label_at_instant(spark: SparkSession, d: str) -> DataFrame:
    pts = A.segments(spark, d).select(
        "item_id", "seg_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("t_ms")
    )
    return I.label_at(pts, A.turns(spark, d))


@query("cue_at_instant", "INT-14", oracle=A.sql(A.CUES, """
pts AS (SELECT item_id, ord, end_ms + 30 AS t_ms FROM cues)""", body="""
SELECT p.item_id, p.ord, p.t_ms, min(c.ord) AS cue_ord
FROM pts p JOIN cues c ON p.item_id = c.item_id AND p.t_ms >= c.start_ms - 50 AND p.t_ms <= c.end_ms + 50
GROUP BY 1, 2, 3"""))
def cue_at_instant(spark: SparkSession, d: str) -> DataFrame:
    cues = A.cues(spark, d)
    return I.cue_at(cues.select("item_id", "ord", (F.col("end_ms") + 30).alias("t_ms")),
                    cues.select("item_id", "ord", "start_ms", "end_ms"))


@query("word_to_clip", "INT-15", oracle=A.sql(A.CUES, """
toks AS (SELECT item_id, ord, start_ms, string_split(text, ' ') AS w FROM cues),
pos AS (SELECT item_id, ord, start_ms, w, unnest(range(1, len(w) + 1)) AS i FROM toks),
words AS (
  SELECT item_id, ord * 100000 + i AS ord, w[i] AS word,
         start_ms + 60 * (coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0))::BIGINT AS ws,
         start_ms + 60 * (coalesce(list_sum(list_transform(w[1:i-1], lambda x: length(x) + 1)), 0) + length(w[i]))::BIGINT AS we
  FROM pos),
clips AS (SELECT item_id, ord AS clip_id, start_ms + 600 AS s, end_ms + 1800 AS e FROM cues),
hit AS (
  SELECT c.item_id, c.clip_id, string_agg(w.word, '' ORDER BY w.ord) AS txt, count(*) AS n
  FROM clips c JOIN words w ON c.item_id = w.item_id
   AND w.ws + w.we >= 2 * c.s AND w.ws + w.we < 2 * c.e AND trim(w.word, e' \\t\\n') <> '' GROUP BY 1, 2)""", body="""
SELECT c.item_id, c.clip_id, c.s AS start_ms, c.e AS end_ms,
       regexp_replace(regexp_replace(replace(regexp_replace(coalesce(txt, ''), '\\[.*?\\]', '', 'g'), '　', ''),
         '^\\s+', ''), '\\s+$', '') AS text, coalesce(n, 0) AS n_words
FROM clips c LEFT JOIN hit h USING (item_id, clip_id)"""))
def word_to_clip(spark: SparkSession, d: str) -> DataFrame:
    cues = A.cues(spark, d)
    toks = cues.select("item_id", "ord", "start_ms", F.split("text", " ").alias("w"))
    starts = F.aggregate(
        "w", F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, -1) + F.length(x) + 1)
    )
    words = toks.select(
        "item_id", "ord", "start_ms", F.posexplode(F.arrays_zip("w", starts.alias("off"))).alias("i", "z")
    ).filter("z.w IS NOT NULL").select(
        "item_id", (F.col("ord") * 100000 + F.col("i") + 1).alias("ord"), F.col("z.w").alias("word"),
        (F.col("start_ms") + F.col("z.off") * 60).alias("start_ms"),
        (F.col("start_ms") + (F.col("z.off") + F.length("z.w")) * 60).alias("end_ms"),
    )
    clips = cues.select(
        "item_id", F.col("ord").alias("clip_id"), (F.col("start_ms") + 600).alias("start_ms"),
        (F.col("end_ms") + 1800).alias("end_ms"),
    )
    return I.words_to_clips(words, clips)


@query("window_ranges", "INT-16", "UDF-4", oracle=A.sql(A.CUES, body="""
SELECT item_id, ord, k, start_ms + k * 500 AS ws, least(start_ms + k * 500 + 1400, end_ms) AS we
FROM (SELECT *, unnest(range(0, (end_ms - start_ms - 300) // 500 + 1)) AS k
      FROM cues WHERE end_ms - start_ms >= 300)"""))
def window_ranges(spark: SparkSession, d: str) -> DataFrame:
    return I.windows_in_range(A.cues(spark, d)).select("item_id", "ord", "k", "ws", "we")


@query("fixed_chunks", "INT-17", "UDF-4", oracle=A.sql(A.EV, A.ITEMS, body="""
SELECT item_id, k, k * 30000 AS start_ms, least((k + 1) * 30000, duration_ms) AS end_ms
FROM (SELECT *, unnest(range(0, (duration_ms - 1) // 30000 + 1)) AS k FROM items)
WHERE least((k + 1) * 30000, duration_ms) - k * 30000 >= 500"""))
def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    return I.fixed_chunks(A.items(spark, d), 30_000)


@query("silence_islands", "INT-18", oracle=A.sql(A.EV, A.ITEMS, A.SAMPLES, """
quiet AS (SELECT item_id, idx AS f FROM samples WHERE abs(x) < 0.2),
g AS (SELECT *, f - row_number() OVER (PARTITION BY item_id ORDER BY f) AS grp FROM quiet),
raw AS (SELECT item_id, min(f) * 20 AS s, (max(f) + 1) * 20 + 50 AS e FROM g GROUP BY item_id, grp),
m AS (SELECT *, coalesce(s - max(e) OVER (PARTITION BY item_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                 >= 40, true)::INT AS opens FROM raw),
r AS (SELECT *, sum(opens) OVER (PARTITION BY item_id ORDER BY s) AS run FROM m),
merged AS (SELECT item_id, min(s) AS s, max(e) AS e FROM r GROUP BY item_id, run)""", body="""
SELECT item_id, s AS start_ms, least(e, duration_ms) AS end_ms FROM merged JOIN items USING (item_id) WHERE e - s >= 150"""))
def silence_islands(spark: SparkSession, d: str) -> DataFrame:
    frames = A.samples(spark, d).select(
        "item_id", F.col("idx").alias("frame_no"), (F.abs("x") < 0.2).alias("silent")
    )
    return I.silence_islands(frames, A.items(spark, d), merge_gap=40, min_silence=150)


@query("run_merge", "INT-20", oracle=A.sql(A.EV, A.TURNS, """
m AS (SELECT *, coalesce(label <> lag(label) OVER w OR start_ms - lag(end_ms) OVER w > 375, true)::INT AS opens
      FROM turns WHERE end_ms - start_ms < 6000 WINDOW w AS (PARTITION BY item_id ORDER BY start_ms, end_ms, ord)),
r AS (SELECT *, sum(opens) OVER (PARTITION BY item_id ORDER BY start_ms, end_ms, ord) AS part FROM m)""", body="""
SELECT item_id, CAST(part AS BIGINT) AS part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, any_value(label) AS label
FROM r GROUP BY item_id, part"""))
def run_merge(spark: SparkSession, d: str) -> DataFrame:
    short = A.turns(spark, d).filter("end_ms - start_ms < 6000")
    return I.label_runs(short, ["item_id"], 375, order=("start_ms", "end_ms", "ord"))


@query("emit_turns", "INT-21", oracle=A.sql(A.EV, A.TURNS, """
lines AS (
  SELECT *, CASE ord % 3 WHEN 0 THEN 'pre' WHEN 1 THEN 'post' END AS side, (end_ms - start_ms) // 3 AS d FROM turns)""",
    body="""
SELECT item_id, ord, 0 AS part, start_ms, CASE side WHEN 'pre' THEN start_ms + d WHEN 'post' THEN end_ms - d ELSE end_ms END AS end_ms,
       CASE WHEN side = 'pre' THEN 'other' ELSE label END AS label FROM lines
UNION ALL
SELECT item_id, ord, 1, CASE side WHEN 'pre' THEN start_ms + d ELSE end_ms - d END, end_ms,
       CASE WHEN side = 'pre' THEN label ELSE 'other' END FROM lines WHERE side IS NOT NULL"""))
def emit_turns(spark: SparkSession, d: str) -> DataFrame:
    lines = A.turns(spark, d).select(
        "*",
        F.when(F.col("ord") % 3 == 0, "pre").when(F.col("ord") % 3 == 1, "post").alias("side"),
        F.lit("other").alias("other_label"),
        F.floor((F.col("end_ms") - F.col("start_ms")) / 3).alias("other_ms"),
    )
    return I.emit_turns(lines)
