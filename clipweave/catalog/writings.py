"""Text, clock and file-format queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.functions import clock as C
from clipweave.functions import text as T
from clipweave.functions.registry import register_sql, segmentation
from clipweave.plans import export as X
from clipweave.session import scratch_path
from clipweave.sources import manifests as M
from clipweave.sources import subtitles as ST

WS = "[\\s　]"
TRIM = "regexp_replace(regexp_replace({c}, '^[\\s　]+', ''), '[\\s　]+$', '')"
NL = "regexp_replace(regexp_replace({c}, '^\\n+', ''), '\\n+$', '')"
SHORT = "NOT regexp_full_match(x, '[!?…,.\\-]*')"
SPLIT = "，。？！,.?!~:：—…"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "documents")


def _digest(docs: DataFrame, parts: Column) -> DataFrame:
    """Number and digest of each document's parts, which are made once for both."""
    return docs.select("doc_id", parts.alias("_p")).select("doc_id", F.size("_p").alias("n"), F.md5(F.array_join("_p", "\n")).alias("digest"))


@query("text_cleanup", "TXT-1", oracle=f"""
SELECT doc_id, md5({TRIM.format(c="replace(regexp_replace('[noise] ' || text || '　[end]', '\\[.*?\\]', '', 'g'), '　', '')")}) AS digest FROM documents""")
def text_cleanup(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(
        "doc_id", F.md5(T.clean_transcript(F.concat(F.lit("[noise] "), "text", F.lit("　[end]")))).alias("digest"))


@query("punct_collapse", "TXT-2", oracle="""
SELECT doc_id, md5(regexp_replace(t, '([!?…,.\\-])([!?…,.\\-])+', '\\1', 'g')) AS digest,
       md5(regexp_replace(t, '([!?…,.\\-\\s])([!?…,.\\-])+', '\\1', 'g')) AS english FROM (SELECT doc_id, replace(replace(text, '.', '.,!'), 'e ', 'e ,-') AS t FROM documents)""")
def punct_collapse(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace(F.replace("text", F.lit("."), F.lit(".,!")), F.lit("e "), F.lit("e ,-"))
    return _docs(spark, d).select("doc_id", F.md5(T.collapse_punct(t)).alias("digest"), F.md5(T.collapse_punct(t, first_space=True)).alias("english"))


@query("width_fold", "TXT-3", oracle="""
SELECT doc_id, md5(translate(translate(text, 'aeZ09 ', 'ａｅＺ０９　'), 'ａｅＺ０９　', 'aeZ09 ')) AS digest FROM documents""")
def width_fold(spark: SparkSession, d: str) -> DataFrame:
    wide = F.translate("text", "aeZ09 ", "ａｅＺ０９　")
    return _docs(spark, d).select("doc_id", F.md5(T.fold_width(wide)).alias("digest"))


@query("symbol_map", "TXT-4", oracle="""
SELECT doc_id, md5(regexp_replace(translate(replace(translate(translate(text, 'eaotnid', '嗯中：。～、…'), '嗯呣', '恩母'), '...', '…'),
  '：；，。！？·、$/—~～' || chr(10), ',,,.!?,,.,-……' || '.'), '[^一-龥!?…,.\\-]+', '', 'g')) AS digest FROM documents""")
def symbol_map(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.map_symbols(F.translate("text", "eaotnid", "嗯中：。～、…"))).alias("digest"))


_PIECES = f"""
pc AS (SELECT doc_id, t, regexp_extract_all(CASE WHEN regexp_matches(u, '[{SPLIT}]$') THEN u ELSE u || '。' END, '(?s)[^{SPLIT}]*[{SPLIT}]') AS p
  FROM (SELECT doc_id, t, replace(replace(t, '……', '。'), '——', '，') AS u FROM (SELECT doc_id, {NL.format(c="text")} AS t FROM documents)))"""


@query("sentence_split", "TXT-5", oracle="WITH " + _PIECES + """
SELECT doc_id, len(p) AS n, md5(array_to_string(p, chr(10))) AS digest FROM pc""")
def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), T.pieces(T.strip_newlines(F.col("text"))))


@query("sentence_split_cjk", "TXT-5", oracle=f"""
SELECT doc_id, len(s) AS n, md5(array_to_string(s, chr(10))) AS digest FROM (
SELECT doc_id, list_transform(string_split_regex({TRIM.format(c="regexp_replace(regexp_replace(replace(text, ' ', ''), '[—《》【】<>{}()（）#&@“”^_|\\\\]', '', 'g'), '([：、，；。？！,;?!][”’]?)', '\\1' || chr(10), 'g')")}, '\\n+'),
  lambda x: {TRIM.format(c="x")}) AS s FROM documents)""")
def sentence_split_cjk(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), T.sentences(F.col("text")))


@query("cut_groups_of_four", "TXT-6", "UDF-1", oracle="WITH " + _PIECES + f""",
g AS (SELECT doc_id, CASE WHEN len(p) <= 8 THEN [t] ELSE list_transform(range(0, greatest(1, CAST(ceil(len(p) / 4.0) AS BIGINT) - 1)),
  lambda k: array_to_string(p[k * 4 + 1 : CASE WHEN k = greatest(1, CAST(ceil(len(p) / 4.0) AS BIGINT) - 1) - 1 THEN len(p) ELSE k * 4 + 4 END], '')) END AS c FROM pc),
f AS (SELECT doc_id, list_filter(c, lambda x: {SHORT}) AS c FROM g)
SELECT doc_id, len(c) AS n, md5(array_to_string(c, chr(10))) AS digest FROM f""")
def cut_groups_of_four(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), segmentation("cut1")(F.col("text")))


_FIFTY = """
b AS (SELECT doc_id, t, p, string_split(list_reduce(list_prepend('', p), lambda acc, x:
  CASE WHEN length(string_split(acc || x, chr(1))[-1]) > 50 THEN acc || x || chr(1) ELSE acc || x END), chr(1)) AS s FROM pc),
o AS (SELECT doc_id, t, p, list_filter(s, lambda x: x <> '') AS s, s[-1] AS tail FROM b),
j AS (SELECT doc_id, CASE WHEN len(p) < 2 THEN [t] WHEN len(s) > 1 AND length(s[-1]) < 50 THEN list_append(s[1:len(s) - 2], s[len(s) - 1] || s[len(s)]) ELSE s END AS c, len(p) < 2 AS one FROM o),
f AS (SELECT doc_id, CASE WHEN one THEN c ELSE list_filter(c, lambda x: """ + SHORT + """) END AS c FROM j)"""


@query("cut_fifty", "TXT-6", oracle="WITH " + _PIECES + "," + _FIFTY + "SELECT doc_id, len(c) AS n, md5(array_to_string(c, chr(10))) AS digest FROM f")
def cut_fifty(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), segmentation("cut2")(F.col("text")))


@query("cut_stops", "TXT-6", oracle=f"""
WITH t AS (SELECT doc_id, {NL.format(c="text")} AS t FROM documents),
a AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(replace(t, '.', '。'), '^。+', ''), '。+$', ''), '。'), lambda x: {SHORT}) AS c3,
  list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '^\\.+', ''), '\\.+$', ''), '([0-9])\\.', '\\1' || chr(1), 'g'), '\\.([0-9])', chr(1) || '\\1', 'g'), '.'),
    lambda x: replace(x, chr(1), '.')), lambda x: {SHORT}) AS c4 FROM t)
SELECT doc_id, len(c3) AS n3, md5(array_to_string(c3, chr(10))) AS digest3, len(c4) AS n4, md5(array_to_string(c4, chr(10))) AS digest4 FROM a""")
def cut_stops(spark: SparkSession, d: str) -> DataFrame:
    c3 = segmentation("cut3")(F.replace("text", F.lit("."), F.lit("。")))
    c4 = segmentation("cut4")(F.col("text"))
    return _docs(spark, d).select(
        "doc_id", F.size(c3).alias("n3"), F.md5(F.array_join(c3, "\n")).alias("digest3"), F.size(c4).alias("n4"), F.md5(F.array_join(c4, "\n")).alias("digest4"))


@query("cut_clauses", "TXT-6", oracle=f"""
WITH t AS (SELECT doc_id, {NL.format(c="text")} AS t FROM documents),
m AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g'), '([0-9])\\.([0-9])', '\\1' || chr(1) || '\\2', 'g') AS t FROM t),
p AS (SELECT doc_id, list_transform(regexp_extract_all(t, '(?s)[^,.;?!、，。？！：…]*[,.;?!、，。？！：…]|[^,.;?!、，。？！：…]+'), lambda x: replace(x, chr(1), '.')) AS p FROM m),
f AS (SELECT doc_id, list_filter(p, lambda x: NOT regexp_full_match(x, '[,.;?!、，。？！：…]*')) AS c FROM p)
SELECT doc_id, len(c) AS n, md5(array_to_string(c, chr(10))) AS digest FROM f""")
def cut_clauses(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), segmentation("cut5")(F.col("text")))


@query("pack_long_text", "TXT-7", oracle=f"""
WITH k AS (SELECT doc_id, regexp_extract_all(text, '(?s)[^{SPLIT}]+|[{SPLIT}]') AS k FROM documents),
b AS (SELECT doc_id, list_filter(string_split(list_reduce(list_prepend('', k), lambda acc, x:
  CASE WHEN length(string_split(acc, chr(1))[-1]) + length(x) > 510 THEN acc || chr(1) || x ELSE acc || x END), chr(1)), lambda x: x <> '') AS c FROM k)
SELECT doc_id, len(c) AS n, md5(array_to_string(c, chr(10))) AS digest FROM b""")
def pack_long_text(spark: SparkSession, d: str) -> DataFrame:
    packs = F.filter(T.pack_long(F.col("text")), lambda x: x != "")
    return _digest(_docs(spark, d), packs)


@query("merge_short_pieces", "TXT-8", oracle="WITH " + _PIECES + """,
b AS (SELECT doc_id, p, string_split(list_reduce(list_prepend('', p), lambda acc, x:
  CASE WHEN length(string_split(acc || x, chr(1))[-1]) >= 5 THEN acc || x || chr(1) ELSE acc || x END), chr(1)) AS s FROM pc),
c AS (SELECT doc_id, CASE WHEN len(p) < 2 THEN p WHEN s[-1] = '' THEN s[1:len(s) - 1] WHEN len(s) = 1 THEN s
  ELSE list_append(s[1:len(s) - 2], s[len(s) - 1] || s[len(s)]) END AS c FROM b)
SELECT doc_id, len(c) AS n, md5(array_to_string(c, chr(10))) AS digest FROM c""")
def merge_short_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), T.merge_short(T.pieces(T.strip_newlines(F.col("text"))), 5))


@query("apportion_text", "TXT-9", oracle=f"""
WITH c AS (SELECT conv_id, turn, text, length(text) AS n, (turn % 9 + 1) / 10.0::DOUBLE AS r FROM conversations),
a AS (SELECT *, greatest(1, least(n - 1, round_even(n * r, 0)::BIGINT)) AS raw, greatest(2, n // 4) AS lim FROM c),
s AS (SELECT *, list_filter(flatten(list_transform(range(0, lim), lambda d: [raw - d, raw + d])),
  lambda p: p >= 1 AND p <= n - 1 AND contains('{T.CUT_PUNCT}', substring(text, p::INT, 1)))[1] AS hit FROM a)
SELECT conv_id, turn, CASE WHEN n <= 1 THEN n ELSE coalesce(hit, raw) END AS take FROM s""")
def apportion_text(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "conversations").select(
        "conv_id", "turn", T.apportion(F.col("text"), (F.col("turn") % 9 + 1) / 10).alias("take"))


@query("pre_segment", "TXT-10")
def pre_segment(spark: SparkSession, d: str) -> DataFrame:
    return _digest(_docs(spark, d), T.pre_segment(F.col("text"), "cut5", "en"))


_MIXED = "translate(text, 'eaon', 'あカ漢한')"


@query("script_classes", "TXT-11", oracle=f"""
SELECT doc_id, regexp_matches(text, '[A-Za-z]') AND regexp_full_match(text, '(?s)[A-Za-z0-9\\s\\x{{20}}-\\x{{7E}}\\x{{2000}}-\\x{{206F}}\\x{{3000}}-\\x{{303F}}\\x{{FF00}}-\\x{{FFEF}}]+') AS english,
  length(regexp_replace({_MIXED}, '[^{T.CJK}0-9、-〜。！？.!?… /]', '', 'g')) AS cjk_chars,
  len(regexp_extract_all({_MIXED}, '[ぁ-ゖ゙゚ァ-ヺー]+(?:[0-9、\\-〜。！？.!?… ]+[ぁ-ゖ゙゚ァ-ヺー]*)*')) AS kana_runs,
  length(array_to_string(regexp_extract_all({_MIXED}, '[\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}\\x{{AC00}}-\\x{{D7AF}}]+(?:[0-9、\\-〜。！？.!?… ]+[\\x{{1100}}-\\x{{11FF}}\\x{{3130}}-\\x{{318F}}\\x{{AC00}}-\\x{{D7AF}}]*)*'), '')) AS hangul_chars FROM documents""")
def script_classes(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.translate("text", "eaon", "あカ漢한")
    ja = F.filter(T.script_runs(mixed, T.KANA, "ja", "x"), lambda r: r["lang"] == "ja")
    ko = F.filter(T.script_runs(mixed, T.HANGUL, "ko", "x"), lambda r: r["lang"] == "ko")
    return _docs(spark, d).select(
        "doc_id", T.all_english(F.col("text")).alias("english"), F.length(T.cjk_only(mixed)).alias("cjk_chars"), F.size(ja).alias("kana_runs"),
        F.aggregate(ko, F.lit(0), lambda s, r: s + F.length(r["text"])).alias("hangul_chars"))


@query("language_runs", "TXT-12", "TXT-11")
def language_runs(spark: SparkSession, d: str) -> DataFrame:
    runs = T.language_runs(F.translate("text", "eaon", "あカ漢한"))
    r = _docs(spark, d).select("doc_id", F.explode(T.run_totals(runs)).alias("r"))
    return r.groupBy("doc_id", "r.lang").agg(F.sum("r.runs").alias("runs"), F.sum("r.chars").alias("chars"))


@query("truncate_text", "TXT-14", oracle="SELECT doc_id, left(text, 48) AS head FROM documents")
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", T.truncate(F.col("text"), 48).alias("head"))


@query("tag_strip", "TXT-13", oracle=f"SELECT doc_id, md5({TRIM.format(c='text')}) AS digest FROM documents")
def tag_strip(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.md5(T.strip_tags(F.concat(F.lit("<|ja|>"), "text", F.lit("<|end|>")))).alias("digest"))


# --- clocks and logs -----------------------------------------------------------------

@query("stamp_parse", "TIM-1", oracle="""
SELECT event_id, h * 3600000 + m * 60000 + s * 1000 + f AS srt_ms, h * 3600000 + m * 60000 + s * 1000 + f * 10 AS ass_ms FROM (
SELECT event_id, event_id % 120 AS h, event_id % 60 AS m, event_id % 59 AS s, event_id % 100 AS f FROM events)""")
def stamp_parse(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    i = F.col("event_id").cast("int")
    return e.select("event_id", F.format_string("%d:%02d:%02d.%d", i % 120, i % 60, i % 59, i % 100).alias("t")).select(
        "event_id", C.stamp_ms(F.col("t"), 1000).alias("srt_ms"), C.stamp_ms(F.col("t"), 100).alias("ass_ms"))


@query("probe_logs", "TIM-2", oracle="""
SELECT o_orderkey AS item_id, round((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + (o_custkey % 60) + 0.5, 3)::DOUBLE AS duration, n AS streams
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) ON l_orderkey = o_orderkey""")
def probe_logs(spark: SparkSession, d: str) -> DataFrame:
    o, li = A.read(spark, d, "orders"), A.read(spark, d, "lineitem")
    k, c = F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int")
    head = o.select(F.col("o_orderkey").alias("item_id"), F.lit(0).alias("line_no"),
                    F.format_string("  Duration: %02d:%02d:%02d.50, start: 0.0", k % 30, k % 60, c % 60).alias("line"))
    kind = F.when(F.col("l_returnflag") == "A", "Video: h264").when(F.col("l_returnflag") == "R", "Audio: aac").otherwise("Data: none")
    body = li.select(F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("line_no"),
                     F.concat(F.lit("  Stream #0:1(und): "), kind, F.lit(" (x)")).alias("line"))
    durations, streams = C.probe_logs(head.unionByName(body))
    n = streams.groupBy("item_id").agg(F.count(F.lit(1)).alias("streams"))
    return durations.join(n, "item_id", "left")


@query("silence_logs", "TIM-3", "INT-1", oracle="""
WITH l AS (SELECT user_id AS item_id, event_id, event_type IN ('view', 'click') AS s, event_type = 'error' AS e FROM events),
a AS (SELECT item_id, event_id * 100 AS t, row_number() OVER (PARTITION BY item_id ORDER BY event_id) AS n FROM l WHERE s),
b AS (SELECT item_id, event_id * 100 AS t, row_number() OVER (PARTITION BY item_id ORDER BY event_id) AS n FROM l WHERE e)
SELECT a.item_id, a.t AS start_ms, b.t AS end_ms FROM a LEFT JOIN b USING (item_id, n) WHERE b.t IS NULL OR b.t > a.t""")
def silence_logs(spark: SparkSession, d: str) -> DataFrame:
    e = A.read(spark, d, "events")
    word = F.when(F.col("event_type").isin("view", "click"), "silence_start: ").when(F.col("event_type") == "error", "silence_end: ").otherwise("frame= ")
    lines = e.select(F.col("user_id").alias("item_id"), F.col("event_id").alias("line_no"),
                     F.concat(F.lit("[sd @ 0x1] "), word, (F.col("event_id") / 10).cast("string"), F.lit(" |")).alias("line"))
    return C.silence_logs(lines)


@query("referers", "TIM-5", oracle="""
SELECT page_id, 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) || '/' AS referer FROM pages""")
def referers(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "pages").select("page_id", C.referer(F.col("url")).alias("referer"))


# --- files -------------------------------------------------------------------------------

_CUE_TEXT = """
ct AS (SELECT *, regexp_replace(regexp_replace(regexp_extract(""" + TRIM.format(c="text") + """ || chr(10) || chr(10), '(?s)^(.*?)\\n\\s*\\n', 1), '[\\s　]*\\n[\\s　]*', ' ', 'g'), '^[\\s　]+|[\\s　]+$', '', 'g') AS t FROM cues)"""


@query("subtitle_blocks", "SNK-1", oracle=A.sql(A.CUES, body="""
SELECT item_id, n, n || chr(10) || printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms // 60000 % 60, start_ms // 1000 % 60, start_ms % 1000) || ' --> ' ||
  printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms // 60000 % 60, end_ms // 1000 % 60, end_ms % 1000) || chr(10) || """ + TRIM.format(c="text") + """ || chr(10) AS value
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY start_ms, ord) AS n FROM cues)"""))
def subtitle_blocks(spark: SparkSession, d: str) -> DataFrame:
    return ST.srt_blocks(A.cues(spark, d))


@query("subtitle_round_trip", "SRC-2", "SNK-1", "SRC-4", oracle=A.sql(A.CUES, _CUE_TEXT, body="SELECT item_id, start_ms, end_ms, t AS text FROM ct WHERE t <> ''"))
def subtitle_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "srt")
    ST.write_srt(A.cues(spark, d), path)
    got = ST.read_subtitles(spark, path)
    return got.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), "start_ms", "end_ms", "text")


@query("ass_parse", "SRC-3", oracle=A.sql(A.CUES, f"""
f AS (SELECT *, {TRIM.format(c="regexp_replace(text, '\\s*\\n\\s*', ' ', 'g')")} AS t FROM cues)""", body="""
SELECT item_id, ord, start_ms // 1000 * 1000 + start_ms % 1000 // 10 * 10 AS start_ms, end_ms // 1000 * 1000 + end_ms % 1000 // 10 * 10 AS end_ms, t AS text FROM f WHERE t <> ''"""))
def ass_parse(spark: SparkSession, d: str) -> DataFrame:
    def stamp(c: str) -> Column:
        t = F.col(c)
        return F.format_string("%d:%02d:%02d.%02d", F.floor(t / 3_600_000), F.floor(t / 60_000) % 60, F.floor(t / 1000) % 60, F.floor(t % 1000 / 10))

    one = F.regexp_replace("text", r"\s*\n\s*", r"\\N")
    lines = A.cues(spark, d).select("item_id", F.col("ord").alias("line_no"), F.concat(
        F.lit("Dialogue: 0,"), stamp("start_ms"), F.lit(","), stamp("end_ms"), F.lit(r",Default,,0,0,0,,{\an8}"), one).alias("line"))
    noise = lines.select("item_id", "line_no", F.lit("Dialogue: broken,line").alias("line"))
    return ST.parse_ass(lines.unionByName(noise)).withColumnRenamed("line_no", "ord")


@query("manifest_parse", "SRC-5", "SNK-2", oracle=A.sql(A.CLIPS, f"""
c AS (SELECT *, replace({TRIM.format(c="text")}, '|', ' ') AS t FROM clips)""", body="""
SELECT ord::VARCHAR || '.wav' AS path, speaker, language, md5("""+ TRIM.format(c="split_part(t, chr(10), 1)") + """) AS digest FROM c WHERE t <> ''"""))
def manifest_parse(spark: SparkSession, d: str) -> DataFrame:
    """Manifest written to text files and read back; further lines of a text are rejects."""
    path = scratch_path(spark, "manifest")
    plan = A.clips(spark, d).filter(~T.is_blank(F.col("text"))).select(
        F.concat(F.col("ord").cast("string"), F.lit(".wav")).alias("path"), "speaker", "language", "text",
        F.col("ord").alias("seq"), F.lit(None).cast("string").alias("reason"))
    M.write_manifest(plan, path)
    good, _ = M.read_manifest(spark, path)
    return good.select("path", "speaker", "language", F.md5("text").alias("digest"))


@query("manifest_rejects", "SRC-5", oracle="""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS v FROM documents)
SELECT CASE WHEN length(v) - length(replace(v, '|', '')) = 3 THEN 'good' ELSE 'bad' END AS fate, count(*) AS n FROM l
WHERE length(v) - length(replace(v, '|', '')) = 3 OR regexp_matches(v, '[^\\s　]') GROUP BY 1""")
def manifest_rejects(spark: SparkSession, d: str) -> DataFrame:
    lines = _docs(spark, d).select(F.explode(F.split("text", "\n")).alias("value"))
    good, bad = M.parse_manifest(lines)
    tag = lambda df, w: df.agg(F.lit(w).alias("fate"), F.count(F.lit(1)).alias("n"))
    return tag(good, "good").unionByName(tag(bad, "bad")).filter("n > 0")


@query("speaker_manifests", "SNK-3", oracle=A.sql(A.CLIPS, __import__("clipweave.catalog.clipsets", fromlist=["_SPK"])._SPK, body="""
SELECT speaker AS speaker_dir, 'list' AS split, count(*) AS n FROM kp GROUP BY 1
UNION ALL SELECT speaker, 'val_list', count(*) FROM kp WHERE is_val GROUP BY 1"""))
def speaker_manifests(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "lists")
    plan = X.export_plan(A.clips(spark, d), per_speaker=True, val_ratio=0.2)
    M.write_speaker_manifests(plan, path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.filter(F.size(F.split("value", r"\|")) == 4).groupBy("speaker_dir", "split").agg(F.count(F.lit(1)).alias("n"))


@query("phoneme_table", "SRC-6", oracle="""
SELECT 'c' || conv_id AS name, arg_max(length(text) - length(replace(text, ' ', '')) + 1, turn) AS n_phones, max(turn)::VARCHAR AS word2ph FROM conversations
WHERE NOT contains(text, chr(9)) AND turn % 5 <> 4 GROUP BY 1""")
def phoneme_table(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "conversations")
    turn = F.col("turn").cast("string")
    cells = F.when(F.col("turn") % 5 != 4, F.concat_ws("\t", F.concat(F.lit("c"), "conv_id"), "text", turn, F.lit("norm"))).otherwise(F.concat(F.lit("c"), "conv_id"))
    got = M.parse_phonemes(c.select(F.col("turn").alias("line_no"), cells.alias("value")))
    return got.select("name", F.size("phones").cast("long").alias("n_phones"), "word2ph")


@query("semantic_table", "SRC-7", oracle="""
SELECT 'd' || doc_id AS name, (n_chars % 50 + 1)::INT AS n, ((n_chars % 50) * (n_chars % 50 + 1) // 2)::BIGINT AS total FROM documents""")
def semantic_table(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "semantic")
    rows = _docs(spark, d).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"),
                                  F.sequence(F.lit(0).cast("long"), F.col("n_chars") % 50).alias("ids"))
    M.write_semantic(rows, path)
    return M.read_semantic(spark, path).select(
        "name", F.size("ids").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("json_lines", "SRC-8", "SNK-5", oracle="SELECT doc_id, md5(text) AS digest, lang FROM documents")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    M.write_json_lines(_docs(spark, d).select("doc_id", "text", "lang"), path)
    return M.read_json_lines(spark, path, "doc_id long, text string, lang string").select("doc_id", F.md5("text").alias("digest"), "lang")


@query("url_lines", "SRC-9", oracle="""
SELECT g AS batch, url, count(*) AS n FROM (SELECT page_id // 10 AS g, url FROM pages UNION ALL SELECT page_id, url FROM pages) GROUP BY 1, 2""")
def url_lines(spark: SparkSession, d: str) -> DataFrame:
    p = A.read(spark, d, "pages")
    pasted = p.groupBy(F.floor(F.col("page_id") / 10).alias("batch")).agg(
        F.concat(F.lit("\r\n  "), F.array_join(F.collect_list("url"), " \r\n\r"), F.lit("\n")).alias("raw"))  # ten URLs each
    lists = p.select(F.col("page_id").alias("batch"), F.array("url", F.lit("  ")).alias("urls"))
    both = M.split_urls(pasted).unionByName(M.url_list(lists))
    return both.groupBy("batch", "url").agg(F.count(F.lit(1)).alias("n"))


@query("merge_parts", "SNK-4", oracle="""
SELECT row_number() OVER (ORDER BY conv_id % 4, conv_id * 1000 + turn) AS ord, md5(text) AS digest FROM conversations WHERE regexp_matches(text, '[^\\s　]')""")
def merge_parts(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "conversations")
    parts = c.select((F.col("conv_id") % 4).alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.col("text").alias("value"))
    blanks = parts.select("part", F.col("line_no"), F.lit("  ").alias("value"))
    return M.merge_parts(parts.unionByName(blanks)).select("ord", F.md5("value").alias("digest"))


# --- extension surface --------------------------------------------------------------------

@query("sql_functions", "UDF-1", "UDF-4", "INT-7", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT seg_id, CASE WHEN q IS NULL THEN '' WHEN q >= 80 THEN 'good' WHEN q >= 60 THEN 'fair' ELSE 'poor' END AS band,
  CASE WHEN end_ms - start_ms >= 300 THEN (end_ms - start_ms - 300) // 500 + 1 ELSE 0 END AS n_windows FROM segments"""))
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    register_sql(spark)
    A.segments(spark, d).createOrReplaceTempView("clipweave_segments")
    return spark.sql("""
        SELECT s.seg_id, cw_score_band(any_value(s.q)) AS band, count(w.ws) AS n_windows
        FROM clipweave_segments s LEFT JOIN LATERAL cw_windows(s.start_ms, s.end_ms) w ON true GROUP BY s.seg_id""")


@query("distinct_evaluation", "UDF-5", oracle="""
SELECT event_id, md5(upper(event_type) || '!') AS result FROM events""")
def distinct_evaluation(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.functions.hooks import evaluate_distinct

    e = A.read(spark, d, "events").select("event_id", "event_type")
    out = evaluate_distinct(e, "event_type", lambda s: s.str.upper() + "!", "string", "result")
    return out.select("event_id", F.md5("result").alias("result"))


@query("vector_provider", "UDF-2", oracle=A.sql(A.CUES, body="""
SELECT item_id, ord, 2 AS dims, round((end_ms - start_ms) / 1000.0, 3)::DOUBLE AS first FROM cues WHERE end_ms - start_ms >= 250"""))
def vector_provider(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.functions.hooks import embed_ranges

    def provider(rows):  # noqa: ANN001, ANN202
        return [[(e - s) / 1000.0, 1.0] if e - s >= 250 else None for s, e in zip(rows["start_ms"], rows["end_ms"], strict=True)]

    out = embed_ranges(A.cues(spark, d).select("item_id", "ord", "start_ms", "end_ms"), provider)
    return out.filter("emb IS NOT NULL").select("item_id", "ord", F.size("emb").alias("dims"), F.round(F.col("emb")[0], 3).alias("first"))


