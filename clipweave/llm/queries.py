"""Registered queries of the numbered operators, next to the DuckDB SQL they must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.llm import bpe, decontam, filteraudit, hardneg, langid, linededup, minhash, pii, quality, rendering, repetition, substrings, warc
from clipweave.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: words of a text in DuckDB
WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda w: w <> '')"
ASCII = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, oracle: str | None = None) -> Callable:
    def keep(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return keep


def _spans(spans: Column) -> Column:
    """start:end pairs as text, in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def _covered(n: int, as_name: str) -> str:
    """Words of a text that lie in n-word windows found twice or more in it."""
    return f"""{as_name} AS (
      SELECT rid, count(DISTINCT p + o) AS {as_name}_words FROM (
        SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM (
          SELECT rid, p, array_to_string(list_slice(words, p, p + {n - 1}), ' ') AS g
          FROM docs, unnest(range(1, len(words) - {n - 2})) u(p) WHERE len(words) >= {n}) WHERE p IS NOT NULL),
        unnest(range({n})) v(o) WHERE c > 1 GROUP BY rid)"""


REPETITION_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
{_covered(3, "triple")}, {_covered(repetition.MIN_REPEAT, "cover")}, {_covered(repetition.MAX_REPEAT + 1, "longer")},
lines AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM docs),
all_of AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, list_sum(list_transform(words, lambda w: length(w)))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(triple_words, 0)::BIGINT AS n_repeat_words, coalesce(cover_words, 0)::BIGINT AS covered_words, coalesce(longer_words, 0) > 0 AS long_repeat
  FROM docs JOIN lines USING (rid) LEFT JOIN triple USING (rid) LEFT JOIN cover USING (rid) LEFT JOIN longer USING (rid))
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, covered_words, long_repeat,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT long_repeat
    AND 1000 * covered_words <= {int(repetition.MAX_COVERED * 1000)} * n_words AS kept
FROM all_of
"""


@query("op1_repetition_rules", REPETITION_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = repetition.judge(repetition.repetition(table(spark, sf_dir, "documents")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "long_repeat", "base_failed", "kept")


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to
FROM m
"""


@query("op3_warc_revisits", WARC_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.deduplicate(spark, warc.archive(table(spark, sf_dir, "pages")))
    return warc.resolve(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {ASCII.format("array_to_string(" + WORDS + ", ' ')")} AS t FROM documents),
w AS (SELECT doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) u(p)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * i >= 75 * (x.n + y.n - i)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN c ON doc_id = a LEFT JOIN n USING (doc_id)
"""


@query("op4_near_duplicates", NEAR_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"))


DECONTAM_SQL = f"""
WITH i AS (SELECT DISTINCT item_id, {ASCII.format("array_to_string(" + WORDS + ", ' ')")} AS t FROM benchmark),
iw AS (SELECT item_id, string_split(t, ' ') AS w FROM i WHERE t <> ''),
s AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(list_slice(w, p, p + least(len(w), 5) - 1), ' ') AS g
      FROM iw, unnest(range(1, len(w) - least(len(w), 5) + 2)) u(p)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY 1),
dw AS (SELECT DISTINCT doc_id, string_split({ASCII.format("array_to_string(" + WORDS + ", ' ')")}, ' ') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS g
      FROM (SELECT DISTINCT k FROM s), dw, unnest(range(1, len(w) - k + 2)) u(p) WHERE len(w) >= k)
SELECT doc_id, item_id, any_value(n)::BIGINT AS n_item_shingles, count(*)::BIGINT AS n_shared
FROM g JOIN s USING (k, g) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING 1000 * count(*) >= 750 * any_value(n)
"""


@query("op7_decontamination", DECONTAM_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("doc").alias("doc_id"), "item_id", "n_item_shingles", "n_shared")


LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, p, lines[p] AS line, {ASCII.format("trim(lines[p], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
      FROM d, unnest(range(1, len(lines) + 1)) u(p)),
k AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT rid, l.doc_id, p, line, coalesce(l.doc_id > owner, false) AS gone FROM l LEFT JOIN k USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid
"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = linededup.marked(table(spark, sf_dir, "documents"))
    return held.select(
        F.col("doc").alias("doc_id"), F.size(linededup.lines_of(F.col("row.text"))).cast("long").alias("n_lines"),
        linededup.n_dropped().alias("n_dropped"), F.sha2(linededup.kept_text(), 256).alias("kept_sha256"),
    )


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


UNITS_SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
t AS (SELECT *, regexp_extract_all(text, '[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]+') AS tokens FROM d),
k AS (SELECT doc_id, text, unnest(range(1, len(tokens) + 1)) AS p, unnest(tokens) AS token FROM t),
w AS (SELECT *, ltrim(token, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word,
        sum(length(token)) OVER (PARTITION BY doc_id, text ORDER BY p) AS stop, lag(token) OVER (PARTITION BY doc_id, text ORDER BY p) AS before FROM k),
b AS (SELECT *, p = 1 OR starts_with(regexp_extract(token, '\\n'), chr(10)) OR regexp_matches(before, '[.!?]$') OR regexp_matches(word, '^\\p{{Lu}}') AS begins FROM w),
e AS (SELECT *, coalesce(lead(begins) OVER (PARTITION BY doc_id, text ORDER BY p), true) AS ends FROM b),
u AS (SELECT x.doc_id, x.text, x.p, y.p AS q, x.stop - length(x.word) AS s, y.stop AS e
      FROM (SELECT *, p + {substrings.PASSAGE_WORDS - 1} AS least FROM e WHERE begins) x
      ASOF JOIN (SELECT * FROM e WHERE ends) y ON x.doc_id = y.doc_id AND x.text = y.text AND x.least <= y.p),
l AS (SELECT doc_id, text, list(word ORDER BY p) AS words FROM w GROUP BY ALL),
h AS (SELECT doc_id, text, s, e, {ASCII.format("array_to_string(list_slice(words, p, q), ' ')")} AS key FROM u JOIN l USING (doc_id, text)),
r AS (SELECT doc_id, text, s, e, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS n FROM h),
g AS (SELECT doc_id, text, s, e, coalesce(s > max(e) OVER (PARTITION BY doc_id, text ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS apart FROM r WHERE n > 1),
i AS (SELECT *, sum(apart::INTEGER) OVER (PARTITION BY doc_id, text ORDER BY s, e) AS part FROM g),
m AS (SELECT doc_id, text, min(s)::BIGINT AS s, max(e)::BIGINT AS e FROM i GROUP BY doc_id, text, part),
c AS (SELECT doc_id, text, count(*) AS n_removed, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM m GROUP BY ALL)
SELECT d.doc_id, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(spans, '') AS spans FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id AND d.text = c.text
"""


@query("op10_substring_dedup", UNITS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = substrings.dedup(table(spark, sf_dir, "documents"))
    return held.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_removed", _spans(F.col("spans")).alias("spans"))


@query("op2_weak_label_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.classify(table(spark, sf_dir, "documents"))
    return judged.select(F.col("doc").alias("doc_id"), "n_words", F.round("score", 4).alias("score"), "kept")


@query("op6_personal_data")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc").alias("doc_id"), *[f"n_{k}" for k in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op5_layout_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.extract(table(spark, sf_dir, "pages"))


@query("op11_cross_parsing_language")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = langid.identify(table(spark, sf_dir, "documents"))
    return told.select(F.col("doc").alias("doc_id"), "held_out", "lang_pred", F.round("score", 6).alias("score"))


AUDIT_SQL = f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
seen AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT part, text, {WORDS} AS words, coalesce(doc_id > first, false) AS again, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
      FROM t JOIN seen USING (text) LEFT JOIN l USING (doc_id)),
f AS (SELECT part, good, toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), again] AS fails FROM w),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT unnest({filteraudit.ORDERS}) AS filter_order),
r AS (SELECT m.*, filter_order, list_min(list_filter([CASE WHEN fails[ascii(filter_order[k]) - 64] THEN k END for k in [1, 2, 3, 4, 5]], lambda k: k IS NOT NULL)) AS gone FROM m, o),
s AS (SELECT part, filter_order, step, filter_order[step] AS letter,
        coalesce(sum(n) FILTER (gone IS NULL OR gone > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (gone = step), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (gone < step AND fails[ascii(filter_order[step]) - 64]), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (fails[ascii(filter_order[step]) - 64] AND len(list_filter(fails, lambda x: x)) = 1), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (gone = step), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (gone = step), 0)::BIGINT AS toxic_lost
      FROM r, unnest([1, 2, 3, 4, 5]) u(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
FROM s
"""


@query("op12_filter_audit", AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


HARD_SQL = """
WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT row_number() OVER () AS rid, * FROM e),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS other_id, b.label = a.label AS same, list_dot_product(a.vec, b.vec)::BIGINT AS score
      FROM r a JOIN r b ON a.rid <> b.rid WHERE a.vec_id % 100 = 0),
p AS (SELECT rid, anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY rid, positive_id ORDER BY score DESC, other_id))::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (rid) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@query("op13_hard_negatives", HARD_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.mine(table(spark, sf_dir, "embeddings"))
