"""State-table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.operators import state as S
from clipweave.sources.snapshots import explode_snapshots

COLS = ["item_id", "seg_id", "start_ms", "end_ms", "text", "character_id", "locked"]


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items of a customer's project."""
    return A.read(spark, d, "orders").select(
        F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("item_id"), F.col("o_orderdate").alias("created"))


@query("items_by_project", "JOI-1", oracle="""
SELECT o_custkey AS project_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders""")
def items_by_project(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.plans.scan import number_rows

    it = _items(spark, d).withColumn("_t", F.unix_micros(F.col("created").cast("timestamp")))
    return number_rows(it, ["project_id"], ["_t", "item_id"], "place").select("project_id", "item_id", "place")


@query("items_of_one_project", "JOI-1", oracle="""
SELECT o_custkey AS project_id, o_orderkey AS item_id FROM orders WHERE o_custkey = 7""")
def items_of_one_project(spark: SparkSession, d: str) -> DataFrame:
    return S.items_of_project(_items(spark, d), 7).select("project_id", "item_id")


@query("project_counts", "JOI-2", oracle="""
SELECT c_custkey AS project_id, coalesce(i.n, 0) AS n_items, coalesce(k.n, 0) AS n_characters FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) i ON o_custkey = c_custkey
LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) k ON l_suppkey = c_custkey""")
def project_counts(spark: SparkSession, d: str) -> DataFrame:
    projects = A.read(spark, d, "customer").select(F.col("c_custkey").alias("project_id"))
    chars = A.read(spark, d, "lineitem").select(F.col("l_suppkey").alias("project_id"))
    return S.project_counts(projects, _items(spark, d), chars)


@query("flatten_segments", "JOI-3", oracle=A.sql(A.EV, A.ITEMS, A.SEGMENTS, body="""
SELECT s.item_id, seg_id, duration_ms, end_ms - start_ms AS ms FROM segments s JOIN items USING (item_id)"""))
def flatten_segments(spark: SparkSession, d: str) -> DataFrame:
    return S.with_items(A.segments(spark, d), A.items(spark, d)).select(
        "item_id", "seg_id", "duration_ms", (F.col("end_ms") - F.col("start_ms")).alias("ms"))


def _characters(spark: SparkSession, d: str) -> DataFrame:
    """Customers as characters; their orders are the labels, keyed by order status."""
    o = A.read(spark, d, "orders")
    labels = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(
        F.concat_ws(":", F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))).alias("labels"))
    c = A.read(spark, d, "customer")
    return c.join(labels, c.c_custkey == labels.o_custkey, "left").select(
        F.col("c_custkey").alias("ord"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("char_id"),
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(S.AUTO_PREFIX), F.col("c_custkey").cast("string"))).otherwise(F.col("c_name")).alias("name"),
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.when(F.col("c_nationkey") == 3, "model").alias("exp"), F.col("c_nationkey").alias("emb_count"))


@query("label_key_lookup", "JOI-4", oracle="""
SELECT o_orderkey || ':' || o_orderstatus AS label_key, 'c' || o_custkey AS char_id FROM orders
UNION ALL SELECT l_orderkey || ':none', NULL FROM lineitem WHERE l_linenumber = 1""")
def label_key_lookup(spark: SparkSession, d: str) -> DataFrame:
    keys = A.read(spark, d, "orders").select(F.concat_ws(":", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("label_key"))
    none = A.read(spark, d, "lineitem").filter("l_linenumber = 1").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit(":none")).alias("label_key"))
    return S.character_of_key(keys.unionByName(none), _characters(spark, d))


@query("character_segments", "JOI-5", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, 'none' AS who FROM segments WHERE character_id IS NULL UNION ALL
SELECT item_id, seg_id, 'view' FROM segments WHERE character_id = 'view'"""))
def character_segments(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    pick = lambda c, w: S.segments_of_character(seg, c).select("item_id", "seg_id", F.lit(w).alias("who"))
    return pick(None, "none").unionByName(pick("view", "view"))


@query("orphan_entities", "JOI-6", "SET-2", oracle="""
WITH ch AS (SELECT c_custkey AS k, c_nationkey, 'c' || c_custkey AS char_id FROM customer WHERE c_nationkey <> 3),
lab AS (SELECT o_custkey AS k, o_orderkey FROM orders),
alive AS (SELECT DISTINCT k FROM lab JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity = 50)
SELECT char_id FROM ch WHERE k IN (SELECT k FROM lab) AND k NOT IN (SELECT k FROM alive)
  AND k NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 1)""")
def orphan_entities(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    refs = li.filter("l_quantity = 1").select(F.concat(F.lit("c"), F.col("l_partkey").cast("string")).alias("character_id"))
    valid = li.filter("l_quantity = 50").select(F.col("l_orderkey").alias("prefix"))
    return S.orphan_characters(_characters(spark, d), refs, valid).select("char_id")


@query("stale_entities", "JOI-7", oracle="""
WITH own AS (SELECT o_custkey AS k, bool_or(o_totalprice > 450000) AS other FROM orders GROUP BY 1)
SELECT 'c' || c_custkey AS char_id FROM customer JOIN own ON k = c_custkey
WHERE c_nationkey <> 3 AND c_custkey % 2 = 0 AND c_nationkey <= 1 AND NOT other""")
def stale_entities(spark: SparkSession, d: str) -> DataFrame:
    """Labels belong to the customer's own item, expensive orders to another one."""
    home = F.when(F.col("o_totalprice") > 450_000, F.col("o_orderkey") + 10_000_000).otherwise(F.col("o_custkey"))
    labels = A.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("ord")).agg(
        F.collect_list(F.concat_ws(":", home.cast("string"), F.col("o_orderkey").cast("string"))).alias("own"))
    ch = _characters(spark, d).join(labels, "ord").withColumn("labels", F.col("own")).withColumn("item_id", F.col("ord"))
    return S.stale_characters(ch).select("char_id")


@query("feature_availability", "JOI-9", "SET-1", oracle="""
SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id IN (SELECT vec_id FROM embeddings)
 AND doc_id IN (SELECT page_id FROM pages)""")
def feature_availability(spark: SparkSession, d: str) -> DataFrame:
    r = lambda t, c: A.read(spark, d, t).select(F.col(c).alias("doc_id"))
    lab = A.read(spark, d, "labels").filter("quality = 1").select("doc_id")
    return S.in_all([r("documents", "doc_id"), lab, r("embeddings", "vec_id"), r("pages", "page_id")], "doc_id")


_WORDS = """
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: length(w) > 0) AS w FROM documents),
dp AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS s FROM dw),
freq AS (SELECT s, count(*) AS n FROM dp GROUP BY 1),
vocab AS (SELECT s, row_number() OVER (ORDER BY s) AS id FROM freq WHERE n >= 20)"""


def _phones(spark: SparkSession, d: str) -> DataFrame:
    return A.read(spark, d, "documents").select(F.col("doc_id").alias("name"), A.word_tokens(F.col("text")).alias("phones"))


def _vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Words seen at least twenty times, numbered alphabetically; 0 is the unknown one."""
    from clipweave.plans.scan import number_all

    words = _phones(spark, d).select(F.explode("phones").alias("symbol")).groupBy("symbol").agg(_count()).filter("n >= 20")
    ids = number_all(words.select("symbol"), ["symbol"], "id")
    return ids.unionByName(spark.createDataFrame([("UNK", 0)], "symbol string, id long"))


@query("phoneme_ids", "JOI-10", oracle="WITH " + _WORDS + """
SELECT doc_id AS name, count(*) AS n, sum((i - 1) % 97 * coalesce(id, 0))::BIGINT AS checksum,
       count(CASE WHEN id IS NULL THEN 1 END) AS unknown FROM dp LEFT JOIN vocab USING (s) GROUP BY 1""")
def phoneme_ids(spark: SparkSession, d: str) -> DataFrame:
    out = S.phoneme_ids(_phones(spark, d), _vocabulary(spark, d))
    return out.select(
        "name", F.size("ids").cast("long").alias("n"),
        F.aggregate(F.transform("ids", lambda x, i: x * (i % 97)), F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"),
        F.size(F.filter("ids", lambda x: x == 0)).cast("long").alias("unknown"))


@query("snapshot_upsert", "UPD-1", oracle="""
SELECT c_custkey AS item_id, CASE WHEN n IS NOT NULL AND n % 2 = 0 THEN 'new' ELSE c_name END AS data, CASE WHEN n IS NOT NULL THEN 's' || n ELSE c_mktsegment END AS segments
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def snapshot_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = A.read(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("data"), F.col("c_mktsegment").alias("segments"))
    new = A.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("item_id")).agg(_count()).select(
        "item_id", F.when(F.col("n") % 2 == 0, "new").alias("data"), F.concat(F.lit("s"), F.col("n").cast("string")).alias("segments"))
    return S.upsert(old, new, "item_id")


@query("item_replace", "UPD-2", oracle="""
SELECT c_custkey AS item_id, coalesce(p, c_name) AS name FROM customer LEFT JOIN
(SELECT o_custkey, arg_max(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def item_replace(spark: SparkSession, d: str) -> DataFrame:
    old = A.read(spark, d, "customer").select(F.col("c_custkey").alias("item_id"), F.col("c_name").alias("name"))
    new = A.read(spark, d, "orders").select(F.col("o_custkey").alias("item_id"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("version"))
    return S.replace_by_id(old, new, "item_id")


@query("cascade_delete", "UPD-3", oracle="""
SELECT 'items' AS part, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' UNION ALL
SELECT 'snapshots', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') UNION ALL
SELECT 'deletable', count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = A.read(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("item_id"))
    snaps = A.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item_id"))
    items, left = S.delete_items(_items(spark, d), snaps, gone)
    free = S.deletable_projects(A.read(spark, d, "customer").select(F.col("c_custkey").alias("project_id")), _items(spark, d))
    part = lambda df, w: df.agg(F.lit(w).alias("part"), _count())
    return part(items, "items").unionByName(part(left, "snapshots")).unionByName(part(free, "deletable"))


@query("default_project", "UPD-4", oracle="""
WITH p AS (SELECT o_custkey AS project_id, min(o_orderdate) AS created FROM orders GROUP BY 1),
f AS (SELECT project_id FROM p ORDER BY created, project_id LIMIT 1)
SELECT o_orderkey AS item_id, CASE WHEN o_orderstatus = 'P' THEN (SELECT project_id FROM f) ELSE o_custkey END AS project_id FROM orders""")
def default_project(spark: SparkSession, d: str) -> DataFrame:
    it = _items(spark, d)
    projects = it.groupBy("project_id").agg(F.min("created").alias("created"))
    loose = A.read(spark, d, "orders").select(
        F.col("o_orderkey").alias("item_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("project_id"))
    return S.assign_default_project(loose, projects).select("item_id", "project_id")


@query("pool_migration", "UPD-5", oracle="""
SELECT o_orderkey AS item_id, 'p' || l_partkey AS char_id, o_orderkey || ':' || l_returnflag || ',' || o_orderkey || ':' || l_linestatus AS labels
FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 2""")
def pool_migration(spark: SparkSession, d: str) -> DataFrame:
    li = A.read(spark, d, "lineitem")
    one = F.struct(
        F.when(F.col("l_linenumber") != 2, F.concat(F.lit("p"), F.col("l_partkey").cast("string"))).alias("id"),
        F.lit("x").alias("name"), F.array("l_returnflag", "l_linestatus").alias("labels"))
    docs = li.join(A.read(spark, d, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(
        F.col("l_orderkey").alias("item_id")).agg(F.collect_list(one).alias("characters"))
    return S.pool_item_characters(docs).select("item_id", "char_id", F.array_join("labels", ",").alias("labels"))


@query("column_backfill", "UPD-6", oracle="""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE coalesce('[' || quality || ']', '[]') END AS segments FROM documents LEFT JOIN labels USING (doc_id)""")
def column_backfill(spark: SparkSession, d: str) -> DataFrame:
    rows = A.read(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("[]").alias("segments"))
    src = A.read(spark, d, "labels").select("doc_id", F.concat(F.lit("["), F.col("quality").cast("string"), F.lit("]")).alias("segments"))
    once = S.backfill(rows, src, "doc_id", ["segments"])
    return S.backfill(once, src, "doc_id", ["segments"])


@query("detach_refs", "UPD-7", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, CASE WHEN NOT locked AND character_id IN ('view', 'click') THEN NULL ELSE character_id END AS character_id,
       coalesce(NOT locked AND character_id IN ('view', 'click'), false) AS changed FROM segments"""))
def detach_refs(spark: SparkSession, d: str) -> DataFrame:
    gone = A.events(spark, d).filter("event_type IN ('view', 'click')").select(F.col("event_type").alias("char_id")).distinct()
    return S.detach_characters(A.segments(spark, d), gone).select("item_id", "seg_id", "character_id", "changed")


@query("reset_project", "UPD-8", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id % 4 AS project_id, count(character_id) FILTER (item_id % 4 <> 1) AS assigned, count(CASE WHEN item_id % 4 = 1 AND character_id IS NOT NULL THEN 1 END) AS changed,
       count(CASE WHEN locked THEN 1 END) AS locked FROM segments GROUP BY 1"""))
def reset_project(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d).withColumn("project_id", F.col("item_id") % 4)
    out, _ = S.reset_project(seg, seg.select("project_id"), 1)
    return out.groupBy("project_id").agg(F.count("character_id").alias("assigned"), F.count_if("changed").alias("changed"), F.count_if("locked").alias("locked"))


@query("field_owned_merge", "UPD-9", oracle="""
SELECT c_custkey AS char_id, c_name AS name, CASE WHEN n IS NULL THEN c_nationkey ELSE n END::BIGINT AS emb_count, coalesce(t, c_acctbal) AS embedding
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS t FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def field_owned_merge(spark: SparkSession, d: str) -> DataFrame:
    fresh = A.read(spark, d, "customer").select(F.col("c_custkey").alias("char_id"), F.col("c_name").alias("name"),
                                                 F.col("c_nationkey").cast("long").alias("emb_count"), F.col("c_acctbal").alias("embedding"))
    upd = A.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("char_id")).agg(
        F.count(F.lit(1)).alias("emb_count"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))).alias("embedding"),
        F.lit("old name").alias("name"))
    return S.merge_fields(fresh, upd, "char_id", ["emb_count", "embedding"])


_LOCKED = """
stored AS (SELECT item_id, seg_id, start_ms, end_ms, text, character_id, locked FROM segments),
incoming AS (
  SELECT item_id, seg_id, start_ms, end_ms, 'auto' AS text, 'auto' AS character_id, false AS locked FROM segments WHERE NOT mixed
  UNION ALL SELECT item_id, seg_id + 1000000000, start_ms + (end_ms - start_ms) // 2, end_ms, 'half', 'auto', seg_id % 2 = 0 FROM segments WHERE mixed),
keepers AS (SELECT * FROM stored WHERE locked),
missing AS (SELECT * FROM keepers k WHERE NOT EXISTS (SELECT 1 FROM incoming i WHERE i.item_id = k.item_id AND i.seg_id = k.seg_id)),
rest AS (SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM keepers k WHERE i.item_id = k.item_id AND i.seg_id = k.seg_id)
  AND (i.locked OR NOT EXISTS (SELECT 1 FROM missing m WHERE m.item_id = i.item_id AND m.start_ms < i.end_ms AND i.start_ms < m.end_ms
    AND i.end_ms > i.start_ms AND m.end_ms > m.start_ms
    AND (least(m.end_ms, i.end_ms) - greatest(m.start_ms, i.start_ms))::DOUBLE / least(m.end_ms - m.start_ms, i.end_ms - i.start_ms) >= 0.5)))"""


@query("locked_merge", "UPD-10", oracle=A.sql(A.EV, A.SEGMENTS, _LOCKED, body="SELECT * FROM rest UNION ALL SELECT * FROM keepers"))
def locked_merge(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    auto = seg.filter("NOT mixed").select("item_id", "seg_id", "start_ms", "end_ms", F.lit("auto").alias("text"),
                                          F.lit("auto").alias("character_id"), F.lit(False).alias("locked"))
    halves = seg.filter("mixed").select(
        "item_id", (F.col("seg_id") + 1_000_000_000).alias("seg_id"),
        (F.col("start_ms") + F.floor((F.col("end_ms") - F.col("start_ms")) / 2)).alias("start_ms"), "end_ms",
        F.lit("half").alias("text"), F.lit("auto").alias("character_id"), (F.col("seg_id") % 2 == 0).alias("locked"))
    return S.merge_locked(seg.select(*COLS), auto.unionByName(halves))


@query("merge_characters", "UPD-11", "SET-5", oracle="""
WITH ch AS (SELECT c_custkey AS k, 'c' || c_custkey AS char_id, c_nationkey AS g FROM customer),
lab AS (SELECT o_custkey AS k, o_orderkey, o_orderstatus FROM orders),
p AS (SELECT g, min(k) AS t, count(*) AS n FROM ch GROUP BY 1)
SELECT 'c' || t AS char_id, count(o_orderkey) AS n_labels, 'nation' || g AS name FROM p JOIN ch USING (g) LEFT JOIN lab USING (k) GROUP BY t, g""")
def merge_characters(spark: SparkSession, d: str) -> DataFrame:
    ch = _characters(spark, d)
    picks = ch.select("char_id", F.col("ord").alias("pick_no"), F.col("emb_count").alias("merge_id"),
                      F.concat(F.lit("nation"), F.col("emb_count").cast("string")).alias("name"))
    left, _ = S.merge_characters(ch, A.segments(spark, d), picks)
    return left.select("char_id", F.size("labels").cast("long").alias("n_labels"), "name")


@query("delete_characters", "UPD-12", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, CASE WHEN character_id = 'signup' THEN NULL ELSE character_id END AS character_id FROM segments"""))
def delete_characters(spark: SparkSession, d: str) -> DataFrame:
    gone = A.events(spark, d).filter("event_type = 'signup'").select(F.col("event_type").alias("char_id"))
    return S.delete_characters(A.segments(spark, d), gone).select("item_id", "seg_id", "character_id")


@query("merge_segments", "UPD-13", oracle=A.sql(A.EV, A.SEGMENTS, """
m AS (SELECT *, item_id * 100000 + start_ms // 30000 AS merge_id FROM segments),
f AS (SELECT merge_id, arg_min(seg_id, struct_pack(a := start_ms, b := ord)) AS seg_id, arg_min(item_id % 2, start_ms) AS en FROM m GROUP BY 1)""", body="""
SELECT m.merge_id, min(m.item_id) AS item_id, any_value(f.seg_id) AS seg_id, min(m.start_ms) AS start_ms, max(m.end_ms) AS end_ms, count(*)::INT AS merged,
       coalesce(CASE WHEN f.en = 0 THEN string_agg(CASE WHEN m.text <> '' THEN m.text END, ' ' ORDER BY m.start_ms, m.ord)
                ELSE string_agg(CASE WHEN m.text <> '' THEN m.text END, '' ORDER BY m.start_ms, m.ord) END, '') AS text
FROM m JOIN f USING (merge_id) GROUP BY m.merge_id, f.en HAVING count(*) >= 2"""))
def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d).withColumn("merge_id", F.col("item_id") * 100000 + F.floor(F.col("start_ms") / 30000)).withColumn(
        "language", F.when(F.col("item_id") % 2 == 0, "EN").otherwise("JP"))
    return S.merge_segments(seg).select("merge_id", "item_id", "seg_id", "start_ms", "end_ms", "merged", "text")


@query("merge_manifest_rows", "UPD-14", oracle="""
WITH l AS (SELECT conv_id * 1000 + turn AS ord, conv_id, turn, text FROM conversations),
t AS (SELECT min(ord) AS ord, string_agg(text, '' ORDER BY ord) AS t FROM l WHERE turn < 3 GROUP BY conv_id)
SELECT ord, coalesce(t, text) AS text FROM l LEFT JOIN t USING (ord) WHERE turn >= 3 OR t IS NOT NULL""")
def merge_manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    c = A.read(spark, d, "conversations").withColumn("ord", F.col("conv_id") * 1000 + F.col("turn"))
    picks = c.filter("turn < 3").select("ord", F.col("conv_id").alias("merge_id"))
    return S.merge_manifest_rows(c.select("ord", "text"), picks)


@query("toggle_lock", "UPD-15", oracle=A.sql(A.EV, A.SEGMENTS, """
p AS (SELECT item_id, seg_id, item_id || ':' || text AS sel, locked FROM segments WHERE text = '' OR locked),
w AS (SELECT sel, NOT bool_and(locked) AS t FROM p GROUP BY 1)""", body="""
SELECT s.item_id, s.seg_id, coalesce(w.t, s.locked) AS locked FROM segments s LEFT JOIN p USING (item_id, seg_id) LEFT JOIN w USING (sel)"""))
def toggle_lock(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    picks = seg.filter("text = '' OR locked").select("item_id", "seg_id", F.concat_ws(":", F.col("item_id").cast("string"), "text").alias("selection"))
    return S.toggle_lock(seg, picks).select("item_id", "seg_id", "locked")


@query("snapshot_diff", "UPD-16", "SET-2", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, count(*) AS missing, count(*) > 20 AS alarm FROM segments WHERE end_ms - start_ms < 2000 GROUP BY 1"""))
def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    return S.recover_deleted(seg, seg.filter("end_ms - start_ms >= 2000"))[1]


@query("snapshot_restore", "UPD-16", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, row_number() OVER (PARTITION BY item_id ORDER BY start_ms, seg_id) - 1 AS ord FROM segments"""))
def snapshot_restore(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.plans.scan import number_rows

    seg = number_rows(A.segments(spark, d).drop("ord"), ["item_id"], ["start_ms", "seg_id"], "_n").withColumn("ord", F.col("_n") - 1)
    seg = seg.select("item_id", "seg_id", "ord", "start_ms", "end_ms")
    current = seg.filter("end_ms - start_ms >= 2000")
    gone, _ = S.recover_deleted(seg, current)
    return S.restore_order(current, gone).select("item_id", "seg_id", "ord")


@query("item_lineage", "UPD-18", oracle="""
WITH RECURSIVE n AS (SELECT c_custkey AS item_id, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey - 1 END AS p FROM customer),
w AS (SELECT item_id, item_id AS root, 0 AS depth FROM n WHERE p IS NULL UNION ALL
      SELECT n.item_id, w.root, w.depth + 1 FROM w JOIN n ON n.p = w.item_id)
SELECT item_id, root, depth, root % 10 AS project_id FROM w""")
def item_lineage(spark: SparkSession, d: str) -> DataFrame:
    it = A.read(spark, d, "customer").select(
        F.col("c_custkey").alias("item_id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") - 1).alias("derived_from"))
    return S.lineage(it).withColumn("project_id", F.col("root") % 10)


@query("reassign_segments", "UPD-19", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, CASE WHEN text = '' THEN CASE WHEN seg_id % 2 = 0 THEN 'hand' END ELSE character_id END AS character_id,
       locked OR text = '' AS locked, text = '' AND seg_id % 2 = 0 AS sample FROM segments"""))
def reassign_segments(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    picks = seg.filter("text = ''").select("item_id", "seg_id", F.when(F.col("seg_id") % 2 == 0, "hand").otherwise("").alias("new_character"))
    out, samples = S.reassign(seg, picks)
    mark = samples.select("item_id", "seg_id", F.lit(True).alias("sample"))
    return out.join(mark, ["item_id", "seg_id"], "left").select(
        "item_id", "seg_id", "character_id", "locked", F.coalesce("sample", F.lit(False)).alias("sample"))


@query("apply_bounds", "UPD-20", oracle=A.sql(A.EV, A.ITEMS, A.SEGMENTS, """
e AS (SELECT s.*, duration_ms, greatest(0, least(start_ms - CASE seg_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 5000 ELSE -1000 END, duration_ms)) AS ns,
             greatest(0, least(end_ms + CASE seg_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 5000 ELSE -1000 END, duration_ms)) AS ne
      FROM segments s JOIN items USING (item_id)),
r AS (SELECT *, CASE WHEN ne - ns < 10 THEN 'too short' WHEN abs(ns - start_ms) < 5 AND abs(ne - end_ms) < 5 THEN 'unchanged' ELSE 'applied' END AS edit FROM e)""",
    body="""SELECT item_id, seg_id, CASE WHEN edit = 'applied' THEN ns ELSE start_ms END AS start_ms, CASE WHEN edit = 'applied' THEN ne ELSE end_ms END AS end_ms, edit FROM r"""))
def apply_bounds(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    k = F.col("seg_id") % 3
    a = F.when(k == 0, 3).when(k == 1, 5000).otherwise(-1000)
    b = F.when(k == 0, 2).when(k == 1, 5000).otherwise(-1000)
    edits = seg.select("item_id", "seg_id", (F.col("start_ms") - a).alias("start_ms"), (F.col("end_ms") + b).alias("end_ms"))
    return S.apply_bounds(seg, A.items(spark, d), edits).select("item_id", "seg_id", "start_ms", "end_ms", "edit")


@query("fill_texts", "UPD-21", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, seg_id, CASE WHEN seg_id % 3 = 0 THEN 'heard ' || seg_id ELSE text END AS text FROM segments"""))
def fill_texts(spark: SparkSession, d: str) -> DataFrame:
    seg = A.segments(spark, d)
    k = F.col("seg_id") % 3
    new = seg.select("item_id", "seg_id", F.when(k == 0, F.concat(F.lit("  heard "), F.col("seg_id").cast("string"), F.lit("\n"))).when(k == 1, "  ").alias("text"))
    ghosts = seg.select("item_id", (F.col("seg_id") + 1_000_000_000).alias("seg_id"), F.lit("gone").alias("text"))
    return S.fill_texts(seg, new.unionByName(ghosts)).select("item_id", "seg_id", "text")


@query("strong_or_weak", "SET-3", oracle=A.sql(*[A.VECTORS, A.VDIMS, A.POOL], """
m AS (SELECT item_id, label, d, avg(v) AS m FROM vdims GROUP BY 1, 2, 3)""", body="SELECT DISTINCT item_id AS project_id, 'speaker' || label AS label, true AS assigned FROM m"))
def strong_or_weak(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.catalog.voices import _labels, _pools
    from clipweave.operators import vectors as V

    labels, pools = _labels(spark, d), _pools(spark, d)
    strong = V.match_in_order(labels, pools, mode="strong").filter("how = 'match'")
    left = labels.join(strong.select(F.col("project_id").cast("long").alias("project_id"), "label"), ["project_id", "label"], "left_anti")
    weak = V.match_in_order(left, pools, mode="weak", threshold=0.82).filter("how <> 'pool'")
    both = strong.unionByName(weak)
    return both.select(F.col("project_id").cast("long").alias("project_id"), "label", F.col("char_id").isNotNull().alias("assigned"))


@query("history_with_live", "SET-4", oracle="""
SELECT o_orderkey AS task_id, CASE WHEN n IS NULL THEN 'old' ELSE 'live' END AS state FROM orders LEFT JOIN
(SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def history_with_live(spark: SparkSession, d: str) -> DataFrame:
    hist = A.read(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.lit("old").alias("state"))
    live = A.read(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("task_id")).distinct().withColumn("state", F.lit("live"))
    live = live.join(hist.select("task_id"), "task_id", "left_semi")
    return S.live_over_history(hist, live, "task_id")


@query("ttl_expiry", "TIM-4", oracle="""
SELECT event_id FROM events WHERE NOT (event_type IN ('purchase', 'error', 'signup') AND ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)""")
def ttl_expiry(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "error").when(
        F.col("event_type") == "signup", "cancelled").otherwise("running")
    t = A.read(spark, d, "events").select("event_id", status.alias("status"), F.col("ts").cast("timestamp").alias("finished"))
    return S.alive(t, F.lit("2024-01-31").cast("timestamp"), ttl_seconds=7 * 86400).select("event_id")


_DEPS = """
st AS (SELECT l_orderkey AS t, l_linenumber AS p, l_orderkey * 10 + l_linenumber AS up,
  CASE WHEN l_returnflag = 'R' AND l_linenumber = 7 THEN 'error' WHEN l_quantity <= 45 THEN 'done' ELSE 'running' END AS s,
  l_partkey % 997 = 0 AS miss FROM lineitem)"""


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Line items as upstream tasks of their order; a few upstreams do not exist."""
    li = A.read(spark, d, "lineitem")
    up = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    status = F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 7), "error").when(F.col("l_quantity") <= 45, "done").otherwise("running")
    deps = li.select(F.col("l_orderkey").cast("string").alias("task_id"), up.alias("upstream"), F.col("l_linenumber").alias("place"))
    tasks = li.filter("l_partkey % 997 <> 0").select(up.alias("task_id"), status.alias("status"), F.col("l_suppkey").alias("result"))
    return tasks.dropDuplicates(["task_id"]), deps


@query("dependency_ready", "STR-6", oracle="WITH " + _DEPS + """
SELECT t::VARCHAR AS task_id, CASE WHEN bool_or(miss OR s = 'error') THEN 'error' WHEN bool_and(s = 'done') THEN 'ready' ELSE 'waiting' END AS state,
       count(CASE WHEN NOT miss AND s = 'done' THEN 1 END) AS n_done, count(*) AS n_upstream FROM st GROUP BY 1""")
def dependency_ready(spark: SparkSession, d: str) -> DataFrame:
    return S.dependency_state(*_tasks(spark, d))


@query("dependency_cascade", "STR-6", oracle="""
WITH RECURSIVE n AS (SELECT o_orderkey AS t, o_orderkey // 3 AS up, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 3 = 0 THEN 'error' ELSE 'pending' END AS s FROM orders),
w AS (SELECT t FROM n WHERE s = 'error' UNION SELECT n.t FROM n JOIN w ON n.up = w.t WHERE n.t <> w.t)
SELECT t AS task_id, CASE WHEN t IN (SELECT t FROM w) THEN 'error' ELSE 'pending' END AS status FROM n""")
def dependency_cascade(spark: SparkSession, d: str) -> DataFrame:
    o = A.read(spark, d, "orders")
    tasks = o.select(F.col("o_orderkey").alias("task_id"), F.when((F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 3 == 0), "error").otherwise("pending").alias("status"))
    deps = o.select(F.col("o_orderkey").alias("task_id"), F.floor(F.col("o_orderkey") / 3).alias("upstream")).filter("task_id <> upstream")
    return S.cascade_failures(tasks, deps)


@query("snapshot_explode", "SRC-1", oracle=A.sql(A.EV, A.SEGMENTS, body="""
SELECT item_id, count(*) AS n, sum(end_ms - start_ms)::BIGINT AS ms, count(CASE WHEN locked THEN 1 END) AS locked FROM segments
WHERE NOT (item_id % 10 = 1) GROUP BY 1"""))
def snapshot_explode(spark: SparkSession, d: str) -> DataFrame:
    """Segments packed into one document per item and read back; some columns are broken."""
    one = F.struct(F.col("seg_id").cast("string").alias("id"), (F.col("start_ms") / 1000).alias("start"),
                   (F.col("end_ms") / 1000).alias("end"), "text", F.col("character_id").alias("characterId"), "mixed", "locked", "q")
    docs = A.segments(spark, d).groupBy("item_id").agg(F.to_json(F.sort_array(F.collect_list(one))).alias("j"))
    k = F.col("item_id") % 10
    docs = docs.select("item_id", F.when(k == 0, "{not json").when(k == 1, "{}").otherwise(F.col("j")).alias("segments"),
                       F.when(k == 0, F.concat(F.lit('{"segments": '), F.col("j"), F.lit("}"))).otherwise("{}").alias("data"))
    rows = explode_snapshots(docs)
    return rows.groupBy("item_id").agg(_count(), F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"), F.count_if("locked").alias("locked"))
