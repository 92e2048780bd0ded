"""Embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave import adapters as A
from clipweave.catalog.registry import query
from clipweave.functions import vectors as FV
from clipweave.operators import vectors as V
from clipweave.plans.identify import identify
from clipweave.plans.nearest import best_matches
from clipweave.plans.scan import number_rows

COS = "list_dot_product({a}, {b}) / ((sqrt(list_dot_product({a}, {a})) + 1e-9) * (sqrt(list_dot_product({b}, {b})) + 1e-9))"
QUERYSET = """
asked AS (SELECT vec_id, item_id, ord, label, emb FROM vectors)"""
SIMS = """
sims AS (
  SELECT a.vec_id, p.char_id, p.ord AS pord, """ + COS.format(a="a.emb", b="p.emb") + """ AS sim
  FROM asked a CROSS JOIN pool p),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, pord) AS rk FROM sims),
top2 AS (SELECT vec_id, max(CASE WHEN rk = 1 THEN char_id END) AS best, max(CASE WHEN rk = 1 THEN sim END) AS s1,
                coalesce(max(CASE WHEN rk = 2 THEN sim END), -1) AS s2 FROM ranked GROUP BY 1)"""
BASE = (A.VECTORS, A.VDIMS, A.POOL)


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return A.vectors(spark, d).withColumn("project_id", F.lit(0))


@query("cosine_top2", "EMB-1", "MAT-1", oracle=A.sql(*BASE, QUERYSET, SIMS, body="""
SELECT vec_id, best, round(s1, 5) AS best_sim, round(s2, 5) AS second_sim FROM top2"""))
def cosine_top2(spark: SparkSession, d: str) -> DataFrame:
    got = best_matches(_asked(spark, d), A.pool(spark, d), keys=["project_id"], k=2)
    m = lambda i: F.get("matches", F.lit(i))
    return got.select("vec_id", m(0)["char_id"].alias("best"), F.round(m(0)["sim"], 5).alias("best_sim"),
                      F.round(m(1)["sim"], 5).alias("second_sim"))


@query("cosine_neighbours", "EMB-1", "EMB-2", oracle=A.sql(A.VECTORS, body=f"""
SELECT a.vec_id, round({COS.format(a="a.emb", b="b.emb")}, 5) AS sim,
       round(sqrt(list_dot_product(a.emb, a.emb)) / (sqrt(list_dot_product(a.emb, a.emb)) + 1e-9), 5) AS unit_norm
FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1"""))
def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    v = A.vectors(spark, d)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("emb").alias("emb2"))
    return v.join(nxt, "vec_id").select(
        "vec_id", F.round(FV.cosine(F.col("emb"), F.col("emb2")), 5).alias("sim"),
        F.round(FV.norm(FV.unit(F.col("emb"))), 5).alias("unit_norm"),
    )


@query("vector_wire_format", "EMB-3", oracle=A.sql(A.VECTORS, body="""
SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN NULL ELSE len(emb) END AS dims,
       CASE WHEN vec_id % 10 = 0 THEN NULL ELSE round(list_sum(list_transform(emb, lambda x: x::FLOAT::DOUBLE)), 4) END AS total
FROM vectors"""))
def vector_wire_format(spark: SparkSession, d: str) -> DataFrame:
    v = A.vectors(spark, d)
    wire = v.select("vec_id", F.when(F.col("vec_id") % 10 == 0, "not base64!").otherwise(
        FV.encode_vector(F.col("emb").cast("array<float>"))).alias("raw"))
    back = wire.withColumn("v", FV.decode_vector("raw"))
    return back.select(
        "vec_id", F.when(F.col("v").isNotNull(), F.size("v")).alias("dims"),
        F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("total"),
    )


_CUES = """
win AS (SELECT *, ord // 3 AS cue FROM vectors),
wd AS (SELECT item_id, cue, ord, unnest(range(1, len(emb) + 1)) AS d, unnest(emb) AS v FROM win),
mu AS (SELECT item_id, cue, d, avg(v) AS m, count(*) AS n FROM wd GROUP BY 1, 2, 3),
muv AS (SELECT item_id, cue, any_value(n) AS n, list(m ORDER BY d) AS c FROM mu GROUP BY 1, 2),
near AS (SELECT w.item_id, w.cue, w.ord, n, row_number() OVER (PARTITION BY w.item_id, w.cue
          ORDER BY """ + COS.format(a="w.emb", b="c") + """ DESC, w.ord) AS rk
         FROM win w JOIN muv USING (item_id, cue)),
kept AS (SELECT item_id, cue, ord FROM near WHERE rk <= greatest(1, ceil(n * 0.75))),
tm AS (SELECT item_id, cue, d, avg(v) AS m FROM wd JOIN kept USING (item_id, cue, ord) GROUP BY 1, 2, 3),
cuevec AS (SELECT item_id, cue, list(m ORDER BY d) AS raw FROM tm GROUP BY 1, 2),
cueunit AS (SELECT item_id, cue, list_transform(raw, lambda x: x / (sqrt(list_dot_product(raw, raw)) + 1e-9)) AS emb FROM cuevec)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return A.vectors(spark, d).withColumn("cue", F.floor(F.col("ord") / 3))


@query("trimmed_mean", "EMB-4", "UDF-3", oracle=A.sql(A.VECTORS, _CUES, body="""
SELECT item_id, cue, round(emb[1], 5) AS e0, round(emb[10], 5) AS e9, round(list_sum(emb), 5) AS total FROM cueunit"""))
def trimmed_mean(spark: SparkSession, d: str) -> DataFrame:
    out = V.trimmed_mean(_windows(spark, d), ["item_id", "cue"], "ord")
    return out.select(
        "item_id", "cue", F.round(F.col("emb")[0], 5).alias("e0"), F.round(F.col("emb")[9], 5).alias("e9"),
        F.round(F.aggregate("emb", F.lit(0.0), lambda s, x: s + x), 5).alias("total"),
    )


_CENTRED = """
imu AS (SELECT item_id, d, avg(v) AS m, count(*) AS n FROM vdims GROUP BY 1, 2),
cms AS (SELECT vec_id, item_id, label, d, v - m AS v FROM vdims JOIN imu USING (item_id, d) WHERE n >= 3),
cmsn AS (SELECT vec_id, item_id, label, sqrt(sum(v * v)) AS nrm FROM cms GROUP BY 1, 2, 3),
centred AS (SELECT vec_id, item_id, label, d, v / (nrm + 1e-9) AS v FROM cms JOIN cmsn USING (vec_id, item_id, label))"""


@query("mean_subtract", "EMB-5", oracle=A.sql(A.VECTORS, A.VDIMS, _CENTRED, body="""
SELECT vec_id, item_id, round(max(CASE WHEN d = 1 THEN v END), 5) AS e0, round(max(CASE WHEN d = 20 THEN v END), 5) AS e19
FROM centred GROUP BY 1, 2"""))
def mean_subtract(spark: SparkSession, d: str) -> DataFrame:
    shifted, _ = V.subtract_item_mean(A.vectors(spark, d))
    return shifted.select("vec_id", "item_id", F.round(F.col("emb")[0], 5).alias("e0"),
                          F.round(F.col("emb")[19], 5).alias("e19"))


@query("centroids", "EMB-6", "UDF-3", oracle=A.sql(A.VECTORS, A.VDIMS, _CENTRED, """
raw AS (SELECT label, d, avg(v) AS m, count(*) AS n FROM vdims GROUP BY 1, 2),
rn AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM raw GROUP BY 1),
cm AS (SELECT label, d, avg(v) AS m FROM centred GROUP BY 1, 2),
cn AS (SELECT label, sqrt(sum(m * m)) AS nrm FROM cm GROUP BY 1)""", body="""
SELECT r.label, r.d - 1 AS d, r.n AS n, round(r.m / (rn.nrm + 1e-9), 5) AS raw_value, round(c.m / (cn.nrm + 1e-9), 5) AS centred_value
FROM raw r JOIN rn USING (label) JOIN cm c ON c.label = r.label AND c.d = r.d JOIN cn ON cn.label = r.label"""))
def centroids(spark: SparkSession, d: str) -> DataFrame:
    v = A.vectors(spark, d)
    shifted, _ = V.subtract_item_mean(v)
    raw = V.centroids(v, ["label"]).select("label", "n", F.posexplode("centroid").alias("d", "a"))
    cen = V.centroids(shifted, ["label"]).select("label", F.posexplode("centroid").alias("d", "b"))
    return raw.join(cen, ["label", "d"]).select(
        "label", "d", "n", F.round("a", 5).alias("raw_value"), F.round("b", 5).alias("centred_value")
    )


@query("nearest_centroid_vote", "EMB-7", "EMB-8", oracle=A.sql(*BASE, QUERYSET, SIMS, """
votes AS (SELECT a.item_id, a.ord // 3 AS cue, t.best, count(*) AS n, min(a.ord) AS f
          FROM asked a JOIN top2 t USING (vec_id) GROUP BY 1, 2, 3)""", body="""
SELECT item_id, cue, arg_max(best, struct_pack(n := n, f := -f)) AS label, max(n) AS votes FROM votes GROUP BY 1, 2"""))
def nearest_centroid_vote(spark: SparkSession, d: str) -> DataFrame:
    pool = A.pool(spark, d).select("project_id", "ord", F.col("char_id").alias("label"), F.col("emb").alias("centroid"))
    rows = _asked(spark, d).drop("label").withColumn("cue", F.floor(F.col("ord") / 3))
    named = V.nearest_label(rows, pool, ["project_id"])
    return V.majority(named, ["item_id", "cue"], "label", "ord")


@query("silhouette", "EMB-10", "UDF-3", oracle=A.sql(A.VECTORS, A.VDIMS, """
nrm AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM vdims GROUP BY 1),
u AS (SELECT vec_id, item_id % 4 AS grp, label, d, v / (n + 1e-9) AS v FROM vdims JOIN nrm USING (vec_id)),
cm AS (SELECT grp, label, d, avg(v) AS m, count(*) AS n FROM u GROUP BY 1, 2, 3),
cn AS (SELECT grp, label, sqrt(sum(m * m)) AS nr, any_value(n) AS n FROM cm GROUP BY 1, 2),
sims AS (SELECT u.grp, u.vec_id, u.label, c.label AS other, sum(u.v * c.m / (nr + 1e-9)) AS sim
         FROM u JOIN cm c ON c.grp = u.grp AND c.d = u.d JOIN cn ON cn.grp = c.grp AND cn.label = c.label GROUP BY 1, 2, 3, 4),
ab AS (SELECT s.grp, s.vec_id, cn.n, max(CASE WHEN other = s.label THEN 1 - sim END) AS a,
              min(CASE WHEN other <> s.label THEN 1 - sim END) AS b
       FROM sims s JOIN cn ON cn.grp = s.grp AND cn.label = s.label GROUP BY 1, 2, 3)""", body="""
SELECT grp, round(coalesce(avg(CASE WHEN n > 1 THEN (b - a) / greatest(a, b, 1e-9) END), -1), 5) AS silhouette FROM ab GROUP BY 1"""))
def silhouette(spark: SparkSession, d: str) -> DataFrame:
    rows = A.vectors(spark, d).withColumn("grp", F.col("item_id") % 4)
    return V.silhouette(rows, ["grp"]).select("grp", F.round("silhouette", 5).alias("silhouette"))


@query("cluster_lines", "EMB-9", "EMB-11", "EMB-12")
def cluster_lines(spark: SparkSession, d: str) -> DataFrame:
    """Clusters found per project (item % 4) and how pure they are by the hidden label."""
    rows = A.vectors(spark, d).select((F.col("item_id") % 4).alias("project_id"), F.col("vec_id").alias("ord"), "label", "emb")
    named = V.cluster_lines(rows, ["project_id"])
    return named.groupBy("project_id", "cluster").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("labels_inside"), F.min("ord").alias("first_ord")
    )


def _lines(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """One line per vector; its vote is the nearest known character."""
    pool = A.pool(spark, d)
    cents = pool.select(F.col("char_id").alias("label"), "ord", F.col("emb").alias("centroid"))
    rows = A.vectors(spark, d).drop("label")
    named = V.nearest_label(rows, cents, [])
    return named.select("item_id", "ord", (F.col("ord") * 2000).alias("start_ms"),
                        (F.col("ord") * 2000 + 1900).alias("end_ms"), "label", "emb"), cents


@query("smooth_labels", "EMB-13", oracle="WITH RECURSIVE " + ",".join([*BASE, """
sims AS (
  SELECT v.item_id, v.ord, p.char_id, p.ord AS pord, """ + COS.format(a="v.emb", b="p.emb") + """ AS sim
  FROM vectors v CROSS JOIN pool p),
pos AS (SELECT *, dense_rank() OVER (PARTITION BY item_id ORDER BY ord) AS t FROM sims),
step AS (SELECT item_id, t, any_value(ord) AS ord, list(sim ORDER BY pord) AS s FROM pos GROUP BY 1, 2),
fwd AS (
  SELECT item_id, t, ord, s AS v, NULL::BIGINT[] AS back FROM step WHERE t = 1
  UNION ALL
  SELECT n.item_id, n.t, n.ord,
    list_transform(n.s, lambda e, j: e + list_max(list_transform(f.v, lambda x, i: x - CASE WHEN i = j THEN 0.0 ELSE 0.05 END))),
    list_transform(n.s, lambda e, j: list_position(list_transform(f.v, lambda x, i: x - CASE WHEN i = j THEN 0.0 ELSE 0.05 END),
      list_max(list_transform(f.v, lambda x, i: x - CASE WHEN i = j THEN 0.0 ELSE 0.05 END)))::BIGINT)
  FROM fwd f JOIN step n ON n.item_id = f.item_id AND n.t = f.t + 1),
last AS (SELECT item_id, max(t) AS t FROM step GROUP BY 1),
path AS (
  SELECT f.item_id, f.t, f.ord, list_position(f.v, list_max(f.v))::BIGINT AS j, f.back FROM fwd f JOIN last USING (item_id, t)
  UNION ALL
  SELECT f.item_id, f.t, f.ord, p.back[p.j], f.back FROM path p JOIN fwd f ON f.item_id = p.item_id AND f.t = p.t - 1),
names AS (SELECT list(char_id ORDER BY ord) AS c FROM pool)"""]) + """
SELECT item_id, ord, c[j] AS smoothed FROM path CROSS JOIN names""")
def smooth_labels(spark: SparkSession, d: str) -> DataFrame:
    lines, cents = _lines(spark, d)
    return V.smooth_labels(lines, cents).select("item_id", "ord", "smoothed")


_RUNS = """
words AS (
  SELECT item_id, seg_id, ord, start_ms, end_ms, character_id AS label FROM segments WHERE end_ms - start_ms >= 1500),
lines AS (SELECT *, lag(label) OVER w AS pl, lead(label) OVER w AS nl FROM words
          WINDOW w AS (PARTITION BY item_id ORDER BY ord)),
runs AS (SELECT item_id, ord, unnest([1, 2, 3]) AS part,
                unnest([start_ms, start_ms + 1200, end_ms - 200]) AS s, unnest([start_ms + 1200, end_ms - 200, end_ms]) AS e,
                unnest([coalesce(pl, 'zz'), label, coalesce(nl, 'zz')]) AS label FROM lines)"""


@query("mixed_lines", "EMB-14", "WIN-5", oracle=A.sql(A.EV, A.SEGMENTS, _RUNS, """
j AS (SELECT r.*, l.pl, l.nl, l.label AS own, l.start_ms, l.end_ms FROM runs r JOIN lines l USING (item_id, ord)),
b AS (SELECT *, sum((label IS DISTINCT FROM pl)::INT) OVER (PARTITION BY item_id, ord ORDER BY part) AS bp,
                sum((label IS DISTINCT FROM nl)::INT) OVER (PARTITION BY item_id, ord ORDER BY part DESC) AS bn FROM j),
m AS (SELECT item_id, ord, any_value(pl) AS pl, any_value(nl) AS nl, any_value(greatest(1, end_ms - start_ms)) AS len,
             sum(CASE WHEN bp = 0 AND pl <> own THEN e - s END) AS pre, sum(CASE WHEN bn = 0 AND nl <> own THEN e - s END) AS post
      FROM b GROUP BY 1, 2),
q AS (SELECT *, CASE WHEN pre >= 1000 AND pre::DOUBLE / len >= 0.30 THEN pre END AS p, CASE WHEN post >= 1000 AND post::DOUBLE / len >= 0.30 THEN post END AS n FROM m)""",
    body="""
SELECT item_id, ord, CASE WHEN p IS NOT NULL AND (n IS NULL OR p >= n) THEN 'pre' WHEN n IS NOT NULL THEN 'post' END AS side,
       CASE WHEN p IS NOT NULL AND (n IS NULL OR p >= n) THEN pl WHEN n IS NOT NULL THEN nl END AS other_label,
       CAST(CASE WHEN p IS NOT NULL AND (n IS NULL OR p >= n) THEN p WHEN n IS NOT NULL THEN n END AS BIGINT) AS other_ms FROM q"""))
def mixed_lines(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.plans.scan import neighbour, prefix_scan

    lines = A.segments(spark, d).filter("end_ms - start_ms >= 1500").select(
        "item_id", "ord", "start_ms", "end_ms", F.col("character_id").alias("label")
    )
    near = prefix_scan(lines, ["item_id"], ["ord"], pl=neighbour(F.col("label")))
    near = prefix_scan(near, ["item_id"], ["ord"], reverse=True, nl=neighbour(F.col("label")))
    run = lambda i, a, b, lb: F.struct(F.lit(i).alias("part"), a.alias("start_ms"), b.alias("end_ms"), lb.alias("label"))
    s, e = F.col("start_ms"), F.col("end_ms")
    runs = near.select("item_id", "ord", F.inline(F.array(
        run(1, s, s + 1200, F.coalesce("pl", F.lit("zz"))), run(2, s + 1200, e - 200, F.col("label")),
        run(3, e - 200, e, F.coalesce("nl", F.lit("zz"))))))
    return V.mixed_lines(lines, runs).select("item_id", "ord", "side", "other_label", "other_ms")


def _cues(windows: DataFrame) -> DataFrame:
    return windows.groupBy("project_id", "item_id", "ord").agg(F.min("ws").alias("start_ms"), F.max("we").alias("end_ms"))


def _speech_windows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Three windows per cue, from the given vectors; four projects of items."""
    w = _windows(spark, d)
    start = F.col("cue") * 3000
    windows = w.select(
        (F.col("item_id") % 4).alias("project_id"), "item_id", F.col("cue").alias("ord"),
        (start + F.col("ord") % 3 * 500).alias("ws"), (start + F.col("ord") % 3 * 500 + 1400).alias("we"), "emb",
    )
    return _cues(windows), windows


@query("identify_speakers", "EMB-15", "WIN-1", "AGG-3")
def identify_speakers(spark: SparkSession, d: str) -> DataFrame:
    got = identify(*_speech_windows(spark, d))
    return got.lines.groupBy("project_id", "item_id").agg(
        F.count(F.lit(1)).alias("total"), F.count("label").alias("labelled"),
        F.count_if("mixed").alias("mixed"), F.countDistinct("label").alias("speakers"),
    )


@query("identify_turns", "EMB-15", "INT-21")
def identify_turns(spark: SparkSession, d: str) -> DataFrame:
    return identify(*_speech_windows(spark, d)).turns


def _planted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cues of one voice each: three vectors of an item and label in a row; four projects reuse item ids."""
    v = A.vectors(spark, d)
    v = number_rows(v, ["item_id", "label"], ["ord"], "k").withColumn("k", F.col("k") - 1)
    start = (F.floor(F.col("k") / 3) * 10 + F.col("label")) * 3000
    windows = v.select(
        (F.col("item_id") % 4).alias("project_id"), F.floor(F.col("item_id") / 4).alias("item_id"),
        (F.floor(F.col("k") / 3) * 10 + F.col("label")).alias("ord"), (start + F.col("k") % 3 * 500).alias("ws"),
        (start + F.col("k") % 3 * 500 + 1400).alias("we"), "emb", "label",
    )
    return _cues(windows), windows.drop("label"), windows


_PLANTED = ["""
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, label ORDER BY ord) - 1 AS k FROM vectors),
win AS (SELECT item_id % 4 AS project_id, item_id // 4 AS item_id, (k // 3) * 10 + label AS ord, ((k // 3) * 10 + label) * 3000 + (k % 3) * 500 AS ws, label FROM k),
cue AS (SELECT project_id, item_id, ord, any_value(label) AS voice, min(ws) AS start_ms, max(ws) + 1400 AS end_ms FROM win GROUP BY 1, 2, 3),
first AS (SELECT project_id, voice, row_number() OVER (PARTITION BY project_id ORDER BY min(struct_pack(i := item_id, s := start_ms))) AS n FROM cue GROUP BY 1, 2)"""]


@query("identify_planted", "EMB-15", "AGG-3", "WIN-1", "INT-21", oracle=A.sql(A.VECTORS, *_PLANTED, body="""
SELECT project_id, item_id, start_ms::BIGINT AS start_ms, end_ms::BIGINT AS end_ms, 'speaker' || n AS label FROM cue JOIN first USING (project_id, voice)"""))
def identify_planted(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the joint identification where every cue has one planted voice: labels by first appearance in the project."""
    cues, windows, _ = _planted(spark, d)
    return identify(cues, windows).turns


@query("cluster_planted", "EMB-9", "EMB-11", "EMB-12", oracle=A.sql(A.VECTORS, body="""
SELECT item_id % 4 AS project_id, vec_id AS ord,
  (dense_rank() OVER (PARTITION BY item_id % 4 ORDER BY min_id) - 1)::INTEGER AS cluster
FROM (SELECT *, min(vec_id) OVER (PARTITION BY item_id % 4, label) AS min_id FROM vectors)"""))
def cluster_planted(spark: SparkSession, d: str) -> DataFrame:
    """Every line's cluster: the planted voices of a project, numbered by first appearance."""
    rows = A.vectors(spark, d).select((F.col("item_id") % 4).alias("project_id"), F.col("vec_id").alias("ord"), "emb")
    return V.cluster_lines(rows, ["project_id"]).select("project_id", "ord", "cluster")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """Per item (as project) and label: the label's mean vector of the queries."""
    made = V.centroids(A.vectors(spark, d), ["item_id", "label"])
    return made.select(
        F.col("item_id").alias("project_id"), F.col("label").alias("ord"),
        F.concat(F.lit("speaker"), F.col("label").cast("string")).alias("label"),
        F.concat_ws(":", F.col("item_id").cast("string"), F.concat(F.lit("speaker"), F.col("label").cast("string"))).alias("label_key"),
        F.col("centroid").alias("emb"),
    )


def _pools(spark: SparkSession, d: str) -> DataFrame:
    """Every project knows the even characters; character 4 owns the key of speaker 5."""
    projects = A.vectors(spark, d).select(F.col("item_id").alias("project_id")).distinct()
    known = A.pool(spark, d).filter("ord % 2 = 0").drop("project_id")
    rows = known.agg(F.collect_list(F.struct(*known.columns))).scalar()  # five rows: the even labels of ten
    key = F.concat_ws(":", F.col("project_id").cast("string"), F.lit("speaker5"))
    return projects.withColumn("_all", rows).select("project_id", F.inline("_all")).withColumn(
        "labels", F.when(F.col("ord") == 4, F.array(key)).otherwise(F.array().cast("array<string>"))
    )


def _in_order(mode: str, threshold: float, asked: str) -> list[str]:
    """Matching in order as recursive SQL: the state is the list of a project's characters.

    ``asked`` makes ``seq`` (project_id, t, x, key): the vector that is matched at step t.
    """
    hit = f"s1 >= {threshold}" if mode == "weak" else f"s1 >= {threshold} AND s1 - s2 >= 0.05"
    had = "c.n" if mode == "gap" else "(CASE WHEN c.n = 0 THEN 1 ELSE c.n END)"
    keys = "c.keys" if mode == "gap" else "list_distinct(list_append(c.keys, key))"
    owner = "list_position(list_transform(known, lambda c: list_contains(c.keys, key)), true)" if mode == "weak" else "NULL::INTEGER"
    new = "WHEN how = 'new' THEN list_append(known, {'id': 'char_' || key, 'keys': [key], 'v': x, 'n': 1})" if mode == "weak" else ""
    return [*BASE, """
lmean AS (SELECT item_id, label, d, avg(v) AS m FROM vdims GROUP BY 1, 2, 3),
lvec AS (SELECT item_id, label, list(m ORDER BY d) AS m FROM lmean GROUP BY 1, 2),
lunit AS (SELECT item_id, label, list_transform(m, lambda z: z / (sqrt(list_dot_product(m, m)) + 1e-9)) AS x FROM lvec),
projects AS (SELECT DISTINCT item_id AS project_id FROM vectors),
start AS (SELECT project_id, list({'id': char_id, 'keys': CASE WHEN ord = 4 THEN [project_id || ':speaker5'] ELSE []::VARCHAR[] END,
            'v': emb, 'n': emb_count::INTEGER} ORDER BY ord) AS known FROM projects, pool WHERE ord % 2 = 0 GROUP BY 1)""", asked, f"""
walk AS (
  SELECT project_id, 0::BIGINT AS t, known, NULL::VARCHAR AS char_id, NULL::VARCHAR AS how, NULL::DOUBLE AS sim FROM start
  UNION ALL
  SELECT project_id, t, CASE {new} WHEN target IS NULL THEN known ELSE list_transform(known, lambda c, i: CASE WHEN i = target THEN
           {{'id': c.id, 'keys': {keys}, 'v': list_transform(c.v, lambda z, j: (z * {had} + x[j]) / ({had} + 1)), 'n': ({had} + 1)::INTEGER}} ELSE c END) END,
         CASE WHEN how = 'new' THEN 'char_' || key ELSE known[target].id END, how, s1
  FROM (SELECT *, CASE WHEN owner IS NOT NULL THEN owner WHEN {hit} THEN first END AS target,
               CASE WHEN owner IS NOT NULL THEN 'key' WHEN {hit} THEN 'match' ELSE '{"new" if mode == "weak" else "none"}' END AS how
        FROM (SELECT *, list_max(sims) AS s1, list_position(sims, list_max(sims)) AS first, {owner} AS owner,
                     coalesce(list_max(list_filter(sims, lambda z, i: i <> list_position(sims, list_max(sims)))), -1) AS s2
              FROM (SELECT w.project_id, q.t, q.x, q.key, w.known, list_transform(w.known, lambda c: {COS.format(a="q.x", b="c.v")}) AS sims
                    FROM walk w JOIN seq q ON q.project_id = w.project_id AND q.t = w.t + 1))))"""]


_SEQ = """
seq AS (SELECT item_id AS project_id, row_number() OVER (PARTITION BY item_id ORDER BY label) AS t, label, x,
               item_id || ':speaker' || label AS key FROM lunit)"""
_STEPS = """
SELECT w.project_id::VARCHAR AS project_id, label::BIGINT AS ord, 'speaker' || label AS label, char_id, how, round(sim, 4) AS sim
FROM walk w JOIN seq USING (project_id, t)"""


@query("pool_match_strong", "MAT-1", oracle="WITH RECURSIVE " + ",".join(_in_order("strong", 0.80, _SEQ)) + _STEPS)
def pool_match_strong(spark: SparkSession, d: str) -> DataFrame:
    out = V.match_in_order(_labels(spark, d), _pools(spark, d), mode="strong")
    return out.filter("how <> 'pool'").select("project_id", "ord", "label", "char_id", "how", F.round("sim", 4).alias("sim"))


@query("pool_match_weak", "MAT-2", oracle="WITH RECURSIVE " + ",".join(_in_order("weak", 0.82, _SEQ)) + _STEPS)
def pool_match_weak(spark: SparkSession, d: str) -> DataFrame:
    out = V.match_in_order(_labels(spark, d), _pools(spark, d), mode="weak", threshold=0.82)
    return out.filter("how <> 'pool'").select("project_id", "ord", "label", "char_id", "how", F.round("sim", 4).alias("sim"))


_FROZEN = """
lmean AS (SELECT item_id, label, d, avg(v) AS m FROM vdims GROUP BY 1, 2, 3),
lvec AS (SELECT item_id, label, list(m ORDER BY d) AS emb FROM lmean GROUP BY 1, 2),
fs AS (SELECT l.item_id AS project_id, l.label, p.char_id, """ + COS.format(a="l.emb", b="p.emb") + """ AS sim,
              p.ord AS pord FROM lvec l CROSS JOIN pool p WHERE p.ord % 2 = 0),
fr AS (SELECT *, row_number() OVER (PARTITION BY project_id, label ORDER BY sim DESC, pord) AS rk FROM fs)"""


@query("pool_match_frozen", "MAT-1", oracle=A.sql(*BASE, _FROZEN, body="""
SELECT project_id, 'speaker' || label AS label,
  CASE WHEN max(CASE WHEN rk = 1 THEN sim END) >= 0.80 AND max(CASE WHEN rk = 1 THEN sim END) - max(CASE WHEN rk = 2 THEN sim END) >= 0.05
       THEN max(CASE WHEN rk = 1 THEN char_id END) END AS char_id,
  round(max(CASE WHEN rk = 1 THEN sim END), 4) AS sim FROM fr GROUP BY 1, 2"""))
def pool_match_frozen(spark: SparkSession, d: str) -> DataFrame:
    out = V.match_frozen(_labels(spark, d), _pools(spark, d), ["project_id"])
    return out.select("project_id", "label", "char_id", F.round("sim", 4).alias("sim"))


@query("absorb_mean", "MAT-3", oracle=A.sql(*BASE, """
smp AS (SELECT label, d, avg(v) AS m, count(*) AS k FROM vdims GROUP BY 1, 2),
pd AS (SELECT ord AS label, char_id, emb_count, unnest(range(1, len(emb) + 1)) AS d, unnest(emb) AS o FROM pool)""", body="""
SELECT char_id, d - 1 AS d, (emb_count + coalesce(k, 0))::INT AS emb_count,
       round(CASE WHEN k IS NULL THEN o ELSE (o * emb_count + m * k) / (emb_count + k) END, 5) AS value
FROM pd LEFT JOIN smp USING (label, d)"""))
def absorb_mean(spark: SparkSession, d: str) -> DataFrame:
    samples = _asked(spark, d).withColumn("char_id", F.concat(F.lit("c"), F.col("label").cast("string")))
    out = V.absorb_samples(A.pool(spark, d), samples, ["project_id"])
    return out.select("char_id", F.posexplode("emb").alias("d", "v"), "emb_count").select(
        "char_id", "d", "emb_count", F.round("v", 5).alias("value")
    )


_SEGV = """
segv AS (SELECT vec_id, emb, CASE WHEN vec_id % 4 = 1 THEN 'c' || label WHEN vec_id % 4 = 2 THEN 'c' || ((label + 3) % 10)
                WHEN vec_id % 4 = 3 THEN 'gone' END AS cur, vec_id % 9 = 0 AS locked, vec_id % 10 = 7 AS mixed FROM asked),
cs AS (SELECT s.vec_id, max(sim) AS cur_sim FROM segv s JOIN sims m ON m.vec_id = s.vec_id AND m.char_id = s.cur GROUP BY 1)"""
_RESCAN = """
SELECT vec_id, CASE WHEN locked OR mixed THEN 'skipped'
    WHEN cur IS NULL AND s1 >= 0.80 AND s1 - s2 >= 0.05 THEN 'bound'
    WHEN cur IS NOT NULL AND cur <> best AND s1 >= 0.80 AND s1 - coalesce(cur_sim, -1) >= 0.08 THEN 'moved' ELSE 'kept' END AS outcome,
  CASE WHEN locked OR mixed THEN cur WHEN cur IS NULL AND s1 >= 0.80 AND s1 - s2 >= 0.05 THEN best
    WHEN cur IS NOT NULL AND cur <> best AND s1 >= 0.80 AND s1 - coalesce(cur_sim, -1) >= 0.08 THEN best ELSE cur END AS new_character
FROM segv JOIN top2 USING (vec_id) LEFT JOIN cs USING (vec_id)"""


def _voiced_segments(spark: SparkSession, d: str) -> DataFrame:
    c = lambda e: F.concat(F.lit("c"), e.cast("string"))
    k = F.col("vec_id") % 4
    return _asked(spark, d).select(
        "project_id", "vec_id", "item_id", F.col("vec_id").alias("seg_id"), "emb",
        F.when(k == 1, c(F.col("label"))).when(k == 2, c((F.col("label") + 3) % 10)).when(k == 3, "gone").alias("character_id"),
        (F.col("vec_id") % 9 == 0).alias("locked"), (F.col("vec_id") % 10 == 7).alias("mixed"),
    )


@query("rescan_assign", "MAT-4", oracle=A.sql(*BASE, QUERYSET, SIMS, _SEGV, body=_RESCAN))
def rescan_assign(spark: SparkSession, d: str) -> DataFrame:
    out = V.rescan(_voiced_segments(spark, d), A.pool(spark, d), ["project_id"])
    return out.select("vec_id", "outcome", "new_character")


@query("rescan_counters", "MAT-4", oracle=A.sql(*BASE, QUERYSET, SIMS, _SEGV, f"r AS ({_RESCAN})", body="""
SELECT outcome, count(*) AS n FROM r GROUP BY 1"""))
def rescan_counters(spark: SparkSession, d: str) -> DataFrame:
    return rescan_assign(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_FEEDBACK = """
segv AS (SELECT vec_id, emb, CASE WHEN vec_id % 4 = 1 THEN 'c' || label WHEN vec_id % 4 = 2 THEN 'c' || ((label + 3) % 10)
                WHEN vec_id % 4 = 3 THEN 'gone' END AS cur, vec_id % 9 = 0 AS locked, vec_id % 10 = 7 AS mixed FROM asked),
smp AS (SELECT cur AS char_id, d, avg(v) AS m, count(*) AS k FROM segv JOIN vdims USING (vec_id) WHERE locked AND cur IS NOT NULL GROUP BY 1, 2),
pdim AS (SELECT ord, char_id, emb_count, unnest(range(1, len(emb) + 1)) AS d, unnest(emb) AS o FROM pool),
npool AS (SELECT ord, char_id, list(CASE WHEN k IS NULL THEN o ELSE (o * emb_count + m * k) / (emb_count + k) END ORDER BY d) AS emb
          FROM pdim LEFT JOIN smp USING (char_id, d) GROUP BY 1, 2),
sims AS (SELECT a.vec_id, a.cur, p.char_id, p.ord AS pord, """ + COS.format(a="a.emb", b="p.emb") + """ AS sim FROM segv a CROSS JOIN npool p),
rk AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, pord) AS rk FROM sims),
t2 AS (SELECT vec_id, max(CASE WHEN rk = 1 THEN char_id END) AS best, max(CASE WHEN rk = 1 THEN sim END) AS s1,
              max(CASE WHEN rk = 2 THEN sim END) AS s2, coalesce(max(CASE WHEN char_id = cur THEN sim END), -1) AS sc FROM rk GROUP BY 1)"""


@query("feedback_job", "MAT-5", "UPD-9", oracle=A.sql(*BASE, QUERYSET, _FEEDBACK, body="""
SELECT CASE WHEN locked OR mixed THEN 'skipped' WHEN cur IS NULL AND s1 >= 0.80 AND s1 - s2 >= 0.05 THEN 'bound'
    WHEN cur IS NOT NULL AND cur <> best AND s1 >= 0.80 AND s1 - sc >= 0.08 THEN 'moved' ELSE 'kept' END AS outcome, count(*) AS n
FROM segv JOIN t2 USING (vec_id) WHERE NOT (locked AND cur IS NOT NULL) GROUP BY 1"""))
def feedback_job(spark: SparkSession, d: str) -> DataFrame:
    seg = _voiced_segments(spark, d)
    samples = seg.filter("locked AND character_id IS NOT NULL").select("project_id", "item_id", "seg_id", "character_id", "emb")
    out, _ = V.feedback(seg, A.pool(spark, d), samples, ["project_id"])
    return out.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


_GAPCAND = """
inside AS (
  SELECT i.item_id % 8 AS project_id, g.item_id, greatest(g.start_ms, s.start_ms) AS start_ms, least(g.end_ms, s.end_ms) AS end_ms
  FROM gaps g JOIN speech s ON s.item_id = g.item_id JOIN items i ON i.item_id = g.item_id
  WHERE g.end_ms - g.start_ms >= 250 AND least(g.end_ms, s.end_ms) - greatest(g.start_ms, s.start_ms) BETWEEN 600 AND 15000),
numbered AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY item_id, start_ms, end_ms) AS ord FROM inside)"""


@query("gap_scan_candidates", "MAT-6", oracle=A.sql(
    A.EV, A.ITEMS, A.SEGMENTS, A.SPEECH, A.SPARSE,
    __import__("clipweave.catalog.timelines", fromlist=["_GAPS"])._GAPS.format(src="sparse"), _GAPCAND, body="""
SELECT project_id, ord, item_id, start_ms, end_ms FROM numbered"""))
def gap_scan_candidates(spark: SparkSession, d: str) -> DataFrame:
    from clipweave.plans.gapscan import gap_candidates

    sparse = A.sparse_segments(spark, d)
    items = A.items(spark, d).withColumn("project_id", F.col("item_id") % 8).withColumn("created", F.col("item_id"))
    return gap_candidates(sparse, items, A.speech(spark, d).drop("ord")).select(
        "project_id", "ord", "item_id", "start_ms", "end_ms"
    )


def gap_vectors(cands: DataFrame, vectors: DataFrame) -> DataFrame:
    """Every candidate with a vector from anywhere in the table, chosen by its place."""
    from clipweave.plans.scan import number_all

    held = number_all(vectors.select("vec_id", "emb"), ["vec_id"], "_k").drop("vec_id")
    total = vectors.count()
    at = 1 + F.pmod(F.col("item_id") * 7919 + F.floor(F.col("start_ms") / 100) * 7, F.lit(max(total, 1)))
    return cands.withColumn("_k", at).join(held, "_k", "left").drop("_k")


_GAPSEQ = """
held AS (SELECT row_number() OVER (ORDER BY vec_id) AS k, emb FROM vectors),
placed AS (SELECT *, 1 + (item_id * 7919 + (start_ms // 100) * 7) % (SELECT count(*) FROM vectors) AS k FROM numbered),
seq AS (SELECT project_id, ord AS t, emb AS x, '' AS key FROM placed JOIN held USING (k))"""


@query("gap_scan", "MAT-6", oracle="WITH RECURSIVE " + ",".join([
    A.EV, A.ITEMS, A.SEGMENTS, A.SPEECH, A.SPARSE,
    __import__("clipweave.catalog.timelines", fromlist=["_GAPS"])._GAPS.format(src="sparse"), _GAPCAND,
    *_in_order("gap", 0.80, _GAPSEQ)]) + """
SELECT n.project_id::VARCHAR AS project_id, n.item_id, n.start_ms, n.end_ms, w.char_id AS character_id, 'gapscan' AS origin
FROM numbered n LEFT JOIN walk w ON w.project_id = n.project_id AND w.t = n.ord""")
def gap_scan(spark: SparkSession, d: str) -> DataFrame:
    """Uncovered speech of each item, matched in order."""
    from clipweave.plans.gapscan import gap_candidates

    sparse = A.sparse_segments(spark, d)
    speech = A.speech(spark, d).drop("ord")
    cands = gap_candidates(sparse, A.items(spark, d).withColumn("project_id", F.col("item_id") % 8)
                           .withColumn("created", F.col("item_id")), speech)
    voiced = gap_vectors(cands, A.vectors(spark, d))
    labelled = voiced.withColumn("label", F.lit("")).withColumn("label_key", F.lit(""))
    out = V.match_in_order(labelled, _pools(spark, d).filter("project_id < 8"), mode="gap").filter("how <> 'pool'")
    back = voiced.withColumn("project_id", F.col("project_id").cast("string")).drop("emb")
    return back.join(out.select("project_id", "ord", "char_id"), ["project_id", "ord"], "left").select(
        "project_id", "item_id", "start_ms", "end_ms", F.col("char_id").alias("character_id"), F.lit("gapscan").alias("origin")
    )


@query("characters_by_key", "MAT-7", oracle=A.sql(A.EV, """
keys AS (SELECT DISTINCT item_id || ':' || event_type AS label_key FROM ev),
owners AS (SELECT item_id || ':' || 'view' AS label_key, arg_min('c' || event_id, event_id) AS owner FROM ev
           WHERE event_type = 'view' GROUP BY 1)""", body="""
SELECT label_key, coalesce(owner, 'char_' || label_key) AS char_id, owner IS NULL AS created FROM keys LEFT JOIN owners USING (label_key)"""))
def characters_by_key(spark: SparkSession, d: str) -> DataFrame:
    ev = A.events(spark, d)
    key = F.concat_ws(":", F.col("item_id").cast("string"), F.col("event_type"))
    seen = ev.select(key.alias("label_key")).distinct()
    pool = ev.filter("event_type = 'view'").select(
        F.col("event_id").alias("ord"), F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("char_id"),
        F.array(key).alias("labels"),
    )
    return V.characters_by_key(seen, pool)
