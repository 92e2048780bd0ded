"""Embedding tables: means, centroids, clustering, smoothing and pool matching."""

from __future__ import annotations

import gc
import json
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipweave.functions.vectors import EPS, cosine, minus, unit
from clipweave.plans.fold import _fresh, ordered_fold
from clipweave.plans.frames import plain_strings
from clipweave.plans.nearest import GROUP_ROWS, POOL_VALUES, TILE, best_matches
from clipweave.plans.scan import neighbour, number_rows, prefix_scan, running_sum
from clipweave.session import saved, setting

#: clusters of a group that one task joins to the end; more are joined in rounds first, with the same result
EXACT_LINES = 4096
#: clusters, and numbers in their vectors (32 MB), on one side of a tile; a group that fits is joined in one task
TILE_ROWS, TILE_VALUES = 65_536, 4_194_304
#: decimal places of a similarity; what is equal to that place is a tie, on every route
DIGITS = 12
#: heights where the tree is cut: by silhouette, and where none decides with too few or too many clusters
CUTS = [float(t) for t in np.arange(0.04, 0.94, 0.02)]
LADDER = (0.50, 0.45, 0.40, 0.35, 0.30, 0.25, 0.20, 0.15, 0.10, 0.05)
WIDER = (0.65, 0.70, 0.75, 0.80, 0.85, 0.90)


def vector_mean(col: str | Column) -> Column:
    """Mean vector as an aggregate; partial sums are combined before the shuffle."""
    c = F.col(col) if isinstance(col, str) else col
    return vector_to_array(Summarizer.mean(array_to_vector(c.cast("array<double>"))))


def centroids(rows: DataFrame, keys: list[str], emb: str = "emb", *, normalise: bool = True) -> DataFrame:
    """Mean vector per group (unit length if asked) and the group size ``n``."""
    made = rows.filter(F.col(emb).isNotNull()).groupBy(*keys).agg(
        vector_mean(emb).alias("centroid"), F.count(F.lit(1)).alias("n")
    )
    return made.withColumn("centroid", unit(F.col("centroid"))) if normalise else made


def trimmed_mean(windows: DataFrame, keys: list[str], order: str, emb: str = "emb",
                 keep: float = 0.75) -> DataFrame:
    """Mean of the vectors closest to the group's direction, as a unit vector.

    The best ``ceil(keep * n)`` rows by cosine to the mean are averaged unscaled.
    """
    valid = windows.filter(F.col(emb).isNotNull())
    mean = valid.groupBy(*keys).agg(vector_mean(emb).alias("_c"), F.count(F.lit(1)).alias("_n"))
    near = valid.join(mean, keys).withColumn(
        "_far", -F.aggregate(F.zip_with(unit(F.col(emb)), unit(F.col("_c")), lambda a, b: a * b),
                             F.lit(0.0), lambda s, v: s + v)
    )
    ranked = number_rows(near, keys, ["_far", order], "_rk")
    kept = ranked.filter(F.col("_rk") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * keep)))
    return kept.groupBy(*keys).agg(
        unit(vector_mean(emb)).alias("emb"), F.first("_n").alias("n"), F.count(F.lit(1)).alias("kept")
    )


def subtract_item_mean(cues: DataFrame, windows: DataFrame | None = None, min_cues: int = 3, *,
                       item: tuple[str, ...] = ("item_id",)) -> tuple[DataFrame, DataFrame | None]:
    """Remove each item's mean cue vector where it has at least ``min_cues`` of them.

    Cue vectors are scaled to unit length afterwards, window vectors are not.
    """
    mean = (
        cues.filter(F.col("emb").isNotNull()).groupBy(*item)
        .agg(vector_mean("emb").alias("_mu"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") >= min_cues).drop("_n")
    )
    shifted = cues.join(mean, list(item), "left").withColumn(
        "emb", F.when(F.col("_mu").isNull(), F.col("emb")).otherwise(unit(minus(F.col("emb"), F.col("_mu"))))
    ).drop("_mu")
    if windows is None:
        return shifted, None
    moved = windows.join(mean, list(item), "left").withColumn(
        "emb", F.when(F.col("_mu").isNull(), F.col("emb")).otherwise(minus(F.col("emb"), F.col("_mu")))
    ).drop("_mu")
    return shifted, moved


def nearest_label(rows: DataFrame, cents: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``label`` of the closest centroid; ``cents`` has keys, label, centroid."""
    pool = cents.select(*keys, F.col("label").alias("char_id"), F.col("centroid").alias("emb"), "ord")
    got = best_matches(rows, pool, keys=keys, k=1)
    return got.withColumn("label", F.get("matches", F.lit(0))["char_id"]).drop("matches")


def majority(rows: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """Most frequent label per group; the one seen first wins ties."""
    votes = rows.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("_first"))
    return votes.groupBy(*keys).agg(
        F.max_by(label, F.struct(F.col("votes"), -F.col("_first"))).alias(label),
        F.max("votes").alias("votes"),
    )


def silhouette(rows: DataFrame, keys: list[str], label: str = "label", emb: str = "emb") -> DataFrame:
    """Centroid silhouette per group: mean of (b - a) / max(a, b), -1 without any."""
    lab = F.col(label).cast("string")
    x = rows.withColumn("_lab", lab).withColumn("_u", unit(F.col(emb).cast("array<double>")))
    cents = centroids(x, [*keys, "_lab"], "_u")
    pool = cents.select(*keys, F.col("_lab").alias("char_id"), F.col("centroid").alias("emb"),
                        F.col("_lab").alias("ord"))
    got = best_matches(x.select(*keys, "_lab", "_u"), pool, keys=keys, k=2, emb="_u", current="_lab")
    got = got.join(cents.select(*keys, "_lab", "n"), [*keys, "_lab"])
    first, second = F.get("matches", F.lit(0)), F.get("matches", F.lit(1))
    other = F.when(first["char_id"] == F.col("_lab"), second["sim"]).otherwise(first["sim"])
    a, b = 1 - F.col("current_sim"), 1 - other
    score = F.when((F.col("n") > 1) & other.isNotNull(), (b - a) / F.greatest(a, b, F.lit(EPS)))
    return got.groupBy(*keys).agg(F.coalesce(F.avg(score), F.lit(-1.0)).alias("silhouette"))


# --- clustering -------------------------------------------------------------

def cluster_lines(rows: DataFrame, keys: list[str], *, exact_lines: int = EXACT_LINES, max_k: int = 15,
                  min_k: int = 3, threshold: float = 0.60, merge: float = 0.95) -> DataFrame:
    """Adds ``cluster`` (numbered by first appearance in ``ord``) per group of ``keys``.

    Average linkage on cosine distance over all lines of a group, cut where the centroid
    silhouette is best. Clusters are (sum, count) rows: average linkage needs nothing else.
    Equal vectors start as one cluster. While a group has more than ``exact_lines`` clusters,
    all mutual nearest pairs merge in rounds of joins; average linkage is reducible, so this
    gives the same tree as one merge at a time. Once they fit a tile, one task goes on with them
    in memory. All ways call two distances equal that agree to ``DIGITS`` places and prefer the
    cluster seen first.
    """
    x = rows.filter(F.col("emb").isNotNull()).select(*keys, "ord", unit(F.col("emb").cast("array<double>")).alias("emb"))
    x = x.withColumn("_same", F.sha2(F.transform("emb", lambda v: v + F.lit(0.0)).cast("string"), 256))  # -0.0 is 0.0
    same = saved(x.groupBy(*keys, "_same").agg(
        F.first("emb").alias("emb"), F.min("ord").alias("_unit"), F.count(F.lit(1)).cast("double").alias("n")
    ))
    n = F.col("n")
    units = same.select(*keys, F.col("_unit").alias("ord"), F.transform("emb", lambda v: v * n).alias("s"), "n")
    large = saved(units.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m")).filter(F.col("_m") > exact_lines).drop("_m"))
    few = F.broadcast(large)  # a row per ``exact_lines`` units at most
    schema = T.StructType([
        *[units.schema[c] for c in keys],
        T.StructField("_unit", units.schema["ord"].dataType), T.StructField("cluster", T.IntegerType()),
    ])

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        out = part[[*keys, "ord"]].rename(columns={"ord": "_unit"})
        sums = np.stack(part["s"].to_list())
        out["cluster"] = choose_clusters(sums, part["n"].to_numpy(float), max_k, min_k, threshold, merge)
        return plain_strings(out)

    solved = units.join(few, keys, "left_anti").groupBy(*keys).applyInPandas(solve, schema)
    if large.limit(1).count():
        big = units.join(few, keys, "left_semi")
        solved = solved.unionByName(_cluster_large(big, keys, exact_lines, max_k, min_k, threshold, merge))
    # lines find their unit by its digest, so that vectors are shuffled once to find equal ones
    named = same.select(*keys, "_same", "_unit").join(solved, [*keys, "_unit"]).select(*keys, "_same", "cluster")
    named = x.select(*keys, "ord", "_same").join(named, [*keys, "_same"]).select(*keys, "ord", "cluster")
    return rows.join(named, [*keys, "ord"], "left")


def vector_sum(col: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(col))))


def _nearest(means: np.ndarray, pool: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row of ``pool`` with the highest product, and that product; the first one among equals.

    ``own`` names the row that is the searching one itself, or is negative.
    """
    step, found = max(1, TILE // max(1, len(pool))), []
    for at in range(0, len(means), step):
        sims, self_at = means[at : at + step] @ pool.T, own[at : at + step]
        rows = np.arange(len(sims))
        sims[rows[self_at >= 0], self_at[self_at >= 0]] = -np.inf
        top = sims.max(axis=1)
        first = (sims >= (top - 1.01 * 10.0**-DIGITS)[:, None]).argmax(axis=1)
        best = np.round(top, DIGITS)
        off = np.flatnonzero(np.round(sims[rows, first], DIGITS) != best)  # close, but not a tie
        first[off] = np.round(sims[off], DIGITS).argmax(axis=1)
        found.append((first, best))
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, int), np.zeros(0))


def _tile_rows(spark: SparkSession) -> Column:
    """Clusters of a group on one side of a tile, as an aggregate of their ``s``."""
    wide = F.greatest(F.lit(1), F.floor(F.lit(TILE_VALUES) / F.greatest(F.lit(1), F.max(F.size("s")))))
    forced = spark.conf.get("clipweave.poolBlock", None)
    return F.lit(int(forced)) if forced else F.least(F.lit(TILE_ROWS), wide)


def nearest_in_tiles(search: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, parent, sim): the nearest other cluster of each searching one; the smaller ``ord`` wins ties.

    Searching rows and clusters of a group are dealt to blocks by a hash, and every block of the
    one meets every block of the other in a task of its own; only winners leave the tiles. Blocks
    are as large as a task can hold, since every row is copied once per block of the other side.
    """
    size = _tile_rows(search.sparkSession)
    blocks = lambda rows, name: rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    counts = F.broadcast(blocks(search, "_p").join(blocks(clusters, "_q"), keys))  # a row per large group
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    own = lambda name: F.pmod(F.xxhash64("ord"), F.col(name))
    spot, columns = [*keys, "_i", "_j"], [*keys, "ord", "s", "n"]
    left = search.select(*columns).join(counts, keys).withColumn("_i", own("_p")).withColumn("_j", every("_q"))
    right = clusters.select(*columns).join(counts, keys).withColumn("_j", own("_q")).withColumn("_i", every("_p"))
    kind = search.schema["ord"].dataType
    schema = T.StructType([
        *[search.schema[c] for c in keys], T.StructField("ord", kind), T.StructField("parent", kind),
        T.StructField("sim", T.DoubleType()),
    ])

    def best(_key: tuple, rows: pd.DataFrame, pool: pd.DataFrame) -> pd.DataFrame:
        out = rows[[*keys, "ord"]].assign(parent=rows["ord"], sim=np.nan)
        if len(rows) and len(pool):
            pool = pool.sort_values("ord", kind="stable")
            names, means = pool["ord"].to_numpy(), np.stack(pool["s"].to_list()) / pool["n"].to_numpy(float)[:, None]
            own = np.stack(rows["s"].to_list()) / rows["n"].to_numpy(float)[:, None]
            first, out["sim"] = _nearest(own, means, pd.Index(names).get_indexer(rows["ord"]))
            out["parent"] = names[first]
            out = out[np.isfinite(out["sim"])]
        return plain_strings(out[schema.fieldNames()])

    tiles = left.groupBy(*spot).cogroup(_fresh(right).groupBy(*spot)).applyInPandas(best, schema)
    winner = F.max_by(F.struct("parent", "sim"), F.struct(F.col("sim"), -F.col("parent"))).alias("b")
    return tiles.groupBy(*keys, "ord").agg(winner).select(*keys, "ord", "b.parent", "b.sim")


def linkage_tree(units: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The average-linkage tree as rows (keys, ord, parent, h): ``ord`` joins ``parent`` at height ``h``.

    ``units``: keys, ord, s (sum of unit vectors), n. A cluster is named by its smallest ``ord``.
    Each cluster of a group above ``most`` and above a tile keeps its nearest neighbour from round to round. In a
    round all mutual neighbours merge; only the merged clusters and those whose neighbour merged
    search again, as average linkage brings nobody closer than its nearest was. The tables of a
    round hold the groups still above; one task joins each of the others to the end.
    """
    clusters, tree, ready = units, [], []
    kind = units.schema["ord"].dataType
    near, search = None, clusters
    while True:
        many = F.count(F.lit(1)) > F.greatest(F.lit(most), _tile_rows(units.sparkSession))
        sizes = saved(clusters.groupBy(*keys).agg(many.alias("_busy")))
        groups, left = sizes.agg(F.count(F.lit(1)), F.count_if("_busy")).first()
        busy = F.broadcast(sizes.filter("_busy").drop("_busy"))  # each stands for a tile of clusters
        if left < groups:
            ready.append(clusters.join(busy, keys, "left_anti") if left else clusters)
        if not left:
            break
        pool = clusters.join(busy, keys, "left_semi")
        found = nearest_in_tiles(search.join(busy, keys, "left_semi"), pool, keys)
        near = saved(found if near is None else near.join(busy, keys, "left_semi").unionByName(found))
        back = near.select(*keys, F.col("ord").alias("parent"), F.col("parent").alias("ord"))
        pairs = near.join(back, [*keys, "ord", "parent"]).filter("parent < ord")
        # rounding may leave a group without a mutual pair: its closest one merges
        best = near.groupBy(*keys).agg(F.max_by(F.struct("ord", "parent", "sim"), F.struct("sim", -F.col("ord"))).alias("b"))
        best = best.join(pairs.select(*keys).distinct(), keys, "left_anti").select(
            *keys, F.greatest("b.ord", "b.parent").alias("ord"), F.least("b.ord", "b.parent").alias("parent"), "b.sim"
        )
        pairs = saved(pairs.unionByName(best).select(*keys, "ord", "parent", (1 - F.col("sim")).alias("h")))
        tree.append(pairs)
        moved = pairs.select(*keys, F.explode(F.array("ord", "parent")).alias("ord"), F.col("parent").alias("_root"))
        joined = pool.join(moved, [*keys, "ord"]).drop("ord").withColumnRenamed("_root", "ord")
        merged = joined.groupBy(*keys, "ord").agg(vector_sum("s").alias("s"), F.sum("n").alias("n"))
        # only merged clusters are added up, the others stay as they are
        clusters = saved(pool.join(moved, [*keys, "ord"], "left_anti").unionByName(merged))
        lost = near.join(moved.select(*keys, F.col("ord").alias("parent")), [*keys, "parent"], "left_semi").select(*keys, "ord")
        again = saved(moved.select(*keys, "ord").union(lost).distinct())
        near = near.join(again, [*keys, "ord"], "left_anti")
        search = clusters.join(again, [*keys, "ord"], "left_semi")
        gc.collect()  # lets Spark drop the files of the rounds before
    schema = T.StructType([
        *[units.schema[c] for c in keys], T.StructField("ord", kind), T.StructField("parent", kind),
        T.StructField("h", T.DoubleType()),
    ])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable").reset_index(drop=True)
        heights, joins = average_linkage(np.stack(part["s"].to_list()), part["n"].to_numpy(float), most)
        out = part.loc[[b for _, b in joins], [*keys, "ord"]].reset_index(drop=True)
        out["parent"] = part["ord"].to_numpy()[[a for a, _ in joins]] if joins else []
        out["h"] = heights
        return plain_strings(out)

    rest = reduce(DataFrame.unionByName, ready, units.limit(0)).groupBy(*keys).applyInPandas(finish, schema)
    for pairs in tree:
        rest = rest.unionByName(pairs)
    return rest


def _cluster_large(units: DataFrame, keys: list[str], most: int, max_k: int, min_k: int, threshold: float,
                   merge: float) -> DataFrame:
    """``choose_clusters`` as aggregates over the merge list: (keys, _unit, cluster)."""
    from clipweave.session import cut

    twice = saved(units.groupBy(*keys, "ord").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").drop("_k"))
    if twice.limit(1).count():  # a name is one cluster
        named = units.join(twice, [*keys, "ord"], "left_semi").groupBy(*keys, "ord")
        units = units.join(twice, [*keys, "ord"], "left_anti").unionByName(
            named.agg(vector_sum("s").alias("s"), F.sum("n").alias("n"))
        )
    tree = cut(linkage_tree(units, keys, most))
    every = [*CUTS, threshold, *LADDER, *WIDER]
    counts = tree.groupBy(*keys).agg(F.array(*[F.count_if(F.col("h") <= t) for t in every]).alias("made"))
    sizes = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("lines"))
    cuts = T.StructType([*[units.schema[c] for c in keys], *T.StructType.fromDDL("base double, steps array<double>").fields])

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            base, steps = [], []
            for made, m, lines in zip(part["made"], part["m"], part["lines"], strict=True):
                left = {t: int(m - c) for t, c in zip(every, made, strict=True)}
                first: dict[int, float] = {}
                for t in CUTS:
                    if 2 <= left[t] <= max_k and left[t] < lines:
                        first.setdefault(left[t], t)
                steps.append(sorted(first.values()))
                base.append(steps[-1][0] if first else _plain_cut(left.__getitem__, max_k, min_k, threshold))
            yield plain_strings(part[keys].assign(base=base, steps=steps))

    plan = cut(counts.join(sizes, keys).mapInPandas(choose, cuts))
    plan = F.broadcast(plan)  # a row per large group
    low = tree.join(plan, keys).filter("h <= base").select(*keys, "ord", "parent")
    roots = saved(units.select(*keys, "ord").join(low, [*keys, "ord"], "left")
                .select(*keys, "ord", F.coalesce("parent", "ord").alias("root")))
    while True:  # every pass doubles the steps a link spans
        ahead = roots.select(*keys, F.col("ord").alias("root"), F.col("root").alias("_next"))
        moved = saved(roots.join(ahead, [*keys, "root"]))
        done = moved.filter("root <> _next").limit(1).count() == 0
        roots = moved.select(*keys, "ord", F.col("_next").alias("root"))
        if done:
            break
    placed = units.join(roots, [*keys, "ord"])
    heads = placed.groupBy(*keys, "root").agg(vector_sum("s").alias("s"), F.sum("n").alias("n"))
    above = tree.withColumnRenamed("ord", "root").join(
        roots.select(*keys, F.col("ord").alias("parent"), F.col("root").alias("_head")), [*keys, "parent"]
    ).select(*keys, "root", F.col("_head").alias("parent"), "h")
    heads = heads.join(above, [*keys, "root"], "left").join(plan, keys)
    heads = cut(heads.select(*keys, F.col("root").alias("ord"), "s", "n", "parent", "h", "steps"))

    # groups with several good cuts: their silhouettes, the lines of a group in salted parts
    salts = F.broadcast(sizes.select(*keys, F.ceil(F.col("m") / setting(units.sparkSession, "matchGroup", GROUP_ROWS)).alias("_salts")))
    some = heads.filter(F.size("steps") > 1)
    copies = some.join(salts, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    salted = placed.join(salts, keys).join(F.broadcast(plan.filter(F.size("steps") > 1).select(*keys)), keys, "left_semi")
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.col("_salts")))
    sums_of = T.StructType([*[units.schema[c] for c in keys], *T.StructType.fromDDL("t double, total double, weight double").fields])

    def score(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in sums_of.fields}, dtype=object)
        right = right.sort_values("ord", kind="stable").reset_index(drop=True)
        sums, n = np.stack(right["s"].to_list()), right["n"].to_numpy(float)
        at = right.set_index("ord").index.get_indexer(left["root"])
        own, weight = np.stack(left["s"].to_list()), left["n"].to_numpy(float)
        out = []
        for t in right["steps"].iloc[0]:
            lab = _heads_at(right, t)
            cent, members = _directions(sums, lab), np.bincount(lab, weights=n)
            out.append((t, *_silhouette_sums(own / weight[:, None], weight, lab[at], cent, members)))
        made = pd.DataFrame(out, columns=["t", "total", "weight"])
        for c in keys:
            made[c] = right[c].iloc[0]
        return plain_strings(made[[f.name for f in sums_of.fields]])

    spot = [*keys, "_salt"]
    scored = salted.groupBy(*spot).cogroup(_fresh(copies).groupBy(*spot)).applyInPandas(score, sums_of)
    best = scored.groupBy(*keys, "t").agg((F.sum("total") / F.sum("weight")).alias("v")).groupBy(*keys).agg(
        F.max_by("t", F.struct(F.col("v"), -F.col("t"))).alias("t")
    )
    final = heads.join(best, keys, "left")
    out_schema = T.StructType([
        *[units.schema[c] for c in keys], T.StructField("root", units.schema["ord"].dataType),
        T.StructField("cluster", T.IntegerType()),
    ])

    def name(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable").reset_index(drop=True)
        t = part["t"].iloc[0]
        lab = np.arange(len(part)) if pd.isna(t) else _heads_at(part, t)
        out = part[[*keys, "ord"]].rename(columns={"ord": "root"})
        out["cluster"] = _merge_twins(np.stack(part["s"].to_list()), lab, merge, max_k)
        return plain_strings(out)

    named = final.groupBy(*keys).applyInPandas(name, out_schema)
    return roots.join(named, [*keys, "root"]).select(*keys, F.col("ord").alias("_unit"), "cluster")


def _heads_at(heads: pd.DataFrame, t: float) -> np.ndarray:
    """Labels of the clusters of a cut when it is raised to ``t``; rows in order of appearance."""
    place = {o: i for i, o in enumerate(heads["ord"])}
    up = heads[heads["h"].notna()].sort_values("h", kind="stable")
    joins = [(place[p], place[o]) for p, o in zip(up["parent"], up["ord"], strict=True)]
    return _cut_tree(len(heads), up["h"].to_list(), joins, t)


def choose_clusters(sums: np.ndarray, n: np.ndarray, max_k: int, min_k: int, threshold: float,
                    merge: float) -> np.ndarray:
    """Cut the average-linkage tree where the silhouette is best; then merge twins.

    ``sums``/``n`` describe units of one or more unit vectors, in order of appearance.
    """
    if len(n) < 2:
        return np.zeros(len(n), int)
    heights, joins = average_linkage(sums, n)
    cut = lambda t: _cut_tree(len(n), heights, joins, t)
    best, score = None, -1.0
    for t in CUTS:
        lab = cut(t)
        if 2 <= lab.max() + 1 <= max_k:
            s = _unit_silhouette(sums, n, lab)
            if s > score:
                best, score = lab, s
    if best is None:
        best = cut(_plain_cut(lambda t: cut(t).max() + 1, max_k, min_k, threshold))
    return _merge_twins(sums, best, merge, max_k)


def _plain_cut(clusters: Callable[[float], int], max_k: int, min_k: int, threshold: float) -> float:
    """The cut where no silhouette decides, by the number of clusters at a height."""
    if clusters(threshold) < min_k:
        return next((t for t in LADDER if clusters(t) >= min_k), LADDER[-1])
    if clusters(threshold) > max_k:
        return next((t for t in WIDER if clusters(t) <= max_k), WIDER[-1])
    return threshold


def _pair_rounds(s: np.ndarray, w: np.ndarray, most: int) -> tuple[np.ndarray, list[float], list[tuple[int, int]]]:
    """Joins mutual nearest pairs until ``most`` clusters are left: their places, the heights and the joins.

    ``s`` and ``w`` are changed: the smaller place of a pair takes its sum and count.
    """
    at, heights, joins = np.arange(len(w)), [], []
    near, sim = np.zeros(len(w), int), np.full(len(w), -np.inf)  # by place
    search, spot = at, np.empty(len(w), int)
    while len(at) > most:
        spot[at] = np.arange(len(at))
        means = s[at] / w[at, None]
        first, sim[search] = _nearest(means[spot[search]], means, spot[search])
        near[search] = at[first]
        b = at[(near[near[at]] == at) & (near[at] < at)]
        if not len(b):  # rounding may leave no mutual pair: the closest one merges
            top = at[sim[at].argmax()]
            b = np.array([max(top, near[top])])
            near[b], sim[b] = min(top, near[top]), sim[top]
        a = near[b]
        heights += (1.0 - sim[b]).tolist()
        joins += zip(a.tolist(), b.tolist())
        moved = np.zeros(len(w), bool)
        moved[a] = moved[b] = True
        s[a] += s[b]
        w[a] += w[b]
        at = np.setdiff1d(at, b, assume_unique=True)
        search = at[moved[at] | moved[near[at]]]
    return at, heights, joins


def average_linkage(sums: np.ndarray, n: np.ndarray, most: int = EXACT_LINES) -> tuple[list[float], list[tuple[int, int]]]:
    """Nearest-neighbour chain; the mean distance of A and B is 1 - S_A.S_B / (n_A n_B).

    A chain goes on to the nearest cluster, the first one among equals, until two name each other.
    Above ``most`` clusters mutual pairs are joined first, all of a round at once.
    """
    s, w = sums.copy(), n.copy()
    if len(w) > max(1, most) and np.isfinite(s).all():
        at, heights, joins = _pair_rounds(s, w, max(1, most))
        more, last = average_linkage(s[at], w[at], len(at))
        return heights + more, joins + [(int(at[a]), int(at[b])) for a, b in last]
    alive = np.ones(len(w), bool)
    heights, joins, chain = [], [], []
    while alive.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            top = chain[-1]
            d = 1.0 - np.round((s @ s[top]) / (w * w[top]), DIGITS)
            d[~alive] = np.inf
            d[top] = np.inf
            near = int(np.argmin(d))
            if near in chain:  # the one before, or another one that only rounding sets before it
                near = chain[-2]
                break
            chain.append(near)
        a, b = sorted((chain.pop(), chain.pop()))
        heights.append(float(d[near]))
        joins.append((a, b))
        s[a] += s[b]
        w[a] += w[b]
        alive[b] = False
    return heights, joins


def _cut_tree(n: int, heights: list[float], joins: list[tuple[int, int]], t: float) -> np.ndarray:
    """Labels when every join up to height ``t`` is made, numbered by appearance."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for h, (a, b) in zip(heights, joins, strict=True):
        if h <= t:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return pd.factorize(np.array([find(i) for i in range(n)]))[0]


def _directions(sums: np.ndarray, lab: np.ndarray) -> np.ndarray:
    total = np.zeros((lab.max() + 1, sums.shape[1]))
    np.add.at(total, lab, sums)
    return total / (np.linalg.norm(total, axis=1, keepdims=True) + EPS)


def _silhouette_sums(means: np.ndarray, n: np.ndarray, lab: np.ndarray, cent: np.ndarray,
                     members: np.ndarray) -> tuple[float, float]:
    """Sum and weight of the silhouettes of the units whose cluster has more than one line."""
    dist = 1.0 - means @ cent.T
    rows = np.arange(len(lab))
    a = dist[rows, lab].copy()
    dist[rows, lab] = np.inf
    b = dist.min(axis=1)
    use = members[lab] > 1
    s = (b - a) / np.maximum(np.maximum(a, b), EPS)
    return float((s[use] * n[use]).sum()), float(n[use].sum())


def _unit_silhouette(sums: np.ndarray, n: np.ndarray, lab: np.ndarray) -> float:
    members = np.bincount(lab, weights=n)
    total, weight = _silhouette_sums(sums / n[:, None], n, lab, _directions(sums, lab), members)
    return total / weight if weight else -1.0


def _merge_twins(sums: np.ndarray, lab: np.ndarray, limit: float, max_k: int) -> np.ndarray:
    """Join the first pair of near-identical clusters until none is left, then cap k."""
    lab = lab.copy()
    while lab.max() > 0:
        cent = _directions(sums, lab)
        sim = np.triu(cent @ cent.T, 1)
        sim[np.tril_indices(len(cent))] = -2.0
        close = np.argwhere(sim >= limit)
        if len(close):
            a, b = close[0]
        elif len(cent) > max_k:
            a, b = np.unravel_index(np.argmax(sim), sim.shape)
        else:
            break
        lab[lab == b] = a
        lab = pd.factorize(lab)[0]
    return lab


# --- sequence smoothing -------------------------------------------------------

def smooth_labels(lines: DataFrame, cents: DataFrame, switch_cost: float = 0.05, *,
                  item: tuple[str, ...] = ("item_id",), project: tuple[str, ...] = ()) -> DataFrame:
    """Most likely label sequence per item: similarity to centroids minus switches.

    ``lines``: item, ord, label (the vote), emb; ``cents``: project, label, ord, centroid. Only
    lines with a vector take part, and only in items that have at least three. The labels of a
    project are one row that meets its lines, so projects may have any labels of their own.
    """
    from clipweave.session import cut

    item, project = list(item), list(project)
    one = project or ["_one"]
    whole = cents if project else cents.withColumn("_one", F.lit(0))
    table = whole.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct(
        F.col("ord"), F.col("label").cast("string").alias("label"), unit(F.col("centroid").cast("array<double>")).alias("u")
    ))).alias("_table"))
    voiced = lines.filter(F.col("emb").isNotNull())
    enough = voiced.groupBy(*item).agg(F.count(F.lit(1)).alias("_n")).filter("_n >= 3").drop("_n")
    rows = voiced.join(enough, item, "left_semi").select(
        *item, "ord", unit(F.col("emb").cast("array<double>")).alias("_u"), *([] if project else [F.lit(0).alias("_one")])
    ).join(table, one)
    product = lambda c: F.aggregate(F.zip_with("_u", c["u"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scored = cut(rows.select(*item, "ord", F.transform("_table", product).alias("sims")))

    def forward(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
        v = None if state is None else np.array(json.loads(state))
        back, best = [], []
        for sims in rows["sims"]:
            own = np.arange(len(sims))
            if v is None:
                v, b = np.asarray(sims, float), np.zeros(len(sims), int)
            else:  # stay, or come from the best one at the price of a switch; the first of equals
                top = int(v.argmax())
                away = v[top] - switch_cost
                b = np.where(v > away, own, np.where(v == away, np.minimum(own, top), top))
                v = np.asarray(sims, float) + np.maximum(v, away)
            v = v - v.max()  # only differences matter, and they stay comparable between cells
            back.append(b.tolist())
            best.append(int(v.argmax()))
        out = rows[[*item, "ord"]].copy()
        out["back"], out["best"] = back, best
        return out, None if v is None else json.dumps([round(float(z), 9) for z in v])

    def backward(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
        j = None if state is None else int(state)
        path = []
        for best, back in zip(rows["best"], rows["back"], strict=True):
            j = int(best) if j is None else j
            path.append(j)
            j = int(back[j])
        out = rows[[*item, "ord"]].copy()
        out["state"] = path
        return out, None if j is None else str(j)

    at = ", ".join(f"{c} {scored.schema[c].dataType.simpleString()}" for c in [*item, "ord"])
    fwd = cut(ordered_fold(scored, item, ["ord"], forward, f"{at}, back array<int>, best int"))
    path = ordered_fold(fwd, item, ["ord"], backward, f"{at}, state int", reverse=True)
    path = path if project else path.withColumn("_one", F.lit(0))
    smoothed = path.join(table, one).select(*item, "ord", F.col("_table")[F.col("state")]["label"].alias("_s"))
    return lines.join(smoothed, [*item, "ord"], "left").withColumn(
        "smoothed", F.coalesce("_s", F.col("label").cast("string"))
    ).drop("_s")


def mixed_lines(lines: DataFrame, runs: DataFrame, min_ms: int = 1000, min_share: float = 0.30, *,
                item: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """Does a line start or end with a long run of its neighbour's voice?

    ``lines``: item_id, ord, start_ms, end_ms, label (smoothed, null if unknown);
    ``runs``: item_id, ord, part, start_ms, end_ms, label. Adds side, other_label, other_ms.
    """
    from clipweave.plans.scan import plan_cells

    cells = plan_cells(lines, list(item), F.col("ord"))
    near = prefix_scan(lines, list(item), ["ord"], cells=cells, _pl=neighbour(F.col("label")))
    near = prefix_scan(near, list(item), ["ord"], cells=cells, reverse=True, _nl=neighbour(F.col("label")))
    keys = [*item, "ord"]
    sides = near.select(*keys, "label", "_pl", "_nl").withColumnRenamed("label", "_own")
    r = runs.select(*keys, "part", "label", (F.col("end_ms") - F.col("start_ms")).alias("_d")).join(sides, keys)
    run_cells = plan_cells(r, keys, F.col("part"))

    def edge(side: str, reverse: bool) -> DataFrame:
        other = F.col(side)
        broken = (~F.col("label").eqNullSafe(other)).cast("long")
        seen = prefix_scan(r, keys, ["part"], cells=run_cells, reverse=reverse, _br=running_sum(broken))
        return seen.filter((F.col("_br") == 0) & other.isNotNull() & (other != F.col("_own"))).groupBy(*keys).agg(
            F.sum("_d").alias(side + "_ms")
        )

    both = near.join(edge("_pl", False), keys, "left").join(edge("_nl", True), keys, "left")
    length = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))

    def strong(c: str) -> Column:
        return F.when((F.col(c) >= min_ms) & (F.col(c) / length >= min_share), F.col(c))

    pre, post = strong("_pl_ms"), strong("_nl_ms")
    side = F.when(pre.isNotNull() & (post.isNull() | (pre >= post)), "pre").when(post.isNotNull(), "post")
    return both.withColumn("side", side).withColumn(
        "other_label", F.when(F.col("side") == "pre", F.col("_pl")).when(F.col("side") == "post", F.col("_nl"))
    ).withColumn(
        "other_ms", F.when(F.col("side") == "pre", pre).when(F.col("side") == "post", post)
    ).drop("_pl", "_nl", "_pl_ms", "_nl_ms")


# --- pool matching --------------------------------------------------------------

def absorb_samples(pool: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Running mean of every character with its new samples (order-free)."""
    add = samples.filter(F.col("emb").isNotNull()).groupBy(*keys, "char_id").agg(
        vector_mean("emb").alias("_m"), F.count(F.lit(1)).cast("int").alias("_k")
    )
    n = F.coalesce("emb_count", F.lit(0))
    fresh = F.col("emb").isNull() | (n <= 0)
    blended = F.zip_with("emb", "_m", lambda o, m: (o * n + m * F.col("_k")) / (n + F.col("_k")))
    return (
        pool.join(add, [*keys, "char_id"], "left")
        .withColumn("emb", F.when(F.col("_k").isNull(), F.col("emb")).when(fresh, F.col("_m")).otherwise(blended))
        .withColumn(
            "emb_count",
            F.when(F.col("_k").isNull(), F.col("emb_count")).when(fresh, F.col("_k")).otherwise(n + F.col("_k")),
        )
        .drop("_m", "_k")
    )


def rescan(segments: DataFrame, pool: DataFrame, keys: list[str], bind: float = 0.80,
           bind_margin: float = 0.05, move_margin: float = 0.08) -> DataFrame:
    """Match segments against the pool; adds ``outcome`` and ``new_character``.

    Outcomes: skipped (no id, locked, mixed or no vector), bound, moved, kept.
    """
    open_ = F.col("seg_id").isNotNull() & ~F.coalesce("locked", F.lit(False)) & ~F.coalesce("mixed", F.lit(False))
    x = segments.withColumn("_v", F.when(open_, F.col("emb")))
    got = best_matches(x, pool, keys=keys, k=2, emb="_v", current="character_id")
    best, second = F.get("matches", F.lit(0)), F.get("matches", F.lit(1))
    lead = best["sim"] - F.coalesce(second["sim"], F.lit(-1.0))
    cur = F.col("character_id").cast("string")
    outcome = (
        F.when(F.col("_v").isNull(), "skipped")
        .when(best.isNull(), "kept")
        .when(cur.isNull() & (best["sim"] >= bind) & (lead >= bind_margin), "bound")
        .when(
            cur.isNotNull() & (cur != best["char_id"]) & (best["sim"] >= bind)
            & (best["sim"] - F.col("current_sim") >= move_margin),
            "moved",
        )
        .otherwise("kept")
    )
    out = got.withColumn("outcome", outcome)
    return out.withColumn(
        "new_character", F.when(F.col("outcome").isin("bound", "moved"), best["char_id"]).otherwise(cur)
    ).drop("_v", "matches", "current_sim")


def feedback(segments: DataFrame, pool: DataFrame, samples: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Absorb corrected samples, rescan everything else; (segments, pool) come back."""
    stronger = absorb_samples(pool, samples.withColumnRenamed("character_id", "char_id"), keys)
    rest = segments.join(samples.select(*keys, "item_id", "seg_id"), [*keys, "item_id", "seg_id"], "left_anti")
    return rescan(rest, stronger, keys), stronger


_MOVES = ("project_id string, ord long, label string, char_id string, how string, sim double, "
          "emb array<double>, emb_count int")


def match_in_order(labels: DataFrame, pool: DataFrame, *, mode: str, threshold: float = 0.80,
                   margin: float = 0.05) -> DataFrame:
    """Match labels to a pool that moves with every match, one label after another.

    ``labels``: project_id, ord (place in the sequence), label, label_key, emb.
    ``pool``: project_id, ord, char_id, labels, emb, emb_count. Modes:

    * ``strong``: best >= threshold and a clear lead, else unmatched;
    * ``weak``: a character that has the label key, else best >= threshold, else a new one;
    * ``gap``: like strong, but the sample is absorbed and misses stay unassigned.

    Rows of kind ``pool`` carry the changed characters. A pool whose size is checked travels
    to the tasks, and the labels of a project stream through an ordered fold whose state is
    the changed characters alone. With a larger pool one task takes a project: only a matched
    character changes, so with L labels the L + 2 best characters of the untouched pool per
    label decide every step, at most L * (L + 2) of them.
    """
    lab = labels.filter(F.col("emb").isNotNull()).withColumn("project_id", F.col("project_id").cast("string"))
    chars = pool.withColumn("project_id", F.col("project_id").cast("string"))
    todo = lab.select("project_id", F.col("ord").cast("long").alias("ord"), "label", "label_key",
                      F.col("emb").cast("array<double>").alias("emb"))
    chars = chars.select(
        "project_id", F.col("ord").cast("long").alias("ord"), F.col("char_id").cast("string").alias("char_id"),
        "labels", F.col("emb").cast("array<double>").alias("emb"), F.col("emb_count").cast("int").alias("emb_count"),
    )
    names = [x.split()[0] for x in _MOVES.split(", ")]

    def cos(a: np.ndarray, b: np.ndarray) -> float:
        return float(a @ b / ((np.linalg.norm(a) + EPS) * (np.linalg.norm(b) + EPS)))

    def characters(rows: pd.DataFrame) -> list[dict]:
        return [
            {"id": r.char_id, "labels": list(r.labels) if r.labels is not None else [],
             "v": None if r.emb is None else np.asarray(r.emb, float),
             "n": 0 if pd.isna(r.emb_count) else int(r.emb_count), "moved": False}
            for r in rows.sort_values("ord").itertuples(index=False)
        ]

    def walk(project: str, known: list[dict], rows: pd.DataFrame) -> list[tuple]:
        out = []
        for r in rows.itertuples(index=False):
            v = np.asarray(r.emb, float)
            sims = [(-cos(v, c["v"]), i) for i, c in enumerate(known) if c["v"] is not None]
            sims.sort()
            best = -sims[0][0] if sims else -1.0
            lead = best - (-sims[1][0] if len(sims) > 1 else -1.0)
            target, how = None, "none"
            owner = [c for c in known if r.label_key in c["labels"]] if mode == "weak" else []
            if owner:
                target, how = owner[0], "key"
            elif sims and best >= threshold and (mode == "weak" or lead >= margin):
                target, how = known[sims[0][1]], "match"
            if target is not None:
                had = target["n"] if mode == "gap" else (target["n"] or 1)
                if target["v"] is not None and had > 0:
                    target["v"] = (target["v"] * had + v) / (had + 1)
                    target["n"] = had + 1
                elif mode == "gap":
                    target["v"], target["n"] = v, 1
                else:
                    target["n"] = had + 1
                if r.label_key not in target["labels"] and mode != "gap":
                    target["labels"].append(r.label_key)
                target["moved"] = True
            elif mode == "weak":
                target = {"id": f"char_{r.label_key}", "labels": [r.label_key], "v": v, "n": 1, "moved": True}
                known.append(target)
                how = "new"
            out.append((project, r.ord, r.label, target["id"] if target else None, how, best, None, None))
        return out

    def moved(project: str, known: list[dict]) -> list[tuple]:
        return [(project, None, None, c["id"], "pool", None, None if c["v"] is None else c["v"].tolist(), c["n"])
                for c in known if c["moved"]]

    def frame(out: list[tuple]) -> pd.DataFrame:
        return plain_strings(pd.DataFrame(out, columns=names))

    count, width = chars.agg(F.count(F.lit(1)), F.max(F.size("emb"))).first()
    if count * max(width or 1, 1) <= setting(labels.sparkSession, "poolValues", POOL_VALUES):
        local = chars.toPandas()  # size checked
        shared = labels.sparkSession.sparkContext.broadcast(dict(list(local.groupby("project_id", sort=False))))

        def resume(project: str, state: str | None) -> list[dict]:
            """The project's characters as the state left them; those made on the way come last."""
            held = shared.value.get(project)
            known = [] if held is None else characters(held)
            place = {c["id"]: c for c in reversed(known)}
            for i, kept, v, n in json.loads(state) if state else []:
                now = {"id": i, "labels": kept, "v": None if v is None else np.array(v, float), "n": n, "moved": True}
                if i in place:
                    place[i].update(now)
                else:
                    known.append(now)
            return known

        def step(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
            project = rows["project_id"].iloc[0]
            known = resume(project, state)
            out = walk(project, known, rows)
            left = [(c["id"], c["labels"], None if c["v"] is None else c["v"].tolist(), c["n"]) for c in known if c["moved"]]
            return frame(out), json.dumps(left) if left else None

        def finish(key: tuple, state: str | None) -> pd.DataFrame:
            return frame(moved(key[0], resume(key[0], state)))

        return ordered_fold(todo, ["project_id"], ["ord"], step, _MOVES, finish=finish)

    most = lab.groupBy("project_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    near = best_matches(lab.select("project_id", "emb"), chars, keys=["project_id"], k=most + 2)
    wanted = near.select("project_id", F.explode("matches.char_id").alias("char_id"))
    if mode == "weak":
        owners = (
            chars.select("project_id", "char_id", F.explode("labels").alias("label_key"))
            .join(lab.select("project_id", "label_key"), ["project_id", "label_key"], "left_semi")
            .select("project_id", "char_id")
        )
        wanted = wanted.unionByName(owners)
    wanted = wanted.distinct()
    some = chars.join(wanted, ["project_id", "char_id"], "left_semi")

    def solve(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = characters(right)
        out = walk(key[0], known, left.sort_values("ord"))
        return frame(out + moved(key[0], known))

    return todo.groupBy("project_id").cogroup(some.groupBy("project_id")).applyInPandas(solve, _MOVES)


def match_frozen(labels: DataFrame, pool: DataFrame, keys: list[str], threshold: float = 0.80,
                 margin: float = 0.05) -> DataFrame:
    """Order-free variant: every label is matched against the pool as it was."""
    got = best_matches(labels, pool, keys=keys, k=2)
    best, second = F.get("matches", F.lit(0)), F.get("matches", F.lit(1))
    hit = (best["sim"] >= threshold) & (best["sim"] - F.coalesce(second["sim"], F.lit(-1.0)) >= margin)
    return got.withColumn("char_id", F.when(hit, best["char_id"])).withColumn("sim", best["sim"]).withColumn(
        "second", second["sim"]
    ).drop("matches")


def characters_by_key(keys_seen: DataFrame, pool: DataFrame) -> DataFrame:
    """Without vectors: one character per label key, reusing an owner of the key."""
    owners = pool.select("ord", "char_id", F.explode("labels").alias("label_key")).groupBy("label_key").agg(
        F.min_by("char_id", "ord").alias("owner")
    )
    return keys_seen.join(owners, "label_key", "left").withColumn(
        "char_id", F.coalesce("owner", F.concat(F.lit("char_"), "label_key"))
    ).withColumn("created", F.col("owner").isNull()).drop("owner")


def similarity(a: str, b: str) -> Column:
    return cosine(F.col(a), F.col(b))
