"""Exact best matches of many vectors against a pool of named vectors.

A pool whose size is checked to be small travels to the executors once and every
Arrow batch is one matrix product: no shuffle, no pairs. A larger pool is cut into
blocks that meet the rows in salted groups; the block winners are merged afterwards.
Both ways look at every pool vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipweave.functions.vectors import EPS
from clipweave.plans.fold import _fresh
from clipweave.plans.frames import plain_strings
from clipweave.plans.scan import number_rows
from clipweave.session import setting

POOL_VALUES = 8_000_000  # numbers (64 MB) a shipped pool may hold
BLOCK = 4096
GROUP_ROWS = 50_000
TILE = 4_000_000  # similarities (32 MB) that a task holds at once
FEW = 8  # so many leaders are found one by one, more by sorting


def _directions(rows: np.ndarray) -> np.ndarray:
    return rows / (np.linalg.norm(rows, axis=1, keepdims=True) + EPS)


def _leaders(sims: np.ndarray, k: int) -> np.ndarray:
    """Column indices of the k largest values per row; earlier columns win ties."""
    if k > FEW or k >= sims.shape[1]:
        return np.argsort(-sims, axis=1, kind="stable")[:, :k]
    left, rows, out = np.where(np.isnan(sims), -np.inf, sims), np.arange(len(sims)), []
    for _ in range(k):
        out.append(left.argmax(axis=1))
        left[rows, out[-1]] = -np.inf
    return np.stack(out, axis=1)


def _tiles(rows: np.ndarray, pool: np.ndarray, k: int, scaled: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, leaders, similarities) of as many rows at a time as fit ``TILE`` numbers."""
    if scaled:
        rows, pool = _directions(rows), _directions(pool)
    step = max(1, TILE // max(1, len(pool)))
    for at in range(0, len(rows), step):
        sims = rows[at : at + step] @ pool.T
        yield at, _leaders(sims, k), sims


def best_matches(
    rows: DataFrame,
    pool: DataFrame,
    *,
    keys: list[str],
    k: int = 2,
    emb: str = "emb",
    current: str | None = None,
    scaled: bool = True,
) -> DataFrame:
    """Adds ``matches`` = array of (char_id, sim) of the k best, best first.

    Similarity is the cosine, or the plain product of the vectors if not ``scaled``.

    ``pool`` has the ``keys``, ord, char_id and emb. Rows whose vector is null get a
    null array. With ``current`` (a column naming a character) ``current_sim`` is
    added: the similarity to that character, or -1 when it is not in the pool.
    """
    spark = rows.sparkSession
    named = pool.filter(F.col("emb").isNotNull()).select(
        *keys, "ord", "char_id", F.col("emb").cast("array<double>").alias("emb")
    )
    n, width = named.agg(F.count(F.lit(1)), F.max(F.size("emb"))).first()
    cur = F.col(current).cast("string") if current else F.lit(None).cast("string")
    slim = rows.withColumn("_cur", cur).withColumn("_e", F.col(emb).cast("array<double>"))
    if n * (width or 1) <= setting(spark, "poolValues", POOL_VALUES):
        out = _shipped(slim, named, keys, k, scaled)
    else:
        out = _blocked(slim, named, keys, k, scaled)
    out = out.drop("_cur", "_e")
    return out if current else out.drop("current_sim")


_EXTRA = "matches array<struct<char_id:string,sim:double>>, current_sim double"


def _result_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([*rows.schema.fields, *T.StructType.fromDDL(_EXTRA).fields])


def _rank(part: pd.DataFrame, ids: list[str], mat: np.ndarray, k: int, scaled: bool) -> pd.DataFrame:
    out = part.copy()
    have = part["_e"].notna().to_numpy()
    matches: list = [None] * len(part)
    now: list = [None] * len(part)
    if have.any() and len(ids):
        place = {c: i for i, c in enumerate(ids)}
        voiced, current = np.flatnonzero(have), part["_cur"].to_list()
        for first, top, sims in _tiles(np.stack(part.loc[have, "_e"].to_list()), mat, k, scaled):
            for row, order, line in zip(voiced[first : first + len(top)], top, sims, strict=True):
                matches[row] = [{"char_id": ids[j], "sim": float(line[j])} for j in order]
                at = place.get(current[row])
                now[row] = float(line[at]) if at is not None else -1.0
    out["matches"] = matches
    out["current_sim"] = pd.Series(now, dtype="float64", index=out.index)
    return out


def _shipped(rows: DataFrame, pool: DataFrame, keys: list[str], k: int, scaled: bool) -> DataFrame:
    local = pool.toPandas()  # size checked by the caller
    local = local.sort_values("ord", kind="stable")
    groups = local.groupby(keys, sort=False, dropna=False) if keys else [((), local)]
    table: dict[tuple, tuple[list[str], np.ndarray]] = {}
    for key, part in groups:
        if len(part):
            ids = part["char_id"].astype(str).to_list()
            table[key if isinstance(key, tuple) else (key,)] = (ids, np.stack(part["emb"].to_list()))
    shared = rows.sparkSession.sparkContext.broadcast(table)
    schema = _result_schema(rows)

    def rank(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            groups = batch.groupby(keys, sort=False, dropna=False) if keys else [((), batch)]
            for key, part in groups:
                ids, mat = known.get(key if isinstance(key, tuple) else (key,), ([], None))
                yield plain_strings(_rank(part, ids, mat, k, scaled))

    return rows.mapInPandas(rank, schema)


def _blocked(rows: DataFrame, pool: DataFrame, keys: list[str], k: int, scaled: bool) -> DataFrame:
    spark = rows.sparkSession
    one = keys or ["_one"]
    if not keys:
        rows, pool = rows.withColumn("_one", F.lit(0)), pool.withColumn("_one", F.lit(0))
    block = setting(spark, "poolBlock", BLOCK)
    size = setting(spark, "matchGroup", GROUP_ROWS)
    blocks = number_rows(pool, one, ["ord"], "_rn").withColumn(
        "_block", F.floor((F.col("_rn") - 1) / block)
    )
    span = blocks.groupBy(*one).agg(F.max("_block").alias("_top"))
    counts = rows.groupBy(*one).agg(F.ceil(F.count(F.lit(1)) / size).alias("_salts"))
    plan = counts.join(span, one, "left")
    rid = rows.withColumn("_rid", F.monotonically_increasing_id())
    from clipweave.session import cut

    rid = cut(rid)  # the generated id must not change when a task is run again
    placed = (
        rid.select("_rid", "_e", "_cur", *one)
        .join(plan, one)
        .withColumn("_salt", F.pmod(F.xxhash64("_rid"), F.col("_salts")))
        .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_top", F.lit(0)))))
        .drop("_top", "_salts")
    )
    copies = (
        # the pool is numbered, so that ``ord`` may be of any sortable type
        blocks.select("_rn", "_block", "char_id", "emb", *one)
        .join(plan, one)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
        .drop("_top", "_salts")
    )
    spot = [*one, "_salt", "_block"]
    part_schema = T.StructType.fromDDL("_rid long, ord long, char_id string, sim double, now double")

    def match(_key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("_rn")
        left = left[left["_e"].notna()]
        if left.empty or right.empty:
            return pd.DataFrame({"_rid": [], "ord": [], "char_id": [], "sim": [], "now": []}, dtype=object)
        ids, ords = right["char_id"].astype(str).to_numpy(), right["_rn"].to_numpy()
        place = {c: i for i, c in enumerate(ids)}
        at = [place.get(c) for c in left["_cur"]]
        rid, made = left["_rid"].to_numpy(), []
        for first, top, sims in _tiles(np.stack(left["_e"].to_list()), np.stack(right["emb"].to_list()), k, scaled):
            now = [sims[i, j] if j is not None else np.nan for i, j in enumerate(at[first : first + len(top)])]
            n = top.shape[1]
            made.append(pd.DataFrame({
                "_rid": np.repeat(rid[first : first + len(top)], n), "ord": ords[top].ravel(),
                "char_id": ids[top].ravel(), "sim": np.take_along_axis(sims, top, 1).ravel(),
                "now": np.repeat(now, n),
            }))
        return plain_strings(pd.concat(made, ignore_index=True))

    partial = placed.groupBy(*spot).cogroup(_fresh(copies).groupBy(*spot)).applyInPandas(match, part_schema)
    best = F.struct(F.col("sim"), (-F.col("ord")).alias("o"), F.col("char_id"))
    merged = partial.groupBy("_rid").agg(
        # k entries per block of the pool
        F.transform(
            F.slice(F.sort_array(F.collect_list(best), asc=False), 1, k),
            lambda x: F.struct(x["char_id"].alias("char_id"), x["sim"].alias("sim")),
        ).alias("matches"),
        F.coalesce(F.max(F.when(~F.isnan("now"), F.col("now"))), F.lit(-1.0)).alias("current_sim"),
    )
    return rid.join(merged, "_rid", "left").drop("_rid", *([] if keys else ["_one"]))
