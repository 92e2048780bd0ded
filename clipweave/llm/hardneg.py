"""Hard negatives by Fagin's threshold algorithm over blocks of vectors.

Rows are dealt to blocks by a hash; a cell is a group of anchors beside a block. In each cell the
block's rows stand in one sorted list per dimension. An anchor reads every list from the end that
its own sign favours, scores each row it meets by random access, and stops once the threshold (the
score that a row at the current depth of all lists would have) is strictly below what it holds.
The first pass finds the positives of a block among the anchor's label, the second the negatives
of every window; both merge the blocks' best rows by a ranking that is cut before the shuffle.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no
part; equal rows count once; rows that share an id but differ are rows of their own; a shorter
vector counts as filled up with zeros; scaled components are held within 2^27 on both sides, so
that scores stay in 64 bits; a negative positive score leaves its window empty; anchors without
positives or negatives give no rows; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.common import written

#: rows of a block and anchors of a group, so that a cell is of bounded size
BLOCK, ANCHORS = 8192, 4096
#: fixed values of the contract
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
#: depth of the first sorted access; it doubles
DEPTH = 16
HELD = 1 << 27


def integer_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vec (integers), rid: the rows that take part, each once."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(whole)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    held = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(256 * x.cast("double")), F.lit(-HELD)), F.lit(HELD)).cast("int"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), held.alias("vec")).distinct()
    return rows.withColumn("rid", F.xxhash64("vec_id", "label", "vec"))


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = vectors.combine_chunks()
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    if len(flat) == len(lists) * width:
        return flat.reshape(len(lists), width).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class SortedLists:
    """Candidates in one list per dimension, by value."""

    def __init__(self, vec: np.ndarray):
        self.vec = vec
        self.order = np.ascontiguousarray(np.argsort(vec, axis=0, kind="stable").T.astype(np.int32))
        self.value = np.take_along_axis(vec.T, self.order.astype(np.int64), 1)

    def nearest(self, anchor: np.ndarray, enough: Callable[[np.ndarray, np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the candidates met until ``enough(places, scores, threshold)`` or all are met.

        Every candidate that was not met scores at most the threshold that was told last.
        """
        n = len(self.vec)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        met, depth = np.zeros(n, bool), 0
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(places) < n:
            to = min(n, max(DEPTH, 2 * depth))
            new = np.zeros(n, bool)
            new[self.order[up, n - to : n - depth].ravel()] = True
            new[self.order[down, depth:to].ravel()] = True
            if not len(up) + len(down):  # a zero vector favours no list
                new[:] = True
            fresh = np.flatnonzero(new & ~met)
            met[fresh] = True
            places, scores = np.concatenate([places, fresh]), np.concatenate([scores, self.vec[fresh] @ anchor])
            threshold = int(anchor[up] @ self.value[up, n - to] + anchor[down] @ self.value[down, to - 1])
            depth = to
            if enough(places, scores, threshold):
                break
        return places, scores


def _best(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, most: int) -> list[tuple[int, int]]:
    """(place, score) of the first few: higher scores first, smaller ids first among equals."""
    if len(scores) > most:
        least = np.partition(scores, len(scores) - most)[len(scores) - most]
        at = np.flatnonzero(scores >= least)
        places, scores = places[at], scores[at]
    first = np.lexsort((ids[places], -scores))[:most]
    return list(zip(places[first].tolist(), scores[first].tolist()))


def _kth(scores: np.ndarray, k: int) -> int | None:
    return int(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else None


def _width(*tables: pa.Table) -> int:
    return max((int(t["vec"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in tables if t.num_rows), default=0)


def _positives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of one block for each anchor of a group, of its own label and without itself."""
    out: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        width = _width(anchors, rows)
        vec, labels, ids, rids = _matrix(rows["vec"], width), *(rows[c].to_numpy() for c in ("label", "vec_id", "rid"))
        own, of, rid_of = _matrix(anchors["vec"], width), *(anchors[c].to_numpy() for c in ("label", "rid"))
        for label in np.unique(of).tolist():
            inside = np.flatnonzero(labels == label)
            lists = SortedLists(vec[inside]) if len(inside) else None
            for k in np.flatnonzero(of == label) if lists else ():
                other = rids[inside] != rid_of[k]

                def enough(places: np.ndarray, scores: np.ndarray, threshold: int, other: np.ndarray = other) -> bool:
                    kth = _kth(scores[other[places]], POSITIVES)
                    return kth is not None and threshold < kth

                places, scores = lists.nearest(own[k], enough)
                held = other[places]
                out += [(rid_of[k], ids[inside[p]], s) for p, s in _best(places[held], scores[held], ids[inside], POSITIVES)]
    return _table(out, ["rid", "positive_id", "positive_score"])


def _negatives(anchors: pa.Table, rows: pa.Table) -> pa.Table:
    """The best rows of one block in each window of each anchor of a group, of other labels."""
    out: list[tuple] = []
    if anchors.num_rows and rows.num_rows:
        width = _width(anchors, rows)
        lists, labels, ids = SortedLists(_matrix(rows["vec"], width)), *(rows[c].to_numpy() for c in ("label", "vec_id"))
        own, of, rid_of, found = _matrix(anchors["vec"], width), *(anchors[c].to_numpy() for c in ("label", "rid")), anchors["found"].to_pylist()
        for k, positives in enumerate(found):
            windows = [(p, x["positive_score"]) for p, x in enumerate(positives) if x["positive_score"] >= 0]
            other = labels != of[k]

            def within(scores: np.ndarray, s: int) -> np.ndarray:
                return (LEAST * s <= 100 * scores) & (100 * scores <= MOST * s)

            def enough(places: np.ndarray, scores: np.ndarray, threshold: int, windows: list = windows, other: np.ndarray = other) -> bool:
                held = scores[other[places]]
                for _, s in windows:
                    kth = _kth(held[within(held, s)], NEGATIVES)
                    if not (100 * threshold < LEAST * s or (kth is not None and threshold < kth)):
                        return False
                return True

            places, scores = lists.nearest(own[k], enough) if windows else (np.zeros(0, np.int64),) * 2
            held = other[places]
            places, scores = places[held], scores[held]
            for p, s in windows:
                at = within(scores, s)
                out += [(rid_of[k], p, ids[x], score) for x, score in _best(places[at], scores[at], ids, NEGATIVES)]
    return _table(out, ["rid", "place", "negative_id", "negative_score"])


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.table([pa.array(np.array(c, np.int64)) for c in columns], names)


def _in_cells(anchors: DataFrame, rows: DataFrame, groups: int, blocks: int, find: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every group of anchors meets every block: anchors are copied once per block, rows once per group."""
    a = anchors.withColumns({"i": F.pmod("rid", F.lit(groups)).cast("int"), "j": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    b = rows.withColumns({"i": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "j": F.pmod("rid", F.lit(blocks)).cast("int")})
    return a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(find, schema)


def mine(vectors: DataFrame, every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; anchors are the ids divisible by ``every``."""
    rows = written(integer_rows(vectors), "integer-vectors")
    anchors = rows.filter(F.col("vec_id") % every == 0)
    blocks, groups = -(-max(1, rows.count()) // BLOCK), -(-max(1, anchors.count()) // ANCHORS)
    near = _in_cells(anchors.select("rid", "label", "vec"), rows, groups, blocks, _positives, "rid long, positive_id long, positive_score long")
    best = Window.partitionBy("rid").orderBy(F.desc("positive_score"), "positive_id")
    near = near.withColumn("p", F.row_number().over(best)).filter(F.col("p") <= POSITIVES)
    found = near.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("p", "positive_id", "positive_score"))).alias("found"))
    found = written(anchors.join(found, "rid"), "anchors-with-positives")
    met = _in_cells(found.select("rid", "label", "vec", "found"), rows.select("rid", "vec_id", "label", "vec"), groups, blocks, _negatives, "rid long, place long, negative_id long, negative_score long")
    first = Window.partitionBy("rid", "place").orderBy(F.desc("negative_score"), "negative_id")
    met = met.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= NEGATIVES)
    positive = F.col("found")[F.col("place").cast("int")]
    return found.join(met, "rid").select(
        F.col("vec_id").alias("anchor_id"), positive["positive_id"].alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        "negative_id", positive["positive_score"].alias("positive_score"), "negative_score",
    )
