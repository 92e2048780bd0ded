"""Filter interaction audit: what each filter removes in every order, from truth-table survival words.

Filters fail or pass a document on their own, so a document is described by the set of filters it
fails. That set becomes a 32-bit word whose bit S says whether the document survives the subset S
of filters. Bit counts of the words per part and label, added up by carry-save adders, are the
survivors of all 32 subsets, and every figure of every order is a difference of two of them.

Defined cases: a null text is an empty one (no words: it fails A alone, unless it repeats); a null
part is the empty string; every row counts as a document, equal rows too; rows with the same
doc_id and text don't fail E through each other; a row without doc_id never fails E and makes no
other row fail it; a document is good (toxic) if any of its label rows says so, and null labels
say nothing; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import SPACES

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: all orders in which the filters can be applied
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: fixed values of the contract: words, distinct share, capitals share, marks
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS, MARKS = 200, 50, 3, "[#$%&*|]"
#: groups of documents whose survivors are counted
GROUPS = ["every", "good", "toxic"]
#: bit S of word M: the subset S holds none of the filters in M
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & m) for m in range(SUBSETS)], np.uint32)


def failures(docs: DataFrame) -> DataFrame:
    """doc, part, digest of the text and the bits of the filters A to D that its whole text fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.sha2(text, 256).alias("digest"),
        F.filter(F.split(text, f"[{SPACES}]+"), lambda w: w != "").alias("words"), text.alias("text"),
    )
    n, chars = F.size("words"), F.length("text").cast("long")
    capitals = chars - F.length(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    tests = [n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT * n, 100 * capitals > MAX_CAPITALS * chars, F.col("text").rlike(MARKS)]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(tests)), F.lit(0))
    return rows.select("doc", "part", "digest", bits.cast("int").alias("fails"))


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, bits of all failed filters, good, toxic of every row.

    The smallest id per text is pre-aggregated; rows meet it, and their labels, in left joins
    whose large side Spark may split, so neither a common text nor a common id ends in one task.
    """
    rows = failures(docs)
    first = rows.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    again = F.coalesce(F.col("doc") > F.col("first"), F.lit(False))
    told = [F.coalesce(F.col(g), F.lit(False)).alias(g) for g in GROUPS[1:]]
    return rows.join(first, "digest", "left").join(marks, "doc", "left").select("part", F.when(again, F.col("fails") + 16).otherwise(F.col("fails")).alias("fails"), *told)


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How many 32-bit words have each bit set.

    Carry-save adders turn three words of one weight into a sum of that weight and a carry of
    twice the weight, for all 32 places at once, until two words of each weight are left.
    """
    counts, weight, places = np.zeros(SUBSETS, np.int64), 1, np.arange(SUBSETS, dtype=np.uint32)
    while len(words):
        carries = [words[:0]]
        while len(words) > 2:
            third = len(words) // 3
            a, b, c = (words[i * third : (i + 1) * third] for i in range(3))
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, words[3 * third :]])
        for word in words:
            counts += weight * ((word >> places) & 1).astype(np.int64)
        words, weight = np.concatenate(carries), 2 * weight
    return counts


def survivors(rows: DataFrame) -> DataFrame:
    """One row per part: for each group an array of how many documents survive each of the 32 subsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(0).dictionary_encode()
            number = parts.indices.to_numpy(zero_copy_only=False)
            words = WORDS[batch.column(1).to_numpy(zero_copy_only=False)]
            inside = [np.ones(len(words), bool), *(batch.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))]
            by_part = np.argsort(number, kind="stable")
            cuts = np.searchsorted(number[by_part], np.arange(len(parts.dictionary) + 1))
            places = [by_part[a:b] for a, b in zip(cuts, cuts[1:])]
            counts = [pa.array([bit_counts(words[at[held[at]]]) for at in places], pa.list_(pa.int64())) for held in inside]
            yield pa.RecordBatch.from_arrays([parts.dictionary, *counts], ["part", *GROUPS])

    found = rows.select("part", "fails", *GROUPS[1:]).mapInArrow(run, "part string, " + ", ".join(f"{g} array<long>" for g in GROUPS))
    return found.groupBy("part").agg(*[F.array(*[F.sum(F.col(g)[s]) for s in range(SUBSETS)]).alias(g) for g in GROUPS])


def _shapley(every: Column, bit: Column) -> Column:
    """Removals of a filter added up over all orders: orders in which exactly S stands before it, times what it removes then."""
    orders = F.array(*[F.lit(x) for x in (24, 6, 4, 6, 24)])  # |S|! * (4 - |S|)!
    before = F.filter(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda s: s.bitwiseAND(bit) == 0)
    return F.aggregate(before, F.lit(0).cast("long"), lambda acc, s: acc + orders[F.bit_count(s)] * (every[s] - every[s.bitwiseOR(bit)]))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley; 600 rows per part."""
    bit_of = lambda letter: F.call_function("shiftleft", F.lit(1), F.ascii(letter) - F.lit(ord("A")))
    rows = survivors(judged(docs, labels)).select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")).withColumn("letters", F.split("filter_order", ""))
    before = F.aggregate(F.slice("letters", F.lit(1), F.col("step") - 1), F.lit(0), lambda acc, x: acc.bitwiseOR(bit_of(x)))
    rows = rows.withColumns({"before": before, "bit": bit_of(F.col("letters")[F.col("step") - 1])}).withColumn("after", F.col("before").bitwiseOR(F.col("bit")))
    every, bit = F.col("every"), F.col("bit")
    lost = {g: F.col(g)[F.col("before")] - F.col(g)[F.col("after")] for g in GROUPS}
    return rows.select(
        "part", "filter_order", "step", every[F.col("after")].alias("kept"), lost["every"].alias("removed"),
        (every[0] - every[bit] - lost["every"]).alias("redundant"), (every[F.lit(SUBSETS - 1) - bit] - every[SUBSETS - 1]).alias("unique_fails"),
        lost["good"].alias("good_lost"), lost["toxic"].alias("toxic_lost"), _shapley(every, bit).alias("shapley"),
    )
