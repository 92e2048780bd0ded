"""Benchmark decontamination: size-partitioned one-permutation MinHash, then exact containment.

Only DataFrame functions. A document's distinct shingles are hashed once; documents are parted by
set size, and a part of sets up to 2^p has 2^(p + 1) bins, each of which keeps its minimum. So
the sketch grows with the set, and a shingle that a short item shares with a document is its bin's
minimum with a chance of at least 0.78, in documents of any length. An item's shingle is looked
up with the first part in whose bins it is the item's own minimum; it stays one in all finer ones.

An item whose containment asks for fewer than ``SURE`` common shingles could be missed by chance
(0.22 ^ SURE), so such items are looked up among all shingles of the documents instead of sketches.

Defined cases: null or empty texts and null ids match nothing; an item with fewer words than a
shingle is one shingle of its own length, sought among runs of as many words; equal rows of a
document give one result; extra input columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import lower_ascii, sized, written

#: words of a shingle
SHINGLE = 5
#: share of an item's shingles that a document must hold
CONTAINMENT = 0.75
#: common shingles from which a sketch is sure enough: 0.22 ^ 8 is under 6e-6
SURE = 8


def word_array(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), r"[ \t\n\x0B\f\r]+", -1), lambda w: w != "")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, wherever the optimiser moves it."""
    return F.transform(F.array(value), use)[0]


def runs(words: Column, k: int, of: str) -> Column:
    """All runs of k words, as hashes or joined by spaces; none if there are fewer words."""
    def run(i: Column) -> Column:
        taken = [words[i + j] for j in range(k)]
        return F.xxhash64(*taken) if of == "hash" else F.concat_ws(" ", *taken)

    return F.when(F.size(words) >= k, F.transform(F.sequence(F.lit(0), F.size(words) - k), run)).otherwise(
        F.array().cast("array<bigint>" if of == "hash" else "array<string>")
    )


def _runs_of(k: int, of: str) -> Callable[[Column], Column]:
    return lambda words: runs(words, k, of)


def item_shingles(items: DataFrame, k: int = SHINGLE) -> DataFrame:
    """item_id, length of its shingles in words, distinct shingles as text and as hashes."""
    words = F.col("words")
    held = items.filter(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), word_array(F.col("text").cast("string")).alias("words"))
    held = held.filter(F.size("words") > 0)
    whole = F.size("words") < k
    return held.select(
        "item_id",
        F.least(F.size("words"), F.lit(k)).alias("k"),
        F.when(whole, F.array(F.concat_ws(" ", "words"))).otherwise(F.array_distinct(runs(words, k, "text"))).alias("texts"),
        # a short item is hashed like the runs of its own length
        F.coalesce(*[F.when(F.size("words") == n, runs(words, n, "hash")) for n in range(1, k)], F.array_distinct(runs(words, k, "hash"))).alias("hashes"),
    ).distinct()


def part_of(n: Column) -> Column:
    """The size part p of a set: the least p with 2^p >= n."""
    return F.ceil(F.log2(F.greatest(n, F.lit(1)))).cast("int")


def bin_of(h: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, (F.lit(64) - bits).cast("int"))


def sketch(hashes: Column, n: Column) -> Column:
    """Minimum of every bin: after sorting, the first hash of each run with the same leading bits."""
    bits = part_of(n) + 1
    return bound(
        F.struct(F.sort_array(hashes).alias("sorted"), bits.alias("bits")),
        lambda x: F.filter(x["sorted"], lambda h, i: (i == 0) | (bin_of(h, x["bits"]) != bin_of(x["sorted"][F.greatest(i - 1, F.lit(0))], x["bits"]))),
    )


def item_index(items: DataFrame) -> DataFrame:
    """(hash, item_id, first part from which the hash is its bin's minimum in the item's sketch)."""
    flat = items.select("item_id", F.posexplode(F.sort_array("hashes")).alias("i", "hash"), F.sort_array("hashes").alias("all"))
    before = F.when(F.col("i") > 0, F.col("all")[F.greatest(F.col("i") - 1, F.lit(0))])
    # leading bits that a hash shares with the smaller one before it: from one bit more on it has a bin of its own
    shared = F.coalesce(F.lit(64) - F.length(F.bin(F.col("hash").bitwiseXOR(before))).cast("int"), F.lit(-1))
    return flat.select("hash", "item_id", F.greatest(shared, F.lit(0)).alias("part"))


def candidates(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """Distinct (doc, body, item_id) pairs that share a sketch value, or any shingle for small items."""
    need = F.ceil(F.size("hashes") * F.lit(containment))
    sure, small = items.filter((need >= SURE) & (F.col("k") == k)), items.filter((need < SURE) | (F.col("k") < k))
    held = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    hashed = held.select("doc", "body", F.array_distinct(bound(word_array(F.col("text")), _runs_of(k, "hash"))).alias("hashes"))
    mins = hashed.select("doc", "body", F.coalesce(part_of(F.size("hashes")), F.lit(0)).alias("of"), F.explode(sketch(F.col("hashes"), F.size("hashes"))).alias("hash"))
    found = mins.join(sized(item_index(sure)), "hash").filter(F.col("part") <= F.col("of") + 1).select("doc", "body", "item_id")
    for row in small.select("k").distinct().collect():  # at most k lengths
        index = small.filter(F.col("k") == row.k).select("item_id", F.explode("hashes").alias("hash"))
        every = held.select("doc", "body", F.explode(bound(word_array(F.col("text")), _runs_of(row.k, "hash"))).alias("hash"))
        found = found.unionByName(every.join(sized(index), "hash").select("doc", "body", "item_id"))
    return found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT, k: int = SHINGLE) -> DataFrame:
    """Verified pairs: doc, body, item_id, n_item_shingles, n_shared, by exact comparison of shingle texts."""
    items = written(item_shingles(benchmark, k), "items")
    pairs = written(candidates(docs, items, containment, k), "item-pairs")
    texts = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), "text")
    held = texts.join(sized(pairs), ["doc", "body"]).select("doc", "body", "item_id", F.col("text").cast("string").alias("text"))
    met = held.join(items.select("item_id", "k", "texts"), "item_id")
    lengths = [r.k for r in items.select("k").distinct().collect()]  # at most k lengths
    each = [F.when(F.col("k") == n, bound(word_array(F.col("text")), _runs_of(n, "text"))) for n in lengths]
    shared = F.size(F.array_intersect("texts", F.coalesce(*each, F.array().cast("array<string>")))).cast("long")
    exact = met.select("doc", "body", "item_id", F.size("texts").cast("long").alias("n_item_shingles"), shared.alias("n_shared"))
    return exact.filter(1000 * F.col("n_shared") >= int(containment * 1000) * F.col("n_item_shingles")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that hold no benchmark item; columns as they came."""
    hit = written(contaminated(docs, benchmark, containment).select("doc", "body").distinct(), "contaminated")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"))
    return held.join(sized(hit), ["doc", "body"], "left_anti").select("row.*")
