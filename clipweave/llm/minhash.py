"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

A document's set becomes 200 minima. Runs of five minima are 40 band keys; the low four bits of
every minimum are packed into 13 numbers. Equal sets are one node from the start, so copies cost
nothing later. In each band bucket all nodes are compared with the most central one only (the one
with the most partners in all its buckets): packed bits give a collision-corrected estimate, and
pairs above a limit 4.7 deviations under the threshold are confirmed on full sets. Buckets whose
nodes are then not all in one component are unsettled; their remaining pairs are compared in
blocks of bounded size on full sets, and only pairs that join components leave a block.

Defined cases: null or empty texts (or none but white space) have an empty set and link with
nothing; with a null doc_id a row is not linked and its component is null; rows are nodes by
their sets, so equal rows are linked; extra input columns are carried by ``deduplicate`` and
ignored otherwise; an empty table gives an empty result. A node is named by 64 bits of its set's
digest, and shingles by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import dealt, pieces, screened, side, spread_join, words_of, written

SHINGLE = 5
#: per cent of the union that two sets must share
SIMILARITY = 75
BANDS, ROWS = 40, 5
HASHES = BANDS * ROWS
#: bits kept of each minimum
BITS = 4
LANES = 64 // BITS
PACKED = -(-HASHES // LANES)
#: packed minima may differ in so many places: the estimate is then 0.6 or more
MOST_DIFFERENT = int(HASHES * (1 - 0.6) * (1 - 2.0**-BITS))
#: nodes of a block of an unsettled bucket
BLOCK = 1024


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles."""
    ids, words, counts = words_of(texts, lower=True)
    named = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False) if len(words) else np.zeros(0, np.uint64)
    h = named[ids]
    rolled = np.zeros(max(len(h) - SHINGLE + 1, 0), np.uint64)
    for j in range(SHINGLE):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(rolled)]
    rolled = _mixed(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(rolled[at : at + n - SHINGLE + 1]))
        elif n:
            whole = hashlib.blake2b(h[at : at + n].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _minima(sets: list[np.ndarray]) -> np.ndarray:
    rng = np.random.default_rng(20)
    times, plus = rng.integers(0, 1 << 31, HASHES) * 2 + 1, rng.integers(0, 1 << 32, HASHES)
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(x * np.uint32(times[k]) + np.uint32(plus[k]), starts)
    return out


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1), pa.int64()))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc, body, n, node (null for an empty set), band keys and packed low bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1_000_000):
            sets = shingle_sets(batch.column(2))
            full = [i for i, s in enumerate(sets) if len(s)]
            take = np.zeros(len(sets), np.int64)
            take[full] = np.arange(len(full))
            bands, packed = np.zeros((max(len(full), 1), BANDS), np.int64), np.zeros((max(len(full), 1), PACKED), np.int64)
            if full:
                minima = _minima([sets[i] for i in full]).astype(np.uint64)
                key = np.zeros((len(full), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
                bands = key.view(np.int64)
                low = np.zeros((len(full), PACKED * LANES), np.uint64)
                low[:, :HASHES] = minima & np.uint64((1 << BITS) - 1)
                low = low.reshape(len(full), PACKED, LANES) << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))
                packed = np.bitwise_or.reduce(low, axis=2).view(np.int64)
            node = pa.array([node_of(s) if len(s) else None for s in sets], pa.int64())
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, node, _lists(bands[take]), _lists(packed[take])], names)

    names = ["doc", "body", "n", "node", "bands", "packed"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc long, body long, n long, node long, bands array<long>, packed array<long>")


def full_sets(texts: DataFrame) -> DataFrame:
    """node, n and its shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 2_000_000):
            sets = [s for s in shingle_sets(batch.column(0)) if len(s)]
            ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
            flat = pa.array(np.concatenate(sets).view(np.int64) if sets else [], pa.int64())
            columns = [pa.array(map(node_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["node", "n", "shingles"]
    return texts.select("text").mapInArrow(run, "node long, n long, shingles array<long>")


def n_different(a: Column, b: Column) -> Column:
    """Places where two packed rows of minima differ."""
    ones = F.lit(0x1111111111111111).cast("long")

    def lanes(n: Column, x: Column) -> Column:
        once = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        return n + F.bit_count(once.bitwiseOR(F.shiftrightunsigned(once, 2)).bitwiseAND(ones))

    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseXOR(y)), F.lit(0), lanes)


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed minima, corrected for low bits that agree by chance."""
    chance = 2.0**-BITS
    return (1 - n_different(a, b) / HASHES - chance) / (1 - chance)


def similar(common: Column, n: Column, m: Column) -> Column:
    return 100 * common >= SIMILARITY * (n + m - common)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b), a written table, whose full sets are similar.

    Only sets that a screen takes for members of pairs are shuffled, whatever the number of pairs.
    Adaptive execution may split the partners of one that many pairs have.
    """
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    left, right = (screened(x, pairs, [on]).filter("_hit").drop("_hit") for x, on in ((left, "a"), (right, "b")))
    both = left.join(side(pairs), "a").join(dealt(right), "b")
    return both.filter(similar(F.size(F.array_intersect("s_a", "s_b")), F.col("n_a"), F.col("n_b"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable, by labels that spread over links and jump to their own labels."""
    edges = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        known = side(labels)
        near = edges.join(known.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = known.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("mid"))
        jump = known.select(F.col("node").alias("mid"), F.col("comp").alias("far"))
        step = written(lower.join(jump, "mid", "left").select("node", "old", F.least("mid", F.coalesce("far", "mid")).alias("comp")), "labels")
        labels = step.select("node", "comp")
        if not step.filter("old <> comp").head(1):
            return labels


def _block_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate links of sorted (key, i, j) groups; a group has at most two blocks of nodes.

    Whole hashes are compared, as the check after it does, so every pair found here is a link: its
    nodes join components at once, and further pairs between those are not compared.
    """

    def links(group: pd.DataFrame) -> list[tuple[int, int]]:
        nodes, comp, block = group["node"].to_numpy(), group["comp"].to_numpy().copy(), group["block"].to_numpy()
        sets = list(group["shingles"])
        sizes = np.array([len(s) for s in sets])
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        mark, found = np.zeros(ids.max() + 1, np.int32), []
        for x in range(len(nodes) - 1):
            able = (comp[x + 1 :] != comp[x]) & (100 * np.minimum(sizes[x], sizes[x + 1 :]) >= SIMILARITY * np.maximum(sizes[x], sizes[x + 1 :]))
            if group["i"].iat[0] != group["j"].iat[0]:
                able &= block[x + 1 :] != block[x]
            if not able.any():
                continue
            own = ids[starts[x] : starts[x] + sizes[x]]
            mark[own] = 1
            common = np.add.reduceat(mark[ids[starts[x + 1] :]], starts[x + 1 :] - starts[x + 1])
            mark[own] = 0
            union = sizes[x] + sizes[x + 1 :] - common
            for y in np.flatnonzero(able & (100 * common >= SIMILARITY * union)) + x + 1:
                if comp[y] != comp[x]:
                    found.append((int(nodes[x]), int(nodes[y])))
                    comp[comp == comp[y]] = comp[x]
        return found

    rest: pd.DataFrame | None = None
    for frame in _with_end(batches):
        whole = rest if frame is None else frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if whole is None or not len(whole):
            continue
        key = whole[["key", "i", "j"]].to_numpy()
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(whole)]
        stop = len(cuts) - 1 if frame is None else len(cuts) - 2
        out = [p for a, b in zip(cuts[:stop], cuts[1 : stop + 1]) if b - a > 1 for p in links(whole.iloc[a:b])]
        rest = None if frame is None else whole.iloc[cuts[stop] :]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame | None]:
    for batch in batches:
        yield batch.to_pandas()
    yield None


def unsettled_links(members: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Further candidate links of buckets that hold more than one component."""
    held = members.select("key", "node").join(side(labels), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    held = written(held, "bucket-comps")
    mixed = held.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    mixed = written(mixed.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "mixed-buckets")
    rows = spread_join(held, mixed, ["key"], F.col("node"), growing=True).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block")
    # rows of one node are few: one per band
    rows = rows.join(dealt(sets.select("node", "shingles")), "node")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_block_links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc, body, n, component_id (least doc_id of the component)."""
    rows = written(sketches(docs), "sketches")
    named = rows.filter(F.col("doc").isNotNull() & F.col("node").isNotNull())
    first = F.min(F.struct("doc", "body")).alias("first")
    nodes = written(named.groupBy("node").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("packed").alias("packed")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-bands")
    members = written(spread_join(keys, shared, ["key"], F.col("node"), growing=True), "members")
    scores = members.groupBy("node").agg(F.sum("m").alias("score"))
    ranked = written(members.join(dealt(scores.join(dealt(nodes.select("node", "n", "packed")), "node")), "node"), "ranked")
    hubs = ranked.groupBy("key").agg(F.max(F.struct("score", "node", "n", "packed")).alias("hub"))
    hubs = written(hubs.select("key", F.col("hub.node").alias("b"), F.col("hub.n").alias("hub_n"), F.col("hub.packed").alias("hub_packed")), "hubs")
    # a bucket of m nodes meets its hub in m / BLOCK tasks
    sizes = ranked.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("tasks")).distinct()
    copies = hubs.join(dealt(sizes), "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")
    salted = ranked.withColumn("salt", F.pmod(F.xxhash64("node"), F.ceil(F.col("m") / BLOCK)).cast("int"))
    met = salted.join(dealt(copies), ["key", "salt"]).filter(F.col("node") != F.col("b"))
    near_size = 100 * F.least("n", "hub_n") >= SIMILARITY * F.greatest("n", "hub_n")
    pairs = met.filter(near_size & (n_different(F.col("packed"), F.col("hub_packed")) <= MOST_DIFFERENT))
    pairs = written(pairs.select(F.col("node").alias("a"), "b").distinct(), "pairs")
    wanted = nodes.join(dealt(members.select("node").distinct()), "node", "left_semi").select("first.doc", "first.body")
    wanted = written(wanted, "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))
    texts = screened(texts, wanted, ["doc", "body"]).filter("_hit").drop("_hit").join(side(wanted), ["doc", "body"])
    sets = written(full_sets(texts).dropDuplicates(["node"]), "sets")
    links = written(confirmed(pairs, sets), "links")
    labels = components(links)
    more = written(confirmed(written(unsettled_links(members, labels, sets), "late-pairs"), sets), "late-links")
    if more.head(1):
        labels = components(links.unionByName(more))
    least = nodes.select("node", F.col("first.doc").alias("doc")).join(side(labels), "node", "left").select("node", "doc", F.coalesce("comp", "node").alias("comp"))
    least = written(least, "node-comps")
    lowest = written(least.groupBy("comp").agg(F.min("doc").alias("component_id")), "lowest")
    known = written(spread_join(least.select("node", "comp"), lowest, ["comp"], F.col("node"), 4, growing=True).select("node", "component_id"), "node-ids")
    out = rows.select("doc", "body", "n", "node").join(dealt(known), "node", "left")
    return out.select("doc", "body", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The documents that are the least of their component (or have no id), columns as they came."""
    gone = written(near_duplicates(docs).filter("doc > component_id").select("doc", "body").distinct(), "near-copies")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"))
    held = screened(held, gone, ["doc", "body"])
    # few rows that stay are hits, so hardly more than those that go are shuffled
    left = held.filter("_hit").join(side(gone), ["doc", "body"], "left_anti")
    return held.filter("not _hit").unionByName(left.select(*held.columns)).select("row.*")
