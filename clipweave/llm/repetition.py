"""Quality rules on repetition: suffix arrays of words and their longest-common-prefix intervals.

Defined cases: a null or empty text has no words and fails the word minimum; repeated rows are
judged one by one; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.llm.common import pieces, words_of

#: characters that count as symbols; fixed by the result contract
SYMBOLS = "#*$%&|<>"
#: a repeat is at least this many words long
MIN_REPEAT = 5
#: a text may have this share of its words inside repeats
MAX_COVERED = 0.45
#: and no repeat longer than this many words
MAX_REPEAT = 60

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "covered_words long, longest_repeat long, n_repeats long, spans array<struct<start:int,end:int>>"
)


def suffix_order(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of every text in order, text by text, and the words each shares with the one before.

    Prefix doubling: ranks by 1, 2, 4, ... words; suffixes alone in their rank drop out of later
    rounds. The kept ranks of all rounds give the common prefix of neighbours by descent.
    """
    n = len(ids)
    ends = np.repeat(np.cumsum(counts), counts)
    text = np.repeat(np.arange(len(counts)), counts)
    key = text * (int(ids.max(initial=0)) + 1) + ids
    order = np.argsort(key, kind="stable")
    slot = np.arange(n)
    ranks = [np.empty(n, np.int64)]

    def settle(keys: np.ndarray, at: np.ndarray, rank: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order[at]] = at[np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))]
        alone = new & np.append(new[1:], True)
        return at[~alone]

    active = settle(key[order], slot, ranks[0])
    h = 1
    while len(active):
        rank = ranks[-1]
        pos = order[active]
        after = pos + h
        more = after < ends[pos]
        second = np.where(more, rank[np.where(more, after, 0)] + 1, 0)
        keys = rank[pos] * (n + 1) + second
        turn = np.argsort(keys, kind="stable")
        order[active] = pos[turn]
        ranks.append(rank.copy())
        active = settle(keys[turn], active, ranks[-1])
        h *= 2
    lcp = np.zeros(n, np.int64)
    pair = np.flatnonzero(np.append(False, ranks[0][order[1:]] == ranks[0][order[:-1]])) if n else slot
    a, b = order[pair - 1], order[pair]
    for level in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        inside &= (a < ends[order[pair - 1]]) & (b < ends[order[pair]])
        same = np.zeros(len(pair), bool)
        same[inside] = ranks[level][a[inside]] == ranks[level][b[inside]]
        step = np.where(same, 1 << level, 0)
        lcp[pair] += step
        a, b = a + step, b + step
    return order, lcp


def intervals(order: np.ndarray, lcp: np.ndarray, before: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """LCP intervals (first rank, last rank, words) of at least ``least`` words that are left-maximal.

    ``before`` is the word in front of each suffix. Equal words in front of all suffixes of an
    interval mean that a longer repeat holds the same places, so the interval is not reported.
    """
    turn = np.cumsum(np.append(False, before[order[1:]] != before[order[:-1]]))
    found, stack = [], []
    high = np.flatnonzero(lcp >= least)
    last = -2
    for r in [*high.tolist(), len(lcp)]:
        if r != last + 1 or r == len(lcp):
            while stack:
                left, words = stack.pop()
                if turn[last] > turn[left]:
                    found.append((left, last, words))
        if r == len(lcp):
            break
        left = r - 1
        words = int(lcp[r])
        while stack and stack[-1][1] > words:
            left, longer = stack.pop()
            if turn[r - 1] > turn[left]:
                found.append((left, r - 1, longer))
        if not stack or stack[-1][1] < words:
            stack.append((left, words))
        last = r
    return found


def _measure(texts: pa.Array, least: int) -> list[pa.Array]:
    ids, _, counts = words_of(texts)
    n, ends = len(ids), np.cumsum(counts)
    order, lcp = suffix_order(ids, counts)
    reach = np.zeros(n, np.int64)
    if n:
        reach[order] = np.maximum(lcp, np.append(lcp[1:], 0))
    which = np.repeat(np.arange(len(counts)), counts)

    def covered(long: np.ndarray, words: np.ndarray) -> np.ndarray:
        edge = np.zeros(n + 1, np.int64)
        np.add.at(edge, long, 1)
        np.add.at(edge, long + words, -1)
        return np.cumsum(edge)[:n] > 0

    three = np.flatnonzero(reach >= 3)
    triple = covered(three, np.full(len(three), 3))
    long = np.flatnonzero(reach >= least)
    inside = covered(long, reach[long])
    starts = np.flatnonzero(inside & ~np.append(False, inside[:-1] & (which[1:] == which[:-1]))) if n else long
    stops = np.flatnonzero(inside & ~np.append(inside[1:] & (which[1:] == which[:-1]), False)) + 1 if n else long
    front = np.append(-1, ids[:-1]) if n else ids
    first = ends - counts
    front[first[counts > 0]] = -1 - np.flatnonzero(counts > 0)
    firsts = np.array([which[order[left]] for left, _, _ in intervals(order, lcp, front, least)] if n else [], np.int64)
    longest = np.zeros(len(counts), np.int64)
    np.maximum.at(longest, which, reach)
    per = np.bincount(which[starts], minlength=len(counts))
    spans = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(per)), pa.int32()),
        pa.StructArray.from_arrays(
            [pa.array(starts - first[which[starts]], pa.int32()), pa.array(stops - first[which[starts]], pa.int32())],
            ["start", "end"],
        ),
    )
    count = lambda mask: pa.array(np.bincount(which[mask], minlength=len(counts)))
    return [pa.array(counts), count(triple), count(inside), pa.array(longest), pa.array(np.bincount(firsts, minlength=len(counts))), spans]


def _characters(texts: pa.Array) -> tuple[list[int], list[int], list[int]]:
    chars, symbols, repeats = [], [], []
    for t in texts.to_pylist():
        t = t or ""
        chars.append(len(t) - sum(map(t.count, " \t\n\v\f\r")))
        symbols.append(sum(map(t.count, SYMBOLS)))
        lines = [x for x in t.split("\n") if x.strip(" \t\n\v\f\r")] if "\n" in t else []
        repeats.append(len(lines) - len(set(lines)))
    return chars, symbols, repeats


def repetition(docs: DataFrame, min_repeat: int = MIN_REPEAT) -> DataFrame:
    """Word counts, repeats and their spans (word offsets, end exclusive) per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column(1)
            words, triple, inside, longest, n, spans = _measure(texts, min_repeat)
            chars, symbols, lines = (pa.array(x, pa.int64()) for x in _characters(texts))
            out = [batch.column(0), words, chars, symbols, lines, triple, inside, longest, n, spans]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pc.cast(x, pa.int64()) if i < 9 else x for i, x in enumerate(out)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Add base_failed, long_repeat and kept."""
    per_mille = int(max_covered * 1000)
    return (
        measured.withColumn("base_failed", base_failed())
        .withColumn("long_repeat", F.col("longest_repeat") > max_repeat)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("long_repeat") & (1000 * F.col("covered_words") <= per_mille * F.col("n_words")))
    )
