"""Substring dedup by hashing units of text: the earliest occurrence of a unit stays, later ones are cut out.

Units are lines, paragraphs, or passages. A passage begins where a sentence or a line begins, or at
a capitalised word, and runs on to the first such place after ``PASSAGE_WORDS`` words; so passages
overlap, are found inside lines and across line breaks, and a text is cut only where that many
words in a row stand in an earlier place. Overlapping cuts are joined. Letters are compared without
regard to case, but capitals set the borders: a passage copied in capitals only is another one.

Defined cases: a null or empty text has no units to cut; units shorter than the minimum never
count; with a null doc_id nothing is registered and nothing cut; a unit that repeats inside its
own document is cut there too; equal rows (same doc_id and text) are one document and get equal
spans; a text without such places is one passage; extra input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.common import SPACES, pieces, sized, written

#: units with fewer words are left alone
MIN_WORDS = 8
UNITS = {"line": re.compile(r"[^\n]+"), "paragraph": re.compile(r"(?:[^\n]|\n(?!\n))+")}
WORD = re.compile(r"[^ \t\n\v\f\r]+")
#: words of a passage at least
PASSAGE_WORDS = 40
#: white space that parts two sentences or lines, or stands in front of a capital
CAPITALS = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Lu"]
CAPITAL = "[{}]|(?=[\U00010000-\U0010ffff])[{}]".format("".join(c for c in CAPITALS if c < "\U00010000"), "".join(c for c in CAPITALS if c >= "\U00010000"))
BORDER = re.compile(rf"(?<=[.!?])[ \t\v\f\r\n]+|[ \t\v\f\r]+(?:\n[ \t\v\f\r\n]*|(?={CAPITAL}))|\n[ \t\v\f\r\n]*")
DIGEST = xxhash.xxh3_128_digest
#: bytes of text whose units are hashed at once; a longer text is hashed alone
PIECE = 1_000_000
#: digests found twice or more that are broadcast at most (about 15 MB); more meet the units by a shuffle
FEW = 100_000
#: a digest found more often than this is broadcast on its own
FREQUENT = 10_000


def _units(text: str, unit: str, min_words: int) -> Iterator[tuple[list[str], int, int]]:
    """(words, start, end) of every line or paragraph that is long enough."""
    for m in UNITS[unit].finditer(text):
        words = WORD.findall(m[0])
        if len(words) >= min_words:
            yield words, m.start(), m.end()


def _passages(text: str, min_words: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(normalised sentences, their first and last place, the last sentence of the passage each begins; -1: none)."""
    said, counts, begins, ends = [], [], [], []
    at = 0
    for m in [*BORDER.finditer(text), None]:
        to = m.start() if m else len(text)
        words = text[at:to].encode().lower().split()  # of bytes: A-Z alone, and the six characters of SPACES
        if words:
            said.append(b" ".join(words))
            counts.append(len(words))
            begins.append(at)
            ends.append(to)
        at = m.end() if m else to
    if said:  # white space that is no border stands at both ends of the text alone
        begins[0] += len(text[begins[0] : ends[0]]) - len(text[begins[0] : ends[0]].lstrip(SPACES))
        ends[-1] = begins[-1] + len(text[begins[-1] : ends[-1]].rstrip(SPACES))
    so_far = np.cumsum([0, *counts])
    last = np.searchsorted(so_far, so_far[:-1] + min_words) - 1
    return said, np.array(begins, np.int32), np.array(ends, np.int32), np.where(last < len(said), last, -1)


def _columns(text: str, unit: str, least: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(16 bytes of digest, start, end) of every unit of a text."""
    if unit == "passage":
        said, begins, ends, last = _passages(text, least)
        first = np.flatnonzero(last >= 0)
        keys = [DIGEST(b" ".join(said[k : to + 1])) for k, to in zip(first.tolist(), last[first].tolist())]
        return b"".join(keys), begins[first], ends[last[first]]
    found = list(_units(text, unit, least))
    keys = [DIGEST(" ".join(words).encode().lower()) for words, _, _ in found]
    return b"".join(keys), *(np.array([f[i] for f in found], np.int32) for i in (1, 2))


def unit_digests(docs: DataFrame, unit: str = "passage", min_words: int | None = None) -> DataFrame:
    """One row per unit: 128-bit digest of its normalised words, document, and offsets in code points."""
    least = min_words if min_words is not None else PASSAGE_WORDS if unit == "passage" else MIN_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE):
            made = [_columns(text, unit, least) for text in batch.column(1).to_pylist()]
            n = [len(start) for _, start, _ in made]
            digests = np.frombuffer(b"".join(k for k, _, _ in made), ">i8").reshape(-1, 2).astype(np.int64)
            of = [pa.array(np.repeat(batch.column(i).to_numpy(zero_copy_only=False), n)) for i in (0, 2)]
            at = [pa.array(np.concatenate([m[i] for m in made])) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), *of, *at], names)

    names = ["h1", "h2", "doc", "body", "start", "end"]
    texts = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    texts = texts.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("body"))
    return texts.mapInArrow(run, "h1 long, h2 long, doc long, body long, start int, end int")


def _met(units: DataFrame, shared: DataFrame) -> DataFrame:
    """Units with the earliest place of their digest. Frequent digests, at most ``FEW``, are broadcast; the rest
    are met by a shuffle that needs no salts, as none of them fills a task."""
    total = shared.agg(F.sum("n")).first()[0]
    often = F.col("n") > max(FREQUENT, total // FEW)
    hot = F.broadcast(shared.filter(often))
    rest = units.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").join(shared.filter(~often), ["h1", "h2"])
    return units.join(hot, ["h1", "h2"]).unionByName(rest)


def cut_spans(docs: DataFrame, unit: str = "passage", min_words: int | None = None) -> DataFrame:
    """Per document with something to cut: doc, body, n_removed, spans (sorted offsets of what is cut).

    Occurrences are ranked by (doc_id, text hash, offset). Digests that occur once leave after a
    pre-aggregated count; the rest meet their earliest place as a broadcast of checked size, or,
    but for the most frequent ones, by a shuffle. Units of equal rows are counted once per document.
    """
    units = written(unit_digests(docs, unit, min_words), "units")
    place = F.struct("doc", "body", "start")
    firsts = units.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n"))
    shared = written(firsts.filter("n > 1"), "unit-firsts")
    small = sized(shared, FEW)
    met = units.join(small, ["h1", "h2"]) if small is not shared else _met(units, shared)
    later = met.filter(place > F.col("first")).select("doc", "body", "start", "end").distinct()
    so_far = Window.partitionBy("doc", "body").orderBy("start", "end")
    apart = later.withColumn("apart", F.coalesce(F.col("start") > F.max("end").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    joined = apart.withColumn("part", F.sum(F.col("apart").cast("int")).over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
    joined = joined.groupBy("doc", "body", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = F.array_sort(F.collect_list(F.struct("start", "end")))
    return joined.groupBy("doc", "body").agg(F.count(F.lit(1)).alias("n_removed"), spans.alias("spans"))


def dedup(docs: DataFrame, unit: str = "passage", min_words: int | None = None) -> DataFrame:
    """Each input row as ``row`` with n_removed and spans; a row with nothing to cut has none."""
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"))
    out = held.join(cut_spans(docs, unit, min_words), ["doc", "body"], "left")
    return out.select("row", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>")).alias("spans"))


def remaining(text: str | None, spans: list) -> str | None:
    """A text without its cut spans; each unit's line end stays, so other offsets can be followed."""
    if text is None:
        return None
    at, out = 0, []
    for start, end in spans:
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])
