"""Language identification by cross-parsing: suffix automata of labelled text, fewest phrases win.

A bounded sample of labelled text per language becomes a suffix automaton. A text is cut greedily
into the longest phrases that occur in a language's sample (a symbol that never occurs is a phrase
of its own). The phrases times the bits that name a place in the sample, per letter of the text,
estimate the cross entropy; the language with the least wins.

Texts are lower-cased and runs of other characters than letters and marks become one space. They
are parsed in stretches of ``STRETCH`` code points side by side, so the whole of a long text is
read and a phrase ends at most once more per stretch in every language.

Defined cases: ``und`` with score 0 if the text is null or has no letter, or nothing was learned;
equal estimates go to the language that sorts first; a single learned language scores 1; a null
doc_id is not held out and nothing is learned from it; repeated rows are predicted alike; extra
input columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.llm.common import packed_arcs, pieces, sized, worker_tables

#: code points that a language is learned from at most, and that all together are
REFERENCE, REFERENCES = 80_000, 800_000
#: code points that one document adds at most, from a place that its id fixes
PART = 1_000
#: code points of a text that are parsed in one go
STRETCH = 512
FOLDS = 5
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def normalised(text: Column) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


# ------------------------------------------------------------------------------------ learning


def sample(docs: DataFrame, reference: int = REFERENCE, references: int = REFERENCES, part: int = PART) -> tuple[DataFrame, int]:
    """(lang, place, text of the chosen documents; code points per language).

    A first count of the rows per language thins each one out by a hash, so that the ranking which
    picks the documents sees about four times as many as it keeps, however common a language is.
    """
    text = F.col("text").cast("string")
    known = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & text.isNotNull())
    counts = known.groupBy(F.col("lang").cast("string").alias("lang")).count()
    languages = counts.count()
    size = max(1, min(reference, references // max(1, languages)))
    most = -(-size // part)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("draw")), F.lit(1 << 40))
    rows = known.select(F.col("lang").cast("string").alias("lang"), text.alias("text"), F.col("doc_id").cast("long").alias("doc"), draw.alias("draw"))
    rows = rows.join(sized(counts), "lang").filter(F.col("draw") * F.col("count") < F.lit(4 * most * (1 << 40))).filter(has_letter(F.col("text")))
    chosen = rows.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc", F.xxhash64("text")))).filter(F.col("place") <= most)
    clean = normalised(F.col("text"))
    begin = 1 + F.pmod(F.col("draw"), F.greatest(F.length(clean) - part, F.lit(1)))
    return chosen.select("lang", "place", F.substring(clean, begin.cast("int"), F.lit(part)).alias("text")), size


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of every state; state 0 is the start, and exactly the substrings of the text can be read."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for x in text:
        new = len(step)
        step.append({})
        length.append(length[last] + 1)
        at = last
        while at >= 0 and x not in step[at]:
            step[at][x] = new
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            to = step[at][x]
            if length[to] == length[at] + 1:
                link.append(to)
            else:
                twin = new + 1
                link.append(twin)
                step.append(dict(step[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = twin
                while at >= 0 and step[at].get(x) == to:
                    step[at][x] = twin
                    at = link[at]
        last = new
    return step


class Automaton(NamedTuple):
    """A suffix automaton in two arrays: state s reads symbol x if cells[base[s] + x] belongs to s."""

    letters: np.ndarray  # symbol of every code point up to the largest one; 0 for those never seen
    first: np.ndarray  # state after each symbol from the start, 0 for none
    base: np.ndarray
    cells: np.ndarray  # owner << 32 | next state, owner -1 where empty
    size: int

    @staticmethod
    def of(text: str) -> Automaton:
        step = suffix_automaton(text)
        alphabet = sorted(set(text))
        symbol = {x: i for i, x in enumerate(alphabet, 1)}
        letters = np.zeros(ord(alphabet[-1]) + 2 if alphabet else 1, np.uint16)
        letters[[ord(x) for x in alphabet]] = range(1, len(alphabet) + 1)
        base, cells = packed_arcs([{symbol[x]: to for x, to in arcs.items()} for arcs in step], len(alphabet) + 1)
        first = np.zeros(len(alphabet) + 1, np.int64)
        for x, to in step[0].items():
            first[symbol[x]] = to
        return Automaton(letters, first, base, cells, len(text))

    def phrases(self, points: np.ndarray, active: np.ndarray) -> np.ndarray:
        """Phrases of each stretch; ``points`` has one column per stretch, longest first, ``active[t]`` of them reach row t."""
        marks = np.where(points < len(self.letters), self.letters[np.minimum(points, len(self.letters) - 1)], 0)
        state, count = np.zeros(points.shape[1], np.int64), np.zeros(points.shape[1], np.int64)
        for row, n in zip(marks, active.tolist()):
            at, x = state[:n], row[:n]
            cell = self.cells[self.base[at] + x]
            reads = (cell >> 32) == at
            onward = np.where(reads, cell & 0xFFFFFFFF, self.first[x])
            # a phrase ends where nothing goes on from inside the sample; a symbol unknown to the sample is one by itself
            count[:n] += (~reads & (at > 0)).view(np.int8) + (onward == 0).view(np.int8)
            state[:n] = onward
        return count + (state > 0)


def learn(docs: DataFrame, reference: int = REFERENCE, references: int = REFERENCES, part: int = PART) -> dict[str, Automaton]:
    """The automaton of each language, built where its sample lies and sent to the driver; ``references`` bounds them all."""
    chosen, size = sample(docs, reference, references, part)
    names = ["lang", "letters", "first", "base", "cells", "size"]

    def build(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["place", "text"]).to_pylist(), key=lambda r: r["place"])
        made = Automaton.of("".join(r["text"] for r in rows)[:size])
        arrays = [pa.array([x.astype(np.int64)], pa.list_(pa.int64())) for x in made[:4]]
        return pa.table([table["lang"].combine_chunks()[:1], *arrays, pa.array([made.size])], names)

    rows = chosen.groupBy("lang").applyInArrow(build, "lang string, letters array<long>, first array<long>, base array<long>, cells array<long>, size long")
    found = {r["lang"]: r for batch in rows.toArrow().to_batches() for r in ({n: batch.column(i)[k] for i, n in enumerate(names)} for k in range(batch.num_rows))}
    flat = lambda r, n: r[n].values.to_numpy(zero_copy_only=False)
    return {
        str(lang): Automaton(flat(r, "letters").astype(np.uint16), flat(r, "first"), flat(r, "base").astype(np.int32), flat(r, "cells"), r["size"].as_py())
        for lang, r in sorted(found.items(), key=lambda x: str(x[0]))
    }


# ----------------------------------------------------------------------------------- predicting


def _stretches(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points, one column per stretch; how many reach each row; text of each stretch; code points per text)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    per_text = -(-lengths // STRETCH)
    text = np.repeat(np.arange(len(texts)), per_text)
    inside = (np.arange(len(text)) - np.repeat(np.cumsum(per_text) - per_text, per_text)) * STRETCH
    size = np.minimum(STRETCH, lengths[text] - inside)
    begin = (np.cumsum(lengths) - lengths)[text] + inside
    longest = np.argsort(-size, kind="stable")
    text, size, begin = text[longest], size[longest], begin[longest]
    rows = np.arange(size[0] if len(size) else 0)
    columns = points[np.minimum(begin[None, :] + rows[:, None], len(points) - 1)] if len(size) else np.zeros((0, 0), np.uint32)
    return columns, np.searchsorted(-size, -rows, side="left"), text, lengths


def bits(texts: list[str], languages: list[Automaton]) -> np.ndarray:
    """Estimated bits per code point of every text (row) under every language (column); empty texts cost 0."""
    columns, active, text, lengths = _stretches(texts)
    out = np.zeros((len(texts), len(languages)))
    for k, language in enumerate(languages):
        phrases = np.bincount(text, language.phrases(columns, active), len(texts))
        out[:, k] = phrases * np.log2(language.size + 2) / np.maximum(lengths, 1)
    return out


def predict(docs: DataFrame, languages: dict[str, Automaton]) -> DataFrame:
    """doc, lang_pred, score of every row by its whole text; the score is the winner's lead over the second, as a share."""
    names, model = ["doc", "lang_pred", "score"], uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast((list(languages), [tuple(a) for a in languages.values()]))  # of bounded size, see learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, automata = worker_tables("langid", model, lambda: (shared.value[0], [Automaton(*a) for a in shared.value[1]]))
        for batch in pieces(batches, "text"):
            texts, told = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False) & bool(labels)
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if told.any():
                cost = bits(pc.fill_null(texts, "").filter(pa.array(told)).to_pylist(), automata)
                best[told] = np.argmin(cost, 1)
                two = np.sort(cost, 1)[:, :2]
                score[told] = 1 - two[:, 0] / two[:, 1] if cost.shape[1] > 1 else 1.0
            label = pa.array(labels + [UNKNOWN], pa.string()).take(pa.array(np.where(told, best, len(labels))))
            yield pa.RecordBatch.from_arrays([batch.column(0), label, pa.array(score)], names)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), normalised(text).alias("text"), has_letter(text).alias("told"))
    return rows.mapInArrow(run, "doc long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc, held_out, lang_pred, score; learned from the rows that are not held out."""
    return predict(docs, learn(docs)).select("doc", held_out(F.col("doc")).alias("held_out"), "lang_pred", "score")
