"""Quality classifier: heuristic labelers, their reliabilities by EM, and a hashed linear scorer.

Six labelers vote on every document; EM over the counts of all vote patterns gives each one's
reliability and every document's posterior, without labels. The posteriors of a bounded sample
(``SAMPLE`` documents with the smallest id hashes) train a logistic model on hashed words, word
shapes and repeats, which then scores every whole text.

Defined cases: a text without words (null, empty or white space) is rejected with score 0; equal
rows get equal scores; extra input columns are carried by ``keep`` and ignored otherwise; an
empty table gives an empty result; if all posteriors fall on one side, that side's share is the score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.llm import weaklabels
from clipweave.llm.common import pieces, sized, sums, words_of, worker_tables, written

#: documents that the scorer is fitted on, at most
SAMPLE = 20_000
#: hash buckets of the scorer
BUCKETS = 1 << 15
#: a document stays from this score on
THRESHOLD = 0.5
#: common short words of the four languages; fixed values
STOPWORDS = frozenset(
    "the and of to in is was for with that on as by it are from or this be a an he at not "
    "der die das und ist nicht ein eine mit auf zu von den im für sich dem des als "
    "le la les de et un une est dans pour que qui pas sur au avec des en du par "
    "el los las y que es por con para una del no se lo un su al".split()
)
SYMBOLS = "#*$%&|<>{}~^=_\\"
MARKS = frozenset(SYMBOLS)
LETTERS, DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
LABELERS = ["symbols", "bars", "repeats", "shouting", "stopwords", "sentences"]
#: bytes of text measured at once; a longer text is measured alone
PIECE = 1_000_000
#: words whose traits a worker remembers, before it starts anew
REMEMBERED = 100_000
#: scale of shares in the linear model
SCALE = 30.0


class _Traits(dict):
    """Traits of distinct words, five flags and two buckets in one number; a worker keeps one table of them."""

    def __init__(self) -> None:
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, w: str) -> int:
        low = w.lower()
        shape = "a" if w.isalpha() else DIGITS.sub("0", LETTERS.sub("a", w))
        of_shape = self.shapes.get(shape)
        if of_shape is None:
            of_shape = self.shapes[shape] = zlib.crc32(b"shape " + shape.encode()) % BUCKETS
        loud, long = len(w) > 1 and w.isupper(), w.endswith("!!")
        stop, ends = low.strip(".,;:!?") in STOPWORDS and not loud, w[-1] in ".!?" and not long
        flags = stop | (not MARKS.isdisjoint(w)) << 1 | (w == "|") << 2 | ends << 3 | (long or (loud and len(w) > 2)) << 4
        number = flags | (zlib.crc32(low.encode()) % BUCKETS * BUCKETS + of_shape) << 5
        self[w] = number
        return number

    def of(self, words: list[str]) -> np.ndarray:
        """Of each word: stop word, has a symbol, is a bar, ends a sentence, shouts, bucket of the word, of its shape."""
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self) > REMEMBERED or len(self.shapes) > REMEMBERED:
            self.clear()
            self.shapes.clear()
        return np.stack([*[numbers >> j & 1 for j in range(5)], (numbers >> 5) // BUCKETS, (numbers >> 5) % BUCKETS])


def _votes(counts: np.ndarray, stop: np.ndarray, symbol: np.ndarray, bar: np.ndarray, ends: np.ndarray, shouts: np.ndarray, twice: np.ndarray) -> list[np.ndarray]:
    n = np.maximum(counts, 1)

    def accuse(share: np.ndarray, least: float) -> np.ndarray:
        return np.where(share >= least, -1, 0)

    def either(share: np.ndarray, good: float, bad: float, least: int) -> np.ndarray:
        return np.where(counts >= least, np.where(share >= good, 1, np.where(share <= bad, -1, 0)), 0)

    return [
        accuse((symbol - bar) / n, 0.1),
        accuse(bar / n, 0.1),
        accuse(twice / n, 0.2),
        accuse(shouts / n, 0.2),
        either(stop / n, 0.08, 0.02, 10),
        either(ends / n, 0.02, 0.003, 30),
    ]


def _measured(texts: pa.Array, traits_of: _Traits) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(word numbers, traits per distinct word, words per text, votes per labeler, repeats per word)."""
    ids, words, counts = words_of(texts)
    traits = traits_of.of(words.to_pylist())
    text = np.repeat(np.arange(len(counts)), counts)
    twice = np.zeros(len(ids), np.int64)
    twice[1:] = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
    # a word right after itself approves of nothing
    each = [sums(traits[j][ids] * (1 - twice) if j in (0, 3) else traits[j][ids], counts) for j in range(5)]
    return ids, traits, counts, _votes(counts, *each, sums(twice, counts)), twice


def votes(docs: DataFrame) -> DataFrame:
    """doc, body and the pattern of the six votes for every text that has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traits_of = worker_tables("word traits", BUCKETS, _Traits)
        for batch in pieces(batches, "text", PIECE):
            _, _, counts, cast, _ = _measured(batch.column(2), traits_of)
            number = np.zeros(len(counts), np.int64)
            for v in cast:
                number = number * 3 + v + 1
            kept = pa.array(counts > 0)
            columns = [batch.column(0), batch.column(1), pa.array(number, pa.int32())]
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in columns], ["doc", "body", "pattern"])

    return _texts(docs).mapInArrow(run, "doc long, body long, pattern int")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), F.col("text").cast("string").alias("text"))


def _features(ids: np.ndarray, traits: np.ndarray, twice: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and shares of one text's words, shapes and repeats."""
    repeat = zlib.crc32(b"again") % BUCKETS
    buckets = np.concatenate([traits[5][ids], traits[6][ids], np.full(int(twice.sum()), repeat)])
    where, n = np.unique(buckets, return_counts=True)
    return where, SCALE * n / len(ids)


def features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        traits_of = worker_tables("word traits", BUCKETS, _Traits)
        for batch in pieces(batches, "text", PIECE):
            ids, traits, counts, _, twice = _measured(batch.column(2), traits_of)
            ends = np.cumsum(counts)
            rows = [_features(ids[e - c : e], traits, twice[e - c : e]) if c else ([], []) for e, c in zip(ends, counts)]
            where = pa.array([r[0] for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), where, pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["doc", "body", "where", "share"])

    return _texts(docs).mapInArrow(run, "doc long, body long, where array<int>, share array<double>")


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[float], float, dict]:
    """(weight per bucket, intercept, what EM found). Vote patterns are counted over all documents."""
    cast = written(votes(docs), "quality-votes")
    counts = weaklabels.count_patterns(cast, "pattern")
    chance, share, post = weaklabels.estimate(counts, len(LABELERS))
    found = {"reliability": dict(zip(LABELERS, chance)), "share": share}
    chosen = cast.orderBy(F.xxhash64("doc", "body"), "doc").limit(sample).distinct()
    chosen = written(weaklabels.posterior(chosen, "pattern", post, "good"), "quality-sample")
    rows = features(_texts(docs).join(chosen.select("doc", "body"), ["doc", "body"], "left_semi").withColumnRenamed("doc", "doc_id"))
    vector = F.udf(lambda where, share: Vectors.sparse(BUCKETS, where, share), VectorUDT())
    rows = rows.join(chosen, ["doc", "body"])
    # a document is a positive with its posterior as weight and a negative with the rest
    both = written(rows.select("where", "share", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("good").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("good")).alias("weight")))).alias("l")), "quality-rows")
    train = both.select(vector("where", "share").alias("features"), "l.label", "l.weight").filter("weight > 0.001")
    classes = [r[0] for r in train.select("label").distinct().collect()]
    if len(classes) < 2:
        return [0.0] * BUCKETS, 30.0 if classes == [1.0] else -30.0, found
    model = LogisticRegression(maxIter=60, regParam=1e-5, weightCol="weight", standardization=False).fit(train)
    return [float(x) for x in model.coefficients.toArray()], float(model.intercept), found


def score(docs: DataFrame, weights: list[float], intercept: float) -> DataFrame:
    """doc, body, n_words, score of every row by its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(weights))  # BUCKETS numbers
    repeat = zlib.crc32(b"again") % BUCKETS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        traits_of = worker_tables("word traits", BUCKETS, _Traits)
        for batch in pieces(batches, "text", PIECE):
            ids, traits, counts, _, twice = _measured(batch.column(2), traits_of)
            each = (weight[traits[5]] + weight[traits[6]])[ids] + weight[repeat] * twice
            total = intercept + SCALE * sums(each, counts) / np.maximum(counts, 1)
            p = np.where(counts > 0, 1 / (1 + np.exp(-np.clip(total, -40, 40))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(p)], ["doc", "body", "n_words", "score"])

    return _texts(docs).mapInArrow(run, "doc long, body long, n_words long, score double")


def classify(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    weights, intercept, _ = fit(docs, sample)
    return score(docs, weights, intercept).withColumn("kept", F.col("score") >= threshold)


def keep(docs: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that are not rejected, columns as they came."""
    gone = written(classify(docs, threshold, sample).filter(~F.col("kept")).select("doc", "body").distinct(), "rejected")
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc"), F.xxhash64("text").alias("body"))
    return held.join(sized(gone.withColumn("doc", F.coalesce("doc", F.lit(-1)))), ["doc", "body"], "left_anti").select("row.*")
