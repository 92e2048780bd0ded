"""Shared pieces: tables, written stages, hot-key joins and word arrays."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.session import scratch_path

#: the six ASCII characters that part words; fixed by the result contracts
SPACES = " \t\n\v\f\r"
#: copies of a shared key's row, so that its partners spread over this many tasks
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write rows as Parquet in the shared folder and read them back: lineage ends here.

    The garbage collection lets Spark drop the shuffle files of frames no longer held.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    gc.collect()
    return df.sparkSession.read.parquet(path)


#: rows of numbers (16 to 32 bytes each) that are broadcast at most; more are joined by shuffle
BROADCAST_ROWS = 1_000_000


def sized(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for written rows of checked number; a larger table is left as it is."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


#: rows of numbers (115 bytes each in a hashed table of two keys) that a join may broadcast without a screen
FEW_ROWS = 100_000


def dealt(rows: DataFrame) -> DataFrame:
    """A hint that both sides of the join with ``rows`` are dealt by key.

    Spark judges a written table by its compressed files and doesn't count the copies that an
    explode makes of it, so what looks small to it can fill the driver as a broadcast.
    """
    return rows.hint("merge")


def side(rows: DataFrame) -> DataFrame:
    """Written rows of numbers as a side of a join: broadcast while they are few, else dealt by key."""
    return F.broadcast(rows) if rows.count() <= FEW_ROWS else dealt(rows)


#: bits of one row of a screen (fixed by Spark's bitmap functions), bits per key and most bits of a screen (8 MB)
SCREEN_ROW, SCREEN_BITS, MOST_BITS = 4096 * 8, 32, 1 << 26


def screened(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with a column _hit that is true wherever ``on`` equals a key of the written ``keys``, and seldom elsewhere.

    The keys become a bitmap of their hashes of 8 MB at most, the only thing that is broadcast, so
    a join that follows deals out hits alone. Beyond two million keys more of the others hit, too.
    """
    slots = min(max(1 << (SCREEN_BITS * keys.count()).bit_length(), SCREEN_ROW), MOST_BITS)
    place = F.xxhash64(*on).bitwiseAND(F.lit(slots - 1))
    maps = keys.select(F.floor(place / SCREEN_ROW).alias("_screen"), (place % SCREEN_ROW).alias("_at"))
    maps = maps.groupBy("_screen").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    found = rows.withColumn("_screen", F.floor(place / SCREEN_ROW)).withColumn("_at", place % SCREEN_ROW)
    found = found.join(F.broadcast(maps), "_screen", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("_at") % 8).cast("int")) == 1, F.lit(False))
    return found.withColumn("_hit", hit).drop("_screen", "_at", "_bits")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z alone, as the contracts ask; other letters stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def spread_join(rows: DataFrame, shared: DataFrame, key: list[str], by: Column, salts: int = SALTS, growing: bool = False) -> DataFrame:
    """Inner join of many rows with one row per shared key.

    Rows carry a salt from ``by``, and each shared key's row is copied once per salt, so a
    key that holds a third of all rows is met by ``salts`` tasks instead of one. With
    ``growing`` the copies are never broadcast: Spark's estimate of their size is that of ``shared``.
    """
    copies = shared.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    return salted.join(dealt(copies) if growing else copies, [*key, "_salt"]).drop("_salt")


# --------------------------------------------------------------------------- inside tasks


def worker_tables(owner: str, key: object, make: Callable[[], object]) -> object:
    """An operator's tables in this worker process, kept from task to task.

    Workers serve the stages of all operators one after another, so the tables of one operator
    leave once another one needs its own: a worker never holds two sets.
    """
    slot = sys.__dict__.setdefault("_clipweave_tables", {})
    if slot.get("key") != (owner, key):
        slot.clear()
        gc.collect()
        give_back()
        slot.update(tables=make(), key=(owner, key))
    return slot["tables"]


def give_back() -> None:
    """Return freed memory to the system: workers stay for later stages and count while they idle."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of one piece stay near ``most`` bytes (a longer text is one piece)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        del texts, batch
        give_back()


def words_of(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(word number of every word, the distinct words, words per text); a null text has none."""
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[full]
    coded = words.filter(pa.array(full)).dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return ids, coded.dictionary, np.bincount(text, minlength=len(texts)).astype(np.int64)


def sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups with the given sizes; an empty group gives 0."""
    total = np.concatenate([np.zeros(1, values.dtype if values.dtype.kind == "f" else np.int64), np.cumsum(values)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def packed_arcs(step: list[dict[int, int]], symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """(base, cells) of an automaton whose state s reads symbol x < ``symbols`` if ``cells[base[s] + x] >> 32`` is s.

    The low half of that cell is the next state. States with many arcs are placed first, from a
    place that moves on where free cells get rare; those with one arc fill the gaps.
    """
    cells: list[int] = [-1] * (2 * len(step) + symbols)
    base, low, gap = [0] * len(step), 0, 0
    for s in sorted(range(len(step)), key=lambda s: -len(step[s])):
        marks = list(step[s])
        if len(marks) == 1:
            while cells[gap] >= 0 or gap < marks[0]:
                gap += 1
            b = gap - marks[0]
        elif marks:
            b = tried = low
            while not all([cells[b + x] < 0 for x in marks]):
                b += 1
                if b + symbols >= len(cells):
                    cells += [-1] * len(cells)
            low = b if b - tried > 32 else low
        else:
            continue
        base[s] = b
        for x, to in step[s].items():
            cells[b + x] = s << 32 | to
        if max(gap, low) + symbols >= len(cells):
            cells += [-1] * len(cells)
    used = max(base, default=0) + symbols
    return np.array(base, np.int64), np.array((cells + [-1] * used)[:used], np.int64)
