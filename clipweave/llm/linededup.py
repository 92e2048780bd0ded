"""Line dedup: hashes in range partitions, first occurrences streamed, keep bitmaps per document.

Only DataFrame functions. Texts are read twice: once for the hash of every line, once to apply
the bitmaps; what is shuffled in between are hashes, numbers and bitmaps, never lines.

Defined cases: a null or empty text is one empty line; a null doc_id holds no line and keeps all;
rows with the same doc_id count as one document; equal rows give equal results; extra input
columns are carried by ``apply`` and ignored otherwise; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from clipweave.llm.common import SALTS, SPACES, lower_ascii, written

#: keys of fewer code points are never dropped
MIN_KEY = 10
#: positions per word of a bitmap
BITS = 63


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACES)))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """One row per long enough line: 128 bits of its key, document, text hash and position."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line")
    )
    keyed = rows.filter(F.col("doc").isNotNull()).withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_key)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "doc", "body", "pos")


def drop_bitmaps(hashes: DataFrame) -> DataFrame:
    """Compressed bitmaps of dropped lines: (doc, body, words), words a map from position div 63 to bits.

    Words without a dropped line are left out, so a missing row means that all lines are kept.
    """
    ends = hashes.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
    shared = written(ends.filter(F.col("last") > F.col("owner")).select("h1", "h2", "owner"), "line-owners")
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    none = F.lit(None)
    # an owner row leads every (hash, salt) range; the hot hashes lie in SALTS ranges
    leads = shared.select("h1", "h2", salt.alias("salt"), F.lit(0).alias("kind"), "owner", none.cast("long").alias("doc"), none.cast("long").alias("body"), none.cast("int").alias("pos"))
    lines = hashes.select("h1", "h2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"), none.cast("long").alias("owner"), "doc", "body", "pos")
    parts = int(hashes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = leads.unionByName(lines).repartitionByRange(parts, "h1", "h2", "salt")
    stream = W.partitionBy("h1", "h2", "salt").orderBy("kind", "doc", "body", "pos").rowsBetween(W.unboundedPreceding, 0)
    later = (
        ranged.withColumn("first", F.first("owner", ignorenulls=True).over(stream))
        .filter((F.col("kind") == 1) & (F.col("first") < F.col("doc")))
        .select("doc", "body", "pos")
    )
    words = later.groupBy("doc", "body", F.floor(F.col("pos") / BITS).cast("int").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, pos % {BITS})")).alias("bits"))
    return words.groupBy("doc", "body").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words"))


def marked(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Each input row as ``row`` with its lines and the bitmap of those to drop (null: none)."""
    maps = drop_bitmaps(written(line_hashes(docs, min_key), "line-hashes"))
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("body"))
    return held.join(maps, ["doc", "body"], "left")


def kept_text() -> Column:
    """The lines that stay, joined; from the columns of ``marked``."""
    text, lines = F.coalesce(F.col("row.text"), F.lit("")), lines_of(F.col("row.text"))
    zero = F.lit(0).cast("long")
    dense = F.transform(F.sequence(F.lit(0), F.floor(F.size(lines) / BITS).cast("int")), lambda w: F.coalesce(F.col("words")[w], zero))

    kept = F.transform(F.array(F.struct(dense.alias("dense"), lines.alias("lines"))), lambda x: F.array_join(F.filter(x["lines"], lambda _, i: _stays(x["dense"], i)), "\n"))[0]
    return F.when(F.col("words").isNull(), text).otherwise(kept)


def _stays(dense: Column, i: Column) -> Column:
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (i % BITS).cast("int"))
    return dense[F.floor(i / BITS).cast("int")].bitwiseAND(bit) == 0


def n_dropped() -> Column:
    return F.coalesce(F.aggregate(F.map_values("words"), F.lit(0).cast("long"), lambda n, x: n + F.bit_count(x)), F.lit(0).cast("long"))


def apply(docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """The documents with their kept lines as text and n_chars, if there, set anew."""
    out = marked(docs, min_key).select("row.*", kept_text().alias("_kept"))
    cols = [F.col("_kept").alias(c) if c == "text" else F.length("_kept").cast(t).alias(c) if c == "n_chars" else F.col(c) for c, t in docs.dtypes]
    return out.select(*cols)
