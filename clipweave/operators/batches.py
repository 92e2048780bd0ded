"""Training-set preparation: length filters, buckets, padding and batches."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipweave.functions.text import strip, strip_tags
from clipweave.plans.fold import _fresh, ordered_fold
from clipweave.plans.frames import plain_strings
from clipweave.plans.scan import number_rows
from clipweave.session import cut, setting

HZ = 25


def phone_rate_reason(max_sec: int = 54, hz: int = HZ, lo: float = 3.0, hi: float = 25.0) -> Column:
    """Why a sample is unfit, null if it is fine. Needs n_ids, n_phones, n_unknown."""
    rate = F.col("n_phones") / (F.col("n_ids") / hz)
    return (
        F.when(F.col("n_phones").isNull(), "no phonemes")
        .when(F.col("n_ids") > max_sec * hz, "too long")
        .when(F.coalesce("n_unknown", F.lit(0)) > 0, "no phonemes")
        .when(F.col("n_phones") > max_sec * hz / 2.5, "too many phones")
        .when((rate > hi) | (rate < lo), "phone rate")
    )


def acoustic_length(rows: DataFrame, rate: int, hop: int, validation: bool = False) -> DataFrame:
    """Keep 0.6 s < duration < 54 s (all but empty ones in validation); adds ``length``."""
    seconds = F.col("bytes") / rate / 2
    fits = (seconds != 0) & (F.lit(validation) | ((seconds > 0.6) & (seconds < 54)))
    return rows.filter(fits).withColumn("length", F.floor(F.col("bytes") / (2 * hop)))


def sample_seconds(n_ids: Column, hz: int = HZ) -> Column:
    return n_ids / hz


def drifting_buckets(rows: DataFrame, width_ids: int = 2 * HZ) -> DataFrame:
    """Length buckets whose limit rises once per opened bucket; adds ``bucket``.

    Rows in length order; a row at or above the limit opens the next bucket and raises
    the limit by one width, so gaps in the lengths make the limits lag behind. All rows
    of one length are handled at once: of c rows, the first min(c, widths above the
    limit) open a bucket each. The fold runs over distinct lengths only.
    """
    hist = rows.groupBy("n_ids").agg(F.count(F.lit(1)).alias("c")).withColumn("_one", F.lit(0))

    def step(part: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
        bucket, limit = (0, width_ids) if state is None else json.loads(state)
        out = []
        for n, c in zip(part["n_ids"].astype(int), part["c"].astype(int), strict=True):
            opened = min(int(c), (int(n) - limit) // width_ids + 1) if n >= limit else 0
            out.append((int(n), bucket, opened))
            bucket, limit = bucket + opened, limit + opened * width_ids
        return pd.DataFrame(out, columns=["n_ids", "_base", "_opened"]), json.dumps([bucket, limit])

    plan = ordered_fold(hist, ["_one"], ["n_ids"], step,
                        f"n_ids {hist.schema['n_ids'].dataType.simpleString()}, _base long, _opened long")
    placed = number_rows(rows, ["n_ids"], ["ord"], "_j").join(plan, "n_ids")
    return placed.withColumn("bucket", F.col("_base") + F.least(F.col("_j"), F.col("_opened"))).drop("_j", "_base", "_opened")


def grid_buckets(rows: DataFrame, width_ids: int = 2 * HZ) -> DataFrame:
    return rows.withColumn("bucket", F.floor(F.col("n_ids") / width_ids))


# Length boundaries of the acoustic trainer.
BOUNDS = [32, *range(300, 2000, 100)]


def bounded_buckets(rows: DataFrame, bounds: list[int] | None = None) -> DataFrame:
    """Half-open buckets (b_i, b_i+1]; rows outside are dropped, empty buckets do not count.

    ``bucket`` numbers the non-empty buckets from 0.
    """
    b = bounds or BOUNDS
    raw = F.lit(None).cast("int")
    for i in range(len(b) - 2, -1, -1):
        raw = F.when((F.col("length") > b[i]) & (F.col("length") <= b[i + 1]), i).otherwise(raw)
    kept = rows.withColumn("_raw", raw).filter(F.col("_raw").isNotNull())
    from pyspark.sql import window as W

    seen = kept.select("_raw").distinct()  # at most one row per boundary
    seen = seen.withColumn("bucket", F.row_number().over(W.Window.partitionBy(F.lit(0)).orderBy("_raw")) - 1)
    return kept.join(F.broadcast(seen), "_raw").drop("_raw")


def pad_buckets(rows: DataFrame, batch: int, replicas: int, order: str = "ord") -> DataFrame:
    """Fill each bucket to a multiple of batch x replicas by cycling; adds ``pos``."""
    unit = batch * replicas
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    size = size.withColumn("_total", (F.ceil(F.col("_n") / unit) * unit).cast("long"))
    at = number_rows(rows, ["bucket"], [order], "_p").join(size, "bucket")
    return at.withColumn(
        "pos", F.explode(F.sequence((F.col("_p") - 1).cast("long"), F.col("_total") - 1, F.col("_n")))
    ).drop("_p", "_n", "_total")


def epoch_batches(rows: DataFrame, batch: int, replicas: int, *, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Shuffled batches of one epoch: adds rank, batch_no (in the bucket) and batch_order.

    The order is a hash of (seed, epoch, row), so every executor and every rerun agrees.
    """
    mix = lambda *c: F.xxhash64(F.lit(seed), F.lit(epoch), *c)
    shuffled = rows.withColumn("_h", mix("ord"))
    size = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n"))
    unit = batch * replicas
    size = size.withColumn("_total", (F.ceil(F.col("_n") / unit) * unit).cast("long"))
    at = number_rows(shuffled, ["bucket"], ["_h", "ord"], "_p").join(size, "bucket")
    padded = at.withColumn("pos", F.explode(F.sequence((F.col("_p") - 1).cast("long"), F.col("_total") - 1, F.col("_n"))))
    placed = padded.withColumn("rank", F.col("pos") % replicas).withColumn(
        "batch_no", F.floor(F.floor(F.col("pos") / replicas) / batch)
    )
    batches = placed.select("rank", "bucket", "batch_no").distinct().withColumn("_bh", mix("rank", "bucket", "batch_no"))
    ordered = number_rows(batches, ["rank"], ["_bh", "bucket", "batch_no"], "batch_order").drop("_bh")
    return placed.join(ordered, ["rank", "bucket", "batch_no"]).drop("_h", "_p", "_n", "_total")


def divisible(rows: DataFrame, replicas: int, drop_last: bool = False) -> DataFrame:
    """Repeat the head (or drop the tail) so that rows divide by the replicas; adds pos, rank."""
    from clipweave.plans.scan import number_all

    n = rows.agg(F.count(F.lit(1))).scalar()
    rounded = F.floor(F.col("_n") / replicas) if drop_last else F.ceil(F.col("_n") / replicas)
    at = number_all(rows, ["ord"], "_p").withColumn("_n", n).withColumn("_total", (rounded * replicas).cast("long"))
    at = at.filter(F.col("_p") <= F.col("_total")).withColumn(
        "pos", F.explode(F.sequence((F.col("_p") - 1).cast("long"), F.col("_total") - 1, F.col("_n"))))
    return at.withColumn("rank", F.col("pos") % replicas).drop("_p", "_n", "_total")


def pad_arrays(rows: DataFrame, keys: list[str], arrays: dict[str, int]) -> DataFrame:
    """Right-pad arrays to the longest of their batch; ``arrays`` maps column to pad value."""
    top = rows.groupBy(*keys).agg(*[F.max(F.size(c)).alias(f"_m_{c}") for c in arrays])
    out = rows.join(top, keys)
    return out.withColumns({
        c: F.concat(F.col(c), F.array_repeat(F.lit(v).cast(rows.schema[c].dataType.elementType), F.col(f"_m_{c}") - F.size(c)))
        for c, v in arrays.items()
    }).drop(*[f"_m_{c}" for c in arrays])


def homogeneous_batches(rows: DataFrame, keys: list[str], batch: int, threshold: float = 0.75) -> DataFrame:
    """Batches of similar text length: (keys, ord, batch_no).

    Rows by length; the next batch is the longest prefix of at most ``batch`` rows whose middle
    length is at least ``threshold`` of their mean length (texts without any length stand alone).

    Where a batch that begins at a row would end depends on the next rows alone, so every row gets
    that length in a window. Which rows do begin a batch is a chain through those lengths: a key is
    cut into cells along its order, every cell tells for each place at which the chain may enter it
    where it leaves again and after how many batches, the cells' answers are joined end to end, and
    every cell is numbered from its entry. A hot key is worked on by as many tasks as it has cells.
    """
    size = max(setting(rows.sparkSession, "batchCell", 250_000), batch)
    at = number_rows(rows.select(*keys, "ord", "n_chars"), keys, ["n_chars", "ord"], "_p")
    placed = at.withColumn("_at", F.col("_p") - 1).withColumn("_cell", F.floor(F.col("_at") / size))
    # a cell's last rows look at the first ones of the next cell, which get a copy in front
    seen = placed.withColumn("_in", F.explode(F.when(
        (F.col("_at") % size < batch - 1) & (F.col("_cell") > 0), F.array(F.col("_cell"), F.col("_cell") - 1)
    ).otherwise(F.array("_cell"))))
    ahead = Window.partitionBy(*keys, "_in").orderBy("_at").rowsBetween(0, batch - 1)
    part = F.col("_next")
    total = lambda n: F.aggregate(F.slice(part, F.lit(1), n), F.lit(0).cast("double"), lambda t, x: t + x)
    fits = lambda n: (n == 1) | ((total(n) > 0) & (F.get(part, F.floor(n / 2).cast("int")) * n >= threshold * total(n)))
    heads = seen.withColumn("_next", F.collect_list("n_chars").over(ahead)).filter("_in = _cell")
    heads = heads.select(*keys, "ord", "_cell", "_at", F.array_max(F.filter(F.sequence(F.lit(1), F.size(part)), fits)).alias("_take"))
    heads = cut(heads)

    key_types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    ways_schema = f"{key_types}, _cell long, entry int, leave int, made long"
    entry_schema = f"{key_types}, _cell long, entry int, made long"
    named = [*keys, "_cell"]

    def ways(part: pd.DataFrame) -> pd.DataFrame:
        take, n = part.sort_values("_at")["_take"].tolist(), len(part)
        leave, made = [0] * (n + batch), [0] * (n + batch)
        leave[n:] = range(batch)
        for i in range(n - 1, -1, -1):
            leave[i], made[i] = leave[i + take[i]], made[i + take[i]] + 1
        some = min(batch, n)
        out = pd.DataFrame({c: [part[c].iloc[0]] * some for c in named})
        return plain_strings(out.assign(entry=range(some), leave=leave[:some], made=made[:some]))

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        known = {(c, e): (to, m) for c, e, to, m in part[["_cell", "entry", "leave", "made"]].itertuples(index=False)}
        out, entry, made = [], 0, 0
        for cell in sorted({c for c, _ in known}):
            out.append((cell, entry, made))
            entry, more = known.get((cell, entry), (0, 0))  # a chain may pass over the few rows of a last cell
            made += more
        table = pd.DataFrame(out, columns=["_cell", "entry", "made"])
        for c in keys:
            table[c] = part[c].iloc[0]
        return plain_strings(table[[*keys, "_cell", "entry", "made"]])

    def number(_key: tuple, part: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at")
        take, entry = part["_take"].tolist(), int(entries["entry"].iloc[0])
        starts, i = np.zeros(len(take), np.int64), entry
        while i < len(take):
            starts[i] = 1
            i += take[i]
        # rows in front of the entry belong to the batch that came in
        part["batch_no"] = int(entries["made"].iloc[0]) + np.cumsum(starts) - 1
        return plain_strings(part[[*keys, "ord", "batch_no"]])

    entries = heads.groupBy(*named).applyInPandas(ways, ways_schema).groupBy(*keys).applyInPandas(follow, entry_schema)
    out = f"{key_types}, ord {rows.schema['ord'].dataType.simpleString()}, batch_no long"
    return heads.groupBy(*named).cogroup(_fresh(cut(entries)).groupBy(*named)).applyInPandas(number, out)


def original_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ord")


def effective_batch(n: Column, batch: int) -> Column:
    return F.greatest(F.least(F.lit(batch), F.floor(n / 4)), F.lit(1))


def clean_path(c: Column) -> Column:
    """No trailing slashes, one separator, no quotes or blanks around the path."""
    c = F.translate(F.regexp_replace(c, r"[\\/]+$", ""), "\\", "/")
    return F.regexp_replace(c, "^[ '\n\"‪]+|[ '\n\"‪]+$", "")


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def asr_manifest(results: DataFrame, speaker: str, language: str) -> DataFrame:
    """Recogniser output (wav_path, text) to manifest rows; blank texts go."""
    return results.filter(F.length(strip(F.col("text"))) > 0).select(
        F.translate("wav_path", "\\", "/").alias("path"), F.lit(speaker).alias("speaker"),
        F.lit(language).alias("language"), strip_tags(F.col("text")).alias("text"))


def readiness(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Per experiment: which artefacts are missing or empty, and whether it may start.

    ``expected``: exp, artefact; ``present``: exp, artefact, n_rows.
    """
    joined = expected.join(present, ["exp", "artefact"], "left")
    state = F.when(F.col("n_rows").isNull(), "missing").when(F.col("n_rows") == 0, "empty").otherwise("ok")
    return joined.withColumn("state", state).withColumn(
        "n_rows", F.coalesce("n_rows", F.lit(0)))


def ready(expected: DataFrame, present: DataFrame) -> DataFrame:
    return readiness(expected, present).groupBy("exp").agg(
        F.bool_and(F.col("state") == "ok").alias("ready"), F.count_if(F.col("state") == "missing").alias("missing"),
        F.count_if(F.col("state") == "empty").alias("empty"))
