"""Signal tables: one row per sample (item_id, idx, x), all results by aggregation.

Levels, peaks and frame energies are sums and extremes, so every task reduces its own
samples before anything is shuffled.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clipweave.plans.fold import ordered_fold
from clipweave.plans.overlap import point_join
from clipweave.plans.scan import neighbour, number_rows, plan_cells, prefix_scan, running_sum

SILENT = 10 ** (-50 / 20)


def unblock(blocks: DataFrame) -> DataFrame:
    """Blocked samples (item_id, block_no, first_idx, x ARRAY) to rows."""
    return blocks.select("item_id", "first_idx", F.posexplode("x").alias("_p", "x")).select(
        "item_id", (F.col("first_idx") + F.col("_p")).alias("idx"), F.col("x").cast("double").alias("x")
    )


def mono(channels: DataFrame) -> DataFrame:
    """Mean over channels (item_id, idx, channel, x)."""
    return channels.groupBy("item_id", "idx").agg(F.avg("x").alias("x"))


def lengths(samples: DataFrame) -> DataFrame:
    return samples.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def peaks(samples: DataFrame, points: int = 4000) -> DataFrame:
    """(min, max) per block of ceil(n / points) samples."""
    size = lengths(samples).select("item_id", F.ceil(F.col("n") / points).alias("_b"))
    return samples.join(size, "item_id").groupBy("item_id", F.floor(F.col("idx") / F.col("_b")).alias("block")).agg(
        F.min("x").alias("lo"), F.max("x").alias("hi")
    )


def db(c: Column) -> Column:
    return 20 * F.log10(c)


def level_metrics(samples: DataFrame, keys: list[str], rate: float) -> DataFrame:
    """RMS and peak level, silence ratio, clipping and duration per group."""
    a = F.abs("x")
    part = samples.groupBy(*keys).agg(
        F.avg(F.col("x") * F.col("x")).alias("_ms"), F.max(a).alias("_pk"), F.avg((a < SILENT).cast("double")).alias("_si"),
        F.max(a > 0.999).alias("clipping"), F.count(F.lit(1)).alias("samples"),
    )
    return part.select(
        *keys, F.round(db(F.sqrt(F.col("_ms") + 1e-9)), 2).alias("rms_db"), F.round(db(F.col("_pk") + 1e-9), 2).alias("peak_db"),
        F.round("_si", 4).alias("silence_ratio"), "clipping", F.round(F.col("samples") / rate, 3).alias("duration"), "samples",
    )


def normalise_loudness(samples: DataFrame, target_db: float = -16.0) -> DataFrame:
    """Linear gain per item that brings the RMS level to the target."""
    gain = samples.groupBy("item_id").agg(
        (F.lit(target_db) - db(F.sqrt(F.avg(F.col("x") * F.col("x")) + 1e-9))).alias("gain_db"))
    return samples.join(gain, "item_id").withColumn("x", F.col("x") * F.pow(F.lit(10.0), F.col("gain_db") / 20))


def blend_peak(samples: DataFrame, peak: float = 0.9, alpha: float = 0.25) -> DataFrame:
    """Mix of the peak-normalised and the original signal."""
    top = samples.groupBy("item_id").agg(F.max(F.abs("x")).alias("_m"))
    x = F.when(F.col("_m") > 1, F.col("x") / F.col("_m")).otherwise(F.col("x"))
    mixed = x / F.col("_m") * (peak * alpha) + (1 - alpha) * x
    return samples.join(top, "item_id").withColumn("x", F.when(F.col("_m") > 0, mixed).otherwise(F.col("x"))).drop("_m")


def frame_energy(samples: DataFrame, frame: int, hop: int) -> DataFrame:
    """Mean square per complete frame; a signal shorter than a frame is one frame.

    Samples are first summed in buckets of gcd(frame, hop), on the map side; only
    bucket sums are copied to the frames that cover them.
    """
    g = gcd(frame, hop)
    bucket = samples.groupBy("item_id", F.floor(F.col("idx") / g).alias("_b")).agg(
        F.sum(F.col("x") * F.col("x")).alias("_s"), F.count(F.lit(1)).alias("_c"))
    n = bucket.groupBy("item_id").agg(F.sum("_c").alias("_n"))
    per, step = frame // g, hop // g
    last = F.greatest(F.lit(0), F.floor((F.col("_n") - frame) / hop))
    first = F.greatest(F.lit(0), F.ceil((F.col("_b") - (per - 1)) / step))
    upto = F.least(last, F.floor(F.col("_b") / step))
    spread = bucket.join(n, "item_id").withColumn(
        "frame_no", F.explode(F.when(first <= upto, F.sequence(first, upto)).otherwise(F.array().cast("array<bigint>")))
    )
    return spread.groupBy("item_id", "frame_no").agg((F.sum("_s") / F.sum("_c")).alias("ms"))


def decimate(samples: DataFrame, rate: int, target: int = 16_000) -> tuple[DataFrame, int]:
    """Keep every k-th sample so that the rate does not exceed ``target``."""
    k = max(1, rate // target)
    if k == 1:
        return samples, rate
    return samples.filter(F.col("idx") % k == 0).withColumn("idx", F.floor(F.col("idx") / k)), rate // k


def band_means(frames: DataFrame, value: str = "db", share: float = 0.10) -> DataFrame:
    """Mean of the quietest and loudest ``share`` of the frames per item."""
    n = frames.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    ranked = number_rows(frames, ["item_id"], [value, "frame_no"], "_r")
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    return ranked.join(n, "item_id").groupBy("item_id").agg(
        F.avg(F.when(F.col("_r") <= k, F.col(value))).alias("lo"),
        F.avg(F.when(F.col("_r") > F.col("n") - k, F.col(value))).alias("hi"),
        F.first("mean").alias("mean"), F.first("n").alias("n_frames"),
    )


def adaptive_threshold(frames: DataFrame) -> DataFrame:
    """Silence level per item from its own loudness range; null without contrast."""
    span = F.col("hi") - F.col("lo")
    return band_means(frames).withColumn(
        "threshold", F.when(span >= 8, F.col("lo") + F.greatest(F.lit(6.0), span * 0.20)))


def frames_db(samples: DataFrame, frame: int, hop: int, eps: float = 1e-12) -> DataFrame:
    return frame_energy(samples, frame, hop).select("item_id", "frame_no", db(F.sqrt(F.col("ms") + eps) + eps).alias("db"))


# --- quality score -------------------------------------------------------------------

def clip_score(ratio: Column) -> Column:
    return F.when(ratio <= 0.001, 1.0).when(ratio >= 0.01, 0.0).otherwise(1 - (ratio - 0.001) / 0.009)


def level_score(rms_db: Column) -> Column:
    s = (
        F.when(rms_db.between(-24, -10), 1.0)
        .when((rms_db >= -34) & (rms_db < -24), 1 - (-24 - rms_db) / 10 * 0.7)
        .when((rms_db > -10) & (rms_db <= -4), 1 - (rms_db + 10) / 6 * 0.5)
        .otherwise(0.15)
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))


def activity_score(silence: Column) -> Column:
    return F.when(silence <= 0.30, 1.0).when(silence >= 0.70, 0.0).otherwise(1 - (silence - 0.30) / 0.40)


def snr_score(n_frames: Column, lo: Column, hi: Column, mean: Column, silence: Column) -> Column:
    flat = (silence < 0.02) | (lo > mean - 6)
    return F.when((n_frames < 8) | flat, 0.85).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (hi - lo) / 30)))


def score_band(q: Column) -> Column:
    return F.when(q.isNull(), "").when(q >= 80, "good").when(q >= 60, "fair").otherwise("poor")


@F.pandas_udf(T.DoubleType())
def flatness(frames: pd.Series) -> pd.Series:
    """Geometric over arithmetic mean of the magnitude spectrum of a windowed frame."""

    def one(x: np.ndarray) -> float:
        spec = np.abs(np.fft.rfft(np.asarray(x, float) * np.hanning(len(x)))) + 1e-10
        return float(np.exp(np.log(spec).mean()) / (spec.mean() + 1e-10))

    return frames.map(one)


def frame_arrays(samples: DataFrame, frame: int, hop: int) -> DataFrame:
    """Complete frames as arrays; built from gcd-sized pieces, each at most a frame long."""
    g = gcd(frame, hop)
    piece = samples.groupBy("item_id", F.floor(F.col("idx") / g).alias("_b")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"]).alias("_x"))
    n = lengths(samples)
    per, step = frame // g, hop // g
    last = F.floor((F.col("n") - frame) / hop)
    first = F.greatest(F.lit(0), F.ceil((F.col("_b") - (per - 1)) / step))
    upto = F.least(last, F.floor(F.col("_b") / step))
    spread = piece.join(n.filter(F.col("n") >= frame), "item_id").withColumn(
        "frame_no", F.explode(F.when(first <= upto, F.sequence(first, upto)).otherwise(F.array().cast("array<bigint>"))))
    return spread.groupBy("item_id", "frame_no").agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_b", "_x"))), lambda s: s["_x"])).alias("frame"))


def spectral_scores(samples: DataFrame, frame: int, hop: int, min_samples: int = 2048) -> DataFrame:
    """Score of the mean flatness per item; 0.7 where the signal is too short."""
    flat = frame_arrays(samples, frame, hop).withColumn("f", flatness("frame"))
    mean = flat.groupBy("item_id").agg(F.avg("f").alias("sfm"), F.count(F.lit(1)).alias("_k"))
    raw = F.when(F.col("sfm") <= 0.05, 1.0).when(F.col("sfm") >= 0.50, 0.0).otherwise(1 - (F.col("sfm") - 0.05) / 0.45)
    known = (F.col("n") >= min_samples) & (F.coalesce("_k", F.lit(0)) >= 4)
    return lengths(samples).join(mean, "item_id", "left").select(
        "item_id", "sfm", F.when(known, raw).otherwise(0.7).alias("spectral"))


def quality_scores(samples: DataFrame, rate: float, *, frame_s: float = 0.032, hop_s: float = 0.008,
                   min_samples: int = 2048, spectral: DataFrame | None = None) -> DataFrame:
    """Quality 0..100 per item with its five components."""
    frame, hop = max(1, int(frame_s * rate)), max(1, int(hop_s * rate))
    a = F.abs("x")
    base = samples.groupBy("item_id").agg(
        F.avg(F.col("x") * F.col("x")).alias("_ms"), F.avg((a >= 0.99).cast("double")).alias("clip_ratio"),
        F.avg((a < SILENT).cast("double")).alias("silence_ratio"), F.count(F.lit(1)).alias("n"),
    ).withColumn("rms_db", db(F.sqrt(F.col("_ms") + 1e-10) + 1e-10))
    bands = band_means(frames_db(samples, frame, hop, 1e-10))
    spec = spectral if spectral is not None else spectral_scores(samples, frame, hop, min_samples)
    all_ = base.join(bands, "item_id").join(spec.select("item_id", "spectral"), "item_id")
    scored = all_.select(
        "item_id", "n", "clip_ratio", "silence_ratio", "rms_db", (F.col("hi") - F.col("lo")).alias("snr_db"), "spectral",
        snr_score(F.col("n_frames"), F.col("lo"), F.col("hi"), F.col("mean"), F.col("silence_ratio")).alias("snr"),
        clip_score(F.col("clip_ratio")).alias("clip"), level_score(F.col("rms_db")).alias("level"),
        activity_score(F.col("silence_ratio")).alias("activity"),
    )
    q = 40 * F.col("snr") + 20 * F.col("clip") + 15 * F.col("level") + 15 * F.col("activity") + 10 * F.col("spectral")
    return scored.withColumn("q", F.when(F.col("n") < int(0.05 * rate), 0.0).otherwise(F.round(q, 1)))


# --- cutting -----------------------------------------------------------------------------

def slice_ranges(samples: DataFrame, clips: DataFrame, rate: float, width: int = 16_000) -> DataFrame:
    """Samples of each clip [start_ms, end_ms), clamped to the signal."""
    s = F.greatest(F.lit(0), F.floor(F.col("start_ms") * rate / 1000)).cast("long")
    e = F.floor(F.col("end_ms") * rate / 1000).cast("long")
    spans = clips.select("item_id", "clip_id", s.alias("s"), e.alias("e")).filter("e > s")
    hits = point_join(samples, spans, ["item_id"], at="idx", span=("s", "e"), width=width)
    return hits.select("item_id", F.col("r_clip_id").alias("clip_id"), (F.col("idx") - F.col("r_s")).alias("idx"), "x")


def mid_window(ranges: DataFrame, length: int = 1000) -> DataFrame:
    """The middle second of each range (all of a shorter one)."""
    span = F.col("end_ms") - F.col("start_ms")
    cut = F.floor((span - F.least(span, F.lit(length))) / 2)
    return ranges.withColumn("ws", F.col("start_ms") + cut).withColumn(
        "we", F.col("start_ms") + cut + F.least(span, F.lit(length)))


def window_gate(samples: DataFrame, keys: list[str], rate: float, min_db: float = -45.0) -> DataFrame:
    """Windows with a quarter second of sound above the level gate."""
    m = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("x") * F.col("x")).alias("_ms"))
    level = db(F.sqrt("_ms") + 1e-9)
    return m.filter((F.col("n") >= int(rate) // 4) & (level >= min_db)).select(*keys, "n", level.alias("level_db"))


def trim_bounds(frames: DataFrame, hop_ms: int, threshold: float = -35.0, keep_ms: int = 100) -> DataFrame:
    """First and last loud frame per item, with some silence kept."""
    loud = frames.filter(F.col("db") > threshold).groupBy("item_id").agg(
        F.min("frame_no").alias("_a"), F.max("frame_no").alias("_b"))
    end = frames.groupBy("item_id").agg(((F.max("frame_no") + 1) * hop_ms).alias("_end"))
    return loud.join(end, "item_id").select(
        "item_id", F.greatest(F.lit(0), F.col("_a") * hop_ms - keep_ms).alias("start_ms"),
        F.least(F.col("_end"), (F.col("_b") + 1) * hop_ms + keep_ms).alias("end_ms"))


def peak_guard(rows: DataFrame, limit: float = 2.2) -> tuple[DataFrame, DataFrame]:
    """Usable feature rows, and the ones to compute again (NaN inside). Too loud ones go."""
    fine = rows.filter(F.col("peak") <= limit)
    broken = F.exists("feature", F.isnan)
    return fine.filter(~broken), fine.filter(broken)


def energy_slices(frames: DataFrame, *, threshold: float, min_length: int, min_interval: int, max_kept: int) -> DataFrame:
    """Cut long signals at the quietest frame of long silences; chunks in frames.

    ``frames``: item_id, frame_no, rms. Runs and their minima are plain aggregates; only
    the choice of cuts looks back (a clip must be long enough), a fold over runs.
    """
    quiet = (F.col("rms") < threshold)
    base = frames.withColumn("_q", quiet)
    cells = plan_cells(base, ["item_id"], F.col("frame_no"))
    seen = prefix_scan(base, ["item_id"], ["frame_no"], cells=cells, _pq=neighbour(F.col("_q")))
    opens = F.col("_q") & ~F.coalesce("_pq", F.lit(False))
    runs = prefix_scan(seen, ["item_id"], ["frame_no"], cells=cells, _run=running_sum(opens.cast("long")))
    inside = runs.filter(F.col("_q") | F.coalesce("_pq", F.lit(False)))  # the run and the loud frame after it
    bounds = inside.groupBy("item_id", "_run").agg(
        F.min("frame_no").alias("s"), F.max(F.when(~F.col("_q"), F.col("frame_no"))).alias("i"))
    total = frames.groupBy("item_id").agg((F.max("frame_no") + 1).alias("total"))
    both = inside.join(bounds, ["item_id", "_run"]).join(total, "item_id")
    f, s, i = F.col("frame_no"), F.col("s"), F.col("i")
    low = lambda cond: F.min_by(F.when(cond, f), F.when(cond, F.struct(F.col("rms"), f)))
    cuts = both.groupBy("item_id", "_run", "s", "i", "total").agg(
        low(F.lit(True)).alias("all_"), low(f <= s + max_kept).alias("left_"), low(f >= i - max_kept).alias("right_"),
        low((f >= i - max_kept) & (f <= s + max_kept)).alias("mid_"),
    )
    item = cuts.schema["item_id"].dataType.simpleString()

    def step(rows: pd.DataFrame, state: str | None) -> tuple[pd.DataFrame, str | None]:
        clip = 0 if state is None else int(state)
        out = []
        for r in rows.itertuples(index=False):
            start = int(r.s)
            if pd.isna(r.i):  # silence up to the end
                if r.total - start >= min_interval:
                    out.append((int(r.left_), int(r.total) + 1))
                continue
            stop = int(r.i)
            if not ((start == 0 and stop > max_kept) or (stop - start >= min_interval and stop - clip >= min_length)):
                continue
            width = stop - start
            if width <= max_kept:
                a = b = int(r.all_)
            elif width <= 2 * max_kept:
                a, b = min(int(r.left_), int(r.mid_)), max(int(r.right_), int(r.mid_))
                b = int(r.right_) if start == 0 else b
            else:
                a, b = int(r.left_), int(r.right_)
            out.append((0 if start == 0 else a, b))
            clip = b
        made = pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        made.insert(0, "item_id", rows["item_id"].iloc[0] if len(rows) else None)
        return made, str(clip)

    tags = ordered_fold(cuts, ["item_id"], ["s"], step, f"item_id {item}, a long, b long")
    sequence = prefix_scan(tags, ["item_id"], ["b"], _from=neighbour(F.col("b")))
    inner = sequence.select("item_id", F.coalesce("_from", F.lit(0)).alias("begin"), F.col("a").alias("end"),
                            F.col("_from").isNull().alias("_first"))
    last = tags.groupBy("item_id").agg(F.max("b").alias("_b"))
    tail = total.join(last, "item_id", "left").select(
        "item_id", F.coalesce("_b", F.lit(0)).alias("begin"), F.col("total").alias("end"), F.lit(False).alias("_first"))
    tail = tail.filter("begin < end")
    return inner.filter("NOT _first OR end > 0").unionByName(tail).drop("_first")
