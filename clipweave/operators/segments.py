"""Clip rules: issues, filters, summaries, orderings and holdouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.text import is_blank, strip
from clipweave.plans.scan import (
    number_all,
    number_ranked,
    number_rows,
    plan_cells,
    prefix_scan,
    running_sum,
)

MIN_MS, MAX_MS = 1000, 15_000
EDGE = 1 << 60

# Language codes.
LANGUAGES = {"JP": "ja", "ZH": "zh", "EN": "en", "JA": "ja", "JA-JP": "ja"}
TRAIN_LANGUAGES = {
    "ZH": "zh", "zh": "zh", "JP": "ja", "jp": "ja", "JA": "ja", "ja": "ja", "EN": "en", "en": "en",
    "En": "en", "KO": "ko", "Ko": "ko", "ko": "ko", "yue": "yue", "YUE": "yue", "Yue": "yue",
}


def length_ms() -> Column:
    return F.col("end_ms") - F.col("start_ms")


def lookup(table: dict[str, str], key: Column) -> Column:
    flat = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*flat), key)


def segment_issues() -> Column:
    """Ordered array of problems of a segment: mixed, blank, short, long."""
    return F.array_compact(F.array(
        F.when(F.col("mixed"), "mixed"),
        F.when(is_blank(F.col("text")), "blank"),
        F.when(length_ms() < MIN_MS, "short"),
        F.when(length_ms() > MAX_MS, "long"),
    ))


def clip_issues(duration: Column, silence: Column, clipping: Column) -> Column:
    """Ordered array of problems of a finished clip, from its level metrics."""
    return F.array_compact(F.array(
        F.when(duration < MIN_MS / 1000, "short"),
        F.when(duration > MAX_MS / 1000, "long"),
        F.when(silence > 0.5, "silence"),
        F.when(clipping, "clipping"),
    ))


def skip_reason(min_ms: int = 800, min_score: float = 0.0) -> Column:
    """First reason to leave a clip out of an export, null to keep it.

    A clip without a score is never dropped for its score.
    """
    low = F.lit(min_score > 0) & F.col("score").isNotNull() & (F.col("score") < min_score)
    return F.when(is_blank(F.col("text")), "blank").when(length_ms() < min_ms, "short").when(low, "low score")


def view_filter(rows: DataFrame, keyword: str = "", item: object = None, status: str = "all") -> DataFrame:
    """Keyword, item and status filter of the segment list."""
    kw = keyword.strip().lower()
    if kw:
        rows = rows.filter(F.lower(F.coalesce("text", F.lit(""))).contains(kw))
    if item is not None:
        rows = rows.filter(F.col("item_id") == item)
    tests = {
        "all": F.lit(True), "ok": F.size(segment_issues()) == 0, "bad": F.size(segment_issues()) > 0,
        "locked": F.col("locked"), "unassigned": F.col("character_id").isNull(),
    }
    return rows.filter(tests[status])


def view_order(rows: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """Order of the segment list: time, duration, score or character name."""
    way = lambda c: c.asc() if ascending else c.desc()
    if by == "duration":
        return rows.orderBy(way(length_ms()), "item_id", "ord")
    if by == "score":
        return rows.orderBy(way(F.coalesce(F.col("q"), F.lit(-1.0))), "item_id", "ord")
    if by == "character":
        name = F.collate(F.col("character_name"), "zh")
        return rows.orderBy(name.asc_nulls_last(), "start_ms", "item_id", "ord")
    return rows.orderBy(way(F.col("start_ms")), "item_id", "ord")


def view_positions(rows: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """Place of every row in the same order, for paging: adds ``position``."""
    one = rows.withColumn("_one", F.lit(0))
    if by == "character":
        # rank of the name, unassigned last; then the start time inside one name
        known = plan_cells(one, ["_one"], F.lit(0)).subset(rows.sparkSession)
        names = one.filter("character_name IS NOT NULL").select("_one", "character_name").distinct()
        ranked = number_rows(names, ["_one"], ["character_name"], "_rank", cells=known).drop("_one")
        one = one.join(ranked, "character_name", "left").withColumn("_rank", F.coalesce("_rank", F.lit(EDGE)))
        sizes = one.groupBy("_one", "_rank").agg(F.count(F.lit(1)).alias("_m"))
        ahead = prefix_scan(sizes, ["_one"], ["_rank"], cells=known, _a=running_sum(F.col("_m"), False))
        placed = number_rows(one, ["_rank"], ["start_ms", "ord"], "_p", cells=known)
        out = placed.join(ahead.select("_rank", F.coalesce("_a", F.lit(0)).alias("_a")), "_rank")
        return out.withColumn("position", F.col("_a") + F.col("_p")).drop("_one", "_rank", "_a", "_p")
    value = {"duration": length_ms(), "score": F.coalesce(F.col("q"), F.lit(-1.0)), "time": F.col("start_ms")}[by]
    one = one.withColumn("_rank", value if ascending else -value)
    return number_ranked(one, ["_one"], "_rank", "ord", "position").drop("_one", "_rank")


def role_clips(rows: DataFrame) -> DataFrame:
    """Usable clips of named roles: text and at least half a second."""
    return rows.filter(
        F.col("character_id").isNotNull() & ~is_blank(F.col("text")) & (length_ms() >= 500)
    )


def cues_to_segments(cues: DataFrame) -> DataFrame:
    """Fresh, unassigned segments from subtitle cues."""
    return cues.filter("end_ms > start_ms").select(
        "item_id", "ord", "start_ms", "end_ms", F.coalesce("text", F.lit("")).alias("text"),
        F.lit("JP").alias("language"), F.lit(None).cast("string").alias("speaker_label"),
        F.lit(None).cast("string").alias("character_id"), F.lit(False).alias("mixed"),
    )


def usable_transcript(text: Column) -> Column:
    """At least two characters, no Hangul syllable, more than punctuation."""
    return (
        (F.length(text) >= 2) & ~text.rlike(r"[가-힯]")
        & ~text.rlike(r"\A[.!?、。！？\s]+\z")
    )


def train_language(code: Column) -> Column:
    """Language code of the trainer, null when it is not supported."""
    return lookup(TRAIN_LANGUAGES, code)


def lenient_language(code: Column) -> Column:
    """Known codes mapped, others lowered, ``ja`` when there is none."""
    known = lookup(LANGUAGES, F.upper(F.coalesce(code, F.lit(""))))
    return F.coalesce(known, F.lower(F.when(F.coalesce(code, F.lit("")) != "", code).otherwise("ja")))


def clean_samples(raw: DataFrame, size: int = 20) -> DataFrame:
    """Feedback samples that parse, in requests of ``size`` rows per item, one per request and segment.

    ``raw`` has string columns and ``ord``; all five fields must cast.
    """
    typed = raw.select(
        "ord", "item_id", "seg_id", "character_id",
        F.col("start").try_cast("double").alias("start"), F.col("end").try_cast("double").alias("end"),
    ).dropna(subset=["item_id", "seg_id", "start", "end"])
    placed = number_rows(typed, ["item_id"], ["ord"], "_n").withColumn("batch_no", F.floor((F.col("_n") - 1) / size)).drop("_n")
    named = placed.filter(F.coalesce("character_id", F.lit("")) != "")
    first = named.groupBy("item_id", "batch_no", "seg_id").agg(F.min_by(F.struct("*"), "ord").alias("r"))
    return first.select("r.*")


def media_filter(items: DataFrame, text: str = "", playable: bool = False) -> DataFrame:
    if text:
        items = items.filter(F.lower("name").contains(text.strip().lower()))
    return items.filter(F.coalesce("path", F.lit("")) != "") if playable else items


def pending_transcription(rows: DataFrame) -> DataFrame:
    return rows.filter(is_blank(F.col("text")) & ~F.col("locked"))


def best_streams(formats: DataFrame) -> DataFrame:
    """Per media: the tallest complete stream and the richest audio-only stream."""
    has = lambda c: F.coalesce(F.col(c), F.lit("none")) != "none"
    linked = formats.filter(F.coalesce("url", F.lit("")) != "")
    kind = F.when(has("vcodec") & has("acodec"), "single").when(has("acodec"), "audio")
    rank = F.when(F.col("kind") == "single", F.coalesce("height", F.lit(0))).otherwise(F.coalesce("abr", F.lit(0)))
    best = linked.withColumn("kind", kind).filter(F.col("kind").isNotNull()).withColumn("rank", rank)
    return best.groupBy("media_id", "kind").agg(
        F.max_by("format_id", F.struct(F.col("rank"), -F.col("ord"))).alias("format_id"), F.max("rank").alias("rank")
    )


# --- summaries ----------------------------------------------------------------

def role_stats(rows: DataFrame) -> DataFrame:
    """Clips, seconds and majority language (first seen wins ties) per role."""
    usable = role_clips(rows).withColumn("lang", lenient_language(F.coalesce("language", F.lit("JP"))))
    by_lang = usable.groupBy("character_id", "lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(length_ms()).alias("ms"), F.min("ord").alias("f")
    )
    return by_lang.groupBy("character_id").agg(
        F.sum("n").alias("clips"), F.round(F.sum("ms") / 1000, 1).alias("seconds"),
        F.max_by("lang", F.struct(F.col("n"), -F.col("f"))).alias("language"),
    )


def quality_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("q").alias("scored"), F.round(F.avg("q"), 1).alias("mean_q")
    )


def identification_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"), F.count("label").alias("labelled"), F.count_if("mixed").alias("mixed"),
        F.countDistinct("label").alias("speakers"),
    )


def label_distribution(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows and share of all rows per label."""
    by = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("share", F.col("n") / by.agg(F.sum("n")).scalar())


def reason_counts(rows: DataFrame, reason: Column) -> DataFrame:
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def badges(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("character_id").isNull()).alias("unassigned"),
        F.count_if(is_blank(F.col("text"))).alias("blank"),
        F.count(F.lit(1)).alias("total"),
    )


def reference_clip(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The clip closest to four seconds, preferably between two and eight."""
    s = length_ms() / 1000
    cost = F.abs(s - 4) + F.when((s >= 2) & (s <= 8), 0.0).otherwise(1000.0)
    return rows.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(cost, F.col("ord"))).alias("r")).select("r.*")


def longest_line(rows: DataFrame, keys: list[str], limit: int = 48, default: str = "") -> DataFrame:
    """Longest text per group, cut to ``limit`` characters; the first one wins ties."""
    best = F.max_by("text", F.struct(F.length(strip(F.col("text"))), -F.col("ord")))
    return rows.groupBy(*keys).agg(best.alias("t")).select(
        *keys, F.substring(F.coalesce(F.when(~is_blank(F.col("t")), F.col("t")), F.lit(default)), 1, limit).alias("line")
    )


def latest(rows: DataFrame, by: str, n: int = 200) -> DataFrame:
    """The newest ``n`` rows, oldest first."""
    return rows.orderBy(F.col(by).desc(), F.col("task_id").desc()).limit(n).orderBy(by, "task_id")


def latest_checkpoint(files: DataFrame, pattern: str) -> DataFrame:
    """Per experiment: the file with the highest epoch in its name, then the newest."""
    raw = F.regexp_extract("name", pattern, 1)
    epoch = F.when(raw == "", -1).otherwise(raw.cast("int"))
    return files.withColumn("epoch", epoch).groupBy("exp").agg(
        F.max_by(F.struct("name", "epoch"), F.struct(F.col("epoch"), F.col("mtime"), -F.col("ord"))).alias("r")
    ).select("exp", "r.name", "r.epoch")


def log_tail(lines: DataFrame, n: int = 400) -> DataFrame:
    """Last ``n`` lines of the newest log per experiment."""
    from pyspark.sql import window as W

    newest = lines.groupBy("exp").agg(F.max_by("log", F.struct("mtime", "log")).alias("log"))
    w = W.Window.partitionBy("exp").orderBy(F.col("line_no").desc())  # top-n: limited before the shuffle
    return (
        lines.join(newest, ["exp", "log"]).withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    )


# --- holdouts and sharding ------------------------------------------------------

def every_nth(ratio: float) -> int:
    return max(1, round(1 / ratio)) if ratio and ratio > 0 else 0


def holdout_lines(lines: DataFrame, ratio: float) -> DataFrame:
    """Every n-th kept line of a finished manifest (ordered by ``seq``) is held out."""
    n = every_nth(ratio)
    numbered = number_all(lines, ["seq"], "line_no")
    return numbered.withColumn("is_val", (F.col("line_no") % n == 0) if n else F.lit(False))


def shard(lines: DataFrame, index: int, parts: int) -> DataFrame:
    """Rows index, index + parts, ... of a numbered table (0-based ``ord``)."""
    return lines.filter(F.col("ord") % parts == index)


def oversample(rows: DataFrame, keys: list[str], min_rows: int = 100) -> DataFrame:
    """Groups of fewer than ``min_rows`` rows are repeated; adds ``copy``. Empty stays empty."""
    small = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < min_rows)
    times = small.select(*keys, F.greatest(F.lit(2), F.floor(min_rows / F.col("_n"))).cast("int").alias("_t"))
    return (
        rows.join(times, keys, "left")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.coalesce("_t", F.lit(1)) - 1)))
        .drop("_t")
    )


def unique_names(wanted: DataFrame, existing: DataFrame, keys: list[str], first: int = 1) -> DataFrame:
    """``base``, ``base_1``, ... without meeting each other or ``existing`` names.

    Row number r of a base takes the r-th free name: its number is shifted past the
    taken suffixes below it. ``first`` is the first suffix (2 for experiment names).
    """
    from clipweave.plans.scan import prefix_scan, running_max

    numbered = number_rows(wanted, [*keys, "base"], ["ord"], "_r").withColumn("_k", F.col("_r") - 1)
    # taken suffix numbers of each base: 0 for the bare name, else 1, 2, ...
    suffix = F.regexp_extract("name", r"_(\d+)$", 1)
    step = suffix.try_cast("long") - (first - 1)
    taken = existing.select(*keys, F.col("name").alias("base"), F.lit(0).cast("long").alias("_s")).unionByName(
        existing.filter(suffix != "").filter(~suffix.startswith("0")).select(
            *keys, F.regexp_replace("name", r"_\d+$", "").alias("base"), step.alias("_s")
        )
    ).filter("_s >= 0").distinct()
    # the j-th taken suffix blocks every row whose number reaches s - j
    order = number_rows(taken, [*keys, "base"], ["_s"], "_j").withColumn("_at", F.col("_s") - (F.col("_j") - 1))
    none = F.lit(None).cast("long")
    both = order.select(*keys, "base", F.col("_at").alias("_p"), F.lit(0).alias("_side"), F.col("_j").alias("_block"),
                        none.alias("ord")).unionByName(
        numbered.select(*keys, "base", F.col("_k").alias("_p"), F.lit(1).alias("_side"), none.alias("_block"),
                        F.col("ord").cast("long").alias("ord")))
    seen = prefix_scan(both, [*keys, "base"], ["_p", "_side", "_block"], at=F.col("_p"),
                       _shift=running_max(F.col("_block")))
    number = F.col("_p") + F.coalesce("_shift", F.lit(0))
    return seen.filter("_side = 1").select(
        *keys, "ord", "base",
        F.when(number == 0, F.col("base")).otherwise(
            F.concat(F.col("base"), F.lit("_"), (number + (first - 1)).cast("string"))
        ).alias("name"),
    )
