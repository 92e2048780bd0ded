"""Dataset export: grouping, ranking, holdout, skipping and numbering as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipweave.functions.text import strip
from clipweave.operators.segments import every_nth, skip_reason
from clipweave.plans.scan import Cells, number_ranked, number_rows, plan_cells, prefix_scan, running_sum


def safe_name(c: Column, limit: int = 64) -> Column:
    """A folder name: reserved characters and white space become ``_``."""
    clean = F.regexp_replace(F.coalesce(c, F.lit("")), r'[/\\:*?"<>|\x00\s　]', "_")
    clean = F.regexp_replace(clean, r"^[._ ]+|[._ ]+$", "")
    return F.substring(F.when(clean == "", "speaker").otherwise(clean), 1, limit)


def by_speaker(clips: DataFrame, default: str, known: Cells | None = None) -> DataFrame:
    """Default for blank speakers and ``speaker_no`` in order of first appearance."""
    named = clips.withColumn("speaker", F.coalesce(F.nullif(F.col("speaker"), F.lit("")), F.lit(default)))
    first = named.groupBy("speaker").agg(F.min("ord").alias("_f")).withColumn("_one", F.lit(0))
    numbered = prefix_scan(first, ["_one"], ["_f"], cells=known,
                           speaker_no=running_sum(F.lit(1).cast("long")))
    return named.join(numbered.select("speaker", "speaker_no"), "speaker")


def export_plan(clips: DataFrame, *, default_speaker: str = "speaker", per_speaker: bool = False,
                val_ratio: float = 0.0, min_ms: int = 800, min_score: float = 0.0) -> DataFrame:
    """All clips with their fate: ``reason`` (null = exported), place and file names.

    Within a speaker, scored clips come first by score, then the rest in input order.
    The holdout counts every row of the speaker, also those skipped later; files are
    numbered per folder over exported rows only.
    """
    counted = plan_cells(clips.select("speaker"), ["speaker"], F.lit(0))
    known = counted.subset(clips.sparkSession)
    grouped = by_speaker(clips, default_speaker, known)
    grouped = grouped.withColumn("_rank", -F.coalesce("score", F.lit(-1.0)))
    ranked = number_ranked(grouped, ["speaker"], "_rank", "ord", "place", cells=known)
    n = every_nth(val_ratio)
    val = (F.col("place") % n == 0) if per_speaker and n else F.lit(False)
    planned = ranked.withColumn("reason", skip_reason(min_ms, min_score)).withColumn("is_val", val)
    if per_speaker:
        folder = F.concat(safe_name(F.col("speaker")), F.when(F.col("is_val"), "/val").otherwise("/train"))
    else:
        folder = F.lit("")
    planned = planned.withColumn("folder", folder)

    kept = planned.filter("reason IS NULL")
    # running number over speakers: rows of earlier speakers plus the place in the own one
    sizes = kept.groupBy("speaker_no").agg(F.count(F.lit(1)).alias("_m")).withColumn("_one", F.lit(0))
    ahead = prefix_scan(sizes, ["_one"], ["speaker_no"], cells=known,
                        _ahead=running_sum(F.col("_m"), inclusive=False))
    ahead = ahead.select("speaker_no", F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    numbered = number_rows(kept, ["speaker_no"], ["place"], "_in_speaker", cells=known)
    numbered = numbered.join(ahead, "speaker_no").withColumn("seq", F.col("_ahead") + F.col("_in_speaker") - 1)
    if per_speaker:
        # folders may be shared by speakers with equal safe names, so number along seq
        numbered = number_rows(numbered, ["folder"], ["seq"], "file_no", cells=known)
    else:
        numbered = numbered.withColumn("file_no", F.col("seq") + 1)
    path = F.concat(
        F.when(F.col("folder") == "", "").otherwise(F.concat(F.col("folder"), F.lit("/"))),
        F.lpad(F.col("file_no").cast("string"), F.greatest(F.lit(3), F.length(F.col("file_no").cast("string"))), F.lit("0")),
        F.lit(".wav"),
    )
    done = numbered.withColumn("path", path).drop("_ahead", "_in_speaker")
    skipped = planned.filter("reason IS NOT NULL")
    return done.unionByName(skipped, allowMissingColumns=True).drop("_rank")


def manifest_line() -> Column:
    """``path|speaker|language|text``; a bar in the text becomes a space."""
    return F.concat_ws("|", "path", "speaker", "language", F.translate(strip(F.col("text")), "|", " "))


def speaker_summary(plan: DataFrame) -> DataFrame:
    """Exported rows per speaker, in order of first appearance."""
    return plan.filter("reason IS NULL").groupBy("speaker", "speaker_no").agg(
        F.count_if(~F.col("is_val")).alias("train"), F.count_if("is_val").alias("val")
    )


def resolve_sources(clips: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clips with their media path, and the rejects with an error each."""
    joined = clips.join(sources.select("item_id", F.col("path").alias("source")), "item_id", "left")
    blank = F.coalesce(F.col("item_id").cast("string"), F.lit("")) == ""
    error = F.when(blank, "clip without item").when(F.col("source").isNull(), "item without source")
    judged = joined.withColumn("error", error)
    return judged.filter("error IS NULL").drop("error"), judged.filter("error IS NOT NULL")


def clip_file_name(base: Column, ext: str = "wav") -> Column:
    """``base_MM-SS.s-MM-SS.s.ext`` for a range of an item."""

    def stamp(ms: Column) -> Column:
        ms = F.greatest(F.lit(0), ms)
        minutes = F.floor(ms / 60_000)
        rest = F.bround(ms - minutes * 60_000, -2)  # whole tenths, ties to even
        return F.format_string("%02d-%04.1f", minutes, rest / 1000)

    return F.concat(base, F.lit("_"), stamp(F.col("start_ms")), F.lit("-"), stamp(F.col("end_ms")), F.lit("." + ext))
