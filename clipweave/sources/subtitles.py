"""Subtitle files to cue rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.clock import STAMP, srt_stamp, stamp_ms
from clipweave.functions.text import strip
from clipweave.plans.scan import number_rows

PAIR = rf"{STAMP}\s*-->\s*{STAMP}"


def parse_srt(files: DataFrame, text: str = "text", keep: tuple[str, ...] = ("item_id",), strict: bool = False) -> DataFrame:
    """SubRip texts to cues. Blocks are split at blank lines; broken blocks are left out."""
    body = F.regexp_replace(strip(F.col(text)), "\r\n?", "\n")
    blocks = files.select(*keep, F.posexplode(F.split(body, r"\n\s*\n")).alias("block_no", "_b"))
    lines = F.filter(F.transform(F.split("_b", "\n"), strip), lambda x: F.length(x) > 0)
    blocks = blocks.withColumn("_l", lines).filter(F.size("_l") > 0)
    numbered = F.get("_l", F.lit(0)).rlike(r"^\d+$")
    blocks = blocks.withColumn("_l", F.when(numbered, F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0)))).otherwise(F.col("_l")))
    head = F.get("_l", F.lit(0))
    cues = blocks.filter(head.rlike(PAIR)).select(
        *keep, "block_no",
        stamp_ms(F.regexp_extract(head, f"({STAMP})\\s*-->", 1), 1000, strict).alias("start_ms"),
        stamp_ms(F.regexp_extract(head, f"-->\\s*({STAMP})", 1), 1000, strict).alias("end_ms"),
        strip(F.array_join(F.slice("_l", 2, F.greatest(F.size("_l") - 1, F.lit(0))), " ")).alias("text"),
    )
    return cues.filter("text <> ''")


def parse_ass(lines: DataFrame, line: str = "line", keep: tuple[str, ...] = ("item_id", "line_no")) -> DataFrame:
    """Dialogue lines of ASS/SSA files (one row per line, so files are splittable) to cues."""
    fields = F.split(F.regexp_extract(F.col(line), r"^Dialogue:\s*(.*)$", 1), ",", 10)
    clean = F.regexp_replace(F.regexp_replace(F.get("_f", F.lit(9)), r"\{[^}]*\}", ""), r"\\[Nn]", " ")
    return (
        lines.filter(F.col(line).startswith("Dialogue:"))
        .withColumn("_f", fields)
        .filter(F.size("_f") == 10)
        .select(*keep, stamp_ms(F.get("_f", F.lit(1)), 100).alias("start_ms"), stamp_ms(F.get("_f", F.lit(2)), 100).alias("end_ms"),
                strip(clean).alias("text"))
        .filter("text <> ''")
    )


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    """Cues of all subtitle files under ``path``, by extension; no files, no rows."""
    name = F.col("_metadata.file_path")
    reader = spark.read.option("recursiveFileLookup", "true")
    schema = "path string, ord long, start_ms long, end_ms long, text string"
    try:
        whole = reader.text(path, wholetext=True).withColumn("path", name)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
    is_ass = F.lower("path").rlike(r"\.(ass|ssa)$")
    srt = parse_srt(whole.filter(~is_ass).withColumnRenamed("value", "text"), keep=("path",))
    # one file is one row here, because line numbers are needed for the order of cues
    lines = whole.filter(is_ass).select("path", F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "line"))
    ass = parse_ass(lines, keep=("path", "line_no"))
    return srt.select("path", F.col("block_no").cast("long").alias("ord"), "start_ms", "end_ms", "text").unionByName(
        ass.select("path", F.col("line_no").cast("long").alias("ord"), "start_ms", "end_ms", "text"))


def srt_block(number: Column, start_ms: Column, end_ms: Column, text: Column) -> Column:
    return F.concat(
        number.cast("string"), F.lit("\n"), srt_stamp(start_ms), F.lit(" --> "), srt_stamp(end_ms), F.lit("\n"),
        strip(F.coalesce(text, F.lit(""))), F.lit("\n"))


def srt_blocks(cues: DataFrame) -> DataFrame:
    """One text row per cue: item_id, n (1-based index in the item) and the block."""
    numbered = number_rows(cues, ["item_id"], ["start_ms", "ord"], "n")
    return numbered.select("item_id", "n", srt_block(F.col("n"), F.col("start_ms"), F.col("end_ms"), F.col("text")).alias("value"))


def write_srt(cues: DataFrame, path: str) -> None:
    """SubRip files under ``path/item_id=...``.

    Rows are range-partitioned by (item, index): an item normally ends up in one file,
    a huge one in several consecutive parts instead of one huge task.
    """
    blocks = srt_blocks(cues)
    (
        blocks.repartitionByRange("item_id", "n").sortWithinPartitions("item_id", "n")
        .select("item_id", "value").write.mode("overwrite").partitionBy("item_id").text(path)
    )
