"""Line-oriented tables of the trainer: manifests, phonemes, semantic ids, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipweave.functions.text import strip
from clipweave.plans.export import manifest_line


def parse_manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``path|speaker|language|text`` lines to rows, and the lines that do not fit."""
    parts = lines.withColumn("_p", F.split("value", r"\|", -1))
    good = parts.filter(F.size("_p") == 4).select(
        F.col("_p")[0].alias("path"), F.col("_p")[1].alias("speaker"), F.col("_p")[2].alias("language"),
        strip(F.col("_p")[3]).alias("text"))
    return good, parts.filter((F.size("_p") != 4) & (F.length(strip(F.col("value"))) > 0)).select("value")


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_manifest(spark.read.option("lineSep", "\n").text(path))


def write_manifest(plan: DataFrame, path: str) -> None:
    """One manifest in ``seq`` order; parts keep the order of the whole."""
    lines = plan.filter("reason IS NULL").select("seq", manifest_line().alias("value"))
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.mode("overwrite").text(path)


def write_speaker_manifests(plan: DataFrame, path: str) -> None:
    """Manifests per speaker folder: ``list`` holds every row, ``val_list`` the held-out ones.

    Folders without validation rows get no ``val_list``.
    """
    from clipweave.plans.export import safe_name

    rows = plan.filter("reason IS NULL").select(
        safe_name(F.col("speaker")).alias("speaker_dir"), "seq", manifest_line().alias("value"),
        F.explode(F.when(F.col("is_val"), F.array(F.lit("list"), F.lit("val_list"))).otherwise(F.array(F.lit("list")))).alias("split"))
    (
        rows.repartitionByRange("speaker_dir", "split", "seq").sortWithinPartitions("speaker_dir", "split", "seq")
        .select("speaker_dir", "split", "value").write.mode("overwrite").partitionBy("speaker_dir", "split").text(path)
    )


def parse_phonemes(lines: DataFrame) -> DataFrame:
    """name, phones, word2ph, text by tabs; other rows go, the last of equal names stays.

    ``lines``: line_no, value.
    """
    p = lines.withColumn("_p", F.split("value", "\t", -1)).filter(F.size("_p") == 4)
    last = p.groupBy(F.col("_p")[0].alias("name")).agg(F.max_by("_p", "line_no").alias("_p"))
    return last.select("name", F.split(F.col("_p")[1], " ").alias("phones"), F.col("_p")[2].alias("word2ph"), F.col("_p")[3].alias("norm_text"))


def semantic_ids(rows: DataFrame) -> DataFrame:
    """``semantic`` = space-joined numbers to an array."""
    return rows.select("name", F.transform(F.split("semantic", " "), lambda x: x.cast("int")).alias("ids"))


def read_semantic(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("sep", "\t").option("header", "true").schema("name string, semantic string").csv(path)
    return semantic_ids(raw)


def write_semantic(rows: DataFrame, path: str) -> None:
    flat = rows.select("name", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("semantic"))
    flat.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def merge_parts(parts: DataFrame) -> DataFrame:
    """Non-blank lines of sharded outputs with ``ord`` in (part, line_no) order."""
    from clipweave.plans.scan import number_rows, plan_cells, prefix_scan, running_sum

    kept = parts.filter(F.length(strip(F.col("value"))) > 0)
    sizes = kept.groupBy("part").agg(F.count(F.lit(1)).alias("_m")).withColumn("_one", F.lit(0))
    known = plan_cells(kept, ["part"], F.col("line_no"))
    ahead = prefix_scan(sizes, ["_one"], ["part"], cells=known.subset(parts.sparkSession), _a=running_sum(F.col("_m"), False))
    placed = number_rows(kept, ["part"], ["line_no"], "_p", cells=known)
    return placed.join(ahead.select("part", F.coalesce("_a", F.lit(0)).alias("_a")), "part").select(
        (F.col("_a") + F.col("_p")).alias("ord"), "value")


def split_urls(raw: DataFrame, column: str = "raw") -> DataFrame:
    """A pasted block of URLs, one per line, to rows."""
    text = F.regexp_replace(column, "\r\n?", "\n")
    keep = [c for c in raw.columns if c != column]
    rows = raw.select(*keep, F.posexplode(F.split(text, "\n")).alias("line_no", "url"))
    return rows.withColumn("url", strip(F.col("url"))).filter("url <> ''")


def url_list(raw: DataFrame, column: str = "urls") -> DataFrame:
    """An array of URLs to rows; blank entries go."""
    keep = [c for c in raw.columns if c != column]
    rows = raw.select(*keep, F.posexplode(column).alias("line_no", "url"))
    return rows.withColumn("url", strip(F.col("url"))).filter("url <> ''")
