"""Joint speaker identification for all items of many projects, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.operators import vectors as V
from clipweave.operators.intervals import emit_turns, label_runs
from clipweave.plans.nearest import best_matches
from clipweave.session import cut


@dataclass
class Identified:
    lines: DataFrame  # project_id, item_id, ord, start_ms, end_ms, label, mixed
    turns: DataFrame  # project_id, item_id, start_ms, end_ms, label
    centroids: DataFrame  # project_id, label, ord, centroid in the original space


def number_by_appearance(rows: DataFrame, keys: list[str], group: str, order: list[str], name: str) -> DataFrame:
    """0-based number of each group in the order of its first row."""
    from clipweave.plans.scan import prefix_scan, running_sum

    first = rows.filter(F.col(group).isNotNull()).groupBy(*keys, group).agg(
        F.min(F.struct(*[F.col(c) for c in order])).alias("_f")
    )
    flat = first.select(*keys, group, *[F.col("_f")[c].alias(f"_o_{c}") for c in order])
    if not keys:
        flat = flat.withColumn("_one", F.lit(0))
    numbered = prefix_scan(
        flat, keys or ["_one"], [f"_o_{c}" for c in order],
        **{name: running_sum(F.lit(1).cast("long"), inclusive=False)},
    )
    numbered = numbered.select(*keys, group, F.coalesce(name, F.lit(0)).alias(name))
    return rows.join(numbered, [*keys, group], "left")


PROJECT = ("project_id",)
ITEM = ("project_id", "item_id")


def identify(cues: DataFrame, windows: DataFrame) -> Identified:
    """Cues and their window vectors of many projects to turns and line labels, each project by itself.

    ``cues``: project_id, item_id, ord, start_ms, end_ms; ``windows``: project_id, item_id, ord,
    ws, we, emb. Steps: trimmed mean per cue, item mean subtraction, clustering over the whole
    project, window votes, sequence smoothing, mixed-line test, turns. Every step is keyed by
    project and item, so items of two projects may share an id, and labels (speaker1, speaker2,
    ... by first appearance) belong to their project.
    """
    line = [*ITEM, "ord"]
    # each cut ends a costly stage whose rows several later steps read
    raw = cut(V.trimmed_mean(windows, line, "ws").select(*line, "emb"))
    centred, moved = V.subtract_item_mean(raw, windows, item=ITEM)
    timed = centred.join(cues.select(*line, "start_ms", "end_ms"), line)
    # clustering wants one running order over the project: item, then cue start
    named = cut(V.cluster_lines(number_project(timed), list(PROJECT)))
    named = number_by_appearance(
        named.select(*ITEM, F.col("cue").alias("ord"), F.col("ord").alias("seq"), "cluster", "emb"),
        list(PROJECT), "cluster", ["seq"], "num",
    )
    named = cut(named.withColumn("label", F.concat(F.lit("speaker"), (F.col("num") + 1).cast("string"))))
    label = [*PROJECT, "label"]
    order = named.filter("label IS NOT NULL").groupBy(*label).agg(F.min("num").alias("ord"))
    cents = cut(V.centroids(named, label).join(order, label).select(*label, "ord", "centroid"))
    original = V.centroids(named.select(*line, "label").join(raw, line), label)

    pool = cents.select(*PROJECT, F.col("label").alias("char_id"), "ord", F.col("centroid").alias("emb"))
    voted = best_matches(moved.join(named.select(*line), line, "left_semi"), pool, keys=list(PROJECT), k=1)
    voted = cut(voted.select(*line, F.col("ws").alias("start_ms"), F.col("we").alias("end_ms"),
                             F.get("matches", F.lit(0))["char_id"].alias("label")))
    vote = V.majority(voted, line, "label", "start_ms").select(*line, "label")
    runs = label_runs(voted, line, max_gap=375)
    lines = cues.select(*line, "start_ms", "end_ms").join(vote, line, "left").join(named.select(*line, "emb"), line, "left")
    smooth = V.smooth_labels(lines, cents, item=ITEM, project=PROJECT)
    smooth = cut(smooth.drop("label", "emb").withColumnRenamed("smoothed", "label"))
    judged = V.mixed_lines(smooth, runs, item=ITEM)
    return Identified(
        lines=judged.select(*line, "start_ms", "end_ms", "label", F.col("side").isNotNull().alias("mixed")),
        turns=emit_turns(judged, ITEM).select(*ITEM, "start_ms", "end_ms", "label"),
        centroids=original.join(order, label),
    )


def number_project(rows: DataFrame) -> DataFrame:
    """``ord`` becomes a running number over (item, start) of the project; the old one stays as ``cue``."""
    from clipweave.plans.scan import prefix_scan, running_sum

    per_item = rows.groupBy(*ITEM).agg(F.count(F.lit(1)).alias("_m"))
    ahead = prefix_scan(per_item, list(PROJECT), ["item_id"], _a=running_sum(F.col("_m"), inclusive=False))
    inner = prefix_scan(rows, list(ITEM), ["start_ms", "ord"], _p=running_sum(F.lit(1).cast("long")))
    return (
        inner.join(ahead.select(*ITEM, F.coalesce("_a", F.lit(0)).alias("_a")), list(ITEM))
        .withColumnRenamed("ord", "cue")
        .withColumn("ord", F.col("_a") + F.col("_p"))
        .drop("_a", "_p")
    )
