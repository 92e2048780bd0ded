"""Candidates for missed speech: uncovered gaps that contain voice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipweave.operators.intervals import gaps, intersect
from clipweave.plans.scan import number_rows


def gap_candidates(segments: DataFrame, items: DataFrame, speech: DataFrame, *, min_ms: int = 600,
                   max_ms: int = 15_000, limit: int | None = None) -> DataFrame:
    """Uncovered voice ranges per project, numbered by ``ord``, items in creation order.

    A caller that proposes only so many rows at a time names a ``limit``.
    """
    inside = intersect(gaps(segments, items), speech).filter(
        (F.col("end_ms") - F.col("start_ms")).between(min_ms, max_ms)
    )
    placed = inside.join(items.select("item_id", "project_id", "created"), "item_id")
    numbered = number_rows(placed, ["project_id"], ["created", "item_id", "start_ms", "end_ms"], "ord")
    return numbered if limit is None else numbered.filter(F.col("ord") <= limit)
