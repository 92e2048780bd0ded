"""Interval joins on (item, time bin), so a long or busy item spreads over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN_MS = 10_000


def _bins(start: Column, end: Column, width: int) -> Column:
    """All bins touched by the half-open range [start, end)."""
    return F.explode(
        F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))
    )


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    *,
    left_span: tuple[str, str] = ("start_ms", "end_ms"),
    right_span: tuple[str, str] = ("start_ms", "end_ms"),
    prefix: str = "r_",
    width: int = BIN_MS,
) -> DataFrame:
    """Pairs whose half-open ranges share time; right columns get ``prefix``.

    Each pair meets in every bin both ranges touch and is kept only in the bin of
    the later start, so no de-duplication shuffle is needed.
    """
    ls, le = left_span
    rs, re_ = (prefix + right_span[0], prefix + right_span[1])
    r = right.select(*keys, *[F.col(c).alias(prefix + c) for c in right.columns if c not in keys])
    lb = left.filter(F.col(le) > F.col(ls)).withColumn("_bin", _bins(F.col(ls), F.col(le), width))
    rb = r.filter(F.col(re_) > F.col(rs)).withColumn("_bin", _bins(F.col(rs), F.col(re_), width))
    pairs = lb.join(rb, [*keys, "_bin"]).filter(
        (F.col(ls) < F.col(re_))
        & (F.col(rs) < F.col(le))
        & (F.col("_bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width))
    )
    return pairs.drop("_bin")


def point_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: list[str],
    *,
    at: str = "t_ms",
    span: tuple[str, str] = ("start_ms", "end_ms"),
    slack: int = 0,
    closed: bool = False,
    prefix: str = "r_",
    width: int = BIN_MS,
) -> DataFrame:
    """Pairs with start - slack <= t < end + slack (<= with ``closed``)."""
    s, e = prefix + span[0], prefix + span[1]
    r = ranges.select(*keys, *[F.col(c).alias(prefix + c) for c in ranges.columns if c not in keys])
    extra = 1 if closed else 0
    rb = r.withColumn(
        "_bin", _bins(F.col(s) - slack, F.col(e) + slack + extra, width)
    )
    pb = points.withColumn("_bin", F.floor(F.col(at) / width))
    upper = F.col(at) <= F.col(e) + slack if closed else F.col(at) < F.col(e) + slack
    return (
        pb.join(rb, [*keys, "_bin"]).filter((F.col(at) >= F.col(s) - slack) & upper).drop("_bin")
    )


def overlap_ms(a: str, b: str, c: str, d: str) -> Column:
    """Shared length of [a, b) and [c, d); negative when they are apart."""
    return F.least(F.col(b), F.col(d)) - F.greatest(F.col(a), F.col(c))


def overlap_ratio(a: str, b: str, c: str, d: str) -> Column:
    """Shared length over the shorter length; 0 for invalid or separate ranges."""
    shared = overlap_ms(a, b, c, d)
    short = F.least(F.col(b) - F.col(a), F.col(d) - F.col(c))
    return F.when((shared > 0) & (short > 0), shared / short).otherwise(F.lit(0.0))
