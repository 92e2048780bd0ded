"""Ordered scans that survive hot keys.

A window over ``partitionBy(item)`` sends a whole item to one task. That is the
best plan while every item is small, and a dead end when one item holds a third
of the table. ``prefix_scan`` therefore looks at the key counts first:

* no key above ``rowsPerCell``: one plain window, one shuffle;
* otherwise the rows of each hot key are cut along the order axis into cells of
  about that many rows. Each cell is scanned alone, the cell totals (a few
  thousand rows) are scanned once more, and the carry is joined back.

Both forms return the same values; tests compare them with tiny cells.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from clipweave.session import ROWS_PER_CELL, setting

MAX_CELLS = 4096


@dataclass(frozen=True)
class Cells:
    """Split points of the hot keys; ``table`` is None when no key is hot.

    At most ``MAX_CELLS`` keys can hold more than 1/MAX_CELLS of the rows each, so
    the table is small whatever the data size, and safe to broadcast.
    """

    keys: tuple[str, ...]
    table: DataFrame | None
    total: int | None = None  # rows of the table that was counted

    def subset(self, spark: SparkSession) -> Cells | None:
        """Plan for any table made from some of the counted rows.

        A table that fits one cell as a whole has no hot key, whatever it is grouped
        by; otherwise None: count again.
        """
        small = self.total is not None and self.total <= setting(spark, "rowsPerCell", ROWS_PER_CELL)
        return Cells(self.keys, None, self.total) if small else None

    def attach(self, df: DataFrame, at: Column) -> DataFrame:
        """Add ``_cell`` (0-based, non-decreasing in ``at``; -1 for normal keys)."""
        if self.table is None:
            return df.withColumn("_cell", F.lit(-1))
        value = at.cast("double")
        cell = F.size(F.filter("_bounds", lambda b: b <= value))
        return (
            df.join(F.broadcast(self.table), list(self.keys), "left")
            .withColumn("_cell", F.when(F.col("_bounds").isNull(), -1).otherwise(cell))
            .drop("_bounds")
        )


def plan_cells(
    df: DataFrame, keys: list[str], at: Column, rows: int | None = None, counts: DataFrame | None = None
) -> Cells:
    """Count rows per key and choose split points for the keys that are too big.

    ``counts`` (keys, _n) replaces the count of ``df`` where it is known from smaller
    tables.
    """
    spark = df.sparkSession
    rows = rows or setting(spark, "rowsPerCell", ROWS_PER_CELL)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, largest = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not largest or largest <= rows:
        return Cells(tuple(keys), None, total or 0)
    limit = max(rows, total // MAX_CELLS)
    hot = counts.filter(F.col("_n") > limit)
    steps = min(MAX_CELLS, -(-largest // limit))
    if steps < 2:
        return Cells(tuple(keys), None, total)
    points = [i / steps for i in range(1, steps)]
    bounds = (
        df.withColumn("_at", at.cast("double"))
        .join(F.broadcast(hot), keys)
        .groupBy(*keys, "_n")
        .agg(F.percentile_approx("_at", points, 10 * steps).alias("_all"))
    )
    every = F.greatest(F.lit(1), F.floor(F.lit(steps) * limit / F.col("_n"))).cast("int")
    bounds = bounds.withColumn("_every", every).select(
        *keys,
        F.array_distinct(
            F.filter("_all", lambda x, i: (i + 1) % F.col("_every") == 0)
        ).alias("_bounds"),
    )
    kept = bounds.collect()  # at most MAX_CELLS keys, about 2 * MAX_CELLS numbers
    return Cells(tuple(keys), spark.createDataFrame(kept, bounds.schema), total)


@dataclass(frozen=True)
class Scan:
    kind: str  # sum | max | min | prev | fill
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Scan:
    return Scan("sum", value, inclusive)


def running_max(value: Column, inclusive: bool = True) -> Scan:
    return Scan("max", value, inclusive)


def running_min(value: Column, inclusive: bool = True) -> Scan:
    return Scan("min", value, inclusive)


def neighbour(value: Column) -> Scan:
    """Value of the row just before (just after, when the scan is reversed)."""
    return Scan("prev", value, False)


def filled(value: Column, inclusive: bool = True) -> Scan:
    """Last non-null value seen so far: the as-of lookup."""
    return Scan("fill", value, inclusive)


def _merge(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).otherwise(carry + F.coalesce(local, F.lit(0)))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def _over(kind: str, value: Column, window) -> Column:
    if kind in ("sum", "max", "min"):
        return getattr(F, kind)(value).over(window)
    return F.last(value, ignorenulls=kind == "fill").over(window)


def prefix_scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    *,
    at: str | Column | None = None,
    cells: Cells | None = None,
    reverse: bool = False,
    **scans: Scan,
) -> DataFrame:
    """Running aggregates per key in ascending ``order`` (descending if ``reverse``).

    ``at`` is the numeric axis used to cut hot keys; it must be non-decreasing in
    ``order`` and defaults to its first column. Keys must not be null.
    """
    axis = F.col(order[0]) if at is None else (F.col(at) if isinstance(at, str) else at)
    if cells is None:
        cells = plan_cells(df, keys, axis)
    wrapped = {
        # "prev" must tell "no row before" from "null value before"
        n: Scan(s.kind, F.struct(s.value.alias("v")) if s.kind == "prev" else s.value, s.inclusive)
        for n, s in scans.items()
    }
    sort = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]

    def finish(out: DataFrame) -> DataFrame:
        for n, s in wrapped.items():
            if s.kind == "prev":
                out = out.withColumn(n, F.col(n)["v"])
        return out

    def local(frame: DataFrame, parts: list[str]) -> DataFrame:
        base = W.Window.partitionBy(*parts).orderBy(*sort)
        cols = {
            n: _over(
                s.kind,
                s.value,
                base.rowsBetween(W.Window.unboundedPreceding, 0 if s.inclusive else -1),
            )
            for n, s in wrapped.items()
        }
        return frame.withColumns(cols)

    if cells.table is None:
        return finish(local(df, keys))

    celled = cells.attach(df, axis)
    scanned = local(celled, [*keys, "_cell"])
    place = F.struct(*[F.col(c) for c in order])
    pick = F.min_by if reverse else F.max_by
    totals = []
    for n, s in wrapped.items():
        if s.kind in ("sum", "max", "min"):
            totals.append(getattr(F, s.kind)(s.value).alias(f"_t_{n}"))
        else:
            where = place if s.kind == "prev" else F.when(s.value.isNotNull(), place)
            totals.append(pick(s.value, where).alias(f"_t_{n}"))
    step = F.col("_cell").desc() if reverse else F.col("_cell").asc()
    before = (
        W.Window.partitionBy(*keys).orderBy(step).rowsBetween(W.Window.unboundedPreceding, -1)
    )
    carried = (
        celled.filter("_cell >= 0")
        .groupBy(*keys, "_cell")
        .agg(*totals)
        .select(
            *keys,
            "_cell",
            *[
                (
                    _over(s.kind, F.col(f"_t_{n}"), before)
                    if s.kind in ("sum", "max", "min")
                    else F.last(f"_t_{n}", ignorenulls=True).over(before)
                ).alias(f"_c_{n}")
                for n, s in wrapped.items()
            ],
        )
    )
    joined = scanned.join(carried, [*keys, "_cell"], "left")
    joined = joined.withColumns(
        {n: _merge(s.kind, F.col(f"_c_{n}"), F.col(n)) for n, s in wrapped.items()}
    )
    return finish(joined.drop("_cell", *[f"_c_{n}" for n in wrapped]))


def number_rows(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    name: str,
    *,
    at: str | Column | None = None,
    cells: Cells | None = None,
) -> DataFrame:
    """1-based ``row_number`` per key, safe for hot keys."""
    return prefix_scan(
        df, keys, order, at=at, cells=cells, **{name: running_sum(F.lit(1).cast("long"))}
    )


def number_all(df: DataFrame, order: list[str], name: str, cells: Cells | None = None) -> DataFrame:
    """1-based numbering of the whole table; cut along the first order column."""
    one = df.withColumn("_all_rows", F.lit(0))
    return number_rows(one, ["_all_rows"], order, name, cells=cells).drop("_all_rows")


def number_ranked(
    df: DataFrame, keys: list[str], rank: str, order: str, name: str, cells: Cells | None = None
) -> DataFrame:
    """Number rows per key by (``rank`` ascending, ``order`` ascending).

    ``rank`` may repeat a lot (scores), so it is no axis to cut along. The number is
    the count of rows in better ranks, taken from the aggregated (key, rank) table,
    plus the place among rows of equal rank, cut along the unique ``order``.
    """
    if cells is None:
        cells = plan_cells(df, keys, F.lit(0))
    if cells.table is None:
        return number_rows(df, keys, [rank, order], name, cells=cells)
    ranks = df.groupBy(*keys, rank).agg(F.count(F.lit(1)).alias("_m"))
    ahead = prefix_scan(
        ranks, keys, [rank], _ahead=running_sum(F.col("_m"), inclusive=False)
    ).select(*keys, rank, F.coalesce("_ahead", F.lit(0)).alias("_ahead"))
    placed = number_rows(df, [*keys, rank], [order], "_place")
    return (
        placed.join(ahead, [*keys, rank])
        .withColumn(name, F.col("_ahead") + F.col("_place"))
        .drop("_ahead", "_place")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

