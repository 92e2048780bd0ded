"""Scans and folds give the same result with and without hot-key cells."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipweave.plans.fold import ordered_fold
from clipweave.plans.overlap import overlap_join, point_join
from clipweave.plans.scan import (
    filled,
    neighbour,
    number_ranked,
    prefix_scan,
    running_max,
    running_min,
    running_sum,
)


def _table(spark, n=120, seed=3):
    rnd = random.Random(seed)
    data = [
        (rnd.choice(["hot", "hot", "hot", "a", "b"]), rnd.randrange(40), i, rnd.choice([None, 1, 5, -3, 8]))
        for i in range(n)
    ]
    return data, spark.createDataFrame(data, "k string, t long, o long, v long")


def _expected(data, reverse):
    out = {}
    for k in {d[0] for d in data}:
        seq = sorted((d for d in data if d[0] == k), key=lambda d: (d[1], d[2]), reverse=reverse)
        total, top, low, last, fill = None, None, None, None, None
        for _, _, o, v in seq:
            prev = last
            before = total
            if v is not None:
                total = v if total is None else total + v
                top = v if top is None else max(top, v)
                low = v if low is None else min(low, v)
                fill = v
            last = v
            out[o] = (total, before, top, low, prev, fill)
    return out


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("cells", [2_000_000, 5])
def test_prefix_scan(spark, reverse, cells):
    spark.conf.set("clipweave.rowsPerCell", str(cells))
    try:
        data, df = _table(spark)
        got = prefix_scan(
            df, ["k"], ["t", "o"], reverse=reverse, s=running_sum(F.col("v")), e=running_sum(F.col("v"), False),
            m=running_max(F.col("v")), w=running_min(F.col("v")), p=neighbour(F.col("v")), f=filled(F.col("v")),
        )
        have = {r["o"]: (r["s"], r["e"], r["m"], r["w"], r["p"], r["f"]) for r in got.collect()}
        assert have == _expected(data, reverse)
    finally:
        spark.conf.unset("clipweave.rowsPerCell")


def test_number_ranked_with_many_equal_ranks(spark, tiny_cells):
    df = spark.range(60).select(F.lit("g").alias("k"), (F.col("id") % 2).alias("r"), F.col("id").alias("o"))
    got = {r["o"]: r["n"] for r in number_ranked(df, ["k"], "r", "o", "n").collect()}
    order = sorted(range(60), key=lambda i: (i % 2, i))
    assert got == {o: i + 1 for i, o in enumerate(order)}


@pytest.mark.parametrize("cells", [2_000_000, 5])
def test_ordered_fold(spark, cells):
    spark.conf.set("clipweave.rowsPerCell", str(cells))
    try:
        _, df = _table(spark, 90)

        def step(rows, state):
            acc = int(state or 0)
            out = []
            for o, t in zip(rows["o"], rows["t"], strict=True):
                acc = 0 if acc > 50 else acc + int(t)  # depends on the resolved row before
                out.append((int(o), acc))
            return pd.DataFrame(out, columns=["o", "acc"]), str(acc)

        def finish(key, state):
            return pd.DataFrame({"o": [-len(key[0])], "acc": [int(state)]})

        got = sorted(tuple(r) for r in ordered_fold(df, ["k"], ["t", "o"], step, "o long, acc long", finish=finish).collect())
        want = []
        for k in ("hot", "a", "b"):
            acc = 0
            for r in sorted((r for r in df.collect() if r["k"] == k), key=lambda r: (r["t"], r["o"])):
                acc = 0 if acc > 50 else acc + r["t"]
                want.append((r["o"], acc))
            want.append((-len(k), acc))
        assert got == sorted(want)
    finally:
        spark.conf.unset("clipweave.rowsPerCell")


def test_overlap_join_matches_nested_loops(spark):
    rnd = random.Random(1)
    span = lambda i: (1, i, s := rnd.randrange(-50, 400), s + rnd.randrange(-3, 90))
    left, right = [span(i) for i in range(60)], [span(i) for i in range(60)]
    a = spark.createDataFrame(left, "item_id long, x long, start_ms long, end_ms long")
    b = spark.createDataFrame(right, "item_id long, y long, start_ms long, end_ms long")
    got = sorted((r["x"], r["r_y"]) for r in overlap_join(a, b, ["item_id"], width=32).collect())
    want = sorted((p[1], q[1]) for p in left for q in right
                  if p[3] > p[2] and q[3] > q[2] and p[2] < q[3] and q[2] < p[3])
    assert got == want
    pts = a.select("item_id", "x", F.col("start_ms").alias("t_ms"))
    hit = sorted((r["x"], r["r_y"]) for r in point_join(pts, b, ["item_id"], width=32).collect())
    assert hit == sorted((p[1], q[1]) for p in left for q in right if q[2] <= p[2] < q[3])
