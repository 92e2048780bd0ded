"""Homogeneous batches: chains of batch starts across cells, against a loop over sorted rows."""

from __future__ import annotations

import random

import pytest

from clipweave.operators.batches import homogeneous_batches


def looped(rows, batch, threshold):
    out = {}
    for lang in {r[0] for r in rows}:
        left, no = sorted((n, o) for g, o, n in rows if g == lang), 0
        while left:
            for n in range(min(batch, len(left)), 0, -1):
                some = [x for x, _ in left[:n]]
                if n == 1 or (sum(some) > 0 and some[n // 2] * n >= threshold * sum(some)):
                    break
            out |= {(lang, o): no for _, o in left[:n]}
            left, no = left[n:], no + 1
    return out


@pytest.mark.parametrize(("batch", "cell"), [(8, 250_000), (8, 11), (4, 4), (1, 3)])
def test_batches_equal_a_loop(spark, batch, cell):
    random.seed(3)
    rows = [(g, 1000 * k + i, random.choice([0, 0, 1, 3, random.randint(1, 50), random.randint(1, 5000)])) for k, (g, m) in enumerate([("a", 157), ("b", 1), ("c", 12), ("d", 33)]) for i in range(m)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "lang string, ord long, n_chars long, entry string").repartition(3)
    spark.conf.set("clipweave.batchCell", str(cell))
    try:
        got = {(r.lang, r.ord): r.batch_no for r in homogeneous_batches(frame, ["lang"], batch).collect()}
    finally:
        spark.conf.unset("clipweave.batchCell")
    assert got == looped(rows, batch, 0.75)
