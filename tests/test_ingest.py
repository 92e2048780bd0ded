"""Ingestion into hash buckets: what a batch rewrites, what a second run of it does, and any cut into batches."""

from __future__ import annotations

import glob
import os
import random

import pytest

from clipweave.session import scratch_path
from clipweave.streaming import runs as R
from clipweave.streaming.buckets import BucketTable
from clipweave.streaming.ingest import ingest_segments, merging

STORED = "item_id long, seg_id long, start_ms long, end_ms long, text string, locked boolean"
NEW = STORED + ", version long"


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def by_hand(stored, batches):
    """The table after every batch: the last version of an id wins unless the stored row is locked."""
    held = {(r[0], r[1]): r for r in stored}
    for batch in batches:
        newest = {}
        for r in batch:
            if (r[0], r[1]) not in newest or newest[r[0], r[1]][-1] < r[-1]:
                newest[r[0], r[1]] = r
        for key, r in newest.items():
            if key not in held or not held[key][5]:
                held[key] = r[:-1]
    return sorted(held.values())


@pytest.fixture
def tables():
    rng = random.Random(4)
    stored = [(i, s, s * 100, s * 100 + 90, "old", rng.random() < 0.3) for i in range(12) for s in range(4)]
    version = iter(range(1000))
    # half of all new rows belong to item 3
    new = [[(3 if rng.random() < 0.5 else rng.randrange(14), s := rng.randrange(6), s * 100, s * 100 + 90, f"b{b}", rng.random() < 0.2, next(version))
            for _ in range(15)] for b in range(4)]
    return stored, new


@pytest.mark.parametrize("per_batch", [1, 2])
def test_stream_equals_merging_by_hand(spark, tmp_path, tables, per_batch):
    stored, new = tables
    for i, rows in enumerate(new):
        spark.createDataFrame(rows, NEW).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        for f in glob.glob(str(tmp_path / f"part{i}/*.parquet")):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = R.file_stream(spark, f"{tmp_path}/*", spark.createDataFrame([], NEW).schema, per_batch)
    cut = [sum(new[i : i + per_batch], []) for i in range(0, 4, per_batch)]
    assert rows_of(ingest_segments(stream, spark.createDataFrame(stored, STORED), 5)) == by_hand(stored, cut)


def test_batch_rewrites_its_buckets_once(spark, tables):
    stored, new = tables
    table = BucketTable(scratch_path(spark, "segments"), spark.createDataFrame([], STORED).schema, "item_id", 64)
    table.create(spark.createDataFrame(stored, STORED))
    one = spark.createDataFrame([r for r in new[0] if r[0] == 3], NEW)
    merging(table)(one, 0)
    after = rows_of(table.read(spark))
    assert after == by_hand(stored, [[r for r in new[0] if r[0] == 3]])
    # one item, so one bucket of its own or shared with others
    (folder,) = glob.glob(f"{table.root}/data/v=0/bucket=*")
    assert [int(folder.rsplit("=")[-1])] == table.touched(one)
    # the batch again, with other rows: it is committed, so nothing changes
    merging(table)(spark.createDataFrame(new[1], NEW), 0)
    assert rows_of(table.read(spark)) == after and table.manifest(spark).filter("version = 0").count() == 1
    # data of an attempt that never committed is not read, and is replaced by the next attempt
    table._put(spark.createDataFrame([(3, 99, 0, 1, "lost", False)], STORED), 1)
    assert rows_of(table.read(spark)) == after
    merging(table)(spark.createDataFrame(new[1], NEW), 1)
    assert rows_of(table.read(spark)) == by_hand(after, [new[1]])


def test_empty_tables_and_null_items(spark):
    none = spark.createDataFrame([], STORED)
    table = BucketTable(scratch_path(spark, "segments"), none.schema, "item_id", 8)
    table.create(none)
    merging(table)(spark.createDataFrame([], NEW), 0)
    assert rows_of(table.read(spark)) == []
    merging(table)(spark.createDataFrame([(None, 1, 0, 5, "a", False, 1), (7, 1, 0, 5, "b", True, 1)], NEW), 1)
    assert sorted(map(str, table.read(spark).collect())) == sorted(
        ["Row(item_id=None, seg_id=1, start_ms=0, end_ms=5, text='a', locked=False)", "Row(item_id=7, seg_id=1, start_ms=0, end_ms=5, text='b', locked=True)"])
