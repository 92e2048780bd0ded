"""Keyed state over several micro-batches: any cut gives the same rows, keys expire, late rows are dropped."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest

from clipweave.session import scratch_path
from clipweave.streaming import runs as R
from clipweave.streaming import tasks as K

T0 = datetime(2024, 1, 1)


def stream(spark, tmp_path, schema, files, per_batch=1):
    """One Parquet file per list of rows, read in order, so many at a time."""
    top = tmp_path / f"in-{random.getrandbits(60):x}"
    top.mkdir()
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(top / f"part{i}"))
        for f in (top / f"part{i}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return R.file_stream(spark, f"{top}/*", spark.createDataFrame([], schema).schema, per_batch)


def run(spark, out):
    """(rows, keys in the state after each batch) of an append stream."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKS)
    query = (out.writeStream.outputMode("append").format("parquet").option("path", at := scratch_path(spark, "rows"))
             .option("checkpointLocation", scratch_path(spark, "state")).trigger(availableNow=True).start())
    query.awaitTermination()
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return sorted(tuple(r) for r in spark.read.schema(out.schema).parquet(at).collect()), left


def cuts(rows, n):
    return [rows[i * len(rows) // n : (i + 1) * len(rows) // n] for i in range(n)]


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_any_number_of_batches_gives_the_same_rows(spark, tmp_path):
    random.seed(8)
    kinds = ["pending", "running", "done", "error", "cancelled"]
    tasks = [(random.randint(0, 12), at(i), i, random.choice(kinds)) for i in range(240)]
    build = {
        "states": ("task_id long, ts timestamp, seq long, status string", tasks, lambda s: K.task_states(s, ttl_ms=10**9)),
        "progress": ("task_id long, ts timestamp, seq long, progress double, message string",
                     [(k, t, q, random.choice([None, random.random()]), random.choice([None, "a", "b"])) for k, t, q, _ in tasks], K.throttled_progress),
        "runs": ("project_id long, ts timestamp, seq long, kind string", [(k, t, q, random.choice(["request", "done", "failed"])) for k, t, q, _ in tasks], K.coalesced_runs),
        "queue": ("project_id long, ts timestamp, seq long, kind string, item_id string, seg_id string",
                  [(k % 2, t, q, "finish" if q % 40 == 39 else "sample", str(q % 3), str(q % 5)) for k, t, q, _ in tasks], K.feedback_batches),
    }
    for schema, rows, make in build.values():
        once, _ = run(spark, make(stream(spark, tmp_path, schema, [rows])))
        many, _ = run(spark, make(stream(spark, tmp_path, schema, cuts(rows, 3))))
        assert many == once and once


def test_terminal_tasks_are_forgotten_and_late_rows_dropped(spark, tmp_path):
    schema = "task_id long, ts timestamp, seq long, status string"
    files = [
        [(k, at(0), k, "running") for k in range(20)] + [(k, at(1), 100 + k, "done") for k in range(15)],
        [(99, at(300), 200, "pending")],  # moves the watermark far ahead
        [(98, at(301), 201, "pending"), (3, at(2), 202, "running"), (16, at(302), 203, "done")],  # one row is late
        [(3, at(303), 204, "pending")],  # a forgotten task may begin anew
    ]
    rows, left = run(spark, K.task_states(stream(spark, tmp_path, schema, files), ttl_ms=60_000, late="1 minute"))
    assert (3, at(2), 202, "running", 3) not in rows and all(r[2] != 202 for r in rows)
    assert (3, at(303), 204, "pending", 1) in rows and (16, at(302), 203, "done", 2) in rows
    assert len(rows) == 20 + 15 + 1 + 1 + 1 + 1
    assert max(left) > left[-1]


def test_idle_projects_keep_no_state(spark, tmp_path):
    schema = "project_id long, ts timestamp, seq long, kind string"
    files = [[(k, at(0), k, "request") for k in range(30)], [(k, at(1), 100 + k, "done") for k in range(30)], [(1, at(2), 300, "done")]]
    rows, left = run(spark, K.coalesced_runs(stream(spark, tmp_path, schema, files)))
    assert len(rows) == 30 and left[0] >= 30 and left[-1] == 0


@pytest.mark.parametrize("n", [1, 4])
def test_queue_sends_twenty_at_a_time_until_it_is_empty(spark, tmp_path, n):
    schema = "project_id long, ts timestamp, seq long, kind string, item_id string, seg_id string"
    rows = [(7, at(i), i, "sample", "a", str(i % 30)) for i in range(46)] + [(7, at(100 + i), 100 + i, "finish", None, None) for i in range(4)]
    got, _ = run(spark, K.feedback_batches(stream(spark, tmp_path, schema, cuts(rows, n))))
    batches = {}
    for _, no, _, seg, _, seq in got:
        batches.setdefault(no, []).append((seq, seg))
    # the first sample goes alone, the others wait: 20, 20 and 5; a segment's earliest stands for its repeats
    assert {k: len(v) for k, v in batches.items()} == {1: 1, 2: 20, 3: 20, 4: 5}
    assert sorted(batches[2]) == [(i, str(i % 30)) for i in range(1, 21)] and (30, "0") in batches[3]


def test_readiness_over_batches(spark, tmp_path):
    schema = "task_id long, n_upstream long, upstream long, ts timestamp, seq long, status string"
    files = [[(1, 2, 10, at(0), 0, "done"), (2, 2, 10, at(0), 1, "done")], [(1, 2, 11, at(1), 2, "done"), (2, 2, 11, at(1), 3, "error")], [(2, 2, 12, at(2), 4, "done")]]
    rows, _ = run(spark, K.readiness_stream(stream(spark, tmp_path, schema, files)))
    assert rows == [(1, at(1), "ready", 2), (2, at(1), "error", 1)]
