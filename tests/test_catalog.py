"""A cross-section of the registered queries equals its SQL on the smallest tables."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from check_oracles import TABLES, compare  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SAMPLE = ["gap_ranges", "dominant_label", "rescan_assign", "export_plan_per_speaker", "locked_merge", "level_metrics",
          "pad_bucket", "cut_fifty", "dependency_ready", "rerun_stream"]


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, duck, name):
    assert compare(name, spark, duck, SF).startswith("ok")


@pytest.mark.parametrize("name", ["gap_ranges", "export_plan_flat", "align_to_speech"])
def test_equals_sql_with_hot_keys(spark, duck, name):
    spark.conf.set("clipweave.rowsPerCell", "40")
    try:
        assert compare(name, spark, duck, SF).startswith("ok")
    finally:
        spark.conf.unset("clipweave.rowsPerCell")


def test_contract(spark, duck):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["item_id", "seg_id", "label", "cover_ms", "total_ms", "mixed"]
