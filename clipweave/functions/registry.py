"""Names for text segmentation methods and small SQL functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from clipweave.functions import text

#: name -> builder of an array<string> column
_METHODS: dict[str, Callable[[Column], Column]] = {}


def register_segmentation(name: str) -> Callable:
    """Decorator: make a text segmentation available under ``name``."""

    def keep(builder: Callable[[Column], Column]) -> Callable[[Column], Column]:
        _METHODS[name] = builder
        return builder

    return keep


def segmentation(name: str) -> Callable[[Column], Column]:
    if name not in _METHODS:
        raise ValueError(f"unknown segmentation {name!r}; known: {', '.join(_METHODS)}")
    return _METHODS[name]


def segmentation_names() -> list[str]:
    return list(_METHODS)


for _name, _builder in (
    ("cut0", text.cut_none),
    ("cut1", text.cut_fours),
    ("cut2", text.cut_fifty),
    ("cut3", text.cut_full_stops),
    ("cut4", text.cut_periods),
    ("cut5", text.cut_clauses),
):
    register_segmentation(_name)(_builder)

#: SQL functions, created per session; bodies are plain SQL and stay in the JVM
_SQL_FUNCTIONS = {
    "cw_overlap_ms(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS BIGINT":
        "least(b, d) - greatest(a, c)",
    "cw_overlap_ratio(a BIGINT, b BIGINT, c BIGINT, d BIGINT) RETURNS DOUBLE":
        "CASE WHEN least(b, d) > greatest(a, c) AND least(b - a, d - c) > 0 "
        "THEN (least(b, d) - greatest(a, c)) / least(b - a, d - c) ELSE 0D END",
    "cw_score_band(q DOUBLE) RETURNS STRING":
        "CASE WHEN q IS NULL THEN '' WHEN q >= 80 THEN 'good' WHEN q >= 60 THEN 'fair' ELSE 'poor' END",
    "cw_cosine(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE":
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, v) -> s + v) / "
        "((sqrt(aggregate(a, 0D, (s, v) -> s + v * v)) + 1e-9) * "
        "(sqrt(aggregate(b, 0D, (s, v) -> s + v * v)) + 1e-9))",
    "cw_language(code STRING) RETURNS STRING":
        "CASE upper(coalesce(code, '')) WHEN 'JP' THEN 'ja' WHEN 'ZH' THEN 'zh' WHEN 'EN' THEN 'en' "
        "WHEN 'JA' THEN 'ja' WHEN 'JA-JP' THEN 'ja' ELSE lower(coalesce(nullif(code, ''), 'ja')) END",
}

#: table functions for LATERAL use
_SQL_TABLES = {
    "cw_windows(s BIGINT, e BIGINT) RETURNS TABLE(ws BIGINT, we BIGINT)":
        "SELECT s + k * 500, least(s + k * 500 + 1400, e) FROM (SELECT explode(CASE WHEN e - s >= 300 "
        "THEN sequence(0L, CAST(floor((e - s - 300) / 500) AS BIGINT)) ELSE array() END) AS k)",
    "cw_chunks(total BIGINT, len BIGINT) RETURNS TABLE(cs BIGINT, ce BIGINT)":
        "SELECT k * len, least((k + 1) * len, total) FROM (SELECT explode(CASE WHEN total > 0 THEN "
        "sequence(0L, (total - 1) div len) ELSE array() END) AS k) "
        "WHERE least((k + 1) * len, total) - k * len >= 500",
}


def register_sql(spark: SparkSession) -> None:
    """Create the temporary SQL scalar and table functions in this session."""
    for head, body in _SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    for head, body in _SQL_TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
