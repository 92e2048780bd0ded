"""Places where user functions plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: rows of ranges -> one vector (or None) per row
Provider = Callable[[pd.DataFrame], list]


def embed_ranges(ranges: DataFrame, provider: Provider) -> DataFrame:
    """Adds ``emb`` from a user function that sees whole Arrow batches of ranges.

    Models and their weights live in the function; without one, join a vector table.
    """
    schema = T.StructType([*ranges.schema.fields, T.StructField("emb", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(emb=pd.Series(provider(batch), index=batch.index, dtype=object))

    return ranges.mapInPandas(run, schema)


def evaluate_distinct(rows: DataFrame, column: str, fn: Callable[[pd.Series], pd.Series], kind: str, name: str) -> DataFrame:
    """Run an expensive function once per distinct input and give every row its result."""
    once = F.pandas_udf(fn, kind) if hasattr(fn, "__annotations__") and fn.__annotations__ else _series_udf(fn, kind)
    known = rows.select(column).distinct().withColumn(name, once(F.col(column)))
    return rows.join(known, column, "left")


def _series_udf(fn: Callable[[pd.Series], pd.Series], kind: str) -> Callable:
    def call(values: pd.Series) -> pd.Series:
        return fn(values)

    return F.pandas_udf(call, kind)
