"""Vector expressions and the base64 wire form."""

from __future__ import annotations

import base64
import binascii

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def unit(a: Column) -> Column:
    """L2-normalised vector."""
    return F.get(
        F.transform(F.array(norm(a) + EPS), lambda n: F.transform(a, lambda x: x / n)), F.lit(0)
    )


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


@F.pandas_udf(T.StringType())
def encode_vector(v: pd.Series) -> pd.Series:
    """Little-endian float32 bytes in base64."""
    return v.map(
        lambda x: None if x is None else base64.b64encode(np.asarray(x, "<f4").tobytes()).decode()
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def decode_vector(s: pd.Series) -> pd.Series:
    """Inverse of ``encode_vector``; null for anything that is no such vector."""

    def one(x: object) -> object:
        if not isinstance(x, str) or not x:
            return None
        try:
            return np.frombuffer(base64.b64decode(x), "<f4")
        except (binascii.Error, ValueError):
            return None

    return s.map(one)
