"""Small helpers for pandas frames inside tasks."""

from __future__ import annotations

import pandas as pd


def plain_strings(rows: pd.DataFrame) -> pd.DataFrame:
    """String columns as plain objects.

    Concatenated Arrow-backed strings come in several chunks, which the conversion back to
    Spark does not accept.
    """
    odd = [c for c, t in rows.dtypes.items() if isinstance(t, pd.StringDtype)]
    return rows.astype(dict.fromkeys(odd, object)) if odd else rows
