"""Numeric helpers shared by metrics and scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def py_round4(s: pd.Series) -> pd.Series:
    """Python's ``round(x, 4)`` (half-even on the exact binary value).

    Spark's ``round``/``bround`` work on the shortest decimal text of the double and
    disagree with Python on some ties, so the few values that are reported rounded go
    through this vectorised helper.
    """
    return pd.Series([None if v is None or pd.isna(v) else round(float(v), 4) for v in s], dtype="float64")


def ratio(num, den) -> Column:
    """``num / den`` as double; NULL when the denominator is 0 (ANSI-safe)."""
    n = F.col(num) if isinstance(num, str) else num
    d = F.col(den) if isinstance(den, str) else den
    return F.try_divide(n.cast("double"), d.cast("double"))


def format_metric(c, dp: int = 4) -> Column:
    """Display text of a metric with ``dp`` decimals, formatted the Python way
    (``f"{v:.4f}"``: half-even on the exact binary value). Display views only."""

    @F.pandas_udf(T.StringType())
    def fmt(s: pd.Series) -> pd.Series:
        return pd.Series([None if v is None or pd.isna(v) else f"{float(v):.{dp}f}" for v in s])

    return fmt(F.col(c) if isinstance(c, str) else c)
