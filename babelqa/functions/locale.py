"""Subset-code (``Lang_Ctry``) parsing and model-family detection."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def subset_parts_strict(subset) -> tuple[Column, Column]:
    """``split('_')`` must give exactly two parts; otherwise the query fails with an
    error that names the value."""
    s = _col(subset)
    parts = F.split(s, "_")
    ok = s.isNotNull() & (F.size(parts) == 2)
    err = F.raise_error(F.concat(F.lit("subset is not Lang_Ctry: "), F.coalesce(s, F.lit("NULL"))))
    lang = F.when(ok, F.get(parts, 0)).otherwise(err.cast("string"))
    country = F.when(ok, F.get(parts, 1)).otherwise(err.cast("string"))
    return lang, country


def subset_parts_lenient(subset) -> tuple[Column, Column]:
    """Split at the first ``_``: no ``_`` -> (whole, ''); NULL -> ('', '')."""
    s = _col(subset)
    parts = F.split(s, "_", 2)
    lang = F.coalesce(F.get(parts, 0), F.lit(""))
    country = F.coalesce(F.get(parts, 1), F.lit(""))
    return lang, country


def lang_of(subset, unknown: str | None = "unknown") -> Column:
    """Language prefix: text before the first ``_``; empty/NULL subset -> ``unknown``."""
    s = _col(subset)
    prefix = F.substring_index(s, "_", 1)
    if unknown is None:
        return prefix
    return F.when(s.isNull() | (s == ""), F.lit(unknown)).otherwise(prefix)


def model_family(model_id) -> Column:
    """``aya`` when the lower-cased id contains ``aya``; everything else is ``qwen``."""
    return F.when(F.lower(_col(model_id)).contains("aya"), F.lit("aya")).otherwise(F.lit("qwen"))
