"""Token-array functions (Column -> Column) built on Spark's higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import IGNORE_INDEX


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _lit(v) -> Column:
    return F.lit(v) if isinstance(v, (int, float, str)) else _col(v)


def shift_compare(preds, labels, ignore: int = IGNORE_INDEX) -> Column:
    """Causal-shift comparison: ``preds[:-1]`` against ``labels[1:]``; labels equal to
    ``ignore`` are skipped. Returns ``struct(correct, total)``."""
    p, lab = _col(preds), _col(labels)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    m = F.greatest(F.size(lab) - 1, F.lit(0))
    pairs = F.arrays_zip(F.slice(p, 1, n).alias("p"), F.slice(lab, 2, m).alias("l"))
    scored = F.filter(pairs, lambda x: x["l"].isNotNull() & (x["l"] != F.lit(ignore)))
    correct = F.size(F.filter(scored, lambda x: x["p"] == x["l"]))
    return F.struct(correct.cast("long").alias("correct"), F.size(scored).cast("long").alias("total"))


def argmax_label(scores) -> Column:
    """0-based index of the largest score; the first index wins on ties."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def strip_prompt_ids(ids, prompt_len) -> Column:
    """Keep the generated part: ids from position ``prompt_len`` on."""
    a, n = _col(ids), _lit(prompt_len)
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def truncate_at_stop(ids, stop_ids) -> Column:
    """Cut a generated sequence before the first stop id (NULL stop ids are ignored)."""
    a = _col(ids)
    stops = F.array(*[F.lit(s) for s in stop_ids if s is not None]) if isinstance(stop_ids, (list, tuple)) \
        else F.filter(_col(stop_ids), lambda x: x.isNotNull())
    hits = F.filter(F.transform(a, lambda x, i: F.when(F.array_contains(stops, x), i)), lambda i: i.isNotNull())
    first = F.array_min(hits)
    return F.when(first.isNull(), a).otherwise(F.slice(a, 1, first))


def find_subarray(ids, needle, start) -> Column:
    """0-based position of the first occurrence of ``needle`` in ``ids`` at or after
    ``start``; NULL when absent."""
    a, nd, st = _col(ids), _col(needle), _lit(start)
    m = F.size(nd)
    last = F.size(a) - m
    # sequence(st, st) when there is no room; the outer condition discards it.
    starts = F.sequence(st, F.greatest(last, st))
    cand = F.filter(starts, lambda i: F.slice(a, i + 1, m) == nd)
    return F.when((last >= st) & (F.size(cand) > 0), F.element_at(cand, 1))


def response_start(tokens, prefix_len, marker) -> Column:
    """Position behind the first response marker at or after ``prefix_len`` (where the final
    assistant turn starts); NULL when it is absent."""
    nd = F.array(*[F.lit(x) for x in marker]) if isinstance(marker, (list, tuple)) else _col(marker)
    return find_subarray(tokens, nd, prefix_len) + F.size(nd)


def mask_before(ids, start, ignore: int = IGNORE_INDEX, strict: bool = True) -> Column:
    """Labels: ``ignore`` before ``start``, the ids from there on. A NULL start fails the
    query when ``strict``."""
    a, r = _col(ids), _col(start)
    masked = F.concat(F.array_repeat(F.lit(ignore), r), F.slice(a, r + 1, F.greatest(F.size(a) - r, F.lit(0))))
    if not strict:
        return masked
    return F.when(r.isNotNull(), masked).otherwise(
        F.raise_error(F.lit("response marker not found in the final assistant turn")).cast("array<int>"))


def label_mask(ids, prefix_len, marker_ids, ignore: int = IGNORE_INDEX, strict: bool = True,
               search=None) -> Column:
    """Training labels of one example: every id up to the end of the first response
    marker found in the final assistant turn (which starts at ``prefix_len``) is
    ``ignore``; the rest are kept. A missing marker fails the query when ``strict``.
    ``search`` is an array aligned with ``ids`` to look for the marker in (e.g. the
    token strings when the marker is given as text); default ``ids``."""
    a = _col(ids)
    return mask_before(a, response_start(a if search is None else _col(search), prefix_len, marker_ids), ignore, strict)


def attention_ones(ids) -> Column:
    return F.array_repeat(F.lit(1), F.size(_col(ids)))


def pad_to(values, length, pad_value, side: str = "left") -> Column:
    """Pad an array to ``length`` with ``pad_value`` on the given side."""
    a, n = _col(values), _lit(length)
    fill = F.array_repeat(_lit(pad_value), F.greatest(n - F.size(a), F.lit(0)))
    return F.concat(fill, a) if side == "left" else F.concat(a, fill)
