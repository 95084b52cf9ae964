"""Scalar text functions (Column -> Column), all JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import FALLBACK_ANSWER, LOSSLESS_TOKEN_PATTERN, PY_WHITESPACE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``: remove every Unicode whitespace character at both ends.

    ``F.trim`` alone removes spaces only; with an explicit character set it strips exactly
    the characters Python treats as whitespace.
    """
    return F.trim(_col(c), F.lit(PY_WHITESPACE))


def is_blank(c) -> Column:
    """True when the text is empty after a Python strip (NULL stays NULL)."""
    return py_strip(c) == F.lit("")


def with_fallback(c, fallback: str = FALLBACK_ANSWER) -> Column:
    """A blank generation is replaced by the fixed refusal sentence."""
    c = _col(c)
    return F.when(is_blank(c), F.lit(fallback)).otherwise(c)


def strip_thinking(c, question=None) -> Column:
    """Remove ``<think>...</think>`` blocks (non-greedy, across lines), strip, then delete
    every occurrence of the question when it is non-empty. No second strip."""
    text = py_strip(F.regexp_replace(_col(c), r"(?s)<think>.*?</think>", ""))
    if question is None:
        return text
    q = _col(question)
    return F.when(q.isNull() | (q == ""), text).otherwise(F.replace(text, q, F.lit("")))


def strip_echo(c, question) -> Column:
    """Delete every occurrence of the question, then strip (order differs from
    ``strip_thinking``)."""
    q = _col(question)
    replaced = F.when(q.isNull() | (q == ""), _col(c)).otherwise(F.replace(_col(c), q, F.lit("")))
    return py_strip(replaced)


def exact_match(pred, ref) -> Column:
    """1 when both texts are equal after strip + lower, else 0."""
    return (F.lower(py_strip(pred)) == F.lower(py_strip(ref))).cast("int")


def words(c) -> Column:
    """Maximal runs of non-whitespace (Python ``str.split()``).

    Every whitespace character is first mapped to a space, then the text is split on
    single spaces and empty pieces dropped; same result as matching ``WORD_PATTERN``,
    about three times cheaper than the regex.
    """
    spaced = F.translate(_col(c), PY_WHITESPACE, " " * len(PY_WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def lossless_tokens(c) -> Column:
    """Tokens that keep their leading whitespace; ``array_join(tokens, '')`` restores the
    text up to trailing whitespace."""
    return F.regexp_extract_all(_col(c), F.lit(LOSSLESS_TOKEN_PATTERN), 0)
