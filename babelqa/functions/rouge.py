"""ROUGE building blocks.

Tokenisation is a JVM expression. One Arrow pass compares the two token lists of a row: stems
(a worker remembers the words it has seen), clipped overlap and the longest common subsequence,
bit-parallel (Allison & Dix 1986; Hyyro 2004), so a pair of long texts costs about
``len(a) * len(b) / 64`` word operations instead of a full DP table, and Python's rounding of
the reported values. The same measures from ids and their places serve the relational way.
"""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .porter import stem


STATS_TYPE = T.StructType([
    T.StructField("rouge1_f1", T.DoubleType()), T.StructField("rougeL_f1", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
])


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rouge_tokens(c) -> Column:
    """Lower-case, every run outside ``[a-z0-9]`` separates tokens (non-Latin text has
    no tokens at all and scores 0)."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("[a-z0-9]+"), 0)


@F.pandas_udf(T.StringType())
def stem_word(s: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else (stem(w) if len(w) > 3 else w) for w in s])


def lcs_length(a, b) -> int:
    """Length of the longest common subsequence of two token sequences."""
    if len(a) == 0 or len(b) == 0:
        return 0
    if len(a) < len(b):
        a, b = b, a  # bit vector over the shorter sequence
    masks: dict = {}
    for i, t in enumerate(b):
        masks[t] = masks.get(t, 0) | (1 << i)
    full = (1 << len(b)) - 1
    v = full
    for t in a:
        u = v & masks.get(t, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - bin(v).count("1")


def f_measure(overlap: int, n_pred: int, n_ref: int, empty_zero: bool) -> float:
    """F1 computed in the scorer's operation order."""
    if empty_zero and (n_pred == 0 or n_ref == 0):
        return 0.0
    p = overlap / max(n_pred, 1)
    r = overlap / max(n_ref, 1)
    return 2 * p * r / (p + r) if p + r > 0 else 0.0


def in_order(ids, places) -> list:
    """The id sequence of a text, from the places of each id in it."""
    out = [0] * sum(map(len, places))
    for i, own in zip(ids.tolist(), places):
        for p in own.tolist():
            out[p] = i
    return out


REMEMBERED = 400_000     # words a worker remembers the stems of before it starts anew
_stems: dict[str, str] = {}


def tokens_of(joined: str, stemmed: bool) -> list[str]:
    """Tokens joined by blanks -> their stems, or the tokens themselves."""
    words = joined.split()
    if stemmed:
        if len(_stems) > REMEMBERED:
            _stems.clear()
        for w in words:
            if w not in _stems:
                _stems[w] = stem(w) if len(w) > 3 else w
        words = [_stems[w] for w in words]
    return words


def clipped_overlap(a: list, b: list) -> int:
    have = Counter(a)
    return sum(min(n, have[t]) for t, n in Counter(b).items() if t in have)


def pair_counts_udf(stemmed: bool, with_lcs: bool):
    """Arrow UDF (generated, reference tokens joined by blanks) -> overlap, lcs, n_gen, n_gold."""

    @F.pandas_udf("overlap int, lcs int, n_gen int, n_gold int")
    def pair_counts(gen: pd.Series, gold: pd.Series) -> pd.DataFrame:
        rows = []
        for g, r in zip(gen, gold):
            g, r = tokens_of(g, stemmed), tokens_of(r, stemmed)
            rows.append((clipped_overlap(g, r), lcs_length(g, r) if with_lcs else 0, len(g), len(r)))
        return pd.DataFrame(rows, columns=["overlap", "lcs", "n_gen", "n_gold"], dtype="int32")

    return pair_counts


def pair_scores_udf(w_r1: float = 0.5, w_rl: float = 0.5, stemmed: bool = True, with_lcs: bool = True):
    """Arrow UDF (generated, reference tokens joined by blanks) -> as ``rouge_stats_udf``; without
    ``with_lcs`` only ``rouge1_f1`` means something."""

    @F.pandas_udf(STATS_TYPE)
    def pair_scores(gen: pd.Series, gold: pd.Series) -> pd.DataFrame:
        rows = []
        for g, r in zip(gen, gold):
            g, r = tokens_of(g, stemmed), tokens_of(r, stemmed)
            f1 = f_measure(clipped_overlap(g, r), len(g), len(r), empty_zero=False)
            fl = f_measure(lcs_length(g, r), len(g), len(r), empty_zero=True) if with_lcs else 0.0
            rows.append((round(f1, 4), round(fl, 4), round(f1 * w_r1 + fl * w_rl, 4)))
        return pd.DataFrame(rows, columns=[f.name for f in STATS_TYPE.fields], dtype="float64")

    return pair_scores


def rouge_stats_udf(w_r1: float = 0.5, w_rl: float = 0.5):
    """Arrow UDF (ids, their places in both texts, overlap) -> 4-place F values and score (rounded the
    Python way; the score uses the unrounded F values)."""

    @F.pandas_udf(STATS_TYPE)
    def rouge_stats(ids: pd.Series, gen: pd.Series, gold: pd.Series, overlap: pd.Series) -> pd.DataFrame:
        rows = []
        for i, g, r, ov in zip(ids, gen, gold, overlap):
            g, r = in_order(i, g), in_order(i, r)
            f1 = f_measure(ov, len(g), len(r), empty_zero=False)
            fl = f_measure(lcs_length(g, r), len(g), len(r), empty_zero=True)
            rows.append((round(f1, 4), round(fl, 4), round(f1 * w_r1 + fl * w_rl, 4)))
        return pd.DataFrame(rows, columns=[f.name for f in STATS_TYPE.fields])

    return rouge_stats
