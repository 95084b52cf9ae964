"""A quality classifier as a sparse ensemble of rules.

1. ``statistics`` are Column expressions over a whole text: shares of capitals, digits and
   symbols, word lengths, repeated words and lines, and so on.
2. Small regression trees are grown one after the other on the statistics of a bounded sample
   of labelled rows, each on what the trees before leave unexplained. Every path from a root
   to a node is a rule: a conjunction of comparisons of statistics.
3. A logistic regression with an L1 penalty weighs the rules; most weights become zero.
4. ``compiled`` turns the rules that are left into one Spark expression, so scoring is a
   projection over the table and no Python worker takes part.

The sample: the SAMPLE rows of smallest hash among the labels that may be learned from, then as
many of the documents they name. It does not depend on the layout of the tables or their size.

Defined results: null text is empty; the statistics of an empty text are zero, and it is scored
like any other; with no labelled row to learn from the score is 0.5, with labels of one kind
alone their smoothed share. A label that is null teaches nothing; repeated labels and documents
count as often as they stand there; a row without doc_id is scored and not held out; an empty
table gives no row; other columns of the tables, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 8000
TREES, DEPTH, CUTS, LEAF = 24, 3, 32, 20
SHRINK = 0.3
PENALTY = 2e-3
STEPS = 600
THRESHOLD = 0.3

# word characters of the scripts as Java's regular expressions name them
UPPER, LETTERS, DIGITS, PLAIN = r"[^\p{Lu}]", r"[^\p{L}]", r"[^\p{Nd}]", r"[\p{L}\p{M}\p{N}\s.,;:!?'\"()\-]"


def statistics(text: Column) -> list[Column]:
    """Statistics of a text without nulls, in two steps: parts first, then their ratios (see
    ``with_statistics``)."""
    lines = F.split(text, "\n")
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    return [F.length(text).cast("double").alias("chars"),
            F.length(F.regexp_replace(text, UPPER, "")).alias("upper"),
            F.length(F.regexp_replace(text, LETTERS, "")).alias("letters"),
            F.length(F.regexp_replace(text, DIGITS, "")).alias("digits"),
            F.length(F.regexp_replace(text, PLAIN, "")).alias("symbols"),
            (F.length(text) - F.length(F.translate(text, ".!?", ""))).alias("stops"),
            F.size(lines).cast("double").alias("lines"), F.size(F.array_distinct(lines)).alias("kinds_of_line"),
            words.alias("words")]


NAMES = ["chars", "words", "word_length", "upper", "letters", "digits", "symbols", "stops", "line_words",
         "repeated_lines", "repeated_words", "stuttered_words", "short_words", "long_words"]


def with_statistics(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns of ``keep`` and the array ``x`` of the statistics of NAMES, as doubles."""
    rows = rows.select(*keep, *statistics(F.coalesce(F.col(text), F.lit(""))))
    n = F.size("words")
    rows = rows.select(
        *keep, "chars", "upper", "letters", "digits", "symbols", "stops", "lines", "kinds_of_line", n.alias("n"),
        F.size(F.array_distinct("words")).alias("kinds_of_word"),
        F.size(F.filter("words", lambda w, k: w == F.get("words", k + 1))).alias("stutters"),
        F.size(F.filter("words", lambda w: F.length(w) <= 3)).alias("short"),
        F.size(F.filter("words", lambda w: F.length(w) >= 16)).alias("long"))
    by = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    rest = lambda a, b: F.when(F.col(b) > 0, 1 - by(a, b)).otherwise(0.0)
    return rows.select(*keep, F.array(
        "chars", F.col("n").cast("double"), by("chars", "n"), by("upper", "letters"), by("letters", "chars"), by("digits", "chars"),
        by("symbols", "chars"), by("stops", "n"), by("n", "lines"), rest("kinds_of_line", "lines"), rest("kinds_of_word", "n"),
        by("stutters", "n"), by("short", "n"), by("long", "n")).alias("x"))


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, bound, above): the statistic is above the bound, or not."""

    conditions: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([(x[:, f] > bound) == above for f, bound, above in self.conditions])

    def column(self, x: str = "x") -> Column:
        parts = [F.get(x, F.lit(f)) > F.lit(bound) if above else F.get(x, F.lit(f)) <= F.lit(bound)
                 for f, bound, above in self.conditions]
        return reduce(Column.__and__, parts)


def grow(x: np.ndarray, target: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[Rule], np.ndarray]:
    """A regression tree of at most DEPTH levels: the rules of all its nodes, and its values."""
    rules, value = [], np.zeros(len(x))
    work = [((), np.arange(len(x)))]
    while work:
        path, rows = work.pop()
        y = target[rows]
        value[rows] = y.mean()
        if path:
            rules.append(Rule(path))
        if len(path) == DEPTH or len(rows) < 2 * LEAF:
            continue
        best = (1e-9, -1, 0.0)
        total, n = y.sum(), len(rows)
        for f, bounds in enumerate(cuts):
            if not len(bounds):
                continue
            place = np.searchsorted(bounds, x[rows, f])          # values <= bounds[k] lie in places 0..k
            count = np.cumsum(np.bincount(place, minlength=len(bounds) + 1))[:-1]
            below = np.cumsum(np.bincount(place, weights=y, minlength=len(bounds) + 1))[:-1]
            ok = (count >= LEAF) & (n - count >= LEAF)
            gain = np.where(ok, below ** 2 / np.maximum(count, 1) + (total - below) ** 2 / np.maximum(n - count, 1) - total ** 2 / n, 0)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(bounds[k]))
        if best[1] < 0:
            continue
        _, f, bound = best
        above = x[rows, f] > bound
        work += [((*path, (f, bound, True)), rows[above]), ((*path, (f, bound, False)), rows[~above])]
    return rules, value


def _chance(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression with an L1 penalty, by accelerated proximal steps."""
    mean, spread = z.mean(axis=0), z.std(axis=0)
    spread = np.where(spread > 0, spread, 1)
    u = np.hstack([(z - mean) / spread, np.ones((len(z), 1))])
    step = 4 / np.linalg.eigvalsh(u.T @ u / len(u))[-1]
    w = past = np.zeros(u.shape[1])
    for k in range(STEPS):
        ahead = w + k / (k + 3) * (w - past)
        moved = ahead - step * (u.T @ (_chance(u @ ahead) - y)) / len(y)
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        shrunk[-1] = moved[-1]                                    # the bias bears no penalty
        past, w = w, shrunk
    weights = w[:-1] / spread
    return weights, float(w[-1] - weights @ mean)


@dataclass(frozen=True)
class Ensemble:
    """Weighted rules and a bias."""

    rules: tuple[tuple[Rule, float], ...]
    bias: float

    def column(self, x: str = "x") -> Column:
        """The rules compiled to one Spark expression over the array of statistics."""
        margin = reduce(Column.__add__, (F.when(r.column(x), F.lit(w)).otherwise(0.0) for r, w in self.rules), F.lit(self.bias))
        return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), margin))))


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules from trees on (x, y), weighed by the lasso; y is 0 or 1."""
    good = float(y.sum())
    prior = (good + 1) / (len(y) + 2)
    bias = float(np.log(prior / (1 - prior)))
    if good in (0, len(y)):
        return Ensemble((), bias)
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)[1:-1], method="lower")) for column in x.T]
    margin, rules = np.full(len(y), bias), {}
    for _ in range(TREES):
        chance = _chance(margin)
        found, value = grow(x, y - chance, cuts)
        if not found:
            break
        rules.update(dict.fromkeys(found))
        margin += SHRINK * value / max(1e-6, float((chance * (1 - chance)).mean()))
    columns, kept = {}, []
    for rule in rules:                         # rules that hold for the same rows count once
        holds = rule.holds(x)
        if 0 < holds.sum() < len(x) and columns.setdefault(holds.tobytes(), rule) is rule:
            kept.append(rule)
    if not kept:
        return Ensemble((), bias)
    weights, bias = lasso(np.stack([r.holds(x) for r in kept], axis=1).astype(float), y)
    return Ensemble(tuple((r, float(w)) for r, w in zip(kept, weights) if w != 0), bias)


def learned(docs: DataFrame, labels: DataFrame, allowed: Column, bound: int = SAMPLE) -> Ensemble:
    """The ensemble of the labels (doc_id, quality) that ``allowed`` names, each with the texts
    of that doc_id; at most ``bound`` of them."""
    rows = labels.where(allowed & F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    rows = rows.select("doc_id", (F.col("quality") > 0).cast("double").alias("y"))
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(bound)        # at most ``bound`` rows of 16 bytes
    texts = docs.join(F.broadcast(rows), "doc_id").select("doc_id", "y", "text")
    found = with_statistics(texts, "text", ["doc_id", "y"])
    sample = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x", "y").limit(bound).collect()
    x = np.array([r["x"] for r in sample], float).reshape(-1, len(NAMES))
    return fit(x, np.array([r["y"] for r in sample]))


def held_out(doc_id: Column) -> Column:
    """True for the documents whose crc32(doc_id as text) mod 5 is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from labels that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    model = learned(docs, labels, ~held_out(F.col("doc_id")), bound)
    found = with_statistics(docs, "text", ["doc_id"])
    found = found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.column("x").alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
