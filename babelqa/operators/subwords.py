"""Learned subwords: byte-pair style merges over the word-count table, and the codec they make.

A word is a string of symbols, one code point each: its own characters at first, and a code
point of the private planes for each merged pair, so a merge is a string replacement and a pair
a substring of length two. ``learn_merges`` keeps two written tables, words and pair counts. A
round takes the most frequent pairs, replaces them, and corrects the counts by what the words
that held them lose and gain; other words are not looked at again.

Rounds, not merges, cost jobs. The second pair in rank may be merged in the same round as the
first if they share no symbol: no count that ranked below can rise, and a pair with a
new symbol is at most as frequent as one that ranked below, and loses the tie, as ties go to the
pair whose later symbol is older. A pair of equal symbols (whose merge may pair with itself) ends
its round. The merges are those of the one-by-one learner, in its order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import measured, ship_package

FIRST_SYMBOL = 0xF0000          # merge r is written as this code point plus r
MOST_MERGES = 0x20000 - 4       # the private planes, without their last points
FIRST_ID = 0x110000             # ids: a character's code point, or this number plus the merge
TOP = 64                        # pairs looked at in a round
FEW = 256                       # merges up to which a text is rewritten whole
REMEMBERED = 200_000            # pieces a worker remembers the symbols of before it starts anew

_WORD = re.compile(r"\S+")
_PRIVATE = re.compile("[\U000F0000-\U0010FFFF]")


def _pairs(word: str, weight: Column) -> list[Column]:
    """One row for every two neighbouring symbols."""
    w = F.col(word)
    starts = F.when(F.length(w) > 1, F.sequence(F.lit(1), F.length(w) - 1)).otherwise(F.array().cast("array<int>"))
    return [F.explode(F.transform(starts, lambda i: F.substr(w, i, F.lit(2)))).alias("pair"), weight.alias("n")]


def learn_merges(vocab: DataFrame, n_merges: int, token: str = "token", cnt: str = "cnt", min_count: int = 2) -> list[tuple[str, int]]:
    """The first ``n_merges`` merges of (token, cnt): (pair of symbols, its count when merged).
    Fewer where no pair is left that occurs ``min_count`` times. Words that hold characters of
    the private planes teach nothing."""
    if not 0 <= n_merges <= MOST_MERGES:
        raise ValueError(f"n_merges must be within 0 and {MOST_MERGES}")
    plain = ~F.coalesce(F.col(token).rlike(r"[\x{F0000}-\x{10FFFF}]"), F.lit(True))
    words = measured(vocab.where(plain).select(F.col(token).alias("w"), F.col(cnt).cast("long").alias("cnt")), "subword-words")
    total = F.sum("n").alias("n")
    counts = measured(words.select(*_pairs("w", F.col("cnt"))).groupBy("pair").agg(total), "subword-pairs")
    left, right = F.substr("pair", F.lit(1), F.lit(1)), F.substr("pair", F.lit(2), F.lit(1))
    merges: list[tuple[str, int]] = []
    while len(merges) < n_merges:
        top = counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), F.greatest(left, right), left, right).limit(TOP).collect()
        used: set[str] = set()
        after, chosen = F.col("w"), 0
        for r in top:
            if used & set(r["pair"]) or len(merges) == n_merges:
                break
            after = F.replace(after, F.lit(r["pair"]), F.lit(chr(FIRST_SYMBOL + len(merges))))
            merges.append((r["pair"], r["n"]))
            used |= set(r["pair"])
            chosen += 1
            if r["pair"][0] == r["pair"][1]:
                break
        if not chosen or len(merges) == n_merges:
            break
        step = words.withColumn("after", after)
        changed = step.where(F.col("w") != F.col("after"))
        delta = changed.select(*_pairs("w", -F.col("cnt"))).unionByName(changed.select(*_pairs("after", F.col("cnt"))))
        counts = measured(counts.unionByName(delta).groupBy("pair").agg(total).where(F.col("n") > 0), "subword-pairs")
        words = measured(step.select(F.col("after").alias("w"), "cnt"), "subword-words")
    return merges


def spelt(merges: list[tuple[str, int]]) -> list[tuple[str, str]]:
    """The two parts of each merge, as the characters they stand for."""
    whole: dict[str, str] = {}
    out = []
    for r, (pair, _) in enumerate(merges):
        a, b = (whole.get(c, c) for c in pair)
        whole[chr(FIRST_SYMBOL + r)] = a + b
        out.append((a, b))
    return out


class Codec:
    """Ids of texts under ranked merges. Blanks and unmerged characters are their code points."""

    def __init__(self, merges: list[tuple[str, int]]):
        ids = {chr(FIRST_SYMBOL + r): FIRST_ID + r for r in range(len(merges))}
        as_id = lambda c: ids.get(c, ord(c))
        self.rank = {(as_id(p[0]), as_id(p[1])): r for r, (p, _) in enumerate(merges)}
        self.text = {FIRST_ID + r: a + b for r, (a, b) in enumerate(spelt(merges))}
        self.merges = [(p, chr(FIRST_SYMBOL + r)) for r, (p, _) in enumerate(merges)]
        self.lengths = np.array([len(t) for t in self.text.values()], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.points = np.frombuffer("".join(self.text.values()).encode("utf-32-le"), np.int32)
        self.known: dict[str, str] = {}

    def word(self, word: str) -> list[int]:
        ids = [ord(c) for c in word]
        while len(ids) > 1:
            best = min((self.rank.get(p, len(self.rank)) for p in zip(ids, ids[1:])), default=len(self.rank))
            if best == len(self.rank):
                break
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.rank.get((ids[k], ids[k + 1])) == best:
                    out.append(FIRST_ID + best)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def symbols(self, text: str) -> str:
        """The text with a symbol for each merge, as the learner writes it. A later merge makes no
        earlier pair, so a few merges are replaced one after the other in the whole text. With
        more, the pieces between spaces are remembered; nothing merges across a blank."""
        if len(self.merges) <= FEW:
            for pair, symbol in self.merges:
                text = text.replace(pair, symbol)
            return text
        if len(self.known) > REMEMBERED:
            self.known.clear()
        pieces, known = text.split(" "), self.known
        for p in set(pieces).difference(known):
            known[p] = _WORD.sub(lambda m: "".join(chr(i if i < FIRST_ID else i - FIRST_ID + FIRST_SYMBOL) for i in self.word(m.group())), p)
        return " ".join([known[p] for p in pieces])

    def encode(self, text: str) -> np.ndarray:
        if not text.isascii() and _PRIVATE.search(text):       # its own characters are no symbols of merges
            out, at = [], 0
            for m in _WORD.finditer(text):
                out += [*map(ord, text[at:m.start()]), *self.word(m.group())]
                at = m.end()
            return np.array(out + [*map(ord, text[at:])], np.int32)
        ids = np.frombuffer(self.symbols(text).encode("utf-32-le"), np.int32)
        return np.where(ids >= FIRST_SYMBOL, ids + (FIRST_ID - FIRST_SYMBOL), ids)

    def decode(self, ids: np.ndarray) -> str:
        merge = np.flatnonzero(ids >= FIRST_ID)
        which = ids[merge] - FIRST_ID
        if len(which) and which.max() >= len(self.lengths):
            raise KeyError(int(which.max()) + FIRST_ID)
        if len(ids) and ids.min() < 0:
            raise ValueError(f"{ids.min()} is no id")
        counts = np.ones(len(ids), np.int64)
        counts[merge] = self.lengths[which]
        out = np.repeat(ids, counts)
        n = counts[merge]               # the characters of the merges, one after the other
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(np.cumsum(counts)[merge] - n, n) + inner] = self.points[np.repeat(self.starts[which], n) + inner]
        return out.astype("<i4").tobytes().decode("utf-32-le")


def encode_subwords(df: DataFrame, merges: list[tuple[str, int]], text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of a text; NULL text has NULL ids. A narrow pass; the merges go with the task."""
    ship_package(df.sparkSession)
    codec = Codec(merges)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else codec.encode(t) for t in texts.to_pylist()]
        offsets = np.cumsum([0] + [0 if r is None else len(r) for r in rows], dtype=np.int32)
        values = np.concatenate([np.empty(0, np.int32), *[r for r in rows if r is not None]])
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()), mask=texts.is_null())

    return df.withColumn(out, encode(text))


def decode_subwords(df: DataFrame, merges: list[tuple[str, int]], ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the text of ids; an id that is no character and no merge is an error."""
    ship_package(df.sparkSession)
    codec = Codec(merges)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        values = rows.flatten()
        if values.null_count:
            raise TypeError("a NULL is no id")
        values, n = values.to_numpy(), pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n, dtype=np.int64)
        texts = [codec.decode(values[e - k:e]) for e, k in zip(ends, n)]
        return pa.array([t if v else None for t, v in zip(texts, rows.is_valid().to_pylist())], pa.string())

    return df.withColumn(out, decode(ids))
