"""Runs of periodic words, found on a grammar of the text.

A run is a stretch of words with smallest period q, at least ``max(MIN_LENGTH, MIN_PERIODS * q)``
words long, that no neighbouring word extends keeping the period.

1. Word ids are compressed by Re-Pair in rounds, all documents of a block at once: in a round
   every pair that occurs twice in its document, and is not overlapped by a more frequent one,
   gives way to a nonterminal. What is left is the start string of each document.
2. A run lies in the lowest node of the derivation that holds it and crosses the boundary of
   that node's two parts, or else a boundary of the start string. So each nonterminal's boundary
   is searched once, inside its own expansion, and each boundary of the start string in the
   whole text. Half of a run lies on one side of the boundary, so the words there come again
   one period away; with growing grams (of 3, 9, 65, 513 ... words for periods up to 8, 64, 512
   ...) the same gram at the right distance names the few periods that are then checked word
   by word.
3. Runs of a nonterminal are translated to all its places in the derivation. A piece that a
   node's edge cut off lies inside the whole run, which a higher node has: of each period, the
   maximal intervals stay.

Defined results: null text has no words; a row without doc_id is taken as it is; repeated rows
give equal rows; an empty table gives no row; other columns of the input, whatever their names,
are not read. Documents are taken in blocks of about BLOCK_WORDS words, a longer one alone;
the result does not depend on the blocks.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import count
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, prepare

MIN_LENGTH, MIN_PERIODS = 6, 4
BLOCK_WORDS = 200_000
PROBES = (0.5, 0.25, 0.75, 0.125, 0.625, 0.375, 0.875)
CANDIDATES = 1 << 20


def _spans(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sizes (2, 3): owner 0 0 1 1 1 and place 0 1 0 1 2."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def repair(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair of word ids that no two documents share. Returns the replaced places: start,
    boundary and end in words and the nonterminal; and the starts of the start string's symbols."""
    symbol, start = ids.astype(np.int64), np.arange(len(ids))
    fresh = int(symbol.max(initial=-1)) + 1
    live = doc[:-1] == doc[1:] if len(ids) else np.empty(0, bool)      # pairs (i, i + 1) that may occur twice
    places: list[tuple] = []
    while True:
        at = np.flatnonzero(live)
        if not len(at):
            break
        left, right = symbol[at], symbol[at + 1]
        # of a chain x x x x only every other pair counts
        same = left == right
        chained = same & np.r_[False, same[:-1] & (np.diff(at) == 1)]
        head = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
        odd = (np.arange(len(at)) - head) % 2 == 1
        spare, at = at[odd], at[~odd]
        _, pair, times = np.unique(left[~odd] * fresh + right[~odd], return_inverse=True, return_counts=True)
        often = times[pair] > 1
        if not often.any():
            break
        at, pair = at[often], pair[often]
        rank = times[pair].astype(np.int64) * (len(times) + 1) + pair       # more frequent first
        full = np.zeros(len(symbol) + 1, np.int64)
        full[at + 1] = rank
        wins = (rank >= full[at]) & (rank >= full[np.minimum(at + 2, len(symbol))])
        # equal neighbours happen only in chains, where every other pair was taken out
        hit, which = at[wins], pair[wins]
        names, which = np.unique(which, return_inverse=True)
        ends = np.r_[start[1:], len(ids)]
        places.append((start[hit], start[hit + 1], ends[hit + 1], fresh + which))
        live = np.zeros(len(symbol), bool)
        live[at] = live[spare] = True
        symbol[hit] = fresh + which
        live[hit] = True
        live[np.maximum(hit - 1, 0)] = True
        keep = np.ones(len(symbol), bool)
        keep[hit + 1] = False
        symbol, start, live = symbol[keep], start[keep], live[keep]
        live = live[:-1] & (doc[start[:-1]] == doc[start[1:]])
        fresh += len(names)
    cut = [np.concatenate(x) if places else np.empty(0, np.int64) for x in (zip(*places) if places else [()] * 4)]
    return *cut, start


def grams(ids: np.ndarray, longest: int):
    """(words, first and last period, gram id of each place; -1 where it does not come again)."""
    def doubled(gram, shift):
        out = np.full(len(gram), -1, np.int64)
        at = np.flatnonzero((gram[:-shift] >= 0) & (gram[shift:] >= 0)) if len(gram) > shift else np.empty(0, np.int64)
        _, name, times = np.unique(gram[at] * (len(gram) + 1) + gram[at + shift], return_inverse=True, return_counts=True)
        again = times[name] > 1
        out[at[again]] = name[again]
        return out

    _, gram = np.unique(ids, return_inverse=True)
    gram = doubled(doubled(gram, 1), 1)
    words, low = 3, 1
    while (gram >= 0).any() and low <= longest:
        yield words, low, 8 * low, gram
        if words == 3:
            gram, words = doubled(doubled(doubled(gram, 2), 3), 1), 9    # 5, 8, 9
        else:
            for _ in range(3):
                gram, words = doubled(gram, words - 1), 2 * words - 1
        low *= 8


def _forward(ids: np.ndarray, x: int, q: int, stop: int) -> int:
    """The first y >= x + q that differs from the word q before it, or stop."""
    y, step = x + q, 64
    while y < stop:
        z = min(stop, y + step)
        differs = ids[y:z] != ids[y - q:z - q]
        k = int(differs.argmax())
        if differs[k]:
            return y + k
        y, step = z, 4 * step
    return stop


def _backward(ids: np.ndarray, x: int, q: int, stop: int) -> int:
    """The first place of the stretch that keeps period q down from x."""
    y, step = x, 64
    while y > stop:
        z = max(stop, y - step)
        differs = (ids[z:y] != ids[z + q:y + q])[::-1]
        k = int(differs.argmax())
        if differs[k]:
            return y - k
        y, step = z, 4 * step
    return stop


def _candidates(gram, words, low, high, cut, first, last):
    """(boundary number, period, right) with the gram beside a boundary met again one period on."""
    places = np.flatnonzero(gram >= 0)
    size = len(gram) + 1
    keys = gram[places] * size + places
    order = np.argsort(keys)
    keys, places = keys[order], places[order]
    for right in (True, False):
        at = cut - 1 if right else cut - words + 1
        inside = (at >= first) & (at + words <= last)
        number = np.flatnonzero(inside)
        number = number[gram[at[number]] >= 0]
        at, base = at[number], gram[at[number]] * size
        room = (last[number] - cut[number]) // 2 if right else (cut[number] - first[number]) // 2
        far = np.minimum(high - 1, room)
        if right:
            a, b = np.searchsorted(keys, base + at + low), np.searchsorted(keys, base + np.minimum(at + far, size - 1), "right")
        else:
            a, b = np.searchsorted(keys, base + np.maximum(at - far, 0)), np.searchsorted(keys, base + at - low, "right")
        sizes = np.maximum(b - a, 0)
        block = np.cumsum(sizes) // CANDIDATES
        for k in np.unique(block[sizes > 0]):
            mine = (block == k) & (sizes > 0)
            owner, place = _spans(sizes[mine])
            met = places[a[mine][owner] + place]
            yield number[mine][owner], np.abs(met - at[mine][owner]), right


def crossing_runs(ids: np.ndarray, cut: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs inside [first, last) that hold the words on both sides of ``cut``: number of the
    boundary, start, end, period."""
    found: list[tuple[int, int, int, int]] = []
    longest = int((last - first).max(initial=0)) // MIN_PERIODS
    covered: dict[tuple[int, bool], int] = {}     # periods up to here are known or impossible
    for words, low, high, gram in grams(ids, longest):
        for number, period, right in _candidates(gram, words, low, high, cut, first, last):
            edge = cut[number]
            ok = 4 * period <= last[number] - first[number]
            for share in PROBES:       # necessary: the half beside the boundary repeats
                step = (period * share).astype(np.int64)
                x = edge[ok] + step[ok] if right else edge[ok] - 1 - step[ok]
                y = x + period[ok] if right else x - period[ok]
                ok[ok] = ids[x] == ids[y]
            order = np.lexsort((period[ok], number[ok]))
            number, period = number[ok][order], period[ok][order]
            heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else []
            for a, b in zip(heads, np.r_[heads[1:], len(number)] if len(number) else []):
                n, ps = int(number[a]), period[a:b]
                c, ws, we = int(cut[n]), int(first[n]), int(last[n])
                k = int(np.searchsorted(ps, covered.get((n, right), 0), "right"))
                while k < len(ps):
                    q = int(ps[k])
                    x = c - 1 if right else c - q
                    end, start = _forward(ids, x, q, we), _backward(ids, x, q, ws)
                    side = end - c if right else c - start
                    if end - start >= max(MIN_LENGTH, MIN_PERIODS * q):
                        found.append((n, start, end, q))
                    if side >= 2 * q:
                        # a longer smallest period would share q + period words with this stretch
                        covered[n, right] = max(covered.get((n, right), 0), side - q + 1)
                        k = int(np.searchsorted(ps, covered[n, right], "right"))
                    k = max(k, int(np.searchsorted(ps, q, "right")))
    table = np.array(found, np.int64).reshape(-1, 4)
    return tuple(table.T)


def block_runs(ids: np.ndarray, doc: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """All runs of a block: document, start, end, period, in this order of document and start."""
    start, middle, end, name, top = repair(ids, doc)
    # one place of each nonterminal that is long enough to hold a run
    large = np.flatnonzero(end - start >= MIN_LENGTH)
    names, once = np.unique(name[large], return_index=True)
    once = large[once]
    begin = stops - np.bincount(doc, minlength=len(stops))
    inner = top[1:][doc[top[1:]] == doc[top[:-1]]] if len(top) else top
    cut = np.r_[middle[once], inner]
    first, last = np.r_[start[once], begin[doc[inner]]], np.r_[end[once], stops[doc[inner]]]
    number, a, b, q = crossing_runs(ids, cut, first, last)
    rule = number < len(names)
    # runs of nonterminals, at all their places
    order = large[np.argsort(name[large], kind="stable")]
    lo = np.searchsorted(name[order], names[number[rule]])
    hi = np.searchsorted(name[order], names[number[rule]], "right")
    owner, place = _spans(hi - lo)
    shift = start[order[lo[owner] + place]] - first[number[rule]][owner]
    a, b, q = (np.r_[a[rule][owner] + shift, a[~rule]], np.r_[b[rule][owner] + shift, b[~rule]],
               np.r_[q[rule][owner], q[~rule]])
    # of each period, the maximal intervals
    d = doc[a]
    order = np.lexsort((-b, a, q, d))
    d, a, b, q = d[order], a[order], b[order], q[order]
    group = np.r_[False, (d[1:] != d[:-1]) | (q[1:] != q[:-1])].cumsum() if len(d) else d
    reach = np.maximum.accumulate(b + group * (len(ids) + 1)) - group * (len(ids) + 1) if len(d) else b
    whole = np.r_[True, (group[1:] != group[:-1]) | (b[1:] > reach[:-1])] if len(d) else np.empty(0, bool)
    d, a, b, q = d[whole], a[whole], b[whole], q[whole]
    order = np.lexsort((q, a, d))
    return d[order], a[order], b[order], q[order]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(first word, period) of the stretch that the query makes periodic, or None."""
    if doc_id is None or not n:
        return None
    h = crc32(str(doc_id).encode())
    if h % 10:
        return None
    a = h // 10 % n
    return a, 1 + (n - a) // (3 + h // 10 % 8)


class Block:
    """Word ids of some documents, numbered apart for each."""

    def __init__(self):
        self.words, self.source, self.ids, self.fresh, self.size = [], [], [], 0, 0

    def add(self, words: list[bytes], stretch: tuple[int, int] | None) -> None:
        names = dict(zip(dict.fromkeys(words), count(self.fresh)))
        self.fresh += len(names)
        ids = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
        source = None
        if stretch:
            a, p = stretch
            source = np.arange(len(words))
            source[a:] = a + (source[a:] - a) % p
            ids = ids[source]
        self.words.append(words)
        self.source.append(source)
        self.ids.append(ids)
        self.size += len(words)

    def runs(self):
        """Per document: its words, and starts, lengths, periods of its runs."""
        sizes = np.array([len(x) for x in self.ids], np.int64)
        ids = np.concatenate(self.ids) if self.ids else np.empty(0, np.int64)
        stops = np.cumsum(sizes)
        d, a, b, q = block_runs(ids, np.repeat(np.arange(len(sizes)), sizes), stops)
        edges = np.searchsorted(d, np.arange(len(sizes) + 1))
        for k, (words, source) in enumerate(zip(self.words, self.source)):
            mine = slice(edges[k], edges[k + 1])
            if source is not None:
                words = [words[j] for j in source.tolist()]
            yield words, a[mine] - (stops[k] - sizes[k]), b[mine] - a[mine], q[mine]


RUNS = pa.schema([("doc_id", pa.int64()), ("words", pa.int64()),
                  ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                  ("collapsed", pa.string())])
RUNS_DDL = "doc_id long, words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def collapsed(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> bytes:
    """The words, one blank between, without those that a run repeats."""
    if not len(start):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, stretches=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, words, runs (start, length, period; by start, then period)
    and the collapsed text. ``stretches(doc_id, n)`` may name a first word and a period from
    which on the words repeat, before the search."""
    prepare(docs.sparkSession)

    def rows_of(names, block):
        found = list(block.runs())
        runs = [np.stack(x[1:], axis=1) for x in found]
        flat = np.concatenate(runs)
        offsets = np.cumsum([0, *map(len, runs)])
        items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUNS.field("runs").type.value_type))
        return pa.RecordBatch.from_arrays([
            pa.array(names, pa.int64()), pa.array([len(x[0]) for x in found], pa.int64()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items, type=RUNS.field("runs").type),
            pa.array([collapsed(*x) for x in found], pa.binary()).cast(pa.string())], schema=RUNS)

    def run(batches):
        names, block = [], Block()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                words = text.as_buffer().to_pybytes().split() if text.is_valid else []
                if names and block.size + len(words) > BLOCK_WORDS:
                    yield rows_of(names, block)
                    names, block = [], Block()
                names.append(doc)
                block.add(words, stretches(doc, len(words)) if stretches else None)
        if names:
            yield rows_of(names, block)
        else:
            yield batches_of({c: [] for c in RUNS.names}, RUNS)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, RUNS_DDL)


def run_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent and the digests of runs and text."""
    found = periodic_runs(docs, stretches=planted)
    # greatest length / period, compared crosswise; ties by start, then period, which is their order
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda top, r: F.when(
        r["length"] * top["period"] > top["length"] * r["period"], r).otherwise(top))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(
        "", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
