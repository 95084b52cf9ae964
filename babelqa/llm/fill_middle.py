"""Fill-in-middle: a text is cut twice between its units and its parts are put into prefix-
suffix-middle (psm) or suffix-prefix-middle (spm) order.

A unit is a run of non-blank characters with the blanks before it, or the blanks at the end of
the text. The places where units end are kept in a Roaring-style set: offsets are split into a
high part (the container) and 16 low bits; a container is a sorted array, a bitmap or a list of
runs, whichever is smallest, and cumulative cardinalities lead from a number k to its container.
``select(k)`` there gives the cut after unit k + 1, so no list of units is made.

The draws are the first four 32-bit groups of sha256("<seed>:<doc_id>"): two cuts, the rate of
texts that stay plain, the share of spm. A text that is empty or holds a mark stays plain, so an
output is read back without escapes: ``restored`` rebuilds the text from output and form alone.

Defined results: null text is empty: plain, no unit; a row without doc_id draws as if its number
were the empty text; repeated rows give equal rows; an empty table gives no row; other columns
of the input, whatever their names, are not read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches_of, prepare, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE = 50          # texts in a hundred that are cut
SPM_RATE = 80      # of these, in suffix-prefix-middle order
LOW_BITS = 16
ARRAY_LIMIT = 4096                       # 2 bytes a value: beyond, a bitmap is smaller
BITMAP_BYTES = (1 << LOW_BITS) // 8
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


class BoundarySet:
    """A set of sorted offsets with rank by container and select."""

    def __init__(self, offsets: np.ndarray):
        high = offsets >> LOW_BITS
        first = np.flatnonzero(np.r_[True, high[1:] != high[:-1]]) if len(offsets) else np.empty(0, np.int64)
        self.keys = high[first]
        self.before = np.r_[first, len(offsets)].astype(np.int64)      # cumulative cardinalities
        low = (offsets & ((1 << LOW_BITS) - 1)).astype(np.int64)
        self.containers = [self._container(low[a:b]) for a, b in zip(self.before[:-1].tolist(), self.before[1:].tolist())]

    @staticmethod
    def _container(low: np.ndarray) -> tuple:
        starts = np.flatnonzero(np.r_[True, np.diff(low) != 1])
        if 4 * len(starts) < min(2 * len(low), BITMAP_BYTES):
            return "run", low[starts].astype(np.uint16), starts        # run starts, values before each run
        if len(low) <= ARRAY_LIMIT:
            return "array", low.astype(np.uint16), None
        bits = np.zeros(1 << LOW_BITS, np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        return "bitmap", words, np.r_[0, np.cumsum(np.bitwise_count(words))[:-1]]

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The offset with k offsets before it."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        c = int(np.searchsorted(self.before, k, "right")) - 1
        kind, values, counts = self.containers[c]
        k -= int(self.before[c])
        if kind == "array":
            low = int(values[k])
        elif kind == "run":
            run = int(np.searchsorted(counts, k, "right")) - 1
            low = int(values[run]) + k - int(counts[run])
        else:
            word = int(np.searchsorted(counts, k, "right")) - 1
            bits = np.unpackbits(values[word:word + 1].view(np.uint8), bitorder="little")
            low = 64 * word + int(np.flatnonzero(bits)[k - int(counts[word])])
        return (int(self.keys[c]) << LOW_BITS) | low


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte offsets behind each unit of a text in UTF-8."""
    if not len(raw):
        return np.empty(0, np.int64)
    blank = BLANK[raw]
    ends = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    return np.r_[ends, len(raw)] if blank[-1] else ends


def draws(doc_id: int | None, seed: int) -> tuple[int, ...]:
    digest = sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k:k + 8], 16) for k in range(0, 32, 8))


def arrange(raw: np.ndarray, doc_id: int | None, seed: int, rate: int, spm_rate: int) -> tuple:
    """n, form, prefix_chars, middle_chars and output of a text in UTF-8."""
    text, cuts = raw.tobytes(), BoundarySet(unit_ends(raw))
    n, (h1, h2, h3, h4) = len(cuts), draws(doc_id, seed)
    if not text or h3 % 100 >= rate or any(m.encode() in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = (cuts.select(k - 1) if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    size = lambda x: len(x.decode("utf-8", "surrogatepass"))
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    if h4 % 100 < spm_rate:
        return n, "spm", size(prefix), size(middle), b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", size(prefix), size(middle), b"".join((p, prefix, s, suffix, m, middle))


ARRANGED = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                      ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = RATE, spm_rate: int = SPM_RATE,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n units, form, prefix_chars, middle_chars, output."""
    prepare(docs.sparkSession)

    def run(batches):
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            rows = [(doc, *arrange(raw[a:b], doc, seed, rate, spm_rate)) for doc, a, b in
                    zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist())]
            found = dict(zip(ARRANGED.names, zip(*rows))) if rows else {c: [] for c in ARRANGED.names}
            found["output"] = pa.array(found["output"], pa.binary()).cast(pa.string())
            yield batches_of(found, ARRANGED)

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text of an output. A text that holds a mark is never cut, and a mark cannot arise
    where a part meets one, so the first marks found are the ones that were set."""
    second = F.when(form == "spm", F.lit(PREFIX)).otherwise(F.lit(SUFFIX))
    first, rest = F.substr(output, F.lit(4)), F.length(F.substring_index(output, MIDDLE, 1))
    at = F.instr(first, second)
    one = F.substr(first, F.lit(1), at - 1)
    two = F.substr(first, at + 3, rest - at - 5)
    middle = F.substr(output, rest + 4)
    return (F.when(form == "plain", output).when(form == "spm", F.concat(two, middle, one))
            .otherwise(F.concat(one, middle, two)))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of output and restored text."""
    found = fill_in_middle(docs)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                        sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
