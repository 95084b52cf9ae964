"""Vector bin packing of examples into sequences, by the dot-product heuristic.

An example takes three things of a sequence: tokens, a segment, and loss-bearing tokens.
While a sequence is open, the example whose size vector has the largest dot product with
what the sequence has left (each over its limit) goes in, among those that fit all limits.
If none fits, the longest one that is left is cut so that the sequence ends full: ids may be
cut anywhere and every id lies in exactly one piece. A sequence that cannot be filled (its
segments are used up, or the task's rows are) is cut into sequences whose lengths are powers of
two, which need no padding.

Each task packs its own rows through a pool of at most POOL examples; nothing is shuffled,
and sequence ids carry the task's number, so a re-run task gives the same pieces. Documents
longer than a sequence are cut into full sequences as they come.

Defined results: null text is empty; an empty document is its end id alone; repeated rows and
null ids are packed like others; an empty table gives no piece; other columns of the input, whatever their
names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, prepare
from .encoding import encoder

MAX_TOKENS = 2048
MAX_SEGMENTS = 128
MAX_LOSS = 2048
POOL = 2048


@dataclass
class Example:
    """Token ids (little-endian unsigned 32-bit) from ``start`` on of one document. Parts of a long
    document are views of its ids, so cutting copies nothing."""
    doc: int | None
    ids: bytes | memoryview
    total: int            # tokens of the whole document
    start: int = 0
    loss: np.ndarray | None = None   # per token; None: every token bears loss

    def __len__(self) -> int:
        return len(self.ids) // 4

    def bearing(self, n: int | None = None) -> int:
        n = len(self) if n is None else n
        return n if self.loss is None else int(self.loss[:n].sum())

    def cut(self, n: int) -> tuple[Example, Example]:
        head = Example(self.doc, self.ids[:4 * n], self.total, self.start, None if self.loss is None else self.loss[:n])
        tail = Example(self.doc, self.ids[4 * n:], self.total, self.start + n,
                       None if self.loss is None else self.loss[n:])
        return head, tail


class Packer:
    """Feed examples with ``add``, take finished sequences (lists of examples) from
    ``ready``; ``finish`` packs what is left."""

    def __init__(self, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS), pool: int = POOL):
        if min(limits) < 1 or pool < 2:
            raise ValueError("limits have to be at least 1, the pool at least 2")
        self.limits, self.scale = np.array(limits), 1 / np.array(limits, float)
        self.pool, self.held = pool, 0
        self.items: list[Example | None] = [None] * pool
        self.sizes = np.zeros((pool, 3), np.int64)
        self.free = list(range(pool))[::-1]

    def _put(self, x: Example) -> None:
        x.ids = bytes(x.ids)       # what is held must not hold a long document
        k = self.free.pop()
        self.items[k], self.sizes[k] = x, (len(x), 1, x.bearing())
        self.held += 1

    def _take(self, k: int) -> Example:
        x, self.items[k] = self.items[k], None
        self.sizes[k] = 0
        self.free.append(k)
        self.held -= 1
        return x

    def _within(self, x: Example, left: np.ndarray) -> int:
        """The most leading tokens of x that keep to what is left."""
        n = min(len(x), int(left[0]))
        if x.bearing(n) > left[2]:
            n = int(np.searchsorted(np.cumsum(x.loss), left[2], side="right")) if x.loss is not None else int(left[2])
        return n if left[1] > 0 else 0

    def add(self, x: Example) -> Iterator[list[Example]]:
        x.ids = memoryview(x.ids)
        while len(x) >= self.limits[0] or x.bearing() > self.limits[2]:
            head, x = x.cut(self._within(x, self.limits))
            yield [head]
        if len(x):
            self._put(x)
        while self.held >= self.pool - 1:
            yield from self._settled(self._sequence())

    def _sequence(self) -> list[Example]:
        left, out = self.limits.copy(), []
        while self.held and left[0] > 0 and left[1] > 0:
            used = self.sizes[:, 1] > 0
            fits = used & (self.sizes <= left).all(axis=1)
            if left[1] == 1:     # the last segment has to fill the sequence
                fits &= self.sizes[:, 0] == left[0]
            if fits.any():
                worth = self.sizes @ (left * self.scale * self.scale)
                k = int(np.where(fits, worth, -1.0).argmax())
                out.append(self._take(k))
            else:
                k = int(np.where(used, self.sizes[:, 0], -1).argmax())
                n = self._within(self.items[k], left)
                if n == 0:
                    break
                head, tail = self._take(k).cut(n)
                out.append(head)
                if len(tail):
                    self._put(tail)
            left -= (len(out[-1]), 1, out[-1].bearing())
        return out

    def _settled(self, out: list[Example]) -> Iterator[list[Example]]:
        """A full sequence as it is; a shorter one in sequences of powers of two."""
        total = sum(map(len, out))
        if total == self.limits[0]:
            yield out
            return
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                part, room = [], 1 << bit
                while room:
                    x = out.pop(0)
                    if len(x) > room:
                        x, rest = x.cut(room)
                        out.insert(0, rest)
                    part.append(x)
                    room -= len(x)
                yield part

    def finish(self) -> Iterator[list[Example]]:
        while self.held:
            yield from self._settled(self._sequence())


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
                    ("loss_tokens", pa.int64())])
PIECES_DDL = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
              "offset long, loss_tokens long")


def _rows(sequences: Iterator[list[Example]], first: int) -> list[tuple]:
    rows = []
    for k, sequence in enumerate(sequences, first):
        offset = 0
        for x in sequence:
            rows.append((x.doc, x.start, len(x), zlib.crc32(x.ids), x.total, k, offset, x.bearing()))
            offset += len(x)
    return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return batches_of(dict(zip(PIECES.names, zip(*rows))) if rows else {n: [] for n in PIECES.names}, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1,
                   limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS), pool: int = POOL) -> DataFrame:
    """(doc_id, text) -> one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, loss_tokens. Every token bears loss."""
    prepare(docs.sparkSession)

    def run(batches):
        packer, encode = Packer(limits, pool), encoder(tokenizer)
        end, at = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.ids(batch.column("text").to_pylist())):
                ids += end
                new = _rows(packer.add(Example(doc, ids, len(ids) // 4)), at)
                at = new[-1][5] + 1 if new else at
                rows += new
            yield _batch(rows)
        yield _batch(_rows(packer.finish(), at))

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, PIECES_DDL)


def pack_examples(examples: DataFrame, limits: tuple[int, int, int] = (MAX_TOKENS, MAX_SEGMENTS, MAX_LOSS),
                  pool: int = POOL) -> DataFrame:
    """Instruction data (doc_id long, ids array<int>, loss array<boolean> or null) -> pieces as
    in ``pack_documents``; loss tokens are counted by the mask. Null ids: no piece."""
    prepare(examples.sparkSession)

    def run(batches):
        packer, at = Packer(limits, pool), TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = []
            for doc, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "loss"))):
                if ids:
                    mask = None if loss is None else np.array(loss, bool)
                    new = _rows(packer.add(Example(doc, np.array(ids, "<u4").tobytes(), len(ids), 0, mask)), at)
                    at = new[-1][5] + 1 if new else at
                    rows += new
            yield _batch(rows)
        yield _batch(_rows(packer.finish(), at))

    return examples.select("doc_id", "ids", "loss").mapInArrow(run, PIECES_DDL)
