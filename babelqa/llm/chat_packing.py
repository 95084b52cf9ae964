"""Packing of instruction data: conversations under limits on tokens, segments and loss tokens.

Turns are numbered inside their conversation and TURNS of them in a row make one part, so a
conversation of any length is spread over tasks. A part is rendered by the template of
``chat_format``; its ids are those of the stretches between the edges of the loss mask, one
after the other, and an end id. The bodies of assistant turns bear loss, nothing else. Parts are
packed by ``packing.Packer``.

Defined results: null role and null text are empty; rows without conv_id form one conversation;
rows of one turn number are ordered by role and text; repeated rows are turns of their own; an
empty table gives no piece; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from babelqa.operators.ranking import rank_within

from .chat_format import END, format_chats
from .common import prepare, written
from .encoding import encoder
from .packing import POOL, Example, Packer, _rows

TURNS = 32                        # turns of a part
LIMITS = (2048, 4, 1638)          # of a sequence: tokens, segments, loss-bearing tokens (four in five)

PIECES = pa.schema([(c, pa.int64()) for c in ("conv_id", "part", "start", "length", "ids_crc32", "part_tokens",
                                              "sequence_id", "offset", "loss_tokens")])
PIECES_DDL = ", ".join(f"{c} long" for c in PIECES.names)


def chat_parts(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, part, formatted, loss (spans of turns of the part)."""
    rows = written(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "turns")
    # numbered as a written table is read; it parts rows that are alike in all columns
    rows = rows.select("*", F.xxhash64("text").alias("_text"), F.monotonically_increasing_id().alias("_tie"))
    ranked = rank_within(rows, ["conv_id"], ["turn", "role", "_text", "_tie"], out="_rank")
    part = F.floor(F.col("_rank") / turns).cast("long")
    chats = format_chats(ranked.select(F.struct("conv_id", part.alias("part")).alias("conv_id"), "turn", "role", "text"))
    return chats.select("conv_id.conv_id", "conv_id.part", "formatted", "loss")


def stretches(formatted: str, loss: list[dict]) -> Iterator[tuple[str, bool]]:
    """The rendered text cut at the edges of the loss mask: (text, bears loss)."""
    stop, begin, mark = 0, 0, END + "\n"
    spans = {s["turn"]: (s["start"], s["length"]) for s in loss}
    for k in range(formatted.count(mark)):
        if k in spans:
            low = begin + spans[k][0]
            high = low + spans[k][1]
            yield formatted[stop:low], False
            yield formatted[low:high], True
            stop = high
        begin = formatted.index(mark, begin) + len(mark)
    yield formatted[stop:], False


def pack_chats(rows: DataFrame, tokenizer: str, end_id: int = 1, limits: tuple[int, int, int] = LIMITS,
               pool: int = POOL, turns: int = TURNS) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per piece: conv_id, part, start (ids of the part
    before it), length, ids_crc32, part_tokens, sequence_id, offset, loss_tokens."""
    prepare(rows.sparkSession)

    def example(encode, key, formatted, loss):
        ids, mask = [], []
        texts, bearing = zip(*stretches(formatted, loss))
        for x, bears in zip(encode.ids(list(texts)), bearing):
            ids.append(x)
            mask.append(np.full(len(x) // 4, bears))
        ids = b"".join([*ids, np.array([end_id], "<u4").tobytes()])
        return Example(key, ids, len(ids) // 4, 0, np.concatenate([*mask, [False]]))

    def settled(packer, sequences):
        """Without padding, also those that the loss limit cut off a long part."""
        for sequence in sequences:
            yield from packer._settled(sequence)

    def pieces(found):
        columns = list(zip(*((*row[0], *row[1:]) for row in found))) if found else [()] * len(PIECES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=PIECES)

    def run(batches):
        packer, encode, at = Packer(limits, pool), encoder(tokenizer), TaskContext.get().partitionId() << 32
        for batch in batches:
            found = []
            for conv, part, formatted, loss in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "part", "formatted", "loss"))):
                new = _rows(settled(packer, packer.add(example(encode, (conv, part), formatted, loss))), at)
                at = new[-1][5] + 1 if new else at
                found += new
            yield pieces(found)
        yield pieces(_rows(packer.finish(), at))

    # in a fixed order, so that a task that runs again gives the same sequences
    return chat_parts(rows, turns).sortWithinPartitions("conv_id", "part").mapInArrow(run, PIECES_DDL)
