"""Token-ID files with directly addressable codes.

An id is cut into chunks of CHUNK_BITS bits. Level 0 holds the lowest chunk of every id; a
continuation bitmap says which ids go on, and level 1 holds the next chunk of those alone, and
so on. A rank directory (set bits before each block of RANK_BITS) turns "how many ids before
this one go on" into one lookup and one short popcount, so any id, or any range, is read
without decoding what lies before it.

File format (little-endian): the table of a run is a folder of Parquet files. Each row is one
segment: ``part`` and ``segment`` (order), ``first_id`` (ids before it in the part),
``doc_ids``, ``doc_starts`` (first id of each document in the segment, and the total at the
end) and ``codes``, a self-contained byte string:
  "DAC1" | u32 levels | u64 ids | per level: u64 n | u64 directory entries |
  n chunk bytes | ceil(n/8) bitmap bytes (lowest bit first) | u32 directory entries.

Parts follow the order of doc_id (rows without one first, equal ids by content), so ids of all
documents before one are its part's sum, its segment's first_id and its own start. Segments
close at document boundaries after SEGMENT_IDS ids.

Defined results: null text is empty: its end id alone; repeated rows are written like others;
an empty table gives no document; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, content_key, prepare, scratch
from .encoding import encoder

CHUNK_BITS = 8
RANK_BITS = 512
SEGMENT_IDS = 1 << 18
POPCOUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode_codes(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest):
        more = rest >> np.uint32(CHUNK_BITS)
        goes_on = more > 0
        bitmap = np.packbits(goes_on, bitorder="little")
        per_block = np.add.reduceat(POPCOUNT[bitmap].astype(np.uint32), np.arange(0, len(bitmap), RANK_BITS // 8))
        directory = np.concatenate([[0], np.cumsum(per_block)[:-1]]).astype("<u4")
        levels.append(struct.pack("<QQ", len(rest), len(directory)) + (rest & np.uint32(0xFF)).astype(np.uint8).tobytes()
                      + bitmap.tobytes() + directory.tobytes())
        rest = more[goes_on]
    return b"DAC1" + struct.pack("<IQ", len(levels), len(ids)) + b"".join(levels)


class DirectCodes:
    """Random access to encoded ids."""

    def __init__(self, codes: bytes | memoryview):
        codes = memoryview(codes)
        if bytes(codes[:4]) != b"DAC1":
            raise ValueError("not a segment of directly addressable codes")
        n_levels, self.size = struct.unpack_from("<IQ", codes, 4)
        self.levels, at = [], 16
        for _ in range(n_levels):
            n, blocks = struct.unpack_from("<QQ", codes, at)
            at += 16
            chunks = np.frombuffer(codes, np.uint8, n, at)
            bitmap = np.frombuffer(codes, np.uint8, (n + 7) // 8, at + n)
            directory = np.frombuffer(codes, "<u4", blocks, at + n + len(bitmap))
            self.levels.append((chunks, bitmap, directory))
            at += n + len(bitmap) + 4 * blocks

    @staticmethod
    def _rank(level: tuple, i: int) -> int:
        """Set bits before bit i."""
        _, bitmap, directory = level
        if i == 0:
            return 0
        block, byte = (i - 1) // RANK_BITS, i >> 3
        found = int(directory[block]) + int(POPCOUNT[bitmap[block * RANK_BITS // 8:byte]].sum(dtype=np.int64))
        return found + (int(POPCOUNT[int(bitmap[byte]) & ((1 << (i & 7)) - 1)]) if i & 7 else 0)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level[0][i]) << (CHUNK_BITS * k)
            if not level[1][i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """ids a .. b-1: each level is entered through its rank directory."""
        out = np.zeros(b - a, np.uint32)
        to = np.arange(b - a)
        for k, level in enumerate(self.levels):
            if a >= b:
                break
            out[to] |= level[0][a:b].astype(np.uint32) << np.uint32(CHUNK_BITS * k)
            bits = np.unpackbits(level[1][a >> 3:(b + 7) >> 3], bitorder="little")[a & 7:(a & 7) + b - a].astype(bool)
            to = to[bits]
            a, b = self._rank(level, a), self._rank(level, b)
        return out


SEGMENTS = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()),
                      ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("codes", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0, segment_ids: int = SEGMENT_IDS) -> None:
    """Encode (doc_id, text) whole, append ``end_id`` to each document and write the files."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.repartitionByRange("doc_id").withColumn("t", content_key("text")).sortWithinPartitions("doc_id", "t")

    def run(batches):
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, segment, first = TaskContext.get().partitionId(), 0, 0
        held, names, starts, n = [], [], [], 0

        def close():
            ids = np.frombuffer(b"".join(held), "<u4")
            return batches_of({"part": [part], "segment": [segment], "first_id": [first], "n_ids": [n],
                               "doc_ids": [names], "doc_starts": [[*starts, n]], "codes": [encode_codes(ids)]}, SEGMENTS)

        for batch in batches:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode.ids(batch.column("text").to_pylist())):
                starts.append(n)
                names.append(doc)
                held.append(ids + end)
                n += len(held[-1]) // 4
                if n >= segment_ids:
                    yield close()
                    segment, first, held, names, starts, n = segment + 1, first + n, [], [], [], 0
        if names:
            yield close()

    docs.mapInArrow(run, "part int, segment int, first_id long, n_ids long, doc_ids array<long>, "
                         "doc_starts array<long>, codes binary").write.parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """The files' documents: doc_id, start, n_tokens, ids_crc32, each read by its place."""
    table = spark.read.parquet(path)
    sums = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, total = {}, 0
    for part, n in sums:        # one number per file
        before[part] = total
        total += n
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c: batch.column(c)[row]  # noqa: E731, B023
                codes = DirectCodes(get("codes").as_buffer())
                starts = get("doc_starts").values.to_numpy()
                base = before[get("part").as_py()] + get("first_id").as_py()
                crc = [zlib.crc32(codes.slice(a, b).astype("<u4").tobytes())
                       for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield batches_of({"doc_id": get("doc_ids").values, "start": starts[:-1] + base,
                                  "n_tokens": np.diff(starts), "ids_crc32": crc}, out)

    return table.select("part", "first_id", "doc_ids", "doc_starts", "codes").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    path = scratch(docs.sparkSession, "tokens")
    write_tokens(docs, tokenizer, path)
    return read_documents(docs.sparkSession, path)
