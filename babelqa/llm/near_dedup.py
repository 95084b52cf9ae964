"""MinHash near-dedup: circulant MinHash, banding, exact Jaccard verification.

A document's set holds its distinct word shingles (ASCII letters lower-cased, words cut at
ASCII white space; a document with fewer words than a shingle is one shingle). Shingles are
64-bit hashes. Two fixed permutations of the slots 0..SLOTS-1 make the whole signature: the
first scatters the shingles, the second is read at circular shifts 0, 1, 2, ... and gives
coordinate k as the smallest value among the set's slots shifted by k, so one shingle
touches one contiguous run of the second table.

Documents with equal sets are one node. Nodes meet in bands of the signature:

1. In each bucket the most central node (largest sum of its buckets' sizes) is the hub;
   only (hub, member) pairs are emitted, so a bucket costs its size, not its square.
2. Each pair is confirmed on the full sets; confirmed pairs give components.
3. Where a hub's group still has several components, the members not linked with the hub
   are compared with the whole group in blocks inside tasks, on full sets, and only links
   between different components come out. So each pair that shares a bucket is either
   compared, or already connected.

With 32 bands of 5 rows a pair at similarity 0.8 misses every bucket with probability
3e-6, at 0.85 below 1e-8. Node ids are 64-bit hashes of whole sets.

Defined results: null or empty text, or text without words: empty set, linked with nothing,
component_id its own id. Rows with equal ids or null ids are separate rows with their own
sets; null ids never become a component_id unless the whole component has no id. An empty table gives
no row; other columns, whatever their names, are not read by the operator and kept by the stage.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, content_key, prepare, release, small_side, text_bytes, without, written
from .encoding import forget_chunks
from .graph import components

SHINGLE_WORDS = 5
SIMILARITY = Fraction(4, 5)
BANDS, ROWS = 32, 5
SLOTS = 1 << 20
SEED = 20
QUERY_BLOCK, MEMBER_BLOCK = 256, 512   # rows of a block comparison
WANTED_ROWS = 2_000_000                # node ids (8 bytes) that may be broadcast; more are joined in a shuffle
CACHE_WORDS = 1 << 16                  # hashes of words a task remembers

MIX1, MIX2, MIX3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHash()


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX2
    x = (x ^ (x >> np.uint64(27))) * MIX3
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one document."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    take = min(width, len(one))
    mixed = np.full(len(one) - take + 1, take, np.uint64)
    for k in range(take):
        mixed = scramble(mixed * MIX1 + one[k:len(one) - take + 1 + k])
    return np.unique(mixed)


class Circulant:
    """The two permutations; ``signature`` maps a set to ``size`` coordinates."""

    def __init__(self, size: int, slots: int = SLOTS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.scatter = rng.permutation(slots).astype(np.int32)
        ring = rng.permutation(slots).astype(np.int32)
        self.shifts = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:size]]), size)
        self.size, self.slots = size, slots

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = self.scatter[(hashes & np.uint64(self.slots - 1)).astype(np.int64)]
        low = np.full(self.size, np.iinfo(np.int32).max, np.int32)
        for k in range(0, len(at), 2048):
            np.minimum(low, self.shifts[at[k:k + 2048]].min(axis=0), out=low)
        return low


_circulants: dict[tuple, Circulant] = {}


def circulant(size: int) -> Circulant:
    if size not in _circulants:
        _circulants[size] = Circulant(size)
    return _circulants[size]


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    part = signature[:bands * rows].astype(np.uint64).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = scramble(key * MIX1 + part[:, k])
    return key.view(np.int64)


def node_id(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).astype(np.int64))


def _documents(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    raw, at = text_bytes(batch.column(column))
    view = memoryview(raw)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        yield bytes(view[a:b])


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, t, text) -> (doc_id, t, node, n_shingles, bands); node and bands null if empty."""
    out = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("node", pa.int64()), ("n_shingles", pa.int64()),
                     ("bands", pa.list_(pa.int64()))])

    def run(batches):
        forget_chunks()
        make = circulant(bands * rows)
        for batch in batches:
            nodes, sizes, keys = [], [], []
            for text in _documents(batch, "text"):
                found = shingle_set(text, width)
                sizes.append(len(found))
                nodes.append(node_id(found) if len(found) else None)
                keys.append(band_keys(make.signature(found), bands, rows) if len(found) else None)
            yield batches_of({"doc_id": batch.column("doc_id"), "t": batch.column("t"), "node": nodes, "n_shingles": sizes, "bands": keys}, out)
        _words.clear()

    return docs.mapInArrow(run, "doc_id long, t long, node long, n_shingles long, bands array<long>")


def packed_texts(docs: DataFrame, width: int) -> DataFrame:
    """(node, packed): the compressed text of each node, once per task."""
    out = pa.schema([("node", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        seen, press = set(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            nodes, packed = [], []
            for text in _documents(batch, "text"):
                found = shingle_set(text, width)
                if len(found) and (node := node_id(found)) not in seen:
                    seen.add(node)
                    nodes.append(node)
                    packed.append(press.compress(text))
            yield batches_of({"node": nodes, "packed": packed}, out)
        _words.clear()

    return docs.mapInArrow(run, "node long, packed binary")


def unpacked_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, packed) -> (node, members): the node's set as packed 64-bit hashes."""
    out = pa.schema([("node", pa.int64()), ("members", pa.binary())])

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            yield batches_of({"node": batch.column("node"),
                              "members": [shingle_set(press.decompress(x.as_py()), width).tobytes()
                                          for x in batch.column("packed")]}, out)

    return texts.mapInArrow(run, "node long, members binary")


def similar(both: int | np.ndarray, one, other, least: Fraction):
    """Exact test: intersection / union >= least."""
    return both * least.denominator >= (one + other - both) * least.numerator


def _sets(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(column)]


def confirm(pairs: DataFrame, least: Fraction) -> DataFrame:
    """(a, b, set_a, set_b) -> the pairs (a, b) whose full sets are similar."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(_sets(batch, "set_a"), _sets(batch, "set_b")):
                small, large = sorted((x, y), key=len)
                if len(small) * least.denominator < len(large) * least.numerator:
                    keep.append(False)
                    continue
                at = np.searchsorted(large, small)
                both = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                keep.append(bool(similar(both, len(x), len(y), least)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_())).cast(out)

    return pairs.mapInArrow(run, "a long, b long")


def _compare(block: list[tuple], least: Fraction) -> Iterator[tuple[int, int]]:
    """Links between different components of one block of (query?, comp, set) rows; one
    link at most for each query and component."""
    queries = [(c, s) for q, c, s in block if q]
    members = [(c, s) for q, c, s in block if not q]
    if not queries or not members:
        return
    values, columns = np.unique(np.concatenate([s for _, s in members]), return_inverse=True)
    sizes = np.array([len(s) for _, s in members])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    comps = np.array([c for c, _ in members])
    mark = np.zeros(len(values), np.int64)
    for comp, own in queries:
        at = np.searchsorted(values, own)
        at = at[values[np.minimum(at, len(values) - 1)] == own]
        mark[at] = 1
        both = np.add.reduceat(mark[columns], starts)
        mark[at] = 0
        hit = similar(both, sizes, len(own), least) & (comps != comp)
        for other in np.unique(comps[hit]).tolist():
            yield comp, other


def compare_blocks(rows: DataFrame, least: Fraction) -> DataFrame:
    """Rows (hub, part_q, part_m, query, comp, members), sorted by block -> links between
    components. One block at a time is held."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        key, block = None, []

        def done():
            found = sorted(set(_compare(block, least)))
            return batches_of({"a": [a for a, _ in found], "b": [b for _, b in found]}, out)

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("hub", "part_q", "part_m"))))
            query, comp = batch.column("query").to_pylist(), batch.column("comp").to_pylist()
            sets = _sets(batch, "members")
            for k, q, c, s in zip(keys, query, comp, sets):
                if k != key:
                    if block:
                        yield done()
                    key, block = k, []
                block.append((q, c, s.copy()))
        if block:
            yield done()

    return rows.mapInArrow(run, "a long, b long")


def star_pairs(signed: DataFrame) -> DataFrame:
    """(hub, node) for each node that shares a bucket with a hub."""
    bands = signed.where("node is not null").select("node", "bands").dropDuplicates(["node"])
    bands = bands.select("node", F.explode("bands").alias("band"))
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = written(bands.join(sizes, "band"), "buckets")
    central = members.groupBy("node").agg(F.sum("size").alias("central"))
    hubs = (members.join(central, "node").groupBy("band")
            .agg(F.max(F.struct("central", "node")).alias("top")).select("band", F.col("top.node").alias("hub")))
    return members.join(hubs, "band").where("hub <> node").select("hub", "node").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE_WORDS,
                    least: Fraction = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, t (content key), n_shingles, component_id (smallest id of
    its group of near-duplicates), kept (doc_id = component_id)."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), content_key(text_col).alias("t"),
                       F.col(text_col).cast("string").alias("text"))
    signed = written(sign(docs, width, bands, rows), "signed")

    star = written(star_pairs(signed), "star")
    release(spark)
    wanted = small_side(written(star.select("node").union(star.select("hub")).distinct(), "wanted"), WANTED_ROWS)
    texts = packed_texts(docs.select("text"), width).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    sets = written(unpacked_sets(texts, width), "sets")
    release(spark)

    of = lambda name, col: sets.select(F.col("node").alias(name), F.col("members").alias(col))
    pairs = star.select(F.col("hub").alias("a"), F.col("node").alias("b"))
    links = written(confirm(pairs.join(of("b", "set_b"), "b").join(of("a", "set_a"), "a"), least), "links")
    first = components(links)

    comp_of = lambda name, col: first.select(F.col("node").alias(name), F.col("comp").alias(col))
    group = (star.join(comp_of("node", "c"), "node", "left").join(comp_of("hub", "h"), "hub", "left")
             .select("hub", "node", F.coalesce("c", "node").alias("comp"), F.coalesce("h", "hub").alias("hub_comp")))
    group = written(group.withColumn("query", F.col("comp") != F.col("hub_comp")).drop("hub_comp"), "groups")
    split = (group.groupBy("hub").agg(F.sum(F.col("query").cast("long")).alias("n_q"), F.count("*").alias("n_m"))
             .where("n_q > 0 and n_m > 1")
             .select("hub", F.ceil(F.col("n_q") / QUERY_BLOCK).cast("int").alias("qs"),
                     F.ceil(F.col("n_m") / MEMBER_BLOCK).cast("int").alias("ms")))
    rest = group.join(split, "hub").join(sets, "node")
    at = F.xxhash64("node", F.lit(SEED))
    as_query = rest.where("query").select(
        "hub", F.pmod(at, "qs").cast("int").alias("part_q"),
        F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("part_m"), "query", "comp", "members")
    as_member = rest.select(
        "hub", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("part_q"),
        F.pmod(at, "ms").cast("int").alias("part_m"), F.lit(False).alias("query"), "comp", "members")
    block = ["hub", "part_q", "part_m"]
    blocks = as_query.unionByName(as_member).repartition(*block).sortWithinPartitions(*block, "query")
    second = components(compare_blocks(blocks, least))

    comp = (first.join(second.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left")
            .select("node", F.coalesce("top", "comp").alias("comp")))
    alone = second.join(first.select("node"), "node", "left_anti")
    comp = written(comp.unionByName(alone.select("node", "comp")), "comps")
    least_id = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("low"))
    low = least_id.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    top = low.groupBy("comp").agg(F.min("low").alias("component_id"))
    found = low.join(top, "comp").select("node", "component_id")
    out = signed.select("doc_id", "t", "node", "n_shingles").join(found, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, **params) -> DataFrame:
    """docs without the near-duplicates of another document: of each group the document with
    the smallest id stays, as one row if its id and text are repeated. Documents without
    words stay; so do groups in which no document has an id. Columns as they were."""
    out = without(docs, near_duplicates(docs, **params).where("not kept"))
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    again = small_side(written(again.select(F.col("doc_id").alias("_d")), "again"))
    same = docs["doc_id"] == again["_d"]
    return out.join(again, same, "left_anti").unionByName(
        out.join(again, same, "left_semi").dropDuplicates(["doc_id", "text"]))
