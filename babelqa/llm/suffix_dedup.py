"""Suffix-array dedup with a logarithmic index family.

Finds every byte covered by a WINDOW-byte string that also starts anywhere else (same
document included, overlaps count, matches never cross documents).

* Sparse suffix arrays. Each window chooses one suffix inside itself: the leftmost smallest
  hash of PREFIX bytes. The choice depends on the window's bytes alone, so two equal windows
  choose suffixes with equal prefixes at equal distances, and only about one suffix in 70
  has to be indexed. Consecutive windows with one choice form the suffix's *context*.
* Logarithmic family. A batch of documents gets a suffix array: one entry per distinct
  suffix prefix, sorted by its 64-bit hash, with the smallest and largest context hash and
  the number of suffixes. A new array is merge-scanned (sort-merge join on the prefix)
  against the levels that stay; arrays of equal size are merged into one of twice the size,
  like carries of a binary counter, so n batches cost log2(n) rewrites of an entry.
* Long matches. A prefix met once holds no repeat. Met more often with one context, every
  window of that context repeats. Else the contexts differ somewhere: contexts met twice
  repeat whole, and one copy of each distinct context is compared with the others of its
  prefix, window by window, in a task. Prefixes with more than GROUP distinct contexts are
  not gathered: their contexts are cut into short runs of windows, equal runs repeat whole,
  and runs that share only their core are compared window by window, in shuffles that
  aggregate first. Both ways settle every window.

Nothing is emitted per pair. Copies of a text count at most twice per task, which is all
"anywhere else" asks. Contexts of long documents may be cut where blocks meet; they then
differ from uncut ones and are settled by their runs.

Defined results: null text is empty; texts under WINDOW bytes are never touched; repeated
rows are separate documents; ids may be null or repeated (texts are keyed by content); an empty
table gives no row; other columns, whatever their names, are not read by the digest and kept by
the stage. ``suffix_index`` keeps the levels for later batches.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, drop, prepare, release, text_bytes, written
from .encoding import forget_chunks

WINDOW = 200
PREFIX = 64
BATCHES = 4
GROUP = 2000           # distinct contexts of one suffix prefix that are compared in one task
RUN = 12               # windows that are compared through one core, in larger groups
BLOCK_BYTES = 1 << 18
POSITION_BITS = 24     # positions inside a block
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                              0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def _prefix_hashes(x: np.ndarray) -> np.ndarray:
    """Hash of the PREFIX bytes from each position."""
    word = x.astype(np.uint64)
    for step in (1, 2, 4):
        word = word[:-step] | (word[step:] << np.uint64(8 * step))
    word = word * MIX[0]
    word ^= word >> np.uint64(32)
    n = len(word) - PREFIX + 8
    mixed = word[:n] * MIX[1]
    for k in range(8, PREFIX, 8):
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[2 + k // 8 % 4]
        mixed += word[k:k + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= MIX[6]
    return mixed ^ (mixed >> np.uint64(30))


def _slide_min(values: np.ndarray, width: int) -> np.ndarray:
    low, have = values, 1
    while 2 * have <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[:-rest], low[rest:]) if rest else low


def _blocks(at: np.ndarray, window: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Byte ranges [a, b) with the window starts [s, e) inside, long documents cut so that
    each window start lies in exactly one block."""
    a = b = 0
    parts: list[tuple[int, int]] = []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        last = e - window + 1
        while s < last:
            stop = min(last, s + BLOCK_BYTES)
            if parts and (s < b or stop + window - 1 - a > 2 * BLOCK_BYTES):
                yield a, b, parts
                parts = []
            if not parts:
                a = s
            parts.append((s, stop))
            b, s = stop + window - 1, stop
    if parts:
        yield a, b, parts


def suffixes(raw: np.ndarray, at: np.ndarray, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, first window start in the row, number of windows, prefix hash, context hash)."""
    mask = np.uint64((1 << POSITION_BITS) - 1)
    for a, b, parts in _blocks(at, window):
        block = raw[a:b]
        prefix = _prefix_hashes(block)
        keyed = (prefix & ~mask) | np.arange(len(prefix), dtype=np.uint64)
        chosen = (_slide_min(keyed, window - PREFIX + 1) & mask).astype(np.int64)
        starts = np.concatenate([np.arange(s - a, e - a) for s, e in parts])
        chosen = chosen[starts]
        cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)) + 1
        cut = np.concatenate([[0], cut])
        size = np.diff(np.append(cut, len(starts)))
        low = starts[cut]
        view, hashed = memoryview(block), xxhash.xxh3_64_intdigest
        context = np.fromiter((hashed(view[p:q]) for p, q in zip(low.tolist(), (low + size + window - 1).tolist())),
                              np.uint64, len(low))
        row = np.searchsorted(at, low + a, side="right") - 1
        yield row, low + a - at[row], size, prefix[chosen[cut]].view(np.int64), context.view(np.int64)


def text_keys(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    view, hashed = memoryview(raw), xxhash.xxh3_64_intdigest
    return np.fromiter((hashed(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())),
                       np.uint64, len(at) - 1).view(np.int64)


def _twice(keys: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """Marks the first two rows of each key in this task."""
    keep = np.zeros(len(keys), bool)
    for k, key in enumerate(keys.tolist()):
        n = seen.get(key, 0)
        if n < 2:
            seen[key], keep[k] = n + 1, True
    return keep


SUFFIX = pa.schema([("key", pa.int64()), ("context", pa.int64()), ("t", pa.int64()), ("size", pa.int32()),
                    ("place", pa.int64())])


def indexed_suffixes(docs: DataFrame, window: int) -> DataFrame:
    """(text) -> (key, context, t, size, place): place is 256 * first window start + number
    of windows; (t, size) is the text's content key."""

    def run(batches):
        forget_chunks()
        seen: dict[int, int] = {}
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            t, size = text_keys(raw, at), np.diff(at)
            keep = _twice(t, seen)
            for row, low, n, key, context in suffixes(raw, at, window):
                ok = keep[row]
                row = row[ok]
                yield batches_of({"key": key[ok], "context": context[ok], "t": t[row],
                                  "size": size[row].astype(np.int32), "place": low[ok] * 256 + n[ok]}, SUFFIX)

    return docs.select("text").mapInArrow(run, "key long, context long, t long, size int, place long")


class LevelFamily:
    """Suffix arrays in levels of 1, 2, 4, ... batches. ``add`` scans a new batch against
    what is there and keeps the family logarithmic; ``repeated`` gives the prefixes that
    occur more than once, and whether their contexts differ."""

    def __init__(self):
        self.levels: list[DataFrame | None] = []
        self.matches: list[DataFrame] = []

    @staticmethod
    def _array(entries: DataFrame) -> DataFrame:
        merged = entries.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"),
                                            F.sum("n").alias("n"))
        return written(merged.sortWithinPartitions("key"), "level")

    def add(self, suffixes: DataFrame) -> None:
        new = suffixes.select("key", F.col("context").alias("low"), F.col("context").alias("high"),
                              F.lit(1).cast("long").alias("n"))
        level, carry = 0, []
        while level < len(self.levels) and self.levels[level] is not None:
            carry.append(self.levels[level])
            self.levels[level] = None
            level += 1
        staying = [x for x in self.levels if x is not None]
        if staying:
            new = self._array(new)
            for old in staying:
                old = old.select("key", *(F.col(c).alias(f"old_{c}") for c in ("low", "high")))
                self.matches.append(written(new.join(old, "key").select(
                    "key", F.least("low", "old_low").alias("low"), F.greatest("high", "old_high").alias("high")),
                    "matches"))
        for other in carry:
            new = new.unionByName(other)
        if level == len(self.levels):
            self.levels.append(None)
        self.levels[level] = new if staying and not carry else self._array(new)
        for old in carry:       # its entries are in the new level now
            drop(old)

    def repeated(self) -> DataFrame:
        parts = [x.where("n > 1").select("key", "low", "high") for x in self.levels if x is not None] + self.matches
        found = parts[0]
        for x in parts[1:]:
            found = found.unionByName(x)
        return found.groupBy("key").agg((F.min("low") < F.max("high")).alias("mixed"))


def packed_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs -> the given columns, then (t, size, packed): content key and compressed text."""
    schema = docs.select(*columns).schema.add("t", "long").add("size", "integer").add("packed", "binary")

    def run(batches):
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            raw, at = text_bytes(batch.column("text"))
            view = memoryview(raw)
            packed = [press.compress(view[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            arrays = [batch.column(c) for c in columns] + [
                pa.array(text_keys(raw, at)), pa.array(np.diff(at).astype(np.int32)), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*columns, "t", "size", "packed"])

    return docs.select(*columns, *([] if "text" in columns else ["text"])).mapInArrow(run, schema)


CONTEXTS = pa.schema([("key", pa.int64()), ("bytes", pa.binary()), ("lead", pa.int32()), ("t", pa.int64()),
                      ("size", pa.int32()), ("place", pa.int64()), ("single", pa.bool_())])


def context_bytes(rows: DataFrame, window: int) -> DataFrame:
    """(t, size, packed, contexts: list of (place, key, single)) -> one row per context with
    its bytes; ``lead`` is where its chosen suffix starts in them."""

    def run(batches):
        press = zstandard.ZstdDecompressor()
        mask = np.uint64((1 << POSITION_BITS) - 1)
        for batch in batches:
            found = []
            for t, size, packed, contexts in zip(*(batch.column(c) for c in ("t", "size", "packed", "contexts"))):
                text, t, size = press.decompress(packed.as_py()), t.as_py(), size.as_py()
                raw = np.frombuffer(text, np.uint8)
                for c in contexts.as_py():
                    low, n = divmod(c["place"], 256)
                    lead = int(np.argmin(_prefix_hashes(raw[low:low + window]) & ~mask))
                    found.append((c["key"], text[low:low + n + window - 1], lead, t, size, c["place"], c["single"]))
            yield batches_of(dict(zip(CONTEXTS.names, zip(*found))) if found else {n: [] for n in CONTEXTS.names}, CONTEXTS)

    return rows.mapInArrow(run, "key long, bytes binary, lead int, t long, size int, place long, single boolean")


PLACES = pa.schema([("t", pa.int64()), ("size", pa.int32()), ("place", pa.int64())])


def compared_in_groups(contexts: DataFrame, window: int) -> DataFrame:
    """Contexts sorted by key -> (t, size, place) of the windows of single contexts that
    another context of the key holds too. One key's contexts are held at a time."""

    def places(group: list[tuple]):
        met = Counter(c[0][p:p + window] for c in group for p in range(len(c[0]) - window + 1))
        for text, t, size, place, single in group:
            if single:
                hit = np.array([met[text[p:p + window]] > 1 for p in range(len(text) - window + 1)], np.int8)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))).tolist()
                for a, b in zip(edge[::2], edge[1::2]):
                    yield t, size, (place // 256 + a) * 256 + b - a

    def run(batches):
        key, group = None, []
        for batch in batches:
            found = []
            for k, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "bytes", "t", "size", "place", "single"))):
                if k != key:
                    found += places(group)
                    key, group = k, []
                group.append(tuple(row))
            yield batches_of(dict(zip(PLACES.names, zip(*found))) if found else {n: [] for n in PLACES.names}, PLACES)
        found = list(places(group))
        yield batches_of(dict(zip(PLACES.names, zip(*found))) if found else {n: [] for n in PLACES.names}, PLACES)

    return contexts.mapInArrow(run, "t long, size int, place long")


RUNS = pa.schema([("core1", pa.int64()), ("core2", pa.int64()), ("left", pa.binary()), ("right", pa.binary()),
                  ("first", pa.int32()), ("t", pa.int64()), ("size", pa.int32()), ("place", pa.int64()),
                  ("single", pa.bool_())])


def context_runs(contexts: DataFrame, window: int) -> DataFrame:
    """Contexts -> one row per run: the windows of a context whose chosen suffix stands
    q*RUN .. q*RUN+RUN-1 bytes inside them. All of them hold the run's core (its hash is
    kept); what sticks out on either side is kept as is, so the windows can be told apart
    later. ``first`` is the smallest distance in the run, minus q*RUN; ``place`` the run's."""

    def run(batches):
        core_size = window - RUN + 1
        for batch in batches:
            found: list[tuple] = []
            for text, lead, t, size, place, single in zip(*(
                    batch.column(c).to_pylist() for c in ("bytes", "lead", "t", "size", "place", "single"))):
                low, n = divmod(place, 256)
                near, far = lead - (n - 1), lead      # distances of the last and the first window
                for q in range(near // RUN, far // RUN + 1):
                    d0, d1 = max(near, q * RUN), min(far, q * RUN + RUN - 1)
                    core = lead - q * RUN
                    found.append((xxhash.xxh3_128_digest(text[core:core + core_size], seed=q), text[lead - d1:core],
                                  text[core + core_size:lead - d0 + window], d0 - q * RUN, t, size,
                                  (low + lead - d1) * 256 + d1 - d0 + 1, single))
            core = np.frombuffer(b"".join(f[0] for f in found), np.int64).reshape(-1, 2)
            rest = dict(zip(RUNS.names[2:], list(zip(*found))[1:])) if found else {n: [] for n in RUNS.names[2:]}
            yield batches_of(rest | {"core1": core[:, 0], "core2": core[:, 1]}, RUNS)

    return contexts.mapInArrow(run, "core1 long, core2 long, left binary, right binary, first int, t long, size int, "
                                    "place long, single boolean")


def repeated_in_contexts(runs: DataFrame) -> DataFrame:
    """Runs of distinct contexts -> (t, size, place) of the repeated windows of contexts that
    occur once. Equal runs repeat whole; where one core has several kinds of run, each kind's
    windows are compared, by the bytes that stick out of the core."""
    core, kind = ["core1", "core2"], ["core1", "core2", "left", "right", "first"]
    kinds = written(runs.groupBy(*kind).agg(F.count("*").alias("n"), F.min(F.struct(
        F.col("single").alias("other"), "t", "size", "place")).alias("one")), "kinds")
    whole = (runs.where("single").join(kinds.where("n > 1").select(*kind), kind, "left_semi")
             .select("t", "size", "place"))
    several = kinds.groupBy(*core).agg(F.count("*").alias("k")).where("k > 1").select(*core)
    width = F.pmod(F.col("one.place"), F.lit(256)).cast("int")
    cut = kinds.join(several, core, "left_semi").select(
        *core, "left", "right", "n", "one", F.explode(F.sequence(F.col("first"), F.col("first") + width - 1)).alias("d"))
    # a window at distance d holds the last d bytes before the core, and those behind it up to RUN - 1 in all
    cut = cut.select(*core, "d", F.expr("right(hex(left), 2 * d)").alias("before"),
                     F.expr(f"left(hex(right), 2 * ({RUN - 1} - d))").alias("behind"), "n", "one",
                     (F.col("one.place") / 256).cast("long").alias("low"), F.octet_length("left").alias("lead"))
    window = [*core, "d", "before", "behind"]
    shared = cut.groupBy(*window).agg(F.count("*").alias("m")).where("m > 1").select(*window)
    alone = (cut.where("n = 1 and one.other").join(shared, window, "left_semi")
             .select("one.t", "one.size", ((F.col("low") + F.col("lead") - F.col("d")) * 256 + 1).alias("place")))
    return whole.unionByName(alone)


def repeated_places(docs: DataFrame, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """(text) -> (t, size, places): for each text with repeated windows, where they start
    (256 * first start + number of starts)."""
    docs = docs.select(F.coalesce(F.col("text"), F.lit("")).alias("text"))
    family = LevelFamily()
    part = F.pmod(F.xxhash64("text"), F.lit(batches))
    for k in range(batches):
        family.add(indexed_suffixes(docs.where(part == k), window))
    repeated = written(family.repeated(), "repeated")

    met = written(indexed_suffixes(docs, window).join(repeated, "key"), "met")
    contexts = (met.where("mixed").groupBy("key", "context")
                .agg(F.count("*").alias("n"), F.min(F.struct("t", "size", "place")).alias("first")))
    contexts = written(contexts, "contexts")
    release(docs.sparkSession)
    one_text = contexts.groupBy("first.t", "first.size").agg(F.collect_list(F.struct(
        F.col("first.place").alias("place"), "key", (F.col("n") == 1).alias("single"))).alias("contexts"))
    texts = packed_rows(docs.where(F.octet_length("text") >= window), []).dropDuplicates(["t", "size"])
    cut = written(context_bytes(texts.join(one_text, ["t", "size"]), window), "cut")
    release(docs.sparkSession)
    large = contexts.groupBy("key").agg(F.count("*").alias("k")).where(F.col("k") > GROUP).select("key")
    small = compared_in_groups(cut.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key"), window)
    runs = written(context_runs(cut.join(large, "key", "left_semi"), window), "runs")

    place = ["t", "size", "place"]
    whole = met.where("not mixed").select(*place)
    copied = met.where("mixed").join(contexts.where("n > 1").select("key", "context"), ["key", "context"]).select(*place)
    found = whole.unionByName(copied).unionByName(small).unionByName(repeated_in_contexts(runs))
    return found.groupBy("t", "size").agg(F.collect_set("place").alias("places"))


def removed_spans(places: np.ndarray, window: int) -> np.ndarray:
    """Sorted, disjoint, non-touching byte spans (n, 2) that the given places cover."""
    places = np.sort(places)
    low, high = places // 256, places // 256 + places % 256 + window - 1
    reach = np.maximum.accumulate(high)
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    return np.stack([low[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(low) - 1)]], axis=1)


def cut_spans(raw: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def with_spans(docs: DataFrame, columns: list[str], window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """docs' columns, (t, size, packed) and ``places``, null where nothing repeats."""
    prepare(docs.sparkSession)
    return packed_rows(docs, columns).join(repeated_places(docs, window, batches), ["t", "size"], "left")


def dedup_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 batches: int = BATCHES) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
                     ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc, packed, places in zip(*(batch.column(c) for c in ("doc_id", "packed", "places"))):
                raw = press.decompress(packed.as_py())
                spans = removed_spans(places.values.to_numpy(), window) if places.is_valid else np.empty((0, 2), int)
                kept = cut_spans(raw, spans)
                rows.append((doc.as_py(), len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
            yield batches_of(dict(zip(out.names, zip(*rows))) if rows else {n: [] for n in out.names}, out)

    return with_spans(docs, ["doc_id"], window, batches).select("doc_id", "packed", "places").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, text_col: str = "text", window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """docs with the repeated bytes cut out of ``text_col`` (a character that loses a byte
    goes whole); other columns stay. Null text stays null."""
    rest = F.struct(*(F.lit(None).cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(rest.alias("row"), F.col(text_col).isNotNull().alias("has_text"),
                       F.col(text_col).cast("string").alias("text"))
    schema = rows.select("row").schema.add("kept", "string")

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            texts = []
            for text, packed, places in zip(batch.column("has_text").to_pylist(), batch.column("packed"), batch.column("places")):
                raw = press.decompress(packed.as_py())
                if places.is_valid:
                    raw = cut_spans(raw, removed_spans(places.values.to_numpy(), window))
                texts.append(raw.decode("utf-8", "ignore") if text else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], names=["row", "kept"])

    cut = with_spans(rows, ["row", "has_text"], window, batches).drop("t", "size").mapInArrow(run, schema)
    return cut.select(F.col("row").withField(text_col, F.col("kept")).alias("row")).select("row.*")


def keep_after_repeats(docs: DataFrame) -> DataFrame:
    """Documents with their repeated passages cut out and n_chars brought up to date; those
    that lose all but white space go, those that were empty before stay."""
    rest = F.struct(*(F.lit(None).cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))
    before = docs.select(rest.alias("row"), "text", F.coalesce(F.col("text"), F.lit("")).rlike(r"\S").alias("said"))
    cut = remove_repeats(before).where(~F.col("said") | F.col("text").rlike(r"\S"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(row.alias("row")).select("row.*")
