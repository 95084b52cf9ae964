"""A kept family of suffix arrays: the levels of ``suffix_dedup`` in a folder, to which later
batches are added.

``add`` takes a batch of documents under an identity and gives the places of its texts where a
window starts that also starts anywhere else in the batch or in any batch before it.

* The batch gets a suffix array: one entry per distinct (suffix prefix, context) with the
  number of suffixes and one place. It is merge-scanned against the kept levels: their entries
  of the same prefixes, joined by key. Contexts met twice repeat whole; where a prefix has
  several contexts, their bytes are fetched from the kept texts and compared window by window, by
  the same two ways as in ``suffix_dedup``.
* Levels whose entries number alike (the same power of two) merge, so their number is
  logarithmic in that of the entries and an entry is rewritten as often.
* A version file, which one writer alone can create, names levels, texts and batches. A batch that
  fails before that leaves nothing visible and is simply added again; one that is known gives
  its kept result. A writer that lost the race starts over, so it sees the other's batch.

Defined results: null text is empty; texts under the window have no place; repeated rows of one
batch are separate documents; a batch without rows is known from then on and has no places; other
columns of the input, whatever their names, are not read by ``add`` and kept by ``cut``.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from babelqa.sources import files as FS

from .common import drop, prepare, small_side, written
from .suffix_dedup import (GROUP, WINDOW, compared_in_groups, context_bytes, context_runs, cut_spans, indexed_suffixes,
                           packed_rows, removed_spans, repeated_in_contexts)

LOG = "_versions"
ENTRIES = "key long, context long, n long, t long, size int, place long"
TEXTS = "t long, size int, packed binary"
PLACES = "t long, size int, places array<long>"


def suffix_array(entries: DataFrame) -> DataFrame:
    """Entries (key, context, n, t, size, place) -> one per (key, context), sorted by key."""
    merged = entries.groupBy("key", "context").agg(F.sum("n").alias("n"), F.min(F.struct("t", "size", "place")).alias("one"))
    return merged.select("key", "context", "n", "one.t", "one.size", "one.place").sortWithinPartitions("key")


class SuffixIndex:
    """The family in ``path`` (shared storage). ``window`` is fixed by the first batch."""

    def __init__(self, spark: SparkSession, path: str, window: int = WINDOW, group: int = GROUP):
        self.spark, self.path, self.window, self.group = spark, path.rstrip("/"), window, group
        kept = self._state()[1]["window"]
        if kept != window:
            raise ValueError(f"the index in {path} has windows of {kept} bytes, not {window}")

    def _state(self) -> tuple[int, dict]:
        names = [n for n in FS.files(self.spark, f"{self.path}/{LOG}") if n.endswith(".json")]
        if not names:
            return -1, {"window": self.window, "levels": [], "texts": [], "batches": {}}
        return int(names[-1][:-5]), json.loads(FS.read_text(self.spark, f"{self.path}/{LOG}/{names[-1]}"))

    def _read(self, folders: list[str], ddl: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(*[f"{self.path}/{f}" for f in folders])

    def _write(self, df: DataFrame, kind: str) -> str:
        folder = f"{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def level_sizes(self) -> list[int]:
        """Entries of each level, the largest first."""
        return [rows for _, rows in self._state()[1]["levels"]]

    def batches(self) -> list[str]:
        return list(self._state()[1]["batches"])

    def places(self, batch_id: str) -> DataFrame:
        """The kept result of a batch: (t, size, places), (t, size) being a text's content key."""
        return self._read([self._state()[1]["batches"][batch_id]], PLACES)

    def add(self, docs: DataFrame, batch_id: str, text_col: str = "text") -> DataFrame:
        """Add a batch; gives ``places(batch_id)``."""
        prepare(self.spark)
        number, state = self._state()
        if batch_id in state["batches"]:
            return self.places(batch_id)
        batch = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        batch = written(batch.where(F.octet_length("text") >= self.window), "batch")
        suffixes = written(indexed_suffixes(batch, self.window), "suffixes")
        array = self._write(suffix_array(suffixes.withColumn("n", F.lit(1).cast("long"))), "level")
        texts = self._write(packed_rows(batch, []).dropDuplicates(["t", "size"]), "texts")
        drop(batch)
        folders = {"levels": [f for f, _ in state["levels"]], "texts": [*state["texts"], texts]}
        found = self._write(self._repeated(suffixes, array, folders), "places")
        drop(suffixes)

        rows, levels = self._read([array], ENTRIES).count(), list(state["levels"])
        carry = [array]
        while rows and levels and levels[-1][1].bit_length() <= rows.bit_length():
            carry.append(levels.pop()[0])
            merged = self._write(suffix_array(self._read(carry, ENTRIES)), "level")
            carry, rows = [merged], self._read([merged], ENTRIES).count()
        state = {**state, "levels": levels + ([[carry[0], rows]] if rows else []), "texts": folders["texts"],
                 "batches": {**state["batches"], batch_id: found}}
        if FS.create(self.spark, f"{self.path}/{LOG}/{number + 1:020d}.json", json.dumps(state)):
            return self.places(batch_id)
        return self.add(docs, batch_id, text_col)      # another writer was faster: its batch counts too

    def _repeated(self, suffixes: DataFrame, array: str, folders: dict) -> DataFrame:
        """Suffixes of a new batch -> (t, size, places) of its windows that start elsewhere too."""
        new = self._read([array], ENTRIES)
        keys = small_side(written(new.select("key").distinct(), "keys"))
        old = self._read(folders["levels"], ENTRIES).join(keys, "key", "left_semi")
        both = new.withColumn("new", F.lit(True)).unionByName(old.withColumn("new", F.lit(False)))
        contexts = written(both.groupBy("key", "context").agg(
            F.sum("n").alias("n"), F.max("new").alias("new"), F.min(F.struct("t", "size", "place")).alias("one")), "contexts")
        several = written(contexts.groupBy("key").agg(F.count("*").alias("k")).where("k > 1"), "several")
        mixed = contexts.join(several.select("key"), "key", "left_semi")
        of_text = mixed.groupBy("one.t", "one.size").agg(F.collect_list(F.struct(
            F.col("one.place").alias("place"), "key", (F.col("new") & (F.col("n") == 1)).alias("single"))).alias("contexts"))
        of_text = written(of_text, "wanted")
        wanted = small_side(of_text.select("t", "size"))
        texts = (self._read(folders["texts"], TEXTS).join(wanted, ["t", "size"], "left_semi")
                 .dropDuplicates(["t", "size"]))           # a text may have come in several batches
        cut = written(context_bytes(texts.join(of_text, ["t", "size"]), self.window), "cut")
        large = several.where(F.col("k") > self.group).select("key")
        small = compared_in_groups(cut.join(large, "key", "left_anti").repartition("key").sortWithinPartitions("key"),
                                   self.window)
        runs = written(context_runs(cut.join(large, "key", "left_semi"), self.window), "runs")
        copied = (suffixes.join(contexts.where("n > 1").select("key", "context"), ["key", "context"], "left_semi")
                  .select("t", "size", "place"))
        found = copied.unionByName(small).unionByName(repeated_in_contexts(runs))
        return found.groupBy("t", "size").agg(F.collect_set("place").alias("places"))

    def cut(self, docs: DataFrame, batch_id: str, text_col: str = "text") -> DataFrame:
        """The documents of a batch that was added, without the bytes of its places (a character
        that loses a byte goes whole). Null text stays null; columns as they were."""
        prepare(self.spark)
        rest = F.struct(*(F.lit(None).cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))
        rows = docs.select(rest.alias("row"), F.col(text_col).isNotNull().alias("said"),
                           F.col(text_col).cast("string").alias("text"))
        schema, window = rows.select("row").schema.add("kept", "string"), self.window

        def run(batches):
            press = zstandard.ZstdDecompressor()
            for batch in batches:
                kept = []
                for said, packed, places in zip(*(batch.column(c) for c in ("said", "packed", "places"))):
                    raw = press.decompress(packed.as_py())
                    if places.is_valid:
                        raw = cut_spans(raw, removed_spans(places.values.to_numpy(), window))
                    kept.append(raw.decode("utf-8", "ignore") if said.as_py() else None)
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(kept, pa.string())], names=["row", "kept"])

        found = packed_rows(rows, ["row", "said"]).join(self.places(batch_id), ["t", "size"], "left")
        cut = found.select("row", "said", "packed", "places").mapInArrow(run, schema)
        return cut.select(F.col("row").withField(text_col, F.col("kept")).alias("row")).select("row.*")

    def clean(self) -> int:
        """Delete folders that the newest version does not list. Call it when no writer is at
        work. Returns their number."""
        state = self._state()[1]
        listed = {f for f, _ in state["levels"]} | set(state["texts"]) | set(state["batches"].values())
        gone = [f for kind in ("level-", "texts-", "places-") for f in FS.folders(self.spark, self.path, kind)
                if f.rsplit("/", 1)[1] not in listed]
        for f in gone:
            FS.delete(self.spark, f)
        return len(gone)
