"""Quoted CSV with line breaks inside the fields, read by many tasks per file.

Spark's multi-line CSV reader takes a file as one task, since only a scan from the start
tells whether a line break stands inside quotes. A break ends a record exactly when the
number of quote marks before it, from the start of the file, is even (a doubled mark inside a
field counts twice), so:

1. the file is read as lines in ordinary splits, and every split reports the parity of its
   quote marks;
2. a prefix sum over the splits of a file says for each split whether it starts inside quotes;
3. each split then cuts its own records. A record that crosses the end of a split is put
   together from the fragments of the splits concerned, one row for each.

Quote marks are expected where the CSV rules allow them: around whole fields, doubled inside.
The text is UTF-8 with ``\\n`` or ``\\r\\n`` after each record.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import join_splits
from ..session import measured

PIECES = "_file string, _block long, _at long, _whole boolean, _text string"
_PIECE_SCHEMA = pa.schema([("_file", pa.string()), ("_block", pa.int64()), ("_at", pa.int64()), ("_whole", pa.bool_()),
                           ("_text", pa.string())])


def split_lines(spark: SparkSession, path) -> DataFrame:
    """The lines of the files, each with its file and the start of its split."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), "value")


def split_states(lines: DataFrame, quote: str = '"') -> DataFrame:
    """(_file, _block, starts_open, ends_open): whether a split starts and ends inside quotes."""
    marks = F.length("value") - F.length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    marks = F.coalesce(F.try_divide(marks, F.lit(len(quote))), F.lit(0)).cast("long")
    odd = lines.groupBy("_file", "_block").agg(F.sum(marks).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, 0))
    return odd.select("_file", "_block", (F.pmod(upto - F.col("n"), F.lit(2)) == 1).alias("starts_open"),
                      (F.pmod(upto, F.lit(2)) == 1).alias("ends_open"))


def _cut(lines: DataFrame, quote: str, whole: bool) -> DataFrame:
    """Lines with ``starts_open`` -> the whole records of their splits, or else the fragments
    at the splits' ends. ``_at`` numbers the records that start in a split; -1 is the rest of a
    record that started before."""

    def run(batches):
        place, held, at, inside = None, [], 0, False       # held: lines of a record not yet ended

        def piece(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PIECE_SCHEMA)] if rows else [
                pa.array([], f.type) for f in _PIECE_SCHEMA], schema=_PIECE_SCHEMA)

        for batch in batches:
            files, blocks, starts = (batch.column(c) for c in ("_file", "_block", "starts_open"))
            values = batch.column("value")
            if not batch.num_rows:
                continue
            block = blocks.to_numpy()
            name = files.dictionary_encode().indices.to_numpy()
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (name[1:] != name[:-1])])
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), batch.num_rows]):
                here = files[a].as_py(), int(block[a])
                if here != place:
                    if held and not whole:
                        yield piece([(*place, at, False, "\n".join(held))])
                    place, held, at, inside = here, [], 0, bool(starts[a].as_py())
                    if inside:
                        at = -1
                odd = pc.count_substring(values.slice(a, b - a), quote).to_numpy() & 1
                open_after = (np.cumsum(odd) + inside) & 1
                text, rows, first = values.slice(a, b - a).to_pylist(), [], 0
                for end in (np.flatnonzero(open_after == 0) + 1).tolist():
                    body = "\n".join([*held, *text[first:end]]) if held or end > first + 1 else text[first]
                    if (at >= 0) == whole:
                        rows.append((*here, at, at >= 0, body))
                    held, first, at = [], end, at + 1
                held += text[first:]
                inside = bool(open_after[-1])
                yield piece(rows)
        if held and not whole:
            yield piece([(*place, at, False, "\n".join(held))])

    return lines.select("_file", "_block", "starts_open", "value").mapInArrow(run, PIECES)


def _joined(fragments: DataFrame) -> DataFrame:
    """Fragments -> the records they make up, at the place where each begins."""
    number = F.sum((F.col("_at") >= 0).cast("long")).over(Window.partitionBy("_file").orderBy("_block", "_at"))
    x = fragments.withColumn("_number", number).groupBy("_file", "_number").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_at", "_text"))).alias("_l"))
    return x.select("_file", F.get("_l", F.lit(0))["_block"].alias("_block"), F.get("_l", F.lit(0))["_at"].alias("_at"),
                    F.array_join(F.transform("_l", lambda r: r["_text"]), "\n").alias("_text"))


def csv_records(spark: SparkSession, path, quote: str = '"') -> tuple[DataFrame, DataFrame]:
    """The records as texts with their place (_file, _block, _at): those inside one split, in
    file order, and the few that cross the end of one."""
    lines = split_lines(spark, path)
    states = measured(split_states(lines, quote), "csv-splits")
    known = states.where(F.col("starts_open") | F.col("ends_open"))
    edge = join_splits(lines, known.select("_file", "_block", "starts_open"), how="inner")
    crossing = measured(_joined(_cut(edge, quote, whole=False)), "csv-edges")
    all_lines = join_splits(lines, states.select("_file", "_block", "starts_open"))
    checked = all_lines.withColumn("starts_open", F.coalesce("starts_open", F.raise_error(
        F.lit("the files were split anew while they were read")).cast("boolean")))
    return _cut(checked, quote, whole=True).drop("_whole"), crossing


def parse_records(records: DataFrame, schema: T.StructType, options: dict) -> DataFrame:
    """Texts of records -> the columns of ``schema`` beside the place; a header and empty
    records are left out."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    text = F.regexp_replace("_text", "\r$", "")
    x = records.withColumn("_text", text).where(F.col("_text") != "")
    if options.get("header") == "true":
        x = x.where(~((F.col("_block") == 0) & (F.col("_at") == 0)))
    parser = {k: v for k, v in options.items() if k != "header"}
    return x.select("_file", "_block", "_at", F.from_csv("_text", ddl, parser).alias("_r")).select(
        "_file", "_block", "_at", *[F.col("_r")[f.name].alias(f.name) for f in schema.fields])
