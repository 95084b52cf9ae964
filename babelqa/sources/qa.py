"""QA table readers.

The QA file has a header row, quoted multi-line text and doubled quotes inside quoted
fields. The schema is declared, never inferred (inference is an extra pass over the data
and guesses types per file).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranking import in_file_order, numbered_in_splits, split_counts, split_offsets
from ..session import measured
from .csv_split import csv_records, parse_records

PLACE = ("_file", "_block", "_at")

QA_SCHEMA = T.StructType([
    T.StructField("ID", T.StringType()),
    T.StructField("subset", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
])

# Options that make Spark's CSV reader and writer agree with the usual QA files: quoted
# multi-line fields, "" inside quotes, and text kept byte for byte (no trimming).
CSV_OPTIONS = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _cleaned(df: DataFrame, na_values, drop_null_subset: bool) -> DataFrame:
    """Markers to NULL in every string column; rows without a subset go."""
    if na_values:
        marks = list(na_values)
        df = df.select(*[F.when(F.col(f.name).isin(marks), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
                         if isinstance(f.dataType, T.StringType) and f.name not in PLACE else F.col(f.name)
                         for f in df.schema.fields])
    if drop_null_subset and "subset" in df.columns:
        df = df.na.drop(subset=["subset"])
    return df


def read_qa(spark: SparkSession, path, fmt: str = "csv", schema: T.StructType | None = None,
            na_values=(), drop_null_subset: bool = True, multi_line: bool = True, split: bool = False) -> DataFrame:
    """Read a QA table. ``na_values`` lists markers turned into NULL in every string
    column (Spark already reads an empty field as NULL). Rows with a NULL ``subset`` are
    dropped when the column exists and ``drop_null_subset`` is set. Line breaks inside quotes
    keep Spark from splitting a CSV file, so each file is one task; ``split=True`` finds the
    records of a large file by the parity of its quote marks and reads it by many tasks
    (``csv_split``), and ``multi_line=False`` does where no text holds a line break."""
    if split:
        if fmt != "csv":
            raise ValueError("split=True is for CSV files")
        records = [parse_records(r, schema or QA_SCHEMA, CSV_OPTIONS) for r in csv_records(spark, path)]
        return _cleaned(records[0].unionByName(records[1]).drop(*PLACE), na_values, drop_null_subset)
    if fmt == "csv":
        reader = spark.read.options(**CSV_OPTIONS).option("multiLine", multi_line)
        df = reader.schema(schema or QA_SCHEMA).csv(path)
    elif fmt == "json":
        df = spark.read.schema(schema or QA_SCHEMA).json(path)
    else:
        df = spark.read.format(fmt).load(path)
        if schema is not None:
            df = df.select(*[F.col(f.name).cast(f.dataType) for f in schema.fields])
    return _cleaned(df, na_values, drop_null_subset)


def read_qa_indexed(spark: SparkSession, path, split: bool = False, **options) -> DataFrame:
    """``read_qa`` plus ``row_id``: 0, 1, 2, ... in the order of the files (by path) and of the
    rows in each of them, after rows without a subset are gone. ``ID`` is filled from it where
    the files have none. Rows are counted per file split and shifted by the rows of the splits
    before; none is shuffled or sorted."""
    if split:
        x = _split_indexed(spark, path, options.pop("schema", None) or QA_SCHEMA, **options)
    else:
        x = in_file_order(read_qa(spark, path, **options))
    if "ID" in x.columns:
        return x.withColumn("ID", F.coalesce(F.col("ID"), F.col("row_id").cast(x.schema["ID"].dataType)))
    return x.withColumn("ID", F.col("row_id"))


def _split_indexed(spark: SparkSession, path, schema, na_values=(), drop_null_subset: bool = True) -> DataFrame:
    """Records inside a split are numbered as they come; the one that crosses its end is the
    last that starts in it."""
    inside, crossing = (_cleaned(parse_records(r, schema, CSV_OPTIONS), na_values, drop_null_subset)
                        for r in csv_records(spark, path))
    placed = inside.drop("_at").withColumn("_mid", F.monotonically_increasing_id())
    last = crossing.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_last"))
    counts = split_counts(placed).withColumnRenamed("n", "_inside").join(last, ["_file", "_block"], "full")
    counts = counts.fillna(0, ["_inside", "_last"]).withColumn("n", F.col("_inside") + F.col("_last"))
    offsets = measured(split_offsets(counts), "splits")
    numbered = numbered_in_splits(placed, offsets.withColumn("n", F.col("_inside")), "row_id")
    edge = crossing.join(offsets.select("_file", "_block", "_inside", "_before"), ["_file", "_block"])
    edge = edge.withColumn("row_id", F.col("_before") + F.col("_inside"))
    return numbered.unionByName(edge.select(*numbered.columns))


def merge_parts(spark: SparkSession, paths, fmt: str = "csv", schema: T.StructType | None = None) -> DataFrame:
    """One read over all part files; each row keeps the file it came from."""
    if fmt == "csv":
        reader = spark.read.options(**CSV_OPTIONS)
        if schema is not None:
            reader = reader.schema(schema)
        df = reader.csv(list(paths))
    else:
        df = spark.read.format(fmt).load(list(paths))
    return df.withColumn("part_file", F.input_file_name())


def part_report(merged: DataFrame, part_of=None) -> DataFrame:
    """Rows per part and the total (``part`` NULL)."""
    key = part_of if part_of is not None else F.col("part_file")
    return merged.withColumn("part", key).rollup("part").agg(F.count(F.lit(1)).alias("rows"))
