"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept, as a table it reads from the shared folder,
and gives the columns of documents; the last gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from babelqa.llm.common import read_table, written
from babelqa.llm.decontaminate import without_contamination
from babelqa.llm.language_id import keep_identified
from babelqa.llm.near_dedup import keep_one_of_each
from babelqa.llm.packing import pack_documents
from babelqa.llm.queries import public_tokenizer
from babelqa.llm.suffix_dedup import keep_after_repeats


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told go; lang becomes the predicted one."""
    return keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near-duplicates (five-word shingles, 0.8)."""
    return keep_one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that start twice are cut out; a document of which
    nothing but white space is left goes."""
    return keep_after_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return without_contamination(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizer("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup),
          ("decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
# Language ID is a learned model and packing a heuristic over tokenizer ids: no SQL form.
ORACLE_SQL = None
ORACLE: dict[str, str] = {}
