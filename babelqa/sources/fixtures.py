"""Views over the driver's tables that stand in for the toolkit's inputs.

Each view exists twice: as a DataFrame function (what the library runs) and as a
DuckDB SQL fragment (what the oracle runs), so both engines see the same rows.
``VIEW_SQL`` fragments are meant for ``WITH name AS (...)`` clauses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..constants import WORD_PATTERN

# FIXED VALUES: the fixture's subset code for ``conv_id % 8`` (and ``seq_id % 8``), in order.
SUBSET_CODES = ["Aka_Gha", "Amh_Eth", "Eng_Eth", "Eng_Gha", "Eng_Ken", "Eng_Uga", "Lug_Uga", "Swa_Ken"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _subset_of(key) -> F.Column:
    codes = F.array(*[F.lit(c) for c in SUBSET_CODES])
    return F.element_at(codes, (F.pmod(key, F.lit(8)) + 1).cast("int"))


def qa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns answered by the next assistant turn: (row_id, ID, subset, input, output)."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    paired = conv.select(
        "conv_id", "turn", "role", "text",
        F.lead("role").over(w).alias("next_role"),
        F.lead("text").over(w).alias("next_text"),
    ).where((F.col("role") == "user") & (F.col("next_role") == "assistant"))
    rid = F.col("conv_id") * 100 + F.col("turn")
    return paired.select(
        rid.alias("row_id"), rid.alias("ID"), _subset_of(F.col("conv_id")).alias("subset"),
        F.col("text").alias("input"), F.col("next_text").alias("output"),
    )


def gen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``qa`` plus a synthetic model answer of seven kinds (see FIXTURES.md)."""
    q = qa(spark, sf_dir)
    k = F.pmod(F.col("row_id"), F.lit(7))
    out, inp = F.col("output"), F.col("input")
    raw = (F.when(k == 0, F.concat(F.lit("  "), F.lower(out), F.lit(" ")))
           .when(k == 1, F.array_join(F.reverse(F.split(out, " ")), " "))
           .when(k == 2, F.concat(F.lit("<think>"), inp, F.lit("</think> "), out))
           .when(k == 3, F.lit("   "))
           .when(k == 4, F.concat(out, F.lit(" "), out))
           .when(k == 5, F.concat(inp, F.lit(" "), out))
           .otherwise(F.reverse(out)))
    return q.select("row_id", "ID", "subset", "input", "output", raw.alias("raw_answer"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("row_id"), "lang",
                    F.concat(F.col("lang"), F.lit("_"), F.col("source")).alias("subset"), "text")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer tasks than cores (a few large row groups) dealt out evenly; a
    scan that already has them stays as it is, without a shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def docs_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``docs`` hash-partitioned by ``row_id`` (the key every per-document operator
    groups by), with the number of partitions Spark's own shuffles use."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    return docs(spark, sf_dir).repartition(n, "row_id")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitespace tokens of ``docs.text`` with their 0-based position."""
    d = docs(spark, sf_dir)
    return d.select("row_id", F.posexplode(F.regexp_extract_all("text", F.lit(WORD_PATTERN), 0))
                    .alias("pos", "token"))


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages per conversation ordered by turn (one conversation is one small group)."""
    conv = table(spark, sf_dir, "conversations")
    return (conv.groupBy("conv_id")
            .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
            .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"),
                                                                    x["text"].alias("content")))
                    .alias("messages")))


def tok_pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token positions of short sequences: label, masked first two positions, argmax
    prediction modulo 10."""
    e = table(spark, sf_dir, "embeddings")
    seq = F.floor(F.col("vec_id") / F.lit(8.0)).cast("long")
    base = e.select(seq.alias("seq_id"), F.pmod(F.col("vec_id"), F.lit(8)).alias("pos"), "label", "embedding")
    pred = F.pmod(F.array_position("embedding", F.array_max("embedding")) - 1, F.lit(10))
    return base.select(
        "seq_id", F.col("seq_id").alias("step"), _subset_of(F.col("seq_id")).alias("subset"), "pos",
        F.when(F.col("pos") < 2, F.lit(K.IGNORE_INDEX)).otherwise(F.col("label")).alias("label_id"),
        pred.alias("pred_id"),
    )


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.COUNTRY_NAMES.items()), "code string, name string")


def max_lens(spark: SparkSession, preset: dict | None = None) -> DataFrame:
    preset = K.MAX_NEW_TOKENS_BY_SUBSET if preset is None else preset
    return spark.createDataFrame(list(preset.items()), "subset string, max_new_tokens int")


# ----------------------------------------------------------------- DuckDB side --

def _subset_case(key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(SUBSET_CODES[:-1]))
    return f"CASE {key} % 8 {arms} ELSE '{SUBSET_CODES[-1]}' END"


def _duck_regex(p: str) -> str:
    return p.replace("'", "''")


VIEW_SQL = {
    "qa": f"""
SELECT conv_id * 100 + turn AS row_id, conv_id * 100 + turn AS ID,
  {_subset_case('conv_id')} AS subset, text AS input, next_text AS output
FROM (SELECT conv_id, turn, role, text,
        lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
        lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text
      FROM conversations) t
WHERE role = 'user' AND next_role = 'assistant'""",
    "gen": """
SELECT row_id, ID, subset, input, output,
  CASE row_id % 7
    WHEN 0 THEN concat('  ', lower(output), ' ')
    WHEN 1 THEN array_to_string(list_reverse(string_split(output, ' ')), ' ')
    WHEN 2 THEN concat('<think>', input, '</think> ', output)
    WHEN 3 THEN '   '
    WHEN 4 THEN concat(output, ' ', output)
    WHEN 5 THEN concat(input, ' ', output)
    ELSE reverse(output) END AS raw_answer
FROM qa""",
    "docs": """
SELECT doc_id AS row_id, lang, concat(lang, '_', source) AS subset, text FROM documents""",
    "tokens": f"""
SELECT row_id, unnest(generate_series(0, len(toks) - 1)) AS pos, unnest(toks) AS token
FROM (SELECT row_id, regexp_extract_all(text, '{_duck_regex(WORD_PATTERN)}') AS toks FROM docs) d""",
    "chat": """
SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS messages
FROM conversations GROUP BY conv_id""",
    "tok_pred": f"""
SELECT seq_id, seq_id AS step, {_subset_case('seq_id')} AS subset, pos,
  CASE WHEN pos < 2 THEN -100 ELSE label END AS label_id,
  (list_position(embedding, list_max(embedding)) - 1) % 10 AS pred_id
FROM (SELECT CAST(floor(vec_id / 8.0) AS BIGINT) AS seq_id, vec_id % 8 AS pos, label, embedding
      FROM embeddings) t""",
    "countries": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', '{v}')" for k, v in K.COUNTRY_NAMES.items()) + ") t(code, name)",
    "max_lens": "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', {v})" for k, v in K.MAX_NEW_TOKENS_BY_SUBSET.items()) + ") t(subset, max_new_tokens)",
}

# Which views each view reads, so a query only pulls the fragments it needs.
VIEW_DEPS = {"gen": ["qa"], "tokens": ["docs"]}


def with_views(sql: str, *names: str, extra=()) -> str:
    """Prefix ``sql`` with ``WITH`` clauses for the named views and their inputs, then
    the ``extra`` ``(name, sql)`` clauses in order."""
    order: list[str] = []

    def add(n):
        for d in VIEW_DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [(n, VIEW_SQL[n]) for n in order] + list(extra)
    if not parts:
        return sql
    ctes = ",\n".join(f"{n} AS ({body}\n)" for n, body in parts)
    return f"WITH {ctes}\n{sql}"
