"""Answer scoring: exact match and ROUGE-1 / ROUGE-L F values.

A row needs nothing but its own two texts, so scoring is one narrow pass: tokens are cut in the
JVM and an Arrow UDF counts stems, overlap and LCS; keys may repeat or be NULL, and no row
moves. With a kept dictionary of stems (``stems``, a path) scoring is relational: only words
that the dictionary lacks are stemmed, and added to it, by later runs as by later
micro-batches. There the rows are written once with their tokens, the tokens are exploded,
joined with the dictionary and regrouped per row, the row riding on its first token. Rows are
numbered as they are read from the written table, so a task that runs again numbers them alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rouge import pair_counts_udf, pair_scores_udf, rouge_stats_udf, rouge_tokens, stem_word
from ..session import measured, ship_package
from ..sources import results as RS
from .records import to_eval_records

KEPT_FOLDERS = 16     # additions to a kept dictionary before they are put into one folder


def scoring_tokens(df: DataFrame, ref_col: str, gen_col: str) -> DataFrame:
    return df.withColumn("_gen_t", rouge_tokens(gen_col)).withColumn("_gold_t", rouge_tokens(ref_col))


def _stemmed(words: DataFrame) -> DataFrame:
    ship_package(words.sparkSession)
    return words.withColumn("stem", stem_word("word"))


def stem_vocab(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Distinct words of a token column and their stems, each word stemmed once."""
    return _stemmed(df.select(F.explode(tokens).alias("word")).distinct())


def kept_stems(df: DataFrame, tokens: str, path: str) -> tuple[DataFrame, int]:
    """The dictionary (word, stem, id) at ``path`` with the words of ``df`` added, and the number
    of words stemmed for it. Words that it holds are left out by an anti-join."""
    spark = df.sparkSession
    words = df.select(F.explode(tokens).alias("word")).distinct()
    if RS.version(spark, path) >= 0:
        words = words.join(RS.read_results(spark, path).select("word"), "word", "left_anti")
    added = RS.write_batch(_stemmed(words).withColumn("id", F.xxhash64("stem")), path, uuid.uuid4().hex, keep_empty=False)
    if RS.folder_count(spark, path) > KEPT_FOLDERS:
        RS.compact(spark, path)
    return RS.read_results(spark, path), added


def rouge_counts(df: DataFrame, gen_tokens: str, gold_tokens: str, stems: str) -> DataFrame:
    """df with ``overlap`` (clipped unigrams), ``n_gen``, ``n_gold``, the row's distinct ``ids``
    and the places of each in both texts (``gen_places``, ``gold_places``). An id stands for one
    stem of the dictionary kept at ``stems``; NULL token arrays count as empty."""
    none = F.array().cast("array<string>")
    x = measured(df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in (gen_tokens, gold_tokens)]).alias("_row"),
                           F.coalesce(gen_tokens, none).alias("_g"), F.coalesce(gold_tokens, none).alias("_r")), "rouge-rows")
    both = F.concat(F.transform("_g", lambda t, i: F.struct(F.lit(0).alias("side"), i.alias("pos"), t.alias("word"))),
                    F.transform("_r", lambda t, i: F.struct(F.lit(1).alias("side"), i.alias("pos"), t.alias("word"))))
    e = x.select(F.monotonically_increasing_id().alias("_uid"), F.struct("_row", "_g", "_r").alias("_row"), both.alias("_both"))
    e = e.select("_uid", "_row", F.posexplode_outer("_both").alias("_k", "_t"))
    first = F.coalesce(F.col("_k"), F.lit(0)) == 0
    e = e.select("_uid", F.when(first, F.col("_row")).alias("_row"), "_t.side", "_t.pos", "_t.word")
    ids = kept_stems(x.select(F.concat("_g", "_r").alias("t")), "t", stems)[0]
    e = e.join(ids.select("word", "id"), "word", "left")
    # One exchange for both aggregations below.
    e = e.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), "_uid")
    gen, gold = F.col("side") == 0, F.col("side") == 1
    place = [F.collect_list(F.when(c, F.col("pos"))).alias(n) for c, n in ((gen, "_gp"), (gold, "_rp"))]
    per_id = e.groupBy("_uid", "id").agg(F.count(F.when(gen, 1)).alias("_cg"), F.count(F.when(gold, 1)).alias("_cr"),
                                         F.first("_row", ignorenulls=True).alias("_row"), *place)
    lists = F.collect_list(F.when(F.col("id").isNotNull(), F.struct(
        F.col("id").alias("ids"), F.col("_gp").alias("gen_places"), F.col("_rp").alias("gold_places")))).alias("_l")
    per_row = per_id.groupBy("_uid").agg(
        F.sum(F.least("_cg", "_cr")).cast("int").alias("overlap"), F.sum("_cg").cast("int").alias("n_gen"),
        F.sum("_cr").cast("int").alias("n_gold"), F.first("_row", ignorenulls=True).alias("_row"), lists)
    lists = [F.col("_l")[c].alias(c) for c in ("ids", "gen_places", "gold_places")]
    back = {gen_tokens: F.col("_row._g"), gold_tokens: F.col("_row._r")}
    return per_row.select(*[back.get(c, F.col(f"_row._row.`{c}`")).alias(c) for c in df.columns], "overlap", "n_gen", "n_gold", *lists)


def _joined(tokens) -> F.Column:
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def rouge1_counts(df: DataFrame, gen_tokens: str, gold_tokens: str, key: str = "row_id", stem: bool = False) -> DataFrame:
    """``(key, overlap, n_gen, n_gold)``: clipped unigram overlap of two token arrays."""
    ship_package(df.sparkSession)
    x = df.select(key, pair_counts_udf(stem, False)(_joined(gen_tokens), _joined(gold_tokens)).alias("_c"))
    return x.select(key, "_c.overlap", "_c.n_gen", "_c.n_gold")


def rougeL_counts(df: DataFrame, gen_tokens: str, gold_tokens: str, key: str = "row_id", stem: bool = True) -> DataFrame:
    """``(key, lcs, n_gen, n_gold)``."""
    ship_package(df.sparkSession)
    x = df.select(key, pair_counts_udf(stem, True)(_joined(gen_tokens), _joined(gold_tokens)).alias("_c"))
    return x.select(key, "_c.lcs", "_c.n_gen", "_c.n_gold")


def rouge1_score(df: DataFrame, ref_col: str = "gold_answer", gen_col: str = "gen_answer", stem: bool = True) -> DataFrame:
    """Adds ``rouge1_f1`` alone."""
    ship_package(df.sparkSession)
    score = pair_scores_udf(stemmed=stem, with_lcs=False)(_joined(rouge_tokens(gen_col)), _joined(rouge_tokens(ref_col)))
    return df.withColumn("rouge1_f1", score["rouge1_f1"])


def rouge_score(df: DataFrame, ref_col: str = "gold_answer", gen_col: str = "gen_answer",
                w_r1: float = 0.5, w_rl: float = 0.5, stem: bool = True, stems: str | None = None) -> DataFrame:
    """Adds ``rouge1_f1``, ``rougeL_f1`` and ``score = w_r1*R1 + w_rl*RL`` (from the
    unrounded F values), all rounded to 4 places. The reference text is the target, the
    generated text the prediction. A row without reference text (NULL) has NULL values.
    ``stems`` names a kept dictionary, for stemmed scores only."""
    ship_package(df.sparkSession)
    if stems and stem:
        x = rouge_counts(scoring_tokens(df, ref_col, gen_col), "_gen_t", "_gold_t", stems)
        x = x.withColumn("_rs", rouge_stats_udf(w_r1, w_rl)("ids", "gen_places", "gold_places", "overlap"))
    else:
        x = df.withColumn("_rs", pair_scores_udf(w_r1, w_rl, stem)(_joined(rouge_tokens(gen_col)), _joined(rouge_tokens(ref_col))))
    known = F.col(ref_col).isNotNull()
    return x.select(*[F.col(f"`{c}`") for c in df.columns],
                    *[F.when(known, F.col("_rs")[c]).alias(c) for c in ("rouge1_f1", "rougeL_f1", "score")])


def score_answers(df: DataFrame, answer: str = "gen_answer", gold: str = "output", id_col: str = "ID",
                  stem: bool = True, stems: str | None = None) -> DataFrame:
    """Evaluation records end to end: exact match plus ROUGE (a NULL gold answer scores
    NULL, it is not turned into the text 'nan')."""
    return rouge_score(to_eval_records(df, answer, gold, id_col), stem=stem, stems=stems)
