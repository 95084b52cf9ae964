"""Evaluation: prompts per model family, decoding parameters, and the runs over an answer
table (evaluation, test and validation mode)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.params import dropped_params, filter_params, parse_params
from ..functions.prompts import append_marker, cut_after_marker, drop_role, question_messages, render_chat
from ..functions.text import py_strip
from ..operators.lookups import align_answers, merge_params, params_map
from ..operators.metrics import eval_summary, gen_metrics
from ..operators.records import (clean_generation, require_columns, to_submission, with_country_name, with_id,
                                 with_subset_parts)
from ..operators.sampling import stratified_sample, uniform_sample
from ..operators.scoring import rouge_score, score_answers
from ..session import measured


def eval_prompts(df: DataFrame, countries: DataFrame, family: str, marker: str = K.ANSWER_MARKER) -> DataFrame:
    """``prompt`` per row. The aya family gets no marker turn: the assistant's messages are
    dropped and an assistant turn is opened. Any other model gets the marker as assistant
    turn, and the rendered chat is cut behind it."""
    x = with_country_name(with_subset_parts(df, strict=True), countries)
    if family == "aya":
        msgs = drop_role(question_messages("input", "lang", "country_name", None), "assistant")
        prompt = render_chat(msgs, generation=True)
    else:
        prompt = cut_after_marker(render_chat(question_messages("input", "lang", "country_name", marker)), marker)
    return x.withColumn("prompt", prompt).select(*df.columns, "prompt")


def eval_params(df: DataFrame, file_params: str, accepted, max_new_tokens: int | None = None) -> DataFrame:
    """Adds ``params`` (the default parameters, those of the JSON column ``file_params`` over
    them, then ``max_new_tokens``, restricted to the ``accepted`` keys) and ``dropped``, the
    keys that were left out, for the report."""
    merged = merge_params(params_map(K.GENERATION_PARAMS), parse_params(file_params))
    if max_new_tokens is not None:
        merged = merge_params(merged, params_map({"max_new_tokens": max_new_tokens}))
    x = df.withColumn("_merged", merged)
    return x.withColumn("params", filter_params("_merged", accepted)) \
        .withColumn("dropped", dropped_params("_merged", accepted)).drop("_merged")


def _answered(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Rows with their raw answer, written once: scoring, summaries and files read that table."""
    given = align_answers(df, answers.select("row_id", F.col("answer").alias("raw_answer")))
    return measured(given, "answered")


def eval_run(df: DataFrame, answers: DataFrame, sample_size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(evaluation records, summary) of questions with gold answers and an answer table
    ``(row_id, answer)``; a sample takes the answers of its rows alone. The scored records are
    written once, and summarised from there."""
    require_columns(df, ["row_id", "subset", "input", "output"])
    if sample_size:
        df = measured(stratified_sample(df, sample_size).drop("lang"), "sample")
        answers = answers.join(df.select("row_id"), "row_id", "left_semi")
    records = measured(score_answers(clean_generation(_answered(with_id(df), answers))), "records")
    return records, eval_summary(records)


def eval_run_test(df: DataFrame, answers: DataFrame) -> DataFrame:
    """Test mode (no gold answers): ID and the three target columns, cleaned as in evaluation."""
    require_columns(df, ["row_id", "subset", "input"])
    return to_submission(clean_generation(_answered(with_id(df), answers)))


def validation_prompts(df: DataFrame, countries: DataFrame, step: int, n: int, marker: str = K.ANSWER_MARKER) -> DataFrame:
    """A uniform sample drawn by the training step, with the prompts of the validation loop:
    lenient subset, country name, opened assistant turn with the marker."""
    x = with_country_name(with_subset_parts(uniform_sample(df, n, seed=step)), countries)
    msgs = question_messages("input", "lang", "country_name", None)
    return x.withColumn("prompt", append_marker(render_chat(msgs, generation=True), marker)).select(*df.columns, "prompt")


def validation_run(df: DataFrame, answers: DataFrame, step: int, n: int, prefix: str = "eval") -> DataFrame:
    """Generation metrics of the step's sample: answers stripped, scored, averaged overall
    and per language."""
    rows = measured(uniform_sample(df, n, seed=step), "sample")
    given = _answered(rows, answers.join(rows.select("row_id"), "row_id", "left_semi"))
    given = given.withColumn("gen_answer", py_strip("raw_answer")).withColumn("gold_answer", py_strip("output"))
    scored = rouge_score(given, "gold_answer", "gen_answer")
    exact = F.when(F.col("output").isNotNull(), (F.lower("gen_answer") == F.lower("gold_answer")).cast("int"))
    return gen_metrics(scored.select("subset", exact.alias("exact_match"), F.col("rouge1_f1").alias("rouge1"),
                                     F.col("rougeL_f1").alias("rougeL"), "score"), prefix=prefix)
