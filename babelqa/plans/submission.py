"""Submission run: per-subset decoding params -> chat prompt -> answers -> echo removal ->
repetition cleanup -> submission projection.

One pass over all rows: partitions replace the per-GPU processes, the per-subset loop
becomes a join with the length table, and the output committer replaces part files plus
a merge step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import constants as K
from ..functions.prompts import DEFAULT_TEMPLATE, ChatTemplate, render_chat
from ..functions.text import strip_echo
from ..operators.lookups import align_answers, decode_params
from ..operators.records import build_sft, to_submission
from ..operators.repetition import clean_repetition
from ..session import measured


def submission_prompts(df: DataFrame, countries: DataFrame, max_lens: DataFrame,
                       template: ChatTemplate = DEFAULT_TEMPLATE, marker: str | None = K.ANSWER_MARKER) -> DataFrame:
    """Rows with ``params`` (file params + the subset's max_new_tokens) and the rendered
    ``prompt`` (test-mode messages, assistant turn opened when the last turn is user)."""
    x = decode_params(df, max_lens)
    msgs = build_sft(x, "test", countries, marker, keep=tuple(c for c in x.columns))
    return msgs.withColumn("prompt", render_chat("messages", template, generation=True)).drop("messages")


def submission_run(df: DataFrame, answers: DataFrame, min_n: int = K.DEFAULT_MIN_N, max_n: int = K.DEFAULT_MAX_N,
                   max_passes: int = K.DEFAULT_MAX_PASSES) -> DataFrame:
    """Questions and their answer table ``(row_id, answer)`` -> submission. The answers come
    from ``submission_prompts`` through ``inference.batch_infer``, or from any other source;
    they are written once before they are cleaned."""
    given = align_answers(df, measured(answers.select("row_id", "answer"), "answers"))
    given = given.withColumn("_echo_free", strip_echo("answer", "input"))
    cleaned = clean_repetition(given, "_echo_free", "row_id", min_n, max_n, max_passes, out="gen_answer")
    return to_submission(cleaned)
