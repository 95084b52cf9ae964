"""Training-table build: QA rows -> chat messages -> token ids -> label masks -> batch
plan -> padded micro-batches, written as Parquet for a trainer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.arrays import mask_before, response_start
from ..functions.locale import lang_of
from ..functions.prompts import render_chat
from ..operators.batching import batch_plan, pad_batches
from ..operators.records import build_sft
from ..operators.vocab import build_vocab, chat_tokens, encode_tokens
from ..session import measured


def training_examples(df: DataFrame, countries: DataFrame, marker: str = K.ANSWER_MARKER) -> DataFrame:
    """(row_id, subset, lang, ids, labels): the final assistant turn is the only part
    that is learned.

    Rendering and tokenising run once: the tokens are written, the vocabulary counts them,
    and encoding carries the row's columns along instead of joining them back. The encoded
    examples are written too, since the batch plan and the padding both read them."""
    sft = build_sft(df, "train", countries, marker, keep=("row_id", "subset"))
    x = sft.select("row_id", "subset", lang_of("subset").alias("lang"),
                   chat_tokens(render_chat("messages")).alias("toks"),
                   F.size(chat_tokens(render_chat(F.slice("messages", 1, F.size("messages") - 1)))).alias("plen"))
    x = measured(x.withColumn("start", response_start("toks", F.col("plen"), [K.RESPONSE_START])).drop("plen"), "chats")
    enc = encode_tokens(x, build_vocab(x, "toks"), "toks", key="row_id", carry=("subset", "lang", "start"))
    return measured(enc.select("row_id", "subset", "lang", "ids", mask_before("ids", F.col("start")).alias("labels")),
                    "examples")


def training_batches(examples: DataFrame, micro: int, accum: int, max_len: int = K.DEFAULT_MAX_SEQ_LEN,
                     pad_id: int = 0, alpha: float = K.DEFAULT_ALPHA, seed: int = K.DEFAULT_SAMPLE_SEED) -> DataFrame:
    """Padded micro-batches of the stratified plan, which reads only (row_id, lang). A row of
    a small pool is drawn in many batches; that hot join key is split by AQE's skew-join
    handling. An example longer than ``max_len`` is an error, never cut."""
    plan = batch_plan(examples.select("row_id", "lang"), micro, accum, alpha, seed)
    rows = plan.join(examples.drop("lang"), "row_id")
    return pad_batches(rows, "ids", "labels", batch="micro_batch", max_len=max_len, pad_id=pad_id, side="right")
