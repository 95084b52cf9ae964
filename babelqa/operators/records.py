"""QA-table building blocks: column checks, subset parsing, SFT / preference / eval /
submission projections, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.locale import subset_parts_lenient, subset_parts_strict
from ..functions.prompts import answer_messages, message, question_messages
from ..functions.text import exact_match, strip_thinking, with_fallback
from .ranking import with_row_id


def require_columns(df: DataFrame, cols) -> DataFrame:
    """Fail before any job runs when a needed column is absent."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing required column(s): {missing}; have {df.columns}")
    return df


def with_subset_parts(df: DataFrame, strict: bool = False, subset: str = "subset",
                      lang: str = "lang", country: str = "country") -> DataFrame:
    lc = subset_parts_strict(subset) if strict else subset_parts_lenient(subset)
    return df.withColumn(lang, lc[0]).withColumn(country, lc[1])


def with_country_name(df: DataFrame, countries: DataFrame, code: str = "country",
                      out: str = "country_name") -> DataFrame:
    """Country code -> name through a left join on the fixed lookup table (4 rows, so a
    broadcast is bounded); unknown codes pass through unchanged."""
    lk = F.broadcast(countries.select(F.col("code").alias("_code"), F.col("name").alias("_name")))
    return (df.join(lk, df[code] == lk["_code"], "left")
            .withColumn(out, F.coalesce(F.col("_name"), F.col(code))).drop("_code", "_name"))


def build_sft(df: DataFrame, mode: str, countries: DataFrame, marker: str | None = K.ANSWER_MARKER,
              q_col: str = "input", a_col: str = "output", keep=("subset",)) -> DataFrame:
    """Rows -> chat messages (strict subset parse + country name).

    ``train``/``val``: [system, user, assistant = marker + ' ' + answer];
    ``test``: [system, user(, assistant = marker)]. Any other mode keeps the current
    behaviour, i.e. the question form. Only ``messages`` and ``keep`` columns remain.
    """
    require_columns(df, [q_col, "subset"] + ([a_col] if mode in ("train", "val") else []))
    x = with_subset_parts(df, strict=True)
    x = with_country_name(x, countries)
    if mode in ("train", "val"):
        msgs = answer_messages(q_col, a_col, "lang", "country_name", marker)
    else:
        msgs = question_messages(q_col, "lang", "country_name", marker)
    return x.select(msgs.alias("messages"), *keep)


def sft_pairs(df: DataFrame, mode: str, countries: DataFrame, marker: str | None = K.ANSWER_MARKER,
              q_col: str = "input", a_col: str = "output", keep=("row_id",)) -> DataFrame:
    """(messages, answer) example view; the answer is NULL in test mode."""
    sft = build_sft(df, mode, countries, marker, q_col, a_col, keep=tuple(keep) + (a_col,))
    ans = F.col(a_col) if mode in ("train", "val") else F.lit(None).cast("string")
    return sft.select(*keep, "messages", ans.alias("answer"))


def build_preferences(df: DataFrame, marker: str = K.ANSWER_MARKER, keep=()) -> DataFrame:
    """Evaluation records -> preference rows (prompt, chosen, rejected).

    prompt = question messages without a marker turn, from ``expected_lang`` /
    ``expected_country``; chosen / rejected = one assistant message holding
    ``marker + ' ' + gold_answer`` / ``gen_answer``.
    """
    require_columns(df, ["input", "expected_lang", "expected_country", "gold_answer", "gen_answer"])
    prompt = question_messages("input", "expected_lang", "expected_country", None)
    chosen = F.array(message("assistant", F.concat(F.lit(marker + " "), F.col("gold_answer"))))
    rejected = F.array(message("assistant", F.concat(F.lit(marker + " "), F.col("gen_answer"))))
    return df.select(*keep, prompt.alias("prompt"), chosen.alias("chosen"), rejected.alias("rejected"))


def clean_generation(df: DataFrame, raw: str = "raw_answer", question: str = "input",
                     out: str = "gen_answer") -> DataFrame:
    """Evaluation-side cleanup of a decoded answer: thinking blocks, echoed question,
    blank -> fallback sentence."""
    return df.withColumn(out, with_fallback(strip_thinking(raw, question)))


def to_eval_records(df: DataFrame, answer: str = "gen_answer", gold: str = "output",
                    id_col: str = "ID") -> DataFrame:
    """Evaluation record without ROUGE: ids, texts, parsed subset, exact match."""
    lang, country = subset_parts_lenient("subset")
    return df.select(
        F.col(id_col).alias("ID"), F.col("input"), F.col(gold).alias("gold_answer"),
        F.col(answer).alias("gen_answer"), lang.alias("expected_lang"), country.alias("expected_country"),
        exact_match(answer, gold).alias("exact_match"),
    )


def to_submission(df: DataFrame, answer: str = "gen_answer", id_col: str = "ID") -> DataFrame:
    """Submission projection: the answer copied to the three target columns."""
    return df.select(F.col(id_col).alias("ID"), *[F.col(answer).alias(t) for t in K.SUBMISSION_TARGETS])


def with_id(df: DataFrame, order_col: str = "row_id", out: str = "ID") -> DataFrame:
    """Keep ``ID`` when present, else the dense global row index."""
    if out in df.columns:
        return df
    return with_row_id(df, [order_col], out=out, key=order_col)


def shard(df: DataFrame, n: int, i: int | None = None, index_col: str = "row_index") -> DataFrame:
    """Round-robin shards on a dense row index: shard ``k`` holds rows ``k, k+n, ...``.

    With ``i`` the rows of shard ``i``; without it every row tagged with ``shard``.
    """
    tagged = df.withColumn("shard", F.pmod(F.col(index_col), F.lit(n)).cast("int"))
    return tagged if i is None else tagged.where(F.col("shard") == i)


def per_subset(df: DataFrame, lookup: DataFrame, key: str = "subset") -> DataFrame:
    """Rows restricted to the subsets listed in ``lookup`` - one semi-join instead of one
    scan per distinct subset (AQE broadcasts the lookup once it has measured it)."""
    return df.join(lookup.select(key), key, "left_semi")
