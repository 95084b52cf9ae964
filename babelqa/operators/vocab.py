"""Vocabulary jobs standing in for a model tokenizer.

A model tokenizer is a codec library, not data work; what remains is: split text into
tokens, build a frequency-ranked vocabulary, encode tokens to ids and decode ids back.
Most occurrences are of few tokens, so a bounded head of the vocabulary goes with the tasks,
which look it up in Arrow arrays; the occurrences of all other tokens, never hot, are joined
with the vocabulary by a shuffle and put back into their row (one row is a bounded group).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import PY_WHITESPACE, regex_class
from ..session import measured, ship_package

# FIXED VALUES: special tokens of the chat template are single tokens.
SPECIAL_TOKEN_PATTERN = r"<\|[A-Za-z_]+\|>|<BOS_TOKEN>"
# A chat token: a special token, else a run of non-whitespace without '<', else '<'.
CHAT_TOKEN_PATTERN = SPECIAL_TOKEN_PATTERN + "|" + regex_class(PY_WHITESPACE + "<", negate=True) + "+|<"


def chat_tokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(c, F.lit(CHAT_TOKEN_PATTERN), 0)


PREFIX = 3      # leading characters that split the tokens of one count
HEAD = 1 << 18  # ids below this, the most frequent tokens, go with the tasks
HEAD_CHARS = 64     # unless their token is longer


def _lists(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _positions(lengths: np.ndarray) -> np.ndarray:
    """The place of every flattened value in its list."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _of_rows(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """How many flattened values each list has where ``flat`` is true."""
    return np.diff(np.concatenate([[0], np.cumsum(flat)])[np.concatenate([[0], np.cumsum(lengths)])])


def split_words(text) -> Column:
    """``functions.text.words`` for a pass that goes on in Python: Arrow splits at the same characters."""
    @F.arrow_udf("array<string>")
    def split(texts: pa.Array) -> pa.Array:
        lists = pc.utf8_split_whitespace(texts)
        words, lengths = lists.flatten().cast(pa.string()), _lengths(lists)
        full = pc.not_equal(words, "")
        kept = _of_rows(full.to_numpy(zero_copy_only=False), lengths)
        out = _lists(words.filter(full), kept)
        return pa.ListArray.from_arrays(out.offsets, out.values, mask=texts.is_null()) if texts.null_count else out

    return split(text)


def count_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, cnt)``: a task counts the tokens of each of its batches before they are dealt out."""
    ship_package(df.sparkSession)

    def count(batches):
        for b in batches:
            c = pc.value_counts(b.column(0).flatten())
            yield pa.record_batch([c.field("values").cast(pa.string()), c.field("counts")], names=["token", "n"])

    return df.select(tokens).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("cnt"))


def build_vocab(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, cnt, id)``: ids by descending count, then token (binary order). The table is
    written, so that joins with it are planned by its real size.

    The counts are written once. A token's id is the tokens of higher counts, plus those of its
    count with a smaller prefix, plus its place among the rest, so no window is wider than the
    tokens that share a count and their first characters (half of all words occur once)."""
    counts = measured(count_tokens(df, tokens), "word-counts")
    counts = counts.withColumn("_p", F.coalesce(F.substring("token", 1, PREFIX), F.lit("")))
    groups = counts.groupBy("cnt", "_p").agg(F.count(F.lit(1)).alias("n"))
    of_count = groups.groupBy("cnt").agg(F.sum("n").alias("n"))
    above = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)     # one row per distinct count
    of_count = of_count.select("cnt", F.coalesce(F.sum("n").over(above), F.lit(0)).alias("_above"))
    smaller = Window.partitionBy("cnt").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("cnt", "_p", F.coalesce(F.sum("n").over(smaller), F.lit(0)).alias("_smaller"))
    starts = measured(groups.join(of_count, "cnt").select("cnt", "_p", (F.col("_above") + F.col("_smaller")).alias("_start")), "word-offsets")
    place = F.row_number().over(Window.partitionBy("cnt", "_p").orderBy("token")) - 1
    x = counts.withColumn("_place", place).join(starts, ["cnt", "_p"])
    return measured(x.select("token", "cnt", (F.col("_start") + F.col("_place")).alias("id")), "vocab")


def _in_head() -> Column:
    return F.coalesce(F.col("id").between(0, HEAD - 1) & (F.length("token") <= HEAD_CHARS), F.lit(False))


def _head(vocab: DataFrame) -> tuple[pa.Array, pa.Array]:
    """The bounded head of the vocabulary: tokens and ids."""
    t = vocab.where(_in_head()).select("token", F.col("id").cast("long").alias("id")).toArrow()
    return (t["token"].cast(pa.string()).combine_chunks(), t["id"].combine_chunks())


def _regroup(whole: DataFrame, rest: DataFrame, key: str, value: str, carry) -> DataFrame:
    """One row per key: its ``_ids``, and ``_rest``, the looked-up (_pos, value) of the others.
    A key with more than one row in ``whole``, or none, is an error."""
    kinds = {f.name: f.dataType for f in [*whole.schema, *rest.schema]}
    none = lambda c: F.lit(None).cast(kinds[c]).alias(c)
    x = whole.select(key, *carry, "_ids", none("_pos"), none(value)).union(
        rest.select(key, *[none(c) for c in carry], none("_ids"), "_pos", value))
    rows = x.groupBy(key).agg(
        F.first("_ids", ignorenulls=True).alias("_ids"), F.sum(F.col("_ids").isNotNull().cast("int")).alias("_rows"),
        F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", value))).alias("_rest"),
        *[F.first(c, ignorenulls=True).alias(c) for c in carry])
    sound = F.col(key).isNotNull() & (F.col("_rows") == 1)
    checked = F.when(sound, F.col(key)).otherwise(F.raise_error(F.concat(
        F.lit(f"{key} is NULL or repeated: "), F.coalesce(F.col(key).cast("string"), F.lit("NULL"))))
        .cast(kinds[key]))
    return rows.select(checked.alias(key), *carry, "_ids", "_rest")


def _places(lengths: np.ndarray, rest: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where the values of ``rest`` belong among the flattened values of lists so long, and the values."""
    flat = rest.flatten()
    starts = np.repeat(np.cumsum(lengths) - lengths, _lengths(rest))
    return starts + flat.field(0).to_numpy(zero_copy_only=False), flat.field(1)


def encode_tokens(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", key: str = "row_id",
                  out: str = "ids", carry=()) -> DataFrame:
    """Token arrays -> id arrays (unknown tokens -> NULL), in token order.

    A task that has a row's tokens fills in the ids of the vocabulary's head; rows are written
    with the tokens that are left, which are joined with the rest of the vocabulary (whose
    tokens and ids are there once) and come back to their row by key. ``carry`` columns ride on
    the row. A NULL or repeated key is an error.
    """
    ship_package(df.sparkSession)
    known, known_ids = _head(vocab)

    @F.arrow_udf("ids array<int>, rest array<struct<_pos: int, token: string>>")
    def look_up(lists: pa.Array) -> pa.Array:
        words, lengths = lists.flatten().cast(pa.string()), _lengths(lists)
        ids = known_ids.take(pc.index_in(words, value_set=known)).cast(pa.int32())
        left = pc.and_(ids.is_null(), words.is_valid())
        pos = pa.array(_positions(lengths).astype(np.int32)).filter(left)
        rest = pa.StructArray.from_arrays([pos, words.filter(left)], names=["_pos", "token"])
        rests = _lists(rest, _of_rows(left.to_numpy(zero_copy_only=False), lengths))
        return pa.StructArray.from_arrays([_lists(ids, lengths), rests], names=["ids", "rest"])

    @F.arrow_udf("array<int>")
    def fill(lists: pa.Array, rest: pa.Array) -> pa.Array:
        lengths = _lengths(lists)
        places, found = _places(lengths, rest)
        ids = lists.flatten()
        values, gaps = ids.fill_null(0).to_numpy().copy(), ids.is_null().to_numpy(zero_copy_only=False).copy()
        values[places], gaps[places] = found.to_numpy(zero_copy_only=False), False
        return _lists(pa.array(values, pa.int32(), mask=gaps), lengths)

    x = measured(df.select(key, *carry, look_up(tokens).alias("_e")), "token-ids")
    left = x.select(key, F.explode("_e.rest").alias("_m")).select(key, "_m._pos", "_m.token")
    tail = vocab.where(~_in_head()).select("token", F.col("id").cast("int").alias("id")).where("id is not null")
    rows = _regroup(x.select(key, *carry, F.col("_e.ids").alias("_ids")),
                    left.join(tail, "token").select(key, "_pos", "id"), key, "id", carry)
    return rows.select(key, *carry, fill("_ids", "_rest").alias(out))


def decode_tokens(df: DataFrame, vocab: DataFrame, ids: str = "ids", key: str = "row_id",
                  skip_ids=(), sep: str = " ", out: str = "text") -> DataFrame:
    """Id arrays -> text; ``skip_ids`` (special tokens) are left out, an id that the
    vocabulary lacks is an error. As in ``encode_tokens``, only ids beyond the vocabulary's
    head are joined with it."""
    ship_package(df.sparkSession)
    known, known_ids = _head(vocab)
    skipped = pa.array(list(skip_ids), pa.int64())

    @F.arrow_udf("array<struct<_pos: int, id: bigint>>")
    def beyond(lists: pa.Array) -> pa.Array:
        values, lengths = lists.flatten(), _lengths(lists)
        left = pc.invert(pc.or_(pc.is_in(values, value_set=known_ids), pc.is_in(values, value_set=skipped)))
        pos = pa.array(_positions(lengths).astype(np.int32)).filter(left)
        rest = pa.StructArray.from_arrays([pos, values.filter(left)], names=["_pos", "id"])
        return _lists(rest, _of_rows(left.to_numpy(zero_copy_only=False), lengths))

    @F.arrow_udf("string")
    def join(lists: pa.Array, rest: pa.Array) -> pa.Array:
        lengths, values = _lengths(lists), lists.flatten()
        places, found = _places(lengths, rest)
        at = pc.index_in(values, value_set=known_ids).fill_null(0).to_numpy().copy()
        at[places] = len(known) + np.arange(len(found))
        kept = pc.invert(pc.is_in(values, value_set=skipped))
        words = pa.concat_arrays([known, found.cast(pa.string())]).take(pa.array(at).filter(kept))
        return pc.binary_join(_lists(words, _of_rows(kept.to_numpy(zero_copy_only=False), lengths)), sep)

    x = df.select(key, F.coalesce(F.col(ids).cast("array<bigint>"), F.array().cast("array<bigint>")).alias("_ids"))
    x = measured(x.withColumn("_left", beyond("_ids")), "token-rests")
    left = x.select(key, F.explode("_left").alias("_m")).select(key, "_m._pos", "_m.id")
    tail = vocab.where(~_in_head()).select("token", F.col("id").cast("long").alias("id"))
    token = F.coalesce("token", F.raise_error(F.concat(F.lit("id without a token: "), F.coalesce(
        F.col("id").cast("string"), F.lit("NULL")))).cast("string"))
    rows = _regroup(x.select(key, "_ids"), left.join(tail, "id", "left").select(key, "_pos", token.alias("token")), key, "token", ())
    return rows.select(key, join("_ids", "_rest").alias(out))
