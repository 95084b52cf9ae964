"""Chat formatting with a grammar round trip, on Spark expressions only.

    conversation := turn*
    turn         := "### " role [flag] ": " body "</turn>" newline

A body may hold neither "### " nor "</turn>". ``parse`` is the deterministic reader of that
grammar. A turn is rendered as it is and reparsed; if the reader does not give back role and
text, the turn is escaped and carries the flag "!". The whole conversation is then rendered,
reparsed and compared with its source; should it still differ, every turn of it is escaped,
and if even that is not read back the query fails. Roles are always escaped.

Escapes are two characters that start with a backslash, so they are undone from left to
right without ambiguity, and escaped text holds no "<" and no "#".

The loss mask lists spans of the rendered turns (turn number, first code point, length): the
body of every assistant turn.

Defined results: null text and null role are empty; turns are ordered by (turn, role, text),
nulls first; repeated rows are turns of their own; rows without conv_id form one conversation;
an empty table gives none. A conversation is one row of the output, so it has to fit a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

HEAD, END, FLAG, SEP = "### ", "</turn>", "!", ": "
BODY_ESCAPES = {"<": "\\l", "#": "\\h"}
ROLE_ESCAPES = {**BODY_ESCAPES, ":": "\\c", "!": "\\b", "\n": "\\n"}


def escape(text: Column, escapes: dict[str, str]) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in escapes.items():
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    def codes(part: Column) -> Column:
        for plain, code in ROLE_ESCAPES.items():
            part = F.replace(part, F.lit(code), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), codes), "\\")


def render(role: Column, text: Column, escaped: Column) -> Column:
    """One turn."""
    body = F.when(escaped, escape(text, BODY_ESCAPES)).otherwise(text)
    return F.concat(F.lit(HEAD), escape(role, ROLE_ESCAPES), F.when(escaped, F.lit(FLAG)).otherwise(F.lit("")),
                    F.lit(SEP), body, F.lit(END + "\n"))


def pieces(formatted: Column) -> Column:
    """The turns of a formatted text, each without its end mark."""
    parts = F.split(formatted, END + "\n")
    return F.slice(parts, 1, F.size(parts) - 1)


def parse_piece(piece: Column) -> Column:
    """struct(role, text) of one turn without its end mark, or null if it breaks the grammar."""
    at = F.instr(piece, SEP)
    head = F.substr(piece, F.lit(len(HEAD) + 1), at - len(HEAD) - 1)
    flagged = head.endswith(FLAG)
    body = F.substr(piece, at + len(SEP))
    role = unescape(F.when(flagged, F.substr(head, F.lit(1), F.length(head) - 1)).otherwise(head))
    sound = piece.startswith(HEAD) & (at > len(HEAD)) & ~F.contains(body, F.lit(HEAD)) & ~F.contains(body, F.lit(END))
    return F.when(sound, F.struct(role.alias("role"), F.when(flagged, unescape(body)).otherwise(body).alias("text")))


def _recovered(formatted: Column) -> Column:
    return F.transform(pieces(formatted), parse_piece)


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> conv_id, formatted, loss: array of (turn, start, length)."""
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"),
                       F.coalesce("text", F.lit("")).alias("text"))
    alone = _recovered(render(F.col("role"), F.col("text"), F.lit(False)))
    source = F.array(F.struct("role", "text"))
    rows = rows.withColumn("escaped", ~F.coalesce(alone == source, F.lit(False)))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", "role", "text", "escaped"))).alias("turns"))

    def rendered(escaped_all: bool) -> Column:
        return F.array_join(F.transform("turns", lambda t: render(
            t["role"], t["text"], F.lit(True) if escaped_all else t["escaped"])), "")

    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    chats = chats.withColumn("source", source).withColumn("first", rendered(False))
    chats = chats.withColumn("same", F.coalesce(_recovered(F.col("first")) == F.col("source"), F.lit(False)))
    chats = chats.withColumn("formatted", F.when(F.col("same"), F.col("first")).otherwise(rendered(True)))
    sure = F.when(F.col("same") | F.coalesce(_recovered(F.col("formatted")) == F.col("source"), F.lit(False)),
                  F.col("formatted")).otherwise(F.raise_error(F.lit("a conversation cannot be read back")))

    def span(t: Column, k: Column) -> Column:
        escaped = ~F.col("same") | t["escaped"]
        start = F.length(escape(t["role"], ROLE_ESCAPES)) + escaped.cast("int") + len(HEAD) + len(SEP)
        body = F.when(escaped, escape(t["text"], BODY_ESCAPES)).otherwise(t["text"])
        return F.struct(t["role"].alias("role"), k.alias("turn"), start.alias("start"), F.length(body).alias("length"))

    loss = F.transform(F.filter(F.transform("turns", span), lambda s: s["role"] == "assistant"),
                       lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["length"].alias("length")))
    return chats.select("conv_id", sure.alias("formatted"), loss.alias("loss"))


def digest(formatted: DataFrame) -> DataFrame:
    """What a reader of (conv_id, formatted, loss) finds: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars."""
    read = formatted.withColumn("pieces", pieces(F.col("formatted")))
    read = read.withColumn("turns", F.transform("pieces", parse_piece))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")

    def under_mask(s: Column) -> Column:
        piece = F.get("pieces", s["turn"])
        text = F.substr(piece, s["start"] + 1, s["length"])
        flagged = F.substr(piece, s["start"] - len(SEP), F.lit(1)) == FLAG
        return F.when(flagged, unescape(text)).otherwise(text)

    read = read.withColumn("under", F.array_join(F.transform("loss", under_mask), ""))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def round_trip(rows: DataFrame) -> DataFrame:
    """Format, write, read back and digest."""
    return digest(written(format_chats(rows), "chats"))
