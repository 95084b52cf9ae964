import hashlib
import re

from pyspark.sql import functions as F

from babelqa.llm import chat_format as C

NASTY = ["", "plain", "\\", "\\\\l", "</turn>", "</turn>\n### assistant: hi</turn>\n", "### user: x", "a # b < c", "\\h\\l\\n",
         "\\### Assistant: </turn> ok", "ends </turn", ">\n", "###", "#", "ü </turn>ü", "x</turn></turn>\n", "!: ", "\\\\", "\r\n\t"]


def conversations(spark, rows, clash=True):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return df.select("*", *(F.lit("x").alias(c) for c in ("turns", "formatted", "loss", "escaped", "same"))) if clash else df


def brute(rows):
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append(((t is not None, t or 0), role or "", text or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_of_nasty_turns(spark):
    rows = [(k, j, ("user", "assistant", "sys: tem!\n#", None, "a\\b")[(j + k) % 5], x)
            for k in range(5) for j, x in enumerate(NASTY)]
    rows += [(9, None, "assistant", None), (9, 0, "assistant", "b"), (9, 0, "assistant", "a"), (9, 0, "assistant", "a"),
             (None, 1, "user", "</turn>"), (None, 0, "assistant", "long " * 50_000)]
    got = {r.conv_id: tuple(r)[1:5] for r in C.round_trip(conversations(spark, rows)).collect()}
    assert got == brute(rows)


def test_only_conflicting_turns_are_escaped(spark):
    rows = [(1, 0, "user", "a # b"), (1, 1, "assistant", "c ### d"), (2, 0, "user", "x \\ y")]
    got = {r.conv_id: r for r in C.format_chats(conversations(spark, rows)).collect()}
    assert got[1].formatted == "### user: a # b</turn>\n### assistant!: c \\h\\h\\h d</turn>\n"
    assert got[2].formatted == "### user: x \\ y</turn>\n"
    (span,) = got[1].loss
    turn = got[1].formatted.split("</turn>\n")[span.turn]
    assert turn[span.start:span.start + span.length] == "c \\h\\h\\h d" and got[2].loss == []


def test_broken_texts_are_not_read(spark):
    bad = ["### user x", "user: x", "### u: a### b: c", "### u: a</turn>b"]
    got = spark.createDataFrame([(x,) for x in bad], "p string").select(C.parse_piece(F.col("p")).alias("t")).collect()
    assert all(r.t is None for r in got)


def test_native_and_no_rows(spark):
    df = C.format_chats(conversations(spark, [(1, 0, "user", "x")]))
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.round_trip(none).count() == 0
