"""Golden literals for the scalar Column functions."""

import pytest
from pyspark.sql import functions as F

from babelqa import constants as K
from babelqa.functions import arrays as A
from babelqa.functions import locale as L
from babelqa.functions import params as PR
from babelqa.functions import prompts as P
from babelqa.functions import text as TX


def one(spark, col, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_py_strip_matches_python(spark):
    samples = ["  a b  ", " x　", "\x1c\x1dy\x1e\x1f", "\n\tz\r\n", " q ", "", "   ",
               "a​b", "\x85m\x85"]
    got = one(spark, TX.py_strip("s"), [(s,) for s in samples], "s string")
    assert got == [s.strip() for s in samples]


def test_words_match_python_split(spark):
    samples = ["a  b\tc\n", " x　y", "", "   ", "one", "é ü ß"]
    got = one(spark, TX.words("s"), [(s,) for s in samples], "s string")
    assert got == [s.split() for s in samples]


def test_lossless_tokens_rejoin(spark):
    samples = ["  a b\n\nc  ", "x", "　y z"]
    got = one(spark, F.array_join(TX.lossless_tokens("s"), ""), [(s,) for s in samples], "s string")
    assert got == [s.rstrip() for s in samples]


def test_strip_thinking(spark):
    rows = [("<think>a\nb</think>  Answer </think>", "q"), ("pre<think>x</think>mid<think>y</think>post", ""),
            ("  Q is here Q ", "Q"), (" keep ", None)]
    got = one(spark, TX.strip_thinking("a", "q"), rows, "a string, q string")
    assert got == ["Answer </think>", "premidpost", " is here ", "keep"]


def test_strip_echo_order(spark):
    got = one(spark, TX.strip_echo("a", "q"), [("Q  answer ", "Q"), ("x", "")], "a string, q string")
    assert got == ["answer", "x"]


def test_exact_match_and_fallback(spark):
    df = spark.createDataFrame([("  Hello ", "hello"), ("a", "b"), ("   ", "x")], "p string, r string")
    rows = df.select(TX.exact_match("p", "r"), TX.with_fallback("p")).collect()
    assert [r[0] for r in rows] == [1, 0, 0]
    assert rows[2][1] == K.FALLBACK_ANSWER and rows[0][1] == "  Hello "


def test_subset_parsing(spark):
    df = spark.createDataFrame([("Eng_Ken",), ("Eng",), ("a_b_c",), (None,)], "s string")
    lang, country = L.subset_parts_lenient("s")
    assert [tuple(r) for r in df.select(lang, country).collect()] == [
        ("Eng", "Ken"), ("Eng", ""), ("a", "b_c"), ("", "")]
    assert [r[0] for r in df.select(L.lang_of("s")).collect()] == ["Eng", "Eng", "a", "unknown"]
    strict = L.subset_parts_strict("s")
    assert df.limit(1).select(*strict).collect()[0] == ("Eng", "Ken")
    for bad in ("Eng", "a_b_c"):
        with pytest.raises(Exception, match="Lang_Ctry"):
            spark.createDataFrame([(bad,)], "s string").select(*strict).collect()


def test_model_family(spark):
    got = one(spark, L.model_family("m"), [("lab/small-AYA-8b",), ("lab/base-QWEN-7b",), ("llama",)], "m string")
    assert got == ["aya", "qwen", "qwen"]


def test_student_prompt(spark):
    df = spark.createDataFrame([("Q?", "Eng", "Kenya"), ("Q?", "", ""), ("Q?", "", "Ghana")],
                               "q string, l string, c string")
    got = [r[0] for r in df.select(P.student_prompt("q", "l", "c")).collect()]
    assert got == ["\nAnswer in Eng\nQuestion:\nQ?", "Q?", "\nAnswer in \nQuestion:\nQ?"]
    assert K.STUDENT_TEMPLATE.format(language="Eng", question="Q?") == got[0]


def test_system_prompt_bytes():
    assert "assistant.Answer" in K.SYSTEM_PROMPT
    assert K.SYSTEM_PROMPT.endswith("no outro.")


def test_messages_and_markers(spark):
    df = spark.createDataFrame([("Q", "A")], "q string, a string")
    qm = df.select(P.question_messages("q", None, None, "")).first()[0]
    assert [m.role for m in qm] == ["system", "user", "assistant"] and qm[2].content == ""
    assert len(df.select(P.question_messages("q", None, None, None)).first()[0]) == 2
    am = df.select(P.answer_messages("q", "a", None, None, "##Answer:")).first()[0]
    assert am[2].content == "##Answer: A"
    assert df.select(P.answer_messages("q", "a", None, None, "")).first()[0][2].content == "A"


def test_render_chat_golden(spark):
    msgs = [("system", "ignored"), ("user", "hi"), ("assistant", "yo"), ("user", "again")]
    df = spark.createDataFrame([(msgs,)], "m array<struct<role:string,content:string>>")
    t = P.DEFAULT_TEMPLATE
    head = t.bos + t.start_turn + t.system_token + t.system_prompt + t.end_turn
    body = (t.start_turn + t.user_token + "hi" + t.end_turn + t.start_turn + t.chatbot_token + t.response_start
            + "yo" + t.response_end + t.end_turn + t.start_turn + t.user_token + "again" + t.end_turn)
    assert df.select(P.render_chat("m")).first()[0] == head + body
    opened = head + body + t.start_turn + t.chatbot_token + t.response_start
    assert df.select(P.render_chat("m", generation=True)).first()[0] == opened
    custom = P.ChatTemplate(system_prompt="S", bos="<s>")
    assert df.select(P.render_chat("m", custom)).first()[0].startswith("<s>" + t.start_turn + t.system_token + "S")


def test_unknown_role_fails(spark):
    df = spark.createDataFrame([([("tool", "x")],)], "m array<struct<role:string,content:string>>")
    with pytest.raises(Exception, match="unknown chat role"):
        df.select(P.render_chat("m")).collect()


def test_cut_after_marker(spark):
    df = spark.createDataFrame([("a ##Answer: b ##Answer: c",), ("none",)], "t string")
    assert df.where("t <> 'none'").select(P.cut_after_marker("t")).first()[0] == "a ##Answer:"
    with pytest.raises(Exception, match="not found"):
        df.where("t = 'none'").select(P.cut_after_marker("t")).collect()


def test_params(spark):
    df = spark.createDataFrame([('{"num_beams": 5, "x": 1}',), ("",), (None,), ("{bad",)], "p string")
    m = PR.parse_params("p")
    assert [r[0] for r in df.select(F.size(m)).collect()] == [2, 0, 0, 0]
    kept = df.limit(1).select(PR.filter_params(m, ["num_beams"]), PR.dropped_params(m, ["num_beams"])).first()
    assert kept[0] == {"num_beams": "5"} and kept[1] == ["x"]
    assert df.limit(1).select(PR.filter_params(m, None)).first()[0] == {"num_beams": "5", "x": "1"}


def test_token_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [-100, 2, 9, 4], [0.1, 0.9, 0.9])],
                               "p array<int>, l array<int>, s array<double>")
    r = df.select(A.shift_compare("p", "l"), A.argmax_label("s"), A.strip_prompt_ids("p", 3),
                  A.truncate_at_stop("p", [3, None]), A.pad_to("p", 6, 0, "left"), A.pad_to("p", 5, 0, "right")).first()
    # preds [1,2,3] vs labels [2,9,4]: no match
    assert (r[0].correct, r[0].total) == (0, 3)
    assert r[1] == 1 and r[2] == [4] and r[3] == [1, 2] and r[4] == [0, 0, 1, 2, 3, 4] and r[5] == [1, 2, 3, 4, 0]


def test_label_mask(spark):
    df = spark.createDataFrame([([5, 6, 7, 8, 7, 9], 2)], "ids array<int>, plen int")
    assert df.select(A.label_mask("ids", F.col("plen"), [7])).first()[0] == [-100, -100, -100, 8, 7, 9]
    with pytest.raises(Exception, match="marker not found"):
        df.select(A.label_mask("ids", F.col("plen"), [42])).collect()


def test_strict_params_fail(spark):
    df = spark.createDataFrame([("{bad",)], "p string")
    with pytest.raises(Exception):
        df.select(PR.parse_params("p", strict=True)).collect()


def test_strip_and_split_random_unicode(spark):
    import random
    rng = random.Random(11)
    pool = list(K.PY_WHITESPACE) + list("ab éßİ中​﻿_-")
    samples = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: (r.st, list(r.w)) for r in df.select("i", TX.py_strip("s").alias("st"), TX.words("s").alias("w")).collect()}
    for i, s in enumerate(samples):
        assert got[i] == (s.strip(), s.split()), repr(s)
