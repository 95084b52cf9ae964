import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from babelqa.llm import chat_packing as C
from llm_cases import words

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TURN = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
ESCAPED = [("\\", "\\\\"), ("<", "\\l"), ("#", "\\h")]


def chats():
    rows = []
    for c in range(60):
        for t in range(1 + c % 6):
            n = 5 if c % 3 == 0 else 40 + 11 * c
            rows.append((c, t, ["user", "assistant"][t % 2], " ".join(words(100 * c + t, n))))
    rows += [(70, t, "assistant", f"turn {t}") for t in range(100)]           # several parts
    rows += [(71, 0, "user", "same"), (71, 0, "user", "same"), (71, 1, "assistant", " ".join(words(1, 3000)))]
    rows += [(72, 0, "user", r"\### Assistant: </turn> ok"), (72, 1, "assistant", r"\### Assistant: </turn> ok")]
    rows += [(None, 0, "user", "a"), (None, None, "assistant", None), (73, 0, None, None), (74, 0, "assistant", "")]
    return rows


def expected(rows, tokenizer, turns):
    """(conv, part) -> ids and loss, by plain string work."""
    encode = lambda x: tokenizer.encode(x, add_special_tokens=False).ids
    of = defaultdict(list)
    for c, t, role, text in rows:
        of[c].append((t is not None, t or 0, role or "", text or ""))
    out = {}
    for c, own in of.items():
        own.sort()
        for p in range(0, len(own), turns):
            ids, loss, plain = [], [], ""
            for _, _, role, text in own[p:p + turns]:
                flag = "!" if "### " in text or "</turn>" in text else ""
                for a, b in ESCAPED if flag else []:
                    text = text.replace(a, b)
                plain += f"### {role}{flag}: "
                if role == "assistant":
                    for part, bears in ((plain, False), (text, True)):
                        x = encode(part)
                        ids, loss, plain = ids + x, loss + [bears] * len(x), ""
                else:
                    plain += text
                plain += "</turn>\n"
            x = encode(plain) + [1]
            out[c, p // turns] = ids + x, loss + [False] * len(x)
    return out


@pytest.mark.parametrize("limits,turns", [(C.LIMITS, C.TURNS), ((256, 3, 60), 7)])
def test_every_token_once_and_within_limits(spark, limits, turns):
    from tokenizers import Tokenizer
    from pyspark.sql import functions as F
    rows = chats()
    want = expected(rows, Tokenizer.from_file(WORDS), turns)
    df = spark.createDataFrame(rows, TURN).repartition(3).select(
        "*", *(F.lit(1).alias(c) for c in ("part", "_rank", "_tie", "loss", "formatted", "_text")))
    found = C.pack_chats(df, WORDS, limits=limits, turns=turns, pool=16).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        pieces[r.conv_id, r.part].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for key, own in pieces.items():
        ids, loss = want[key]
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.part_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            assert r.loss_tokens == sum(loss[at:at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == limits[0] or at & (at - 1) == 0          # no padding
        assert at <= limits[0] and len(own) <= limits[1] and sum(r.loss_tokens for r in own) <= limits[2]
    if limits != C.LIMITS:        # each limit stops some sequence
        used = [(sum(r.length for r in own), len(own), sum(r.loss_tokens for r in own)) for own in sequences.values()]
        assert all(any(u[k] == limits[k] for u in used) for k in range(3))


def test_no_rows(spark):
    assert C.pack_chats(spark.createDataFrame([], TURN), WORDS).count() == 0


def test_same_rows_in_another_layout_are_rendered_alike(spark):
    rows = chats()
    a, b = (C.chat_parts(spark.createDataFrame(rows[::s], TURN).repartition(n), 7) for s, n in ((1, 2), (-1, 5)))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
