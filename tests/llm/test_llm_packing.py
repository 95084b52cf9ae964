import zlib

import numpy as np
import pytest
from pyspark.sql import types as T

from babelqa.llm import packing as P
from babelqa.llm.encoding import ChunkEncoder
from llm_cases import documents, odd_texts, words

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")

TRICKY = ["", "  a  b", "a\n\n b\n", "x <|endoftext|> y", "<|startoftext|>a", "it's  I'M don't\t\ttab \xa0nb em　x", "  ",
          "\x1c\x1d a\x1fb", "é é x 12 345\r\n", "ΑΣ Σ", "a,b a, b. c., .d ,", "Ünïcode, STRASSE. ß", "日本 語", "a​ b", "1.5, 2",
          "word,$$$ it's!! <|endoftext|>, x<|endoftext|> |> a-b a- -b 'tis rock'n'roll' (a) [b] {c}~ d^ e` _f_ f_ g\\\\ #h h# ...", "a.$",
          "$$$\n$$$ x", "a_", "ab'", "it's, it',"]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_chunk_encoder_equals_whole_texts(path):
    from tokenizers import Tokenizer
    whole, chunks = Tokenizer.from_file(path), ChunkEncoder(path)
    assert chunks.known.encode == chunks._chunk
    texts = TRICKY + [" ".join(words(k, 200)).capitalize() + "." for k in range(5)]
    for text, ids in zip(texts, chunks.ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check_pieces(rows, ids, limits):
    """Every id in exactly one piece; sequences gapless and within limits. Returns padding."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for (doc, total), own in pieces.items():
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(ids[doc][at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == total == len(ids[doc])
    assert {d for d, _ in pieces} == {d for d in ids if ids[d]}
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= limits[0] and len(own) <= limits[1] and sum(r.loss_tokens for r in own) <= limits[2]
        padding += 0 if at & (at - 1) == 0 else limits[0] - at
    return padding


def test_documents_are_packed_whole_without_padding(spark):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(WORDS)
    texts = odd_texts() + [" ".join(words(k, 1 + 37 * k % 900)) for k in range(60)]
    docs = documents(spark, texts, clash=True)
    ids = {k: whole.encode(x or "", add_special_tokens=False).ids + [1] for k, x in enumerate(texts)}
    limits = (P.MAX_TOKENS, P.MAX_SEGMENTS, P.MAX_LOSS)
    rows = P.pack_documents(docs, WORDS).collect()
    assert check_pieces(rows, ids, limits) == 0
    again = P.pack_documents(docs, WORDS).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    # a small pool, and limits that bind
    limits = (256, 5, 256)
    assert check_pieces(P.pack_documents(docs, WORDS, limits=limits, pool=9).collect(), ids, limits) == 0
    assert P.pack_documents(documents(spark, []), WORDS).count() == 0


def test_many_tiny_documents_need_no_padding(spark):
    texts = [f"a{k}" for k in range(3000)]
    encoder = ChunkEncoder(WORDS)
    ids = {k: encoder.encode(x) + [1] for k, x in enumerate(texts)}
    limits = (P.MAX_TOKENS, 16, P.MAX_LOSS)
    assert check_pieces(P.pack_documents(documents(spark, texts), WORDS, limits=limits, pool=64).collect(), ids, limits) == 0
    with pytest.raises(ValueError):
        P.Packer((0, 1, 1))


def test_repeated_rows_and_null_ids(spark):
    rows = P.pack_documents(documents(spark, ["a b", "a b", "c"], [None, None, 3]), WORDS).collect()
    assert sum(r.length for r in rows) == 8 and sum(r.doc_id is None for r in rows) >= 2


def test_instruction_limits(spark):
    rng = np.random.default_rng(1)
    rows, ids = [], {}
    for k in range(80):
        n = int(rng.integers(0, 300))
        ids[k] = rng.integers(0, 50_000, n).tolist()
        rows.append((k, ids[k], None if k % 5 == 0 else (rng.random(n) < 0.6).tolist()))
    rows.append((500, None, None))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.LongType())),
                           T.StructField("loss", T.ArrayType(T.BooleanType()))])
    limits = (512, 6, 200)
    found = P.pack_examples(spark.createDataFrame(rows, schema), limits, pool=32).collect()
    check_pieces(found, ids, limits)
    loss = {k: n if m is None else sum(m) for k, x, m in rows[:-1] if (n := len(x)) or True}
    got = {}
    for r in found:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.loss_tokens
    assert got == {k: n for k, n in loss.items() if ids[k]}


def test_dot_product_prefers_the_matching_example():
    packer = P.Packer((100, 10, 50), pool=8)
    for n, loss in ((60, 50), (60, 0), (40, 0), (30, 0)):
        list(packer.add(P.Example(n * 100 + loss, bytes(4 * n), n, 0, np.arange(n) < loss)))
    first = packer._sequence()
    assert [x.doc for x in first] == [6050, 4000]      # most of both, then what still fits best


def test_long_documents_are_cut_without_copies():
    """Eight times the tokens take about eight times as long, not sixty-four."""
    import time

    def seconds(n):
        packer, ids = P.Packer(), np.arange(n, dtype="<u4").tobytes()
        began = time.perf_counter()
        got = sum(len(x) for sequence in packer.add(P.Example(1, ids, n)) for x in sequence)
        assert got + sum(len(x) for sequence in packer.finish() for x in sequence) == n
        return time.perf_counter() - began

    seconds(1 << 18)
    assert seconds(1 << 23) < 40 * max(seconds(1 << 20), 0.005)
