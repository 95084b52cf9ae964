import zlib

import numpy as np
import pytest

from babelqa.llm import token_files as K
from babelqa.llm.common import scratch
from llm_cases import documents, odd_texts, words

public_tokenizers = pytest.importorskip("public_tokenizers")
BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("top", [1, 200, 256, 60_000, 2**24, 2**32 - 1])
@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 4096, 5003])
def test_any_token_is_read_by_its_place(top, n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n, dtype=np.uint64), top).astype(np.uint32)
    codes = K.DirectCodes(K.encode_codes(ids))
    assert len(codes) == n
    for i in [*range(0, n, 97), *([n - 1] if n else [])]:
        assert codes[i] == ids[i]
    for a, b in ((0, n), (n // 3, n // 2), (n // 2, n), (n, n), (7 % (n + 1), min(n, 9))):
        if a <= b:
            assert codes.slice(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(IndexError):
        codes[n]


def test_a_wrong_file_is_refused():
    with pytest.raises(ValueError):
        K.DirectCodes(b"nope" + bytes(20))


@pytest.mark.parametrize("segment", [K.SEGMENT_IDS, 50])
def test_round_trip(spark, segment):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(BYTES)
    texts = odd_texts() + [" ".join(words(k, k)) for k in range(30)]
    ids = [100 - 2 * k for k in range(len(texts))]
    path = scratch(spark, "test-tokens")
    K.write_tokens(documents(spark, texts, ids, clash=True), BYTES, path, segment_ids=segment)
    got = {r.doc_id: tuple(r)[1:] for r in K.read_documents(spark, path).collect()}
    at, want = 0, {}
    for i, x in sorted(zip(ids, texts)):
        e = whole.encode(x or "", add_special_tokens=False).ids + [0]
        want[i] = (at, len(e), zlib.crc32(np.array(e, "<u4").tobytes()))
        at += len(e)
    assert got == want


def test_repeated_and_null_ids_and_no_rows(spark):
    got = sorted(map(tuple, K.round_trip(documents(spark, ["b", "a", None, "x"], [5, 5, None, 1]), BYTES).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 1, 5, 5] and [r[1] for r in got] == [0, 1, 3, 5]
    assert K.round_trip(documents(spark, []), BYTES).count() == 0
