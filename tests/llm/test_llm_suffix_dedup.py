import hashlib
from collections import Counter

import pytest

from babelqa.llm import suffix_dedup as S
from llm_cases import documents, odd_texts, words

W = 200


def brute_marks(texts):
    raws = [(x or "").encode() for x in texts]
    met = Counter(b[i:i + W] for b in raws for i in range(len(b) - W + 1))
    marks = []
    for b in raws:
        m, end = bytearray(len(b)), 0
        for i in range(len(b) - W + 1):
            if met[b[i:i + W]] > 1:
                m[max(i, end):i + W] = b"\1" * (i + W - max(i, end))
                end = i + W
        marks.append(m)
    return raws, marks


def brute(ids, texts):
    out = []
    for i, b, m in zip(ids, *brute_marks(texts)):
        kept = bytes(x for x, gone in zip(b, m) if not gone)
        spans = sum(1 for k in range(len(m)) if m[k] and not (k and m[k - 1]))
        out.append((i, len(b), sum(m), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    shared = " ".join(words(77, 60))
    texts = [" ".join(words(k, 40)) + " " + shared[k % 7:len(shared) - k % 11] + " " + " ".join(words(900 + k, 30))
             for k in range(25)]
    near = " ".join(words(5, 200))
    texts += [near[:k * 70] + "#" + near[k * 70 + 1:] for k in range(1, 12)]
    texts += ["abc" * 400, "abc" * 300 + "d", near[100:299], near[100:300] + "!", "é" * 99 + "x", "é" * 101]
    texts += [t for t in odd_texts() if t is None or len(t) < 3000]
    return texts


@pytest.mark.parametrize("group,batches", [(2000, 4), (0, 1), (3, 3)])
def test_equals_brute_force(spark, monkeypatch, group, batches):
    monkeypatch.setattr(S, "GROUP", group)
    texts = corpus()
    ids = [None if k % 9 == 4 else k // 2 for k in range(len(texts))]      # null and repeated ids
    got = S.dedup_digest(documents(spark, texts, ids, clash=True), batches=batches)
    assert sorted(map(tuple, got.collect()), key=str) == brute(ids, texts)


def test_blocks_of_long_documents(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BYTES", 700)      # on the driver: what each task would do
    import numpy as np
    long = " ".join(words(1, 900)).encode()
    raw = np.frombuffer(long * 2, np.uint8)
    at = np.array([0, len(long), 2 * len(long)])
    seen = [0, 0]
    for row, low, n, key, context in S.suffixes(raw, at, W):
        for r, size in zip(row, n):
            seen[r] += size
        assert (n > 0).all() and (n <= W - S.PREFIX + 1).all() and len(key) == len(context) == len(low)
    assert seen == [len(long) - W + 1] * 2


def test_levels_merge_geometrically(spark):
    family = S.LevelFamily()
    for k in range(7):
        rows = [(j, 10 * j + k % 2, 0, 0, 0) for j in range(k, k + 3)]
        family.add(spark.createDataFrame(rows, "key long, context long, t long, size int, place long"))
        assert [x is not None for x in family.levels] == [bool((k + 1) >> b & 1) for b in range((k + 1).bit_length())]
    got = {r.key: r.mixed for r in family.repeated().collect()}
    assert got == {k: True for k in range(1, 8)}


def test_stage_cuts_text_and_drops_what_is_left_blank(spark):
    shared = "ä" + " ".join(words(8, 50))
    texts = [shared, f"head {shared} tail", None, "", "short", "  ", "only here " * 3]
    docs = documents(spark, texts, clash=True)
    got = S.keep_after_repeats(docs)
    assert got.columns == docs.columns
    rows = {r.doc_id: (r.text, r.n_chars, r.t) for r in got.collect()}
    assert rows == {1: ("head  tail", 10, "xt"), 2: (None, None, "xt"), 3: ("", 0, "xt"), 4: ("short", 5, "xt"),
                    5: ("  ", 2, "xt"), 6: ("only here " * 3, 30, "xt")}


def test_no_rows(spark):
    none = documents(spark, [])
    assert S.dedup_digest(none).count() == 0 and S.keep_after_repeats(none).count() == 0
