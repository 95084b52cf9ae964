import hashlib
import re

import numpy as np

from babelqa.llm import fingerprints as G
from llm_cases import documents, odd_texts, words


def shingles(text):
    w = [x for x in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def brute_edit(texts):
    out = []
    for k, x in enumerate(texts):
        n, after = len(x), texts[(k + 1) % len(texts)]
        out.append(x[:n - n // 4] + after[:n // 4])
    return out


def test_edits_and_likeness(spark):
    # more ranges than rows in some places; ids with gaps
    texts = [x or "" for x in odd_texts()] + [" ".join(words(k, 5 + 17 * k)) for k in range(50)]
    ids = [7 * k - 50 for k in range(len(texts))]
    given = [None if k == 0 else x for k, x in enumerate(texts)]
    got = {r.doc_id: r for r in G.edited_fingerprints(documents(spark, given, ids, clash=True)).collect()}
    errors = []
    for k, (i, x, e) in enumerate(zip(ids, texts, brute_edit(texts))):
        r, after = got[i], texts[(k + 1) % len(texts)]
        assert r.n_chars == len(x) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        assert len(r.fingerprint) == (G.BINS if shingles(x) else 0)
        errors += [r.near_edited - jaccard(x, e), r.near_next - jaccard(x, after)]
        if x == e:
            assert r.near_edited == 1.0 and r.fingerprint == r.edited_fingerprint
        if shingles(x) and not shingles(after):
            assert r.near_next == 0.0
    assert got[ids[6]].fingerprint == got[ids[7]].fingerprint and got[ids[6]].near_next == 1.0
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.2


def test_equal_ids_null_ids_one_row_no_rows(spark):
    texts = ["one two three four five six", "b " * 20, "c " * 20, "d " * 20]
    got = G.edited_fingerprints(documents(spark, texts, [None, 3, 3, 4])).collect()
    assert len(got) == 4
    edits = {r.edited_sha256 for r in got}
    cut = lambda x, after: hashlib.sha256((x[:len(x) - len(x) // 4] + after[:len(x) // 4]).encode()).hexdigest()
    either = ({cut(texts[0], texts[1]), cut(texts[1], texts[2]), cut(texts[2], texts[3]), cut(texts[3], texts[0])},
              {cut(texts[0], texts[2]), cut(texts[2], texts[1]), cut(texts[1], texts[3]), cut(texts[3], texts[0])})
    assert edits in either
    (one,) = G.edited_fingerprints(documents(spark, ["abcd efgh"])).collect()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()
    assert G.edited_fingerprints(documents(spark, [])).count() == 0


def test_native(spark):
    plan = G.edited_fingerprints(documents(spark, ["a b c"]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|SinglePartition", plan)
