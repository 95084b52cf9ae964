"""Repetition operators against naive restatements of their semantics."""

import random

from babelqa.operators import repetition as RP


def naive_trim(tokens, min_n, max_n):
    """Restatement: repeatedly drop the last k tokens (smallest k first, k < length)
    while that k-gram occurs wholly inside the rest."""
    toks = list(tokens)
    while True:
        n = len(toks)
        for k in range(min_n, min(max_n, n - 1) + 1):
            tail = toks[n - k:]
            if any(toks[i:i + k] == tail for i in range(0, n - 2 * k + 1)):
                toks = toks[:n - k]
                break
        else:
            return toks


def naive_first_repeat(tokens, min_n, max_n):
    for n in range(max_n, min_n - 1, -1):
        grams = [tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)]
        best = None
        for i, g in enumerate(grams):
            earlier = [j for j in range(i) if grams[j] == g]
            if earlier:
                best = (earlier[0], n)
                break
        if best:
            return best
    return None


def random_rows(seed, count=300):
    rng = random.Random(seed)
    rows = []
    for k in range(count):
        alpha = rng.choice([2, 3, 5])
        n = rng.choice([0, 1, 2, 3, 5, 6, 7, 12, 20, 40])
        toks = [rng.choice("abcde"[:alpha]) for _ in range(n)]
        if n and rng.random() < 0.4:  # degenerate tail
            tail = toks[-rng.randint(1, min(4, n)):]
            toks += tail * rng.randint(1, 4) + tail[: rng.randint(0, len(tail))]
        rows.append((k, toks))
    return rows


def test_trim_matches_naive(spark):
    rows = random_rows(1)
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    for m, mx in [(3, 8), (1, 8), (2, 2)]:
        got = {r.row_id: r.n_kept for r in RP.trailing_keep_length(df, min_n=m, max_n=mx).collect()}
        for k, toks in rows:
            assert got[k] == len(naive_trim(toks, m, mx)), (m, toks)


def test_trim_edge_lengths(spark):
    m = 3
    cases = {0: [], 1: ["a"], 3: ["a", "b", "c"], 5: list("abcab"), 6: list("abcabc"), 9: list("abcabcabc")}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "row_id long, tokens array<string>")
    got = {r.row_id: r.trimmed for r in RP.trim_repetition(df, min_n=m, max_n=8).collect()}
    assert got == {k: naive_trim(v, m, 8) for k, v in cases.items()}
    assert got[6] == list("abc") and got[9] == list("abc")
    # min_n > max_n and max_passes = 0 trim nothing
    assert {r.n_kept for r in RP.trailing_keep_length(df, min_n=4, max_n=3).collect()} == {len(v) for v in cases.values()}
    assert RP.trailing_keep_length(df, min_n=3, max_passes=0).where("n_kept <> n_tokens").count() == 0


def test_first_repeat_matches_naive(spark):
    rows = random_rows(2)
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    got = {r.row_id: (r.first_start, r.n) for r in RP.first_repeated_ngram(df, min_n=2, max_n=5).collect()}
    for k, toks in rows:
        assert got.get(k) == naive_first_repeat(toks, 2, 5), toks


def test_array_keys_for_arbitrary_tokens(spark):
    rows = [(0, ["a b", "c", "a", "b c"]), (1, ["x", "y", "x", "y"])]
    df = spark.createDataFrame(rows, "row_id long, tokens array<string>")
    got = {r.row_id: (r.first_start, r.n) for r in
           RP.first_repeated_ngram(df, min_n=1, max_n=2, gram_sep=None).collect()}
    assert got == {1: (0, 2)}


def test_clean_repetition_text(spark):
    df = spark.createDataFrame([(0, "the cat sat on the mat on the mat on the"), (1, "  no repeat here  ")],
                               "row_id long, text string")
    got = {r.row_id: r.cleaned for r in RP.clean_repetition(df).collect()}
    # " mat on the" is dropped once; the new tail " mat on the" has no earlier copy
    assert got == {0: "the cat sat on the mat on the", 1: "no repeat here"}
    import re
    texts = ["x y z a b c a b c a b c a b", "w1\nw2 w3 w1\nw2 w3 w1\nw2 w3"]
    df2 = spark.createDataFrame(list(enumerate(texts)), "row_id long, text string")
    got2 = {r.row_id: r.cleaned for r in RP.clean_repetition(df2).collect()}
    for k, t in enumerate(texts):
        toks = re.findall(r"\s*\S+", t)
        assert got2[k] == "".join(naive_trim(toks, 3, 8)).strip()


def test_null_and_repeated_keys_fail(spark):
    import pytest
    for bad in ([(1, "a b c a b c"), (1, "x y z")], [(None, "a b c a b c")]):
        df = spark.createDataFrame(bad, "row_id long, text string")
        with pytest.raises(Exception, match="NULL or repeated"):
            RP.clean_repetition(df).collect()
