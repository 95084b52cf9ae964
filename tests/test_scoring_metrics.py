"""ROUGE helpers against a plain DP, metrics against the fixture's known counts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from babelqa.functions.numeric import py_round4
from babelqa.functions.rouge import f_measure, in_order, lcs_length
from babelqa.operators import metrics as MT
from babelqa.operators import scoring as SC
from babelqa.sources import fixtures as FX
from conftest import SF01


def dp_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def test_lcs_and_overlap_random():
    rng = random.Random(7)
    for _ in range(500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        assert lcs_length(a, b) == dp_lcs(a, b)


def test_ids_in_order():
    import numpy as np
    places = [np.array([0, 3]), np.array([1]), np.array([], dtype=int), np.array([2])]
    assert in_order(np.array([7, 8, 9, 5]), places) == [7, 8, 5, 7]


def test_rouge_edges(spark):
    assert f_measure(0, 0, 3, True) == 0.0 and f_measure(3, 3, 3, True) == 1.0
    df = spark.createDataFrame([(1, "the cat sat", "the cat sat"), (2, "ሰላም ነው", "ሰላም ነው"), (3, "", "a b"),
                                (4, "Running dogs", "the dog runs")], "row_id long, gold string, gen string")
    got = {r.row_id: r for r in SC.rouge_score(df, "gold", "gen").collect()}
    assert (got[1].rouge1_f1, got[1].rougeL_f1, got[1].score) == (1.0, 1.0, 1.0)
    assert got[2].score == 0.0 and got[3].score == 0.0  # non-Latin text has no tokens
    # stemming: run/runs and dog/dogs match -> overlap 2 of (2, 3)
    assert got[4].rouge1_f1 == round(2 * (2 / 3) * (2 / 2) / (2 / 3 + 1), 4)


def test_python_rounding(spark):
    vals = [0.03125, 0.00625, 0.15625, 1 / 3, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in vals], "x double").select(py_round4("x")).collect()]
    assert got == [round(v, 4) if v is not None else None for v in vals]


def test_counts_equal_python(spark):
    a = SC.scoring_tokens(FX.gen(spark, SF01), "output", "raw_answer").select("row_id", "_gen_t", "_gold_t")
    ones = {r.row_id: tuple(r)[1:] for r in SC.rouge1_counts(a, "_gen_t", "_gold_t").collect()}
    ls = {r.row_id: r.lcs for r in SC.rougeL_counts(a, "_gen_t", "_gold_t", stem=False).collect()}
    for r in a.collect():
        g, gold = r._gen_t, r._gold_t
        assert ones[r.row_id] == (sum((Counter(g) & Counter(gold)).values()), len(g), len(gold))
        assert ls[r.row_id] == dp_lcs(g, gold)


def test_repeated_and_null_keys_are_scored_apart(spark):
    df = spark.createDataFrame([(1, "a b c", "a b c"), (1, "a b c", "x"), (None, "a", "a"), (None, "a", None), (4, None, "a"), (5, "", "")],
                               "row_id long, gold string, gen string")
    got = sorted(((r.row_id, r.gold, r.gen, r.rouge1_f1, r.rougeL_f1, r.score) for r in SC.rouge_score(df, "gold", "gen").collect()), key=str)
    assert got == sorted([(1, "a b c", "a b c", 1.0, 1.0, 1.0), (1, "a b c", "x", 0.0, 0.0, 0.0), (None, "a", "a", 1.0, 1.0, 1.0),
                          (None, "a", None, 0.0, 0.0, 0.0), (4, None, "a", None, None, None), (5, "", "", 0.0, 0.0, 0.0)], key=str)


def test_null_scores_are_counted_not_averaged(spark):
    df = spark.createDataFrame([("en_X", "en", 1, 1.0, 1.0, 1.0), ("en_X", "en", None, None, None, None)],
                               "subset string, expected_lang string, exact_match int, rouge1_f1 double, rougeL_f1 double, score double")
    total = {r.expected_lang: r for r in MT.eval_summary(df).collect()}[None]
    assert (total.n, total.exact_match, total.exact_match_null, total.score, total.score_null) == (2, 1.0, 1, 1.0, 1)
    m = {r.metric: (r.n, r.value) for r in MT.gen_metrics(df, metrics=("exact_match", "score")).collect()}
    assert m["eval_gen_score"] == (1, 1.0) and m["eval_gen_exact_match_en"] == (1, 1.0) and m["eval_gen_n_samples"] == (2, 2.0)


def test_token_accuracy_fixture_counts(spark):
    seqs = MT.token_counts(MT.token_positions_to_sequences(FX.tok_pred(spark, SF01)))
    got = {r.lang: (r.correct, r.total) for r in MT.token_accuracy(seqs).collect()}
    assert got == {"Aka": (7, 48), "Amh": (6, 48), "Eng": (22, 192), "Lug": (3, 44), "Swa": (4, 42),
                   None: (42, 374)}


def test_eval_summary_and_gen_metrics(spark):
    df = spark.createDataFrame([("en", 1, 0.5, 0.25, 0.375), ("en", 0, 0.0, 0.0, 0.0), ("fr", 1, 1.0, 1.0, 1.0)],
                               "expected_lang string, exact_match int, rouge1_f1 double, rougeL_f1 double, score double")
    s = {r.expected_lang: r for r in MT.eval_summary(df).collect()}
    assert s[None].n == 3 and s["en"].exact_match == 0.5 and s["fr"].rouge1_f1 == 1.0
    assert MT.eval_summary(df.drop("rouge1_f1")).count() == 0
    g = df.withColumnRenamed("rouge1_f1", "rouge1").withColumnRenamed("rougeL_f1", "rougeL") \
        .withColumn("subset", F.concat("expected_lang", F.lit("_X")))
    m = {r.metric: r.value for r in MT.gen_metrics(g).collect()}
    assert m["eval_gen_exact_match"] == round(2 / 3, 4) and m["eval_gen_n_samples"] == 3.0
    assert m["eval_gen_rouge1_en"] == 0.25 and m["eval_gen_score_fr"] == 1.0
    empty = {r.metric: r.value for r in MT.gen_metrics(g.limit(0)).collect()}
    assert empty["eval_gen_exact_match"] == 0.0 and empty["eval_gen_n_samples"] == 0.0


def test_log_windows(spark):
    seqs = MT.token_counts(MT.token_positions_to_sequences(FX.tok_pred(spark, SF01)))
    w = MT.token_accuracy(seqs, every=10).collect()
    overall = [r for r in w if r.lang is None]
    assert sum(r.total for r in overall) == 374 and len({r.log_window for r in overall}) == len(overall)


def test_format_metrics(spark):
    df = spark.createDataFrame([("en", 32, 0.03125), ("fr", 3, 2 / 3)], "lang string, n long, exact_match double")
    got = {r.lang: (r.n, r.exact_match) for r in MT.format_metrics(df).collect()}
    assert got == {"en": ("32", f"{0.03125:.4f}"), "fr": ("3", "0.6667")}


def test_encode_decode_empty_and_skip(spark):
    from babelqa.operators import vocab as VC
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, [])], "row_id long, tokens array<string>")
    v = VC.build_vocab(df)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for limit in (kept, "-1"):  # map-side lookup and shuffle join
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            enc = {r.row_id: r.ids for r in VC.encode_tokens(df, v).collect()}
            assert enc == {1: [0, 1, 0], 2: []}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    e = VC.encode_tokens(df, v)
    dec = {r.row_id: r.text for r in VC.decode_tokens(e, v, skip_ids=[1]).collect()}
    assert dec == {1: "a a", 2: ""}
    unknown = spark.createDataFrame([(1, [0, 99])], "row_id long, ids array<int>")
    with pytest.raises(Exception, match="id without a token"):
        VC.decode_tokens(unknown, v).collect()
    for bad in ([(1, ["a"]), (1, ["b"])], [(None, ["a"])], [(1, ["a"]), (1, [])]):
        with pytest.raises(Exception, match="NULL or repeated"):
            VC.encode_tokens(spark.createDataFrame(bad, "row_id long, tokens array<string>"), v).collect()


def test_only_tokens_beyond_the_head_are_joined(spark, monkeypatch):
    """With a head of four short tokens: the same ids and texts, NULL tokens, NULL arrays, unknown
    tokens and carried columns, whether a token is in the head or not; the join gets the others only."""
    from pyspark.sql import functions as F
    from babelqa.operators import vocab as VC
    monkeypatch.setattr(VC, "HEAD", 4)
    written = {}
    monkeypatch.setattr(VC, "measured", lambda df, name, f=VC.measured: written.update({name: f(df, name)}) or written[name])
    long = "x" * 100
    rows = [(1, list("aaabbccde")), (2, []), (3, None), (4, [long] * 5 + ["f", None, "a"]), (5, [None]), (6, ["zz", "a", "b"])]
    df = spark.createDataFrame([(k, t, f"c{k}") for k, t in rows], "row_id long, tokens array<string>, c string")
    v = VC.build_vocab(df.where("row_id <> 6"))
    table = {r.token: r.id for r in v.collect()}
    assert table[long] == 0 and table["a"] == 1 and sorted(table.values()) == list(range(len(table)))
    e = VC.encode_tokens(df, v, carry=("c",))
    want = {k: [None if t is None else table.get(t) for t in tokens or []] for k, tokens in rows}
    assert {r.row_id: r.ids for r in e.collect()} == want
    assert {r.row_id: r.c for r in e.collect()} == {k: f"c{k}" for k, _ in rows} and dict(e.dtypes)["ids"] == "array<int>"
    rest = [m.token for r in written["token-ids"].collect() for m in r["_e"].rest]
    assert not {"a", "b"} & set(rest) and rest.count(long) == 5
    whole = e.where("row_id in (1, 2, 3)")
    assert {r.row_id: r.text for r in VC.decode_tokens(whole, v).collect()} == {1: "a a a b b c c d e", 2: "", 3: ""}
    skip = [table["a"], table["d"], 10 ** 9]
    got = VC.decode_tokens(whole.withColumn("ids", F.array_append("ids", F.lit(10 ** 9))), v, skip_ids=skip, sep="-").collect()
    assert {r.row_id: r.text for r in got} == {1: "b-b-c-c-e", 2: "", 3: ""}
    with pytest.raises(Exception, match="id without a token: NULL"):
        VC.decode_tokens(e.where("row_id = 6"), v).collect()
    twice = df.where("row_id = 1").unionByName(df.where("row_id = 1"))
    with pytest.raises(Exception, match="NULL or repeated"):
        VC.encode_tokens(twice, v).collect()


def test_split_words_and_counts_equal_the_column_expressions(spark):
    from babelqa.constants import PY_WHITESPACE
    from babelqa.functions import text as TX
    from babelqa.operators import vocab as VC
    texts = [None, "", " ", "a", " a  b ", "日\u3000本 x", *(f"{w}a{w}{w}b" for w in PY_WHITESPACE), "a\u200bb\ufeff c\u180e"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, text string")
    x = df.select("k", VC.split_words("text").alias("tokens"), TX.words("text").alias("t"))
    assert all(r.tokens == r.t for r in x.collect())
    tokens = spark.createDataFrame([(["a", None, "b"],), ([],), (None,), (["a", None],)], "tokens array<string>")
    assert {r.token: r.cnt for r in VC.count_tokens(tokens).collect()} == {"a": 2, None: 2, "b": 1}


def test_rouge_pipeline_matches_python(spark):
    import re
    from babelqa.functions.porter import stem
    from babelqa.operators.records import clean_generation
    from conftest import SF001

    def toks(s):
        return [stem(t) if len(t) > 3 else t for t in re.findall(r"[a-z0-9]+", s.lower())]

    def f(o, p, r):
        if p == 0 or r == 0:
            return 0.0
        pp, rr = o / p, o / r
        return 2 * pp * rr / (pp + rr) if pp + rr > 0 else 0.0

    ans = clean_generation(FX.gen(spark, SF001))
    got = {r.row_id: r for r in SC.rouge_score(ans, "output", "gen_answer").collect()}
    for r in ans.collect():
        g, ref = toks(r.gen_answer), toks(r.output)
        o = sum((Counter(g) & Counter(ref)).values())
        l1, ll = f(o, len(g), len(ref)), f(dp_lcs(g, ref), len(g), len(ref))
        mine = got[r.row_id]
        assert (mine.rouge1_f1, mine.rougeL_f1, mine.score) == (round(l1, 4), round(ll, 4), round(l1 * .5 + ll * .5, 4))
