import zlib

import numpy as np
from pyspark.sql import functions as F

from babelqa.llm import quality_rules as Q
from conftest import SF01
from llm_cases import documents, odd_texts, words


def given(n):
    """Good prose, and three kinds of junk."""
    texts, good = [], []
    for k in range(n):
        w = words(k, 30 + k % 90)
        junk = [None, " ".join(x.upper() + "!!" for x in w), " ".join(x + "###" for x in w), " ".join(w[:2] * 40)][k % 4 if k % 2 else 0]
        texts.append(junk or " ".join(w))
        good.append(int(junk is None))
    return texts, good


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("x", F.lit("clash")).repartition(2)


def test_held_out_ranking_and_odd_texts(spark):
    texts, good = given(400)
    odd = odd_texts()
    docs = documents(spark, texts + odd, clash=True)
    rows = Q.score_documents(docs, labels(spark, [(k, g, None) for k, g in enumerate(good)] + [(400, None, 0), (None, 1, 1)])).collect()
    assert sorted(r.doc_id for r in rows) == list(range(400 + len(odd)))
    by = {r.doc_id: r for r in rows}
    held = [k for k in by if by[k].held_out]
    assert sorted(held) == [k for k in sorted(by) if zlib.crc32(str(k).encode()) % 5 == 0]
    assert np.mean([by[k].predicted == good[k] for k in held if k < 400]) >= 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert by[400].score == by[401].score            # null and empty


def test_labels_of_held_out_rows_teach_nothing(spark):
    texts, good = given(120)
    docs = documents(spark, texts)
    wrong = [(k, g if zlib.crc32(str(k).encode()) % 5 else 1 - g, 0) for k, g in enumerate(good)]
    one = Q.score_documents(docs, labels(spark, [(k, g, 0) for k, g in enumerate(good)])).collect()
    two = Q.score_documents(docs.withColumn("lang", F.lit("zz")).repartition(5), labels(spark, wrong)).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_nothing_to_learn_one_kind_no_rows(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in Q.score_documents(docs, none).collect()} == {(0.5, 1)}
    bad = Q.score_documents(docs, labels(spark, [(0, 0, 0), (1, 0, 0)])).collect()
    assert len({r.score for r in bad}) == 1 and bad[0].score < 0.5
    assert Q.score_documents(documents(spark, []), none).count() == 0


def test_repeated_rows_and_null_ids(spark):
    texts, good = given(60)
    docs = documents(spark, texts + texts[:5] + texts[:2], [*range(60), *range(5), None, None])
    rows = Q.score_documents(docs, labels(spark, [(k, g, 0) for k, g in enumerate(good)] * 2)).collect()
    score = {k: {r.score for r in rows if r.doc_id == k} for k in range(5)}
    assert len(rows) == 67 and all(len(s) == 1 for s in score.values())
    assert sorted(r.score for r in rows if r.doc_id is None) == sorted(s for k in (0, 1) for s in score[k])
    assert not any(r.held_out for r in rows if r.doc_id is None)


def test_sample_is_bounded(spark):
    texts, good = given(80)
    docs = documents(spark, texts * 3, list(range(80)) * 3).select("doc_id", "text")
    seen = []
    original, Q.fit = Q.fit, lambda x, y: seen.append(len(y)) or original(x, y)
    try:
        Q.learned(docs, labels(spark, [(k, g, 0) for k, g in enumerate(good)]), F.lit(True), bound=25)
    finally:
        Q.fit = original
    assert seen == [25]


def test_compiled_rules_equal_the_model(spark):
    texts, good = given(300)
    docs = documents(spark, texts).select("doc_id", "text")
    rows = Q.with_statistics(docs, "text", ["doc_id"]).orderBy("doc_id").collect()
    x = np.array([r.x for r in rows])
    model = Q.fit(x, np.array(good, float))
    assert 0 < len(model.rules) < 200 and all(1 <= len(r.conditions) <= Q.DEPTH for r, _ in model.rules)
    want = 1 / (1 + np.exp(-(model.bias + sum(w * r.holds(x) for r, w in model.rules))))
    got = Q.with_statistics(docs, "text", ["doc_id"]).select("doc_id", model.column().alias("s")).orderBy("doc_id").collect()
    assert np.allclose([r.s for r in got], want)


def test_statistics_by_hand(spark):
    row = Q.with_statistics(documents(spark, ["Ab ab  12 $$.\nab ab\nÄé\t1"]), "text", ["doc_id"]).first()
    x = dict(zip(Q.NAMES, row.x))
    assert (x["chars"], x["words"], x["symbols"], x["stops"]) == (24, 8, 2 / 24, 1 / 8)
    assert (x["letters"], x["upper"], x["digits"]) == (10 / 24, 2 / 10, 3 / 24)
    assert (x["line_words"], x["repeated_lines"], x["repeated_words"], x["stuttered_words"]) == (8 / 3, 0, 1 - 6 / 8, 1 / 8)
    assert (x["short_words"], x["long_words"]) == (1.0, 0.0)


def test_lasso_drops_idle_rules():
    rng = np.random.default_rng(0)
    z = (rng.random((2000, 12)) < 0.4).astype(float)
    y = (rng.random(2000) < 1 / (1 + np.exp(-(4 * z[:, 0] - 3 * z[:, 1])))).astype(float)
    w, _ = Q.lasso(z, y, penalty=0.02)
    assert w[0] > 1 and w[1] < -1 and (np.abs(w[2:]) < 0.2).all() and (w[2:] == 0).sum() >= 7


def test_given_documents(spark):
    docs, marks = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.score_documents(docs, marks).join(marks, "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in rows if r.quality == q] for q in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) >= 0.97
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
