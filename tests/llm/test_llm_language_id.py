import zlib

import numpy as np
from pyspark.sql import functions as F

from babelqa.llm import language_id as L
from conftest import SF01
from llm_cases import documents

SYLLABLES = {"en": "the ing and tion er ou", "de": "sch ung ein ich ber keit", "fr": "eau oui les ment que tre",
             "es": "cion los ado que rr ez", "xx": "zq wk jx qq zz kw"}


def texts(n, seed=0):
    rng = np.random.default_rng(seed)
    langs = list(SYLLABLES)
    out, names = [], []
    for k in range(n):
        lang = langs[k % len(langs)]
        parts = SYLLABLES[lang].split()
        out.append(" ".join("".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(4, 60))))
        names.append(lang)
    return out, names


def test_held_out_accuracy_and_defined_cases(spark):
    body, names = texts(300)
    odd = [None, "", "123 456 !?", "日本語 の テキスト", "the " * 40_000]
    docs = documents(spark, body + odd, langs=names + ["en", None, "de", None, None], clash=True)
    rows = {r.doc_id: r for r in L.predict_documents(docs).collect()}
    assert len(rows) == 305
    held = [k for k in rows if rows[k].held_out]
    assert sorted(held) == [k for k in range(305) if zlib.crc32(str(k).encode()) % 4 == 2]
    judged = [k for k in held if k < 300]
    assert np.mean([rows[k].lang_pred == names[k] for k in judged]) >= 0.97
    for k in (300, 301, 302):
        assert (rows[k].lang_pred, rows[k].score) == ("und", 0.0)
    assert rows[303].lang_pred in SYLLABLES and rows[304].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_predictions_ignore_the_labels_of_held_out_rows(spark):
    body, names = texts(120)
    wrong = [n if zlib.crc32(str(k).encode()) % 4 != 2 else "xx" for k, n in enumerate(names)]
    one = sorted(map(tuple, L.predict_documents(documents(spark, body, langs=names)).collect()))
    two = sorted(map(tuple, L.predict_documents(documents(spark, body, langs=wrong)).collect()))
    assert one == two


def test_sample_is_bounded_and_does_not_depend_on_the_layout(spark):
    body, names = texts(200)
    docs = documents(spark, body + body[:50], ids=[*range(200), *range(50)], langs=names + names[:50])
    labelled = F.lit(True)
    x, langs = L.training_rows(docs, labelled)
    y, again = L.training_rows(docs.repartition(7), labelled)
    assert langs == again and np.array_equal(x, y) and len(langs) == 200        # equal rows are drawn once
    few = L.training_rows(docs, labelled, bound=10)[1]
    assert 0 < len(few) < 100
    many = documents(spark, body, langs=[f"x{k}" for k in range(200)])
    assert len(L.training_rows(many, labelled)[1]) == 200 and 0 < len(L.training_rows(many, labelled, total=40)[1]) < 80


def test_nothing_to_learn_from_one_language_no_rows(spark):
    rows = L.predict_documents(documents(spark, ["the and", None], langs=[None, None])).collect()
    assert {(r.lang_pred, r.score) for r in rows} == {("und", 0.0)}
    rows = L.predict_documents(documents(spark, ["the and"] * 8, langs=["en"] * 8)).collect()
    assert {r.lang_pred for r in rows} == {"en"} and L.predict_documents(documents(spark, [])).count() == 0


def test_stage_keeps_all_but_unknown(spark):
    body, names = texts(40)
    docs = documents(spark, body + [None, "42", body[0]], ids=[*range(40), 40, None, 0], langs=names + [None, "en", None], clash=True)
    got = L.keep_identified(docs)
    assert got.columns == docs.columns and got.count() == 41
    assert {r.lang for r in got.where("doc_id = 0").collect()} == {"en"}


def test_long_texts_are_read_in_blocks():
    text = ("the quick brown fox " * 80_000).encode()
    at = np.array([0, len(text)])
    whole = L.features(np.frombuffer(text, np.uint8), at)
    again = L.features(np.frombuffer(text + b"zz", np.uint8), at)
    assert len(text) > 1 << 20 and np.array_equal(whole, again)
    # window counts do not depend on the blocks
    x = L.FOLD[np.frombuffer(text, np.uint8)].astype(np.uint32)
    counts, mixed = np.zeros(L.FEATURES), np.zeros(len(x), np.uint32)
    for n in range(1, 5):
        mixed = (mixed[:len(x) - n + 1] * np.uint32(0x01000193)) ^ x[n - 1:]
        counts += np.bincount(((mixed + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=L.FEATURES)
    assert np.allclose(whole[0], np.sqrt(counts) / np.linalg.norm(np.sqrt(counts)), atol=1e-6)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    rows = L.predict_documents(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) >= 0.98
