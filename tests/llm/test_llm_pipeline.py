"""The stages in order, against their brute-force statements, on a corpus with planted cases."""

import re

import corpus_pipeline as C
import pytest
from babelqa.llm.queries import public_tokenizer
from llm_cases import DOCS, words
from test_llm_decontaminate import brute as contaminated
from test_llm_near_dedup import brute as grouped
from test_llm_near_dedup import edited
from test_llm_packing import check_pieces
from test_llm_suffix_dedup import brute_marks

pytest.importorskip("public_tokenizers")


def corpus():
    texts = [" ".join(words(k, 80)) for k in range(30)]
    shared = " ".join(words(500, 60))
    item = " ".join(words(600, 30))
    texts += [texts[0], edited(words(1, 80), 1, 9), f"{texts[2]} {shared} {texts[3][:200]}x", f"{' '.join(words(700, 70))} {shared}",
              f"{' '.join(words(701, 50))} {item} {' '.join(words(702, 20))}", None, "", "12 34", shared * 2, "tiny text"]
    return texts, item


def test_stages(spark, tmp_path):
    texts, item = corpus()
    rows = [(k, x, "en" if k % 2 else None, "s", len(x or "")) for k, x in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    given = {r[0]: r[1] for r in rows}

    step = C.language_id(spark, docs, str(tmp_path))
    assert step.columns == docs.columns
    left = {k: x for k, x in given.items() if re.search(r"[^\W\d_]", x or "")}
    assert {r.doc_id: r.text for r in step.collect()} == left

    step = C.near_dedup(spark, step, str(tmp_path))
    kept = {i for i, _, _, keep in grouped(list(left), list(left.values()), 5) if keep}
    assert 30 not in kept and 31 not in kept
    left = {k: x for k, x in left.items() if k in kept}
    assert {r.doc_id: r.text for r in step.collect()} == left

    step = C.suffix_dedup(spark, step, str(tmp_path))
    raws, marks = brute_marks(list(left.values()))
    left = {k: bytes(x for x, gone in zip(b, m) if not gone).decode("utf-8", "ignore") for k, b, m in zip(left, raws, marks)}
    left = {k: x for k, x in left.items() if re.search(r"\S", x)}
    assert {r.doc_id: (r.text, r.n_chars) for r in step.collect()} == {k: (x, len(x)) for k, x in left.items()}

    step = C.decontamination(spark, step, str(tmp_path))
    bad = {r[0] for r in contaminated(list(left.items()), [(1, item)])}
    assert bad == {34}
    left = {k: x for k, x in left.items() if k not in bad}
    assert {r.doc_id: r.text for r in step.collect()} == left and step.columns == docs.columns

    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    ids = {k: whole.encode(x, add_special_tokens=False).ids + [1] for k, x in left.items()}
    assert check_pieces(C.packing(spark, step, str(tmp_path)).collect(), ids, (2048, 128, 2048)) == 0
    assert check_pieces(C.run(spark, str(tmp_path)).collect(), ids, (2048, 128, 2048)) == 0


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_registry():
    from babelqa.llm.queries import ORACLE, QUERIES
    numbered = sorted(int(m[1]) for k in QUERIES if (m := re.match(r"op(\d+)_", k)))
    assert numbered == list(range(1, 14)) and len(QUERIES) == 14 and "pack_conversations" in QUERIES
    assert set(ORACLE) <= set(QUERIES) and [n for n, _ in C.STAGES] == [
        "language_id", "near_dedup", "suffix_dedup", "decontamination", "packing"]
