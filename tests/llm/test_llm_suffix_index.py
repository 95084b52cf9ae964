import numpy as np
import pytest

from babelqa.llm import suffix_index as I
from babelqa.llm.suffix_dedup import WINDOW, removed_spans, text_keys
from llm_cases import documents, words
from test_llm_suffix_dedup import brute_marks, corpus


def parts():
    """Four batches, of unequal size, that share passages, copies and near copies."""
    texts = corpus()
    return [texts[:9], texts[9:16] + texts[:2], texts[16:30], texts[30:] + texts[12:14] + [None, ""]]


def marks_of(rows, texts):
    raws = [(x or "").encode() for x in texts]
    found = {(r.t, r.size): r.places for r in rows}
    out = []
    for b in raws:
        m = bytearray(len(b))
        t = int(text_keys(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[0])
        if (t, len(b)) in found:
            for low, high in removed_spans(np.array(found[t, len(b)]), WINDOW).tolist():
                m[low:high] = b"\1" * (high - low)
        out.append(m)
    return out


@pytest.mark.parametrize("group", [2000, 0])
def test_each_batch_equals_brute_force_over_all_so_far(spark, scratch, group):
    path, before = scratch("index"), []
    for k, texts in enumerate(parts()):
        index = I.SuffixIndex(spark, path, group=group)       # a new session would find the same
        rows = index.add(documents(spark, texts, clash=True), f"b{k}").collect()
        assert marks_of(rows, texts) == brute_marks(before + texts)[1][len(before):], k
        before += texts
    sizes = [n.bit_length() for n in index.level_sizes()]
    assert sizes == sorted(set(sizes), reverse=True) and index.batches() == ["b0", "b1", "b2", "b3"]


def test_a_known_batch_changes_nothing(spark, scratch):
    index = I.SuffixIndex(spark, scratch("index"))
    shared = " ".join(words(3, 60))
    first = documents(spark, [shared, "x"])
    assert index.add(first, "a").count() == 0
    sizes = index.level_sizes()
    assert index.add(first, "a").count() == 0 and index.level_sizes() == sizes       # its own rows are no repeats
    assert index.add(first, "b").count() == 1


def test_a_batch_that_fails_is_added_again(spark, scratch, monkeypatch):
    index = I.SuffixIndex(spark, scratch("index"))
    shared = " ".join(words(4, 60))
    index.add(documents(spark, [shared]), "a")
    with monkeypatch.context() as m:
        m.setattr(I.FS, "create", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            index.add(documents(spark, [f"head {shared} tail"]), "b")
    assert index.batches() == ["a"] and len(index.level_sizes()) == 1
    got = index.add(documents(spark, [f"head {shared} tail"]), "b").collect()
    assert marks_of(got, [f"head {shared} tail"])[0].count(1) == len(shared.encode())
    assert index.clean() > 0 and index.places("b").count() == 1


def test_a_lost_race_sees_the_other_batch(spark, scratch, monkeypatch):
    path, shared = scratch("index"), " ".join(words(5, 60))
    one, other, create, raced = I.SuffixIndex(spark, path), I.SuffixIndex(spark, path), I.FS.create, []

    def beaten(*args):
        if not raced:
            raced.append(1)
            other.add(documents(spark, [shared]), "other")
        return create(*args)

    monkeypatch.setattr(I.FS, "create", beaten)
    assert one.add(documents(spark, [shared]), "one").count() == 1
    assert one.batches() == ["other", "one"]


def test_cut_keeps_columns(spark, scratch):
    index = I.SuffixIndex(spark, scratch("index"))
    shared = "ä" + " ".join(words(8, 50))
    index.add(documents(spark, [shared]), "a")
    docs = documents(spark, [f"head {shared} tail", None, "", "short"], clash=True)
    index.add(docs, "b")
    got = index.cut(docs, "b")
    assert got.columns == docs.columns
    assert {r.doc_id: (r.text, r.t) for r in got.collect()} == {
        0: ("head  tail", "xt"), 1: (None, "xt"), 2: ("", "xt"), 3: ("short", "xt")}


def test_no_rows_and_other_window(spark, scratch):
    path = scratch("index")
    index = I.SuffixIndex(spark, path)
    assert index.add(documents(spark, []), "none").count() == 0 and index.level_sizes() == []
    assert index.add(documents(spark, ["short", None]), "short").count() == 0 and index.batches() == ["none", "short"]
    with pytest.raises(ValueError):
        I.SuffixIndex(spark, path, window=100)
