import random
import re
from hashlib import sha256

import numpy as np
import pytest

from babelqa.llm import fill_middle as M
from llm_cases import documents, odd_texts, words

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """The contract, on a list of units."""
    text = text or ""
    units = UNIT.findall(text)
    h = sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k:k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}"
    return len(units), "psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}"


def cases():
    texts = [f"{' ' * (k % 3)}{' '.join(words(k, k % 40 + 1))}{' \n' * (k % 2)}" for k in range(60)]
    return texts + odd_texts() + ["a <P> b c d", "x<S>", "<M>", "<S <P <M < S> <<P", "\x0b\x0c\r", "é ß  ü", "😀 😀😀\t😀"] * 6


def test_equals_brute_force_and_restores(spark):
    texts = cases()
    docs = documents(spark, texts, clash=True)
    got = {r.doc_id: tuple(r)[1:] for r in M.fill_in_middle(docs).collect()}
    assert got == {k: brute(k, x) for k, x in enumerate(texts)}
    assert {g[1] for g in got.values()} == {"plain", "psm", "spm"}
    for r in M.digest(docs).collect():
        assert r.restored_sha256 == sha256((texts[r.doc_id] or "").encode()).hexdigest()
        assert r.output_sha256 == sha256(got[r.doc_id][4].encode()).hexdigest()


def test_every_text_cut_or_none(spark):
    docs = documents(spark, cases())
    assert {r.form for r in M.fill_in_middle(docs, rate=0).collect()} == {"plain"}
    forms = {r.form for r in M.fill_in_middle(docs.where("text NOT RLIKE '<[PSM]>' AND text <> ''"), rate=100, spm_rate=0).collect()}
    assert forms == {"psm"}


def test_repeated_rows_null_ids_no_rows(spark):
    rows = sorted(map(tuple, M.fill_in_middle(documents(spark, ["a b c"] * 4, [3, 3, None, None])).collect()), key=str)
    assert rows[0] == rows[1] and rows[2] == rows[3] and rows[2][1:] == brute(None, "a b c")
    assert M.digest(documents(spark, [])).count() == 0


@pytest.mark.parametrize("kind,offsets", [
    ("array", np.arange(7, 60_000, 31)), ("bitmap", np.array(sorted(random.Random(1).sample(range(65_536), 9000)))),
    ("run", np.r_[10:5000, 6000:60_000]), ("array", np.array([65_535])), ("run", np.r_[0:65_536])])
def test_containers_select(kind, offsets):
    cuts = M.BoundarySet(offsets.astype(np.int64))
    assert [c[0] for c in cuts.containers] == [kind] and len(cuts) == len(offsets)
    assert [cuts.select(k) for k in range(len(offsets))] == offsets.tolist()


def test_select_over_many_containers():
    rng = random.Random(4)
    offsets = np.array(sorted({*rng.sample(range(400_000), 2000), *range(70_000, 130_000), *rng.sample(range(140_000, 190_000), 20_000)}), np.int64)
    cuts = M.BoundarySet(offsets)
    assert {c[0] for c in cuts.containers} == {"array", "bitmap", "run"}
    assert [cuts.select(k) for k in range(0, len(offsets), 7)] == offsets[::7].tolist()
    for k in (-1, len(offsets)):
        with pytest.raises(IndexError):
            cuts.select(k)
    assert len(M.BoundarySet(np.empty(0, np.int64))) == 0
