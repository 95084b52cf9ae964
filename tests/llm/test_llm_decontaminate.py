import random
import re

import pytest

from babelqa.llm import decontaminate as D
from llm_cases import documents, odd_texts, words


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


MASKS = [[k for k in range(12) if k % 4 not in pair] for pair in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]


def agrees(same, a, span):
    """Some range that holds the span agrees in 80 percent: all ranges are tried."""
    n = len(same)
    return any(100 * sum(same[i:j]) >= 80 * (j - i) for i in range(a + 1) for j in range(a + span, n + 1))


def brute(docs, items):
    """(doc_id, item_id, n_hits, matched, first_word) by walking every diagonal."""
    out = []
    for d, text in {(d, x or "") for d, x in docs}:
        h = tokens(text)
        for i, g in {(i, tuple(tokens(item))) for i, item in items}:
            hits, span = {}, min(12, len(g))
            if len(g) < 5:
                continue
            masks = MASKS if len(g) >= 12 else [[k for k in range(span) if k != skip] for skip in range(span)]
            for p in range(len(h) - span + 1):
                for q in range(len(g) - span + 1):
                    if any(all(h[p + k] == g[q + k] for k in m) for m in masks):
                        a, b = min(6, p, q), min(6, len(h) - p - span, len(g) - q - span)
                        same = [h[p + k] == g[q + k] for k in range(-a, span + b)]
                        whole = 100 * sum(same) >= (100 if span < 12 else 80) * len(same)
                        if whole or agrees(same, a, span):
                            hits[p, q] = whole, sum(same)
            if any(w for w, _ in hits.values()):
                hits = {k: v for k, v in hits.items() if v[0]}
            if hits:
                out.append((d, i, len(hits), max(m for _, m in hits.values()), min(p for p, _ in hits)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed_rows", [D.SEED_ROWS, 0])
def test_equals_brute_force(spark, seed_rows):
    passages = [words(k, 30) for k in range(6)]
    changed = [list(p) for p in passages]
    for p in changed:
        p[7] = p[19] = "other"
    texts = [" ".join(words(50 + k, 40) + (passages + changed)[k % 12] + words(90 + k, 10)) for k in range(24)]
    texts += [" ".join(passages[0][:12]).upper() + ".", " ".join(passages[1][5:16]), "five words are enough here"]
    texts += [texts[0], texts[0]] + [x for x in odd_texts() if x is None or len(x) < 3000]
    ids = [None if k % 7 == 3 else k for k in range(len(texts))]
    ids[-1] = ids[0]
    items = [(k, " ".join(p)) for k, p in enumerate(passages)]
    items += [(70, items[0][1]), (71, None), (72, ""), (73, "Five words, are enough here!"), (74, "too short"), (None, items[2][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, texts, ids, clash=True)
    got = D.contaminated(docs, bench, seed_rows=seed_rows)
    assert sorted(map(tuple, got.drop("t").collect()), key=str) == brute(list(zip(ids, texts)), items)


def test_plan_is_native(spark):
    bench = spark.createDataFrame([(1, " ".join(words(1, 30)))], "item_id long, text string")
    plan = D.contaminated(documents(spark, ["a"]), bench)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "Cartesian" not in plan


def test_stage_drops_contaminated_documents(spark):
    item = " ".join(words(3, 25))
    texts = ["clean " * 5, f"before {item} behind", None, "", item]
    docs = documents(spark, texts, [1, 1, None, 4, None], clash=True)
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = D.without_contamination(docs, bench)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == [("1", "clean " * 5), ("4", ""), ("None", "None")]
    empty = bench.limit(0)
    assert D.without_contamination(docs, empty).count() == 5 and D.contaminated(documents(spark, []), bench).count() == 0


def by_item(rows):
    """Rows of the texts of one item id joined into one, as the SQL groups them."""
    out = {}
    for d, i, n, m, first in rows:
        n0, m0, f0 = out.get((d, i), (0, 0, first))
        out[d, i] = (n0 + n, max(m0, m), min(f0, first))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


@pytest.mark.parametrize("seed_rows", [D.SEED_ROWS, 0])
def test_item_ids_with_several_texts(spark, seed_rows):
    one, two, other, short = words(1, 40), words(2, 14), words(3, 60), words(4, 7)
    fooled = other[:20] + two + other[20:]      # holds the second text only
    items = [(5, " ".join(one)), (5, " ".join(two)), (None, " ".join(other)), (None, " ".join(two)), (None, " ".join(short)),
             (5, " ".join(one[:20] + two[:5])), (6, " ".join(two))]
    # six words of the long text at its end: no hit; against a shorter text n would not be above 0
    near = one[:26] + [w if bit == "1" else f"x{k}" for k, (w, bit) in enumerate(zip(one[26:38], D.SEEDS[0]))]
    texts = [" ".join(x) for x in (one, fooled, two, short + words(9, 9), words(8, 30) + near[26:] + words(7, 30), near)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(documents(spark, texts), bench, seed_rows=seed_rows)
    assert sorted(map(tuple, got.drop("t").collect()), key=str) == by_item(brute(list(enumerate(texts)), items))


@pytest.mark.parametrize("seed_rows", [D.SEED_ROWS, 0])
def test_short_excerpts_and_short_items(spark, seed_rows):
    item, short = words(1, 60), words(2, 7)
    around = lambda k, part: " ".join(words(100 + k, 30, 10**6) + part + words(200 + k, 30, 10**6))
    texts = [around(n, item[20:20 + n]) for n in range(12, 20)]          # 0 to 7: excerpts of 12 to 19 words
    one_off = [" ".join(short[:k] + ["other"] + short[k + 1:]) for k in range(7)]
    texts += [around(50 + k, x.split()) for k, x in enumerate(one_off)]   # 8 to 14: one word changed
    texts += [around(70, short[:3] + ["x", "y"] + short[5:]), around(71, item[20:29]), around(72, words(9, 40))]
    texts += [around(73, short) + " " + one_off[2]]                       # the exact place alone counts
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in D.contaminated(documents(spark, texts), bench, seed_rows=seed_rows).collect()}
    assert set(got) == {(k, 1) for k in range(8)} | {(k, 2) for k in range(8, 15)} | {(18, 2)}
    assert all(28 <= got[k, 1].first_word <= 30 for k in range(8))     # a span may take in two other words
    assert all((got[k, 2].n_hits, got[k, 2].matched, got[k, 2].first_word) == (1, 6, 30) for k in range(8, 15))
    assert (got[18, 2].n_hits, got[18, 2].matched) == (1, 7)


def test_masks_ignore_any_two_places():
    assert len(D.SEEDS) == 6 and [[k for k, bit in enumerate(m) if bit == "1"] for m in D.SEEDS] == MASKS
    for a in range(12):
        for b in range(12):
            assert any(m[a] == m[b] == "0" for m in D.SEEDS)


@pytest.mark.parametrize("changed", [1, 2])
def test_recall_under_changed_words(spark, changed):
    """Items of 12 to 40 words with one and with two words changed anywhere, in other prose."""
    rng, texts, items, n = random.Random(changed), [], [], 0
    for size in (12, 13, 16, 24, 40):
        for _ in range(40):
            item = words(1000 + n, size, 10**6)
            copy = list(item)
            for k in rng.sample(range(size), changed):
                copy[k] = "zebra"
            texts.append(" ".join(words(5000 + n, 25, 10**6) + copy + words(9000 + n, 25, 10**6)))
            items.append((n, " ".join(item)))
            n += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents(spark, texts), bench).collect()}
    assert got <= {(k, k) for k in range(n)} and len(got) >= 0.9 * n
    by_size = [sum((k, k) in got for k in range(40 * j, 40 * j + 40)) for j in range(5)]
    assert min(by_size) >= 36, by_size


def test_one_pass_over_the_texts_for_all_lengths(spark):
    items = [(n, " ".join(words(n, n))) for n in (5, 6, 7, 8, 9, 10, 11, 12, 30)]
    docs = documents(spark, [" ".join(words(n, n) + words(99, 5)) for n, _ in items])
    plan = D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"LogicalRDD \[doc_id", plan)) == 1
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(k, n) for k, (n, _) in enumerate(items)} <= got


@pytest.mark.parametrize("seed_rows", [D.SEED_ROWS, 0])
def test_long_documents_full_of_items(spark, seed_rows):
    """174,000 seeds of the first document are found: each must not hold its 40,000 words again."""
    item, short = [f"w{k}" for k in range(40)], [f"s{k}" for k in range(7)]
    texts = [" ".join(item * 1000), " ".join(f"x{k}" for k in range(40_000)), " ".join(["y"] * 9000 + short)]
    bench = spark.createDataFrame([(k, " ".join(item)) for k in range(3)] + [(9, " ".join(short))], "item_id long, text string")
    got = D.contaminated(documents(spark, texts), bench, seed_rows=seed_rows).drop("t").collect()
    assert sorted(map(tuple, got)) == [(0, k, 29_000, 24, 0) for k in range(3)] + [(2, 9, 1, 7, 9000)]


@pytest.mark.parametrize("seed_rows", [D.SEED_ROWS, 0])
@pytest.mark.parametrize("piece", [12, 13])
def test_pieces_of_documents_and_items(spark, monkeypatch, piece, seed_rows):
    monkeypatch.setattr(D, "PIECE", piece)
    long, short = words(1, 45), words(2, 7)
    near = long[:9] + ["x"] + long[10:20] + ["y", "z"] + long[22:]
    texts = [" ".join(words(100 + k, k) + (long, near, short, long[k:k + 14])[k % 4] + words(200 + k, k % 9)) for k in range(28)]
    items = [(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(long)), (None, " ".join(short)), (2, " ".join(near[5:30]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(documents(spark, texts), bench, seed_rows=seed_rows)
    assert sorted(map(tuple, got.drop("t").collect()), key=str) == by_item(brute(list(enumerate(texts)), items))
