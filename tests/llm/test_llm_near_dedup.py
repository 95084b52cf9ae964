import re
import random
from itertools import combinations

import pytest

from babelqa.llm import near_dedup as N
from babelqa.llm.graph import components
from llm_cases import documents, odd_texts, words


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def brute(ids, texts, width):
    sets = [shingles(x, width) for x in texts]
    top = list(range(len(ids)))

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in combinations(range(len(ids)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            top[root(a)] = root(b)
    groups = {}
    for a in range(len(ids)):
        groups.setdefault(root(a), []).append(ids[a])
    out = []
    for a, i in enumerate(ids):
        low = min((x for x in groups[root(a)] if x is not None), default=None)
        c = low if sets[a] else i
        out.append((i, len(sets[a]), c, i == c))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.drop("t").collect()), key=str)


def edited(base, n, seed):
    rng, w = random.Random(seed), list(base)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("width", [2, 5])
def test_groups_equal_brute_force(spark, width):
    base = [words(k, 120) for k in range(3)]
    # one large group around a base, whose members are partly under 0.8 among themselves
    texts = [edited(base[0], k % 12, 100 + k) for k in range(60)]
    texts += [edited(base[1], k, k) for k in range(8)] + [" ".join(base[2])] * 4 + [" ".join(words(k, 60)) for k in range(20)]
    chain = list(base[1])
    for k in range(6):      # each similar to its neighbours only
        chain[k * 4:k * 4 + 4] = [f"c{k}{j}" for j in range(4)]
        texts.append(" ".join(chain))
    texts += odd_texts() + ["A  b\tC", "a b c", "One", "one"]
    ids = [1000 - 3 * k for k in range(len(texts))]
    docs = documents(spark, texts, ids, clash=True)
    assert found(N.near_duplicates(docs, width=width)) == brute(ids, texts, width)


def test_block_comparison_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "QUERY_BLOCK", 3)
    monkeypatch.setattr(N, "MEMBER_BLOCK", 4)
    base = words(5, 80)
    texts = [edited(base, k % 9, k) for k in range(40)]
    assert found(N.near_duplicates(documents(spark, texts), width=2)) == brute(list(range(40)), texts, 2)


def test_repeated_rows_null_ids_and_no_rows(spark):
    a, b = " ".join(words(1, 50)), " ".join(words(2, 50))
    docs = documents(spark, [a, a, a, b, b, None, None], [5, 5, None, None, None, None, 7])
    got = N.near_duplicates(docs)
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got.collect()))) == sorted(map(str, [
        (5, 5, True), (5, 5, True), (None, 5, False), (None, None, True), (None, None, True), (None, None, True),
        (7, 7, True)]))
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == sorted(
        [("5", a), ("None", b), ("None", b), ("None", "None"), ("7", "None")])
    none = documents(spark, [])
    assert N.near_duplicates(none).count() == 0 and N.keep_one_of_each(none).count() == 0


def test_large_sides_are_joined_in_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "WANTED_ROWS", 0)
    from babelqa.llm import common
    monkeypatch.setattr(common.small_side, "__defaults__", (0,))
    base = words(5, 80)
    texts = [edited(base, k % 5, k) for k in range(12)]
    docs = documents(spark, texts, clash=True)
    assert found(N.near_duplicates(docs, width=2)) == brute(list(range(12)), texts, 2)
    assert N.keep_one_of_each(docs, width=2).count() == sum(r[3] for r in brute(list(range(12)), texts, 2))


def test_signature_estimates_jaccard():
    import numpy as np
    rng = np.random.default_rng(3)
    make, errors = N.circulant(160), []
    for _ in range(30):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (600, 100, 50))
        x, y = make.signature(np.concatenate([both, a])), make.signature(np.concatenate([both, b]))
        errors.append((x == y).mean() - 600 / 750)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 40), (40, 60), (99, 99)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {**{k: 0 for k in range(21)}, 40: 40, 50: 40, 60: 40}


def under_the_limit(seed, size, members):
    """One query set and members whose Jaccard with it is slightly under or at 0.8."""
    import numpy as np
    rng = np.random.default_rng(seed)
    own = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
    out = []
    for k in range(members):
        swapped = len(own) // 9 + 1 - (k % 5 == 4)     # 8/10 of the union stays at size/9 swapped
        keep = rng.permutation(own)[swapped:]
        out.append(np.unique(np.concatenate([keep, rng.integers(0, 2**63, swapped).astype(np.uint64)])))
    return own, out


@pytest.mark.parametrize("size", [50, 100, 200])
def test_block_comparison_is_exact_slightly_under_the_limit(spark, size):
    rows, expected = [], set()
    for hub in range(40):
        own, members = under_the_limit(hub, size, 1 + hub % 20)
        rows.append((hub, 0, 0, True, hub * 100, own.tobytes()))
        for k, s in enumerate(members):
            comp = hub * 100 + k + 1
            rows.append((hub, 0, 0, False, comp, s.tobytes()))
            both = len(set(own.tolist()) & set(s.tolist()))
            if 5 * both >= 4 * (len(own) + len(s) - both):
                expected.add((hub * 100, comp))
    df = spark.createDataFrame([(*r[:5], bytearray(r[5])) for r in rows],
                               "hub long, part_q int, part_m int, query boolean, comp long, members binary")
    blocks = df.repartition(3, "hub").sortWithinPartitions("hub", "query")
    got = {tuple(r) for r in N.compare_blocks(blocks, N.SIMILARITY).collect()}
    assert got == expected
