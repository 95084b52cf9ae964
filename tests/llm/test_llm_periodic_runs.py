import random
from hashlib import sha256
from zlib import crc32

import pytest

from babelqa.llm import periodic_runs as P
from llm_cases import documents, odd_texts, words


def brute(w):
    """Runs by the definition: every period, every stretch; smaller periods win."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(6, 4 * q) and not any(s <= i and s + n >= i + size for s, n, _ in out):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def split(text):
    return (text or "").encode().split()


def runs_of(texts):
    block = P.Block()
    for w in texts:
        block.add([str(x).encode() for x in w], None)
    return [list(zip(s.tolist(), n.tolist(), q.tolist())) for _, s, n, q in block.runs()]


def sequence(rng):
    kind, k, n = rng.randrange(6), rng.choice([1, 2, 2, 3, 5, 30]), rng.randrange(120)
    w = []
    if kind == 0:
        return [rng.randrange(k) for _ in range(n)]
    if kind == 1:
        while len(w) < n:
            w += [rng.randrange(k) for _ in range(rng.randrange(1, 9))] * rng.randrange(1, 7)
        return w
    if kind == 2:
        u = [rng.randrange(k) for _ in range(rng.randrange(1, 25))]
        return [5] * rng.randrange(3) + u * rng.randrange(3, 8) + u[:rng.randrange(len(u) + 1)] + [rng.randrange(4) for _ in range(4)]
    if kind == 3:
        while len(w) < n:
            w += [0] * rng.randrange(1, rng.choice([4, 12, 40])) + [rng.randrange(1, 3)]
        return w
    if kind == 4:                                   # Fibonacci words are full of runs
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    u = [rng.randrange(3) for _ in range(rng.randrange(1, 6))] * rng.randrange(4, 7) + [9]
    return (u * rng.randrange(4, 6))[rng.randrange(5):]


@pytest.mark.parametrize("seed", range(8))
def test_equals_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [sequence(rng) for _ in range(rng.randrange(1, 12))]
        assert runs_of(texts) == [brute(w) for w in texts]


def test_long_periods_and_long_runs():
    rng = random.Random(3)
    u = [rng.randrange(1000) for _ in range(3000)]
    texts = [u * 4 + u[:100] + [-1], [7] * 50_000, [-1, *u[:700] * 5, *u[:650]], ([0] * 9 + [1]) * 900, u[:11]]
    nines = sorted([(0, 9000, 10), *((10 * k, 9, 1) for k in range(900))], key=lambda r: (r[0], r[2]))
    assert runs_of(texts) == [[(0, 12_100, 3000)], [(0, 50_000, 1)], [(1, 4150, 700)], nines, []]


def test_grammar_gives_the_text_back():
    """Each replaced place spans the same words as every other place of its nonterminal."""
    import numpy as np
    rng = random.Random(9)
    w = np.array(sequence(random.Random(1)) * 6 + [rng.randrange(40) for _ in range(400)] * 2)
    start, middle, end, name, top = P.repair(w, np.zeros(len(w), np.int64))
    spelt = {}
    for a, m, b, x in zip(start, middle, end, name):
        assert a < m < b and spelt.setdefault(x, w[a:b].tolist()) == w[a:b].tolist()
    assert len(top) < len(w) // 2 and top[0] == 0 and (np.diff(top) > 0).all()
    assert len(P.repair(np.empty(0, np.int64), np.empty(0, np.int64))[4]) == 0


def expected(doc_id, text):
    w = split(text)
    h = 1 if doc_id is None else crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = brute(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    top = min(runs, key=lambda r: (-(r[1] / r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_digest_and_odd_texts(spark, monkeypatch):
    texts = odd_texts()[:6] + odd_texts()[8:] + [" ".join(words(k, 200, 6)) for k in range(30)] + [
        "a\x0bb\x0cc\rd\te\nf " * 7, "x " * 6, "x " * 5, "ab  " * 9, "a b c d a b c d a b c d a b c d"]
    ids = [*range(len(texts) - 2), None, 0]
    got = sorted((tuple(r) for r in P.run_digest(documents(spark, texts, ids, clash=True)).collect()), key=str)
    assert got == sorted(((k, *expected(k, x)) for k, x in zip(ids, texts)), key=str)
    assert any(crc32(str(k).encode()) % 10 == 0 for k in range(len(texts) - 2))


def test_blocks_do_not_matter_and_no_rows(spark, monkeypatch):
    texts = [" ".join(words(k, 120, 3)) for k in range(25)]
    one = P.Block()
    for t in texts:
        one.add(split(t), None)
    whole = [[x.tolist() for x in r[1:]] for r in one.runs()]
    for t, want in zip(texts, whole):
        alone = P.Block()
        alone.add(split(t), None)
        assert [x.tolist() for x in next(alone.runs())[1:]] == want
    assert P.run_digest(documents(spark, [])).count() == 0
    rows = P.periodic_runs(documents(spark, ["z z z z z z z y"] * 3, [5, 5, None])).collect()
    assert {(r.words, r.collapsed, tuple(map(tuple, r.runs))) for r in rows} == {(8, "z y", ((0, 7, 1),))}
