"""Subword merges against the one-by-one learner, and the codec's round trip."""

import random
from collections import Counter

import pytest

from babelqa.operators import subwords as S
from babelqa.sources import fixtures as FX
from conftest import SF001


def brute(vocab, n_merges, min_count=2):
    """One merge at a time, all counts anew."""
    words, merges = dict(vocab), []
    while len(merges) < n_merges:
        counts = Counter()
        for w, n in words.items():
            for k in range(len(w) - 1):
                counts[w[k:k + 2]] += n
        best = min(((-n, max(p), p) for p, n in counts.items() if n >= min_count), default=None)
        if best is None:
            break
        pair, new = best[2], chr(S.FIRST_SYMBOL + len(merges))
        merges.append((pair, -best[0]))
        step = Counter()
        for w, n in words.items():
            step[w.replace(pair, new)] += n
        words = step
    return merges


@pytest.mark.parametrize("seed", range(3))
def test_merges_equal_the_one_by_one_learner(spark, seed):
    rng = random.Random(seed)
    letters = ["ab", "abcdefgh", "aéß日😀x"][seed]
    vocab = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))): rng.randrange(1, 9) for _ in range(60)}
    df = spark.createDataFrame(list(vocab.items()), "token string, cnt long")
    assert S.learn_merges(df, 25) == brute(vocab, 25)


def test_runs_of_one_symbol_ties_and_little_input(spark):
    vocab = {"a" * 40: 50, "xy": 30, "yx": 30, "xz": 30, "b": 9, "cd": 1}
    df = spark.createDataFrame([*vocab.items(), (None, 5), (chr(0xF0001) * 3, 70)], "token string, cnt long")
    got = S.learn_merges(df, 40)
    assert got == brute(vocab, 40) and len(got) < 40 and got[0] == ("aa", 39 * 50)
    assert S.learn_merges(df.limit(0), 5) == [] and S.learn_merges(df, 0) == []
    with pytest.raises(ValueError):
        S.learn_merges(df, S.MOST_MERGES + 1)


def test_encoder_follows_the_learner():
    """The ids of a training word are the symbols the learner left it with."""
    rng = random.Random(1)
    vocab = {"".join(rng.choice("abc") for _ in range(rng.randrange(2, 12))): 1 for _ in range(40)}
    merges = brute(vocab, 30)
    codec = S.Codec(merges)
    for word in vocab:
        w = word
        for r, (pair, _) in enumerate(merges):
            w = w.replace(pair, chr(S.FIRST_SYMBOL + r))
        assert codec.word(word) == [ord(c) - S.FIRST_SYMBOL + S.FIRST_ID if ord(c) >= S.FIRST_SYMBOL else ord(c) for c in w]
    assert S.spelt(merges)[0] == (merges[0][0][0], merges[0][0][1])


def test_round_trip_of_all_documents(spark):
    docs = FX.docs(spark, SF001).select("row_id", "text")
    odd = [(-k, t) for k, t in enumerate(["", None, " \n\t", "a b  c", chr(0xF0000) * 2 + " x", "😀é", "tail \n"])]
    docs = docs.unionByName(spark.createDataFrame(odd, "row_id long, text string"))
    merges = brute(Counter(w for r in docs.where("row_id > 5").limit(40).collect() for w in r.text.split()), 60)
    back = S.decode_subwords(S.encode_subwords(docs, merges), merges, out="back")
    rows = back.collect()
    assert all(r.text == r.back for r in rows) and len(rows) == docs.count()
    assert sum(len(r.ids) for r in rows if r.ids) < 0.7 * sum(len(r.text) for r in rows if r.text)
    with pytest.raises(Exception, match="KeyError"):
        S.decode_subwords(spark.createDataFrame([([S.FIRST_ID + 99],)], "ids array<int>"), merges).collect()


def test_codec_arrays_and_both_ways_of_writing_symbols(monkeypatch):
    """Ids and texts are arrays made at once, few merges are replaced in the whole text and many by
    remembered pieces; every way gives the ids of the words one by one."""
    rng = random.Random(5)
    text = "".join(rng.choice("aabbc \n é😀") for _ in range(3000))
    merges = brute(Counter(text.split()), 40)
    few = S.Codec(merges)
    monkeypatch.setattr(S, "FEW", 0)
    many = S.Codec(merges)
    for t in [text, "", " ", "aa", chr(0xF0001) + " " + text[:300] + chr(0x10FFFF)]:
        slow = [i for piece in S.re.findall(r"\S+|\s", t) for i in (few.word(piece) if piece.strip() else [ord(piece)])]
        assert many.encode(t).tolist() == slow and many.decode(many.encode(t)) == t
        monkeypatch.setattr(S, "FEW", 256)
        assert few.encode(t).tolist() == slow and few.encode(t).dtype == "int32" and few.decode(few.encode(t)) == t
        monkeypatch.setattr(S, "FEW", 0)
