import random
import re
import textwrap

import pytest
import zstandard

from babelqa.llm import license_scan as S
from llm_cases import documents, odd_texts, words

TELLING = set("affero agpl apache bsd by cc cc0 clause gnu gpl isc lesser lgpl mit mozilla mpl nc nd sa".split())


def spans_of(text):
    return [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+(?:\.\d+)*", text)]


def fewest(have, want):
    """The plain table: fewest words left out or put in, against any stretch of ``have``."""
    table = [[(0, j) for j in range(len(have) + 1)]]             # (differences, first word of the stretch)
    for i, w in enumerate(want, 1):
        row = [(i, 0)]
        for j, h in enumerate(have, 1):
            best = min((table[i - 1][j][0] + 1, 1, table[i - 1][j][1]), (row[j - 1][0] + 1, 2, row[j - 1][1]))
            if h == w and table[i - 1][j - 1][0] <= best[0]:
                best = (table[i - 1][j - 1][0], 0, table[i - 1][j - 1][1])
            row.append((best[0], best[2]))
        table.append(row)
    end = min(range(len(have) + 1), key=lambda j: (table[-1][j][0], j))
    return table[-1][end][0], table[-1][end][1], end


def brute(text):
    """Every template against the whole text, without blocks, ranking or compression: where several
    fit, the one with most words, then the rests."""
    out, have = [], spans_of(text or "")
    work = [(0, len(have))]
    while work:
        a, b = work.pop()
        hits = []
        for name, template in S.TEMPLATES.items():
            want = [w for w, _, _ in spans_of(template)]
            n, first, end = fewest([h[0] for h in have[a:b]], want)
            if 100 * n > 20 * len(want):
                continue
            left, extra = list(want), []
            for w in (h[0] for h in have[a + first:a + end]):
                left.remove(w) if w in left else extra.append(w)
            if not any(w in TELLING or w[0].isdigit() for w in left + extra):
                hits.append((-len(want), n, name, a + first, a + end))
        if hits:
            _, n, name, first, end = min(hits)
            out.append((name, n))
            work += [(a, first), (end, b)]
    return sorted(out)


def found(text):
    return sorted((name, n) for _, _, name, _, n in S.notices(text or ""))


def prose(n, seed):
    """One line of English words, with long words of licence texts among them."""
    rng = random.Random(seed)
    pool = " ".join(t for name, t in S.TEMPLATES.items() if len(t) > 200).replace(".", "").split()
    plain = "the of and a to in is you that it he was for on are as with his they at be this have from".split()
    return " ".join(rng.choice(pool if rng.random() < 0.5 else plain) for _ in range(n))


def cases():
    body = lambda k: " ".join(words(k, 30))
    texts = [f"{body(k)}\n{t}\n{body(k + 50)}" for k, t in enumerate(S.TEMPLATES.values())]
    texts += [f"{body(1)}\n{S.TEMPLATES['MIT-grant'].replace('any person', 'any human')}\n", "\n".join(S.TEMPLATES["Apache-2.0-header"].split(". ")),
              "Licensed under CC BY-ND 3.0.", "Released under the GNU Affero General Public License.", "Licence to kill",
              "ä LICENSED UNDER CC BY-NC 4.0.  ", f"a\nReleased under the MIT License.\n{body(3)}\n{body(4)}\n{body(5)}\nLicensed under CC BY 4.0."]
    return texts + odd_texts()


def test_equals_search_without_blocks_and_ranking(spark):
    texts = cases()
    got = S.scan_licenses(documents(spark, texts, clash=True)).collect()
    by_doc = {k: sorted((r.license, r.differences) for r in got if r.doc_id == k) for k in range(len(texts))}
    short = [k for k, x in enumerate(texts) if len(x or "") < 8000]
    assert {k: by_doc[k] for k in short} == {k: brute(texts[k]) for k in short}
    names = list(S.TEMPLATES)
    assert all(by_doc[k] == [(names[k], 0)] for k in range(len(names)))
    assert by_doc[len(names)] == [("MIT-grant", 2)]


@pytest.mark.parametrize("seed", range(6))
def test_random_changes_equal_brute_force(seed):
    """Words dropped, changed and put in, in prose that shares many words, up to and past the limit."""
    rng = random.Random(seed)
    for name in rng.sample(list(S.TEMPLATES), 8):
        w = S.TEMPLATES[name].split()
        for _ in range(rng.randrange(0, max(2, len(w) // 5 + 2))):
            k = rng.randrange(len(w))
            w[k:k + 1] = rng.choice([[], ["zebra"], [w[k], "yak"]])
        text = f"{prose(30, seed)} {' '.join(w)} {prose(30, seed + 1)}"
        assert found(text) == brute(text)


@pytest.mark.parametrize("width", [40, 60, 80])
@pytest.mark.parametrize("name", ["MIT-text", "BSD-2-Clause-text", "ISC-text", "Apache-2.0-header", "GPL-3.0-or-later", "MPL-2.0"])
def test_published_layouts(name, width):
    """Head lines, paragraphs, wrapped lines, comment marks."""
    paragraphs = re.split(r"(?<=[.:]) (?=The above|THE SOFTWARE|THIS SOFTWARE|[12]\. |Unless|You may)", S.TEMPLATES[name])
    text = "Some License\n\nCopyright (c) 2020 Jane Doe\nAll rights reserved.\n\n" + "\n\n".join(textwrap.fill(p, width) for p in paragraphs)
    for shown in (text, "\n".join(f" * {line}" for line in text.splitlines()), f"{prose(40, 1)}\n\n{text}\n\n{prose(40, 2)}"):
        hits = S.notices(shown)
        assert [(h[2], h[4]) for h in hits] == [(name, 0)]
        start, end = hits[0][:2]
        assert shown[start:].startswith(S.TEMPLATES[name].split()[0]) and shown[:end].endswith(S.TEMPLATES[name].split()[-1])


def test_ranking_is_the_conditional_size():
    block = S.TEMPLATES["GPL-3.0"]
    ranked = S.reductions(block)
    assert ranked[0][1] == "GPL-3.0" and ranked == sorted(ranked, key=lambda x: (-x[0], x[1])) and len(ranked) == len(S.TEMPLATES)
    plain = zstandard.ZstdCompressor(level=S.LEVEL)
    given = zstandard.ZstdCompressor(level=S.LEVEL, dict_data=zstandard.ZstdCompressionDict(
        S.TEMPLATES["MIT"].encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    want = 1 - len(given.compress(block.encode())) / len(plain.compress(block.encode()))
    assert dict((n, r) for r, n in ranked)["MIT"] == want


def test_ranking_decides_between_confirmed_templates():
    hits = S.notices(S.TEMPLATES["Apache-2.0-header"])
    assert [(h[2], h[4]) for h in hits] == [("Apache-2.0-header", 0)]
    both = S.TEMPLATES["Apache-2.0-header"]
    assert S.confirmed(S.words(both), "Apache-2.0") and S.reductions(both)[0][1] == "Apache-2.0-header"


def test_repeated_rows_null_ids_no_rows(spark):
    t = "Released under the MIT License."
    rows = S.scan_licenses(documents(spark, [t, t, t], [1, 1, None])).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["1", "1", "None"] and {r.differences for r in rows} == {0}
    assert S.scan_licenses(documents(spark, [])).count() == 0


@pytest.mark.parametrize("a,b,n", [("a b c", "a b c", 0), ("x a b c y", "a b c", 0), ("a x b c", "a b c", 1), ("a c", "a b c", 1),
                                   ("", "a", 1), ("z z", "a b", 2), ("a b c x y z a q c", "a b c", 0)])
def test_wording_differences(a, b, n):
    assert len(S.wording_differences(a, b)) == n


def test_prose_behind_a_changed_notice_does_not_hide_it():
    w = S.TEMPLATES["BSD-grant"].split()
    for k in (3, 9, 15):
        w[k] = "zebra"
    for far in (0, 200, 2000):
        assert found(f"{' '.join(w)} {prose(far, far)}".strip()) == [("BSD-grant", 6)]


def test_notice_inside_a_long_line(spark):
    names = [n for n in ("MIT", "CC-BY-4.0", "CC-BY-NC-4.0", "Unlicense", "BSD-2-Clause") for _ in range(8)]
    texts = [f"{prose(300, k)} {S.TEMPLATES[n]} {prose(300, k + 100)}" for k, n in enumerate(names)]
    got = sorted((r.doc_id, r.license, r.differences) for r in S.scan_licenses(documents(spark, texts)).collect())
    assert got == [(k, n, 0) for k, n in enumerate(names)]


@pytest.mark.parametrize("names,between", [
    (["MIT", "CC-BY-4.0"], "\n"), (["MIT", "CC-BY-4.0"], " or, at your choice, "),
    (["MIT", "BSD-3-Clause", "Apache-2.0", "MIT", "CC-BY-SA-4.0", "CC-BY-4.0"], "\nlibrary: "),
    (["MIT-grant", "MIT", "Apache-2.0-header", "Apache-2.0"], "\n\n")])
def test_every_notice_of_a_block_has_a_row(spark, names, between):
    text = "Intro.\n" + between.join(S.TEMPLATES[n] for n in names) + "\nend"
    rows = sorted(S.scan_licenses(documents(spark, [text])).collect(), key=lambda r: r.start)
    assert [(r.license, r.differences) for r in rows] == [(n, 0) for n in names]
    assert [text[r.start:r.end] for r in rows] == [S.TEMPLATES[n] for n in names]
