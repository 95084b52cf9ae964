import random
import time

import pytest

from babelqa.llm.html_text import extract_text, render

CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("a  b\n c", "a b c"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>one</div><div>two</div>x", "one\ntwo\nx"),
    ("<p>a &amp; b &copy; &#65;&lt;", "a & b © A<"), ("<b>un<i>closed</b> tags", "unclosed tags"),
    ("<ul><li>a<li>b</ul>", "- a\n- b"), ("<ol start=9><li>a</li><li>b</ol>", "9. a\n10. b"),
    ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", "- a\n  - b\n  - c\n- d"),
    ("<ul><li>a<br>b</ul>", "- a\n  b"),
    ("<pre>\n x\n  y</pre>z", " x\n  y\n\nz".strip("\n")),
    ("<head><title>t</title></head><body>x<script>if (a</p>) b</script><style>c</style>y", "xy"),
    ("<script>never ended <p>x", ""), ("<!-- c --><p>x<!-- <p>y</p> -->z", "xz"), ("<!DOCTYPE html>x", "x"),
    ("<p hidden>a</p><p style='display: none'>b</p><p style='visibility:hidden'>c<b style='visibility:visible'>d</b></p>e", "d\n\ne"),
    ("<style>.ad, #x {display:none} p.q{display:none}</style><div class='big ad'>a</div><p id=x>b<p class=q>c", ""),
    ("<details><summary>s</summary>gone</details><details open><summary>t</summary>here</details>", "s\nt\nhere"),
    ("<dialog>a</dialog><dialog open>b</dialog><template>c</template><noscript>d</noscript>", "b"),
    ("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "a\n  b\nc\n  d"), ("<blockquote><p>q</blockquote>r", "  q\n\nr"),
    ("<table><tr><td>a<td>bbb<tr><td>cc<td>d</table>", "a  | bbb\ncc | d"),
    ("<table><thead><tr><th>h<th>i</thead><tbody><tr><td colspan=2>wide cell<tr><td>x<td>y</table>", "h | i\nwide cell\nx | y"),
    ("<table><tr><td rowspan=2>r<td>s<tr><td>t</table>", "r | s\n  | t"),
    ("<table><tr><td>a<br>b<td>c</table>", "a | c\nb |"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in | ner | out"),
    ("x</p>y", "x\n\ny"), ("a</i></div></ul>b", "ab"), ("1 < 2 <3 a<", "1 < 2 <3 a<"), ("<a title='>'>t</a>", "t"),
    ("<h1>T</h1>x<hr>y", "T\n\nx\n\ny"), ("<select><option>a<option>b</select>", "a\nb"), ("<textarea>\n a <b></textarea>", "a <b>"),
    ("</>x<p", "x"),
]


STYLED = [
    ("<style>@media print{.n{display:none}} .x{color:red}</style><p class=n>a", "a"),
    ("<style>@media screen and (min-width:9px){.n{display:none}}</style><p class=n>a<p>b", "b"),
    ("<style>@media print{p{color:red}} .n{display:none}</style><p class=n>a<p>b", "b"),
    ("<style>@font-face{src:url(x;y)} .n{display:none}</style><p class=n>a<p>b", "b"),
    ("<style>.h{display:none}.h{display:block}</style><p class=h>a", "a"),
    ("<style>.h{display:block}.h{display:none}</style><p class=h>a", ""),
    ("<style>#i{display:block}p.h{display:none}</style><p class=h id=i>a<p class=h>b", "a"),
    ("<style>.h{display:none!important}#i{display:block}</style><p class=h id=i style='display:block'>a", ""),
    ("<style>.h{display:none}</style><p class=h style='display:block'>a", "a"),
    ("<p style='display:none;display:block'>a<p style='display:block;display:none'>b", "a"),
    ("<style>.h{visibility:hidden}.s{visibility:visible}</style><p class=h>a<b class=s>c</b>d", "c"),
    ("<style>.a .h{display:none}</style><div class=a><i><b class=h>x</b></i>y</div><b class=h>z</b>", "y\nz"),
    ("<style>.a > .h{display:none}</style><div class=a><b class=h>x</b><i><b class=h>y</b></i></div>", "y"),
    ("<style>ul li.h , .z{display:none}</style><ul><li>a<li class=h>b</ul><p class='y z'>c", "- a"),
    ("<style>.a:hover,.b[x],.c+.d{display:none}</style><p class='a b d'>x", "x"),
    ("<style>[hidden]{display:none}.s{display:block}</style><p hidden class=s>a<p hidden>b", "a"),
    ("<style>*{visibility:hidden}.s{visibility:visible}</style><p>a<p class=s>b", "b"),
    ("<style>.h{/* } */display:none}</style><p class=h>a<p>b", "b"), ("<style>.h{display:none</style><p class=h>a", "a"),
    ("<style>td.h{display:none}</style><table><tr><td>a<td class=h>b<td>c</table>", "a | c"),
    ("<input type=submit value=Go><input type=hidden value=x><input value=word><input type=checkbox value=y>", "Goword"),
    ("<object data=x>fallback</object>", "fallback"),
]


@pytest.mark.parametrize("page,text", STYLED)
def test_styles(page, text):
    assert render(page).strip() == text.strip()


@pytest.mark.parametrize("digits", ["9" * 5000, "0" * 5000 + "2", "-3", "２", "1.5", ""])
def test_numbers_that_nobody_means(digits):
    page = f"<table><tr><td colspan='{digits}' rowspan='{digits}'>a<td>b</table><ol start='{digits}'><li>c</ol>&#{digits};&#x{digits};d"
    got = render(page)
    assert "a" in got and "b" in got and "c" in got and got.endswith("d")


def test_deep_tables_keep_their_layout():
    inner = "<table><tr><td>x<td>y</table>"
    for _ in range(60):
        inner = f"<table><tr><td>{inner}<td>z</table>"
    assert render(inner) == "x | y" + " | z" * 60


@pytest.mark.parametrize("page,text", CASES)
def test_layout(page, text):
    assert render(page).strip() == text.strip()


def test_every_visible_word_comes_out_in_order():
    rng, tags = random.Random(4), "p div b i ul ol li table tr td th section h2 blockquote pre span dl dt dd a".split()
    for _ in range(300):
        parts, said = [], []
        for k in range(rng.randrange(1, 60)):
            roll = rng.random()
            if roll < 0.45:
                parts.append(f"<{rng.choice(tags)}>")
            elif roll < 0.65:
                parts.append(f"</{rng.choice(tags)}>")
            else:
                parts.append(f" w{k} ")
                said.append(f"w{k}")
        got = [w for w in render("".join(parts)).split() if w.startswith("w")]
        assert sorted(got) == sorted(said)


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x", "<table><tr><td>" * 1000 + "x", "<" * 50_000, "<a b='" * 30_000,
                                  "<p " * 50_000, "<!--" * 50_000, "</p>" * 30_000, "<b>" * 10_000 + "</i>" * 10_000,
                                  "<ul><li>" * 300 + "x"])
def test_broken_pages_end_soon(page):
    began = time.time()
    render(page)
    assert time.time() - began < 10


def test_query_keeps_every_row(spark):
    rows = [(1, "<p>a<p>b", "u"), (1, "<p>a<p>b", "u"), (None, None, None), (3, "", "u"), (4, "<p>" + "long " * 100_000, "u")]
    pages = spark.createDataFrame([(i, u, h, "x") for i, h, u in rows], "page_id long, url string, html string, text string")
    got = sorted(((str(r.page_id), r.n_chars, r.n_lines) for r in extract_text(pages).collect()))
    assert got == [("1", 4, 3), ("1", 4, 3), ("3", 0, 0), ("4", 499_999, 1), ("None", 0, 0)]
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<html><head><title>T</title><p>Hello <b>you</b><p>there", "Hello you\n\nthere"),
    ("<head><meta charset=utf-8><style>.x{display:none}</style>\nHello<p class=x>no<p>yes", "Hello\n\nyes"),
    ("<head> <script>a</script> <template><p>t</p></template><noscript><p>n</p></noscript> <h1>H</h1>x", "H\n\nx"),
    ("<head><head><title>T</title></head>a<title>b</title>c", "ac"), ("<head><title>T</title>&nbsp;x", "x"),
    ("<html><head><link rel=x></html>\nlate", "late"), ("<head><title>T</title><table><tr><td>a<td>b</table>", "a | b")])
def test_head_ends_without_end_tag(page, text):
    assert render(page).strip() == text


@pytest.mark.parametrize("page,text", [
    ("<table><tr><td>a<td style='visibility:hidden'>b<td>c</table>", "a |  | c"),
    ("<table><tr><th style='visibility: collapse'>a<b style='visibility:visible'>b</b><th>c</table>", "b | c"),
    ("<table><tr style='visibility:hidden'><td>a<td>b<tr><td>c<td>d</table>", "c | d"),
    ("<table><tbody style='visibility:collapse'><tr><td>a<tr><td style='visibility:visible'>b</tbody><tfoot><tr><td>c</table>", "b\nc"),
    ("<table><caption style='visibility:hidden'>a</caption><tr><td>b</table>", "b"),
    ("<table style='visibility:hidden'>t<tr><td>a<td style='visibility:visible'>b</table>", "| b"),
    ("<table><tr style='visibility:hidden'><td><table><tr><td>a</table></table>b", "b")])
def test_visibility_inside_tables(page, text):
    assert render(page).strip() == text
