"""Rendering rules, one small page each."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumentrace.llm import queries
from lumentrace.llm.html_layout import Layout, extract, render
from tests.llm.brute_html import html_text

CASES = [
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b", "a\n\nb"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>k<th>long name<tr><td>value<td>v</table>", "k      long name\nvalue  v"),
    ("<table><tr><td>a<p>b<td>c</table>", "a  c\n\nb"),
    ("<script>x</script><style>y</style><p hidden>z</p><p style='display: none'>w</p>seen", "seen"),
    ("<head><title>t</title></head>body", "body"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("&lt;p&gt; &amp; caf&eacute;", "<p> & café"),
    ("  a \n\t b  <b>c</b>d ", "a b cd"),
    ("<!-- no --><p>a<!-- b -->c", "ac"),
    ("</div></p>a</table>b", "ab"),
    ("<td>lone</td> cell", "lone cell"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\nd\nu\ne"),
    ("<img alt='a cat'> sat", "a cat sat"),
    ("where <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math>, so", "where x=1 2, so"),
    ("<math><semantics><mi>y</mi><annotation encoding='t'>\\y</annotation></semantics></math>", "y"),
    ("<p>a <svg><title>no</title><defs><text>no</text></defs><path d='m'/><g>no<text>Sales</text><text>20<tspan>24</tspan></text></g></svg> b", "a Sales 2024 b"),
    ("<svg><foreignObject><div>in</div></foreignObject><text display='none'>no</text></svg>", "in"),
    ("<svg><rect><p>after an open svg", "after an open svg"),
    ("<svg/>a<math/>b", "ab"),
    ("<input type=submit value='Send it'> <input type=hidden value=no><input type=reset value=Clear>", "Send it Clear"),
    ("<p>" * 3000 + "deep" + "<i>" * 3000, "deep"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_render(html, text):
    assert render(html) == text


def test_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "<p>a", "y"), (2, "", "z"), (2, "", "z")], "page_id long, html string, text string")
    got = sorted((tuple(r) for r in extract(df).collect()), key=repr)
    assert got == sorted([(1, None, 0, 0), (None, "a", 1, 1), (2, "", 0, 0), (2, "", 0, 0)], key=repr)
    assert extract(df.limit(0)).count() == 0


def test_all_pages_equal_the_plain_renderer(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r["page_id"]: None if r["html"] is None else html_text(r["html"]) for r in pages.collect()}
    got = {r["page_id"]: r["text"] for r in queries.op9_html_layout(spark, "/root/testdata/sf0.01").collect()}
    assert got == want and len(got) == pages.count()


@st.composite
def parts(draw, depth=3, inline=False):
    """Markup of paragraphs, lists and tables, with optional end tags left out."""
    word = st.sampled_from(["a", "bb", "long word", " x ", "é &amp; f", "7 &lt; 8"])
    if depth == 0 or inline:
        return draw(st.lists(st.one_of(word, word.map(lambda w: f"<b>{w}</b>"), word.map(lambda w: f"{w}<br>{w}"), st.just("<span hidden>no</span>")), min_size=1, max_size=3).map("".join))
    inner = parts(depth - 1)
    flat = parts(0)
    kind = draw(st.sampled_from(["p", "div", "ul", "ol", "table", "h1", "text", "script"]))
    if kind in ("p", "h1"):
        return f"<{kind}>{draw(flat)}</{kind}>" if kind == "h1" or draw(st.booleans()) else f"<p>{draw(flat)}<p>{draw(flat)}"
    if kind == "div":
        return "<div>" + draw(inner) + "</div>" + draw(inner)
    if kind in ("ul", "ol"):
        return f"<{kind}>" + "".join("<li>" + x for x in draw(st.lists(flat, min_size=1, max_size=3))) + f"</{kind}>"
    if kind == "table":
        cell = st.tuples(st.sampled_from(["", " colspan=2", " rowspan=2", " colspan=2 rowspan=3"]), flat).map(lambda c: f"<td{c[0]}>{c[1]}")
        return "<table>" + "".join("<tr>" + "".join(r) for r in draw(st.lists(st.lists(cell, min_size=1, max_size=3), min_size=1, max_size=4))) + "</table>"
    return draw(flat) if kind == "text" else "<script>if (a<b) x()</script>"


@settings(max_examples=400, deadline=None)
@given(st.lists(parts(), min_size=1, max_size=4).map("".join))
def test_random_pages_equal_the_plain_renderer(html):
    assert render(html) == html_text(html)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><th colspan=2>Head over two<th>C<tr><td>a<td>b<td>c</table>", "Head over two  C\na  b           c"),
        ("<table><tr><td rowspan=2>r<td>1<td>2<tr><td>3<td>4</table>", "r  1  2\n   3  4"),
        ("<title>no</title>a<title>no</title>b", "ab"),
        ("<input value='typed'> <input type=password value=no><input placeholder=hint><input type=checkbox value=no>", "typed hint"),
        ("<style>.x{color:red} .gone, #too {display:none} p.y{visibility:hidden}</style><p class='a gone'>no<p id=too>no<p class=y>no<div class=y>yes</div>", "yes"),
        ("<style>.a{display:none}.a{display:block}@media print{.b{display:none}}/* .b{display:none} */</style><i class=a>a</i><i class=b>b</i>", "ab"),
        ("<style>.a{display:none}</style><i class=a style='display:inline'>a</i>", "a"),
        ("a<b title='x>y'>c</b>", "ac"),
        ("a &#99999999999999999999; b", "a � b"),
        ("x &#" + "9" * 5000 + "; y", "x � y"),
        ("a < b <3", "a < b <3"),
        ("a<p title='never closed>b", "a"),
        ("<textarea>\n&lt;b></textarea><xmp><b></xmp>", "<b><b>"),
        ("a<!-->b<!-- <p> --!>c<?php x ?>d</ x>e</>f", "abcdef"),
    ],
)
def test_more_rules(html, text):
    assert render(html) == text


HOSTILE = {
    "end tags without start": "<b>" * 40_000 + "</i>" * 200_000,
    "blocks in open inline": "<b>" * 40_000 + "<h1>x</h1>" * 80_000,
    "tags without end": "<a " * 340_000,
    "comments without end": "<!--" * 250_000,
    "attributes": "<p " + "a=1 " * 250_000 + ">x",
    "nested tables": "<table><tr><td>x" * 62_000,
    "nested lists": "<ul><li>x" * 110_000,
    "spans": "<table><tr>" + "<td rowspan=65534 colspan=1000>x" * 20_000 + "<tr><td>y" * 50_000,
    "a wide cell": "<table><tr><td>" + "w" * 500_000 + "<tr><td>a<td>b" * 30_000,
    "style comments": "<style>" + "/*" * 500_000,
    "less-than signs": "<" * 1_000_000,
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_anything_takes_seconds(name):
    start = time.monotonic()
    assert len(render(HOSTILE[name])) < 15_000_000
    assert time.monotonic() - start < 40


def table(rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


@pytest.mark.parametrize("wide", [61, 70, 240, 3000])
def test_wide_cells_are_aligned(wide):
    got = render(table([["x" * wide, "B"], ["short", "C"], ["", "D"]])).split("\n")
    assert got == ["x" * wide + "  B", "short" + " " * (wide - 3) + "C", " " * (wide + 2) + "D"]
    many = render(table([[f"c{i}" for i in range(300)], ["y"] * 300])).split("\n")
    assert all(many[0].index(f"c{i} ") == [j for j, c in enumerate(many[1]) if c == "y"][i] for i in range(299))


def test_blanks_are_bounded_in_all():
    """One cell of 100,000 characters above 3,000 short rows: the widest cell leaves the widths, the others keep their columns."""
    rows = [["z" * 100_000, "end"]] + [[f"row {i}", "b", "c"] for i in range(3000)]
    text = render(table(rows))
    lines = text.split("\n")
    assert len(text) < 20 * sum(len(c) for r in rows for c in r) + (1 << 17)
    assert lines[0] == "z" * 100_000 + "  end" and {line.index("b") for line in lines[1:]} == {10}
    assert render(table(rows[:20]), Layout(share=None)).split("\n")[1].index("b") == 100_002
    nested = "<table><tr><td>a</td><td>"
    assert render(nested * 7 + "x" + "</td></tr></table>" * 7) == "a  " * 7 + "x"
