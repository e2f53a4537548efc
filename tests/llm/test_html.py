"""Layout of HTML pages, case by case."""

import pytest

from conftest_llm import with_clashes
from peerlabel.llm import html_text
from peerlabel.llm.html_text import HtmlExtractor, aligned, extract

CASES = {
    "plain": ("just text &amp; more", "just text & more"),
    "null": (None, ""),
    "empty": ("", ""),
    "nothing visible": ("<head><title>t</title></head><script>x</script>", ""),
    "implied paragraphs": ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
    "inline": ("<p>a <b>b</b>\n <i>c</i>d</p>", "a b cd"),
    "unclosed inline": ("<p><b>x<br><p>y", "x\n\ny"),
    "breaks": ("a<br>b<br><br>c", "a\nb\n\nc"),
    "hidden": ("a<span hidden>b</span><i style='DISPLAY : none'>c</i><p style=\"visibility:hidden\">d</p>e", "ae"),
    "not hidden": ("<p style='color:red'>a</p>", "a"),
    "raw text": ("<style>p{}</style>a<script>if (a<b) '</p>'</script>b", "ab"),
    "comments": ("a<!-- <p>no -- > -->b<!doctype html><?php no ?>c", "abc"),
    "bare less-than": ("1 < 2 and a<b>c</b>", "1 < 2 and ac"),
    "attributes with >": ('<a title="x > y">z</a>', "z"),
    "unclosed tag": ("text <a href='", "text"),
    "list": ("<ul><li>a<li>b</ul>", "- a\n- b"),
    "nested list": ("<ul><li>a<ol start=9><li>x<li>y</ol><li>c</ul>", "- a\n  9. x\n  10. y\n- c"),
    "numbered list with value": ("<ol><li>a<li value=7>b<li>c</ol>", "1. a\n7. b\n8. c"),
    "item of blocks": ("<ul><li><p>a</p><p>b</p></ul>", "- a\n\n  b"),
    "empty item": ("<ul><li></li><li>b</li></ul>", "-\n- b"),
    "definition list": ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    "quote": ("a<blockquote>b<br>c</blockquote>d", "a\n\n  b\n  c\n\nd"),
    "pre": ("<pre>a  b\n  c</pre>d", "a  b\n  c\n\nd"),
    "image": ("<img alt='a picture'> and <img>", "a picture and"),
    "table": (
        "<table><tr><th>Name<th>n<tr><td>a<td>1<tr><td>longer<td>22</table>after",
        "Name    n\na       1\nlonger  22\n\nafter",
    ),
    "caption and spans": (
        "<table><caption>c</caption><tr><td colspan=2>wide wide wide<tr><td rowspan=2>a<td>b<tr><td>d</table>",
        "c\nwide wide wide\na  b\n   d",
    ),
    "table in a cell": (
        "<table><tr><td>a<table><tr><td>x<td>y</table><td>b</table>",
        "a     b\n\nx  y",
    ),
    "cell with breaks": ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    "stray end tags": ("</div></p>a</li></table>b", "ab"),
    "rule": ("a<hr>b", "a\n\nb"),
    "upper case tags": ("<P>A<P>B<BR>C", "A\n\nB\nC"),
}


@pytest.mark.parametrize("name", CASES)
def test_layout(name):
    html, expected = CASES[name]
    assert extract(html) == expected


SHOWN = {
    "formula": ("<p>Let <math><mi>x</mi><mo>+</mo><mn>1</mn></math>.", "Let x+1."),
    "fraction": ("a <math><mfrac><mn>1</mn><mn>2</mn></mfrac></math> b", "a 1 2 b"),
    "annotation": ("<math><semantics><mi>x</mi><annotation encoding='tex'>\\x</annotation></semantics></math>y", "xy"),
    "displayed formula": ("a<math display=block><mi>x</mi></math>b", "a\nx\nb"),
    "drawing": (
        "a<svg><title>t</title><desc>d</desc><style>s{}</style><defs><text>no</text></defs>stray"
        "<rect width='1'/><text x='1'>One <tspan>two</tspan></text><g><text>three</text></g></svg>b",
        "a\nOne two\nthree\nb",
    ),
    "icon": ("a<svg><title>t</title><path d='M0'/></svg>b", "ab"),
    "lines of a label": ("<svg><text><tspan x=0>one</tspan><tspan x=0 dy=9>two</tspan></text></svg>", "one two"),
    "foreign object": ("<svg><foreignObject><p>in</p><p>side</p></foreignObject><g>no</g></svg>out", "in\n\nside\n\nout"),
    "switch": ("<svg><switch><foreignObject><div>label</div></foreignObject><text>label</text></switch></svg>", "label"),
    "hidden label": ("<svg><text display='none'>a</text><g visibility=hidden><text>b</text></g><text>c</text></svg>", "c"),
    "drawing left open": ("<svg><g><p>after</p>text", "after\n\ntext"),
    "first option": ("Size<select><option>S<option>M</select>now", "Size S now"),
    "selected option": ("<select><option>S<option selected>M &amp; L</select>", "M & L"),
    "disabled options": ("<select><optgroup label=g disabled><option>a</optgroup><option disabled>b<option>c</select>", "c"),
    "labelled option": ("<select><option label='shown'>not</select>", "shown"),
    "list box": ("<select multiple><option>a<option>b</select>", "a b"),
    "no option": ("a<select>text</select>b", "ab"),
}


@pytest.mark.parametrize("name", SHOWN)
def test_formulas_drawings_and_choices(name):
    html, expected = SHOWN[name]
    assert extract(html) == expected


def test_deep_and_long_pages():
    deep = "<div>" * 20000 + "x" + "</div>" * 20000
    assert extract(deep) == "x"
    nested = "<table><tr><td>" * 300 + "x" + "</table>" * 300
    assert extract(nested) == "x"
    assert extract("<p>word " * 50000).count("word") == 50000
    assert extract("<" * 5000) == "<" * 5000
    assert extract("<a " + "b='c' " * 20000) == ""


def test_every_visible_word_stays(spark, testdata):
    import html
    import re

    pages = spark.read.parquet(f"{testdata}/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in HtmlExtractor().extract(pages).collect()}
    for page in pages.collect():
        body = re.sub(r"(?s)<head>.*?</head>|<!--.*?-->|<script.*?</script>", " ", page.html)
        words = html.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        got = [w for w in texts[page.page_id].split() if w != "-"]
        assert got == [w for w in words if w != "-"]


def test_columns_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "<p>a"), (None, None), (1, "<p>a")], "page_id LONG, html STRING")
    got = HtmlExtractor().extract(with_clashes(rows, "id", "text", "n_chars"))
    assert sorted(map(str, got.collect())) == sorted(["Row(page_id=1, text='a', n_chars=1)"] * 2 + ["Row(page_id=None, text='', n_chars=0)"])
    assert HtmlExtractor().extract(rows.limit(0)).count() == 0


def test_alignment_of_nothing():
    assert list(aligned([])) == [] and list(aligned([[], [([], 1, 1)]])) == []


@pytest.mark.parametrize(
    "html, text",
    [
        ("<form>Find <input value='old' type=text> <input type=submit value=Search> <input type=hidden value=no><input type=password value=no></form>", "Find old Search"),
        ("<input type=checkbox value=no> yes", "yes"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes</b> no</div> end", "yes end"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
        ("<p style='visibility:visible'>yes <span style='visibility:collapse'>no</span>", "yes"),
        ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
        ("<ruby>kanji<rp>(</rp><rt>reading</rt><rp>)</rp></ruby>", "kanjireading"),
        ("10&nbsp;&nbsp;km  far", "10\xa0\xa0km far"),
    ],
)
def test_what_browsers_show(html, text):
    assert html_text.render(html_text.build(html)) == text
