"""The page tokenizer: attribute forms, comments, raw text, implied ends, references; then through Spark."""

import html as stdlib_html
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.functions.html import decode, page_items
from lectern.operators import links as LK


def anchors(page):
    return [(pos, url, text) for kind, pos, url, text, _ in page_items(page) if kind == "a"]


@pytest.mark.parametrize("page,want", [
    ("<a href='x'>A</a>", [(1, "x", "A")]),
    ("<a href=x>A</a>", [(1, "x", "A")]),
    ("<A HREF = \"x\">A</A>", [(1, "x", "A")]),
    ('<a href="x">A', [(1, "x", "A")]),
    ('<a title="a > b" href="x">A</a>', [(1, "x", "A")]),
    ("<a title='\"' href='x'>A</a>", [(1, "x", "A")]),
    ('<!-- <a href="c">C</a> --><a href="d">D</a>', [(1, "d", "D")]),
    ('<a href="1">one<a href="2">two</a>', [(1, "1", "one"), (2, "2", "two")]),
    ('<a href="1">one<b>big<a href="2">two', [(1, "1", "onebig"), (2, "2", "two")]),
    ("<ul><li><a href=1>one<li><a href=2>two</ul>tail", [(1, "1", "one"), (2, "2", "two")]),
    ("<table><tr><td><a href=1>one<td>two</table>", [(1, "1", "one")]),
    ("<div><a href=1>one</div>two", [(1, "1", "one")]),
    ("<a href=1>one</p> two</a>", [(1, "1", "onetwo")]),
    ("<script>s='<a href=q>'</script><style><a href=r></style><a href=z>Z</a>", [(1, "z", "Z")]),
    ("<a href=z>Unit <i>1</i> <!-- c -->notes </a>", [(1, "z", "Unit1notes")]),
    ("<a href=1 href=2>A</a>", [(1, "1", "A")]),
    ('<a href="x" />out</a>', [(1, "x", "")]),
    ("<a name=top>T</a>", [(1, None, "T")]),
    ("<a href>T</a>", [(1, "", "T")]),
    ('<a href="open>x</a> <a href="b">c</a>', [(1, 'open>x</a> <a href=', "c")]),
    ("<a href=\"open>x</a> <a href=b>c</a>", [(1, '"open', "x"), (2, "b", "c")]),
    ("<a href=1>1 < 2 & 3</a>", [(1, "1", "1 < 2 & 3")]),
    ("<a href='?a=1&copy=2&amp;b=&eacute;&#233;&#xE9'>&nbsp;&Zopf;&bogus; x</a>", [(1, "?a=1&copy=2&b=ééé", "𝕫".replace("𝕫", "ℤ") + "&bogus; x")]),
    ("<abbr href=1>no</abbr><a\nhref=2>yes</a>", [(1, "2", "yes")]),
    ("<a href=1>x<!-- open", [(1, "1", "x")]),
    ("", []), ("<", []), ("</", []), ("<a", [(1, None, "")]), ("<!", []), ("<script>", []),
])
def test_anchor_forms(page, want):
    assert anchors(page) == want


def test_named_references_of_the_standard_are_all_known():
    from html.entities import html5
    for name, value in html5.items():
        if name.endswith(";"):
            assert decode(f"&{name}") == value
    assert decode("&#0;&#x110000;") == stdlib_html.unescape("&#0;&#x110000;")


def test_iframes_scripts_and_positions():
    got = list(page_items("<iframe src=a></iframe><script type='x'>one</script><IFRAME SRC='b'/><script>two"))
    assert got == [("f", 1, "a", None, None), ("s", 1, "one", None, None), ("f", 2, "b", None, None), ("s", 2, "two", None, None)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<a href=", "<a ", "'", '"', ">", "</a>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<table>",
                                 "</table>", "<script>", "</script>", "<!--", "-->", "<", "/", "x", " ", "=", "&amp;"]), max_size=40))
def test_any_page_ends_and_positions_are_gapless(parts):
    items = list(page_items("".join(parts)))
    for kind in "afs":
        pos = sorted(i[1] for i in items if i[0] == kind)
        assert pos == list(range(1, len(pos) + 1))


@pytest.mark.parametrize("unit", ["<a href=x>y", "<b><li>", "<ul><li><a href=1>t", "</x>", "<div></span>", "<a href=\"", "<!--", "<td><a>", "&amp;<"])
def test_time_grows_with_the_page(unit):
    t0 = time.time()
    n = len(list(page_items(unit * (300_000 // len(unit)))))
    assert time.time() - t0 < 5 and n >= 0


def test_pages_through_spark(spark):
    pages = spark.createDataFrame(
        [(1, "u", "s", 3, "<a href='https://drive.google.com/file/d/A1/view' data-file=f.pdf>Unit <b>1</b>"), (2, "u", "s", 3, None),
         (3, "u", "s", 3, ""), (None, "u", "s", 3, "<iframe src='https://drive.google.com/open?id=B2'>"),
         (4, "u", "s", 3, "<a href=/semesters/3/subjects/os>OS<a href='/semesters/3/subjects/db'>DB")],
        "page_id long, url string, subject string, semester int, html string")
    got = {(r.page_id, r.strategy, r.pos, r.name, r.drive_id, r.data_file) for r in LK.page_resources(pages).collect()}
    assert got == {(1, 1, 1, "Unit1", "A1", "f.pdf"), (None, 3, 1, "Embedded file", "B2", None)}
    assert {(r.page_id, r.pos, r.name) for r in LK.subject_links(pages, "https://p.example/").collect()} == {(4, 1, "OS"), (4, 2, "DB")}
