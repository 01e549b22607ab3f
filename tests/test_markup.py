"""What is text and what is markup, in pages and in tables; chunks of pages against plain versions."""

import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.chunking import budget, markup, sections
from siltstone.chunking.tables import cells, linear


def texts(page):
    return list(markup.elements(page))


def test_brackets_that_are_no_tags_are_text():
    assert texts("a < b and c > d") == [("text", "a < b and c > d")]
    assert texts("if x<3 then <b>y</b> <5") == [("text", "if x<3 then y <5")]
    assert texts("<a title=\"x>y\" href='q'>l</a>") == [("text", "l")]


def test_references_are_characters():
    assert texts("&eacute; &#233; &#xe9; &lt;i&gt; &nbsp; &amp;amp; &copy;") == [("text", "é é é <i> &amp; ©")]
    assert linear("<table><tr><th>n</th></tr><tr><td>&eacute; a < b &lt;c&gt;</td></tr></table>") == "n\nn: é a < b <c>"


def test_what_is_not_shown_goes():
    page = "<!doctype html><style>p{}</style>x<!-- <p>no</p> --><script>if (a<b) {}</script>y<?php z ?>"
    assert texts(page) == [("text", "x y")]


def test_nested_tables_are_whole():
    page = "x<table><tr><td>a<table><tr><td>i</td></tr></table>y</td><td>z</td></tr></table>w"
    assert [k for k, _ in texts(page)] == ["text", "table", "text"] and texts(page)[1][1] == page[1:-1]
    assert cells(texts(page)[1][1])["text"].tolist() == ["a i y", "z"]
    assert texts("<table><tr><td>a<td>b") == [("text", "a"), ("text", "b")]  # never closed
    assert texts("a</table>b") == [("text", "a"), ("text", "b")]


def test_headings():
    assert texts("<h1>T <i>x</i></h1>one<h2>U</h2>") == [("title", "T x"), ("text", "one"), ("title", "U")]
    assert texts("<h2>open <p>text") == [("text", "open"), ("text", "text")]
    assert texts(None) == texts("") == texts(" <p> </p>") == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["p", "div", "h1", "h3", "li", "b", "span"]), st.text("ab &<é", max_size=12)), max_size=8))
def test_every_shown_character_is_kept(parts):
    """Escaped text comes back whole, in order, whatever tags stand around it."""
    page = "".join(f"<{t} class='k'>{html.escape(x)}</{t}>" for t, x in parts)
    got = "".join(x for _, x in texts(page))
    assert re.sub(r"\s", "", got) == re.sub(r"\s", "", "".join(x for _, x in parts))


def test_long_pages_take_time_in_proportion():
    assert len(texts("<p " * 20_000 + "x" + "<" * 20_000)) == 1
    assert len(texts("<table><tr><td>" * 3000)) == 0


def test_pages_become_chunks(spark):
    """Sections and fitted chunks of a table of pages against the same rules over plain lists."""
    pages = [(i, f"<h1>T{i}</h1><p>{'word ' * (i * 40)}</p><table><tr><td>k{i}</td></tr></table><h2>U &amp; {i}</h2><p>a < b</p>" * (i % 4)) for i in range(12)]
    e = sections.html_elements(spark.createDataFrame(pages, "page_id long, html string"))
    got = {}
    for r in sections.sections(e, 300, 50).orderBy("page_id", "chunk_index").collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    none = []
    for i, page in pages:
        parts = []
        for kind, text in markup.elements(page):
            if kind == "title" or not parts:
                parts.append([])
            parts[-1].append(text)
        want = sections.packed_sections(parts, 300, 50)
        assert got.get(i, []) == want and all(len(t) <= 300 for t in want)
        none += [i] if not want else []
    assert none == [0, 4, 8] and re.search("a < b", "".join(got[3]))
    docs = spark.createDataFrame([(i, "s one two. three four five. six? " * i) for i in range(9)], "doc_id long, text string")
    cut = {}
    for r in budget.split(docs, 7, 3).orderBy("doc_id", "chunk_index").collect():
        cut.setdefault(r["doc_id"], []).append(r["text"])
    assert cut == {i: budget.pieces("s one two. three four five. six? " * i, budget.words, 7, 3) for i in range(1, 9)}
