import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.chunking import sections
from siltstone.chunking.budget import fit, pieces, words
from siltstone.chunking.records import chunk_of, chunked, records, unfenced
from siltstone.chunking.tables import linear
from siltstone.errors import CompletionError

TEXT = st.text(alphabet="ab .!\n", max_size=120)


def by_letters(text):
    """A measure that does not add up: white space counts too."""
    return len(text) // 2


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 8), st.integers(0, 4))
def test_pieces_keep_the_budget_and_every_word(text, budget, overlap):
    got = pieces(text, words, budget, overlap)
    assert all(words(p) <= budget for p in got) and set(text.split()) == set(" ".join(got).split())
    assert bool(got) == bool(text.strip()) and (words(text) > budget or got in ([], [text]))


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 40), st.integers(0, 10))
def test_pieces_by_a_measure_that_does_not_add_up(text, budget, overlap):
    got = pieces(text, by_letters, budget, overlap)
    assert all(by_letters(p) <= budget or len(p.split()) == 1 for p in got) and set(text.split()) == set(" ".join(got).split())


def test_neighbours_share_whole_sentences():
    assert pieces("sun up. sky red. sea calm. day off.", words, 6, 2) == ["sun up. sky red. sea calm.", "sea calm. day off."]
    assert pieces(" ".join(map(str, range(11))), words, 4, 3) == ["0 1 2 3", "4 5 6 7", "8 9 10"]
    assert [pieces(blank, words, 3) for blank in (None, "", " \n")] == [[], [], []]


CHUNK = st.tuples(TEXT, st.lists(st.sampled_from("TU"), max_size=1), st.lists(st.sampled_from("IJ"), max_size=1))


@settings(max_examples=150, deadline=None)
@given(st.lists(CHUNK, max_size=6), st.integers(2, 9), st.integers(0, 3))
def test_fit_loses_nothing(chunks, budget, least):
    got = fit(chunks, words, budget, least, 1)
    assert all(words(t) <= budget for t, _, _ in got) and all(t.strip() or a or b for t, a, b in got)
    for k in (1, 2):  # tables and images, in order
        assert [x for c in got for x in c[k]] == [x for c in chunks for x in c[k]]
    assert {w for t, _, _ in chunks for w in t.split()} == {w for t, _, _ in got for w in t.split()}
    small = [i for i, (t, _, _) in enumerate(got) if i and words(t) < least]
    assert all(words(got[i - 1][0]) + words(got[i][0]) > budget for i in small)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text("xyz", min_size=1, max_size=3), min_size=2, max_size=2), min_size=1, max_size=5))
def test_tables_put_every_cell_by_its_header(rows):
    body = "".join("<tr>" + "".join(f"<td> {c} </td>" for c in r) + "</tr>" for r in rows)
    want = "\n".join(["k | v", *(f"k: {a} | v: {b}" for a, b in rows)])
    assert linear(f"<table><thead><tr><th>k</th><th>v</th></tr></thead>{body}</table>") == want
    assert linear(f"<table><tr><td>k</td><td>v</td></tr>{body}</table>") == want


# The expected lines of these tables.
@pytest.mark.parametrize(("table", "want"), [
    ("<table><tr><td>1</td><td>2</td></tr><tr><td>3</td><td>4</td></tr></table>", "1 | 2\n3 | 4"),
    ("<TABLE><TR><TH>a &amp; b</TH><TH></TH></TR><TR><TD>1<br>2</TD><TD>x</TD><TD>y</TD></TR></TABLE>", "a & b\na & b: 12 | x | y"),
    ("<table><tr><td>up<td>down<tr><td>1<td>", "up | down\nup: 1"),
    ("<table></table>", ""), ("", ""), (None, ""),
])
def test_tables(table, want):
    assert linear(table) == want


def test_records():
    assert records('```json\n[{"a": 1}, 2]\n```') == [{"a": 1}] == records('{"n": 3, "rows": [{"a": 1}]}')
    assert records('{"x": 1, "y": [], "z": [{"a": 1}]}') == [] and records('{"x": 1}') == [{"x": 1}]
    for bad in ("nope", "3", "", None):
        with pytest.raises(CompletionError):
            records(bad)
    assert chunk_of({"text": " t ", "k": 1}) == ("t", {"k": 1})
    assert chunk_of({"q": "é"}) == ('{"q": "é"}', {"q": "é"}) and chunk_of({"text": " "})[1] == {"text": " "}
    assert [unfenced(x) for x in ("  ```JSON\n{}\n``` ", "```[1]", " {} ")] == ["{}", "[1]", "{}"]


def test_html_elements_keep_all_text(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body>loose<div>a &amp; b<pre>c</pre></div><h2>H <b>x</b></h2><ul><li>one<ul><li>two</li></ul></li></ul><!-- no --><table><tr><td>1</td></tr></table>tail<script>var t='</p>';</script></body></html>"
    got = [(r["kind"], r["text"]) for r in sections.html_elements(spark.createDataFrame([(1, page)], "page_id int, html string")).orderBy("pos").collect()]
    assert [t for k, t in got if k != "table"] == ["T", "loose", "a & b", "c", "H x", "one", "two", "tail"]
    assert [k for k, _ in got if k != "text"] == ["title", "table"]


def test_null_texts_are_not_asked_for(spark):
    d = spark.createDataFrame([(1, "abc"), (2, None), (3, "")], "doc_id int, text string")
    got = chunked(d, "p", lambda system, user: json.dumps({"text": user.split("\n")[-1] or "none"})).collect()
    assert sorted((r["doc_id"], r["text"], r["error"]) for r in got) == [(1, "abc", None), (3, "none", None)]
