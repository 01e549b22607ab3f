"""The chunking queries over whole tables: what each has to keep, checked without the code that makes it."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from siltstone.chunking import sections
from siltstone.functions.text import truncated_share
from siltstone.plans.queries import QUERIES
from siltstone.sources import ingest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def grouped(rows, *keys):
    out = defaultdict(list)
    for r in rows:
        out[tuple(r[k] for k in keys)].append(r)
    return {k: sorted(v, key=lambda r: r["chunk_index"]) for k, v in out.items()}


def covers(words, pieces, overlap):
    """Whether the pieces are runs of ``words`` from the first to the last, that share at most ``overlap`` with the one before."""
    ends = {0}
    for i, p in enumerate(pieces):
        ends = {a + len(p) for e in ends for a in range(max(0, e - (overlap if i else 0)), e + 1) if words[a : a + len(p)] == p}
    return len(words) in ends


def test_covers_is_strict():
    assert covers(list("abcdef"), [list("abc"), list("cde"), list("ef")], 1) and not covers(list("abcdef"), [list("abc"), list("ef")], 1)
    assert not covers(list("abcdef"), [list("abcd"), list("bcdef")], 2) and not covers(list("abcdef"), [list("abcde")], 2)


def test_budget_split(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = grouped(QUERIES["budget_split"](spark, SF).collect(), "doc_id")
    assert {k for (k,) in got} == {i for i, t in texts.items() if t and t.strip()}
    for (i,), rows in got.items():
        assert [r["chunk_index"] for r in rows] == list(range(rows[0]["total_chunks"])) and len({r["total_chunks"] for r in rows}) == 1
        pieces = [r["text"].split() for r in rows]
        assert all(len(p) <= 256 for p in pieces) and covers(texts[i].split(), pieces, 32), i
        assert len(pieces) > 1 or rows[0]["text"] == texts[i]


def elements(spark):
    found = sections.html_elements(spark.read.parquet(f"{SF}/pages.parquet")).collect()
    pages = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["page_id"], r["pos"])):
        own = pages[r["page_id"]]
        if r["kind"] == "title" or not own:
            own.append([])
        own[-1].append(r)
    return pages


def test_title_sections(spark):
    pages = elements(spark)
    got = grouped(QUERIES["title_sections"](spark, SF).collect(), "page_id")
    assert {k for (k,) in got} == set(pages)
    for (page,), rows in got.items():
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        assert all(0 < len(r["text"]) <= 5000 for r in rows)
        plain = lambda s: "".join(s.split())
        assert "".join(plain(r["text"]) for r in rows) == "".join(plain(e["text"]) for part in pages[page] for e in part)
        # A chunk that a title begins within was joined, because the section that the title starts is short.
        sizes = [sum(len(e["text"]) for e in part) + 2 * (len(part) - 1) for part in pages[page]]
        starts, at = [], 0
        for part in pages[page]:
            starts.append(at)
            at += sum(len(plain(e["text"])) for e in part)
        at, begins = 0, set()
        for r in rows:
            begins.add(at)
            at += len(plain(r["text"]))
        assert all(s in begins or n < 200 for s, n in zip(starts, sizes, strict=True)), page


def test_fit_chunks(spark):
    pages = elements(spark)
    got = grouped(QUERIES["fit_chunks"](spark, SF).collect(), "page_id", "section")
    parts = {}
    for page, own in pages.items():
        first = 1 if own[0][0]["kind"] == "title" else 0
        for i, part in enumerate(own):
            parts[page, first + i] = part
    assert set(got) <= set(parts)
    for key, part in parts.items():
        rows = got.get(key, [])
        assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
        assert [t for r in rows for t in r["tables"]] == [e["text"] for e in part if e["kind"] == "table"]
        words = [w for e in part if e["kind"] != "table" for w in e["text"].split()]
        kept = [w for r in rows for w in r["text"].split()]
        assert all(len(r["text"].split()) <= 128 for r in rows)
        assert set(kept) == set(words) and not Counter(words) - Counter(kept), key
        for a, b in zip(rows, rows[1:], strict=False):  # small ones stand apart only where they do not fit
            assert len(b["text"].split()) >= 20 or len(a["text"].split()) + len(b["text"].split()) > 128


def test_short_sections_join_the_one_before():
    assert sections.combined([50, 10, 300, 10, 10, 250], 320, 200) == [0, 0, 1, 1, 2, 3]
    assert sections.combined([5, 5, 5], 5000, 0) == [0, 1, 2] and sections.combined([], 5000, 200) == []
    assert sections.combined([100, 98], 200, 99) == [0, 0] and sections.combined([100, 99], 200, 100) == [0, 1]


def test_files_with_many_titles_make_few_chunks(spark):
    rows = [("h", 0, p, kind, text, None) for p, (kind, text) in enumerate([("title", "One"), ("text", "a b"), ("title", "Two"), ("table", "<table><tr><td>k</td></tr><tr><td>v</td></tr></table>"), ("title", "Three"), ("text", "w " * 150), ("title", "Four"), ("image", "aW1n")])]
    rows = [(*r[:4], None if r[3] == "image" else r[4], r[4] if r[3] == "image" else None, None) for r in rows]
    e = spark.createDataFrame(rows, "content_hash string, range_no int, pos int, kind string, text string, image string, error string")
    apart = ingest.chunks(e, 256, 0).orderBy("chunk_index").collect()
    assert len(apart) == 4 and [r["tables"] != [] for r in apart] == [False, True, False, False]
    joined = ingest.chunks(e, 256, 0, combine=200).orderBy("chunk_index").collect()
    assert [r["text"].split("\n")[0] for r in joined] == ["One", "Three"] and {r["total_chunks"] for r in joined} == {2}
    assert len(joined[0]["tables"]) == 1 and "v" in joined[0]["text"] and joined[1]["images"] == ["aW1n"] and "Four" in joined[1]["text"]


def test_raw_text_and_share_of_truncation(spark):
    e = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, "c")], "page_id int, pos int, text string")
    assert {tuple(r) for r in sections.raw_text(e).collect()} == {(1, "a\nb"), (2, "c")}
    d = spark.createDataFrame([(100, ), (400, ), (200, )], "n int")
    got = [r["s"] for r in d.select("n", truncated_share(F.col("n"), 200).alias("s")).orderBy("n").collect()]
    assert got == [0, 0, 50]
