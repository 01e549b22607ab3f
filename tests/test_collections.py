import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.config import from_environment
from siltstone.operators import embed, evaluate, postings
from siltstone.sources import files, golden, ingest
from siltstone.sources.collections import Store

MARKDOWN = b"# Title\n\nSome words of a paragraph.\n\n| Name | Score |\n|---|---|\n| Alice | 92 |\n"


def test_collection_life(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2)
    with pytest.raises(errors.CollectionExists):
        s.create("a", 2)
    rows = spark.createDataFrame([("1", "x", [1.0, 0.0], '{"k": 1}'), ("2", "y", [0.0, 1.0], None)], "id string, text string, embedding array<float>, metadata string")
    s.append("a", rows)
    s.append("a", rows)
    assert s.count("a") == 2 and s.names() == ["a"] and s.version("a") == 2
    assert [r["id"] for r in s.documents("a", {"k": 1}).collect()] == ["1"]
    with pytest.raises(errors.ValidationError):
        s.append("a", rows.withColumn("embedding", F.array(F.lit(1.0))))
    s.delete("a", spark.createDataFrame([("1",)], "id string"))
    assert s.get("a", "1").count() == 0 and s.count("a") == 1
    s.compact("a")
    assert s.vacuum("a") > 0 and s.count("a") == 1
    s.drop("a")
    assert not s.exists("a") and s.table("a", missing_is_empty=True).count() == 0
    with pytest.raises(errors.CollectionNotFound):
        s.table("a")


def office(name: str, xml: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(name, xml)
    return out.getvalue()


def test_parsers():
    assert [e[0] for e in files.markdown(MARKDOWN)] == ["title", "text", "table"]
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    cell = "<w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc>"
    got = files.docx(office("word/document.xml", f"<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:tbl><w:tr>{cell}</w:tr></w:tbl></w:body></w:document>"))
    assert [e[0] for e in got] == ["title", "table"]
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    got = files.pptx(office("ppt/slides/slide1.xml", f"<s {a}><a:p><a:r><a:t>T</a:t></a:r></a:p><a:p><a:r><a:t>x</a:t></a:r></a:p></s>"))
    assert [e[:2] for e in got] == [("title", "T"), ("text", "x")]


def test_ingest_is_idempotent_and_shows_failures(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_bytes(MARKDOWN)
    (src / "bad.docx").write_bytes(b"no zip")
    (src / "skip.txt").write_bytes(b"x")
    s = Store(spark, f"file://{tmp_path}/store")
    e = embed.hashing(8)
    found = files.files(spark, str(src))
    first = {r["source_filename"]: r["status"] for r in ingest.ingest(s, "c", found, e).collect()}
    assert first["a.md"].startswith("Successfully") and first["bad.docx"].startswith("FAILED") and "skip.txt" not in first
    n = s.count("c")
    again = {r["source_filename"]: r["status"] for r in ingest.ingest(s, "c", found, e).collect()}
    assert again["a.md"].startswith("already ingested") and s.count("c") == n
    ingest.ingest(s, "c", found, e, force=True)
    assert s.count("c") == n


def test_settings():
    s = from_environment({"SILTSTONE_SEARCH_TOP_K": "5", "SILTSTONE_CODEC_ENABLED": "true"})
    assert s.search.top_k == 5 and s.codec.active and s.search.candidates() == 50


def test_heads_are_never_replaced(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 1)
    head = s._head("a")
    s.append("a", spark.createDataFrame([("1", "x", [1.0])], "id string, text string, embedding array<float>"))
    with pytest.raises(errors.StorageError):  # a writer that began from the version before
        s._write("a", head | {"version": head["version"] + 1})
    assert s.version("a") == 1 and s.count("a") == 1
    with pytest.raises(errors.ValidationError):
        s.create("b", 1, {"text": 1})


def test_updates_are_checked_and_unique(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 1)
    s.append("a", spark.createDataFrame([("1", "x", [1.0]), ("2", "y", [2.0])], "id string, text string, embedding array<float>"))
    s.update("a", spark.createDataFrame([("1", "new"), ("1", "new")], "id string, text string"))
    assert sorted(r["text"] for r in s.table("a").collect()) == ["new", "y"]
    with pytest.raises(errors.ValidationError):
        s.update("a", spark.createDataFrame([("1", "z", [1.0, 2.0])], "id string, text string, embedding array<float>"))
    with pytest.raises(errors.ValidationError):
        s.replace("a", spark.createDataFrame([("h",)], "content_hash string"), spark.createDataFrame([("3", None, [1.0])], "id string, text string, embedding array<float>"))


def test_an_index_follows_its_collection(spark, tmp_path):
    """As many rows before and after an update, and other words in them."""
    s, q = Store(spark, f"file://{tmp_path}"), spark.createDataFrame([(1, "apple"), (2, "plum")], "qid int, query string")
    s.create("a", 1)
    s.append("a", spark.createDataFrame([("1", "apple pie", [1.0])], "id string, text string, embedding array<float>"))
    assert [r["qid"] for r in postings.index_of(s, "a").search(q).collect()] == [1]
    s.update("a", spark.createDataFrame([("1", "plum pie")], "id string, text string"))
    assert [r["qid"] for r in postings.index_of(s, "a").search(q).collect()] == [2]


def test_pages_are_parsed_in_ranges(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x" * 60)
    (tmp_path / "b.md").write_bytes(MARKDOWN)
    files.register(".pdf", lambda c, first, last: [("text", f"{first}-{last}", first, None)], pages=len)
    try:
        got = files.elements(files.ranges(files.files(spark, str(tmp_path)))).collect()
    finally:
        del files.PARSERS[".pdf"]
    assert sorted(r["text"] for r in got if r["file_type"] == ".pdf") == ["1-25", "26-50", "51-60"]
    assert {r["range_no"] for r in got if r["file_type"] == ".md"} == {0}


def test_golden_questions_and_reports(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "q1", "question": "a?", "ground_truth_chunk_indices": [2, 3], "metadata": {"difficulty": "easy"}}\n\n{"id": "q2", "question": "b?", "ground_truth_chunk_indices": []}\n')
    g = golden.questions(spark, str(tmp_path / "q.jsonl"))
    assert sorted(map(tuple, golden.truth(g).collect()), key=str) == [("q1", 2), ("q1", 3), ("q2", None)]
    got = spark.createDataFrame([("q1", 3, 1), ("q2", 9, 1)], "qid string, item int, rank int")
    scores = evaluate.per_query(got, golden.truth(g))
    at = golden.report(scores, evaluate.overall(scores), f"file://{tmp_path}/out")
    assert spark.read.json(f"{at}/queries").count() == 2
    assert "| hit_rate | 0.5000 |" in [r["value"] for r in spark.read.text(f"{at}/summary").collect()]


def test_passages_are_found_where_they_are_contained(spark):
    d = spark.createDataFrame([(1, "x a b c d e f g h i j k"), (2, "xa b c d e f g h i jz"), (3, "q a b"), (4, None), (5, "")], "item int, text string")
    p = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b"), (3, "zz"), (4, " b c ")], "qid int, passage string")
    assert sorted(map(tuple, evaluate.containing(d, p).collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (4, 1), (4, 2)]


def test_short_passages_are_found_inside_words_without_a_nested_loop(spark):
    r = random.Random(9)
    piece = lambda n: "".join(r.choice("abé \t\n") for _ in range(n))
    texts = [(i, piece(r.randint(0, 60))) for i in range(120)] + [(500, None), (501, "x" * 5000 + "needles" + "y" * 5000)]
    asked = [(i, piece(r.randint(0, 12))) for i in range(150)] + [(900, None), (901, ""), (902, " \t"), (903, "needles"), (904, "xneedlesy"), (905, "needless")]
    d, p = spark.createDataFrame(texts, "item int, text string"), spark.createDataFrame(asked, "qid int, passage string")
    found = evaluate.containing(d, p)
    assert {tuple(x) for x in found.collect()} == {(q, i) for q, s in asked if s and s.strip() for i, t in texts if t and s in t}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and not any("Join Inner" in line and " = " not in line for line in plan.splitlines())
