"""Nulls, empty and long texts, repeated rows, empty tables, and other columns with clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import language, mixing, packing, pii, quality, simhash, substrings, toxicity, urls, vectors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, n_words string, size long, fp int, key string, q double, chunk int, th int, toxic int"
LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [(1, "a b c", "en", "s", 5), (1, "a b c", "en", "s", 5), (2, None, None, None, None), (None, "a b c", "en", None, 5), (3, "", "de", "s", 0), (4, " \n\t", "de", "t", 3), (5, LONG, "en", "t", len(LONG)), (6, LONG, "en", "t", len(LONG)), (7, "é" * 50, "fr", "", 50), (None, None, None, None, None), (1, "other text of the same id", "en", "s", 4)]


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 9) for r in rows], SCHEMA)


ON_DOCUMENTS = {
    "quality": lambda s, d: quality.quality(s, d),
    "filtered": lambda s, d: quality.filtered(s, d),
    "simhash": lambda s, d: simhash.grouped(s, d),
    "deduplicated": lambda s, d: simhash.deduplicated(s, d),
    "substrings": lambda s, d: substrings.removed(s, d, with_text=True),
    "pii": lambda s, d: pii.found(s, d),
    "redacted": lambda s, d: pii.redacted(s, d),
    "mixed": lambda s, d: mixing.mixed(s, d),
    "repeated": lambda s, d: mixing.repeated(s, d),
    "packed": lambda s, d: packing.packed(s, d),
    "toxicity": lambda s, d: toxicity.scored(s, d, toxicity.train(d, d.select("doc_id", F.lit(0).alias("toxic")))),
    "language": lambda s, d: language.scored(s, d),
}
ROW_FOR_ROW = {"quality", "simhash", "substrings", "pii", "redacted", "mixed", "toxicity", "language"}


@pytest.mark.parametrize("name", sorted(ON_DOCUMENTS))
def test_documents(spark, name):
    d = table(spark, ROWS)
    out = ON_DOCUMENTS[name](spark, d)
    n = out.count()
    if name in ROW_FOR_ROW:
        assert n == len(ROWS)
    if name in ("filtered", "deduplicated", "redacted", "repeated"):
        assert out.columns == d.columns and out.schema["text"].dataType == d.schema["text"].dataType
    assert ON_DOCUMENTS[name](spark, d.limit(0)).count() == 0


def test_defined_results(spark):
    d = table(spark, ROWS)
    s = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.removed(spark, d).collect()}
    assert s[6, 60_000] == 60_000 and s[1, 3] == 0
    g = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.grouped(spark, d).collect()]
    assert {c for i, f, c in g if f == "0" * 16} == {2} and {c for i, f, c in g if i in (5, 6)} == {5}
    kept = [r["doc_id"] for r in simhash.deduplicated(spark, d).collect()]
    assert sorted(i for i in kept if i is not None) == [1, 1, 2, 5, 7]  # the other text of id 1 is in another component
    p = packing.packed(spark, d).collect()
    assert {r["doc_id"] for r in p} == {1, None, 5, 6, 7} and all(r["bin_words"] <= packing.CAPACITY for r in p)


def test_pages_and_vectors(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "http://a.net/", None), (None, "http://a.net/", None)], "page_id long, url string, host string")
    assert urls.judged(spark, pages, list(urls.RULES)).count() == 3
    assert urls.judged(spark, pages.limit(0), list(urls.RULES)).count() == 0
    assert urls.judged(spark, pages, []).count() == 3
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0], 2), (None, [1.0, 0.0], 3), (3, [1.0, None], 4)], "vec_id long, embedding array<float>, nid int")
    got = sorted((r["vec_id"] or 0, r["n_links"]) for r in vectors.linked(spark, v).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 0)]
    assert vectors.linked(spark, v.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 997}x" for j in range(70 + i)) + f" mail a{i}@b{i % 3}.com", "en", f"s{i % 2}", 10) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s0", 10) for i in range(5)] + [(200, "too short", "en", "s1", 9), (201, "same words here " * 60, "en", "s1", 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = f"file://{tmp_path}"
    d.write.parquet(f"{at}/documents.parquet")
    sizes, docs = [], d
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == d.columns
        out.write.parquet(f"{at}/{len(sizes)}")
        docs = spark.read.parquet(f"{at}/{len(sizes)}")
        sizes.append(docs)
    assert {r["doc_id"] for r in sizes[0].collect()} == {*range(40), *range(100, 105)}
    assert {r["doc_id"] for r in sizes[1].collect()} == set(range(40))
    assert sizes[2].where("text like '%@%'").count() == 0 and sizes[2].count() == 40
    words = sum(len(r["text"].split()) for r in sizes[3].collect())
    packs = corpus_pipeline.run(spark, at).collect()
    assert sum(r["length"] for r in packs) == words
    bins = {}
    for r in packs:
        bins.setdefault(r["bin_id"], []).append(r)
    assert all(sum(r["length"] for r in b) <= packing.CAPACITY and len({r["doc_id"] for r in b}) == len(b) for b in bins.values())
