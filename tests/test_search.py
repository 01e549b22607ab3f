import base64

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone.functions import validate
from siltstone.operators import bm25, dense, evaluate, fusion, hybrid, rerank
from siltstone.operators.filters import filtered
from siltstone.operators.quantize import Codec, encoded, exported, imported, scan


def ranking(spark, rows):
    return spark.createDataFrame(rows, "qid int, id string, score double, rank int")


def test_rrf_ties_go_to_the_vector_leg(spark):
    v = ranking(spark, [(1, "a", 0.9, 1), (1, "b", 0.8, 3)])
    b = ranking(spark, [(1, "b", 5.0, 1), (1, "a", 4.0, 3)])
    got = fusion.fused(v, b).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["a", "b"] and got[0]["rrf"] == got[1]["rrf"]
    with pytest.raises(ValueError):
        fusion.fused(v, b, weights=(1.0,))


def test_floor_passes_either_leg(spark):
    rows = [(1, "doc-v", 0.9, 5.0), (1, "strong", None, 4.5), (1, "weak", None, 0.1)]
    d = spark.createDataFrame(rows, "qid int, id string, v_score double, b_score double")
    assert {r["id"] for r in hybrid.floor(d, 0.5).collect()} == {"doc-v", "strong"}


def test_batch_equals_single(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(50)], "id long, embedding array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "qid int, embedding array<float>")
    one = [(r["id"], r["score"]) for r in dense.search(rows, [1.0, 2.0, 3.0], 7).orderBy("rank").collect()]
    many = [(r["id"], r["score"]) for r in dense.search_batch(rows, q, 7).orderBy("rank").collect()]
    assert [i for i, _ in one] == [i for i, _ in many]
    assert all(abs(a - b) < 1e-8 for (_, a), (_, b) in zip(one, many, strict=True))


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "red fox fox"), (2, ""), (3, None), (4, "red")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "fox"), (2, "!"), (3, "fox fox")], "qid int, query string")
    got = {(r["qid"], r["id"]): r["score"] for r in bm25.search(docs, q).collect()}
    assert set(got) == {(1, 1), (3, 1)} and abs(got[3, 1] - 2 * got[1, 1]) < 1e-8
    assert bm25.search(docs.limit(0), q).count() == 0


def test_filters(spark):
    d = spark.createDataFrame([Row(id=1, m='{"a": 1}'), Row(id=2, m='{"a": 5, "b": "x"}'), Row(id=3, m="{}")]).withColumn("meta", F.parse_json("m"))
    ids = lambda f: {r["id"] for r in filtered(d, f, "meta").collect()}
    assert ids({"a": 1}) == {1} and ids({"a": {"$gt": 1}}) == {2}
    assert ids({"a": {"$ne": 1}}) == {2, 3} and ids({"a": {"$nin": [1]}}) == {2, 3}
    assert ids({"$or": [{"a": 1}, {"b": "x"}]}) == {1, 2} and ids(None) == {1, 2, 3}
    with pytest.raises(validate.ValidationError):
        ids({"a": {"$near": 1}})


def test_codec(spark):
    rows = spark.createDataFrame([(i, [float((i * j) % 5) for j in range(1, 9)]) for i in range(1, 20)], "id long, embedding array<float>")
    codes = encoded(rows, Codec(8))
    got = [r["id"] for r in scan(imported(exported(codes)), Codec(8), [1.0, 2.0, 3.0, 4.0, 0.0, 1.0, 2.0, 3.0], 3).orderBy("rank").collect()]
    want = [r["id"] for r in dense.search(rows, [1.0, 2.0, 3.0, 4.0, 0.0, 1.0, 2.0, 3.0], 3).orderBy("rank").collect()]
    assert set(got) == set(want)
    for bad in ((0, 8), (4, 9)):
        with pytest.raises(ValueError):
            Codec(*bad)


def test_rerank_model(spark):
    pool = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "qid int, id string, rank int")
    texts = spark.createDataFrame([("a", "x"), ("b", "xx")], "id string, text string")
    q = spark.createDataFrame([(1, "q")], "qid int, query string")
    by_length = rerank.model(lambda: lambda qs, ts: [float(len(t)) for t in ts])
    assert [r["id"] for r in rerank.reranked(pool, texts, q, 10, by_length).orderBy("rank").collect()] == ["b", "a"]


def test_evaluation(spark):
    got = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 9, 1)], "qid int, item int, rank int")
    truth = spark.createDataFrame([(1, 6), (2, None)], "qid int, item int")
    r = {x["qid"]: x for x in evaluate.per_query(got, truth).collect()}
    assert (r[1]["hit"], r[1]["mrr"]) == (1.0, 0.5) and abs(r[1]["ndcg"] - 0.63093) < 1e-4 and r[2]["ndcg"] == 0.0


def test_guards():
    assert validate.check_text(" a ") == "a"
    assert validate.check_name("a-b_1") == "a-b_1"
    for f, bad in ((validate.check_text, "  "), (validate.check_name, "-a"), (validate.check_name, "a" * 64), (validate.check_metadata, {"text": 1}), (validate.check_metadata, {"x": object()}), (validate.check_top_k, 0), (validate.check_top_k, True), (validate.check_vector, [1.0, float("nan")])):
        with pytest.raises(validate.ValidationError):
            f(bad)


def test_queries_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)], "id long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, [float(i), 2.0, 1.0]) for i in range(9)], "qid int, embedding array<float>")
    whole = sorted(map(tuple, dense.search_batch(rows, q, 5).collect()))
    monkeypatch.setattr(dense, "MAX_QUERIES", 4)
    assert sorted(map(tuple, dense.search_batch(rows, q, 5).collect())) == whole and len(whole) == 45


def test_top_k_is_checked(spark):
    d = spark.createDataFrame([(1, "x", [1.0])], "id int, text string, embedding array<float>")
    for k in (0, 101, True):
        with pytest.raises(validate.ValidationError):
            hybrid.search(d, d.select(F.col("id").alias("qid"), F.col("text").alias("query"), "embedding"), k)


def test_codes_as_text_have_no_line_breaks(spark):
    long = bytes(range(256)) * 2
    d = spark.createDataFrame([(1, bytearray(long)), (2, bytearray()), (3, None)], "id int, codes binary")
    text = exported(d)
    assert {r["id"]: r["codes"] for r in text.collect()} == {1: base64.b64encode(long).decode(), 2: "", 3: None}
    assert {r["id"]: r["codes"] for r in imported(text).collect()} == {1: long, 2: b"", 3: None}


def test_tokens_in_python_are_those_of_spark(spark):
    """Every character up to U+0250 and some beyond, alone, in words and in texts of one kind."""
    from siltstone.operators import bm25

    chars = [chr(c) for c in [*range(1, 0x250), 0x307, 0x3A3, 0x2014, 0x4E2D, 0x660, 0x1F600, 0x10400, 0x2C65, 0xFFFD]]
    texts = [None, "", " ", "I\u0130I \u00cf\u00df\u0178", "\u00c9T\u00c9_1\u00d7\u00f72 \u00aa\u00ba \u00b2\u00bd a\u0301b"]
    texts += [f"Ab{c}{c}C {c} {c}x" for c in chars] + ["".join(chars[i : i + 40]) for i in range(0, len(chars), 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = bm25.parted(docs)
    assert rows.where("toks is null").count() > 300  # most go the new way
    found = rows.mapInArrow(bm25.token_batches, "id long, toks array<string>, dl int").collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, bm25.tokenized(docs).collect()))


def test_texts_are_not_shuffled_to_meet_vectors(spark, monkeypatch):
    """The keyword leg reads texts without a join, and a rerank joins those of its pool only, also where small tables are not broadcast."""
    from siltstone.operators import bm25
    from siltstone.plans import queries

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    search, seen = bm25.search, []
    monkeypatch.setattr(bm25, "search", lambda docs, *a, **b: seen.append(plan(docs)) or search(docs, *a, **b))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = plan(queries.QUERIES["hybrid_rerank"](spark, "/root/testdata/sf0.001"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert seen and not any("Join" in p for p in seen)
    assert "BroadcastHashJoin [doc_id" in found and "LeftSemi" in found


def test_passages_are_found_where_texts_are_read(spark):
    """Against a plain search, with odd white space, words cut at either end, anchors in common and repeated items."""
    import itertools

    from siltstone.operators import evaluate

    texts = ["a b c d e f g h i j k", "xa b c d e f g h i jk", "a b c d e f g h X j", "\u00a0a  b\tc d", "a b\u2003c d e", None, "", "b c", "a b c d e f g h i j l a b c d e f g h i j k"]
    passages = ["a b c d e f g h i j", "a b c d e f g h i j k", "b c d", " b c", "a  b\tc", "c d e f g h i j", "b", "b c", None, "  ", "a b c d e f g h i j l", "z z z", "a b\u2003c"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "item long, text string")
    asked = spark.createDataFrame([(i, p) for i, p in enumerate(passages)] + [(None, "b c d")], "qid long, passage string")
    want = {(q, i) for (i, t), (q, p) in itertools.product(enumerate(texts), [*enumerate(passages), (None, "b c d")]) if t is not None and p is not None and p.strip(" ") and p in t}
    got = list(map(tuple, evaluate.containing(docs, asked).collect()))
    assert len(got) == len(set(got)) and set(got) == want
    assert evaluate.containing(docs, asked.where("false")).count() == 0
    one = evaluate.containing(docs, asked.where("qid = 0"))._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in one and "Join" not in one  # no row for a run of words, no text meets its candidates again
