"""What may not grow with pairs of documents and questions, or with what a Python worker is given at once."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.operators import bm25, postings

WORDS = [f"w{i}" for i in range(60)]


def corpus(spark, n=300):
    r = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(r.choice(WORDS, 12).tolist())) for i in range(n)] + [(n, None)], "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame([(i, " ".join(WORDS[i : i + 20])) for i in range(30)], "qid int, query string")


def plain(docs, queries, k=5, k1=1.5, b=0.75):
    toks = {r["doc_id"]: (r["text"] or "").split() for r in docs.collect()}
    mean = sum(map(len, toks.values())) / len(toks)
    df = {w: sum(w in t for t in toks.values()) for w in WORDS}
    out = {}
    for q in queries.collect():
        own = [(-round(sum(np.log(1 + (len(toks) - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) / (k1 * (1 - b + b * len(t) / mean) + t.count(w)) for w in q["query"].split()), 9), i) for i, t in toks.items()]
        out[q["qid"]] = [i for s, i in sorted(own) if s < 0][:k]
    return out


def found(d):
    out = {}
    for r in d.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["id"])
    return out


def plan_of(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_no_pair_of_a_question_and_a_document_is_shuffled(spark, monkeypatch):
    docs, q = corpus(spark)
    got = bm25.search(docs, q, 5)
    assert "Aggregate" not in plan_of(got) and "Join" not in plan_of(got)
    want = plain(docs, q)
    assert found(got) == want
    monkeypatch.setattr(bm25, "MAX_NUMBERS", 400)  # many small matrices
    monkeypatch.setattr(bm25, "MAX_QUERIES", 8)  # and several passes
    assert found(bm25.search(docs, q, 5)) == want


def test_the_index_scores_shards_in_place(spark, tmp_path, monkeypatch):
    docs, q = corpus(spark)
    postings.build(docs, f"file://{tmp_path}/a", id="doc_id", shard=16)
    index = postings.Index(spark, {"a": f"file://{tmp_path}/a"})
    got, report = index.plan(q, 5)
    assert "Aggregate [qid" not in plan_of(got) and found(got) == plain(docs, q)
    sizes = spark.read.parquet(f"file://{tmp_path}/a/blocks").select("shard", F.explode("ids").alias("id")).groupBy("shard").agg(F.countDistinct("id").alias("n"))
    assert sizes.agg(F.max("n")).first()[0] == 16 and report.select("shard").distinct().count() == sizes.count()
    monkeypatch.setattr(postings, "MAX_TOKENS", 50)  # long texts end a shard early
    postings.build(docs, f"file://{tmp_path}/b", id="doc_id", shard=16)
    assert found(postings.Index(spark, {"b": f"file://{tmp_path}/b"}).search(q, 5)) == plain(docs, q)


def test_groups_go_through_python_as_a_stream(spark):
    from siltstone.chunking import budget, sections

    none = F.array().cast("array<string>")
    rows = spark.range(3000).select((F.col("id") % 700).alias("doc_id"), F.col("id").alias("line"), F.concat_ws(" ", F.lit("word"), F.col("id")).alias("text"), none.alias("tables"), none.alias("images"))
    got = budget.fitted(rows, ["doc_id"], "line", 8, 3, 0)
    assert "MapInArrow" in plan_of(got) and "FlatMapGroups" not in plan_of(got)  # no call for each group
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # groups that lie in several batches
    try:
        made = {(r["doc_id"], r["chunk_index"]): r["text"] for r in got.collect()}
        cut = sections.sections(rows.select("doc_id", F.col("line").alias("pos"), F.when(F.col("line") < 700, "title").otherwise("text").alias("kind"), "text"), 20, id="doc_id")
        assert "FlatMapGroups" not in plan_of(cut)
        parts = {(r["doc_id"], r["chunk_index"]): r["text"] for r in cut.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, packed = {}, {}
    for d in range(700):
        own = [f"word {i}" for i in range(d, 3000, 700)]
        want |= {(d, i): c[0] for i, c in enumerate(budget.fit([(t, [], []) for t in own], budget.words, 8, 3, 0))}
        packed |= {(d, i): t for i, t in enumerate(sections.packed_sections([own], 20))}
    assert made == want and parts == packed


def test_texts_go_through_python_by_bytes(spark, monkeypatch):
    import pyarrow as pa

    from siltstone.functions import runs

    b = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "bb", "c" * 50, "", "dd"]})
    got = [r.column("t").to_pylist() for r in runs.text_runs(iter([b]), "t", 6)]
    assert got == [["aaaa", None, "bb"], ["c" * 50], ["", "dd"]]


def test_vectors_of_hashes_by_bounded_runs(spark, monkeypatch):
    from siltstone.operators import embed

    monkeypatch.setattr(embed, "RUN_TOKENS", 3)
    monkeypatch.setattr(embed, "REMEMBERED", 2)
    d = spark.createDataFrame([(1, "one two two"), (2, ""), (3, None), (4, "three four five six seven"), (5, "one two two")], "doc_id int, text string")
    got = {r["doc_id"]: r["embedding"] for r in embed.embedded(d, embed.hashing(8)).collect()}
    assert got[3] is None and got[2] == [0.0] * 8 and got[1] == got[5] and abs(sum(x * x for x in got[4]) - 1) < 1e-6


def test_a_task_passes_on_its_best_of_all_cells(spark, tmp_path):
    from siltstone.operators import ivf

    r = np.random.default_rng(1)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.standard_normal((400, 4)))], "id long, embedding array<double>")
    index = ivf.Index(f"file://{tmp_path}/i", spark).build(d, cells=20)
    q = d.where("id < 5").withColumnRenamed("id", "qid")
    part = index._block(q.select("qid", F.col("embedding").alias("q")), 3, 20)
    assert part.count() <= 5 * 3 * part.rdd.getNumPartitions()  # not k of every cell
    s = r.standard_normal((30, 50))
    for probes in (1, 2, 7, 20, 50):
        cells, scores = ivf.nearest_cells(s, np.eye(50), probes)
        assert (cells == np.argsort(-s, axis=1, kind="stable")[:, :probes]).all() and (np.diff(scores, axis=1) <= 0).all()


def test_files_of_a_collection_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    from siltstone.sources import collections

    monkeypatch.setattr(collections, "BYTES_PER_FILE", 10_000)
    s = collections.Store(spark, f"file://{tmp_path}")
    s.create("a", 2)
    s.append("a", spark.range(50).select(F.col("id").cast("string").alias("id"), F.expr("repeat('x ', 500)").alias("text"), F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding")))
    d = s.table("a")
    assert d.count() == 50 and len(d.inputFiles()) >= 4
