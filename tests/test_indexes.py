"""Stored indexes and what collections know of their files: cells, postings, zone maps, Bloom filters, deletion bitmaps."""

import os
import random
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.functions import validate
from siltstone.operators import bm25, dense, hybrid, ivf, postings
from siltstone.sources.collections import Store

WORDS = [f"w{i}" for i in range(300)]


def texts(n, seed=1):
    r = random.Random(seed)
    return [(str(i), " ".join(r.choices(WORDS, [1 / (j + 1) for j in range(len(WORDS))], k=r.randint(0, 80)))) for i in range(n)]


def rows(spark, n, seed=1):
    meta = lambda i: f'{{"lang": "{["en", "de", "fr"][i % 3]}", "year": {1990 + i % 20}}}'
    return spark.createDataFrame([(i, t or "x", [float(int(i) % 7), 1.0], meta(int(i)), f"h{i}") for i, t in texts(n, seed)], "id string, text string, embedding array<float>, metadata string, content_hash string")


def ranked(df):
    return sorted((r["qid"], r["rank"], str(r["id"]), round(r["score"], 7)) for r in df.collect())


# ---- cells ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def points(spark):
    r = np.random.default_rng(4)
    centres = r.normal(0, 1, (40, 16))
    x = centres[r.integers(40, size=4000)] + r.normal(0, 0.25, (4000, 16))
    return spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "id long, embedding array<double>, label int").repartition(4)


@pytest.fixture(scope="module")
def cells(spark, points, tmp_path_factory):
    return ivf.Index(f"file://{tmp_path_factory.mktemp('cells')}/a", spark).build(points, keep=("label",))


def test_cells_find_what_the_exact_search_finds(spark, points, cells):
    q = points.where("id % 100 = 0").select(F.col("id").alias("qid"), "embedding")
    n = len(cells.centroids)
    assert n > 30
    own = cells.probes_for()
    assert own < n / 2 and cells.recall(points, q) >= 0.95
    assert ranked(cells.search_batch(q, 10, n)) == ranked(dense.search_batch(points, q, 10))
    vector = points.where("id = 7").first()["embedding"]
    assert cells.files(vector, 1) < cells.files(vector, own) < cells.files(vector, n)
    one = [(r["rank"], r["id"], r["score"]) for r in cells.search(list(vector), 5, n).orderBy("rank").collect()]
    assert one == [(r["rank"], r["id"], r["score"]) for r in dense.search(points, list(vector), 5).orderBy("rank").collect()]
    found = cells.search(list(vector), 5, n, F.col("label") == 1).join(points, "id")
    assert {r["label"] for r in found.collect()} == {1}


def test_cells_of_odd_rows(spark, tmp_path):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [1.0, 0.0])], "id int, embedding array<double>")
    index = ivf.Index(f"file://{tmp_path}/a", spark).build(d)
    assert [r["id"] for r in index.search([1.0, 0.0], 9, 99).orderBy("rank").collect()] == [1, 7, 5]
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("inf"), 0.0]), (3, [1.0]), (4, None)], "qid int, embedding array<double>")
    assert {r["qid"] for r in index.search_batch(q, 3, 99).collect()} == {1}
    with pytest.raises(validate.ValidationError):
        index.search([1.0, float("nan")])
    empty = ivf.Index(f"file://{tmp_path}/b", spark).build(d.limit(0))
    assert empty.search_batch(q, 3).count() == 0


def test_a_hot_cell_is_dealt_over_files(spark, tmp_path):
    d = spark.range(3000).select("id", F.when(F.col("id") < 2600, F.array(F.lit(1.0), F.lit(0.001) * (F.col("id") % 5))).otherwise(F.array(F.sin("id"), F.cos("id"))).alias("embedding"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tables lie in one task
    try:
        index = ivf.Index(f"file://{tmp_path}/a", spark).build(d, cells=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_cell = index._cells().select("cell", "_metadata.file_path").distinct().groupBy("cell").count().agg(F.max("count")).first()[0]
    assert per_cell > 1 and index._cells().count() == 3000


def test_cells_belong_to_a_version(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2)
    s.append("a", rows(spark, 30))
    one = ivf.index_of(s, "a")
    assert ivf.index_of(s, "a").path == one.path
    s.delete("a", spark.createDataFrame([("3",)], "id string"))
    assert {r["id"] for r in ivf.index_of(s, "a").search([3.0, 1.0], 40, 99).collect()} == {str(i) for i in range(30) if i != 3}


# ---- dense edges ---------------------------------------------------------------------------------


def test_dense_leaves_out_what_has_no_cosine(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [1.0]), (4, [1.0, None]), (5, [float("inf"), 1.0]), (6, []), (7, None)], "id int, embedding array<double>")
    assert [r["id"] for r in dense.search(d, [1.0, 0.5], 9).collect()] == [1]
    q = spark.createDataFrame([(1, [1.0, 0.5]), (2, [2.0]), (3, [float("nan"), 1.0])], "qid int, embedding array<double>")
    assert sorted((r["qid"], r["id"]) for r in dense.search_batch(d, q, 9).collect()) == [(1, 1), (2, 3)]
    for k in (0, -1, True, 10**6):
        with pytest.raises(validate.ValidationError):
            dense.search(d, [1.0, 0.5], k)
        with pytest.raises(validate.ValidationError):
            dense.search_batch(d, q, k)


def test_dense_in_small_products(spark, monkeypatch):
    d = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(90)], "id long, embedding array<float>")
    q = spark.createDataFrame([(i, [float(i), 2.0, 1.0]) for i in range(9)], "qid int, embedding array<float>")
    whole = ranked(dense.search_batch(d, q, 5))
    monkeypatch.setattr(dense, "MAX_PRODUCTS", 40)
    assert ranked(dense.search_batch(d, q, 5)) == whole


# ---- postings ------------------------------------------------------------------------------------


def test_postings_equal_the_scan_and_skip_shards(spark, tmp_path):
    docs = spark.createDataFrame([(int(i), t) for i, t in texts(1500)] + [(9001, None), (9002, "")], "doc_id long, text string").repartition(4)
    postings.build(docs, f"file://{tmp_path}/a", id="doc_id", shard=16)
    index = postings.Index(spark, {"a": f"file://{tmp_path}/a"})
    q = spark.createDataFrame([(1, "w0 w299"), (2, "w120 w250 w7"), (3, "w5 w5 w290 nowhere"), (4, "!"), (5, " ".join(WORDS[:40])), (6, "w298")], "qid int, query string")
    for k1, b in ((1.5, 0.75), (0.9, 0.2)):
        got, report = index.plan(q, 3, k1, b)
        assert ranked(got) == ranked(bm25.search(docs, q, 3, k1, b))
        seen = {r["qid"]: (r["n"], r["opened"]) for r in report.groupBy("qid").agg(F.count("*").alias("n"), F.count_if("opened").alias("opened")).collect()}
        assert seen[1][1] < seen[1][0] / 2 and seen[3][1] < seen[3][0]  # short questions leave most shards unread
    assert index.search(q.where("qid = 4")).count() == 0 and postings.Index(spark).search(q).count() == 0
    with pytest.raises(validate.ValidationError):
        index.search(q, 0)


def test_a_question_reads_the_directories_of_its_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "PER_BUCKET", 20)
    docs = spark.createDataFrame([(int(i), t) for i, t in texts(400)], "doc_id long, text string")
    postings.build(docs, f"file://{tmp_path}/a", id="doc_id", shard=32)
    assert len([x for x in os.listdir(f"{tmp_path}/a/blocks") if x.startswith("bucket=")]) == 20
    index = postings.Index(spark, {"a": f"file://{tmp_path}/a"})
    h = spark.createDataFrame([("w3",)], "t string").select(F.xxhash64("t")).first()[0]
    d = index._blocks({"w3": h}, {"a": 20})
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "EqualTo(term,w3)" in plan
    read = {r["f"].split("/")[-2] for r in spark.read.parquet(f"file://{tmp_path}/a/blocks").where(F.col("bucket") == h % 20).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}
    assert read == {f"bucket={h % 20}"}
    q = spark.createDataFrame([(1, "w3"), (2, "w9 w4")], "qid int, query string")
    monkeypatch.setattr(postings, "TERMS", 1)  # queries in blocks
    assert ranked(index.search(q)) == ranked(bm25.search(docs, q))


def test_segments_follow_a_collection(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2)
    q = spark.createDataFrame([(1, "w1 w20"), (2, "w250"), (3, "plum")], "qid int, query string")
    same = lambda: ranked(postings.index_of(s, "a").search(q)) == ranked(bm25.search(s.table("a"), q, id="id"))
    s.append("a", rows(spark, 60))
    assert same()
    first = dict(postings.index_of(s, "a").segments)
    s.append("a", rows(spark, 120, seed=2))  # ids 60 to 119 are new
    second = postings.index_of(s, "a").segments
    assert same() and len(second) == 2 and first.items() <= second.items()  # the append built one segment
    s.delete("a", spark.createDataFrame([(str(i),) for i in range(0, 120, 7)], "id string"))
    assert postings.index_of(s, "a").segments == second and same()
    s.update("a", spark.createDataFrame([("5", "plum w1 w1"), ("61", "w250 plum")], "id string, text string"))
    assert len(postings.index_of(s, "a").segments) == 3 and same()
    s.compact("a")
    assert len(postings.index_of(s, "a").segments) == 1 and same()
    d = s.table("a")
    ask = q.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    cols = ["qid", "id", "rank", "v_rank", "b_rank"]
    assert sorted(hybrid.search(d, ask, 5, index=postings.index_of(s, "a")).select(*cols).collect()) == sorted(hybrid.search(d, ask, 5).select(*cols).collect())


# ---- collections ---------------------------------------------------------------------------------


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def test_deleting_writes_bitmaps_only(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2, rows_per_file=50)
    s.append("a", rows(spark, 600))
    before, version = size(tmp_path), s.version("a")
    gone = [str(i) for i in (0, 5, 99, 100, 101, 300, 301, 302, 598, 599)]
    s.delete("a", spark.createDataFrame([(i,) for i in [*gone, "nobody", None]], "id string"))
    assert size(tmp_path) - before < 12_000
    assert {r["id"] for r in s.table("a").collect()} == {str(i) for i in range(600)} - set(gone) and s.count("a") == 590
    assert s.table("a", version=version).count() == 600 and s.count("a", version) == 600  # the old version is readable
    assert {r["id"] for r in s.dead("a").collect()} == set(gone) and s.dead("a", version) is None
    assert s.get("a", "5").count() == 0 and s.get("a", "6").count() == 1
    s.delete("a", spark.createDataFrame([("6",), ("5",)], "id string"))  # bitmaps add up
    assert s.count("a") == 589 and s.get("a", "6").count() == 0 and s.get("a", "5").count() == 0
    s.append("a", rows(spark, 6))  # 0 and 5 come back
    assert s.count("a") == 591 and s.get("a", "5").count() == 1
    s.compact("a")
    assert s.count("a") == 591 and len(s._head("a")["parts"]) == 1 and s._head("a")["deleted"] is None
    s.vacuum("a")
    assert s.count("a") == 591
    with pytest.raises(errors.StorageError):
        s.table("a", version=version)


def test_updates_write_what_changes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2)
    s.append("a", rows(spark, 500))
    s.update("a", spark.createDataFrame([("3", "new", '{"lang": "xx"}'), ("999", "nobody", None)], "id string, text string, metadata string"))
    part = s._head("a")["parts"][-1]
    assert s.part("a", part).count() == 1 and s.count("a") == 500
    r = s.get("a", "3").first()
    assert r["text"] == "new" and r["seq"] == 3 or r["updated_at"] is not None
    assert [x["id"] for x in s.documents("a", {"lang": "xx"}).collect()] == ["3"]
    s.replace("a", spark.createDataFrame([("h3",), ("h4",)], "content_hash string"), rows(spark, 6).where("id in ('4', '5')"))
    assert s.count("a") == 499 and s.get("a", "3").count() == 0 and s.get("a", "4").count() == 1  # 5 is there already


def test_filters_skip_files(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2, hot={"lang": "string", "year": "bigint"}, rows_per_file=40)
    s.append("a", rows(spark, 600))
    s.create("b", 2, rows_per_file=40)
    s.append("b", rows(spark, 600))
    every = len(s.files_for("a"))
    assert every == 15
    cases = [{"lang": "de"}, {"lang": {"$in": ["de", "xx"]}}, {"lang": "de", "year": {"$gte": 2005}}, {"$or": [{"lang": "fr"}, {"year": 1991}]}, {"$and": [{"lang": "en"}, {"year": {"$lt": 1992}}]}, {"lang": {"$ne": "de"}}, {"year": {"$gt": 3000}}, {"other": 1}, {"year": 1991.0}]
    for f in cases:
        want = sorted(r["id"] for r in s.documents("b", f).collect())
        assert sorted(r["id"] for r in s.documents("a", f).collect()) == want
    assert len(s.files_for("a", {"lang": "de"})) <= 7 and len(s.files_for("a", {"lang": "de", "year": {"$gte": 2005}})) <= 3
    assert s.files_for("a", {"year": {"$gt": 3000}}) == [] and len(s.files_for("a", {"lang": {"$ne": "de"}})) == every
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = s.documents("a", {"lang": "de"})._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "EqualTo(hot_0,de)" in plan


def test_ids_are_looked_up_in_few_files(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2, hot={"lang": "string"}, rows_per_file=25)  # sorted by language first, so that ranges of ids overlap
    s.append("a", rows(spark, 500))
    s.append("a", rows(spark, 700, seed=3))
    head = s._head("a")
    one = lambda i: spark.createDataFrame([(i,)], "id string")
    opened = [len(s._files_of(head, one(str(i)))) for i in range(0, 700, 97)]
    assert len(s.files_for("a")) == 28 and max(opened) <= 2 and sum(opened) <= len(opened) + 2
    assert s._files_of(head, one("nobody")) == [] and s.get("a", "nobody").count() == 0
    assert s.get("a", "699").first()["id"] == "699"


def test_one_of_many_writers_wins(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 1)
    head, won = s._head("a") | {"version": 1}, []

    def write(i):
        try:
            s._write("a", head | {"writer": i})
            won.append(i)
        except errors.StorageError:
            pass

    threads = [threading.Thread(target=write, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and s._head("a")["writer"] == won[0]
    assert not [x for x in os.listdir(f"{tmp_path}/a/heads") if x.startswith("new-")]


def test_two_writers_from_one_version(spark, tmp_path):
    """Both read version 1 before either writes; the second fails and its rows are not there."""
    s = Store(spark, f"file://{tmp_path}")
    s.create("a", 2)
    s.append("a", rows(spark, 5))
    head = s._head("a")
    s.delete("a", spark.createDataFrame([("1",)], "id string"))
    with pytest.raises(errors.StorageError):
        s._commit(head, rows(spark, 9).where("id >= '5'"))
    assert s.count("a") == 4


def test_guarded_stores_refuse_reserved_keys(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}").guarded()
    s.create("a", 2)
    bad = rows(spark, 2).withColumn("metadata", F.lit('{"chunk_index": 1}'))
    with pytest.raises(errors.ValidationError):
        s.append("a", bad)
    s.append("a", rows(spark, 2))
    with pytest.raises(errors.ValidationError):
        s.create("c", 2, hot={"x": "map"})
