"""Ingestion in operation: streams with state, an embedding cache, codes by settings, files that are refused."""

import pytest
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.config import CodecConfig
from siltstone.operators import bm25, cache, dense, embed, quantize
from siltstone.sources import files, ingest
from siltstone.sources.collections import Store
from siltstone.streaming import ingest as streaming

MARKDOWN = b"# Title\n\nSome words of a paragraph.\n"


class Counted:
    """An embedder that leaves a row for every text that it embeds."""

    def __init__(self, path):
        self.path = str(path)

    def embedder(self):
        path = self.path

        def load():
            def run(texts):
                with open(path, "a") as f:
                    f.write("".join(f"{t}\n" for t in texts))
                return [[float(len(t)), 1.0] for t in texts]

            return run

        return embed.Embedder(2, load=load)

    def calls(self):
        with open(self.path) as f:
            return sorted(f.read().split("\n")[:-1])


def test_a_second_ingestion_embeds_only_new_texts(spark, tmp_path):
    seen = Counted(tmp_path / "calls")
    known = cache.Cache(spark, f"file://{tmp_path}/cache", "m1")
    one = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "a"), (4, None)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in known.embedded(one, seen.embedder()).collect()}
    assert got == {1: [1.0, 1.0], 2: [2.0, 1.0], 3: [1.0, 1.0], 4: None} and seen.calls() == ["a", "bb"]
    two = spark.createDataFrame([(1, "bb"), (2, "ccc")], "id int, text string")
    assert {r["id"]: r["embedding"][0] for r in known.embedded(two, seen.embedder()).collect()} == {1: 2.0, 2: 3.0}
    assert seen.calls() == ["a", "bb", "ccc"] and known.count() == 3
    assert cache.Cache(spark, f"file://{tmp_path}/cache", "m2").count() == 0  # another model
    assert known.evict(1) == 2 and known.runs() != []
    known.embedded(one, seen.embedder()).collect()
    assert seen.calls() == ["a", "a", "bb", "ccc"]  # what was evicted is embedded again


def test_rows_with_null_texts_stay(spark):
    rows = spark.createDataFrame([(1, "x y"), (2, None), (3, "x y")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in embed.embedded(rows, embed.hashing(4)).collect()}
    assert got[1] == got[3] and got[1] is not None and got[2] is None
    known = rows.where("id = 1").withColumn("embedding", F.array(F.lit(9.0), F.lit(9.0)))
    assert {r["embedding"][0] for r in embed.embedded(rows, embed.hashing(2), known).where("id <> 2").collect()} == {9.0}


def land(spark, at, rows):
    spark.createDataFrame(rows, "text string, metadata string").coalesce(1).write.mode("append").parquet(at)


def test_streams_keep_contents_in_state(spark, tmp_path):
    s, at = Store(spark, f"file://{tmp_path}/store"), f"file://{tmp_path}/landing"
    e = embed.Embedder(1, column=lambda c: F.array(F.lit(1.0)).cast("array<float>"))
    run = lambda: streaming.start(spark.readStream.schema("text string, metadata string").parquet(at), s, "c", e, f"file://{tmp_path}/progress").awaitTermination()
    s.ensure("c", 1)
    s.append("c", spark.createDataFrame([("old", "was there", [1.0], ingest.content_id("was there"))], "id string, text string, embedding array<float>, content_hash string"))
    land(spark, at, [("a", None), ("b", None), ("a", None), ("was there", None)])
    run()
    assert s.count("c") == 3
    land(spark, at, [("a", None), ("c", None)])
    run()
    assert sorted(r["text"] for r in s.table("c").collect()) == ["a", "b", "c", "was there"]
    head = s._head("c")
    (source,) = head["streams"]
    # A batch that is written again, as after a failure between the write and the stream's own record of it, adds nothing.
    again = spark.createDataFrame([("z", "zz", [1.0])], "id string, text string, embedding array<float>")
    assert s.append_batch("c", again, source, head["streams"][source]) == head["version"]
    assert s.count("c") == 4
    s.append_batch("c", again, source, head["streams"][source] + 1)
    assert s.count("c") == 5


def test_a_batch_does_not_read_the_collection(spark, tmp_path):
    """Appending a batch of a stream after its first plans no scan of the rows that are there."""
    s = Store(spark, f"file://{tmp_path}")
    s.create("c", 1)
    row = lambda i: spark.createDataFrame([(str(i), "t", [1.0])], "id string, text string, embedding array<float>")
    s.append_batch("c", row(1), "q", 0)
    read = []
    own = Store._read
    try:
        Store._read = lambda self, *a, **k: read.append(1) or own(self, *a, **k)
        s.append_batch("c", row(2), "q", 1)
    finally:
        Store._read = own
    assert not read and s.count("c") == 2


def vectors(spark, n=400):
    return spark.createDataFrame([(str(i), f"t{i}", [float((i * j) % 17) - 8 for j in range(1, 17)]) for i in range(n)], "id string, text string, embedding array<float>")


def test_settings_decide_on_codes(spark, tmp_path):
    query = [float(j % 5) - 2 for j in range(16)]
    exact = lambda s: [(r["id"], r["score"]) for r in dense.search(s.table("a"), query, 10).orderBy("rank").collect()]
    found = {}
    for name, config in (("off", CodecConfig()), ("on", CodecConfig(enabled=True, pool=60)), ("coarse", CodecConfig(enabled=True, bits=2, pool=10))):
        s = Store(spark, f"file://{tmp_path}/{name}")
        s.create("a", 16)
        ingest.with_codes(s, "a", vectors(spark), config)
        assert s.codes("a").count() == (400 if config.active else 0)
        found[name] = [(r["id"], r["score"]) for r in quantize.search(s.table("a"), query, 10, config).orderBy("rank").collect()]
        want = exact(s)
    assert found["off"] == want and found["on"] == want
    assert len({i for i, _ in found["coarse"]} & {i for i, _ in want}) >= 3  # scores are exact, and the pool decides who has one
    assert dict(found["coarse"]).items() <= dict((r["id"], r["score"]) for r in dense.search(vectors(spark), query, 400).collect()).items()


def test_refused_files_have_a_reason(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_bytes(MARKDOWN)
    (src / "b.txt").write_bytes(b"x")
    (src / "c.md").write_bytes(b"y" * 3000)
    got = {r["source_filename"]: r["reason"] for r in files.refused(spark, str(src), max_mb=0.002).collect()}
    assert set(got) == {"b.txt", "c.md"} and "type" in got["b.txt"] and "larger" in got["c.md"]
    s = Store(spark, f"file://{tmp_path}/store")
    report = ingest.ingest(s, "c", files.files(spark, str(src), max_mb=0.002), embed.hashing(4), refused=files.refused(spark, str(src), max_mb=0.002))
    status = {r["source_filename"]: r["status"] for r in report.collect()}
    assert status["a.md"].startswith("Successfully") and status["b.txt"].startswith("Refused") and status["c.md"].startswith("Refused")


def test_searches_check_what_they_are_asked_for(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "aa")], "qid int, query string")
    for k in (0, True, 10**6):
        with pytest.raises(errors.ValidationError):
            bm25.search(d, q, k)


def test_texts_are_stored(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}")
    rows = spark.createDataFrame([("1", "some text", '{"k": 1}')], "id string, text string, metadata string")
    ingest.texts(s, "c", rows, embed.hashing(4))
    assert s.count("c") == 1
    with pytest.raises(errors.ValidationError):
        ingest.texts(s, "c", rows.withColumn("text", F.lit("  ")), embed.hashing(4))
    with pytest.raises(errors.ValidationError):
        ingest.texts(s, "c", rows.withColumn("id", F.lit("2")).withColumn("metadata", F.lit('{"document_id": "x"}')), embed.hashing(4))
