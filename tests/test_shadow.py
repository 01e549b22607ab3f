"""A second leg beside the main search, counters in passing, and language models by name."""

import datetime

import pytest
from pyspark.sql import functions as F

from siltstone import errors
from siltstone.chunking import records
from siltstone.operators import dense, embed
from siltstone.sources import files, ingest
from siltstone.sources.collections import Store
from siltstone.streaming import shadow

SERVED = "qid string, query string, embedding array<float>, asked timestamp, ids array<string>"


def served(spark, docs, first, n, hour):
    """Questions whose served result is the exact one, but for every third, which lacks its best."""
    r = [(str(i), f"q{i}", [float((i * j) % 7) - 3 for j in range(1, 9)], datetime.datetime(2024, 1, 1, hour)) for i in range(first, first + n)]
    q = spark.createDataFrame(r, "qid string, query string, embedding array<float>, asked timestamp")
    top = dense.search_batch(docs, q, 4, id="id", vector="embedding", qid="qid", query="embedding")
    ids = {k: [x["id"] for x in sorted(top.where(F.col("qid") == k).collect(), key=lambda x: x["rank"])] for k in [x[0] for x in r]}
    return [(*x, (ids[x[0]] if int(x[0]) % 3 else ["other", *ids[x[0]][1:]])) for x in r]


def test_the_second_leg_fills_a_table(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), [float((i * j) % 17) - 8 for j in range(1, 9)]) for i in range(200)], "id string, embedding array<float>")
    leg = lambda q: dense.search_batch(docs, q, 4, id="id", vector="embedding", qid="qid", query="embedding").select("qid", "id", "rank")
    src, to, at = f"file://{tmp_path}/in", f"file://{tmp_path}/out", f"file://{tmp_path}/at"
    one, two = served(spark, docs, 0, 6, 1), served(spark, docs, 6, 6, 2)
    stream = lambda: spark.readStream.schema(SERVED).parquet(src)
    spark.createDataFrame(one, SERVED).coalesce(1).write.parquet(src)
    shadow.start(stream(), leg, to, at, share=1.0, k=4).awaitTermination()
    assert shadow.table(spark, to).count() == 6
    spark.createDataFrame(two, SERVED).coalesce(1).write.mode("append").parquet(src)
    shadow.start(stream(), leg, to, at, share=1.0, k=4).awaitTermination()
    kept = {r["qid"]: (r["overlap"], r["n_real"], r["batch"]) for r in shadow.table(spark, to).collect()}
    assert kept == {str(i): (1.0 if i % 3 else 0.75, 4, i // 6) for i in range(12)}
    got = {r["began"].hour: (r["n"], round(r["overlap"], 6), r["least"], r["agreed"]) for r in shadow.windows(shadow.table(spark, to)).collect()}
    assert got == {h: (6, round((4 + 2 * 0.75) / 6, 6), 0.75, 4) for h in (1, 2)}


def test_a_leg_that_fails_is_a_row(spark, tmp_path):
    src, to = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.createDataFrame([("1", "q", [1.0], None, ["a"])], SERVED).write.parquet(src)

    def leg(q):
        raise errors.SearchError("no codes")

    shadow.start(spark.readStream.schema(SERVED).parquet(src), leg, to, f"file://{tmp_path}/at", share=1.0).awaitTermination()
    (row,) = shadow.table(spark, to).collect()
    assert row["error"] == "Search error: no codes" and row["qid"] is None and shadow.windows(shadow.table(spark, to)).count() == 0


def test_compared_defines_the_odd_cases(spark):
    t = datetime.datetime(2024, 1, 1)
    rows = [("1", "q", [1.0], t, None), ("2", "q", [1.0], None, ["a", "b"]), ("3", "q", [1.0], t, ["x"]), ("3", "q", [1.0], t + datetime.timedelta(1), ["a"])]
    leg = lambda q: q.where("qid <> '1'").select("qid", F.lit("a").alias("id"), F.lit(1).alias("rank"))
    got = {r["qid"]: (r["n_real"], r["overlap"]) for r in shadow.compared(spark.createDataFrame(rows, SERVED), leg).collect()}
    assert got == {"1": (0, 1.0), "2": (2, 0.5), "3": (1, 1.0)}
    assert shadow.compared(spark.createDataFrame([], SERVED), leg).count() == 0


def test_the_share_of_questions(spark):
    q = spark.range(20_000).select(F.col("id").cast("string").alias("qid"))
    n = shadow.sampled(q, 0.1).count()
    assert 1800 < n < 2200 and shadow.sampled(q, 0.1).exceptAll(shadow.sampled(q, 0.2)).count() == 0
    with pytest.raises(errors.ValidationError):
        shadow.sampled(q, 0.0)


def test_counters_are_taken_while_writing(spark, tmp_path):
    def parser(content, first, last):
        if first > 25:
            raise ValueError("torn page")
        return [("text", " ".join(["word"] * 300), first, None)]

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "in" / "b.md").write_bytes(b"# T\n\nfew words\n")
    before = dict(files.PARSERS)
    try:
        files.register(".pdf", parser, pages=lambda c: 60)
        counts = ingest.Counts()
        e = embed.Embedder(4, column=embed.hashing(4).column, max_tokens=100)
        report = ingest.ingest(Store(spark, f"file://{tmp_path}/s"), "c", files.files(spark, str(tmp_path / "in")), e, counts=counts)
        chunks = sum(r["chunks"] for r in report.collect())
    finally:
        files.PARSERS.clear()
        files.PARSERS.update(before)
    assert counts.values == {"elements": 3, "failed_ranges": 2, "chunks": chunks, "truncated": 1} and chunks == 3


def test_ranges_of_a_file_are_shared_and_retried_alone(spark, tmp_path):
    """A file of 100 pages: each range is read by a task of its own, and only the one that failed is parsed again."""
    calls, broken = tmp_path / "calls", tmp_path / "broken"
    where = tmp_path / "in"
    where.mkdir()
    (where / "a.pdf").write_bytes(b"%PDF one")
    broken.write_text("")

    def parser(content, first, last):
        from pyspark import TaskContext

        with open(calls, "a") as f:
            f.write(f"{first} {TaskContext.get().partitionId()}\n")
        if first == 26 and broken.exists():
            raise ValueError("torn page")
        return [("text", content.decode(), first, None)]

    before = dict(files.PARSERS)
    try:
        files.register(".pdf", parser, pages=lambda c: 100)
        ranged = files.ranges(files.files(spark, str(where)))
        with_content = {(r["range_no"], r["text"], r["error"]) for r in files.elements(ranged).collect()}
        calls.write_text("")
        files.elements(ranged, tasks=16).write.parquet(f"{tmp_path}/parsed")
        parsed = spark.read.parquet(f"{tmp_path}/parsed")
        assert {(r["range_no"], r["text"], r["error"]) for r in parsed.collect()} == with_content == {(0, "%PDF one", None), (1, None, "torn page"), (2, "%PDF one", None), (3, "%PDF one", None)}
        made = [line.split() for line in calls.read_text().splitlines()]
        assert sorted(int(a) for a, _ in made) == [1, 26, 51, 76] and len({t for _, t in made}) > 1
        broken.unlink()
        calls.write_text("")
        again = files.retried(parsed, ranged, tasks=16)
        assert {(r["range_no"], r["text"], r["error"]) for r in again.collect()} == {(i, "%PDF one", None) for i in range(4)}
        assert [line.split()[0] for line in calls.read_text().splitlines()] == ["26"]
        found = ranged.withColumn("content_hash", F.lit("0" * 64))
        assert {r["error"].rsplit("/", 1)[1] for r in files.elements(found, tasks=2).collect()} == {"a.pdf has changed since it was listed"}
        counts = ingest.Counts()
        ingest.ingest(Store(spark, f"file://{tmp_path}/s"), "c", files.files(spark, str(where)), embed.hashing(4), counts=counts, tasks=4)
        assert counts.values["elements"] == 4 and counts.values["failed_ranges"] == 0
    finally:
        files.PARSERS.clear()
        files.PARSERS.update(before)


def test_language_models_by_name(spark):
    docs = spark.createDataFrame([(1, "one"), (2, "bad")], "doc_id int, text string")

    def make():
        def call(system, user):
            if user.endswith("bad"):
                raise TimeoutError("too slow")
            return '[{"text": "x", "n": 1}]'

        return call

    records.register("stub", make)
    got = records.chunked(docs, "split", "stub").collect()
    assert {(r["doc_id"], r["text"], r["error"]) for r in got} == {(1, "x", None), (2, None, "LLM error: too slow")}
    made = records.chunked(docs, "split", "stub")
    with pytest.raises(errors.CompletionError, match="1 calls failed: LLM error: too slow"):
        records.checked(made)
    assert records.checked(made.where("doc_id = 1")).count() == 1
    with pytest.raises(errors.UnsupportedProvider):
        records.chunked(docs, "split", "nobody")
