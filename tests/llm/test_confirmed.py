"""Near-duplicates that are confirmed by their shingles, and limits of quality without a hidden constant."""

import random

import duckdb
import numpy as np
import pytest

from siltstone.llm import quality, queries, simhash
from siltstone.llm.common import WORD

VOCAB = [f"w{i}" for i in range(4000)]


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def near(base, changes, r):
    words = base.split()
    for i in r.sample(range(len(words)), changes):
        words[i] = f"zz{r.random()}"
    return " ".join(words)


def family(n, r):
    """Different texts around one boilerplate, none of which reaches 0.8 with another."""
    boiler = [r.choice(VOCAB) for _ in range(250)]
    return [" ".join(boiler + [r.choice(VOCAB) for _ in range(36)]) for _ in range(n)]


@pytest.mark.parametrize("bucket", [1024, 16])
def test_boilerplate_stays_and_near_copies_go(spark, bucket):
    r = random.Random(bucket)
    texts = family(120, r)
    assert max(jaccard(a, b) for a, b in zip(texts, texts[1:])) < 0.8
    rows, pairs = [(i, t) for i, t in enumerate(texts)], 0
    for i in range(40):
        base = " ".join(r.choice(VOCAB) for _ in range(300))
        copy = near(base, r.randint(1, 4), r)
        assert jaccard(base, copy) >= 0.85
        rows += [(1000 + 2 * i, base), (1001 + 2 * i, copy)]
    chain = [" ".join(r.choice(VOCAB) for _ in range(300))]
    for _ in range(40):  # a large group: each near the one before
        chain.append(near(chain[-1], 2, r))
    rows += [(5000 + i, t) for i, t in enumerate(chain)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    root = {x["doc_id"]: x["root"] for x in simhash.similar(spark, d, bucket=bucket).collect()}
    assert len({root[i] for i in range(120)}) == 120
    pairs = sum(root[1000 + 2 * i] == root[1001 + 2 * i] for i in range(40))
    assert pairs >= 39 and len({root[5000 + i] for i in range(41)}) == 1
    assert len(set(root.values())) == 120 + 40 + (40 - pairs) + 1


def test_trees_of_sets_are_components_of_true_links():
    r = random.Random(9)
    sets = []
    for _ in range(30):
        base = r.sample(range(5000), r.randint(5, 60))
        for _ in range(r.randint(1, 5)):
            s = set(base)
            for x in r.sample(base, r.randint(0, len(base) // 6)):
                s.discard(x)
                s.add(r.randrange(5000))
            sets.append(np.array(sorted(s), np.uint32))
    sets.append(np.empty(0, np.uint32))
    r.shuffle(sets)

    def parts(links):
        own = list(range(len(sets)))

        def find(i):
            while own[i] != i:
                i = own[i]
            return i

        for a, b in links:
            own[find(a)] = find(b)
        return {frozenset(j for j in range(len(sets)) if find(j) == find(i)) for i in range(len(sets))}

    want = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i]) and len(sets[j]) and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))]
    a, b = simhash.jaccard_trees(sets, 0.8)
    assert parts(zip(a, b)) == parts(want) and len(a) < len(sets)


def test_short_and_empty_texts_of_the_stage(spark):
    rows = [(1, "one two"), (2, "One TWO"), (3, "one three"), (4, ""), (5, None), (6, "  "), (7, "a b c d e"), (8, "a b c d f")]
    root = {x["doc_id"]: x["root"] for x in simhash.similar(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert root[1] == root[2] and root[4] == root[5] == root[6] and len(set(root.values())) == 5


def plain(n, i, symbols=0, twice=0, repeats=0, long=3):
    words = [f"{'y' * long}{i:04d}x{j:05d}" for j in range(n)]
    lines = [" ".join(words[k : k + 9]) for k in range(0, n, 9)]
    return "\n".join(lines + lines[:1] * twice) + " " + "#" * symbols + f" {' '.join(['aa bb cc'] * repeats)}"


def test_few_symbols_do_not_condemn(spark):
    """Where no other document of a group has symbols, ten in forty thousand words are not many."""
    rows = [(i, plain(200, i, 400 if i % 20 == 0 else 0), "en", "a" if i % 20 == 0 else "b") for i in range(400)]
    rows += [(9000, plain(40_000, 9, 10), "en", "b"), (9001, plain(40_000, 8, 9), "en", "b"), (9002, plain(200, 7, 900), "en", "b")]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[9000] and got[9001] and not got[9002] and all(got[i] for i in range(400) if i % 20)


def test_each_measure_rejects(spark):
    """Below the base rule, too: documents that are odd in one thing each."""
    rows = [(i, plain(300 + i, i, i % 2, i % 3, 2 * (i % 2)), "en", "a") for i in range(300)]
    odd = {"symbol": plain(400, 901, symbols=900), "line": plain(400, 902, twice=30), "repeat": plain(600, 903, repeats=150), "mean": plain(400, 904, long=40)}
    d = spark.createDataFrame(rows + [(1000 + k, t, "en", "a") for k, t in enumerate(odd.values())], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality(spark, d).collect()}
    assert not any(got[1000 + k]["base_failed"] for k in range(4)) and not any(got[1000 + k]["kept"] for k in range(4))
    assert all(got[i]["kept"] for i in range(300))


def test_words_of_the_sql_are_those_of_the_contract(spark, tmp_path):
    rows = [(1, "aaa\x0bbbb\x0cccc\rddd " * 60, "en", "a"), (2, "one\x85two\x1fthree four " * 60, "en", "a"), (3, "\x0b", "en", None), (4, None, None, "a")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    d.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    rel = con.sql(queries.ORACLES["op10_quality"])
    want = {r[rel.columns.index("doc_id")]: dict(zip(rel.columns, r)) for r in rel.fetchall()}
    got = {r["doc_id"]: r.asDict() for r in queries.QUERIES["op10_quality"](spark, f"file://{tmp_path}").collect()}
    assert got == want and got[1]["n_words"] == 240 and WORD.startswith("[^")
