"""Vector codes, concatenation and the filter audit against plain versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import audit, compression, concatenation
from siltstone.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- vector codes --------------------------------------------------------------------------------


def plain_codes(rows, entries=16, rounds=6):
    """{row number: (code, error)}, final codebooks: every distance, in Python's whole numbers."""
    rows = sorted(enumerate(rows), key=lambda r: (r[1][0] is None, r[1][0], r[1][1]))
    x = {i: [int(np.floor(4096 * c)) for c in v] for i, (_, v, _) in rows}
    w = len(next(iter(x.values()))) // 8
    part = lambda i, p: x[i][p * w : (p + 1) * w]
    books = [[part(i, p) for i, _ in rows[:entries]] for p in range(8)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(8):
            own = {}
            for i in x:
                own.setdefault(near(part(i, p), books[p])[1], []).append(part(i, p))
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    last = {i: [near(part(i, p), books[p]) for p in range(8)] for i in x}
    return {i: ("".join(f"{k:02x}" for _, k in d), sum(e for e, _ in d)) for i, d in last.items()}, books


def clustered(n, width=2, seed=3):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (20, 8 * width))
    return [(i, [float(c) for c in (centres[r.integers(20)] + r.normal(0, 0.2, 8 * width)).round(4)], int(r.integers(4))) for i in range(n)]


def test_codes_equal_the_plain_version(spark):
    rows = clustered(300)
    want, books = plain_codes(rows)
    d = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5)
    got = {r["vec_id"]: r for r in compression.compressed(spark, d).collect()}
    assert {i: (r["code"], r["error"]) for i, r in got.items()} == want
    by = {k: sum(want[i][1] for i, _, m in rows if m == k) for k in range(4)}
    assert all(r["label_error"] == by[rows[i][2]] for i, r in got.items())
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    assert {r["codebooks_sha256"] for r in got.values()} == {digest}


def test_bounds_spare_work_and_stay_exact():
    """Most parts are settled by bounds in later rounds, and each round's entries are those of a full search."""
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (16, 4))
    x = centres[r.integers(16, size=3000)] + r.integers(-300, 300, (3000, 4))
    x[100:140] = x[:40]
    history, own, spared = x[:16][None].astype(np.int64), None, []
    for t in range(7):
        if own is None:
            own = compression.Bounds(*(np.zeros(len(x), k) for k in (np.int64, float, np.int64, float, np.int64)))
        _, full = own.assign(x, history)
        d = ((x[:, None].astype(object) - history[-1][None].astype(object)) ** 2).sum(axis=2)
        assert own.code.tolist() == d.argmin(axis=1).tolist()
        spared.append(len(x) - full)
        new = np.array([x[own.code == k].sum(axis=0) // max(1, (own.code == k).sum()) if (own.code == k).any() else history[-1][k] for k in range(16)])
        history = np.concatenate([history, new[None]])
    assert spared[0] == 0 and spared[-1] > 0.5 * len(x)
    # Net displacement is never more than the sum of the moves, and less where entries turn back.
    steps = np.sqrt((np.diff(history, axis=0).astype(float) ** 2).sum(axis=2)).sum(axis=0)
    assert (compression.displaced(history)[0] <= steps * (1 + 1e-5) + 1e-9).all()
    turned = np.array([[[0, 0]], [[3, 4]], [[0, 0]]])
    assert compression.displaced(turned)[0][0] == 0


def test_squares_are_exact_for_large_numbers():
    x, c = np.array([[2**28, -(2**28), 1]]), np.array([[-(2**28), 2**28, 0], [2**28, -(2**28), 1]])
    assert compression.squares(x, c).tolist() == [[2 * 2**58 + 1, 0]]


def test_codes_of_odd_rows(spark):
    v = [float(i) / 7 for i in range(16)]
    rows = [(1, v, 1), (1, v, 1), (2, None, 1), (3, [1.0, None] * 8, 1), (4, [float("nan")] * 16, None), (5, [float("inf")] * 16, 2), (6, v[::-1], None), (None, v, None), (7, v[:8], 3), (8, [], 3), (9, [1e300] * 16, 3), (10, [-0.3] * 16, 3)]
    d = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, code string, x int, error int")
    got = compression.compressed(spark, d).collect()
    assert sorted(str(r["vec_id"]) for r in got) == sorted(["1", "1", "6", "None", "7", "8", "9", "10"])
    assert {r["vec_id"] for r in got if r["code"] is None} == {7, 8, 9} and all(r["error"] is None for r in got if r["code"] is None)
    assert {r["error"] for r in got if r["code"] is not None} == {0}  # as many entries as rows
    assert {r["label_error"] for r in got if r["vec_id"] in (6, None)} == {0}
    assert compression.compressed(spark, d.limit(0)).count() == 0
    assert {r["code"] for r in compression.compressed(spark, d.where("vec_id in (7, 8)").where("label = 3")).collect() if r["vec_id"] == 8} == {None}


# ---- concatenation -------------------------------------------------------------------------------


def direct(text):
    return concatenation.tokenizer(None).encode(text or "", add_special_tokens=False).ids + [1]


ODD = ["<|endoftext|>x y<|startoftext|>", "a\x1cb\x85c d", "é ́x \ń", "ΟΔΟΣ ΣΑΣ ΟΣ́ Σ", "İstanbul İ", "'s it's IT'S", "x‍ y﻿", "1 ½ ² 12345", "\x0b\x0c a\x00b", "가 각 ᄀ ᅡ", "don 't", "a b", "a" * 3000, None, "", "  ", "🙂🙂 🙂"]


def test_ids_are_those_of_the_tokenizer():
    flat, n = concatenation.Ids(None).of(pa.array(ODD))
    assert [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] == [direct(t) for t in ODD]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\tab'sé́İΣ<|>")), max_size=40), min_size=1, max_size=12))
def test_ids_of_any_text(rows):
    flat, n = concatenation.ids_of(None).of(pa.array(rows, pa.string()))
    assert [p.tolist() for p in np.split(flat, np.cumsum(n)[:-1])] == [direct(t) for t in rows]


def test_ids_when_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(concatenation, "REMEMBERED", 3)
    monkeypatch.setattr(concatenation, "JOINED", 2)
    ids, rows = concatenation.Ids(None), [f"w{i} x{i % 3} yy{i % 5}z" for i in range(20)]
    for a in range(0, 20, 4):
        flat, n = ids.of(pa.array(rows[a : a + 4]))
        assert flat.tolist() == [x for t in rows[a : a + 4] for x in direct(t)] and len(n) == 4


def held(rows, pieces, length):
    """Checks pieces against the documents: every id once, windows gapless, digests right."""
    ids = {i: direct(t) for i, t in rows}
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_window.setdefault(p["sequence_id"], []).append(p)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) == len(ids[i]) == own[0]["doc_tokens"]
        for p in own:
            part = np.array(ids[i][p["start"] : p["start"] + p["length"]], "<u4")
            assert p["length"] > 0 and p["ids_crc32"] == zlib.crc32(part.tobytes())
    assert sorted(by_window) == list(range(len(by_window)))
    for k, own in by_window.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:j]) for j in range(len(own))]
        n = sum(p["length"] for p in own)
        assert n == length if k < len(by_window) - 1 else 0 < n <= length
        assert {p["sequence_tokens"] for p in own} == {n} and {p["padded_tokens"] for p in own} == {n if n & (n - 1) == 0 else length}


@pytest.mark.parametrize("length", [1, 7, 64])
def test_windows(spark, length):
    r = random.Random(length)
    rows = [(i, t) for i, t in enumerate(ODD + [" ".join(r.choice(["one", "two", "thrée", "x9,"]) for _ in range(r.randint(0, 80))) for _ in range(60)])]
    d = spark.createDataFrame([(*x, 5, 6) for x in rows], "doc_id long, text string, part int, n int").repartition(5)
    pieces = concatenation.packed(spark, d, length, with_ids=True)
    held(rows, [p.asDict() for p in pieces.collect()], length)
    for s in concatenation.sequences(pieces, pad=0).collect():
        assert len(s["ids"]) in (length, 1, 2, 4, 8, 16, 32) and s["offsets"][0] == 0 and len(s["doc_ids"]) == len(s["offsets"])
    again = concatenation.packed(spark, d, length, with_ids=True)
    assert sorted(map(str, again.collect())) == sorted(map(str, pieces.collect()))


def test_windows_of_odd_tables(spark):
    d = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b"), (2, "w " * 50_000)], "doc_id long, text string")
    got = concatenation.packed(spark, d).collect()
    assert sum(p["length"] for p in got) == 1 + 3 + 3 + 50_001 and sum(p["doc_id"] is None for p in got) == 1
    assert concatenation.packed(spark, d.limit(0)).count() == 0


# ---- filter audit --------------------------------------------------------------------------------


def plain_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    bad = {i for i, _, x in labels if x == 1 and i is not None}
    fails = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails.append((lang or "", i, {k for k, v in f.items() if v}))
    out, sums = {}, {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        for o in permutations("ABCDE"):
            left = own
            for k, x in enumerate(o):
                gone, early = [(i, f) for i, f in left if x in f], [1 for _, f in own if x in f and f & set(o[:k])]
                left = [(i, f) for i, f in left if x not in f]
                out[part, "".join(o), k + 1] = (len(left), len(gone), len(early), sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in bad for i, _ in gone))
                sums[part, x] = sums.get((part, x), 0) + len(gone)
    return {k: (*v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_the_plain_version(spark):
    r = random.Random(8)
    text = lambda: " ".join(r.choice(["a", "B", "word", "%", "XY"]) + str(r.randint(0, 300)) for _ in range(r.choice([3, 150, 220, 400])))
    docs = [(i, text(), r.choice(["en", "de", None, ""])) for i in range(120)]
    docs += [(200 + i, docs[r.randrange(120)][1], "en") for i in range(40)] + [(None, docs[0][1], "en"), (300, None, "en"), (301, "", "fr"), (5, docs[5][1], "en"), (7, "other", "de"), (400, "w " * 60_000, "fr")]
    labels = [(r.randint(0, 250), r.randint(0, 1), r.randint(0, 1)) for _ in range(150)] + [(None, 1, 1), (3, None, None)]
    d = spark.createDataFrame([(*x, "p", 9) for x in docs], "doc_id long, text string, lang string, part string, mask int").repartition(4)
    got = audit.audited(spark, d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {(x["part"], x["filter_order"], x["step"]): tuple(x)[3:] for x in got.collect()}
    want = plain_audit(docs, labels)
    assert found == want and len(found) == 600 * 4
    assert audit.audited(spark, d.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_least_squares_give_shapley_values():
    """The solved weights are those of the definition by orders, for three to five filters."""
    for n in (3, 4, 5):
        want = [[0] * 2**n for _ in range(n)]
        for o in permutations(range(n)):
            for k, f in enumerate(o):
                before = sum(1 << x for x in o[:k])
                want[f][before | 1 << f] += 1
                want[f][before] -= 1
        for row in want:
            row[0] = 0  # the empty coalition removes nothing
        assert audit.shapley_weights(n) == want


def test_masks_are_few(spark):
    d = spark.createDataFrame([(i, "A" * 10, "en") for i in range(500)], "doc_id long, text string, lang string")
    with Scratch(spark) as s:
        m = audit.masks(s, d, spark.createDataFrame([], "doc_id long, quality int, toxic int")).orderBy(F.col("mask")).collect()
    assert [(r["mask"], r["n"]) for r in m] == [(1 + 4, 1), (1 + 4 + 16, 499)]
