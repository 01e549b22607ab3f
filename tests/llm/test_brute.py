"""The operators against plain versions on small tables."""

import hashlib
import math
import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from siltstone.errors import SiltstoneError
from siltstone.llm import language, mixing, packing, pii, quality, queries, simhash, substrings, toxicity, urls, vectors
from siltstone.llm.common import Scratch, tokenized

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(n=120, seed=1):
    """Documents with copies, near copies, shared passages and repeated lines."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocab) for _ in range(40))
    docs = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(0, 150))]
        if i % 5 == 1:
            words[len(words) // 2 : len(words) // 2] = passage.split()[r.randint(0, 10) : r.randint(20, 40)]
        text = " ".join(words)
        if i % 7 == 3 and docs:
            text = docs[r.randrange(len(docs))][1]
        if i % 11 == 5 and docs:
            text = docs[r.randrange(len(docs))][1] + " " + r.choice(vocab)
        if i % 13 == 2:
            text = "\n".join([text[:60]] * 3 + [text])
        docs.append((i, text, ["en", "de"][i % 2], f"s{i % 4}"))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").repartition(3)


#: Two words of 1,024 letters that a polynomial hash modulo 2**64 takes for one.
TWINS = ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)) for k in (0, 1)]


def test_tokens_follow_words():
    rows = ["a b\ta c  \r\nb " + "x" * 70_000 + " a", None, "", " \n", "é " + " ".join(TWINS), "a"]
    t = tokenized(pa.array(rows))
    assert t.lens.tolist() == [len(WORD.findall(x or "")) for x in rows]
    assert [w.decode() for w in t.words.take(pa.array(t.ids)).to_pylist()] == [w for x in rows for w in WORD.findall(x or "")]
    assert len(set(zip(*[h.tolist() for h in t.hashes], strict=True))) == len(t.words)
    assert t.runs_of(3).tolist() == [0, 1, 2, 3, 4, 7]


def test_words_that_look_alike_are_not_removed(spark):
    tail = " ".join(f"w{i}" for i in range(12))
    d = spark.createDataFrame([(1, f"{TWINS[0]} {tail}"), (2, f"{TWINS[1]} {tail}"), (3, f"{TWINS[0]} {tail}")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_removed"] for r in substrings.removed(spark, d).collect()} == {1: 0, 2: 0, 3: 13}
    assert quality.measures(pa.array([f"{TWINS[0]} x y {TWINS[1]} x y z", f"{TWINS[0]} x y {TWINS[0]} x y z"]))[:, 4].tolist() == [0, 6]


def test_substrings(spark, docs):
    seen, want = {}, {}
    for i, t, *_ in corpus():
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 13]) for k in range(len(w) - 12)]
        gone = {j for k, g in enumerate(grams) if g in seen for j in range(k, k + 13)}
        for g in grams:
            seen.setdefault(g, i)
        want[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.removed(spark, docs).collect()}
    assert got == want and any(v[1] for v in want.values())


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) > 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, linked):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.mark.parametrize("bucket", [1024, 2])
def test_simhash(spark, docs, bucket):
    fp = {i: fingerprint(t) for i, t, *_ in corpus()}
    pairs = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    want = components(fp, pairs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.grouped(spark, docs, bucket).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in fp.items()}


@pytest.mark.parametrize("bucket", [1024, 3, 1])
def test_simhash_links_of_near_fingerprints(spark, bucket):
    """In lists of three positions, refined lists and by common neighbours alike."""
    r = random.Random(3)
    fps = [r.getrandbits(64) for _ in range(5)]
    fps += [f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 6))) for f in fps for _ in range(12)]
    fps += [f ^ (0x0101010101010101 & ((1 << 8 * k) - 1)) for f in fps[:5] for k in range(1, 8)]
    want = components(range(len(fps)), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 4])
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    at = {x: k for k, x in enumerate(signed)}
    with Scratch(spark) as s:
        links = simhash._links(s, spark.createDataFrame([(x,) for x in at], "fp long"), bucket).collect()
    got = components(range(len(fps)), [(at[x["a"]], at[x["b"]]) for x in links])
    same = {i: at[signed[i]] for i in range(len(fps))}
    assert len({(want[i], got[same[i]]) for i in want}) == len(set(want.values())) == len({got[same[i]] for i in want})


def test_simhash_tally():
    r = random.Random(8)
    a, other = r.getrandbits(64), [r.getrandbits(64) & 0xFF00FF00FF00FF00 for _ in range(50)]
    want = [sum(a >> 8 * p & 255 == b >> 8 * p & 255 for p in range(8)) for b in other]
    assert simhash.matches(np.uint64(a), np.array(other, np.uint64)).tolist() == want


def test_simhash_keeps_one_row_of_each_component(spark):
    """Ids with several texts, repeated rows, copies under several ids."""
    long = [" ".join(f"w{(i * 7 + j * j) % 89}" for j in range(60)) for i in range(4)]
    rows = [(1, long[0]), (1, long[0]), (1, long[1]), (2, long[1]), (2, long[2]), (3, long[0]), (None, long[3]), (None, long[3]), (4, long[3])]
    got = [(r["doc_id"], long.index(r["text"])) for r in simhash.deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, 0), (1, 1), (2, 2), (4, 3), (None, 3), (None, 3)], key=str)


def test_similar_texts(spark):
    """Groups of five-word shingles against plain sets, in short lists and in long ones dealt into parts."""
    r = random.Random(17)
    docs = []
    for g in range(30):
        words = [f"w{r.randrange(3000)}" for _ in range(300)]
        for k in range(1 + g % 4):
            own = list(words)
            for _ in range(k):
                own[r.randrange(300)] = f"n{r.randrange(3000)}"
            docs.append(own)
    words = [f"w{r.randrange(3000)}" for _ in range(300)]
    for _ in range(150):  # a large group
        docs.append([*words[:100], f"m{len(docs)}", *words[101:]])
    docs += [[], [], ["a", "b"], ["a", "b"], ["a", "c"]]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for w in docs]
    want = components(range(len(docs)), [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string")
    for bucket in (1024, 64):
        got = {x["doc_id"]: x["root"] for x in simhash.similar(spark, d, bucket=bucket).collect()}
        assert len({(want[i], got[i]) for i in got}) == len(set(want.values())) == len(set(got.values()))
    assert {x["doc_id"] for x in simhash.deduplicated(spark, d).collect()} == set(want.values())


def test_quality_measures():
    rows, want = [t + " # a $b" for _, t, *_ in corpus(60)], []
    for t in rows:
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        again = {j for k, g in enumerate(grams) if n[g] > 1 for j in range(k, k + 3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append([len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again), len(lines)])
    assert quality.measures(pa.array(rows)).tolist() == want


def spotted(i, symbols, long, twice):
    """A document with a share of symbols, a length of words, and lines that occur twice."""
    words = [f"{'y' * long}{i}x{j}" for j in range(900)]
    lines = [" ".join(words[k : k + 9]) for k in range(0, 900, 9)]
    return "\n".join(lines + lines[:twice]) + " " + "|" * symbols


def test_quality_thresholds_follow_groups(spark):
    """What is usual in one source is rejected in another, by each of three measures."""
    rows = [(1000 * k + i, spotted(i, 2 + i % 3 + 600 * k, 3 + 20 * k, i % 2 + 15 * k), "en", "ab"[k]) for k in range(2) for i in range(150)]
    odd = [(9000, spotted(7, 1500, 3, 0), "en", "a"), (9001, spotted(8, 2, 40, 0), "en", "a"), (9002, spotted(9, 2, 3, 30), "en", "a"), (9003, spotted(9, 601, 23, 16), "en", "b")]
    d = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")
    with Scratch(spark) as s:
        t = {r["source"]: r for r in quality.thresholds(s, quality.with_measures(d).select("row.lang", "row.source", "base_failed", *quality.FENCES)).collect()}
    for m in ("symbol_ratio", "dup_line_ratio", "mean_word"):
        assert t["a"][f"high_{m}"] < t["b"][f"high_{m}"]
    got = {r["doc_id"]: r["kept"] for r in quality.quality(spark, d).collect()}
    assert [got[i] for i in range(9000, 9004)] == [False, False, False, True]
    assert np.mean([got[i] for i, *_ in rows]) > 0.9


def test_quality_quantiles_are_near_the_exact_ones(spark):
    r = np.random.RandomState(4)
    x = np.exp(r.standard_normal(4000))
    m = spark.createDataFrame([("en", "a", False, *[float(v)] * 4) for v in x], "lang string, source string, base_failed boolean, " + ", ".join(f"{k} double" for k in quality.FENCES))
    for q in quality.quantiles(quality.sketches(m, ["lang"]), ["lang"]).collect():
        p = quality.FENCES[q["measure"]][0]
        for name, level in (("mid", 0.5), ("high", p), ("low", 1 - p)):
            assert abs(q[name] / np.quantile(x, level, method="inverted_cdf") - 1) <= 0.0101


def test_mixing(spark, docs):
    rows = mixing.mixed(spark, docs).collect()
    sizes = Counter()
    for _, t, _, s in corpus():
        sizes[s] += len(WORD.findall(t))
    total, weights = sum(sizes.values()), {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    target, capped = {}, set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = sum(weights[s] for s in sizes if s not in capped)
        target = {s: 3.0 * sizes[s] if s in capped else left * weights[s] / free for s in sizes}
        more = {s for s in sizes if target[s] > 3 * sizes[s]}
        if not more - capped:
            break
        capped |= more
    taken, most = Counter(), max(r["size"] for r in rows)
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= most for s in sizes)
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed(spark, docs.repartition(5)).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in rows}
    copies = Counter(r["doc_id"] for r in mixing.repeated(spark, docs).collect())
    assert copies == Counter({r["doc_id"]: r["copies"] for r in rows if r["size"] and r["copies"]})


def test_packing(spark, docs):
    rows = packing.packed(spark, docs, capacity=100, source_limit=2, shard_items=40).collect()
    text = {i: (t, s) for i, t, _, s in corpus()}
    words = Counter()
    for r in rows:
        words[r["doc_id"]] += r["length"]
    assert words == Counter({i: len(WORD.findall(t)) for i, (t, _) in text.items() if t.strip()})
    bins = {}
    for r in rows:
        bins.setdefault(r["bin_id"], []).append(r)
    for own in bins.values():
        assert sum(r["length"] for r in own) <= 100
        assert len({text[r["doc_id"]][0] for r in own}) == len(own)
        assert max(Counter(text[r["doc_id"]][1] for r in own).values()) <= 2


def test_best_fit_takes_the_tightest_compatible_bin():
    r = random.Random(5)
    items = sorted(((r.randint(1, 60), r.randrange(4), r.randrange(20)) for _ in range(200)), reverse=True)
    got = packing.best_fit(*map(list, zip(*items, strict=True)), 100, 2)
    bins = []
    for (n, s, c), b in zip(items, got, strict=True):
        fit = [(room, k) for k, (room, ss, cs) in enumerate(bins) if room >= n and ss.count(s) < 2 and c not in cs]
        if fit:
            assert bins[b][0] == min(fit)[0]
            bins[b] = (bins[b][0] - n, bins[b][1] + [s], bins[b][2] | {c})
        else:
            assert b == len(bins)
            bins.append((100 - n, [s], {c}))


def test_vectors(spark):
    r = np.random.RandomState(2)
    base = r.standard_normal((60, 16))
    x = np.concatenate([base, base[:20] + 0.05 * r.standard_normal((20, 16)), np.repeat(base[:1], 90, 0) + 0.1 * r.standard_normal((90, 16)), base[3:5]]).astype(np.float32)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    want = components(range(len(x)), np.argwhere(near).tolist())
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.linked(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>"), block=32).collect()}
    assert got == {i: (int(near[i].sum()), want[i], want[i] == i) for i in range(len(x))} | {i: (0, i, True) for i in range(900, 904)}


def test_vectors_dense_groups_that_link(spark):
    """Two groups of 40 at 0.99 within and 0.93 across: every list is full of a node's own group."""
    r = np.random.RandomState(3)
    axes = np.linalg.qr(r.standard_normal((64, 64)))[0]
    centre = [axes[0], 0.937 * axes[0] + np.sqrt(1 - 0.937**2) * axes[1]]
    noise = r.standard_normal((80, 62))
    noise = 0.07 * noise / np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.array([centre[i // 40] + noise[i] @ axes[2:] for i in range(80)])
    x = np.concatenate([x, r.standard_normal((200, 64))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert near[:40, 40:80].all() and (u[:40] @ u[:40].T).min() > 0.985
    assert not np.isin(np.argsort(-u[:40] @ u[:80].T, axis=1)[:, :11], range(40, 80)).any()
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.linked(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (79, 0, i == 0) if i < 80 else (0, i, True) for i in range(280)}


def test_vectors_audit(spark):
    """A large group does not hide lost pairs, and a recall that is not reached is an error."""
    axes = np.linalg.qr(np.random.RandomState(4).standard_normal((16, 16)))[0]
    x = [*[axes[0]] * 30, *[axes[1]] * 2, *[axes[2]] * 2]
    v = spark.createDataFrame([(i, (a + 1e-3 * axes[3] * i).tolist()) for i, a in enumerate(x)], "nid long, vec array<double>")
    roots = spark.createDataFrame([(i, 0) for i in range(30)], "node long, root long")
    met = vectors._audit(spark, v, roots, 0.9, 400)
    assert met.recall == pytest.approx(30 / 34) and (met.nodes, met.linked, met.links, met.whole) == (34, 34, 30 * 29 + 4, True)
    with pytest.raises(SiltstoneError):
        vectors.linked(spark, v.withColumnsRenamed({"nid": "vec_id", "vec": "embedding"}), recall=1.01, rounds=1)


def test_vectors_audit_of_rare_links(spark):
    """Two pairs among 6,000: the sample grows until it has met them, and their loss is seen."""
    x = np.random.RandomState(5).standard_normal((6000, 24))
    x[[100, 3000]] = x[[5000, 5500]] + 1e-3
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "vec_id long, embedding array<double>")
    nodes = v.withColumnsRenamed({"vec_id": "nid", "embedding": "vec"})
    none = spark.createDataFrame([], "node long, root long")
    lost = vectors._audit(spark, nodes, none, 0.9, 400)
    assert (lost.recall, lost.nodes, lost.links, lost.whole) == (0.0, 6000, 4, True)
    part = vectors._audit(spark, nodes, none, 0.9, 100, most=1000, held_bytes=300 * 8 * 24)
    assert 900 < part.nodes < 1100 and not part.whole
    got = {r["vec_id"]: r["component_id"] for r in vectors.linked(spark, v).where("n_links > 0").collect()}
    assert got == {100: 100, 5000: 100, 3000: 3000, 5500: 3000}


def test_vectors_that_share_a_hash(spark):
    """Vectors are told apart by themselves: here all have one of two hashes."""
    rows = [(i, [float(i // 3 % 7), 1.0, float(i % 2)]) for i in range(60)] + [(99, None)]
    with vectors.Scratch(spark) as s:
        d = spark.createDataFrame(rows, "vec_id long, vec array<float>")
        found, nodes = vectors._nodes(s, d, lambda v: F.when(v[2] > 0, 1 << 20).otherwise(5 << 20).cast("long"))
        own = {r["vec_id"]: r["nid"] for r in found.collect()}
        vec = {i: tuple(v) for i, v in rows[:-1]}
        assert all((own[i] == own[j]) == (vec[i] == vec[j]) for i in vec for j in vec) and own[99] is None
        want = {own[i]: (min(j for j in vec if vec[j] == v), sum(w == v for w in vec.values()), v) for i, v in vec.items()}
        assert {r["nid"]: (r["first"], r["mult"], tuple(r["vec"])) for r in nodes.collect()} == want
        with pytest.raises(Exception, match="share a hash"):
            vectors._nodes(s, spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("vec")), lambda v: F.lit(1 << 20).cast("long"))


def test_vectors_of_any_scale(spark):
    rows = [(1, [1e-200, 2e-200]), (2, [1e300, 2e300]), (3, [5e-324, 1e-323]), (4, [2.0, -1.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.linked(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_vectors_search_grows_with_the_nodes():
    for n in (2_000, 100_000, 10_000_000):
        bits = math.ceil(math.log2(n / 64))
        tables = vectors._tables(bits, 0.9, 0.98, 6)
        assert 1 - (1 - (1 - math.acos(0.9) / math.pi) ** bits) ** tables >= 0.98


PII = "a.b@c.org, x@y 10.0.0.1 300.1.1.1 1.2.3.4.5.6.7.8 4111 1111 1111 1111 4111-1111-1111-1112 +1 (017) 555-7713 +12 a@b.c@d.e é q%@z-.x.y"


def plain_spans(t):
    d = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d(m.group())) <= 19 and pii.luhn(d(m.group()))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(d(m.group())) <= 15]
    return sorted(out)


def test_pii_base():
    r = random.Random(9)
    for t in [PII, *("".join(r.choice("a1 @.+-()9") for _ in range(60)) for _ in range(3000))]:
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_model(spark):
    def number(r):
        return f"+1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)}"

    r = random.Random(4)
    rows = [(i, f"text {number(r)} more a{i}@mail{i % 9}.example.com at 12:{i % 60:02d} on 2023-01-{i % 28 + 1:02d}") for i in range(80)]
    rows += [(900, "call (212) 555-1234 now"), (901, "on 2024-02-03 at 10:20 for 3.50"), (902, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: x for x in pii.found(spark, d).collect()}
    assert got[900]["spans"] == "phone:5:19" and got[900]["n_phone"] == 0 and got[901]["spans"] == "" and got[902]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {x["doc_id"]: x["text"] for x in pii.redacted(spark, d).collect()}
    assert clean[900] == "call <PHONE> now" and clean[902] is None and "@" not in clean[0]


def test_pii_decoding_is_the_best_segmentation():
    r = np.random.RandomState(1)
    w, trans = r.standard_normal((5, pii.N_FEATURES)), r.standard_normal((5, 5))
    lat = pii.Lattice("+1 2-345678")
    s = pii._scores(lat, w)
    best = {}

    def walk(at, kind, total, path):
        if at == lat.n:
            best.setdefault("all", []).append((total, path))
            return
        for k, (i, j, _) in enumerate(lat.segs):
            if i == at:
                for t in range(5):
                    if np.isfinite(s[k, t]):
                        walk(j, t, total + s[k, t] + trans[kind, t], path + ([(lat.cuts[i], t - 1, lat.cuts[j])] if t else []))

    walk(0, 0, 0.0, [])
    assert pii.decode("+1 2-345678", w, trans, 0.0) == max(best["all"], key=lambda x: x[0])[1]
    p, _ = pii._marginals(lat, w, trans)
    z = np.logaddexp.reduce([v for v, _ in best["all"]])
    assert abs(p[:, 1:].sum() - sum(len(path) * np.exp(v - z) for v, path in best["all"])) < 1e-8


def plain_model(docs):
    """The model in plain dictionaries: (train counts, tokens, types, predictive probability of a word after another)."""
    end, begin = b"", b" "
    texts = {i: [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))] for i, t in docs}
    c, pairs, seats = Counter(), Counter(), Counter()
    for i, ws in texts.items():
        if language.training(i):
            c.update([*ws, end])
            pairs.update(zip([begin, *ws], [*ws, end], strict=True))
            seats.update([begin, *ws])
    rows = [(p, n) for p, n in pairs.items() if n > 1]
    n = np.array([x for _, x in rows])
    h = {w: int(language._hashes([w])[0]) for w in [*c, begin]}
    keys = language._pair(*(np.array([h[p[k]] for p, _ in rows], np.uint64) for k in (0, 1)))
    total, once = sum(c.values()), sum(x == 1 for x in c.values())
    known = [w for w in c if c[w] > 1]
    d, t, numbers, states = language.discount(total - n.sum(), (n == 2).sum()), np.ones(len(rows)), None, []
    for sweep in range(language.BURN + language.KEEP + 1):
        less = [Counter(), Counter()]
        for (p, x), y in zip(rows, t, strict=True):
            less[0][p[0]] += x - y
            less[1][p[1]] += x - y
        cp = np.array([c[w] - less[1][w] for w in known])
        if numbers is None:
            numbers = language.Numbers(len(c), d, language.discount(once + (cp == 1).sum(), (cp == 2).sum()), 0, len(c))
        root = language.seat(cp, np.full(len(cp), numbers.fresh), numbers.root_d, np.array([h[w] for w in known], np.uint64), 7919 * sweep)
        numbers = language.Numbers(len(c), d, numbers.root_d, cp.sum() + once, root.sum() + once)
        at = {w: (a, b) for w, a, b in zip(known, cp, root, strict=True)}

        def q(w, numbers=numbers, at=at):
            return numbers.root(*at[w]) if w in at else numbers.root(1, 1) if c[w] else numbers.root(0, 0)

        tables = {u: seats[u] - less[0][u] for u in seats}
        own = dict(zip([p for p, _ in rows], t, strict=True))

        def p(u, w, q=q, tables=tables, own=own):
            here = pairs[u, w] - d * (own[u, w] if (u, w) in own else 1) if pairs[u, w] else 0.0
            return (here + (language.STRENGTH + d * tables.get(u, 0)) * q(w)) / (language.STRENGTH + seats[u])

        if sweep > language.BURN:
            states.append(p)
        fresh = np.array([(language.STRENGTH + d * tables[u]) * q(w) for (u, w), _ in rows])
        if len(states) < language.KEEP:
            t = language.seat(n, fresh, d, keys, 104_729 * (sweep + 1))
    return c, total, len(c), lambda u, w: sum(p(u, w) for p in states) / len(states)


def test_language_against_a_plain_version(spark, docs):
    trace = []
    got = {r["doc_id"]: r for r in language.scored(spark, docs, trace).collect()}
    c, n, v, p = plain_model([(i, t) for i, t, *_ in corpus()])
    for i, t, *_ in corpus():
        own = [w.encode() for w in WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t))] + [b""]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(own), sum(c[w] > 0 for w in own), n, not language.training(i))
        assert abs(r["base_score"] - sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) < 1e-6
        assert r["score"] == pytest.approx(sum(np.log10(p(u, w)) for u, w in zip([b" ", *own[:-1]], own, strict=True)), rel=1e-5)
    for u in (b" ", corpus()[1][1].split()[0].encode(), b"never seen"):
        assert sum(p(u, w) for w in c) + p(u, b"never seen") == pytest.approx(1.0)
    again = {r["doc_id"]: r["score"] for r in language.scored(spark, docs.repartition(5)).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-3 for i, r in got.items())
    assert len(trace) == language.BURN + language.KEEP + 1 and abs(trace[-1] - trace[-2]) < abs(trace[1] - trace[0])


def test_language_learns_word_order(spark):
    """Held-out texts are likelier under the model than under the base, and in order than shuffled."""
    r = random.Random(12)
    after = {w: [r.randrange(200) for _ in range(4)] for w in range(200)}

    def text():
        w, out = r.randrange(200), []
        for _ in range(80):
            w = r.choice(after[w])
            out.append(f"v{w}")
        return out

    rows = [(i, " ".join(text())) for i in range(400)]
    rows += [(1000 + i, " ".join(r.sample(t.split(), 80))) for i, t in rows if not language.training(i)]
    got = {x["doc_id"]: x for x in language.scored(spark, spark.createDataFrame([x for x in rows if x[0] < 1000 or not language.training(x[0])], "doc_id long, text string")).collect()}
    held = [x for i, x in got.items() if i < 1000 and x["held_out"]]
    assert sum(x["score"] for x in held) > 0.8 * sum(x["base_score"] for x in held)
    assert all(got[i]["score"] > got[1000 + i]["score"] for i in got if i < 1000 and 1000 + i in got)


def test_seating_is_the_chinese_restaurant():
    r = np.random.RandomState(3)
    customers, fresh, d = np.repeat([2, 5, 30, 200], 400), np.repeat([0.5, 2.0, 1.0, 3.0], 400), 0.4
    got = language.seat(customers, fresh, d, r.randint(0, 2**62, 1600).astype(np.uint64), 5)
    for k in range(4):
        n, f, tables = customers[400 * k], fresh[400 * k], []
        for _ in range(400):
            t = 1
            for done in range(1, n):
                t += r.rand() < f / (done - d * t + f)
            tables.append(t)
        own = got[400 * k : 400 * k + 400]
        assert abs(own.mean() - np.mean(tables)) < 4 * np.sqrt((own.var() + np.var(tables)) / 400) + 0.02 * own.mean()
        assert 0.7 < (own.std() + 0.05) / (np.std(tables) + 0.05) < 1.4


def test_toxicity_on_held_out(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = [f"w{r.randrange(300)}word" for _ in range(60)] + (["vile", "scumlike"][: 1 + i % 2] * (1 + i % 3) if bad else [])
        r.shuffle(w)
        rows.append((i, " ".join("".join(c for c in x if c.isalpha()) + "abcdefghij"[int(x[1:2])] if x.startswith("w") and x[1:2].isdigit() else x for x in w)))
        if i < 300:
            labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    m = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (np.diff(m.thresholds) > 0).all()
    got = {x["doc_id"]: x["toxic"] for x in toxicity.scored(spark, d, m).collect()}
    assert np.mean([got[i] == (i % 4 == 0) for i in range(300, 400)]) >= 0.95


def test_toxicity_likelihood():
    """Slopes against differences, the optimum against a plain ordinal fit, severity against its formula."""
    r = np.random.RandomState(7)
    x = r.rand(120, 5) < 0.4
    z = x @ np.array([2.0, -1.0, 0.5, 0.0, 1.0]) + r.logistic(size=120)
    grade = np.digitize(z, [0.5, 1.5, 3.0])
    rows, cols = np.nonzero(x)
    weight = 1.0 + r.rand(120)

    def plain(w, raw):
        t = np.cumsum([raw[0], *np.exp(raw[1:])])
        up = np.array([[1.0, *(1 / (1 + np.exp(t - zi))), 0.0] for zi in x @ w])
        return -sum(k * np.log(u[g] - u[g + 1]) for k, u, g in zip(weight, up, grade, strict=True)) / 120 + 3e-4 * (w @ w) / 2

    w, raw = 0.3 * r.standard_normal(5), np.array([0.4, -0.2, 0.3])
    value, gw, graw = toxicity.likelihood(w, raw, rows, cols, grade, weight, 3e-4)
    assert value == pytest.approx(plain(w, raw))
    for v, g in ((w, gw), (raw, graw)):
        for i in range(len(v)):
            e = np.zeros(len(v))
            e[i] = 1e-6
            up, down = (plain(w + e, raw) - plain(w - e, raw), 0) if v is w else (plain(w, raw + e) - plain(w, raw - e), 0)
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)
    m = toxicity.fit([np.flatnonzero(row) for row in x], grade, bits=3, rounds=3000)
    weight[:] = np.where(grade > 0, max(1.0, np.sqrt((grade == 0).sum() / (grade > 0).sum())), 1.0)
    best = (m.weights[:5].astype(float), np.array([m.thresholds[0], *np.log(np.diff(m.thresholds))]))
    for _ in range(200):
        assert plain(best[0] + 0.05 * r.standard_normal(5), best[1] + 0.05 * r.standard_normal(3)) > plain(*best) - 1e-5
    assert m.severity(np.array([0, 4])) == pytest.approx(sum(1 / (1 + math.exp(t - m.weights[0] - m.weights[4])) for t in m.thresholds), rel=1e-5)


def test_pii_on_held_out_rewritings(spark):
    """Precision and recall of added spans on numbers written in ways and on lines that the model was not fitted on."""
    r = random.Random(21)
    d3 = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    rows = [(i, f"reach +1 ({d3(3)}) 555-{d3(4)} or b{i}@mail{i % 7}.example.org on 2023-0{i % 9 + 1}-11, {d3(2)}.{d3(2)} pieces") for i in range(120)]
    w, trans = pii.train(spark.createDataFrame(rows, "doc_id long, text string"))
    good = [f"ask for {x} there" for _ in range(60) for x in (f"({d3(3)}) {d3(3)}-{d3(4)}", f"{d3(3)}-{d3(3)}-{d3(4)}", f"{d3(3)}.{d3(3)}.{d3(4)}")]
    plain = [f"ask for {x} there" for _ in range(60) for x in (f"20{d3(2)}-{d3(2)}-{d3(2)}", f"{d3(2)}:{d3(2)}:{d3(2)}", f"{d3(1)}.{d3(5)}", f"{d3(3)} {d3(3)}")]
    hit = sum(pii.all_spans(t, pii.base_spans(t), w, trans) == [(8, 3, len(t) - 6)] for t in good)
    wrong = sum(bool(pii.all_spans(t, pii.base_spans(t), w, trans)) for t in plain)
    assert hit >= 0.95 * len(good) and wrong <= 0.02 * len(plain)
    far = "x" * 5000 + "1 (212) 555-1234"  # a long word does not hide what follows
    assert (5002, 3, 5016) in pii.all_spans(far, pii.base_spans(far), w, trans)


def test_long_words_take_linear_time():
    began = time.time()
    for text in ("x" * 1_000_000, "x" * 1_000_000 + "1", "1" * 1_000_000):
        assert pii.base_spans(text) == [] and pii.all_spans(text, [], np.zeros((5, pii.N_FEATURES)), np.zeros((5, 5))) == []
    assert len(urls.candidates(b"a." * 10_000 + b"net", b"/" + b"x" * 100_000, [3, 11], [1, 4])) == 4
    assert time.time() - began < 3


def test_urls(spark):
    rows = [("http://a.net/x", "net/", "block"), ("http://example.net/en/1", "example.net/en/", "allow"), ("http://EXAMPLE.net/fr/", "net/", "block"), ("http://b.example.com/de/?q", "example.com/de/", "block"), ("https://x.org/fr/", "org/fr/", "allow"), ("http://a.net", None, "allow"), ("http://anet/", None, "allow"), (None, None, "allow"), ("a.net/x", None, "allow"), ("http://net?/", None, "allow")]
    d = spark.createDataFrame([(i, u) for i, (u, *_) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged(spark, d, list(urls.RULES)).collect()}
    assert got == {i: (rule, v) for i, (_, rule, v) in enumerate(rows)}
    entries = spark.createDataFrame(list(urls.RULES), "verdict string, host string, prefix string")
    for out in (urls.judged_sharded(d, entries), urls.judged_by_table(spark, d, entries)):
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, urls.judged(spark, d, list(urls.RULES)).collect()))
    far = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judged_sharded(d, entries).collect()}
    assert far == got


def test_digest_index_confirms_strings(tmp_path):
    path = str(tmp_path / "i")
    urls.DigestIndex.write(path, [("block", f"h{i}.com", "/") for i in range(1000)])
    i = urls.DigestIndex(path)
    hits = i.find([b"h7.com /", b"h1001.com /", b"h999.com /"])
    assert [i.key(int(h)) if h >= 0 else None for h in hits] == [b"h7.com /", None, b"h999.com /"]
    i.digests = np.sort(np.concatenate([np.array(i.digests)[:-1], [xxhash.xxh64_intdigest(b"other /")]]).astype(np.uint64))
    assert i.find([b"other /"])[0] == -1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    """The queries with SQL, against DuckDB on the smallest tables."""
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, "/root/testdata/sf0.001"), con.sql(queries.ORACLES[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    rows = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str)
    assert rows and rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
