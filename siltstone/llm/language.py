"""LM scoring by a hierarchical Pitman-Yor model.

Every word that comes before another one in the training documents has a restaurant of its own (and so has the start
of a text), whose customers are the tokens that follow it; dishes are words and the end of a text. The tables of all
these restaurants are customers of one root restaurant, their common parent, and a new table of the root draws its
dish from all V known words and one unknown word alike, the same events as those of the base score.

Seating is sampled by Gibbs sweeps: customers of a dish come anew one after another, given the tables of all other
dishes as the sweep before left them. After ``BURN`` sweeps the predictive probabilities of ``KEEP`` more are averaged.
Random numbers come from hashes of dish and sweep, so that tasks may be run again with the same result.

Nothing is held whole by a task or the driver. A narrow pass encodes the texts in chunks of bounded bytes, dealt by
their place in the input: a chunk has its distinct words, and its tokens by number. Its distinct words, and its
distinct pairs of neighbouring words, go to buckets by hash, packed, so that no word makes a bucket larger than another,
and a bucket adds them up. A pair that occurs once has one table whatever is sampled, so the sweeps go through pairs that
occur twice or more, bucket by bucket; with c(w) customers in all, a word's tables are c(w) less the customers beyond each
dish's tables in those pairs. A bucket of pairs tells the buckets of words so much for each of its distinct words, packed,
and is answered what is known of them: what is shuffled is a word for each bucket that has it, not two for each pair. In
the end the buckets answer the chunks in the order of their questions, and a chunk adds up the scores of its documents.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, byte_runs, map_rows, mix, read, tokenized

FOLDS = 10
BURN, KEEP = 1, 2
#: Text bytes of a chunk, and for each bucket of pairs and of words, about.
CHUNK_BYTES, BUCKET_BYTES, WORD_BUCKET_BYTES = 6 << 20, 4 << 20, 12 << 20
#: Neighbouring buckets of words that are seated together, so that pairs have fewer of them to tell.
STATE_BUCKETS = 4
#: Strengths of the restaurants of preceding words and of the root.
STRENGTH, ROOT_STRENGTH = 2.0, 10.0
#: The end of a text as a dish, its start as a context: neither can be a word.
_END, _START = b"", b" "
#: Rows of encoded chunks are megabytes: few at a time.
_FEW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
_BLOCK = 32 << 20


def training(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS != 0


# ---- seating ----------------------------------------------------------------------------------


def _uniform(h: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(h ^ np.uint64((salt * 0x9E3779B97F4A7C15) % 2**64)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def binomial(n: np.ndarray, p: np.ndarray, keys: np.ndarray, salt: int) -> np.ndarray:
    """Successes of n draws: by the distribution function where they are few, else by its normal limit."""
    u, mean, deviation = _uniform(keys, salt), n * p, np.sqrt(n * p * (1 - p))
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * _uniform(keys, salt + 1))
    out = np.clip(np.rint(mean + deviation * normal), 0, n)
    few = np.flatnonzero((mean < 9) & (p < 1))
    if len(few):
        odds, left = p[few] / (1 - p[few]), n[few].astype(np.float64)
        term = np.exp(left * np.log1p(-p[few]))
        below, k = term.copy(), np.zeros(len(few))
        for i in range(1, 64):
            more = u[few] > below
            if not more.any():
                break
            term = term * odds * np.maximum(left - i + 1, 0) / i
            below += term
            k += more
        out[few] = k
    return np.where(p >= 1, n, out)


def seat(customers: np.ndarray, fresh: np.ndarray, discount: float, keys: np.ndarray, salt: int) -> np.ndarray:
    """Tables of each dish after its customers came one by one.

    ``fresh``: weight of a new table, (strength + discount * tables of the restaurant) * parent's probability
    of the dish; an old table's weight is its customers less the discount. Each of the first 32 customers is
    drawn; later ones in blocks of a sixteenth of those before, at the chance of a new table in the block's middle.
    """
    t = np.minimum(customers, 1).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    done, step = 1, 0
    while len(live):
        block = 1 if done < 32 else done // 16
        size = np.minimum(block, customers[live] - done)
        p = np.clip(fresh[live] / np.maximum(done + (size - 1) / 2 - discount * t[live] + fresh[live], 1e-300), 0.0, 1.0)
        salted = salt + 977 * step
        new = (_uniform(keys[live], salted) < p) if block == 1 else binomial(size, p, keys[live], salted)
        t[live] = np.minimum(t[live] + new, customers[live])
        done += block
        step += 1
        live = live[customers[live] > done]
    return t


def discount(once: int, twice: int) -> float:
    """The usual estimate from the counts of counts."""
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5


# ---- chunks -----------------------------------------------------------------------------------


def _hashes(words: list[bytes]) -> np.ndarray:
    """56 bits of each word's hash, by which pairs know their words; counts of words are of the words themselves."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) >> np.uint64(8)


def _list(words: pa.Array) -> list[bytes]:
    """Words as Python's bytes, by Arrow at once and not one after another."""
    return words.to_numpy(zero_copy_only=False).tolist()


#: A hash of eight bytes, of which seven are kept: numpy copies them at once.
_CUT = np.dtype([("low", "V7"), ("top", "V1")])


def _seven(h: np.ndarray) -> bytes:
    """The seven bytes of each hash."""
    return h.astype("<u8").view(_CUT)["low"].tobytes()


def _eight(column) -> np.ndarray:
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 7)
    return np.pad(raw, ((0, 0), (0, 1))).view("<u8").ravel()


def _hash(word: bytes) -> int:
    return int(_hashes([word]).view(np.int64)[0])


def _pair(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(u * np.uint64(0x9E3779B97F4A7C15) + w)


def _planes(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte, all first bytes first: small ones pack well."""
    return x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _whole(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def _order(bucket: np.ndarray, buckets: int) -> np.ndarray:
    """The stable order by bucket; sorting sixteen bits takes one pass for each byte."""
    return np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")


def _runs(bucket: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of equal values."""
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    return list(zip(cuts, [*cuts[1:], len(bucket)], strict=True))


def _encoded(docs: DataFrame, buckets: int) -> DataFrame:
    """A row for each chunk: its documents, their tokens by number, and its distinct words (the end of a text is one of
    them) with their counts, in parts, one for each bucket of words. Words have no spaces, so that a part is a text.

    Tokens are numbered by how frequent their word is in the chunk, of equal ones by the place in the parts.
    """
    src = docs.select("doc_id", "text")
    counts = "words: binary, n: binary, held: binary"

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at, n in byte_runs(b.column("text"), CHUNK_BYTES):
            ids, t = b.column("doc_id").slice(at, n), tokenized(b.column("text").slice(at, n), lower=True)
            train = np.array([training(i) for i in ids.to_pylist()], bool)
            n_all = np.append(np.bincount(t.ids, minlength=len(t.words)), len(ids))
            n_train = np.append(np.bincount(t.ids[train[t.text]], minlength=len(t.words)), train.sum())
            words = [*_list(t.words), _END]
            bucket = (_hashes(words) % np.uint64(buckets)).astype(np.int64)
            order = _order(bucket, buckets)
            rank = np.empty(len(order), np.int64)
            rank[order[np.argsort(-n_all[order], kind="stable")]] = np.arange(len(order))
            dealt = [words[i] for i in order.tolist()]
            parts = [{"p": int(bucket[order[a]]), "words": b" ".join(dealt[a:z]), "n": _planes(n_train[order[a:z]]), "held": _planes((n_all - n_train)[order[a:z]])} for a, z in _runs(bucket[order])]
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            cols = [one(ids), one(pa.array(t.lens)), pa.array([_planes(rank[t.ids])]), one(pa.array(parts, pa.struct([("p", pa.int64()), ("words", pa.binary()), ("n", pa.binary()), ("held", pa.binary())])))]
            yield pa.RecordBatch.from_arrays(cols, names=["ids", "lens", "tokens", "parts"])

    kind = src.schema["doc_id"].dataType.simpleString()
    out = map_rows(src, run, f"ids array<{kind}>, lens array<long>, tokens binary, parts array<struct<p: long, {counts}>>")
    return out.withColumn("chunk", F.monotonically_increasing_id())


class Chunk:
    """The distinct (context, word) pairs of a chunk, ordered by bucket, and which one each token (or end) is."""

    def __init__(self, row, buckets: int):
        self.lens = np.array(row["lens"], np.int64)
        words = [w for x in row["parts"] for w in x["words"].split(b" ")]
        n = np.concatenate([_whole(x["n"]) + _whole(x["held"]) for x in row["parts"]])
        by_rank, self.start = np.argsort(-n, kind="stable"), len(words)
        ends = np.cumsum(self.lens + 1)
        self.text = np.repeat(np.arange(len(self.lens)), self.lens + 1)
        word = np.full(len(self.text), words.index(_END), np.int64)
        inner = np.ones(len(word), bool)
        inner[ends - 1] = False
        word[inner] = by_rank[_whole(row["tokens"])]
        before = np.concatenate([[self.start], word[:-1]])[: len(word)]
        before[ends - self.lens - 1] = self.start
        pair, of = np.unique(before * (self.start + 1) + word, return_inverse=True)
        u, w = pair // (self.start + 1), pair % (self.start + 1)
        h = _hashes([*words, _START])
        bucket = (_pair(h[u], h[w]) % np.uint64(buckets)).astype(np.int64)
        order = _order(bucket, buckets)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.bucket, self.u, self.w, self.pair = bucket[order], u[order], w[order], place[of]
        self.hu, self.hw = h[self.u], h[self.w]


def _asked_words(chunks: DataFrame) -> DataFrame:
    """(p, chunk, words, n): the words that a chunk has in a bucket, and how often its training documents have them."""
    return chunks.select("chunk", F.explode("parts").alias("part")).select("part.p", "chunk", "part.words", "part.n")


def _asked_pairs(chunks: DataFrame, buckets: int) -> DataFrame:
    """(p, chunk, u, w, n): the pairs that a chunk has in a bucket, as hashes, and how often its training documents have them."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            c = Chunk(row, buckets)
            train = np.array([training(i) for i in row["ids"]], bool)
            n, runs = np.bincount(c.pair, train[c.text], minlength=len(c.u)), _runs(c.bucket)
            each = lambda x: pa.array([_seven(x[a:z]) for a, z in runs], pa.binary())
            counts = pa.array([_planes(n[a:z]) for a, z in runs], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c.bucket[[a for a, _ in runs]]), pa.array([row["chunk"]] * len(runs)), each(c.hu), each(c.hw), counts], names=["p", "chunk", "u", "w", "n"])

    return map_rows(chunks.select("chunk", "ids", "lens", "tokens", "parts"), run, "p long, chunk long, u binary, w binary, n binary")


def _counts(t: pa.Table) -> np.ndarray:
    return np.concatenate([_whole(x) for x in t.column("n").to_pylist()])


def _places(total: np.ndarray) -> np.ndarray:
    """The place of each word or pair among those of the bucket that occur twice or more; -1: once, -2: never."""
    often = total > 1
    return np.where(often, np.cumsum(often) - 1, np.where(total == 1, -1, -2)).astype(np.int32)


def _replied(t: pa.Table, ref: np.ndarray, sizes: list[int], **found) -> pa.Table:
    """The references of each question, and a row without chunk of what the bucket has found."""
    refs = [x.tobytes() for x in np.split(ref, np.cumsum(sizes)[:-1])]
    rows = {"p": [t.column("p")[0].as_py()] * (len(refs) + 1), "chunk": [*t.column("chunk").to_pylist(), None]}
    out = {k: pa.array(v, pa.int64()) for k, v in rows.items()} | {"refs": pa.array([*refs, None], pa.binary())}
    return pa.table(out | {k: pa.array([None] * len(refs) + [v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in found.items()})


def _added_words(asked: DataFrame) -> DataFrame:
    """(p, chunk, refs, h, c, once, many, customers, ends): the answers' references; of the bucket's words that occur twice or
    more the hashes and counts; how many occur once or more often, the customers of these and among them the ends."""

    def work(t: pa.Table) -> pa.Table:
        parts = [x.split(b" ") for x in t.column("words").to_pylist()]
        own = pa.array([w for x in parts for w in x], pa.binary()).dictionary_encode()
        of = np.asarray(own.indices)
        total = np.bincount(of, _counts(t), minlength=len(own.dictionary)).astype(np.int64)
        often = total > 1
        h = _hashes(_list(own.dictionary.filter(pa.array(often))))
        # Of words that share a hash, pairs know the first; the others have numbers that no hash is.
        again = np.ones(len(h), bool)
        again[np.unique(h, return_index=True)[1]] = False
        h[again] |= np.uint64(1 << 60)
        c = total[often]
        found = {"once": (total == 1).sum(), "many": len(c), "customers": c.sum(), "ends": c[h == np.uint64(_hash(_END))].sum()}
        return _replied(t, _places(total)[of], list(map(len, parts)), h=h.tobytes(), c=c.tobytes(), **{k: int(v) for k, v in found.items()})

    return asked.groupBy("p").applyInArrow(work, "p long, chunk long, refs binary, h binary, c binary, once long, many long, customers long, ends long")


def _added_pairs(asked: DataFrame) -> DataFrame:
    """(p, chunk, refs, u, w, n, often, twice): the answers' references; of the bucket's pairs that occur twice or more the
    words and counts, their customers, and how many occur twice."""

    def work(t: pa.Table) -> pa.Table:
        u, w = _eight(t.column("u")), _eight(t.column("w"))
        _, first, of = np.unique(_pair(u, w), return_index=True, return_inverse=True)
        total = np.bincount(of, _counts(t), minlength=len(first)).astype(np.int64)
        often = first[total > 1]
        return _replied(t, _places(total)[of], [len(x) // 7 for x in t.column("u").to_pylist()], u=u[often].tobytes(), w=w[often].tobytes(), n=total[total > 1].tobytes(), often=int(total[total > 1].sum()), twice=int((total == 2).sum()))

    return asked.groupBy("p").applyInArrow(work, "p long, chunk long, refs binary, u binary, w binary, n binary, often long, twice long")


# ---- the state --------------------------------------------------------------------------------


class Numbers:
    """The few numbers of a state that every task needs."""

    def __init__(self, words: int, d: float, root_d: float, customers: int, tables: int):
        self.base, self.d, self.root_d, self.customers, self.tables = 1.0 / (words + 1), d, root_d, customers, tables

    @property
    def fresh(self) -> float:
        return (ROOT_STRENGTH + self.root_d * self.tables) * self.base

    def root(self, customers, tables):
        """Probability of a dish of the root (arrays or numbers)."""
        return (customers - self.root_d * tables + self.fresh) / (ROOT_STRENGTH + self.customers)


def _joined(t: pa.Table, column: str) -> np.ndarray:
    """The whole numbers of all rows that are not null."""
    return np.frombuffer(b"".join(x for x in t.column(column).to_pylist() if x), np.int64)


def _home(h: np.ndarray, buckets: int) -> np.ndarray:
    """The state bucket that knows each word; the start of a text is by itself."""
    return np.where(h == _hash(_START), -1, (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64) // STATE_BUCKETS)


def _own_words(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, by state bucket, and which of them each is."""
    own, of = np.unique(h, return_inverse=True)
    order = np.argsort(_home(own, buckets), kind="stable")
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    return own[order], place[of]


#: A bucket's pairs (g is null): their distinct preceding and following words, for each pair which of these it has, its
#: customers, tables, and the tables of the states that are averaged, added up; or what it tells state bucket g: words,
#: and the customers beyond the tables in their own restaurant and as dishes.
_PAIRS = {"p": pa.int64(), "g": pa.int64(), **dict.fromkeys(("hu", "hw", "u", "w", "n", "t", "kept", "own", "root"), pa.binary())}
_PAIRS_SCHEMA = "p long, g long, hu binary, hw binary, u binary, w binary, n binary, t binary, kept binary, own binary, root binary"


def _with_told(p: int, hu: np.ndarray, hw: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, t: np.ndarray, kept: np.ndarray, buckets: int) -> pa.Table:
    """The row of a bucket's pairs and what it tells."""
    out = [{"p": p, "hu": hu.tobytes(), "hw": hw.tobytes(), "u": u.tobytes(), "w": w.tobytes(), "n": n.tobytes(), "t": t.tobytes(), "kept": kept.tobytes()}]
    own, root = (np.bincount(of, n - t, minlength=len(h)).astype(np.int64) for of, h in ((u, hu), (w, hw)))
    gu, gw = _home(hu, buckets), _home(hw, buckets)
    homes = np.union1d(gu, gw)
    cuts = [np.searchsorted(x, homes, side).tolist() for x in (gu, gw) for side in ("left", "right")]
    for g, a, b, c, e in zip(homes.tolist(), *cuts, strict=True):
        out.append({"p": p, "g": g, "hu": hu[a:b].tobytes(), "own": own[a:b].tobytes(), "hw": hw[c:e].tobytes(), "root": root[c:e].tobytes()})
    return pa.Table.from_pylist(out, pa.schema(_PAIRS))


def _first(pairs: DataFrame, buckets: int) -> DataFrame:
    """Each bucket's pairs with one table each, and what it tells."""

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in b.to_pylist():
            u, w, n = (np.frombuffer(row[c], np.int64) for c in ("u", "w", "n"))
            (hu, u), (hw, w) = _own_words(u, buckets), _own_words(w, buckets)
            yield from _with_told(row["p"], hu, hw, u, w, n, np.minimum(n, 1), np.zeros(len(n), np.int64), buckets).combine_chunks().to_batches()

    return map_rows(pairs.where("chunk is null").select("p", "u", "w", "n"), run, _PAIRS_SCHEMA)


def _seated(known: DataFrame, pairs: DataFrame, numbers: Numbers, ends: int, salt: int) -> DataFrame:
    """The restaurants of all words, and the root seated anew.

    By bucket of words s: c, their customers at the root, its tables, the tables and customers of their own restaurants;
    and sums. By bucket of pairs p (and g): for its preceding words the last two of these, for the following ones those
    of the root.
    """
    fresh, d = numbers.fresh, numbers.root_d
    packed = ("c", "cp", "t", "tables", "seats")
    sums = ("customers", "seated", "one", "two")
    schema = pa.schema({**dict.fromkeys(("s", "p", "g"), pa.int64()), **dict.fromkeys(packed, pa.binary()), **dict.fromkeys(sums, pa.int64())})

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("s")
        h, c = _joined(left, "h"), _joined(left, "c")
        seats = np.where(h == _hash(_END), 0, np.where(h == _hash(_START), ends, c))
        order = np.argsort(h, kind="stable")
        at = {x: order[np.searchsorted(h[order], _joined(right, x))] for x in ("hu", "hw")}
        less = {x: np.bincount(at[x], _joined(right, y), minlength=len(h)).astype(np.int64) for x, y in (("hu", "own"), ("hw", "root"))}
        # No word has fewer than one customer or table: hashes that words share are bounded so.
        cp, tables = np.maximum(np.minimum(c, 1), c - less["hw"]), np.maximum(np.minimum(seats, 1), seats - less["hu"])
        t = seat(cp, np.full(len(cp), fresh), d, h.view(np.uint64), salt).astype(np.int64)
        out, a = [], 0
        for s, own in zip(left.column("s").to_pylist(), left.column("h").to_pylist(), strict=True):
            x = slice(a, a := a + len(own) // 8)
            out.append({"s": s, **{k: v[x].tobytes() for k, v in zip(packed, (c, cp, t, tables, seats), strict=True)}})
            out[-1] |= {"customers": int(cp[x].sum()), "seated": int(t[x].sum()), "one": int((cp[x] == 1).sum()), "two": int((cp[x] == 2).sum())}
        i = j = 0
        for p, g, hu, hw in zip(*(right.column(k).to_pylist() for k in ("p", "g", "hu", "hw")), strict=True):
            u, w = at["hu"][i : (i := i + len(hu) // 8)], at["hw"][j : (j := j + len(hw) // 8)]
            out.append({"p": p, "g": g, "cp": cp[w].tobytes(), "t": t[w].tobytes(), "tables": tables[u].tobytes(), "seats": seats[u].tobytes()})
        return pa.Table.from_pylist(out, schema)

    told = pairs.where("g is not null").select("p", "g", "hu", "hw", "own", "root")
    kinds = ", ".join([f"{k} long" for k in ("s", "p", "g")] + [f"{k} binary" for k in packed] + [f"{k} long" for k in sums])
    return known.groupBy("g").cogroup(told.groupBy("g")).applyInArrow(work, kinds)


def _answered(pairs: DataFrame, state: DataFrame):
    """Each bucket's pairs beside what the state answers."""
    return pairs.where("g is null").groupBy("p").cogroup(state.where("p is not null").select("p", "g", "cp", "t", "tables", "seats").groupBy("p"))


def _weights(left: pa.Table, right: pa.Table, numbers: Numbers) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """A bucket's pairs, the weight of a new table of each, and the customers in its restaurant."""
    row, right = left.to_pylist()[0], right.sort_by("g")
    own = {k: np.frombuffer(row[k], np.int32 if k in ("u", "w") else np.int64) for k in ("hu", "hw", "u", "w", "n", "t", "kept")}
    new = STRENGTH + numbers.d * _joined(right, "tables")
    return own, new[own["u"]] * numbers.root(_joined(right, "cp"), _joined(right, "t"))[own["w"]], _joined(right, "seats")[own["u"]]


def _likelihood(pairs: DataFrame, state: DataFrame, numbers: Numbers) -> float:
    """The log-likelihood of the customers of all pairs."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        own, f, seats = _weights(left, right, numbers)
        return pa.table({"ll": [float((own["n"] * np.log10((own["n"] - numbers.d * own["t"] + f) / (STRENGTH + seats))).sum())]})

    return _answered(pairs, state).applyInArrow(work, "ll double").agg(F.sum("ll")).first()[0]


def _sweep(pairs: DataFrame, state: DataFrame, numbers: Numbers, salt: int, keep: bool, buckets: int) -> DataFrame:
    """``pairs`` seated anew; the tables that they had are added to what is kept, or not."""

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        own, f, _ = _weights(left, right, numbers)
        hu, hw, u, w, n = (own[k] for k in ("hu", "hw", "u", "w", "n"))
        t = seat(n, f, numbers.d, _pair(hu.view(np.uint64)[u], hw.view(np.uint64)[w]), salt).astype(np.int64)
        return _with_told(left.column("p")[0].as_py(), hu, hw, u, w, n, t, own["kept"] + (own["t"] if keep else 0), buckets)

    return _answered(pairs, state).applyInArrow(work, _PAIRS_SCHEMA)


def _answers(added: DataFrame, found: DataFrame, values: Callable[[pa.Table], list[np.ndarray]], once: list[float], never: list[float], kind: str) -> DataFrame:
    """(of, kind, at, m): for each question, by bucket, the ``values`` of what it asks for, as packed floats.

    ``values``: of what ``found`` has of a bucket, by the place there.
    """
    rest = np.array([never, once], np.float32)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        own = np.concatenate([np.column_stack(values(right)).astype(np.float32), rest])
        m = [own[np.frombuffer(x, np.int32)].tobytes() for x in left.column("refs").to_pylist()]
        return pa.table({"of": left.column("chunk"), "kind": pa.array([kind] * len(m), pa.string()), "at": left.column("p"), "m": pa.array(m, pa.binary())})

    asked = added.where("chunk is not null").select("p", "chunk", "refs")
    return asked.groupBy("p").cogroup(found.groupBy("p")).applyInArrow(work, "of long, kind string, at long, m binary")


def scored(spark: SparkSession, docs: DataFrame, trace: list[float] | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity), a row for each row of ``docs``.

    Null texts count as empty (one token, the end); a null doc_id as the empty text; very long texts are chunks of
    their own; repeated rows are counted and scored each; equal texts score alike (ties); an empty table gives none;
    other columns are ignored, whatever their names. ``perplexity`` is of the averaged predictive probabilities, per
    token. ``trace`` is told the mean log-likelihood of what is sampled, sweep by sweep.
    """
    with Scratch(spark) as s:
        size = docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
        buckets, word_buckets = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // WORD_BUCKET_BYTES))
        chunks = s.table(_encoded(docs, word_buckets), block=_BLOCK)
        asked = s.table(_added_pairs(_asked_pairs(chunks, buckets)), settings=_FEW)
        pairs = s.table(_first(asked, word_buckets), settings=_FEW)
        words = s.table(_added_words(_asked_words(chunks)), settings=_FEW)
        # Words that occur once have one table each; the start of a text is a context that is no dish.
        once, n, customers, ends = (x or 0 for x in words.agg(*(F.sum(c) for c in ("once", "many", "customers", "ends"))).first())
        # One training document ends once, and is not among the known words then.
        total, distinct = customers + once, n + once
        ends = ends or int(total > 0)
        begin = spark.range(1).select(F.lit(-1).cast("long").alias("s"), F.lit(np.int64(_hash(_START)).tobytes()).alias("h"), F.lit(np.int64(0).tobytes()).alias("c"))
        known = words.where("chunk is null").select(F.col("p").alias("s"), "h", "c").union(begin).withColumn("g", F.floor(F.col("s") / STATE_BUCKETS))
        often, twice = (x or 0 for x in asked.agg(F.sum("often"), F.sum("twice")).first())
        d, kept = discount(total - often, twice), []
        # The first state seats one table for each dish of a restaurant; it tells the root's discount.
        numbers = Numbers(distinct, d, 0.0, 0, distinct)
        one, two = (x or 0 for x in _seated(known, pairs, numbers, ends, 0).agg(F.sum("one"), F.sum("two")).first())
        numbers = Numbers(distinct, d, discount(once + one, two), 0, distinct)
        for sweep in range(BURN + KEEP + 1):
            state = s.table(_seated(known, pairs, numbers, ends, 7919 * sweep))
            customers, tables = state.agg(F.sum("customers"), F.sum("seated")).first()
            numbers = Numbers(distinct, d, numbers.root_d, (customers or 0) + once, (tables or 0) + once)
            if trace is not None and often:
                trace.append(_likelihood(pairs, state, numbers) / often)
            if sweep > BURN:  # this state's seats are averaged
                kept.append((numbers, state))
            if len(kept) < KEEP:
                new = s.table(_sweep(pairs, state, numbers, 104_729 * (sweep + 1), sweep > BURN, word_buckets))
                s.drop(pairs)
                pairs = new
            if sweep <= BURN:
                s.drop(state)
        each = [x for x, _ in kept]
        beyond = lambda t, seats: (STRENGTH + d * t) / (STRENGTH + seats)
        begins = [state.where("s = -1").select("tables", "seats").first() for _, state in kept]
        start = np.array([ends, *(x for b in begins for x in (0.0, beyond(*(int(np.frombuffer(v, np.int64)[0]) for v in b))))])
        seen = [x for own in each for x in (own.root(1, 1), (STRENGTH + d) / (STRENGTH + 1))]
        new = [x for own in each for x in (own.root(0, 0), 1.0)]

        def of_words(t: pa.Table) -> list[np.ndarray]:
            """Counts are whole numbers, in two parts that floats hold exactly."""
            states = [t.filter(pa.compute.equal(t.column("i"), i)) for i in range(KEEP)]
            c, own = _joined(states[0], "c"), [{k: _joined(x, k) for k in ("cp", "t", "tables", "seats")} for x in states]
            return [c & 0xFFFFFF, c >> 24, *(x for one, v in zip(each, own, strict=True) for x in (one.root(v["cp"], v["t"]), beyond(v["tables"], v["seats"])))]

        def of_pairs(t: pa.Table) -> list[np.ndarray]:
            """What pairs have beyond their parent's share in all kept states."""
            return [KEEP * _joined(t, "n") - d * (_joined(t, "kept") + _joined(t, "t"))]

        states = [state.where("s >= 0").select(F.col("s").alias("p"), F.lit(i).alias("i"), "c", "cp", "t", "tables", "seats") for i, (_, state) in enumerate(kept)]
        told = _answers(words, functools.reduce(DataFrame.union, states), of_words, [1.0, 0.0, *seen], [0.0, 0.0, *new], "word")
        told = s.table(told.union(_answers(asked, pairs.where("g is null").select("p", "n", "t", "kept"), of_pairs, [KEEP * (1 - d)], [0.0], "pair")))
        for used in (words, asked, pairs, *(state for _, state in kept)):
            s.drop(used)
        log_n = float(np.log10(total + 0.1 * (distinct + 1)))

        def score(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            c, ids = Chunk(row, buckets), row["ids"]
            told = sorted(zip(right.column("at").to_pylist(), right.column("kind").to_pylist(), right.column("m").to_pylist(), strict=True), key=lambda x: x[0])
            blob = {k: np.frombuffer(b"".join([m for _, own, m in told if own == k]), np.float32).astype(np.float64) for k in ("word", "pair")}
            v = blob["word"].reshape(-1, len(start) + 1)
            v = np.concatenate([np.column_stack([v[:, 0] + 2.0**24 * v[:, 1], v[:, 2:]]), start[None, :]])  # the start is the last one
            count = v[:, 0]
            own = blob["pair"] / (STRENGTH + count[c.u])
            for i in range(KEEP):
                own += v[c.u, 2 * i + 2] * v[c.w, 2 * i + 1]
            lp, known, plain = np.log10(own / KEEP), count[c.w] > 0, np.log10(count[c.w] + 0.1)
            add = lambda x: np.bincount(c.text, x[c.pair], minlength=len(ids))
            n_all = c.lens + 1
            columns = {"n_tokens": n_all, "n_known": add(known).astype(np.int64), "train_tokens": np.full(len(ids), total), "base_score": add(plain) - n_all * log_n, "score": add(lp)}
            return pa.table({"doc_id": left.column("ids").chunk(0).flatten(), "held_out": pa.array([not training(i) for i in ids], pa.bool_()), **{k: pa.array(v) for k, v in columns.items()}})

        kind = docs.schema["doc_id"].dataType.simpleString()
        src = chunks.select("chunk", "ids", "lens", "tokens", "parts")
        out = src.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        return s.table(out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))), keep=True)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scores of every document; nulls, long texts, ties and repeats as in ``scored``."""
    return scored(spark, read(spark, sf_dir, "documents"))
