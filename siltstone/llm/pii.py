"""Personal data by base patterns and a semi-Markov conditional random field.

The base patterns find emails, IPv4 addresses, payment cards and phone numbers exactly. The model adds
spans to them, such as numbers written in ways that the patterns do not know. It cuts a region (a run of
words with a digit or an ``@``) into segments and gives each a kind, or none: a segment of up to
``MOST_ATOMS`` atoms is scored as a whole by features of its whole text and its two neighbours, a bounded
dynamic programme picks the best cut and kinds jointly, and what overlaps a base span is left out.

Weights are maximum likelihood (forward-backward over segmentations) on a bounded sample of regions of the
corpus, labelled by the base patterns, each also written in other ways (other separators, no country code).
Patterns are applied so that no text takes more than linear time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import map_rows, read

KINDS = ("email", "ip", "card", "phone")
#: Atoms of an entity at most.
MOST_ATOMS = 20
#: Documents whose regions the model is fitted on, at most, and regions of one shape among them.
SAMPLE, SHAPE = 600, 6
#: Added spans need a log-odds of this over no entity.
MARGIN = 2.0
SEED = 5

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A later start inside the same run of digits cannot match where the first one does not.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
# A region starts where a word does, so that words without a digit are gone through once.
_REGION = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*(?:\x20[^\s0-9@]*+[0-9@]\S*)*")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order."""
    if not _ANY.search(text):
        return []
    out = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            low = m.end()
        at = text.find("@", max(at + 1, low))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        d = _digits(m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


# ---- the model --------------------------------------------------------------------------------

_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\Z")
_GROUPED = re.compile(r"(\+?[0-9]{1,3}[ .-]?)?(\([0-9]{2,4}\)|[0-9]{2,4})[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}\Z")
_CARDLIKE = re.compile(r"[0-9]{14,19}\Z|[0-9]{4}([ -])[0-9]{4,6}\1[0-9]{4,5}(\1[0-9]{3,4})?\Z")
N_FEATURES = 30


def _features(s: str, left: str, right: str) -> np.ndarray:
    """Of a whole span and the characters next to it (or '')."""
    f = np.zeros(N_FEATURES)
    d = _digits(s)
    n = len(d)
    parts = s.split(".")
    quad = len(parts) == 4 and all(p and all("0" <= c <= "9" for c in p) for p in parts)
    letters = any(c.isalpha() for c in s)
    separators = {c for c in s if c in " .-"}
    f[0] = 1
    f[1] = 14 <= n <= 19 and not letters and luhn(d)
    f[2] = 14 <= n <= 19 and not f[1]
    f[3] = 10 <= n <= 15
    f[4] = 7 <= n <= 9
    f[5] = n < 7
    f[6] = n > 19
    f[7] = s[0] == "+"
    f[8] = "(" in s and ")" in s
    f[9] = "-" in s
    f[10] = " " in s
    f[11] = "." in s
    f[12] = s.count("@") == 1
    f[13] = f[12] and _EMAIL.match(s) is not None
    f[14] = f[12] and not f[13]
    f[15] = quad
    f[16] = quad and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    f[17] = letters
    f[18] = letters and not f[12]
    f[19] = "0" <= s[0] <= "9"
    f[20] = s[-1].isalnum()
    f[21] = left.isalnum() and s[0].isalnum()
    f[22] = right.isalnum() and s[-1].isalnum()
    f[23] = any(not (c.isalnum() or c in " .-()@_%+") for c in s)
    f[24] = left in {"+", ".", "-", "@", "(", "#", "/", ":"} if left else 0
    f[25] = not letters and _GROUPED.match(s) is not None
    f[26] = not letters and _CARDLIKE.match(s) is not None
    f[27] = len(separators) > 1
    f[28] = right in {"-", "@", "/", ":", ")"} if right else 0
    f[29] = n == len(s)
    return f


def _atoms(region: str) -> tuple[list[int], np.ndarray]:
    """Where atoms start (the region's end last), and a row for each: may start an entity, may end one, letters, digits, ``@``."""
    cuts, flags = [], []
    for m in _ATOM.finditer(region):
        s = m.group()
        word = s[0].isalnum()
        cuts.append(m.start())
        flags.append((word or s in "+(", word or s == ")", s[0].isalpha(), _ANY.match(s) is not None, s == "@"))
    return [*cuts, len(region)], np.array(flags, np.int64).reshape(-1, 5)


class Lattice:
    """The segments of a region that end after atoms ``lo`` to ``hi``: (first atom, after the last atom), features, and
    which may be entities: those with a digit or an ``@``, over five characters, with letters only beside an ``@``."""

    def __init__(self, region: str, atoms: tuple[list[int], np.ndarray] | None = None, lo: int = 0, hi: int | None = None):
        self.cuts, flags = atoms or _atoms(region)
        self.n = len(self.cuts) - 1
        lo, hi = lo, self.n if hi is None else min(hi, self.n)
        low = max(0, lo - MOST_ATOMS)
        sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(flags[low:hi], axis=0)])
        place = np.asarray(self.cuts)
        found = [(j - 1, j, False) for j in range(lo + 1, hi + 1)]
        for k in range(1, MOST_ATOMS + 1):
            i = np.arange(max(low, lo + 1 - k), hi - k + 1)
            if not len(i):
                continue
            of = sums[i + k - low] - sums[i - low]
            ok = (flags[i, 0] > 0) & (flags[i + k - 1, 1] > 0) & (place[i + k] - place[i] > 5) & ((of[:, 4] > 0) | ((of[:, 2] == 0) & (of[:, 3] > 0)))
            if k == 1:
                for at in i[ok].tolist():
                    found[at - lo] = (at, at + 1, True)
            else:
                found += [(at, at + k, True) for at in i[ok].tolist()]
        self.segs = sorted(found)
        rows = [_features(region[(a := self.cuts[i]) : (z := self.cuts[j])], region[a - 1 : a] if a else "", region[z : z + 1]) for i, j, _ in self.segs]
        self.x = np.array(rows).reshape(-1, N_FEATURES)
        self.ending: dict[int, list[int]] = {j: [] for j in range(lo + 1, hi + 1)}
        for k, (_, j, _) in enumerate(self.segs):
            self.ending[j].append(k)


_T = len(KINDS) + 1  # 0: no entity


def _allowed(lat: Lattice) -> np.ndarray:
    ok = np.zeros((len(lat.segs), _T), bool)
    for k, (i, j, entity) in enumerate(lat.segs):
        ok[k, 0] = j == i + 1
        ok[k, 1:] = entity
    return ok


def _scores(lat: Lattice, w: np.ndarray) -> np.ndarray:
    return np.where(_allowed(lat), lat.x @ w.T, -np.inf)


def _marginals(lat: Lattice, w: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(segment, kind) over all segmentations, and expected transitions."""
    s = _scores(lat, w)
    alpha = np.full((lat.n + 1, _T), -np.inf)
    alpha[0, 0] = 0.0
    came = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        for j in range(1, lat.n + 1):
            for k in lat.ending[j]:
                i = lat.segs[k][0]
                came[k] = np.logaddexp.reduce(alpha[i][:, None] + trans, axis=0)
                alpha[j] = np.logaddexp(alpha[j], came[k] + s[k])
        z = np.logaddexp.reduce(alpha[lat.n])
        beta = np.full((lat.n + 1, _T), -np.inf)
        beta[lat.n] = 0.0
        p, moves = np.zeros_like(s), np.zeros((_T, _T))
        for j in range(lat.n, 0, -1):
            for k in lat.ending[j]:
                i = lat.segs[k][0]
                here = s[k] + beta[j]
                p[k] = np.exp(came[k] + here - z)
                both = alpha[i][:, None] + trans + here[None, :]
                moves += np.exp(both - z)
                beta[i] = np.logaddexp(beta[i], np.logaddexp.reduce(trans + here[None, :], axis=1))
    return np.nan_to_num(p), np.nan_to_num(moves)


#: Atoms that a lattice spans at a time when a region is decoded: what is held does not grow with the region but by a few numbers an atom.
STRIDE = 512


def decode(region: str, w: np.ndarray, trans: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the best segmentation's entities, over the whole region however long; of ties the first met."""
    atoms = _atoms(region)
    n = len(atoms[0]) - 1
    best = np.full((n + 1, _T), -np.inf)
    best[0, 0] = 0.0
    back = np.zeros((n + 1, _T, 2), np.int32)  # where the segment starts, and the kind before
    for lo in range(0, n, STRIDE):
        lat = Lattice(region, atoms, lo, lo + STRIDE)
        s = _scores(lat, w)
        s[:, 1:] -= margin
        for j, ending in lat.ending.items():
            for k in ending:
                i = lat.segs[k][0]
                v = best[i][:, None] + trans
                frm = v.argmax(axis=0)
                tot = v[frm, np.arange(_T)] + s[k]
                for t in np.flatnonzero(tot > best[j]):
                    best[j, t] = tot[t]
                    back[j, t] = i, frm[t]
    out, j, t = [], n, int(best[n].argmax())
    while j > 0:
        i, before = back[j, t].tolist()
        if t:
            out.append((atoms[0][i], t - 1, atoms[0][j]))
        j, t = i, before
    return out[::-1]


def _gold(lat: Lattice, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]] | None:
    """(segment, kind) in order, or None if the spans do not lie on atoms."""
    where = {(lat.cuts[i], lat.cuts[j]): k for k, (i, j, e) in enumerate(lat.segs) if e}
    first = {i: k for k, (i, j, _) in enumerate(lat.segs) if j == i + 1}
    starts, path, i = {a: (kind, z) for a, kind, z in spans}, [], 0
    while i < lat.n:
        a = lat.cuts[i]
        if a in starts:
            kind, z = starts[a]
            k = where.get((a, z))
            if k is None:
                return None
            path.append((k, kind + 1))
            i = lat.segs[k][1]
        else:
            path.append((first[i], 0))
            i += 1
    return path


def fit(regions: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 20, steps: int = 6000, rate: float = 0.1, l2: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights, transitions) by AdaGrad on the likelihood of labelled regions, each gone through ``epochs`` times or
    more, up to ``steps`` in all."""
    w, trans = np.zeros((_T, N_FEATURES)), np.zeros((_T, _T))
    w[1:, 0] = -2.0
    data = []
    for region, spans in regions:
        lat = Lattice(region)
        if (path := _gold(lat, spans)) is not None:
            gx, gt, last = np.zeros_like(w), np.zeros_like(trans), 0
            for k, t in path:
                gx[t] += lat.x[k]
                gt[last, t] += 1
                last = t
            data.append((lat, gx, gt))
    sw, st = np.full_like(w, 1e-6), np.full_like(trans, 1e-6)
    order = np.random.RandomState(SEED)
    for _ in range(max(epochs, -(-steps // max(1, len(data))))):
        for k in order.permutation(len(data)):
            lat, gx, gt = data[k]
            p, moves = _marginals(lat, w, trans)
            g = gx - p.T @ lat.x - l2 * w
            h = gt - moves - l2 * trans
            sw += g * g
            st += h * h
            w += rate * g / np.sqrt(sw)
            trans += rate * h / np.sqrt(st)
    return w, trans


def _shape(s: str) -> str:
    return re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 20)}>", s))


def _rewritten(region: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The region with its one span written in other ways, under the same label."""
    if len(spans) != 1:
        return []
    (a, kind, z), out = spans[0], []
    s, d = region[a:z], _digits(region[a:z])
    ways = []
    if kind == 3 and len(d) >= 10:
        local = d[-10:]
        ways = [f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"1-{local[:3]}-{local[3:6]}-{local[6:]}"]
    elif kind == 2 and len(d) == 16:
        ways = [sep.join(d[i : i + 4] for i in range(0, 16, 4)) for sep in " -"]
    for way in ways:
        if way != s:
            out.append((region[:a] + way + region[z:], [(a, kind, a + len(way))]))
    return out


#: Regions that are none of these kinds, whatever the corpus holds.
_OTHERS = ("2024-01-31", "12:30:05", "3.14159", "1,234,567.89", "v2.10.3", "10-20", "100 200 300", "1999-2004", "4.0.", "555-1234567890123", "0.001", "1/2/2024", "12345", "1234567", "2024 2025", "@user", "a@b", "(1)", "[12]", "1.2.3", "00:1a:2b:3c", "1234567812345678", "50%", "$19.99", "2023-10-05T14:48:00")


def train(docs: DataFrame, sample: int = SAMPLE, each: int = SHAPE) -> tuple[np.ndarray, np.ndarray]:
    """A model of the regions of about ``sample`` documents, by hash of id and text; what is gathered is as bounded.

    The hashes are ranked first, which are a number a row; texts are read of the documents under the last hash.
    """
    rank = F.xxhash64(F.lit(SEED), "doc_id", F.xxhash64("text"))
    src = docs.where("text rlike '[0-9@]'").select(rank.alias("rank"), "text")
    last = src.select("rank").orderBy("rank").limit(sample).agg(F.max("rank")).first()[0]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [m.group() for t in b.column("text").to_pylist() for m in _REGION.finditer(t) if len(m.group()) <= 120]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], names=["region"])

    picked = src.where(F.col("rank") <= F.lit(last)).select("text")
    found = map_rows(picked, run, "region string").distinct().orderBy(F.xxhash64("region"), "region").limit(20 * sample).toArrow()
    rows, seen, ways = [], {}, set()
    for region in [*_OTHERS, *found.column("region").to_pylist()]:
        shape = _shape(region)
        if seen.setdefault(shape, 0) < each:
            seen[shape] += 1
            spans = [x for x in base_spans(region)]
            spans = [x for i, x in enumerate(spans) if not any(x[0] < y[2] and y[0] < x[2] for y in spans[:i])]
            others = _rewritten(region, spans)[: 4 if seen[shape] <= 3 else 0]
            ways |= {_shape(r[a:z]) for r, ((a, _, z),) in others}
            rows += [(region, spans), *others]
    # What the corpus writes in a way that the base does not know is no example of text without personal data.
    return fit([(r, spans) for r, spans in rows if spans or _shape(r) not in ways][: 4 * sample])


def all_spans(text: str, base: list[tuple[int, int, int]], w: np.ndarray, trans: np.ndarray, known: dict | None = None) -> list[tuple[int, int, int]]:
    """The base spans and those that the model adds, in order.

    Regions without ``@``, separators and seven digits are not decoded: they are too short for any kind.
    """
    out = list(base)
    for m in _REGION.finditer(text) if _ANY.search(text) else ():
        a, z = m.span()
        region = text[a:z]
        if not any(c in region for c in "@.-+() ") and sum("0" <= c <= "9" for c in region) < 7:
            continue
        got = known.get(region) if known is not None else None
        if got is None:
            got = decode(region, w, trans)
            if known is not None and len(known) < 20_000 and len(region) <= 200:
                known[region] = got
        own = [x for x in base if x[0] < z and a < x[2]]
        for s, kind, e in got:
            s, e = a + s, a + e
            if not any(s < y and x < e for x, _, y in own):
                out.append((s, kind, e))
    return sorted(out)


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _model(spark: SparkSession, docs: DataFrame):
    return spark.sparkContext.broadcast(train(docs))


def found(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of ``docs``.

    The counts and the digest are of the base spans, ``spans`` is of all. Null and empty texts have none; very long
    texts and words are taken whole, in time linear in their length; of segmentations that tie the first met holds;
    repeated rows are treated alike; an empty table gives none; other columns are ignored, whatever their names.
    """
    model = _model(spark, docs)
    src = docs.select("doc_id", "text")

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, trans = model.value
        counts, shas, spans, known = [], [], [], {}
        for t in b.column("text").to_pylist():
            base = base_spans(t or "")
            counts.append([sum(k == i for _, k, _ in base) for i in range(len(KINDS))])
            shas.append(hashlib.sha256(_text(base).encode()).hexdigest())
            spans.append(_text(all_spans(t or "", base, w, trans, known)))
        n = np.array(counts, np.int64).reshape(-1, len(KINDS))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(n[:, i]) for i in range(len(KINDS))], pa.array(shas), pa.array(spans)], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return map_rows(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of spans that overlap one mask stands for all."""
    out, at = [], 0
    for s, k, e in spans:
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with personal data masked in ``text`` (null stays null); n_chars, if there, follows.

    Long texts, ties, repeated rows and empty tables as in ``found``; other columns stay, whatever their names.
    """
    model = _model(spark, docs)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["text"].alias("text"))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        w, trans = model.value
        known: dict = {}
        texts = [None if t is None else masked(t, all_spans(t, base_spans(t), w, trans, known)) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "clean"])

    out = map_rows(row, run, f"row {row.schema['row'].dataType.simpleString()}, clean string")
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("clean").isNotNull(), F.char_length("clean").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if new.get(c) is not None else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of all documents; nulls, long texts, ties and repeats as in ``found``."""
    return found(spark, read(spark, sf_dir, "documents"))
