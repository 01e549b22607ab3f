"""Packing by concatenation: all documents' tokens are one stream, which is cut into windows of fixed length.

Two passes. The first tokenizes: a task writes its documents' ids, each with its place in the task's own stream, so that
the last place is the task's total. Prefix sums over these totals, a number a task, give the place of each task's stream in
the whole one, and the second pass cuts every document where a window ends, knowing nothing but its own place. No row is
sorted or shuffled, and no window is ever gathered to find the cuts.

Each piece is a boundary record: which ids of which document lie where in which window. Only the last window may be short.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, byte_runs, filled, read, tokenized

LENGTH = 2048
#: The id after each document.
END = 1
TOKENIZER = "word_bpe_49k.json"
#: Words told to the tokenizer in one text; words of a generation, of which a worker remembers two; text bytes that are split at once, about.
JOINED, REMEMBERED, RUN = 64, 200_000, 2 << 20
#: How the public tokenizer parts texts. Only of one that has these rules is it known that case makes no difference, that
#: letters are parted from marks that follow them, and that a word of letters is not parted.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: Added tokens are found before case is dropped; marks of which none is in such a token.
ADDED = re.compile(r"<\|\w+\|>").fullmatch
MARKS = set(string.punctuation) - set("<|>_")
#: A word of letters that neither NFC nor lower case makes longer or shorter.
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_MARK, _ASCII_LETTER, _LATIN_LETTER = np.zeros((3, 256), bool)
_MARK[list(map(ord, MARKS))] = True
_ASCII_LETTER[list(string.ascii_letters.encode())] = True
_LATIN_LETTER[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True  # after 0xC3: À to ÿ but × and ÷
#: Marks at a word's end that are looked through.
TAIL = 8


@cache
def tokenizer(path: str | None):
    """The tokenizer of a file; None: the public one of this package's queries, as installed where the task runs."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for each core
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return Tokenizer.from_file(path)


@cache
def quick(path: str | None):
    """The same model for lower-case words of letters, which need no rules but white space; None if the rules are others."""
    whole = tokenizer(path)
    from tokenizers import Tokenizer, pre_tokenizers

    rules = json.loads(whole.to_str())
    suffix, vocabulary = rules["model"].get("end_of_word_suffix"), whole.get_vocab()
    if (rules["normalizer"] or {}).get("normalizers") != NORMALIZERS or (rules["pre_tokenizer"] or {}).get("pretokenizers") != PRE_TOKENIZERS:
        return None
    if not suffix or not all(c + suffix in vocabulary for c in pre_tokenizers.ByteLevel.alphabet()) or not all(ADDED(t["content"]) for t in rules["added_tokens"]):
        return None
    out = Tokenizer(whole.model)
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


def gathered(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of ``flat`` that begin at ``begins``, one after the other."""
    return flat[np.arange(sizes.sum()) + np.repeat(begins - np.cumsum(sizes) + sizes, sizes)]


def parted(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(pieces, how many of each word): marks that end a word (binary, not empty) behind a letter are a piece of their own."""
    _, offsets, data = words.buffers()
    kind = np.int64 if pa.types.is_large_binary(words.type) else np.int32
    at = np.frombuffer(offsets, kind)[words.offset : words.offset + len(words) + 1]
    byte, begin, end = np.frombuffer(data, np.uint8) if len(words) else np.zeros(1, np.uint8), at[:-1], at[1:]
    tail, own = np.zeros(len(words), kind), np.arange(len(words))
    for k in range(1, TAIL + 1):
        own = own[(end[own] - begin[own] > k) & _MARK[byte[end[own] - k]]]
        tail[own] = k
    a = np.maximum(end - tail - 1, begin)
    letter = _ASCII_LETTER[byte[a]] | _LATIN_LETTER[byte[a]] & (a > begin) & (byte[a - 1] == 0xC3)
    tail = np.where(letter, tail, 0)
    cuts = np.column_stack([begin, end - tail]).ravel()
    pieces = pa.Array.from_buffers(words.type, 2 * len(words), [None, pa.py_buffer(np.append(cuts, at[-1:]).astype(kind)), data])
    return pieces.filter(pa.array(np.column_stack([np.ones(len(tail), bool), tail > 0]).ravel())), 1 + (tail > 0)


class Ids:
    """Ids of runs of texts. The tokenizer never joins what white space parts, so that each distinct word is told to it once.

    By the rules of ``quick`` ASCII texts are told in lower case, and marks that end a word are a word of their own.

    ``known`` has the number of each word that has been met, ``flat`` the words' ids one after the other, ``ends`` where
    those of each word end. When they are many, they become the generation before (``old``) and new ones begin: words that
    are met again pass on from it, so that only those that were not met for a whole generation are told anew.
    """

    def __init__(self, path: str | None):
        self.tokenizer, self.quick = tokenizer(path), quick(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        if self.quick:
            suffix = self.tokenizer.model.end_of_word_suffix
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for w, i in vocabulary.items() if w.endswith(suffix)]] = True
        self._begin()
        self._age()

    def _begin(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def _age(self) -> None:
        self.old = self.known, self.flat, self.ends
        self._begin()

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word)."""
        if not self.quick:
            return self._by_place(words)
        plain = np.fromiter(map(LETTERS, words), bool, len(words))
        if plain.all() or not plain.any():
            return (self._by_word if plain.all() else self._by_place)(words)
        parts = [np.flatnonzero(plain), np.flatnonzero(~plain)]
        told = [f([words[i] for i in part.tolist()]) for f, part in zip((self._by_word, self._by_place), parts, strict=True)]
        order, (ids, n) = np.concatenate(parts), (np.concatenate(x) for x in zip(*told, strict=True))
        sizes, begins = np.empty_like(n), np.empty_like(n)
        sizes[order], begins[order] = n, np.cumsum(n) - n
        return gathered(ids, begins, sizes), sizes

    def _by_word(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_encoded`` of words of letters: each has one id that ends a word."""
        ids: list[int] = []
        texts = [" ".join(words[i : i + JOINED]).lower() for i in range(0, len(words), JOINED)]
        for i in range(0, len(texts), 256):
            for e in self.quick.encode_batch_fast(texts[i : i + 256], add_special_tokens=False):
                ids += e.ids
        flat = np.array(ids, np.int32)
        return flat, np.diff(np.flatnonzero(self.last[flat]), prepend=-1)

    def _by_place(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``_encoded`` of any words: they are told in joined texts, and where an id begins tells its word."""
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        starts = np.cumsum(lens) - lens
        ids: list[int] = []
        at: list[np.ndarray] = []
        texts = [" ".join(words[i : i + JOINED]) for i in range(0, len(words), JOINED)]
        for i in range(0, len(texts), 256):
            for k, e in enumerate(self.tokenizer.encode_batch(texts[i : i + 256], add_special_tokens=False)):
                ids += e.ids
                at.append(np.fromiter(map(itemgetter(0), e.offsets), np.int64, len(e)) + starts[(i + k) * JOINED])
        of = np.searchsorted(starts, np.concatenate(at), "right") - 1
        return np.array(ids, np.int32), np.bincount(of, minlength=len(words))

    def _met(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_encoded`` of words that this generation does not know, those of the one before from there."""
        known, flat, ends = self.old
        at = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        told = np.flatnonzero(at < 0)
        if len(told) == len(words):
            return self._encoded([w.decode() for w in words])
        ids, n = self._encoded([words[i].decode() for i in told.tolist()]) if len(told) else (flat[:0], at[:0])
        sizes, begins = ends[at + 1] - ends[at], ends[at]
        sizes[told], begins[told] = n, len(flat) + np.cumsum(n) - n
        return gathered(np.concatenate([flat, ids]), begins, sizes), sizes

    def _placed(self, words: pa.Array) -> np.ndarray:
        """The number of each word, once all are known."""
        if len(self.known) > REMEMBERED:
            self._age()
        known, n = self.known, len(self.known)
        at = np.fromiter(map(known.get, own := words.to_numpy(zero_copy_only=False).tolist(), repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(at < 0)
        if len(new):
            unmet = [own[i] for i in new.tolist()]
            ids, sizes = self._met(unmet)
            known.update(zip(unmet, range(n, n + len(new)), strict=True))
            self.flat, self.ends = np.concatenate([self.flat, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
            at[new] = np.arange(n, n + len(new))
        return at

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where those of each word begin, how many they are) of the distinct words of a run."""
        if not self.quick:
            own = self._placed(words)
            return self.flat, self.ends[own], self.ends[own + 1] - self.ends[own]
        pieces, n = parted(words)
        each = pieces.dictionary_encode()
        own = self._placed(each.dictionary)[np.asarray(each.indices)]
        ends = np.concatenate([[0], np.cumsum(self.ends[own + 1] - self.ends[own])])
        last = np.cumsum(n)
        return gathered(self.flat, self.ends[own], np.diff(ends)), ends[last - n], ends[last] - ends[last - n]

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, each with its end; number of ids of each text)."""
        column = filled(column)
        if self.quick:
            easy = pc.and_not(pc.string_is_ascii(column), pc.match_substring(column, "<|"))
            column = pc.if_else(easy, pc.ascii_lower(column), column)
        t = tokenized(column)
        flat, begins, each = self._words(t.words)
        begins, each = begins[t.ids], each[t.ids]
        total = np.concatenate([[0], np.cumsum(each)])
        counts = total[t.ends] - total[t.starts]
        # Every word's ids, one place later for each text before it, whose end stands between.
        place = np.arange(total[-1]) + np.repeat(begins - total[:-1], each)
        out = np.full(total[-1] + len(counts), END, np.int32)
        out[np.arange(total[-1]) + np.repeat(np.arange(len(counts)), counts)] = flat[place]
        return out, counts + 1


@cache
def ids_of(path: str | None) -> Ids:
    """One for all tasks of a Python worker, so that what one has met the next one knows."""
    return Ids(path)


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, part, at, n, ids): ids of each text with its end, ``at`` their place in the stream of the task ``part``.

    ``ids`` are little-endian bytes, two of each id where the vocabulary allows it, else four: Spark copies a document's as one value.
    """
    src = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, ids = TaskContext.get().partitionId(), 0, ids_of(path)
        for batch in batches:
            for lo, rows in byte_runs(batch.column("text"), RUN):
                b = batch.slice(lo, rows)
                flat, n = ids.of(b.column("text"))
                ends = np.cumsum(n)
                raw = flat.astype(ids.kind)
                packed = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((np.concatenate([[0], ends]) * raw.itemsize).astype(np.int32)), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(rows, part, np.int32)), pa.array(at + ends - n), pa.array(n), packed], names=["doc_id", "part", "at", "n", "ids"])
                at += int(ends[-1])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, part int, at long, n long, ids binary")


def unpacked(column: pa.Array, n: int) -> np.ndarray:
    """The ``n`` ids of ``tokens``, as unsigned little-endian words."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[column.offset] : at[column.offset + len(column)]]
    return raw.view("<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def cut(rows: DataFrame, length: int, total: int, with_ids: bool) -> DataFrame:
    """The pieces of (doc_id, base, at, n, ids) at the ends of windows."""
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "padded_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            place = np.asarray(b.column("base")) + np.asarray(b.column("at"))
            n, flat = np.asarray(b.column("n")), unpacked(b.column("ids"), int(pc.sum(b.column("n")).as_py()))
            pieces = (place + n - 1) // length - place // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            window = place[row] // length + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            lo, hi = np.maximum(place[row], window * length), np.minimum(place[row] + n[row], (window + 1) * length)
            first = (np.cumsum(n) - n)[row] + lo - place[row]
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(first.tolist(), (hi - lo).tolist(), strict=True)]
            size = np.minimum((window + 1) * length, total) - window * length
            padded = np.where(size & (size - 1) == 0, size, length)
            cols = [b.column("doc_id").take(pa.array(row)), *map(pa.array, (lo - place[row], hi - lo, np.array(crc, np.int64), n[row], window, lo - window * length, size, padded))]
            if with_ids:  # pieces of a batch follow each other without gaps
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hi - lo)]), pa.int32()), pa.array(flat.view(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in names[1:9]) + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


def packed(spark: SparkSession, docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_tokens [, ids]): the pieces.

    ``sequence_tokens`` is how many ids a sequence has, ``padded_tokens`` what it is padded to: itself at a power of two,
    else ``length``. Null and empty texts are their end id alone; a null doc_id is kept; very long texts lie in as many
    sequences as they need; rows that repeat, or share a doc_id, are documents of their own; order follows how rows lie in
    the files, so that there are no ties: the same files give the same pieces; an empty table gives none; other columns are
    ignored, whatever their names.
    """
    with Scratch(spark) as s:
        written = s.table(tokens(docs, path), keep=True)
        # A number for each task of the first pass: what the driver holds grows with tasks, not with rows.
        totals = sorted((r["part"], r["n"]) for r in written.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts = [0, *accumulate(n for _, n in totals)]
    bases = spark.createDataFrame([(p, at) for (p, _), at in zip(totals, starts, strict=False)], "part int, base long")
    return cut(written.join(F.broadcast(bases), "part").select("doc_id", "base", "at", "n", "ids"), length, starts[-1], with_ids)


def sequences(pieces: DataFrame, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, doc_ids, offsets) of pieces with their ids: padded ids, and the documents with where each begins.

    A sequence is at most its length, so that what meets in a group is bounded; sequences without pieces have no row.
    """
    piece = F.struct("offset", "doc_id", "ids", "padded_tokens")
    d = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("p"))
    ids = F.flatten(F.transform("p", lambda x: x["ids"]))
    filled = F.concat(ids, F.array_repeat(F.lit(pad), (F.col("p")[0]["padded_tokens"] - F.size(ids)).cast("int")))
    return d.select("sequence_id", filled.alias("ids"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("offsets"))


def op12_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents; nulls, long texts, ties and repeats as in ``packed``."""
    return packed(spark, read(spark, sf_dir, "documents"))
