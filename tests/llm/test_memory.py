"""What a Python worker holds of texts."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from siltstone.llm import concatenation, language
from siltstone.llm.common import Scratch, byte_runs


def test_a_run_of_texts_is_small():
    ids = concatenation.Ids(None)
    ids.of(pa.array(["one two"]))  # the tokenizer itself is loaded
    column = pa.array([" ".join(str(i % 5000) for i in range(j, j + 2000)) for j in range(1000)])
    tracemalloc.start()
    for at, n in byte_runs(column, concatenation.RUN):
        ids.of(column.slice(at, n))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6


def test_words_met_again_are_not_told_again(monkeypatch):
    """A frequent word stays known while others come and go, and ids are those of whole texts."""
    monkeypatch.setattr(concatenation, "REMEMBERED", 50)
    ids, told = concatenation.Ids(None), []
    encoded = ids._encoded
    monkeypatch.setattr(ids, "_encoded", lambda words: told.extend(words) or encoded(words))
    for r in range(12):
        texts = [f"The café {r}{i}x rare{r}-{i}, again" for i in range(20)]
        flat, n = ids.of(pa.array([*texts, None]))
        whole = [[*ids.tokenizer.encode(t, add_special_tokens=False).ids, concatenation.END] for t in [*texts, ""]]
        assert flat.tolist() == [x for w in whole for x in w] and n.tolist() == list(map(len, whole))
        assert len(ids.known) <= 50 + 43
    assert told.count("The") == told.count("café") == told.count("again") == 1


def test_words_are_told_without_case_and_marks(monkeypatch):
    """What differs in the case of an ASCII text or in marks at its end is told once, words of letters without the rules."""
    ids = concatenation.Ids(None)
    quick, whole = [], []
    for name, told in (("_by_word", quick), ("_by_place", whole)):
        monkeypatch.setattr(ids, name, lambda words, f=getattr(ids, name), told=told: told.extend(words) or f(words))
    texts = ["Alpha, BETA. alpha beta!?) (alpha", "ALPHA beta,beta it's 7-up ALPHA, gamma###", "l'été, Été"]
    flat, n = ids.of(pa.array(texts))
    every = [[*ids.tokenizer.encode(t, add_special_tokens=False).ids, concatenation.END] for t in texts]
    assert flat.tolist() == [x for w in every for x in w] and n.tolist() == list(map(len, every))
    assert sorted(quick) == sorted({"alpha", "beta", "gamma", "Été"})
    assert sorted(whole) == sorted({",", ".", "!?)", "(alpha", "beta,beta", "it's", "7-up", "###", "l'été"})


def test_odd_words_keep_their_ids():
    """Added tokens in capitals, marks behind what is no letter, combining marks, letters that grow in lower case, many marks."""
    words = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|endoftext|>.", "X<|startoftext|>,Y.", "a<|b|>", "J\u030c,", "J\u030c", "x\u0329,", "\u0130,", "\u0130", "×,", "a×,", "é,", "É.", "ßß!", "œ,", "K,", "\u212a", "'s,", "it'S'.", "IT'S", "a'", "a''s", "7,", "a7.", "!", "...", "a" + "." * 7, "a" + "." * 8, "a" + "." * 9, "é" + "!?" * 20, "a_", "a__,", "a|>", "\\", "a\\", "\u1e9e.", "ÿ]", "A", "\xff"]
    r = random.Random(5)
    texts = [*words, *map(str.lower, words), *(" ".join(r.choices([w for w in words if all_ascii <= w.isascii()], k=9)) for all_ascii in (False, True) for _ in range(150)), None, "", " \x1c \n"]
    for column in (pa.array(texts), pa.array(texts).slice(7), pa.array(texts, pa.large_string())):
        ids = concatenation.Ids(None)
        whole = [[*ids.tokenizer.encode(t or "", add_special_tokens=False).ids, concatenation.END] for t in column.to_pylist()]
        flat, n = ids.of(column)
        assert flat.tolist() == [x for w in whole for x in w] and n.tolist() == list(map(len, whole))


def test_a_tokenizer_of_other_rules_is_told_whole_words(tmp_path):
    """Case, marks and words of letters are looked at only where the tokenizer's own rules are the known ones."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"[UNK]": 0, "Alpha,": 5, "alpha": 6, "Alpha": 7, ",": 8, "beta": 70_000}, unk_token="[UNK]"))
    other.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    other.save(path := str(tmp_path / "other.json"))
    ids = concatenation.Ids(path)
    assert ids.quick is None and ids.kind == "<u4"
    flat, n = ids.of(pa.array(["Alpha, alpha Alpha beta", None]))
    assert flat.tolist() == [5, 6, 7, 70_000, concatenation.END, concatenation.END] and n.tolist() == [5, 1]


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_ids_cross_spark_as_bytes(spark, monkeypatch, kind):
    """A document's ids are one value for Spark, two bytes of each id or four; the pieces have them whole."""
    one = concatenation.ids_of(None)
    docs = spark.createDataFrame([(i, "Alpha, beta " * i) for i in range(40)], "doc_id long, text string")
    rows = concatenation.tokens(docs)
    assert rows.schema["ids"].dataType.simpleString() == "binary"
    assert all(len(r["ids"]) == 2 * r["n"] for r in rows.collect())
    flat, n = one.of(pa.array(["Alpha, beta " * i for i in range(40)]))
    ends = np.cumsum(n)
    raw = [flat[e - k : e].astype(kind).tobytes() for e, k in zip(ends, n, strict=True)]
    column = pa.array([b"before", *raw], pa.binary()).slice(1)
    assert concatenation.unpacked(column, int(ends[-1])).tolist() == flat.tolist()


def test_hashes_and_orders_are_plain_ones():
    """Seven bytes of each hash as copied one by one, the stable order by bucket also beyond sixteen bits, words as bytes."""
    h = language._hashes([b"a", b"", b"\xc3\xa9"] * 400)
    packed = language._seven(h)
    assert packed == b"".join(int(x).to_bytes(7, "little") for x in h)
    assert (language._eight(pa.array([packed[:7], b"", packed[7:]], pa.binary())) == h).all()
    for buckets in (1, 50, 1 << 16, 1 << 17):
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        assert language._order(bucket, buckets).tolist() == sorted(range(len(h)), key=bucket.tolist().__getitem__)
    assert language._list(pa.array([b"x", b"\xff", b""], pa.binary()).dictionary_encode().dictionary) == [b"x", b"\xff", b""]


def test_language_writes_no_row_for_a_pair(spark, monkeypatch):
    """The sweeps hold pairs of words packed, by bucket: no table has a row for each; more buckets give the same scores."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join(r.choices(words, k=200))) for i in range(60)], "doc_id long, text string")
    rows, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, **k: rows.append((out := table(self, df, **k)).count()) or out)
    one = {x["doc_id"]: x["score"] for x in language.scored(spark, docs).collect()}
    assert rows[-1] == len(one) == 60 and max(rows[:-1]) < 60
    monkeypatch.setattr(language, "BUCKET_BYTES", 4000)
    monkeypatch.setattr(language, "WORD_BUCKET_BYTES", 2000)
    many = {x["doc_id"]: x["score"] for x in language.scored(spark, docs).collect()}
    assert many == pytest.approx(one, rel=1e-9)
