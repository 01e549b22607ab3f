"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each document gets a handful of measures in one pass. Per (lang, source) a sketch counts the values of
each measure in logarithmic buckets, which bounds the relative error of any quantile (the DDSketch idea);
sketches merge by adding counts, so Spark's partial aggregation builds them, and one hot source costs no more
than the others. Documents that fail the base rules are not counted: what is surely bad does not tell what is usual.
A limit is ``median + spreads * (upper quantile - median)``, for the mean length of words a lower one in the same way:
no constant of a measure enters. Where hardly any document has a thing at all (symbols, repeats), these quantiles are zero
and tell nothing: a limit is no lower than half the median of those documents that do have it. The quantiles of a group
are drawn to those of its language, and these to those of everything, by the number of documents that stand behind them.
The limits, a row per group, are joined back and documents that are surely beyond one of them are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, filled, join_small, map_runs, read, tokenized

#: measure -> (quantile that tells its spread above the median, how many such spreads above the median its limit lies)
FENCES = {"symbol_ratio": (0.90, 2.0), "dup_line_ratio": (0.98, 2.0), "repeat_ratio": (0.98, 3.0), "mean_word": (0.90, 3.0)}
#: The shares among them: what is counted, and of how many.
COUNTED = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words")}
#: Documents that the quantiles of the wider group count as.
PRIOR = 50
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOLS = "#*$%&|<>"
ALPHA = 0.01
_GAMMA = (1 + ALPHA) / (1 - ALPHA)
#: Values below this share the lowest bucket.
LEAST, ZERO = 1e-4, -1_000_000


def measures(column: pa.Array) -> np.ndarray:
    """A row for each text: words, code points in words, symbols, duplicate lines, words in repeated 3-word windows,
    lines with a word.

    Words and lines are numbered by themselves, not by hashes, so that equal numbers are equal words.
    """
    column = filled(column)
    t, n = tokenized(column), len(column)
    count = lambda of, weights=None: np.bincount(of, weights, minlength=n).astype(np.int64)
    points = np.asarray(pc.utf8_length(t.words.cast(pa.string()))).astype(np.int64)
    symbols = sum(np.asarray(pc.count_substring(column, c)).astype(np.int64) for c in _SYMBOLS)
    lists = pc.split_pattern(column, "\n")
    lines = lists.flatten()
    own = np.repeat(np.arange(n), np.asarray(lists.value_lengths()))
    full = np.asarray(pc.binary_length(pc.ascii_trim_whitespace(lines))) > 0
    own, lines = own[full], lines.filter(pa.array(full)).dictionary_encode()
    different = np.unique(own * (len(lines.dictionary) + 1) + np.asarray(lines.indices))
    distinct = count(different // (len(lines.dictionary) + 1))
    at = t.runs_of(3)
    again = np.zeros(len(t.ids), bool)
    if len(at):
        _, two = np.unique(t.ids[at] * (len(t.words) + 1) + t.ids[at + 1], return_inverse=True)
        three = two.astype(np.int64) * (len(t.words) + 1) + t.ids[at + 2]
        order = np.argsort(three, kind="stable")  # texts stay in order within equal windows
        same = (np.diff(three[order]) == 0) & (np.diff(t.text[at[order]]) == 0)
        met = np.zeros(len(at), bool)
        met[order[1:][same]] = met[order[:-1][same]] = True
        for j in range(3):
            again[at[met] + j] = True
    lined = count(own)
    return np.stack([t.lens, count(t.text, points[t.ids]), symbols, lined - distinct, count(t.text[again]), lined], axis=1)


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` as the struct ``row``, and the measures; null texts count as empty. One narrow pass."""
    cols = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    src = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[text].alias("text"))
    row = src.schema["row"].dataType.simpleString()

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = measures(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array(found[:, i]) for i in range(6)]], names=["row", *cols])

    out = map_runs(src, run, f"row {row}, " + ", ".join(f"{c} long" for c in cols))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return out.select(
        "*",
        (F.col("n_symbols") / chars).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / words).alias("repeat_ratio"),
        (F.col("word_chars") / words).alias("mean_word"),
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
    )


def sketches(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, bucket, n): the mergeable sketch of each group's documents that pass the base rules, as a table."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in FENCES]))
    bucket = F.when(F.col("p.value") < LEAST, F.lit(ZERO)).otherwise(F.ceil(F.ln("p.value") / math.log(_GAMMA)).cast("int"))
    return measured.where("not base_failed").select(*keys, pairs.alias("p")).groupBy(*keys, F.col("p.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, measure, n, mid, high, low, some, typical): the quantiles that limits are made of, of each group and measure.

    ``some`` is how many values are not in the lowest bucket, ``typical`` their median. A group has as many rows here as its sketch has buckets, at most a few hundred.
    """
    w = Window.partitionBy(*keys, "measure")
    value = F.when(F.col("bucket") == ZERO, F.lit(0.0)).otherwise(2 * F.pow(F.lit(_GAMMA), F.col("bucket")) / (_GAMMA + 1))
    level = F.create_map(*[F.lit(x) for m, (p, _) in FENCES.items() for x in (m, p)])[F.col("measure")]
    q = lambda p: F.min(F.when(F.col("cum") >= p * F.col("n"), F.col("value")))
    some = F.when(F.col("bucket") != ZERO, F.col("n")).otherwise(0)
    ranked = sketch.select(*keys, "measure", F.sum("n").over(w.orderBy("bucket")).alias("cum"), F.sum("n").over(w).alias("n"), F.sum(some).over(w.orderBy("bucket")).alias("cum_some"), F.sum(some).over(w).alias("some"), value.alias("value"), level.alias("level"))
    typical = F.min(F.when((F.col("value") > 0) & (F.col("cum_some") >= 0.5 * F.col("some")), F.col("value")))
    return ranked.groupBy(*keys, "measure").agg(F.max("n").alias("n"), q(F.lit(0.5)).alias("mid"), q(F.col("level")).alias("high"), q(1 - F.col("level")).alias("low"), F.max("some").alias("some"), typical.alias("typical"))


_Q = ("mid", "high", "low")


def _blended(own: DataFrame, wider: DataFrame, on: list[str]) -> DataFrame:
    """``own`` with its quantiles drawn to those of the wider group, which count as ``PRIOR`` documents; the wider ones stay as w_*."""
    wide = wider.select(*[F.col(c).alias(f"__{c}") for c in on], *[F.col(q).alias(f"w_{q}") for q in (*_Q, "typical")])
    cond = F.lit(True)
    for c in on:
        cond = cond & own[c].eqNullSafe(wide[f"__{c}"])
    out = own.join(wide, cond)
    drawn = {q: (F.col("n") * F.col(q) + PRIOR * F.col(f"w_{q}")) / (F.col("n") + PRIOR) for q in _Q}
    drawn["typical"] = F.coalesce((F.col("some") * F.col("typical") + PRIOR * F.col("w_typical")) / (F.col("some") + PRIOR), "typical", "w_typical")
    return out.withColumns(drawn).drop(*[f"__{c}" for c in on])


def thresholds(scratch: Scratch, measured: DataFrame) -> DataFrame:
    """(lang, source, high_<measure> ..., low_mean_word) for each group of ``measured``, as a written table.

    Null is a language and a source of its own.
    """
    fine = scratch.table(sketches(measured, ["lang", "source"]))
    add = lambda keys: fine.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    every = quantiles(add([]), [])
    lang = _blended(quantiles(add(["lang"]), ["lang"]), every, ["measure"]).select("lang", "measure", *_Q, "typical")
    own = _blended(quantiles(fine, ["lang", "source"]), lang, ["lang", "measure"])
    spread = F.create_map(*[F.lit(x) for m, (_, k) in FENCES.items() for x in (m, k)])[F.col("measure")]
    # A group of copies has no spread of its own: a quarter of its language's is the least.
    high = F.col("mid") + spread * F.greatest(F.col("high") - F.col("mid"), (F.col("w_high") - F.col("w_mid")) / 4)
    high = F.greatest(high, F.coalesce(F.col("typical"), F.lit(0.0)) / 2)
    low = F.col("mid") - spread * F.greatest(F.col("mid") - F.col("low"), (F.col("w_mid") - F.col("w_low")) / 4)
    own = own.select("lang", "source", "measure", high.alias("high"), low.alias("low"))
    of = lambda m, c: F.max(F.when(F.col("measure") == m, F.col(c)))
    out = own.groupBy("lang", "source").agg(*[of(m, "high").alias(f"high_{m}") for m in FENCES], of("mean_word", "low").alias("low_mean_word"))
    return scratch.table(out, keep=True)


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` and ``kept``.

    A share of n parts counts as n less three standard errors of a count, a mean of words as its mean less (or and)
    three standard errors at a variation of a half, so that a few symbols in a short text do not condemn it.
    """
    out = join_small(measured, limits, ["lang", "source"])
    fine = ~F.col("base_failed")
    for m, (n, size) in COUNTED.items():
        sure = F.greatest(F.lit(0.0), F.col(n) - 3 * F.sqrt(F.col(n))) / F.greatest(F.col(size), F.lit(1))
        fine = fine & (sure <= F.col(f"high_{m}"))
    error = 1.5 * F.col("mean_word") / F.sqrt(F.greatest("n_words", F.lit(1)))
    fine = fine & (F.col("mean_word") - error <= F.col("high_mean_word")) & (F.col("mean_word") + error >= F.col("low_mean_word"))
    return out.withColumn("kept", fine)


def quality(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed, kept and the ratios, a row for each row of ``docs``.

    Null and empty texts have no words (and fail the base rules); very long texts are measured whole; a value at a
    limit is kept (ties do not reject); repeated rows are judged alike, each on its own; an empty table gives none;
    other columns are ignored.
    """
    with Scratch(spark) as s:
        src = docs.select("doc_id", "text", "lang", "source")
        m = with_measures(src).select("row.doc_id", "row.lang", "row.source", *BASE, "n_lines", *FENCES, "base_failed")
        m = s.table(m, keep=True)
        limits = thresholds(s, m)
    return judged(m, limits).select("doc_id", *BASE, "base_failed", "kept", *FENCES)


def filtered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in two narrow passes over the texts.

    Nulls, empty and very long texts, ties, repeated rows and empty tables as in ``quality``; columns of ``docs`` may
    have any names.
    """
    with Scratch(spark) as s:
        m = with_measures(docs.select("text", "lang", "source"))
        limits = thresholds(s, s.table(m.select("row.lang", "row.source", "base_failed", *FENCES)))
    measured = with_measures(docs).withColumns({"lang": F.col("row.lang"), "source": F.col("row.source")})
    return judged(measured, limits).where("kept").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document; nulls, long texts, ties and repeats as in ``quality``."""
    return quality(spark, read(spark, sf_dir, "documents")).select("doc_id", *BASE, "base_failed", "kept")


def _sql() -> str:
    """The same in SQL: base measures by words and lines, sketches by logarithmic buckets, limits, verdicts."""
    pick = lambda i: "CASE measure " + " ".join(f"WHEN '{m}' THEN {v[i]}" for m, v in FENCES.items()) + " END"
    value = f"CASE WHEN bucket = {ZERO} THEN 0 ELSE 2 * pow({_GAMMA!r}, bucket) / ({_GAMMA!r} + 1) END"
    quant = lambda src, keys: f"""SELECT {keys} measure, max(n) AS n, min(v) FILTER (WHERE cum >= 0.5 * n) AS mid, min(v) FILTER (WHERE cum >= lv * n) AS high, min(v) FILTER (WHERE cum >= (1 - lv) * n) AS low,
  max(n_some) AS n_some, min(v) FILTER (WHERE v > 0 AND cum_some >= 0.5 * n_some) AS typical
  FROM (SELECT {keys} measure, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY {keys} measure) AS n,
    coalesce(sum(n) FILTER (WHERE bucket <> {ZERO}) OVER (PARTITION BY {keys} measure ORDER BY bucket), 0) AS cum_some, coalesce(sum(n) FILTER (WHERE bucket <> {ZERO}) OVER (PARTITION BY {keys} measure), 0) AS n_some, {value} AS v, ({pick(0)})::DOUBLE AS lv FROM {src}) GROUP BY ALL"""  # noqa: E731
    blend = lambda a, b: ", ".join(f"({a}.n * {a}.{q} + {PRIOR} * {b}.{q}) / ({a}.n + {PRIOR}) AS {q}" for q in _Q) + f", coalesce(({a}.n_some * {a}.typical + {PRIOR} * {b}.typical) / ({a}.n_some + {PRIOR}), {a}.typical, {b}.typical) AS typical"
    sure = " AND ".join(f"greatest(0, {n} - 3 * sqrt({n})) / greatest({size}, 1) <= high_{m}" for m, (n, size) in COUNTED.items())
    limits = ", ".join(f"max(high) FILTER (WHERE measure = '{m}') AS high_{m}" for m in FENCES)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
again AS (SELECT r, unnest([i, i + 1, i + 2]) AS i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i) AS n FROM again GROUP BY r),
b AS (SELECT w.r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN rep USING (r)),
m AS (SELECT *, n_symbols / greatest(word_chars, 1) AS symbol_ratio, n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_repeat_words / greatest(n_words, 1) AS repeat_ratio, word_chars / greatest(n_words, 1) AS mean_word,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
u AS (SELECT lang, source, unnest([{', '.join(repr(m) for m in FENCES)}]) AS measure, unnest([{', '.join(FENCES)}]) AS v FROM m WHERE NOT base_failed),
fine AS (SELECT lang, source, measure, CASE WHEN v < {LEAST} THEN {ZERO} ELSE ceil(ln(v) / {math.log(_GAMMA)!r}) END AS bucket, count(*) AS n FROM u GROUP BY ALL),
ls AS (SELECT lang, measure, bucket, sum(n) AS n FROM fine GROUP BY ALL), es AS (SELECT measure, bucket, sum(n) AS n FROM fine GROUP BY ALL),
e AS ({quant('es', '')}), l0 AS ({quant('ls', 'lang,')}), s0 AS ({quant('fine', 'lang, source,')}),
lb AS (SELECT l0.lang, measure, {blend('l0', 'e')} FROM l0 JOIN e USING (measure)),
sb AS (SELECT s0.lang, s0.source, s0.measure, {blend('s0', 'lb')}, lb.mid AS w_mid, lb.high AS w_high, lb.low AS w_low FROM s0 JOIN lb ON s0.measure = lb.measure AND s0.lang IS NOT DISTINCT FROM lb.lang),
f AS (SELECT lang, source, measure, greatest(mid + ({pick(1)}) * greatest(high - mid, (w_high - w_mid) / 4), coalesce(typical, 0) / 2) AS high, mid - ({pick(1)}) * greatest(mid - low, (w_mid - w_low) / 4) AS low FROM sb),
t AS (SELECT lang, source, {limits}, max(low) FILTER (WHERE measure = 'mean_word') AS low_mean_word FROM f GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({sure}
  AND mean_word - 1.5 * mean_word / sqrt(greatest(n_words, 1)) <= high_mean_word AND mean_word + 1.5 * mean_word / sqrt(greatest(n_words, 1)) >= low_mean_word, FALSE) AS kept
FROM m LEFT JOIN t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""


OP10_SQL = _sql()
