"""How five filters interact: what each removes in every order, and its exact Shapley value.

A document's failures are five bits. What a set of filters (a coalition) removes are the documents that fail one of it,
so that the counts of all 32 coalitions say everything: a filter's step in an order removes the coalition of what came
before and itself, less the coalition of what came before.

A filter's Shapley value comes from the same 32 numbers by constrained least squares: values whose sums over coalitions
are nearest to what coalitions remove, under the Shapley kernel's weights, and which add up to what all five remove. The
normal equations are solved in rationals for each coalition's unit game, once, which gives whole weights for the sum over
all orders; a part's values are these weights times its counts.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import WORD, Scratch, read

FILTERS = "ABCDE"
ALL = 2 ** len(FILTERS) - 1


def solved(matrix: list[list[Fraction]], right: list[list[Fraction]]) -> list[list[Fraction]]:
    """The solutions of a regular system for several right sides, by elimination in rationals."""
    n = len(matrix)
    rows = [[*a, *b] for a, b in zip(matrix, right, strict=True)]
    for i in range(n):
        pivot = next(r for r in range(i, n) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        for r in range(n):
            if r != i and rows[r][i]:
                f = rows[r][i]
                rows[r] = [a - f * b for a, b in zip(rows[r], rows[i], strict=True)]
    return [r[n:] for r in rows]


def shapley_weights(n: int = len(FILTERS)) -> list[list[int]]:
    """weights[filter][coalition]: a filter's values over all orders are their sum over what coalitions remove.

    Least squares over proper coalitions S, each weighed (n - 1) / (C(n, |S|) |S| (n - |S|)), under the constraint that values
    add up to the whole, by its normal equations with a Lagrange multiplier.
    """
    proper = range(1, 2**n - 1)
    kernel = {s: Fraction(n - 1, comb(n, k) * k * (n - k)) for s in proper if (k := s.bit_count())}
    has = lambda s, i: s >> i & 1
    matrix = [[sum((w for s, w in kernel.items() if has(s, i) and has(s, j)), Fraction(0)) for j in range(n)] + [Fraction(1)] for i in range(n)]
    matrix.append([Fraction(1)] * n + [Fraction(0)])
    right = [[kernel.get(s, Fraction(0)) * has(s, i) for s in range(2**n)] for i in range(n)]
    right.append([Fraction(int(s == 2**n - 1)) for s in range(2**n)])
    found = [[v * factorial(n) for v in row] for row in solved(matrix, right)[:n]]
    assert all(v.denominator == 1 for row in found for v in row)
    return [[int(v) for v in row] for row in found]


def failures(text: Column) -> Column:
    """The bits of the first four filters that a text fails; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(t, F.lit("[A-Z]")) > 3 * F.char_length(t), t.rlike("[#$%&*|]")]
    bits = F.lit(0)
    for i, f in enumerate(fails):
        bits = bits + F.when(f, 1 << i).otherwise(0)
    return bits


def masks(s: Scratch, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): how many documents of a part fail just these filters, as a written table.

    Equal texts are told by SHA-256. Their smallest ids are written, as is what they are joined to: both sides of the join are
    plain shuffles, so that a very frequent text is split over tasks.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("h"), failures(F.col("text")).alias("bits"))
    d = s.table(d)
    first = s.table(d.groupBy("h").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "first"))
    e = F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    d = d.join(first, "h", "left").select("doc_id", "part", (F.col("bits") + e).alias("mask"))
    of = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    d = d.join(of, "doc_id", "left")
    return s.table(d.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")]))


def coalitions(counted: DataFrame) -> DataFrame:
    """(part, total, removed, good, toxic): arrays by coalition, of 32 numbers each."""
    each = counted.select("*", F.explode(F.sequence(F.lit(0), F.lit(ALL))).alias("s"))
    met = F.col("mask").bitwiseAND(F.col("s")) != 0
    sums = each.groupBy("part", "s").agg(F.sum("n").alias("total"), *[F.sum(F.when(met, F.col(c)).otherwise(0)).alias(a) for c, a in (("n", "removed"), ("good", "good"), ("toxic", "toxic"))])
    rows = F.array_sort(F.collect_list(F.struct("s", "removed", "good", "toxic")))
    listed = sums.groupBy("part").agg(F.first("total").alias("total"), rows.alias("r"))
    array = lambda c: F.transform("r", lambda x: x[c]).alias(c)
    return listed.select("part", "total", *map(array, ("removed", "good", "toxic")))


def audited(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): 600 rows a part.

    Null texts are empty, null languages the part of the empty string; a null doc_id is smaller than none and copies nothing;
    rows that repeat, or share a doc_id, are documents of their own, and as their ids tie none is the other's copy; a document
    is good or toxic if one of its labels says so; very long texts are read whole; an empty table gives none; other columns
    are ignored, whatever their names.
    """
    bits = lambda own: sum(1 << FILTERS.index(f) for f in own)
    steps = [{"filter_order": "".join(o), "step": k + 1, "filter": FILTERS.index(f), "own": bits(f), "before": bits(o[:k]), "after": bits(o[: k + 1])} for o in permutations(FILTERS) for k, f in enumerate(o)]
    each = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order: string, step: int, filter: int, own: int, before: int, after: int>>")
    with Scratch(spark) as s:
        tables = s.table(coalitions(masks(s, docs, labels)), keep=True)
    weights = F.array(*[F.array(*[F.lit(w).cast("long") for w in row]) for row in shapley_weights()])
    values = F.transform(weights, lambda row: F.aggregate(F.zip_with(row, "removed", lambda w, v: w * v), F.lit(0).cast("long"), lambda a, x: a + x))
    d = tables.withColumn("shapleys", values).select("*", F.explode(each).alias("t"))
    own, after = F.col("t.own"), F.col("t.after")
    step = lambda c: F.get(c, after) - F.get(c, F.col("t.before"))
    return d.select(
        "part",
        "t.filter_order",
        "t.step",
        (F.col("total") - F.get("removed", after)).alias("kept"),
        step("removed").alias("removed"),
        (F.get("removed", own) - step("removed")).alias("redundant"),
        (F.get("removed", F.lit(ALL)) - F.get("removed", F.lit(ALL) - own)).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.get("shapleys", F.col("t.filter")).alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents; nulls, long texts, ties and repeats as in ``audited``."""
    return audited(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT *, min(doc_id) OVER (PARTITION BY text) AS first, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS caps FROM d),
m AS (SELECT part, (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT + 4 * (100 * caps > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > first, FALSE)::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM e LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits FROM f a, f b, f c, f d, f e WHERE a.b + b.b + c.b + d.b + e.b = 31 AND a.b | b.b | c.b | d.b | e.b = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (WHERE mask & (before | own) = 0) AS kept, sum(n) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS removed,
  sum(n) FILTER (WHERE mask & before <> 0 AND mask & own <> 0) AS redundant, sum(n) FILTER (WHERE mask = own) AS unique_fails,
  sum(good) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS good_lost, sum(toxic) FILTER (WHERE mask & before = 0 AND mask & own <> 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM r
"""
