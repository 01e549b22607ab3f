"""Mixing sources to target weights by Pareto order sampling.

A source's target of words is its weight's share of all words, at most ``most`` times its own size; what
exceeds that is shared again by weight until no target is above its limit. Every document of the source
gets the whole copies that the target holds for certain; the words left over come from one more copy of
some documents, a sample without replacement with unequal inclusion probabilities proportional to size
(probability 1 for those so long that they are certain). Pareto order sampling ranks documents by
``q = (u / (1 - u)) / (p / (1 - p))`` for a uniform u and takes the smallest q up to a fixed size; size
here is words, the cut that comes nearest to the words left over.

Whether a document is taken depends on its own q and on a few numbers of its source (probability factor,
whole copies, cut), so that nothing but narrow rows is shuffled, sums per (source, bucket of q) are
combined before they are, and only the rows of one bucket a source are put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch, join_small, n_words, read

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 20240229
#: Buckets of q / (1 + q), in which the cut of a source is first looked for.
BUCKETS = 16384


def _uniform(doc_id: Column, text: Column) -> Column:
    """In (0, 1), from the row alone: reruns agree, and repeated rows are taken together."""
    h = F.xxhash64(F.lit(SEED), doc_id, text)
    return (F.shiftrightunsigned(h, 12).cast("double") + 0.5) / float(2**52)


def _q(u: Column, size: Column, factor: Column) -> Column:
    """Pareto rank; null for what cannot be sampled."""
    p = F.least(F.lit(1.0), size * factor)
    return F.when(p > 0, (u / (1 - u)) * (1 - p) / p)


def source_targets(scratch: Scratch, sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target): a written table, a row per source.

    Sources by code point, null last, take the weights in turn.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # The rank of a source: its place in its range partition, plus the sources of the partitions before.
    ordered = scratch.table(sums.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = before.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    ranked = ordered.withColumn("part", part).join(before, "part")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit(2**33 - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    src = scratch.table(ranked.select("source", "source_size", weight.alias("weight")))
    limit = most * F.col("source_size")
    share, capped = 0.0, -1
    while True:  # each round is one sum over the sources; the capped ones only grow in number
        full = F.col("weight") * share >= limit if capped >= 0 else F.lit(False)
        total, taken, free, now = src.agg(F.sum("source_size"), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if now == capped or not free:
            break
        share, capped = max(0.0, (total or 0) - (taken or 0.0)) / free, now
    return src.select("source", "source_size", F.least(limit, F.col("weight") * share).alias("target"))


def plan(scratch: Scratch, sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, source_size, target, whole, factor, cut): what decides each document of a source. A written table.

    ``sized``: a written table of (source, size, u).
    """
    src = scratch.table(source_targets(scratch, sized, weights, most))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    src = scratch.table(src.select("*", whole.alias("whole"), F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size")).alias("left")))
    # The factor: documents of a size are certain from some size on; below it p = factor * size gives the rest.
    sizes = sized.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n"))
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum(F.col("size") * F.col("n")).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above")
    squares = F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).over(Window.partitionBy("source").orderBy("size")).alias("squares")
    h = sizes.select("source", "size", above, squares)
    h = join_small(h, src.select("source", "left"), ["source"])
    # Cut at this size: all longer ones certain, this and shorter ones in proportion; the longest fitting size is right.
    factor = F.max_by(F.when(F.col("left") > F.col("above"), (F.col("left") - F.col("above")) / F.col("squares")), F.when((F.col("left") > F.col("above")) & ((F.col("left") - F.col("above")) / F.col("squares") * F.col("size") <= 1.0), F.col("size")))
    factors = scratch.table(h.groupBy("source").agg(factor.alias("factor")))
    src = scratch.table(join_small(src, factors, ["source"]).withColumn("factor", F.coalesce("factor", F.lit(0.0))))
    rows = join_small(sized.where("size > 0"), src.select("source", "left", "factor"), ["source"])
    rows = rows.withColumn("q", _q(F.col("u"), F.col("size"), F.col("factor"))).where("q is not null")
    bucket = F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).alias("bucket")
    rows = rows.select("source", "left", "q", "size", bucket)
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    w = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("words").over(w))
    sums = join_small(sums, src.select("source", "left"), ["source"])
    at = scratch.table(sums.where((F.col("upto") - F.col("words") < F.col("left")) & (F.col("upto") >= F.col("left"))).select("source", "bucket", (F.col("upto") - F.col("words")).alias("before")))
    inner = join_small(rows, at, ["source", "bucket"], "inner").groupBy("source", "left", "before", "q").agg(F.sum("size").alias("size"))
    w = Window.partitionBy("source").orderBy("q")
    inner = inner.withColumn("upto", F.col("before") + F.sum("size").over(w))
    ok = inner.where(F.abs(F.col("upto") - F.col("left")) <= F.abs(F.col("upto") - F.col("size") - F.col("left")))
    cut_q = ok.groupBy("source").agg(F.max("q").alias("cut"))
    # Else the cut lies below the first row of the bucket, or (sums under what is left) above all rows.
    base = scratch.table(at.select("source", (F.col("bucket") / float(BUCKETS)).alias("low")))
    out = join_small(src, scratch.table(cut_q), ["source"])
    out = join_small(out, base, ["source"])
    below = F.when(F.col("low") < 1, F.col("low") / (1 - F.col("low")) - 1e-15).otherwise(F.lit(float("inf")))
    cut = F.when(F.col("left") <= 0, F.lit(-1.0)).when(F.col("low").isNull(), F.lit(float("inf"))).otherwise(F.coalesce("cut", below))
    return scratch.table(out.select("source", "source_size", "target", "whole", "factor", cut.alias("cut")), keep=True)


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _uniform(F.col("doc_id"), F.col("text")).alias("u"))


def _copies(size: Column, u: Column) -> Column:
    q = _q(u, size, F.col("factor"))
    return (F.col("whole") + F.when(q <= F.col("cut"), 1).otherwise(0)).cast("int")


def mixed(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies), a row for each row of ``docs``.

    Null texts and texts of white space have size 0 and take 0 words; null is a source of its own, the
    last one; very long texts count whole; rows that tie in rank, as rows repeated in full do, are taken together; an
    empty table gives none; other columns are ignored, whatever their names.
    """
    with Scratch(spark) as s:
        sized = s.table(_sized(docs), keep=True)
        p = plan(s, sized, weights, most)
    out = join_small(sized, p, ["source"])
    copies = _copies(F.col("size"), F.col("u"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))


def repeated(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (documents without words, and null texts, never).

    Long texts, ties, repeated rows and empty tables as in ``mixed``; columns may have any names.
    """
    with Scratch(spark) as s:
        p = plan(s, s.table(_sized(docs)), weights, most)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = row.select("row", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"), _uniform(F.col("row.doc_id"), F.col("row.text")).alias("u"))
    out = join_small(row, p, ["source"]).where("size > 0")
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), _copies(F.col("size"), F.col("u"))))).select("row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; nulls, long texts, ties and repeats as in ``mixed``."""
    return mixed(spark, read(spark, sf_dir, "documents"))
