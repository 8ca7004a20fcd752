"""Mixing sources to target weights by systematic sampling.

Target words per source follow from weights, a share of all words and a cap; the excess of capped sources goes
to the others by weight. Within a source the documents stand in a fixed order; each has the same expected number of
copies, target / source size. One offset, drawn once from the seed, is added to the running sum, and a document is
taken once for each integer that its step of the sum crosses. The order keeps the taken words near the target
whatever the offset: ranked by size, the odd ranks come first, longest first, then the even ranks, shortest
first. Neighbours are of like size, and what an early or late offset gains on the way down it loses on the way up.

Defined cases: null text has size 0; a null source is a source of its own, ranked last; a source without words
has target 0 and takes nothing; very long texts are counted whole; null doc_ids rank first among documents of their
size, by the text's hash; documents that tie in size stand by doc_id; repeated rows stand next to each other and take copies like any
others; an empty table gives an empty mix; extra columns are ignored by `mix` and kept by `mixed`.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, cut, fresh, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
SEED = 0
#: Parts into which documents of one source and one size are dealt, so that no group of copies lands in one task.
SALT = 1024


def offset(seed: int) -> float:
    return round(random.Random(seed).random(), 9)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: a row per source (source, source_size). Adds target; works on that small table only.

    Sources are filled in the order of cap over weight. While the level that the rest would share covers a
    source's cap, the source is full; the level rises until the first that is not full, so the largest level holds.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(rank) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    full = F.col("source_size") * F.lit(float(cap))
    by = Window.orderBy(full / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    return (
        sizes.withColumn("w", w)
        .withColumn("level", (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(full).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("target", F.least(full, F.max("level").over(everything) * F.col("w")))
        .drop("w", "level")
    )


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken (words) for every row of docs; `more` names columns to carry."""
    salt = F.coalesce(F.pmod(F.col("doc_id"), F.lit(SALT)), -1 - F.pmod(F.xxhash64("text"), F.lit(SALT))).cast("int")
    slim = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), salt.alias("salt"), *more))
    cells = cut(slim.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents")), weights, share, cap)
    steps = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy(F.desc("size"))) - F.col("n")
    steps = steps.select("source", "size", before.alias("before_size"))
    inner = F.sum("n").over(Window.partitionBy("source", "size").orderBy("salt")) - F.col("n")

    def same(a: DataFrame, b: DataFrame, *keys: str):
        b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
        return a.join(b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])

    starts = cells.select("source", "size", "salt", inner.alias("before_salt"))
    starts = same(same(starts, steps, "source", "size"), goals, "source")
    ranked = slim.withColumn("nth", F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("doc_id", *more)))
    u, rate = F.lit(offset(seed)), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("before_size") + F.col("before_salt") + F.col("nth")
    at = F.when(rank % 2 == 1, F.floor((rank + 1) / 2)).otherwise(F.col("documents") - F.floor(rank / 2) + 1)
    crossed = F.floor(at * rate + u) - F.floor((at - 1) * rate + u)
    return (
        same(ranked, starts, "source", "size", "salt")
        .withColumn("copies", F.least(crossed, F.ceil(rate)).cast("long"))
        .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken, with the columns of docs.

    A row is known by its doc_id, source and text (as a hash); of rows that have all three in common, as many are taken as
    the mix takes of them together, evenly."""
    mark, name = fresh(docs, "mark"), fresh(docs, "name")
    own = F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text"), F.col("doc_id").isNull(), F.col("source").isNull(), F.col("text").isNull())
    marked = docs.select("doc_id", "source", "text", own.alias(mark))
    counts = mix(marked, more=(mark,), **how).groupBy(F.col(mark).alias(name)).agg(F.sum("copies").alias("copies"), F.count("*").alias("of")).filter("copies > 0")
    counts = counts.select(name, F.col("copies").alias(fresh(docs, "copies")), F.col("of").alias(fresh(docs, "of")))
    copies, of = F.col(fresh(docs, "copies")), F.col(fresh(docs, "of"))
    rows = docs.withColumn(mark, own).join(counts, F.col(mark) == F.col(name))
    alone = rows.filter(of == 1).withColumn(name, copies)
    # Of several equal rows each takes the whole part of copies / rows, and the first ones in any order take one more: they are equal but for columns that the mix does not look at.
    turn = F.row_number().over(Window.partitionBy(mark).orderBy(F.to_json(F.struct(*[c for c in columns(docs)]))))
    several = rows.filter(of > 1).withColumn(name, F.floor((copies + of - turn) / of))
    every = alone.unionByName(several).filter(F.col(name) > 0)
    return every.withColumn(name, F.explode(F.sequence(F.lit(1), F.col(name).cast("int")))).select(*columns(docs))
