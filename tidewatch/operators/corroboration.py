"""What a second source says of the watched places, poll by poll, and what it says of all others.

annotated: rows of `sources.feeds.annotations` with the column poll. polls: poll, good (whether that call succeeded).
A call that failed does not overwrite what an earlier one said: its poll shows the last good one's annotations as stale. Before
any call has succeeded nothing is available, which is not the same as no outage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Annotations listed for a place, and others listed, in a poll.
LISTED, OTHERS = 5, 10


def last_good(polls: DataFrame) -> DataFrame:
    """polls with as_of, the last good poll up to each, and stale. A poll is one row here, however much it brought."""
    by = Window.partitionBy(F.lit(0)).orderBy("poll")
    return polls.select("poll", "good", F.max(F.when(F.col("good"), F.col("poll"))).over(by).alias("as_of")).withColumn("stale", F.col("as_of").isNotNull() & ~F.col("good"))


def _newest() -> list[Column]:
    """Ongoing first, then the latest start; without a start, last."""
    return [F.desc("ongoing"), F.desc(F.coalesce("start", F.lit(""))), F.col("id")]


def corroborated(polls: DataFrame, annotated: DataFrame, watched: list[str], listed: int = LISTED) -> DataFrame:
    """A row per poll and watched code: available, stale, as_of, ongoing, outages (how many), newest (ids, `listed` at most).

    Counts are summed before they are shuffled, and the list is cut by rank before it is: a code that draws a third of all
    annotations is no task's."""
    hits = annotated.select("poll", "id", "ongoing", "start", F.explode(F.array_distinct("locations")).alias("code")).filter(F.col("code").isin(watched))
    n = hits.groupBy("poll", "code").agg(F.bool_or("ongoing").alias("ongoing"), F.count("*").alias("outages"))
    top = hits.withColumn("_i", F.row_number().over(Window.partitionBy("poll", "code").orderBy(*_newest()))).filter(F.col("_i") <= listed)
    top = top.groupBy("poll", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "id"))), lambda x: x["id"]).alias("newest"))
    said = n.join(top, ["poll", "code"]).withColumnRenamed("poll", "as_of")
    asked = last_good(polls).withColumn("code", F.explode(F.array(*[F.lit(c) for c in watched])))
    known = F.col("as_of").isNotNull()
    return asked.join(said, ["as_of", "code"], "left").select(
        "poll", "code", known.alias("available"), "stale", "as_of", F.when(known, F.coalesce("ongoing", F.lit(False))).alias("ongoing"), F.when(known, F.coalesce("outages", F.lit(0))).alias("outages"), F.coalesce("newest", F.array().cast("array<string>")).alias("newest")
    )


def discovered(annotated: DataFrame, watched: list[str], limit: int = OTHERS) -> DataFrame:
    """Per poll the newest `limit` annotations that name places, none of them watched, by place."""
    others = annotated.filter((F.size("locations") > 0) & ~F.arrays_overlap("locations", F.array(*[F.lit(c) for c in watched])).eqNullSafe(True))
    return others.withColumn("place", F.row_number().over(Window.partitionBy("poll").orderBy(*_newest()))).filter(F.col("place") <= limit)
