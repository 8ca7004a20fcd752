"""The event feed: optional filters, newest first, coverage counts. Absent filters constrain nothing; unmeasured
values are their own bucket and never count as zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.session import cut, small


def latest(events: DataFrame, limit: int = 50, event_type: str | None = None, after=None, before=None, min_reliability: int | None = None) -> DataFrame:
    """The newest events that pass all given filters; bounds are inclusive, ties go to the larger id."""
    if not 1 <= limit <= 500:
        raise ValueError("limit is between 1 and 500")
    if event_type:
        events = events.filter(F.col("event_type") == event_type)
    if after:
        events = events.filter(F.col("ts") >= F.lit(after).cast("timestamp"))
    if before:
        events = events.filter(F.col("ts") <= F.lit(before).cast("timestamp"))
    if min_reliability:
        events = events.filter(F.col("reliability") >= min_reliability)
    return events.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def merged_top(a: DataFrame, b: DataFrame, limit: int = 200) -> DataFrame:
    """The newest rows of two feeds together, each id once."""
    return a.unionByName(b).dropDuplicates(["id"]).orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def by_id(events: DataFrame, event_id: int) -> DataFrame:
    return events.filter(F.col("id") == event_id)


def time_range(events: DataFrame) -> DataFrame:
    return events.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def location_stats(events: DataFrame) -> DataFrame:
    """Events with and without a position, and the located share (null without events)."""
    located = F.count_if(F.col("lat").isNotNull())
    return events.agg(F.count("*").alias("total"), located.alias("located"), (F.count("*") - located).alias("unlocated"), F.try_divide(located, F.count("*")).alias("ratio"))


def counts(events: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Rows per value; null is a bucket, shown as 'null'."""
    return events.groupBy(F.coalesce(value.cast("string"), F.lit("null")).alias(name)).agg(F.count("*").alias("n"))


def severity_trend(events: DataFrame, key: str, span: int = 20) -> DataFrame:
    """Mean severity over the last `span` events of each key, with its band.

    Keys may be few and large, so windows run over ranges of (ts, id), whatever the key: each range also gets the last span - 1 events of every
    key before it. Those come from the ranges' own last ones, a slim table of span - 1 rows per range and key."""
    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = cut(events.select(key, "id", "ts", "severity").repartitionByRange(parts, "ts", "id").withColumn("part", F.spark_partition_id()))
    last = Window.partitionBy("part", key).orderBy(F.desc("ts"), F.desc("id"))
    ends = cut(slim.withColumn("n", F.row_number().over(last)).filter(F.col("n") < span).drop("n"))
    # For each key and range: the newest span - 1 of the ends of all ranges before. A range that has enough of its own ends the search.
    held = ends.groupBy(key, "part").agg(F.count("*").alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = held.withColumn("before", before)  # a row per range and key
    place = ends.withColumn("n", F.row_number().over(Window.partitionBy("part", key).orderBy("ts", "id"))).join(totals, [key, "part"]).select(key, "id", "ts", "severity", (F.col("before") + F.col("n")).alias("nth"), F.col("part").alias("from"))
    wanted = totals.filter("before > 0").select(key, "part", F.explode(F.sequence(F.greatest(F.col("before") - (span - 2), F.lit(1)), F.col("before"))).alias("nth"))
    carried = place.join(wanted, [key, "nth"]).select(key, "id", "ts", "severity", "part", F.lit(False).alias("own"))
    mean = F.avg("severity").over(Window.partitionBy("part", key).orderBy("ts", "id").rowsBetween(1 - span, 0))
    band = F.when(F.col("trend").isNull(), F.lit("UNMEASURED")).when(F.col("trend") <= 3, "LOW").when(F.col("trend") <= 6, "ELEVATED").when(F.col("trend") <= 8, "HIGH").otherwise("CRITICAL")
    rows = slim.withColumn("own", F.lit(True)).unionByName(carried).withColumn("trend", F.round(mean, 6)).filter("own")
    return rows.select(key, "id", "trend").withColumn("band", band)


def currency(feeds: DataFrame, now: Column, fresh_s: int = 300, stale_s: int = 900) -> DataFrame:
    """feeds: name, last_ts (null: never reported). Fresh, stale and silent feeds, the worst age, and a state."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_ts")
    n = feeds.select(age.alias("age")).agg(F.count("*").alias("feeds"), F.count_if(F.col("age") <= fresh_s).alias("fresh"), F.count_if(F.col("age") > stale_s).alias("stale"), F.count_if(F.col("age").isNull()).alias("silent"), F.max("age").alias("worst_age"))
    return n.withColumn("state", F.when(F.col("silent") == F.col("feeds"), "silent").when((F.col("stale") > 0) | (F.col("silent") > 0), "partial").otherwise("current"))


def arrivals(polls: DataFrame) -> DataFrame:
    """polls: feed, ts, id, payload (null: the poll failed). For each feed how many polls there were, how many failed, the newest good one and
    when a payload last came that differs from the good one before it (null: never; the first one is no arrival).

    By sums and extremes alone, so a feed of a third of all polls is no task's: what differs from the newest payload ends
    with some poll, and the first good poll after that is the arrival."""
    slim = polls.filter("feed is not null and ts is not null and id is not null").select("feed", F.struct("ts", "id").alias("at"), F.when(F.col("payload").isNotNull(), F.xxhash64("payload")).alias("hash"))
    good = slim.filter("hash is not null")
    all_ = slim.groupBy("feed").agg(F.count("*").alias("polls"), F.count_if(F.col("hash").isNull()).alias("failed"), F.max(F.when(F.col("hash").isNotNull(), F.col("at"))).alias("last"), F.max_by("hash", F.when(F.col("hash").isNotNull(), F.col("at"))).alias("held"))
    other = good.join(small(all_.select("feed", "held")), "feed").filter("hash <> held").groupBy("feed").agg(F.max("at").alias("other"))
    arrived = good.join(small(other), "feed").filter("at > other").groupBy("feed").agg(F.min("at.ts").alias("arrived_at"))
    return all_.join(arrived, "feed", "left").select("feed", "polls", "failed", F.col("last.ts").alias("last_ts"), "arrived_at")


def ages(arrived: DataFrame, now: Column) -> DataFrame:
    """arrived with the age of the last arrival in seconds and whether a poll was missed since; both null where nothing came."""
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.FEED_STALE_S.items() for x in kv]), F.col("feed")), F.lit(V.FEED_STALE_S["stream"]))
    age = (F.unix_micros(now) - F.unix_micros(F.col("arrived_at").cast("timestamp"))) / 1_000_000
    return arrived.withColumn("age_s", age).withColumn("stale", age > limit)
