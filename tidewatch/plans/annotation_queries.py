"""Outage annotations and attack targets in payloads that events are written to, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import corroboration
from tidewatch.plans import substrate as S
from tidewatch.plans.substrate import EV
from tidewatch.sources import feeds

WATCHED = [f"c{i}" for i in range(5)]


def payloads(s, d):
    """An event is one annotation of its day's poll; the call fails on every third day, the first one too, and brings nothing."""
    codes = F.when(F.col("k") % 11 == 0, F.array().cast("array<string>")).when(F.col("k") % 4 == 0, F.array(F.concat(F.lit("c"), F.col("user_id") % 20), F.concat(F.lit("c"), F.col("user_id") % 13))).otherwise(F.array(F.concat(F.lit("c"), F.col("user_id") % 20)))
    start = F.when(F.col("k") % 9 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    one = F.struct(F.concat(F.lit("a"), "id").alias("id"), codes.alias("locations"), start.alias("startDate"), F.when(F.col("k") % 3 != 0, F.lit("over")).alias("endDate"))
    good = F.day("ts") % 3 != 1
    return S.events(s, d).select(F.to_date("ts").cast("string").alias("poll"), good.alias("good"), F.when(good, F.to_json(F.struct(F.array(one).alias("annotations")))).alias("json"))


def polls(s, d):
    return payloads(s, d).groupBy("poll").agg(F.bool_or("good").alias("good"))


def annotated(s, d):
    return feeds.annotations(payloads(s, d), "poll")


def targets(s, d):
    """The traffic of a user as the share of a place; some payloads name none, some give no share."""
    one = F.struct(F.concat(F.lit("c"), F.col("user_id") % 20).alias("targetCountryAlpha2"), F.when(F.col("k") % 7 != 0, (F.col("k") * 0.5).cast("string")).alias("value"), (F.col("k") % 5 + 1).alias("rank"))
    top = F.when(F.col("k") % 6 == 0, F.array()).otherwise(F.array(one))
    json = F.to_json(F.struct(F.struct(F.lit("percentage").alias("units")).alias("meta"), top.alias("top_0")))
    return feeds.attack_targets(S.events(s, d).select("id", json.alias("json")), "id").select("id", "code", "share", "rank", "units")


ANN = f"""{EV}, an AS (SELECT 'a' || id AS id, CAST(CAST(ts AS DATE) AS VARCHAR) AS poll, day(ts) % 3 <> 1 AS good, k % 3 = 0 AS ongoing, CASE WHEN k % 9 <> 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS start,
  CASE WHEN k % 11 = 0 THEN [] WHEN k % 4 = 0 THEN list_distinct(['c' || (user_id % 20), 'c' || (user_id % 13)]) ELSE ['c' || (user_id % 20)] END AS locations FROM ev)"""
WATCH = "['c0', 'c1', 'c2', 'c3', 'c4']"

ENTRIES = {
    "outage_corroboration": (
        lambda s, d: corroboration.corroborated(polls(s, d), annotated(s, d), WATCHED).withColumn("newest", F.array_join("newest", ",")),
        f"""WITH {ANN}, po AS (SELECT poll, good, max(CASE WHEN good THEN poll END) OVER (ORDER BY poll ROWS UNBOUNDED PRECEDING) AS as_of FROM (SELECT poll, bool_or(good) AS good FROM an GROUP BY poll)),
h AS (SELECT id, poll, ongoing, start, unnest(locations) AS code FROM an WHERE good), r AS (SELECT *, row_number() OVER (PARTITION BY poll, code ORDER BY ongoing DESC, coalesce(start, '') DESC, id) AS i FROM h),
n AS (SELECT poll, code, bool_or(ongoing) AS ongoing, count(*) AS outages, string_agg(id, ',' ORDER BY i) FILTER (i <= 5) AS newest FROM r GROUP BY ALL), w AS (SELECT poll, good, as_of, unnest({WATCH}) AS code FROM po)
SELECT w.poll, w.code, as_of IS NOT NULL AS available, as_of IS NOT NULL AND NOT good AS stale, as_of, CASE WHEN as_of IS NOT NULL THEN coalesce(ongoing, false) END AS ongoing, CASE WHEN as_of IS NOT NULL THEN coalesce(outages, 0) END AS outages, coalesce(newest, '') AS newest
FROM w LEFT JOIN n ON n.poll = w.as_of AND n.code = w.code""",
    ),
    "outage_discovery": (
        lambda s, d: corroboration.discovered(annotated(s, d), WATCHED).select("poll", "place", "id", "ongoing", "start", F.array_join("locations", ",").alias("locations")),
        f"""WITH {ANN}, o AS (SELECT * FROM an WHERE good AND len(locations) > 0 AND NOT list_has_any(locations, {WATCH})), r AS (SELECT *, row_number() OVER (PARTITION BY poll ORDER BY ongoing DESC, coalesce(start, '') DESC, id) AS place FROM o)
SELECT poll, place, o2.id, ongoing, start, CASE WHEN k % 4 = 0 THEN 'c' || (user_id % 20) || ',c' || (user_id % 13) ELSE 'c' || (user_id % 20) END AS locations FROM r o2 JOIN ev ON 'a' || ev.id = o2.id WHERE place <= 10""",
    ),
    "attack_targets": (
        targets,
        f"WITH {EV} SELECT id, 'c' || (user_id % 20) AS code, CASE WHEN k % 7 <> 0 THEN k * 0.5::DOUBLE END AS share, k % 5 + 1 AS rank, 'percentage' AS units FROM ev WHERE k % 6 <> 0",
    ),
}
