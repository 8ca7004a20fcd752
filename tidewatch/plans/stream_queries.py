"""Streams over the events table, run to the end of what is there, read back from their sinks."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.operators import feed
from tidewatch.plans import substrate as S
from tidewatch.session import shared_dir
from tidewatch.streaming import pipelines


def run(spark: SparkSession, sf_dir: str, make: Callable[[DataFrame], DataFrame], steps: int = 4, again_s: int = 0, replay: bool = False, mode: str = "append", reports: list | None = None) -> DataFrame:
    """What a stream over the events gives when they arrive in so many steps in order of time, with a stop and a restart from the
    checkpoint after each. again_s: each later step also brings the events of that many seconds before it once more. replay: everything
    arrives once more at the end. reports: gets what the batches report. In update mode rows have the `epoch` that made them."""
    base = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    events = S.read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    us = F.unix_micros("ts")
    cuts = events.agg(F.percentile_approx(us, [i / steps for i in range(1, steps)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    after = lambda lo, s: F.lit(True) if lo is None else us > lo - s * 1_000_000
    part = lambda lo, hi, s: events.filter(after(lo, s) & (F.lit(True) if hi is None else us <= hi))
    parts = [part(lo, hi, 0) if lo is None or not again_s else part(lo, hi, 0).unionByName(part(lo, lo, again_s)) for lo, hi in zip(bounds, bounds[1:])]
    stream = None

    def body(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    for part_ in parts + [events] * replay:
        part_.write.mode("append").parquet(f"{base}/in")
        stream = stream or make(spark.readStream.schema(events.schema).parquet(f"{base}/in"))
        said = pipelines.run_available(stream, f"{base}/out", f"{base}/checkpoint", None if mode == "append" else body, mode)
        if reports is not None:
            reports += said
    out = spark.read.option("basePath", f"{base}/out")
    return out.schema(stream.schema).parquet(f"{base}/out") if mode == "append" else out.schema(stream.schema.add("epoch", "long")).parquet(f"{base}/out")


#: Seconds of events that come twice: within the delay that the guard waits for.
AGAIN_S = 1_500


def stream_dedup(spark, d, reports: list | None = None):
    """Events come twice within the guard's delay, in the next step, where the guard's state finds them; what comes again when all is over is late."""
    return run(spark, d, lambda events: pipelines.guarded(events, ["event_id"]).select("event_id", "user_id", "event_type"), again_s=AGAIN_S, replay=True, reports=reports)


def vessel_messages(events: DataFrame) -> DataFrame:
    """Events as vessel messages: every third is a static one."""
    k = F.get_json_object("props", "$.k").cast("int")
    return events.select(
        F.col("user_id").cast("string").alias("mmsi"), F.when(k % 3 == 0, "ShipStaticData").otherwise("PositionReport").alias("msg_type"), F.when(k % 5 > 0, F.concat(F.lit("S"), k.cast("string"))).otherwise("").alias("ship_name"), "ts", F.col("event_id").alias("id"),
        (29 + k / 100.0).alias("lat"), (45 + (F.col("user_id") % 90) / 10.0).alias("lon"), F.col("value").alias("sog"), F.when(k % 4 > 0, k.cast("double")).alias("true_heading"), k.cast("double").alias("cog"), (k % 8).alias("nav_status"),
        k.alias("type"), F.when(k % 2 == 0, F.concat(F.lit("P"), k.cast("string"))).alias("destination"), k.alias("dim_a"), F.lit(5).alias("dim_b"),
    )


def stream_vessels(spark, d, reports: list | None = None):
    """Vessels that are there at the end: the newest state of each, unless it ended or its last position is too old."""
    states = run(spark, d, lambda events: pipelines.vessels(vessel_messages(events), ttl_s=TTL_S), mode="update", reports=reports)
    newest = states.groupBy("mmsi").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("mmsi", "epoch")]), F.struct("epoch", ~F.col("expired"))).alias("r")).select("mmsi", "r.*")
    end = F.broadcast(S.read(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("end")))  # one row
    live = newest.join(end).filter(f"not expired and lat is not null and unix_micros(end) - unix_micros(seen) <= {TTL_S * 1_000_000}")
    return live.select("mmsi", F.unix_micros("last_ts").alias("last_us"), "lat", "lon", "sog", "true_heading", "nav_status", "type", "destination", "length", "name")


def points(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.filter(k % 5 != 0).select(F.col("user_id").alias("entity"), "ts", F.col("event_id").alias("id"), F.floor(k / 50).cast("double").alias("lat"), F.floor(F.col("value") / 400).cast("double").alias("lon"))


#: Tracks of the events table go on for a day: its users are seen every few hours.
TTL_S = 86_400


def stream_tracks(spark, d):
    return run(spark, d, lambda events: pipelines.tracked(points(events), ttl_s=TTL_S))


TRACKS_SQL = f"""WITH RECURSIVE p AS (SELECT user_id AS entity, ts, event_id AS id, CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 50) AS DOUBLE) AS lat, floor(value / 400) AS lon,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE CAST(json_extract_string(props, '$.k') AS INT) % 5 <> 0),
t AS (SELECT entity, n, ts, id, lat, lon, ts AS last, lat AS a, lon AS b, true AS kept FROM p WHERE n = 1
  UNION ALL SELECT p.entity, p.n, p.ts, p.id, p.lat, p.lon, CASE WHEN k THEN p.ts ELSE t.last END, CASE WHEN k THEN p.lat ELSE t.a END, CASE WHEN k THEN p.lon ELSE t.b END, k
  FROM t JOIN p ON p.entity = t.entity AND p.n = t.n + 1, LATERAL (SELECT p.lat <> t.a OR p.lon <> t.b OR epoch_us(p.ts) - epoch_us(t.last) > {TTL_S * 1_000_000} AS k))
SELECT entity, ts, id, lat, lon FROM t WHERE kept"""

VESSELS_SQL = f"""WITH RECURSIVE e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
t AS (SELECT user_id, n, 0 AS s, ts AS seen, k % 3 <> 0 AS placed FROM e WHERE n = 1
  UNION ALL SELECT e.user_id, e.n, t.s + CAST(x AS INT), CASE WHEN e.k % 3 <> 0 OR x OR NOT t.placed THEN e.ts ELSE t.seen END, e.k % 3 <> 0 OR (t.placed AND NOT x)
  FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1, LATERAL (SELECT epoch_us(e.ts) - epoch_us(t.seen) > {TTL_S * 1_000_000} AS x)),
l AS (SELECT user_id, max(s) AS s, arg_max(seen, n) AS seen FROM t GROUP BY 1),
m AS (SELECT e.*, k % 3 = 0 AS st FROM e JOIN t USING (user_id, n) JOIN l USING (user_id, s) WHERE epoch_us((SELECT max(ts) FROM events)) - epoch_us(l.seen) <= {TTL_S * 1_000_000})
SELECT CAST(user_id AS VARCHAR) AS mmsi, max(epoch_us(ts)) AS last_us, arg_max(29 + k / 100.0::DOUBLE, n) FILTER (NOT st) AS lat, arg_max(45 + (user_id % 90) / 10.0::DOUBLE, n) FILTER (NOT st) AS lon, arg_max(value, n) FILTER (NOT st) AS sog,
  arg_max(k::DOUBLE, n) FILTER (NOT st AND k % 4 > 0) AS true_heading, arg_max(k % 8, n) FILTER (NOT st) AS nav_status, arg_max(k, n) FILTER (st) AS type, arg_max('P' || k, n) FILTER (st AND k % 2 = 0) AS destination,
  arg_max(k + 5, n) FILTER (st) AS length, arg_max(CASE WHEN k % 5 > 0 THEN 'S' || k ELSE '' END, n) FILTER (st OR k % 5 > 0) AS name
FROM m GROUP BY user_id HAVING count(*) FILTER (NOT st) > 0"""

#: Event types as polled feeds; the others keep their names.
FEEDS = {"click": "adsb", "view": "ais", "error": "gnss", "purchase": "tle"}


def polls(events: DataFrame) -> DataFrame:
    """Events as polls: every sixth k is a failed one, and payloads repeat."""
    k = F.get_json_object("props", "$.k").cast("int")
    name = F.coalesce(*[F.when(F.col("event_type") == a, F.lit(b)) for a, b in FEEDS.items()], F.col("event_type"))
    return events.select(name.alias("feed"), "ts", F.col("event_id").alias("id"), F.when(k % 6 != 0, F.concat(F.lit('{"n": '), F.floor(k / 50).cast("string"), F.lit("}"))).alias("payload"))


def aged(spark, d, arrived: DataFrame) -> DataFrame:
    """arrived with ages at the newest event."""
    end = F.broadcast(S.read(spark, d, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("end")))  # one row
    out = feed.ages(arrived.join(end), F.col("end"))
    return out.select("feed", "polls", "failed", F.unix_micros(F.col("last_ts").cast("timestamp")).alias("last_us"), F.unix_micros(F.col("arrived_at").cast("timestamp")).alias("arrived_us"), F.round("age_s", 6).alias("age_s"), "stale", *[c for c in ("late", "arrivals") if c in out.columns])


def feed_arrivals(spark, d):
    return aged(spark, d, feed.arrivals(polls(S.read(spark, d, "events"))))


def stream_arrivals(spark, d, reports: list | None = None):
    """The same by a stream with state, which counts arrivals too: the newest row of each feed."""
    states = run(spark, d, lambda events: pipelines.arrivals(polls(events)), mode="update", reports=reports)
    newest = states.groupBy("feed").agg(F.max_by(F.struct("polls", "failed", "late", "arrivals", "last_ts", "arrived_at"), "epoch").alias("r")).select("feed", "r.*")
    return aged(spark, d, newest)


ARRIVALS = f"""e AS (SELECT CASE event_type {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FEEDS.items())} ELSE event_type END AS feed, ts, event_id AS id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
g AS (SELECT feed, ts, id, k // 50 AS p, lag(k // 50) OVER (PARTITION BY feed ORDER BY ts, id) AS q FROM e WHERE k % 6 <> 0),
a AS (SELECT feed, max(epoch_us(ts)) AS last_us, max(epoch_us(ts)) FILTER (p <> q) AS arrived_us, count(*) FILTER (p <> q) AS arrivals FROM g GROUP BY 1),
n AS (SELECT feed, count(*) AS polls, count(*) FILTER (k % 6 = 0) AS failed FROM e GROUP BY 1),
o AS (SELECT feed, polls, failed, last_us, arrived_us, arrivals, ((SELECT max(epoch_us(ts)) FROM events) - arrived_us) / 1000000::DOUBLE AS age FROM n LEFT JOIN a USING (feed))"""
LIMIT = f"CASE feed {' '.join(f'WHEN {k!r} THEN {v}' for k, v in V.FEED_STALE_S.items())} ELSE {V.FEED_STALE_S['stream']} END"

ENTRIES = {
    "feed_arrivals": (feed_arrivals, f"WITH {ARRIVALS} SELECT feed, polls, failed, last_us, arrived_us, round(age, 6) AS age_s, age > {LIMIT} AS stale FROM o"),
    "stream_arrivals": (stream_arrivals, f"WITH {ARRIVALS} SELECT feed, polls, failed, last_us, arrived_us, round(age, 6) AS age_s, age > {LIMIT} AS stale, 0::BIGINT AS late, coalesce(arrivals, 0) AS arrivals FROM o"),
    "stream_vessels": (stream_vessels, VESSELS_SQL),
    "stream_dedup": (stream_dedup, "SELECT event_id, user_id, event_type FROM events"),
    "stream_tracks": (stream_tracks, TRACKS_SQL),
}
