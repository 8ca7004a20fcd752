"""Documents as landed messages, read by the message source and ingested in steps, with restarts and messages sent twice."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.plans import substrate as S
from tidewatch.plans.event_queries import FOLD_SQL, LEAD_SQL, NOISE_SQL, STRIPPED
from tidewatch.plans.substrate import MSG, REP
from tidewatch.session import shared_dir
from tidewatch.sources import messages
from tidewatch.streaming import ingest, pipelines

CUTOFF = "2024-01-01 02:00:00"
STEPS = 3


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was read out of the messages, by message_id."""
    read = S.messages(spark, sf_dir).select(F.col("id").alias("message_id"), "event_type", "lat", "lon", F.col("severity").cast("int").alias("severity"), "reliability", "status")
    return read.withColumn("killed_reported", F.lit(None).cast("int"))


def run(spark: SparkSession, sf_dir: str) -> ingest.Store:
    """Messages land in steps by doc_id; each later step sends a third of all earlier ones again. Each step is a start from the stream's checkpoint."""
    base = f"{shared_dir(spark)}/ingest/{uuid.uuid4().hex}"
    spark.dataSource.register(messages.Messages)
    docs = S.texts(spark, sf_dir).select("id", "channel", F.col("id").alias("message_id"), S.said(F.col("id")).cast("timestamp").alias("seen"), "text")
    lo, hi = docs.agg(F.min("id"), F.max("id")).first()
    cuts = [lo + (hi - lo + 1) * i // STEPS for i in range(STEPS + 1)] if lo is not None else []
    store, next_ = ingest.Store(spark, f"{base}/store"), 0
    for i in range(len(cuts) - 1):
        new, again = docs.filter(F.col("id").between(cuts[i], cuts[i + 1] - 1)), docs.filter(f"id < {cuts[i]} and id % 3 = 0 and channel is not null")
        next_ = messages.land(again.unionByName(new), f"{base}/log", next_)
        log = spark.readStream.format("message_log").option("path", f"{base}/log").load()
        landed = log.select(F.col("offset").alias("id"), "channel", "message_id", "text", F.col("seen").alias("ts"))
        pipelines.run_available(landed, "", f"{base}/checkpoint", ingest.ingest(store, CUTOFF, readings(spark, sf_dir)))
    return store


def ingested_events(spark, d):
    events = run(spark, d).events(text=False)
    return events.select(F.col("message_id").alias("event_id"), "report_count", "severity", "n_channels", "reliability", "channels")


def ingest_checkpoints(spark, d):
    store = run(spark, d)
    filed = store.reports(text=False).groupBy("channel").agg(F.count("*").alias("reports"), F.countDistinct("event_id").alias("events"))
    far = store.checkpoints().withColumnRenamed("channel", "own")
    return filed.join(far, F.col("channel").eqNullSafe(F.col("own")), "left").select("channel", "reports", "events", "last_message_id")


GATED = f"""{MSG.replace("msg AS (", "msg0 AS (", 1)}, msg1 AS (SELECT *, {STRIPPED} AS s, lower({STRIPPED}) AS low FROM msg0 WHERE text IS NOT NULL AND ts >= TIMESTAMP '{CUTOFF}'),
msg AS (SELECT * EXCLUDE (s, low) FROM msg1 WHERE NOT ({NOISE_SQL} OR coalesce(severity < 3, false)))"""
FILED = f"""{LEAD_SQL.replace(MSG, GATED)}, rep AS MATERIALIZED (SELECT leader AS event_id, row_number() OVER (PARTITION BY leader ORDER BY ld.id) - 1 AS seq, ld.id, coalesce(channel, '') AS channel, channel AS raw, reliability, severity, status FROM ld JOIN msg ON msg.id = ld.id)"""
FOLDED, _ = FOLD_SQL.removeprefix(f"WITH RECURSIVE {REP}, ").rsplit("\nSELECT", 1)
EVENTS_SQL = f"""WITH RECURSIVE {FILED}, {FOLDED},
cl AS (SELECT event_id, seq, channel AS channels FROM rep WHERE seq = 0
  UNION ALL SELECT r.event_id, r.seq, CASE WHEN r.channel = '' OR contains(cl.channels, r.channel) THEN cl.channels WHEN cl.channels = '' THEN r.channel ELSE cl.channels || ', ' || r.channel END
  FROM cl JOIN rep r ON r.event_id = cl.event_id AND r.seq = cl.seq + 1),
ch AS (SELECT event_id, arg_max(channels, seq) AS channels FROM cl GROUP BY event_id)
SELECT event_id, report_count, severity, n_channels, reliability, channels FROM g JOIN l USING (event_id) JOIN ch USING (event_id)"""
CHECKPOINT_SQL = f"""WITH RECURSIVE {FILED} SELECT raw AS channel, count(*) AS reports, count(DISTINCT event_id) AS events, max(id) FILTER (id = event_id) AS last_message_id FROM rep GROUP BY raw"""

ENTRIES = {
    "ingested_events": (ingested_events, EVENTS_SQL),
    "ingest_checkpoints": (ingest_checkpoints, CHECKPOINT_SQL),
}
