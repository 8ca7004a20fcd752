"""The tables at hand, seen as events, reports, messages, aircraft and sensor series. Derived fields use integer
arithmetic only, so that any engine derives the same. Each view has its SQL twin, a common table expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k")).selectExpr(
        "event_id as id", "ts", "event_type", "user_id", "value", "k",
        "case when k % 7 = 0 then null else 1 + k % 10 end as severity",
        "case when user_id % 11 = 0 then null else cast(1 + user_id % 5 as int) end as reliability",
        "case when k % 5 = 0 then null else 29 + ((user_id * 37 + event_id % 4) % 600) / 100.0d end as lat",
        "case when k % 5 = 0 then null else 45 + ((user_id * 53) % 600) / 100.0d end as lon",
        "case when k % 13 = 0 then null when k % 13 = 1 then 'parse_failed' when k % 13 = 2 then 'no_backend' else 'ok' end as extraction_status",
        "case when k % 17 = 0 then null else k % 5 <> 0 end as is_geolocated",
        "case when k % 9 = 0 then null else k % 12 end as nic",
        "case when k % 8 = 0 then null else (k * 7) % 12 end as nac_p",
        "value * 400 as altitude",
        "k % 19 = 0 as on_ground",
    )


EV = """ev AS (SELECT event_id AS id, ts, event_type, user_id, value, k,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 1 + k % 10 END AS severity,
  CASE WHEN user_id % 11 = 0 THEN NULL ELSE CAST(1 + user_id % 5 AS INT) END AS reliability,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 29 + ((user_id * 37 + event_id % 4) % 600) / 100.0::DOUBLE END AS lat,
  CASE WHEN k % 5 = 0 THEN NULL ELSE 45 + ((user_id * 53) % 600) / 100.0::DOUBLE END AS lon,
  CASE WHEN k % 13 = 0 THEN NULL WHEN k % 13 = 1 THEN 'parse_failed' WHEN k % 13 = 2 THEN 'no_backend' ELSE 'ok' END AS extraction_status,
  CASE WHEN k % 17 = 0 THEN NULL ELSE k % 5 <> 0 END AS is_geolocated,
  CASE WHEN k % 9 = 0 THEN NULL ELSE k % 12 END AS nic, CASE WHEN k % 8 = 0 THEN NULL ELSE (k * 7) % 12 END AS nac_p,
  value * 400 AS altitude, k % 19 = 0 AS on_ground
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def said(number: Column) -> Column:
    """When the message of that number was said: one a minute."""
    return F.timestamp_seconds(1_704_067_200 + 60 * number)


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as unlocated messages, one a minute, typed by language; severity from labels, null where unlabelled."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    null = F.lit(None).cast("double")
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"), said(F.col("doc_id")).alias("ts"), F.col("lang").alias("event_type"), "text", F.col("source").alias("channel"), null.alias("lat"), null.alias("lon"),
        (1 + 4 * F.col("quality")).alias("severity"), F.when(F.col("doc_id") % 11 != 0, (1 + F.col("doc_id") % 5).cast("int")).alias("reliability"), F.when(F.col("doc_id") % 7 == 0, "parse_failed").otherwise("ok").alias("status"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, text and channel of messages: documents alone, which no join moves."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("channel"))


MSG = """msg AS (SELECT d.doc_id AS id, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS ts, lang AS event_type, text, source AS channel, 1 + 4 * q.quality AS severity,
  CASE WHEN d.doc_id % 11 <> 0 THEN CAST(1 + d.doc_id % 5 AS INT) END AS reliability, CASE WHEN d.doc_id % 7 = 0 THEN 'parse_failed' ELSE 'ok' END AS status
  FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) q ON q.doc_id = d.doc_id)"""


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the reports of an event: line 1 is the event's own."""
    line = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"), F.min("l_suppkey").alias("k"), F.min("l_partkey").alias("p"))
    return line.select(
        F.col("l_orderkey").alias("event_id"), (F.row_number().over(_first()) - 1).alias("seq"), F.when(F.col("p") % 13 != 0, F.concat("f", "s")).otherwise("").alias("channel"),
        F.when(F.col("k") % 7 != 0, (1 + F.col("k") % 5).cast("int")).alias("reliability"), F.when(F.col("p") % 6 != 0, (1 + F.col("p") % 10).cast("int")).alias("severity"), F.when(F.col("p") % 5 == 0, "parse_failed").otherwise("ok").alias("status"),
    )


def _first():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber")


REP = """rep AS (SELECT l_orderkey AS event_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS seq, CASE WHEN p % 13 <> 0 THEN f || s ELSE '' END AS channel,
  CASE WHEN k % 7 <> 0 THEN CAST(1 + k % 5 AS INT) END AS reliability, CASE WHEN p % 6 <> 0 THEN CAST(1 + p % 10 AS INT) END AS severity, CASE WHEN p % 5 = 0 THEN 'parse_failed' ELSE 'ok' END AS status
  FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS f, min(l_linestatus) AS s, min(l_suppkey) AS k, min(l_partkey) AS p FROM lineitem GROUP BY ALL))"""

#: Length of a sample of the derived series, and how many codes there are.
STEP = 1800


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour sums of k per (user_id % 2, event_type) as sensor series; half hours without events are not measured."""
    t = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / STEP) * STEP
    code = F.concat(F.lit("c"), (F.col("user_id") % 2).cast("string"))
    return events(spark, sf_dir).groupBy(code.alias("code"), F.col("event_type").alias("datasource"), t.alias("t")).agg(F.sum("k").cast("double").alias("v"))


SMP = """smp AS (SELECT 'c' || (user_id % 2) AS code, event_type AS datasource, CAST(floor(epoch(ts) / 1800) * 1800 AS BIGINT) AS t, CAST(sum(k) AS DOUBLE) AS v FROM ev GROUP BY ALL)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("code", "datasource").distinct().withColumns({"step": F.lit(STEP), "fetched": F.lit(True)})


def channel_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").selectExpr("conv_id as channel", "turn as message_id", "role", "text", "turn as seen")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).selectExpr("n_nationkey as handle", "n_name as name", "1 + n_nationkey % 5 as reliability", "r_name as affiliation")
