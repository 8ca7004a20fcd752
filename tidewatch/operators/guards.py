"""Existence guards, backfills, repairs and retention, as semi and anti joins and column rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import values as V


def unseen(incoming: DataFrame, stored: DataFrame, *keys: str) -> DataFrame:
    """Incoming rows whose key is not stored. A null key is never seen."""
    return incoming.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def first_reports(events: DataFrame, reports: DataFrame) -> DataFrame:
    """One report for each event that has none yet."""
    return events.join(reports.select("event_id").distinct(), events["id"] == F.col("event_id"), "left_anti")


def keep_first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows of least `order` of each key (one, where order tells a key's rows apart); nulls are equal to each other. Keys
    may be long texts that many rows share: only 128 bits of them are moved, and copies are added up before that."""
    name = [F.xxhash64(*keys).alias("_h1"), F.xxhash64(F.lit(1), *[F.coalesce(F.hash(k), F.lit(0)) for k in keys], *keys).alias("_h2")]
    named = rows.select("*", *name)
    first = named.groupBy("_h1", "_h2").agg(F.min(order).alias(order))
    return named.join(first, ["_h1", "_h2", order], "left_semi").drop("_h1", "_h2")


def checkpoints(messages: DataFrame) -> DataFrame:
    """The furthest message of each channel and when it was seen; checkpoints only grow."""
    return messages.groupBy("channel").agg(F.max("message_id").alias("last_message_id"), F.max_by("seen", "message_id").alias("last_seen"))


def advance(old: DataFrame, new: DataFrame) -> DataFrame:
    return checkpoints(old.select("channel", F.col("last_message_id").alias("message_id"), F.col("last_seen").alias("seen")).unionByName(new.select("channel", F.col("last_message_id").alias("message_id"), F.col("last_seen").alias("seen"))))


def purge(events: DataFrame, reports: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """Events from the cutoff on, and the reports that still have an event."""
    kept = events.filter(F.col("ts") >= F.lit(cutoff).cast("timestamp"))
    return kept, reports.join(kept.select(F.col("id").alias("event_id")), "event_id", "left_semi")


def is_sentinel(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat == V.SENTINEL_LAT) & (lon == V.SENTINEL_LON), F.lit(False))


def retire_sentinel(events: DataFrame) -> DataFrame:
    """Rows at the retired position lose position and precision and count as tried and failed; others stay. Repeating it changes nothing."""
    bad = is_sentinel(F.col("lat"), F.col("lon"))
    cleared = {c: F.when(bad, F.lit(None)).otherwise(F.col(c)) for c in ("lat", "lon", "geo_precision", "geo_uncertainty_m", "geo_method") if c in events.columns}
    # All columns are rewritten at once, from the old position.
    return events.select(*[(cleared.get(c, F.when(bad, F.lit(False)).otherwise(F.col(c)) if c == "is_geolocated" else F.col(c))).alias(c) for c in events.columns])


def add_columns(events: DataFrame, wanted: dict[str, tuple[str, object]]) -> DataFrame:
    """Columns (name: type, default) that events lacks; those it has stay as they are."""
    return events.select("*", *[F.lit(d).cast(t).alias(c) for c, (t, d) in wanted.items() if c not in events.columns])


def repair_spans(events: DataFrame, no_places=V.NOT_A_PLACE) -> DataFrame:
    """Evidence spans where nobody looked yet (null); found and empty spans are never rewritten. no_places: names that stand for no place."""
    return events.withColumn("evidence_span", F.coalesce("evidence_span", T.evidence_span(F.col("raw_text"), F.col("location_name"), no_places)))


def heal(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """old: id, location_name, severity, killed_reported, ...; fresh: id and a new reading (new_status, new_location,
    new_severity, new_killed). Only an ok reading writes; an unmeasured severity keeps the old one, the toll is
    replaced even by null."""
    ok = F.col("new_status").eqNullSafe("ok")
    both = old.join(fresh, "id", "left")
    changed = {
        "location_name": F.when(ok & (F.trim(F.coalesce("location_name", F.lit(""))) == ""), F.col("new_location")).otherwise(F.col("location_name")),
        "severity": F.when(ok, F.coalesce("new_severity", "severity")).otherwise(F.col("severity")),
        "killed_reported": F.when(ok, F.col("new_killed")).otherwise(F.col("killed_reported")),
    }
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in old.columns])


def reclassify_vague(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """Rows with a vague location take a new specific one with its position; severity only if the new one is truthy."""
    vague = F.lower(F.trim(F.coalesce("location_name", F.lit("")))).isin(*V.VAGUE_LOCATIONS)
    better = F.col("new_status").eqNullSafe("ok") & ~F.lower(F.trim(F.coalesce("new_location", F.lit("")))).isin(*V.VAGUE_LOCATIONS) & F.col("new_lat").isNotNull()
    both = old.join(fresh, "id", "left")
    hit = vague & better
    changed = {
        "location_name": F.when(hit, F.col("new_location")).otherwise(F.col("location_name")),
        "lat": F.when(hit, F.col("new_lat")).otherwise(F.col("lat")),
        "lon": F.when(hit, F.col("new_lon")).otherwise(F.col("lon")),
        "severity": F.when(hit & F.coalesce(F.col("new_severity") != 0, F.lit(False)), F.col("new_severity")).otherwise(F.col("severity")),
    }
    return both.select(*[changed.get(c, F.col(c)).alias(c) for c in old.columns])


def key_violations(reports: DataFrame) -> DataFrame:
    """Keys (channel, message_id) stored twice; null ids are unconstrained."""
    return reports.filter(F.col("message_id").isNotNull()).groupBy("channel", "message_id").agg(F.count("*").alias("n")).filter("n > 1")
