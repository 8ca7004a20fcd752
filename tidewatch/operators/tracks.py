"""Entity tracks and latest state as windows and aggregates over position rows (entity, ts, lat, lon)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import values as V


def compact(points: DataFrame, order: str = "ts", tie: str = "id") -> DataFrame:
    """Points whose position differs from the entity's previous one."""
    by = Window.partitionBy("entity").orderBy(order, tie)
    here = F.struct("lat", "lon")
    return points.withColumn("_before", F.lag(here).over(by)).filter(~F.col("_before").eqNullSafe(here)).drop("_before")


def bounded(points: DataFrame, n: int = V.TRACK_POINTS_AIR) -> DataFrame:
    """The newest n points of each entity."""
    by = Window.partitionBy("entity").orderBy(F.desc("ts"), F.desc("id"))
    return points.withColumn("_n", F.row_number().over(by)).filter(F.col("_n") <= n).drop("_n")


def active(points: DataFrame, now: Column, ttl_s: int = V.TRACK_TTL_S, least: int = 2) -> DataFrame:
    """Tracks of two points at least whose last *recorded* point is young enough: a stationary entity ages out."""
    kept = bounded(compact(points))
    t = kept.groupBy("entity").agg(F.count("*").alias("points"), F.max("ts").alias("last_ts"))
    age = F.unix_timestamp(now) - F.unix_timestamp(F.col("last_ts").cast("timestamp"))
    return t.filter((F.col("points") >= least) & (age <= ttl_s))


def lines(points: DataFrame) -> DataFrame:
    """GeoJSON LineString of each bounded track of two points at least."""
    at = F.struct(F.col("ts"), F.col("id"), F.array("lon", "lat").alias("c"))
    t = bounded(compact(points)).groupBy("entity").agg(F.array_sort(F.collect_list(at)).alias("p"))  # bounded() limits a track
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: x["c"]).alias("coordinates"))
    return t.filter(F.size("p") >= 2).select("entity", F.to_json(geometry).alias("geojson"))


def merged_state(messages: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """Latest non-null value of each field per key, in order of (ts, id). fields: output name and column; a column is
    null on rows of a message type that does not carry the field."""
    order = F.struct("ts", "id")
    return messages.groupBy(key).agg(F.max("ts").alias("last_ts"), *[F.max_by(c, F.when(c.isNotNull(), order)).alias(name) for name, c in fields.items()])


def vessels(messages: DataFrame) -> DataFrame:
    """Vessel state from position and static messages. A name from a position report never erases one; a static
    report's name always counts, even when empty."""
    static, position = F.col("msg_type") == "ShipStaticData", F.col("msg_type") == "PositionReport"
    name = F.when(static, F.coalesce("ship_name", F.lit(""))).when(position & (F.trim(F.coalesce("ship_name", F.lit(""))) != ""), F.col("ship_name"))
    fields = {c: F.when(position, F.col(c)) for c in ("lat", "lon", "sog", "true_heading", "cog", "nav_status")}
    fields |= {c: F.when(static, F.col(c)) for c in ("type", "destination")} | {"name": name, "length": F.when(static, F.coalesce("dim_a", F.lit(0)) + F.coalesce("dim_b", F.lit(0)))}
    return merged_state(messages.filter(~((F.coalesce("lat", F.lit(1)) == 0) & (F.coalesce("lon", F.lit(1)) == 0))), "mmsi", fields)
