"""Navigation-integrity grid: share of degraded aircraft per cell, with the denominators that make it a measurement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import geo as G
from tidewatch.functions import values as V


def cells(aircraft: DataFrame) -> DataFrame:
    """aircraft: lat, lon, altitude, on_ground, nic, nac_p. Counts per cell over the evaluable ones."""
    ok = aircraft.filter(G.evaluable(*[F.col(c) for c in ("lat", "lon", "on_ground", "altitude", "nic", "nac_p")]))
    n, bad = F.count("*"), F.count_if(G.degraded(F.col("nic"), F.col("nac_p")))
    return ok.groupBy(G.grid(F.col("lat")).alias("cy"), G.grid(F.col("lon")).alias("cx")).agg(n.alias("total"), bad.alias("degraded")).withColumn("ratio", F.col("degraded") / F.col("total"))


def zones(aircraft: DataFrame) -> DataFrame:
    """Cells with enough aircraft and a ratio from the threshold on."""
    return cells(aircraft).filter((F.col("total") >= V.CELL_AIRCRAFT) & (F.col("ratio") >= V.CELL_RATIO))


def status(aircraft: DataFrame) -> DataFrame:
    """One row even for no aircraft: status, cells_evaluated, aircraft_evaluable."""
    c = cells(aircraft)
    s = c.agg(F.count_if(F.col("total") >= V.CELL_AIRCRAFT).alias("cells_evaluated"), F.coalesce(F.sum("total"), F.lit(0)).alias("aircraft_evaluable"))
    return s.select(F.when(F.col("aircraft_evaluable") == 0, "no_integrity_data").when(F.col("cells_evaluated") == 0, "insufficient_coverage").otherwise("ok").alias("status"), "cells_evaluated", "aircraft_evaluable")


def probe_summary(aircraft: DataFrame, point: str) -> DataFrame:
    """Per probe point: aircraft, those with each figure, the degraded among those with nic, and that ratio."""
    nic = F.count("nic")
    bad = F.count_if(F.col("nic") < V.NIC_LEAST)
    return aircraft.groupBy(point).agg(F.count("*").alias("total"), nic.alias("with_nic"), F.count("nac_p").alias("with_nac_p"), bad.alias("degraded"), F.try_divide(bad, nic).alias("ratio"))


def region_counts(messages: DataFrame, regions) -> DataFrame:
    """messages: entity, lat, lon. Messages and distinct entities per named region, first fit."""
    r = G.region_of(F.col("lat"), F.col("lon"), regions)
    return messages.groupBy(r.alias("region")).agg(F.count("*").alias("messages"), F.countDistinct("entity").alias("entities"))
