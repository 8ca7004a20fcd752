"""Column functions over positions and sensor fields."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions import values as V


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = V.EARTH_KM) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def grid(x: Column, cell: float = V.CELL_DEG) -> Column:
    """Cell number of a coordinate; halves go to the even number."""
    return F.bround(x / cell).cast("int")


def box_around(lat: float, lon: float, radius_km: float) -> tuple[float, float, float, float]:
    """(south, north, west, east) that holds the circle, to prune before the distance is computed."""
    dlat = math.degrees(radius_km / V.EARTH_KM)
    dlon = dlat / max(0.01, math.cos(math.radians(min(89.0, abs(lat) + dlat))))
    return tuple(round(x, 4) for x in (max(-90.0, lat - dlat), min(90.0, lat + dlat), max(-180.0, lon - dlon), min(180.0, lon + dlon)))


def within(lat: Column, lon: Column, lat0: float, lon0: float, radius_km: float) -> Column:
    s, n, w, e = box_around(lat0, lon0, radius_km)
    return lat.between(s, n) & lon.between(w, e) & (haversine(lat, lon, F.lit(lat0), F.lit(lon0)) <= radius_km)


def in_boxes(lat: Column, lon: Column, boxes) -> Column:
    """boxes: (south, west, north, east)."""
    out = F.lit(False)
    for s, w, n, e in boxes:
        out = out | (lat.between(s, n) & lon.between(w, e))
    return out


def region_of(lat: Column, lon: Column, regions) -> Column:
    """Name of the first region (name, south, west, north, east) that holds the position."""
    return F.coalesce(*[F.when(in_boxes(lat, lon, [box]), F.lit(name)) for name, *box in regions], F.lit("other"))


def is_located(lat: Column, lon: Column, flag: Column) -> Column:
    """Both coordinates are known and geolocation did not fail; a flag that was never set does not hide them."""
    return lat.isNotNull() & lon.isNotNull() & ~flag.eqNullSafe(F.lit(False))


def box_precision(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Struct (precision, uncertainty_m) of a bounding box by its diagonal; a bad box is a country of unknown extent."""
    diagonal = F.hypot(F.abs(north - south) * 111_320.0, F.abs(east - west) * 111_320.0 * F.cos(F.radians((south + north) / 2)))
    # Metres below which a box is a facility, a city, a first-level region.
    tier = F.when(diagonal < 2_000, "facility").when(diagonal < 25_000, "city").when(diagonal < 200_000, "admin1").otherwise("country_centroid")
    return F.struct(tier.alias("precision"), F.floor(diagonal / 2).cast("int").alias("uncertainty_m"))


# A partial match is one tier coarser.
COARSER = {"facility": "city", "city": "admin1"}
TIERS = ("facility", "city", "admin1", "region_named", "country_centroid")


def coarser(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == a, F.lit(b)) for a, b in COARSER.items()], tier)


def heading(dlat: Column, dlon: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(dlon, dlat)) + 360, F.lit(360.0))


def ship_type(code: Column) -> Column:
    # First and last code of each kind.
    kinds = (
        (20, 29, "Wing in Ground"), (30, 35, "Fishing"), (36, 39, "Towing/Dredging"), (40, 49, "High Speed Craft"), (50, 54, "Special Craft"),
        (60, 69, "Passenger"), (70, 79, "Cargo"), (80, 89, "Tanker"), (90, 99, "Other"),
    )
    return F.coalesce(*[F.when(code.between(a, b), F.lit(name)) for a, b, name in kinds], F.lit("Unknown"))


def truthy(*values: Column) -> Column:
    """The first value that is neither null nor zero, else the last."""
    return F.coalesce(*[F.when(v != 0, v) for v in values[:-1]], values[-1])


def evaluable(lat: Column, lon: Column, on_ground: Column, altitude: Column, nic: Column, nac_p: Column) -> Column:
    """Airborne, located, at altitude, and reporting at least one integrity figure."""
    alt = altitude.try_cast("double")
    return ~F.coalesce(on_ground, F.lit(False)) & lat.isNotNull() & lon.isNotNull() & (nic.isNotNull() | nac_p.isNotNull()) & F.coalesce(alt >= V.ALTITUDE_FT, F.lit(False))


def degraded(nic: Column, nac_p: Column) -> Column:
    return F.coalesce(nic < V.NIC_LEAST, F.lit(False)) | F.coalesce(nac_p < V.NAC_P_LEAST, F.lit(False))


def unit_vector(lat: Column, lon: Column) -> Column:
    la, lo = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(la) * F.cos(lo)).alias("x"), (F.cos(la) * F.sin(lo)).alias("y"), F.sin(la).alias("z"))


def key_tier(key: Column) -> Column:
    """The tier that the words of a place's name speak for: a strait or bay, open water, a built facility, else a city."""
    low = F.lower(key)
    return F.when(low.rlike(V.CHOKEPOINT), F.lit("region_named")).when(low.rlike(V.OPEN_WATER), F.lit("country_centroid")).when(low.rlike(V.FACILITY), F.lit("facility")).otherwise(F.lit("city"))


def tier_of(key: Column, declared: Column, voted: Column) -> Column:
    """What was declared of a name outranks what its position's other names vote for; a name alone speaks for itself."""
    return F.coalesce(declared, voted, key_tier(key))


def uncertainty_of(key: Column, by_tier: Column) -> Column:
    """The measured extent of a place, where there is one, outranks that of its tier."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.KEY_UNCERTAINTY_M.items() for x in kv]), F.lower(key)), by_tier)
