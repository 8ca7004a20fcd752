"""An audit of the position that stands for "no place": what is on it, beside it, and what an estimate by names makes of it.

Rows have lat, lon, geometry (hexadecimal; empty is null), location_name, severity, source, event_type, report_count, id.

Geometry falls into three disjoint cases: null, decoded, and there but undecodable; the last is never counted as null.
A row is exact where both coordinates are the sentinel's, half where one is; a band counts the rows that are not exact and whose
larger offset lies within its bound, but not within a smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.functions.display import ewkb_point

#: Bounds of the bands in degrees, and names that are refused as places.
BANDS = (0.000001, 0.0001, 0.01, 0.1, 1.0, 5.0)
REJECTED = ("unknown", "n/a", "", "various", "multiple")
UNKNOWN = "Unknown"
#: What a name's modal position may differ from the sentinel for the proxy to charge the name to it.
TOLERANCE = 0.01


def _at(lat: Column, lon: Column) -> Column:
    return F.coalesce((lat == V.SENTINEL_LAT) & (lon == V.SENTINEL_LON), F.lit(False))


def _exact() -> Column:
    return _at(F.col("lat"), F.col("lon"))


def counters(rows: DataFrame) -> DataFrame:
    """One row with all counters, from one pass with partial sums; an empty table counts 0 everywhere."""
    p = rows.withColumn("_g", ewkb_point(F.nullif(F.col("geometry"), F.lit(""))))
    status, lat, lon = F.col("_g.status"), F.col("lat"), F.col("lon")
    exact, there = _exact(), _at(F.col("_g.lat"), F.col("_g.lon"))
    both = lat.isNotNull() & lon.isNotNull()
    off = F.greatest(F.abs(lat - V.SENTINEL_LAT), F.abs(lon - V.SENTINEL_LON))
    five, unknown = F.col("severity") == 5, F.col("location_name") == UNKNOWN
    tests = {
        "lat_null": lat.isNull(), "lon_null": lon.isNull(), "located": both,
        "geom_null": status == "null", "geom_decoded": status == "point", "geom_undecodable": status == "undecodable",
        "exact": exact, "exact_geom_agrees": exact & there, "exact_geom_null": exact & (status == "null"), "exact_geom_undecodable": exact & (status == "undecodable"), "exact_geom_elsewhere": exact & (status == "point") & ~there,
        "geom_sentinel": there, "geom_sentinel_not_selected": there & ~exact,
        "half_lat": both & ~exact & (lat == V.SENTINEL_LAT), "half_lon": both & ~exact & (lon == V.SENTINEL_LON),
        "severity_5": five, "unknown": unknown, "rejected": F.lower(F.trim("location_name")).isin(*REJECTED),
        "exact_unknown_5": exact & five & unknown, "exact_merged": exact & (F.col("report_count") > 1),
    }
    for i, (least, most) in enumerate(zip((-1.0, *BANDS), BANDS, strict=False), 1):
        tests[f"band_{i}"] = both & ~exact & (off > least) & (off <= most)
    return p.agg(F.count("*").alias("rows"), *[F.count_if(test).alias(name) for name, test in tests.items()])


def profile(rows: DataFrame) -> DataFrame:
    """What the exact rows are like: a row per (dimension, value) with its count. All dimensions come from one reading of the rows,
    and are added up before they are shuffled."""
    of = [F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in ("location_name", "severity", "source", "event_type")]
    return rows.filter(_exact()).select(F.inline(F.array(*of))).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def positions(rows: DataFrame, top: int = 25) -> DataFrame:
    """The `top` most frequent positions of all located rows (ties: the smaller one first), and whether each is the sentinel."""
    n = rows.filter("lat is not null and lon is not null").groupBy("lat", "lon").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "lat", "lon").limit(top).withColumn("sentinel", _exact())


def estimators(rows: DataFrame) -> DataFrame:
    """One row: the proxy beside the census. The proxy charges all rows of a name to the sentinel when the name's most frequent
    position (ties: the one met first, by id) lies within TOLERANCE of it; the census counts rows.

    proxy: rows charged; charged_not_on: of those, the ones elsewhere; missed: rows on the sentinel that it does not charge;
    repairable: rows and names on the sentinel whose name also has a real position. Names are folded from counts per position
    by sums and a largest count: a name of a third of all rows is no task's."""
    at = rows.groupBy("location_name", "lat", "lon").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    on, both = _exact(), F.col("lat").isNotNull() & F.col("lon").isNotNull()
    some = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    by = at.groupBy("location_name").agg(F.sum("n").alias("n"), some(on).alias("on"), some(both & ~on).alias("real"), F.max_by(F.struct("lat", "lon"), F.struct("n", -F.col("first"))).alias("mode"))
    near = (F.abs(F.col("mode.lat") - V.SENTINEL_LAT) < TOLERANCE) & (F.abs(F.col("mode.lon") - V.SENTINEL_LON) < TOLERANCE)
    by = by.withColumn("near", F.coalesce(near, F.lit(False))).withColumn("repairable", ~F.col("location_name").eqNullSafe(UNKNOWN) & (F.col("on") > 0) & (F.col("real") > 0))
    total = lambda test, what: F.coalesce(F.sum(F.when(test, what)), F.lit(0)).cast("long")
    return by.agg(
        total(F.lit(True), F.col("on")).alias("census"), total(F.col("near"), F.col("n")).alias("proxy"), total(F.col("near"), F.col("n") - F.col("on")).alias("charged_not_on"), total(~F.col("near"), F.col("on")).alias("missed"),
        total(F.col("repairable"), F.col("on")).alias("repairable_rows"), F.count_if("repairable").alias("repairable_names"),
    )
