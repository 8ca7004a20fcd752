"""Generated events, bursts and movers over the suppliers and nations at hand. The SQL of movers goes tick by tick."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.plans import substrate as S
from tidewatch.session import small
from tidewatch.sources import synthetic

NOW = "2024-01-31 00:00:00"
#: Seconds a tick, how many ticks, how many targets at most.
FLIGHT_S, VOYAGE_S, TICKS, LEGS = 15, 600, 480, 24


def places(s, d):
    return S.read(s, d, "nation").selectExpr("n_nationkey as place", "n_name as name", "cast(12 + (n_nationkey * 7) % 27 as double) as lat", "cast(34 + (n_nationkey * 11) % 27 as double) as lon", "n_regionkey as region")


PLACES = "place AS (SELECT n_nationkey AS place, n_name AS name, (12 + (n_nationkey * 7) % 27)::DOUBLE AS lat, (34 + (n_nationkey * 11) % 27)::DOUBLE AS lon, n_regionkey AS region FROM nation)"


def step(knots, seconds):
    return knots * V.KNOT_KM / V.DEGREE_KM / 3600 * seconds


def u(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5({key} || ':{seed}'), 1, 7) AS BIGINT) / {synthetic.DRAWS}::DOUBLE)"


def near(x: str, amount: float, seed: int, key: str) -> str:
    return f"({x} + (2 * {u(seed, key)} - 1) * {amount}::DOUBLE)"


def bands(of, x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} < {end}::DOUBLE THEN {value!r}" for value, end in of) + " END"


def flights(s, d):
    """A flight for each supplier: from a place to place after place."""
    spots, e = places(s, d), F.col("entity")
    n = F.lit(spots.count())
    leg = S.read(s, d, "supplier").selectExpr("s_suppkey as entity").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(LEGS))))
    drawn = lambda k: synthetic.uniform(k, e, F.col("j"))
    reach = F.when(F.col("j") == 0, 2.0).otherwise(1.0)
    at = leg.withColumn("place", F.floor(drawn(11) * n).cast("int")).join(small(spots), "place").select("entity", "j", synthetic.around(F.col("lat"), reach, drawn(12)).alias("lat"), synthetic.around(F.col("lon"), reach, drawn(13)).alias("lon"))
    m = at.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("j", "lat", "lon"))).alias("w"))  # LEGS + 1 points each
    movers = m.select("entity", F.col("w")[0]["lat"].alias("lat"), F.col("w")[0]["lon"].alias("lon"), F.slice("w", 2, LEGS).alias("targets"), step(420 + F.col("entity") % 51, FLIGHT_S).alias("step"))
    return shown(synthetic.positions(movers, V.FLIGHT_NEAR, TICKS, V.FLIGHT_NOISE))


def voyages(s, d):
    """A voyage for each supplier: along the nations of its region, there and back."""
    e, spots = F.col("entity"), places(s, d)
    routes = spots.groupBy("region").agg(F.array_sort(F.collect_list(F.struct("place", "lat", "lon"))).alias("route"))  # one of few nations each
    home = S.read(s, d, "supplier").selectExpr("s_suppkey as entity", "s_nationkey as place").join(small(spots.select("place", "region")), "place").join(small(routes), "region")
    at, part = F.floor(synthetic.uniform(21, e) * F.greatest(F.lit(1), F.size("route") - 1)).cast("int"), synthetic.uniform(22, e)
    a, b = F.element_at("route", F.col("at") + 1), F.element_at("route", F.least(F.col("at") + 2, F.size("route")))
    movers = home.withColumn("at", at).select(
        "entity", (a["lat"] + (b["lat"] - a["lat"]) * part).alias("lat"), (a["lon"] + (b["lon"] - a["lon"]) * part).alias("lon"),
        synthetic.there_and_back(F.col("route"), F.col("at"), synthetic.uniform(23, e) > 0.3, LEGS).alias("targets"), step(10 + 8 * synthetic.uniform(24, e), VOYAGE_S).alias("step"),
    )
    return shown(synthetic.positions(movers, V.VOYAGE_NEAR, TICKS, V.VOYAGE_NOISE))


def shown(p):
    return p.select("entity", "tick", "leg", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("heading", 1).alias("heading"), "arrived")


def walk(close: float, noise: float) -> str:
    """Tick by tick over w (entity, leg, lat, lon: the targets from 0) and m (entity, lat, lon, step)."""
    key = "entity || ':' || tick"
    h = "degrees(atan2(w.lon - t.lon, w.lat - t.lat)) + 360"
    return f"""t AS (SELECT entity, 0::BIGINT AS tick, 0 AS leg, lat, lon, step, false AS arrived FROM m
  UNION ALL SELECT t.entity, t.tick + 1, CASE WHEN x.there AND t.leg < {LEGS - 1} THEN t.leg + 1 ELSE t.leg END, CASE WHEN x.there THEN t.lat ELSE t.lat + (w.lat - t.lat) * least(1, t.step / x.d) END,
    CASE WHEN x.there THEN t.lon ELSE t.lon + (w.lon - t.lon) * least(1, t.step / x.d) END, t.step, x.there AND t.leg < {LEGS - 1}
  FROM t JOIN w USING (entity, leg), LATERAL (SELECT sqrt((w.lat - t.lat) * (w.lat - t.lat) + (w.lon - t.lon) * (w.lon - t.lon)) AS d, sqrt((w.lat - t.lat) * (w.lat - t.lat) + (w.lon - t.lon) * (w.lon - t.lon)) < {close}::DOUBLE AS there) x WHERE t.tick < {TICKS})
SELECT entity, tick, leg, round({near('t.lat', noise, 1, key)}, 4) AS lat, round({near('t.lon', noise, 2, key)}, 4) AS lon, round(CASE WHEN {h} >= 360 THEN {h} - 360 ELSE {h} END, 1) AS heading, arrived FROM t JOIN w USING (entity, leg)"""


LEG_KEY = "s_suppkey || ':' || j"
FLIGHTS_SQL = f"""WITH RECURSIVE {PLACES}, p AS (SELECT s_suppkey AS entity, j, {near('lat', 1, 12, LEG_KEY).replace('* 1::DOUBLE', '* CASE WHEN j = 0 THEN 2 ELSE 1 END')} AS lat, {near('lon', 1, 13, LEG_KEY).replace('* 1::DOUBLE', '* CASE WHEN j = 0 THEN 2 ELSE 1 END')} AS lon
  FROM supplier, range({LEGS + 1}) r(j), place WHERE place.place = floor({u(11, LEG_KEY)} * (SELECT count(*) FROM place))),
w AS (SELECT entity, CAST(j - 1 AS INT) AS leg, lat, lon FROM p WHERE j > 0), m AS (SELECT entity, lat, lon, {step(1.0, FLIGHT_S)!r}::DOUBLE * (420 + entity % 51) AS step FROM p WHERE j = 0),
{walk(V.FLIGHT_NEAR, V.FLIGHT_NOISE)}"""

VOYAGES_SQL = f"""WITH RECURSIVE {PLACES}, r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY place) - 1 AS i, count(*) OVER (PARTITION BY region) AS n FROM place),
h AS (SELECT s_suppkey AS entity, r.region, r.n, CAST(floor({u(21, 's_suppkey')} * greatest(1, r.n - 1)) AS BIGINT) AS i0, {u(23, 's_suppkey')} > 0.3::DOUBLE AS onward FROM supplier JOIN r ON r.place = s_nationkey),
k AS (SELECT entity, 0 AS leg, region, n, CASE WHEN onward THEN CASE WHEN i0 + 1 < n THEN i0 + 1 ELSE i0 - 1 END ELSE CASE WHEN i0 > 0 THEN i0 - 1 ELSE 1 END END AS i, CASE WHEN onward THEN i0 + 1 < n ELSE i0 = 0 END AS up FROM h
  UNION ALL SELECT entity, leg + 1, region, n, CASE WHEN up THEN CASE WHEN i + 1 < n THEN i + 1 ELSE i - 1 END ELSE CASE WHEN i > 0 THEN i - 1 ELSE 1 END END, CASE WHEN up THEN i + 1 < n ELSE i = 0 END FROM k WHERE leg < {LEGS - 1}),
w AS (SELECT entity, leg, lat, lon FROM k JOIN r USING (region, i)),
m AS (SELECT entity, a.lat + (b.lat - a.lat) * {u(22, 'entity')} AS lat, a.lon + (b.lon - a.lon) * {u(22, 'entity')} AS lon, {step(1.0, VOYAGE_S)!r}::DOUBLE * (10 + 8 * {u(24, 'entity')}) AS step
  FROM h JOIN r a ON a.region = h.region AND a.i = i0 JOIN r b ON b.region = h.region AND b.i = least(i0 + 1, h.n - 1)),
{walk(V.VOYAGE_NEAR, V.VOYAGE_NOISE)}"""

ENTRIES = {
    "synthetic_events": (
        lambda s, d: synthetic.events(S.read(s, d, "events").selectExpr("event_id as id"), places(s, d).drop("region"), F.lit(NOW).cast("timestamp")).select("id", "event_type", F.unix_timestamp("ts").alias("t"), "severity", "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon")),
        f"""WITH {PLACES} SELECT event_id AS id, {bands(V.DEMO_KINDS, u(1, 'event_id'))} AS event_type, CAST(epoch(TIMESTAMP '{NOW}') AS BIGINT) - CAST(floor(least(-ln(1 - {u(2, 'event_id')}) * {V.DEMO_MEAN_AGE_S}::DOUBLE, {V.DEMO_OLDEST_S}::DOUBLE)) AS BIGINT) AS t,
  {bands(V.DEMO_SEVERITIES, u(3, 'event_id'))} + CAST(floor({u(4, 'event_id')} * 2) AS INT) AS severity, name, round({near('lat', V.DEMO_JITTER, 6, 'event_id')}, 4) AS lat, round({near('lon', V.DEMO_JITTER, 7, 'event_id')}, 4) AS lon
  FROM events JOIN place ON place = floor({u(5, 'event_id')} * (SELECT count(*) FROM place))""",
    ),
    "synthetic_bursts": (
        lambda s, d: synthetic.bursts(S.events(s, d).select("id")),
        f"SELECT event_id AS tick, CAST(nth AS INT) AS nth, CAST(7 + floor({u(11, chr(39).join(['event_id || ', ':', ' || nth']))} * 4) AS INT) AS severity FROM events, range(1, 6) r(nth) WHERE event_id % 8 = 0 AND {u(9, 'event_id')} < 0.3::DOUBLE AND nth <= 3 + floor({u(10, 'event_id')} * 3)",
    ),
    "synthetic_flights": (flights, FLIGHTS_SQL),
    "synthetic_voyages": (voyages, VOYAGES_SQL),
}
