"""The audit of the sentinel position and the samples of each bucket, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import values as V
from tidewatch.operators import archive, audit
from tidewatch.plans import substrate as S
from tidewatch.plans.event_queries import NOISE_SQL, STRIPPED
from tidewatch.plans.substrate import EV, MSG

#: Points as the dump writes them: the sentinel, another place, and one of three dimensions.
ON, ELSEWHERE = "0101000020E6100000000000000000544000000000000039C0", "0101000020E610000000000000008046400000000000003E40"
THREE = "01010000A0E6100000000000000000544000000000000039C00000000000000000"

#: Columns of the archive, the same in Spark's SQL and DuckDB's but for the mark of a double.
COLUMNS = (
    "id", "event_type", "severity",
    "CASE k % 6 WHEN 1 THEN NULL WHEN 3 THEN -25.0{0} + (k % 7) / 1000.0{0} WHEN 4 THEN 30.0{0} WHEN 5 THEN -24.5{0} ELSE -25.0{0} END AS lat",
    "CASE k % 6 WHEN 1 THEN NULL WHEN 2 THEN 80.0{0} + (k % 4) * 0.5{0} WHEN 4 THEN 45.0{0} WHEN 5 THEN 81.0{0} + k % 3 ELSE 80.0{0} END AS lon",
    f"CASE k % 5 WHEN 1 THEN '{ON}' WHEN 2 THEN '{ELSEWHERE}' WHEN 3 THEN '{THREE}' WHEN 4 THEN '' END AS geometry",
    "CASE user_id % 9 WHEN 0 THEN 'Unknown' WHEN 1 THEN NULL WHEN 2 THEN ' Various' WHEN 3 THEN '' ELSE concat('Place ', user_id % 50) END AS location_name",
    "concat('u', user_id % 4) AS source", "k % 4 AS report_count",
)
ARC = f"{EV}, arc AS (SELECT {', '.join(c.format('::DOUBLE') for c in COLUMNS)} FROM ev)"
EXACT = "(lat = -25 AND lon = 80)"


def archived(s, d):
    """Events as rows of an archive, some of them on the sentinel, beside it, or with another geometry."""
    return S.events(s, d).selectExpr(*[c.format("d") for c in COLUMNS])


def bucketed(s, d):
    """Messages by what becomes of them."""
    what = F.when(F.col("status") != "ok", "unmeasured").when(T.is_noise(F.col("text")), "noise").when(T.low_severity(F.col("severity")), "low").otherwise("stored")
    return S.messages(s, d).select("id", what.alias("bucket"))


def toll_samples(s, d):
    """Twenty texts of each way to state a toll, with what stands around the first word that hints at one."""
    hint = "(?i)" + "|".join(V.TOLL_WORDS)
    excerpt = F.when(T.once(F.lower("text"), lambda low: T.any_of(low, V.TOLL_WORDS)), T.window_of(F.col("text"), hint))
    rows = S.texts(s, d).select("id", T.toll_bucket(F.col("text")).alias("bucket"), excerpt.alias("excerpt"))
    return archive.bottom_k(rows, "bucket", "id", 20)


_COUNTS = {
    "lat_null": "lat IS NULL", "lon_null": "lon IS NULL", "located": "lat IS NOT NULL AND lon IS NOT NULL",
    "geom_null": "g = 'null'", "geom_decoded": "g IN ('on', 'elsewhere')", "geom_undecodable": "g = 'three'",
    "exact": EXACT, "exact_geom_agrees": f"{EXACT} AND g = 'on'", "exact_geom_null": f"{EXACT} AND g = 'null'", "exact_geom_undecodable": f"{EXACT} AND g = 'three'", "exact_geom_elsewhere": f"{EXACT} AND g = 'elsewhere'",
    "geom_sentinel": "g = 'on'", "geom_sentinel_not_selected": f"g = 'on' AND NOT coalesce({EXACT}, false)",
    "half_lat": "lat = -25 AND lon <> 80", "half_lon": "lat <> -25 AND lon = 80",
    "severity_5": "severity = 5", "unknown": "location_name = 'Unknown'", "rejected": "lower(trim(location_name)) IN ('unknown', 'n/a', '', 'various', 'multiple')",
    "exact_unknown_5": f"{EXACT} AND severity = 5 AND location_name = 'Unknown'", "exact_merged": f"{EXACT} AND report_count > 1",
} | {f"band_{i}": f"NOT {EXACT} AND off > {lo}::DOUBLE AND off <= {hi}::DOUBLE" for i, (lo, hi) in enumerate([(-1, 0.000001), (0.000001, 0.0001), (0.0001, 0.01), (0.01, 0.1), (0.1, 1), (1, 5)], 1)}

ENTRIES = {
    "sentinel_audit": (
        lambda s, d: audit.counters(archived(s, d)),
        f"""WITH {ARC}, m AS (SELECT *, greatest(abs(lat + 25::DOUBLE), abs(lon - 80::DOUBLE)) AS off, CASE geometry WHEN '{ON}' THEN 'on' WHEN '{ELSEWHERE}' THEN 'elsewhere' WHEN '{THREE}' THEN 'three' ELSE 'null' END AS g FROM arc)
SELECT count(*) AS rows, {", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in _COUNTS.items())} FROM m""",
    ),
    "sentinel_profile": (
        lambda s, d: audit.profile(archived(s, d)),
        f"WITH {ARC} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM arc WHERE {EXACT} GROUP BY ALL" for c in ("location_name", "severity", "source", "event_type")),
    ),
    "sentinel_positions": (lambda s, d: audit.positions(archived(s, d)), f"WITH {ARC} SELECT lat, lon, count(*) AS n, {EXACT} AS sentinel FROM arc WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY lat, lon ORDER BY n DESC, lat, lon LIMIT 25"),
    "sentinel_estimators": (
        lambda s, d: audit.estimators(archived(s, d)),
        f"""WITH {ARC}, a AS (SELECT location_name, lat, lon, count(*) AS n, min(id) AS first FROM arc GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY location_name ORDER BY n DESC, first) AS i FROM a),
b AS (SELECT location_name, sum(n) AS n, coalesce(sum(n) FILTER ({EXACT}), 0) AS o, coalesce(sum(n) FILTER (lat IS NOT NULL AND lon IS NOT NULL AND NOT {EXACT}), 0) AS real, coalesce(bool_or(i = 1 AND abs(lat + 25::DOUBLE) < 0.01::DOUBLE AND abs(lon - 80::DOUBLE) < 0.01::DOUBLE), false) AS near FROM r GROUP BY location_name)
SELECT sum(o)::BIGINT AS census, coalesce(sum(n) FILTER (near), 0)::BIGINT AS proxy, coalesce(sum(n - o) FILTER (near), 0)::BIGINT AS charged_not_on, coalesce(sum(o) FILTER (NOT near), 0)::BIGINT AS missed,
  coalesce(sum(o) FILTER (location_name IS DISTINCT FROM 'Unknown' AND o > 0 AND real > 0), 0)::BIGINT AS repairable_rows, count(*) FILTER (location_name IS DISTINCT FROM 'Unknown' AND o > 0 AND real > 0) AS repairable_names FROM b""",
    ),
    "bucket_samples": (
        lambda s, d: archive.bottom_k(bucketed(s, d), "bucket", "id", 30),
        f"""WITH {MSG}, m AS (SELECT *, {STRIPPED} AS s, lower({STRIPPED}) AS low FROM msg), b AS (SELECT id, CASE WHEN status <> 'ok' THEN 'unmeasured' WHEN ({NOISE_SQL}) THEN 'noise' WHEN severity < 3 THEN 'low' ELSE 'stored' END AS bucket FROM m),
r AS (SELECT id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY md5('0:' || id), id) AS place FROM b) SELECT * FROM r WHERE place <= 30""",
    ),
    "toll_samples": (toll_samples, None),
}
