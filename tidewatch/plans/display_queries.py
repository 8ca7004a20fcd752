"""Labels, time lines and traces."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import display as D
from tidewatch.functions import geo as G
from tidewatch.operators import outage
from tidewatch.plans import substrate as S
from tidewatch.plans.substrate import EV, SMP

START, END = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def stamp(x):
    return F.lit(x).cast("timestamp")


def points(s, d):
    """Positions as hexadecimal points: whole degrees, so that the text can be written down in any engine; some broken, some null."""
    raw = F.when(F.col("k") % 10 == 0, F.lit("00")).when(F.col("k") % 11 != 0, F.lit("0101000020e6100000000000000000f03f0000000000000040"))
    return S.events(s, d).select("id", raw.alias("raw")).select("id", D.ewkb_point(F.col("raw")).alias("p")).select("id", "p.status", "p.lon", "p.lat")


ENTRIES = {
    "age_labels": (
        lambda s, d: S.events(s, d).select("id", D.age_label(F.col("k") * F.col("k")).alias("age")),
        f"""WITH {EV}, a AS (SELECT id, k * k AS s FROM ev) SELECT id, CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h' || lpad(CAST((s // 60) % 60 AS VARCHAR), 2, '0') || 'm' END AS age FROM a""",
    ),
    "uncertainty_labels": (
        lambda s, d: S.events(s, d).select("id", D.uncertainty_label(F.when(F.col("k") % 7 != 0, F.col("k") * 40)).alias("label")),
        f"WITH {EV} SELECT id, CASE WHEN k % 7 = 0 THEN 'unmeasured' WHEN k * 40 < 1000 THEN '±' || (k * 40) || 'm' ELSE '±' || CAST(floor(k * 40 / 1000.0::DOUBLE + 0.5) AS BIGINT) || 'km' END AS label FROM ev",
    ),
    "duration_labels": (
        lambda s, d: S.events(s, d).select("id", D.duration_label(F.col("ts").cast("timestamp"), stamp(END)).alias("label")),
        f"WITH {EV}, a AS (SELECT id, floor((epoch(TIMESTAMP '{END}') - floor(epoch(ts))) / 86400) AS days FROM ev) SELECT id, CASE WHEN days < 1 THEN '<1D' ELSE CAST(days AS BIGINT) || 'D' END AS label FROM a",
    ),
    "timeline_positions": (
        lambda s, d: S.events(s, d).select("id", F.round(D.clamp(D.timeline_percent(F.col("ts").cast("timestamp"), stamp(START), stamp(END)), 0.0, 100.0), 9).alias("percent")),
        f"WITH {EV} SELECT id, round(least(greatest(100 * (floor(epoch(ts)) - epoch(TIMESTAMP '{START}')) / greatest(epoch(TIMESTAMP '{END}') - epoch(TIMESTAMP '{START}'), 60), 0), 100), 9) AS percent FROM ev",
    ),
    "sparkline_runs": (
        lambda s, d: D.runs(S.samples(s, d), outage.KEY, S.STEP),
        f"WITH {EV}, {SMP}, i AS (SELECT *, t - 1800 * row_number() OVER (PARTITION BY code, datasource ORDER BY t) AS island FROM smp WHERE v IS NOT NULL) SELECT code, datasource, min(t) AS start, max(t) AS \"end\", count(*) AS n FROM i GROUP BY code, datasource, island",
    ),
    "trace_flatness": (
        lambda s, d: outage.swing(S.samples(s, d), outage.KEY).select("code", "datasource", D.flat_trace(F.col("mad"), F.col("mid"), F.col("n")).alias("flat")),
        f"WITH {EV}, {SMP}, m AS (SELECT code, datasource, count(*) AS n, median(v) AS mid FROM smp GROUP BY ALL) SELECT code, datasource, CASE WHEN n >= 4 AND mid <> 0 THEN median(abs(v - mid)) / mid <= 0.02::DOUBLE / 20 END AS flat FROM smp JOIN m USING (code, datasource) GROUP BY code, datasource, n, mid",
    ),
    "ewkb_points": (
        points,
        f"WITH {EV} SELECT id, CASE WHEN k % 10 = 0 THEN 'undecodable' WHEN k % 11 <> 0 THEN 'point' ELSE 'null' END AS status, CASE WHEN k % 10 <> 0 AND k % 11 <> 0 THEN 1.0::DOUBLE END AS lon, CASE WHEN k % 10 <> 0 AND k % 11 <> 0 THEN 2.0::DOUBLE END AS lat FROM ev",
    ),
    "headings": (
        lambda s, d: S.events(s, d).select("id", F.round(G.heading((F.col("k") % 7 - 3).cast("double"), (F.col("k") % 5 - 2).cast("double")), 6).alias("heading")),
        f"WITH {EV}, h AS (SELECT id, degrees(atan2((k % 5 - 2)::DOUBLE, (k % 7 - 3)::DOUBLE)) + 360 AS x FROM ev) SELECT id, round(CASE WHEN x >= 360 THEN x - 360 ELSE x END, 6) AS heading FROM h",
    ),
}
