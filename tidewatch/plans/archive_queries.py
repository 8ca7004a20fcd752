"""Archive measurements, sampling, page and wave parsing, and event-time windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.operators import archive
from tidewatch.plans import substrate as S
from tidewatch.plans.event_queries import NOISE_SQL, STRIPPED
from tidewatch.plans.substrate import EV, MSG
from tidewatch.sources import pages, waves


def rate_sql(source: str, key: str, hit: str, name: str) -> str:
    p = "(hits::DOUBLE / n)"
    half = f"1.96::DOUBLE * sqrt({p} * (1 - {p}) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n)"
    centre = f"({p} + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n)"
    return f"""WITH {source}, r AS (SELECT {key} AS {name}, count(*) AS n, count(*) FILTER ({hit}) AS hits FROM {source.split(' ')[0]} GROUP BY 1)
SELECT {name}, n, hits, round({p}, 9) AS rate, round(greatest({centre} - {half}, 0), 9) AS lo, round(least({centre} + {half}, 1), 9) AS hi FROM r"""


def located(s, d):
    return S.events(s, d).filter("lat is not null").select("event_type", F.floor("lat").alias("lat"), F.floor("lon").alias("lon"), "id")


def sampled(s, d):
    """Every third event of a user as a sample of the population of events by type."""
    return S.events(s, d).filter("id % 3 = 0").select(F.col("event_type").alias("stratum"), (F.col("k") % 4 == 0).alias("hit"))


def wave_rows(s, d):
    return S.events(s, d).select("id", waves.sample_json(F.col("id"), F.col("k")).alias("json"))


def wave_files(s, d):
    """Events as documents of one wave each, in one of four envelopes; two share a wave number."""
    stated = F.when(F.col("k") % 3 != 0, F.struct(F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon")))
    time = F.when(F.col("k") % 7 == 0, "").when(F.col("k") % 7 == 1, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    wave = F.to_json(F.struct(F.floor(F.col("id") / 2).alias("wave_number"), F.struct(time.alias("announced_utc")).alias("timing"), F.struct(stated.alias("target_coordinates")).alias("targets")))
    whole = [F.concat(F.lit(a), wave, F.lit(b)) for a, b in (("[", "]"), ('{"meta": [1], "waves": [', "]}"), ('{"waves": [], "data": [', "]}"), ('{"meta": [{"n": 1}], "found": [', "]}"))]
    return S.events(s, d).select(F.col("id").alias("document"), F.get(F.array(*whole), F.col("k") % 4).alias("json"))


def waves_judged(s, d):
    stored = S.events(s, d).filter("k % 10 = 0").select(F.concat(F.lit("waves#"), F.floor(F.col("id") / 2)).alias("source_url"))
    return waves.judged(wave_files(s, d), stored, "waves#")


WAVES = f"""{EV}, w AS (SELECT id, id // 2 AS n, ts, CASE WHEN k % 3 = 0 THEN 'no_position' WHEN k % 7 = 0 THEN 'no_time' WHEN k % 7 = 1 THEN 'bad_time' ELSE 'imported' END AS why FROM ev),
f AS (SELECT n, min(id) FILTER (why = 'imported') AS first FROM w GROUP BY n), st AS (SELECT DISTINCT id // 2 AS n FROM ev WHERE k % 10 = 0),
j AS (SELECT id AS document, 'waves#' || w.n AS source_url, CASE WHEN st.n IS NOT NULL OR coalesce(id > first, false) THEN 'existing' ELSE why END AS status, ts FROM w LEFT JOIN f ON f.n = w.n LEFT JOIN st ON st.n = w.n)"""


def sessions(s, d):
    """Runs of a user's events with gaps under 12 hours."""
    e = S.events(s, d).select("user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "12 hours")).agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


ENTRIES = {
    "source_rates": (lambda s, d: archive.rates(S.events(s, d), F.col("event_type"), F.col("extraction_status") == "ok", "event_type"), rate_sql(EV, "event_type", "extraction_status = 'ok'", "event_type")),
    "wilson_rates": (lambda s, d: archive.rates(S.events(s, d), F.col("user_id"), F.col("k") == 7, "user_id"), rate_sql(EV, "user_id", "k = 7", "user_id")),
    "severity_histogram": (
        lambda s, d: S.events(s, d).groupBy("severity").agg(F.count_if(F.col("extraction_status") == "ok").alias("ok"), F.count_if((F.col("extraction_status") == "ok") & ~T.low_severity(F.col("severity"))).alias("stored")),
        f"WITH {EV} SELECT severity, count(*) FILTER (extraction_status = 'ok') AS ok, count(*) FILTER (extraction_status = 'ok' AND (severity IS NULL OR severity >= 3)) AS stored FROM ev GROUP BY 1",
    ),
    "stored_funnel": (
        lambda s, d: archive.funnel(S.messages(s, d), F.col("status") == "ok", T.is_noise(F.col("text")), T.low_severity(F.col("severity"))),
        f"WITH {MSG}, m AS (SELECT *, {STRIPPED} AS s, lower({STRIPPED}) AS low FROM msg), f AS (SELECT status, severity, ({NOISE_SQL}) AS noise FROM m) SELECT count(*) AS read, count(*) FILTER (status = 'ok') AS measured, count(*) FILTER (status = 'ok' AND NOT noise) AS not_noise, count(*) FILTER (status = 'ok' AND NOT noise AND (severity IS NULL OR severity >= 3)) AS stored FROM f",
    ),
    "mode_coordinate": (
        lambda s, d: archive.modal_position(located(s, d), "event_type", "id"),
        f"""WITH {EV}, a AS (SELECT event_type, CAST(floor(lat) AS BIGINT) AS lat, CAST(floor(lon) AS BIGINT) AS lon, count(*) AS n, min(id) AS first FROM ev WHERE lat IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, first) AS rn FROM a)
SELECT event_type, CAST(sum(n) AS BIGINT) AS total, count(*) AS positions, max(n) AS at_mode, max(lat) FILTER (rn = 1) AS lat, max(lon) FILTER (rn = 1) AS lon FROM r GROUP BY 1""",
    ),
    "count_distribution": (lambda s, d: archive.distribution(S.reports(s, d), "event_id", "report_count"), "SELECT report_count, count(*) AS keys FROM (SELECT l_orderkey, count(DISTINCT l_linenumber) AS report_count FROM lineitem GROUP BY 1) GROUP BY 1"),
    "cumulative_share": (
        lambda s, d: archive.cumulative(S.events(s, d), "user_id", "event_type"),
        f"WITH {EV}, c AS (SELECT event_type, user_id, count(*) AS n FROM ev GROUP BY 1, 2) SELECT event_type, user_id, n, round(sum(n) OVER (PARTITION BY event_type ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING)::DOUBLE / sum(n) OVER (PARTITION BY event_type), 9) AS cumulative FROM c",
    ),
    "id_window_overlap": (
        lambda s, d: archive.id_overlaps(S.channel_messages(s, d)),
        """WITH s AS (SELECT conv_id AS channel, min(turn) AS lo, max(turn) AS hi, count(*) AS n FROM conversations GROUP BY 1 ORDER BY n DESC, channel LIMIT 8), i AS (SELECT DISTINCT conv_id AS channel, turn AS m FROM conversations WHERE conv_id IN (SELECT channel FROM s)),
p AS (SELECT a.channel AS a, b.channel AS b, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM s a JOIN s b ON a.channel < b.channel)
SELECT a, b, (SELECT count(*) FROM i x JOIN i y ON x.m = y.m WHERE x.channel = a AND y.channel = b) AS shared, round((SELECT count(*) FROM i WHERE channel = a AND m BETWEEN lo AND hi) * (SELECT count(*) FROM i WHERE channel = b AND m BETWEEN lo AND hi) / (hi - lo + 1)::DOUBLE, 6) AS expected FROM p WHERE lo <= hi""",
    ),
    "sentinel_bands": (
        lambda s, d: archive.sentinel_census(S.events(s, d).selectExpr("id", "case when k % 5 = 0 then null else -25.0d + (k % 4) * (k % 3) / 100.0d end as lat", "case when k % 5 = 0 then null else 80.0d + (k % 3) * 0.5d end as lon")),
        f"""WITH {EV}, p AS (SELECT CASE WHEN k % 5 = 0 THEN NULL ELSE -25.0::DOUBLE + (k % 4) * (k % 3) / 100.0::DOUBLE END AS lat, CASE WHEN k % 5 = 0 THEN NULL ELSE 80.0::DOUBLE + (k % 3) * 0.5::DOUBLE END AS lon FROM ev), g AS (SELECT lat, abs(lat + 25.0::DOUBLE) AS y, abs(lon - 80.0::DOUBLE) AS x FROM p)
SELECT count(*) AS rows, count(lat) AS located, count(*) FILTER (greatest(x, y) = 0) AS exact, count(*) FILTER (greatest(x, y) > 0 AND greatest(x, y) <= 0.01::DOUBLE) AS near, count(*) FILTER (greatest(x, y) > 0.01::DOUBLE AND greatest(x, y) <= 1) AS band, count(*) FILTER ((y = 0) <> (x = 0)) AS half FROM g""",
    ),
    "toll_buckets": (lambda s, d: S.texts(s, d).select("channel", T.toll(F.col("text")).alias("t")).groupBy("channel", F.col("t.bucket").alias("bucket")).agg(F.count("*").alias("n"), F.sum("t.count").alias("stated")), None),
    "latency_summary": (
        lambda s, d: archive.latency(S.events(s, d), "event_type", "value"),
        f"WITH {EV}, r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ev) SELECT event_type, max(n) AS n, max(value) FILTER (i = n // 2 + 1) AS median, max(value) FILTER (i = least(n * 95 // 100, n - 1) + 1) AS p95, max(value) AS largest FROM r GROUP BY 1",
    ),
    "stratified_estimate": (
        lambda s, d: archive.stratified_estimate(sampled(s, d), S.events(s, d).groupBy(F.col("event_type").alias("stratum")).agg(F.count("*").alias("n"))),
        f"""WITH {EV}, s AS (SELECT event_type AS stratum, count(*) AS m, count(*) FILTER (k % 4 = 0) AS hits FROM ev WHERE id % 3 = 0 GROUP BY 1), n AS (SELECT event_type AS stratum, count(*) AS n FROM ev GROUP BY 1), r AS (SELECT n.n, m, n.n::DOUBLE / sum(n.n) OVER () AS w, hits::DOUBLE / m AS p FROM n JOIN s USING (stratum)),
v AS (SELECT *, CASE WHEN m > 1 THEN w * w * (1 - m::DOUBLE / n) * p * (1 - p) / (m - 1) ELSE 0 END AS v FROM r) SELECT round(sum(w * p), 9) AS estimate, round(sqrt(sum(v)), 9) AS se, bool_or(v > 0) AS has_variance FROM v""",
    ),
    "allocation": (
        lambda s, d: archive.allocation(S.events(s, d).groupBy("user_id").agg(F.count("*").alias("n")), 3000),
        f"WITH {EV}, n AS (SELECT user_id, count(*) AS n FROM ev GROUP BY 1) SELECT user_id, n, CAST(least(greatest(20, round_even(3000 * n::DOUBLE / sum(n) OVER (), 0)), n) AS BIGINT) AS draw FROM n",
    ),
    "coverage_report": (
        lambda s, d: archive.coverage(S.events(s, d), S.events(s, d).filter("k = 5"), "user_id", 2),
        f"WITH {EV}, n AS (SELECT user_id, count(*) FILTER (k = 5) AS n FROM ev GROUP BY 1) SELECT count(*) FILTER (n >= 1) AS some, count(*) FILTER (n = 0) AS none, count(*) FILTER (n = 1) AS one, count(*) FILTER (n <= 2) AS at_floor FROM n",
    ),
    "stratified_sample": (
        lambda s, d: archive.stratified_sample(S.read(s, d, "documents").select("doc_id", "source"), "source", "doc_id", 500),
        """WITH n AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
p AS (SELECT doc_id, CASE WHEN c < 0.01 * (SELECT count(*) FROM documents) THEN '(small)' ELSE d.source END AS source FROM documents d JOIN n ON n.source = d.source),
b AS (SELECT source, least(greatest(20, round_even(500 * count(*)::DOUBLE / (SELECT count(*) FROM p), 0)), count(*))::BIGINT AS draw FROM p GROUP BY source),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY substr(md5('0:' || doc_id), 1, 8), doc_id) AS i FROM p)
SELECT doc_id, r.source FROM r JOIN b ON b.source = r.source WHERE i <= draw""",
    ),
    "title_extract": (lambda s, d: S.read(s, d, "pages").select("page_id", pages.title(F.col("html")).alias("title")), "SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), ''), NULL) AS title FROM pages"),
    "url_parts": (
        lambda s, d: S.read(s, d, "pages").select("page_id", *pages.url_parts(F.col("url"))),
        "SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '') AS path, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query FROM pages",
    ),
    "json_extract_validate": (
        lambda s, d: S.read(s, d, "events").select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "int").alias("k"), F.schema_of_variant(F.try_parse_json("props")).startswith("OBJECT").alias("valid")),
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, json_type(props) = 'OBJECT' AS valid FROM events",
    ),
    "wave_severity": (
        lambda s, d: wave_rows(s, d).select("id", waves.severity(waves.parsed(F.col("json"))).alias("severity")),
        f"WITH {EV} SELECT id, least(10, 6 + CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN k > 5 THEN 1 ELSE 0 END + CASE WHEN k > 20 THEN 1 ELSE 0 END) AS severity FROM ev",
    ),
    "wave_coords": (lambda s, d: wave_rows(s, d).select("id", waves.position(waves.parsed(F.col("json"))).alias("p")).select("id", "p.lat", "p.lon"), None),
    "wave_location": (
        lambda s, d: wave_rows(s, d).select("id", waves.location(waves.parsed(F.col("json"))).alias("location")),
        f"WITH {EV} SELECT id, CASE WHEN k % 4 = 0 THEN 'Middle East' ELSE 'City ' || k END AS location FROM ev",
    ),
    "waves_imported": (
        lambda s, d: waves.imported(waves_judged(s, d)).select("document", "source_url", "lat", "lon", "severity", "location_name", F.unix_timestamp("timestamp").alias("at")),
        f"WITH {WAVES} SELECT document, source_url, 1.5::DOUBLE AS lat, 2.5::DOUBLE AS lon, 6 AS severity, 'Middle East' AS location_name, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM j WHERE status = 'imported'",
    ),
    "waves_skipped": (lambda s, d: waves_judged(s, d).groupBy("status").agg(F.count("*").alias("n")), f"WITH {WAVES} SELECT status, count(*) AS n FROM j GROUP BY status"),
    "session_activity": (
        sessions,
        """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 12 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM i GROUP BY user_id, sess""",
    ),
    "tumbling_counts": (
        lambda s, d: S.events(s, d).groupBy("event_type", F.window("ts", "6 hours")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n"),
        "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS start, count(*) AS n FROM events GROUP BY 1, 2",
    ),
    "sliding_counts": (
        lambda s, d: S.events(s, d).groupBy("event_type", F.window("ts", "12 hours", "6 hours")).agg(F.count("*").alias("n")).select("event_type", F.col("window.start").alias("start"), "n"),
        "SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(6 * o) AS start, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS o) GROUP BY 1, 2",
    ),
    "new_since": (
        lambda s, d: S.events(s, d).filter("k < 50").select("id").join(S.events(s, d).filter("k < 40").select("id"), "id", "left_anti"),
        f"WITH {EV} SELECT id FROM ev WHERE k < 50 EXCEPT SELECT id FROM ev WHERE k < 40",
    ),
    "category_rank": (
        lambda s, d: S.events(s, d).groupBy("user_id", "event_type").agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("rank = 1"),
        f"WITH {EV}, c AS (SELECT user_id, event_type, count(*) AS n FROM ev GROUP BY 1, 2) SELECT user_id, event_type, n, 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS r FROM c) WHERE r = 1",
    ),
}
