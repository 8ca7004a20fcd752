"""Feed, guards, repairs, text, linking and folding over the derived events, messages and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import values as V
from tidewatch.functions.geo import is_located
from tidewatch.operators import feed, guards, linking, places
from tidewatch.plans import substrate as S
from tidewatch.plans.substrate import EV, MSG, REP

COLS = ["id", "ts", "user_id", "event_type", "value"]
SQLCOLS = "id, ts, user_id, event_type, value"


def lst(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


NOISE_SQL = f"""length(s) < 30 OR len(regexp_split_to_array(s, '\\s+')) < 8 OR {" OR ".join(f"contains(low, '{p.replace("'", "''")}')" for p in V.NOISE_PHRASES)}
  OR (len(regexp_split_to_array(s, '\\s+')) <= 25 AND ({" OR ".join(f"rtrim(regexp_extract(low, '^(\\S+)', 1), '.,!?') = '{p}' OR starts_with(rtrim(regexp_replace(regexp_extract(low, '^(\\S+(?:\\s+\\S+)?)', 1), '\\s+', ' ', 'g'), '.,!?'), '{p}')" for p in V.COMMENTARY_STARTERS)}))"""
STRIPPED = "regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')"
WORDS = "list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\s+'), lambda w: length(w) > 2))"


def phrases(spark, d):
    """First three words of each benchmark item, as keys: ASCII letters only."""
    return S.read(spark, d, "benchmark").select(F.lower(F.regexp_extract("text", r"^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)", 1)).alias("key"), F.col("item_id").alias("pos")).filter("key <> ''").groupBy("key").agg(F.min("pos").alias("pos"))


PHR = "phr AS (SELECT key, min(pos) AS pos FROM (SELECT lower(regexp_extract(text, '^([A-Za-z]+ [A-Za-z]+ [A-Za-z]+)', 1)) AS key, item_id AS pos FROM benchmark) WHERE key <> '' GROUP BY key)"

#: RE2's \b knows ASCII alone and would find "zu den" in "zu denüau".
SPELLED = "'(?i)(?:^|[^\\p{L}\\p{M}\\p{N}_])(' || key || ')(?:$|[^\\p{L}\\p{M}\\p{N}_])'"


#: What a spelled phrase cannot do without, cheap to test: its letters, or one of the signs that fold to ASCII letters.
NEAR = "(contains(lower(text), key) OR regexp_matches(text, '[İſK]'))"


def noise_flags(spark, d):
    return S.messages(spark, d).select("id", T.is_noise(F.col("text")).alias("noise"))


def greedy_clusters(spark, d):
    return linking.leaders(S.messages(spark, d))


def merge_fold(spark, d):
    return linking.fold(S.reports(spark, d))


PAIRS_SQL = f"""w AS (SELECT id, ts, event_type, {WORDS} AS ws FROM msg),
pr AS (SELECT a.id AS probe_id, b.id AS id, b.ts AS ts FROM w a JOIN w b ON a.event_type = b.event_type AND b.id < a.id AND abs(date_diff('second', a.ts, b.ts)) <= 900
  WHERE 5 * len(list_intersect(a.ws, b.ws)) > 2 * len(list_distinct(list_concat(a.ws, b.ws))))"""

DEG = "sin(radians(b.lat - a.lat) / 2) * sin(radians(b.lat - a.lat) / 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) * sin(radians(b.lon - a.lon) / 2)"
NEAR_SQL = f"""nr AS (SELECT a.id AS probe_id, b.id AS id, b.ts AS ts, a.lat IS NOT NULL AS located FROM ev a JOIN ev b ON a.event_type = b.event_type AND b.id < a.id
  AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 900000000 AND (a.lat IS NULL) = (b.lat IS NULL)
  WHERE a.lat IS NULL OR 2 * 6371.0 * asin(sqrt(least({DEG}, 1.0))) <= 50)"""

FOLD_SQL = f"""WITH RECURSIVE {REP}, f AS (
  SELECT event_id, seq, CASE WHEN channel <> '' THEN [channel] ELSE []::VARCHAR[] END AS names, coalesce(reliability, 1) AS rel FROM rep WHERE seq = 0
  UNION ALL SELECT r.event_id, r.seq, n.names, least(5, greatest(f.rel, coalesce(r.reliability, 1)) + CASE WHEN len(n.names) >= 3 THEN 1 ELSE 0 END)
  FROM f JOIN rep r ON r.event_id = f.event_id AND r.seq = f.seq + 1, LATERAL (SELECT CASE WHEN r.channel <> '' THEN list_distinct(list_append(f.names, r.channel)) ELSE f.names END AS names) n),
l AS (SELECT event_id, arg_max(rel, seq) AS reliability, arg_max(len(names), seq) AS n_channels FROM f GROUP BY event_id),
g AS (SELECT event_id, count(*) AS report_count, CASE WHEN arg_min(coalesce(status, ''), seq) = 'ok' THEN max(severity) ELSE max(severity) FILTER (seq = 0) END AS severity FROM rep GROUP BY event_id)
SELECT event_id, report_count, severity, n_channels, reliability FROM g JOIN l USING (event_id)"""

COMPAT_SQL = f"""WITH RECURSIVE {REP}, f AS (
  SELECT event_id, seq, channel AS channels FROM rep WHERE seq = 0
  UNION ALL SELECT r.event_id, r.seq, CASE WHEN r.channel = '' OR contains(f.channels, r.channel) THEN f.channels WHEN f.channels = '' THEN r.channel ELSE f.channels || ', ' || r.channel END
  FROM f JOIN rep r ON r.event_id = f.event_id AND r.seq = f.seq + 1)
SELECT event_id, arg_max(channels, seq) AS channels FROM f GROUP BY event_id"""

#: Message after message in order of id, with the list of those that lead so far.
LEAD_SQL = f"""{MSG}, {PAIRS_SQL}, m AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS n FROM msg), c AS MATERIALIZED (SELECT probe_id, list(id ORDER BY ts DESC, id DESC) AS likes FROM pr GROUP BY probe_id),
ld AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::BIGINT[] AS leads
  UNION ALL SELECT n, id, coalesce(l, id), CASE WHEN l IS NULL THEN list_append(leads, id) ELSE leads END
  FROM (SELECT m.n, m.id, ld.leads, list_filter(coalesce(c.likes, []::BIGINT[]), lambda x: list_contains(ld.leads, x))[1] AS l FROM ld JOIN m ON m.n = ld.n + 1 LEFT JOIN c ON c.probe_id = m.id))"""
LINKED_SQL = FOLD_SQL.replace(REP, f"{LEAD_SQL}, rep AS (SELECT leader AS event_id, row_number() OVER (PARTITION BY leader ORDER BY ld.id) - 1 AS seq, channel, reliability, severity, status FROM ld JOIN msg ON msg.id = ld.id)")

ENTRIES = {
    "feed_latest": (lambda s, d: feed.latest(S.events(s, d)).select(*COLS), f"WITH {EV} SELECT {SQLCOLS} FROM ev ORDER BY ts DESC, id DESC LIMIT 50"),
    "feed_by_type": (lambda s, d: feed.latest(S.events(s, d), 200, event_type="click").select(*COLS), f"WITH {EV} SELECT {SQLCOLS} FROM ev WHERE event_type = 'click' ORDER BY ts DESC, id DESC LIMIT 200"),
    "feed_window": (lambda s, d: feed.latest(S.events(s, d), 500, after="2024-01-05", before="2024-01-12").select(*COLS), f"WITH {EV} SELECT {SQLCOLS} FROM ev WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12' ORDER BY ts DESC, id DESC LIMIT 500"),
    "feed_min_reliability": (lambda s, d: feed.latest(S.events(s, d), 100, min_reliability=4).select(*COLS, "reliability"), f"WITH {EV} SELECT {SQLCOLS}, reliability FROM ev WHERE reliability >= 4 ORDER BY ts DESC, id DESC LIMIT 100"),
    "feed_merged_top": (
        lambda s, d: feed.merged_top(S.events(s, d).filter("k < 60").select(*COLS), S.events(s, d).filter("k > 40").select(*COLS)),
        f"WITH {EV} SELECT {SQLCOLS} FROM (SELECT {SQLCOLS} FROM ev WHERE k < 60 UNION SELECT {SQLCOLS} FROM ev WHERE k > 40) ORDER BY ts DESC, id DESC LIMIT 200",
    ),
    "feed_time_range": (lambda s, d: feed.time_range(S.events(s, d)), f"WITH {EV} SELECT min(ts) AS first_ts, max(ts) AS last_ts FROM ev"),
    "event_by_id": (lambda s, d: feed.by_id(S.events(s, d), 77).select(*COLS, "severity", "lat", "lon"), f"WITH {EV} SELECT {SQLCOLS}, severity, lat, lon FROM ev WHERE id = 77"),
    "geo_stats": (lambda s, d: feed.location_stats(S.events(s, d)), f"WITH {EV} SELECT count(*) AS total, count(lat) AS located, count(*) - count(lat) AS unlocated, count(lat)::DOUBLE / count(*) AS ratio FROM ev"),
    "extraction_by_status": (lambda s, d: feed.counts(S.events(s, d), F.col("extraction_status")), f"WITH {EV} SELECT coalesce(extraction_status, 'null') AS value, count(*) AS n FROM ev GROUP BY 1"),
    "extraction_by_geo": (lambda s, d: feed.counts(S.events(s, d), F.col("is_geolocated")), f"WITH {EV} SELECT coalesce(CAST(is_geolocated AS VARCHAR), 'null') AS value, count(*) AS n FROM ev GROUP BY 1"),
    "untagged_by_source": (
        lambda s, d: feed.counts(S.events(s, d).filter("extraction_status is null"), F.nullif(F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("event_type")), F.lit(""))),
        f"WITH {EV} SELECT coalesce(nullif(CASE WHEN user_id % 10 = 0 THEN '' ELSE event_type END, ''), 'null') AS value, count(*) AS n FROM ev WHERE extraction_status IS NULL GROUP BY 1",
    ),
    "located_split": (
        lambda s, d: S.events(s, d).agg(F.count_if(is_located(F.col("lat"), F.col("lon"), F.col("is_geolocated"))).alias("client"), F.count("lat").alias("server"), F.count_if(F.col("extraction_status").isNotNull() & (F.col("extraction_status") != "ok")).alias("failed")),
        f"WITH {EV} SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL AND is_geolocated IS DISTINCT FROM false) AS client, count(lat) AS server, count(*) FILTER (extraction_status <> 'ok') AS failed FROM ev",
    ),
    "category_fold": (
        lambda s, d: S.events(s, d).groupBy(F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("category")).agg(F.count("*").alias("n")),
        f"WITH {EV} SELECT CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS category, count(*) AS n FROM ev GROUP BY 1",
    ),
    "purge_before": (
        lambda s, d: guards.purge(S.events(s, d), S.events(s, d).selectExpr("id as event_id"), "2024-01-15")[0].select(*COLS),
        f"WITH {EV} SELECT {SQLCOLS} FROM ev WHERE ts >= TIMESTAMP '2024-01-15'",
    ),
    "purge_reports": (
        lambda s, d: guards.purge(S.events(s, d), S.reports(s, d), "2024-01-15")[1].select("event_id", "seq", "channel"),
        f"WITH {EV}, {REP} SELECT event_id, seq, channel FROM rep WHERE event_id IN (SELECT id FROM ev WHERE ts >= TIMESTAMP '2024-01-15')",
    ),
    "exact_dedup_keep_first": (
        lambda s, d: guards.keep_first(S.read(s, d, "documents").select("doc_id", "source", "text"), ["source", "text"], "doc_id").select("doc_id", "source"),
        "SELECT min(doc_id) AS doc_id, source FROM documents GROUP BY source, text",
    ),
    "report_backfill_missing": (
        lambda s, d: guards.first_reports(S.read(s, d, "orders").selectExpr("o_orderkey as id", "o_orderstatus as channel"), S.reports(s, d).filter("channel like 'R%'")).selectExpr("id as event_id", "channel"),
        f"WITH {REP} SELECT o_orderkey AS event_id, o_orderstatus AS channel FROM orders WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.event_id = o_orderkey AND rep.channel LIKE 'R%')",
    ),
    "guard_unseen_messages": (
        lambda s, d: guards.unseen(S.channel_messages(s, d), S.channel_messages(s, d).filter("(channel + message_id) % 3 = 0"), "channel", "message_id").select("channel", "message_id", "role"),
        "SELECT conv_id AS channel, turn AS message_id, role FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations o WHERE (o.conv_id + o.turn) % 3 = 0 AND o.conv_id = c.conv_id AND o.turn = c.turn)",
    ),
    "guard_unseen_urls": (
        lambda s, d: guards.unseen(S.read(s, d, "pages").select("page_id", "url"), S.read(s, d, "pages").filter("page_id % 2 = 0").select("url"), "url").select("page_id", T.url_key(F.col("url")).alias("url_key")),
        "SELECT page_id, substr(sha256(url), 1, 16) AS url_key FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)",
    ),
    "checkpoint_max": (lambda s, d: guards.checkpoints(S.channel_messages(s, d)), "SELECT conv_id AS channel, max(turn) AS last_message_id, arg_max(turn, turn) AS last_seen FROM conversations GROUP BY conv_id"),
    "key_violations": (lambda s, d: guards.key_violations(S.channel_messages(s, d).withColumn("message_id", F.floor(F.col("message_id") / 2))), "SELECT conv_id AS channel, turn // 2 AS message_id, count(*) AS n FROM conversations GROUP BY 1, 2 HAVING count(*) > 1"),
    "registry_join": (
        lambda s, d: S.read(s, d, "supplier").join(S.registry(s, d).withColumnRenamed("name", "channel_name"), F.col("s_nationkey") == F.col("handle"), "left").select("s_suppkey", "channel_name", "reliability", "affiliation"),
        "SELECT s_suppkey, n_name AS channel_name, 1 + n_nationkey % 5 AS reliability, r_name AS affiliation FROM supplier LEFT JOIN (nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey",
    ),
    "active_channels": (lambda s, d: S.registry(s, d).filter((F.col("reliability") >= 3) & ~F.col("affiliation").isin("ASIA")), "SELECT n_nationkey AS handle, n_name AS name, 1 + n_nationkey % 5 AS reliability, r_name AS affiliation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE 1 + n_nationkey % 5 >= 3 AND r_name NOT IN ('ASIA')"),
    "noise_flags": (noise_flags, f"WITH s AS (SELECT doc_id AS id, {STRIPPED} AS s FROM documents), l AS (SELECT id, s, lower(s) AS low FROM s) SELECT id, ({NOISE_SQL}) AS noise FROM l"),
    "keyword_relevant": (
        lambda s, d: S.messages(s, d).select("id", T.is_relevant(F.col("channel"), F.col("text")).alias("relevant")),
        f"SELECT doc_id AS id, {' OR '.join(f"contains(lower(coalesce(source, '') || ' ' || coalesce(text, '')), '{k}')" for k in V.CONFLICT_KEYWORDS)} AS relevant FROM documents",
    ),
    "severity_gate": (lambda s, d: S.messages(s, d).filter(~T.low_severity(F.col("severity"))).select("id", "severity"), f"WITH {MSG} SELECT id, severity FROM msg WHERE severity IS NULL OR severity >= 3"),
    "word_sets": (lambda s, d: S.messages(s, d).select("id", F.size(T.word_set(F.col("text"))).alias("words")), f"SELECT doc_id AS id, len({WORDS})::INT AS words FROM documents"),
    "jaccard_pairs": (lambda s, d: linking.similar_pairs(S.messages(s, d)).select("probe_id", "id"), f"WITH {MSG}, {PAIRS_SQL} SELECT probe_id, id FROM pr"),
    "dup_candidates": (
        lambda s, d: linking.candidates(S.events(s, d), S.events(s, d)),
        f"WITH {EV}, {NEAR_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY probe_id ORDER BY ts DESC, id DESC) AS rank FROM nr) SELECT probe_id, id, rank::INT AS rank FROM rk WHERE rank <= CASE WHEN located THEN 20 ELSE 200 END",
    ),
    "greedy_clusters": (greedy_clusters, f"WITH RECURSIVE {LEAD_SQL} SELECT id, leader FROM ld WHERE n > 0"),
    "linked_events": (lambda s, d: linking.linked_events(S.messages(s, d)), LINKED_SQL),
    "merge_fold_reliability": (merge_fold, FOLD_SQL),
    "merge_fold_count_sev": (
        lambda s, d: linking.fold(S.reports(s, d)).select("event_id", "report_count", "severity"),
        f"WITH {REP} SELECT event_id, count(*) AS report_count, CASE WHEN arg_min(coalesce(status, ''), seq) = 'ok' THEN max(severity) ELSE max(severity) FILTER (seq = 0) END AS severity FROM rep GROUP BY event_id",
    ),
    "distinct_named_channels": (lambda s, d: S.reports(s, d).filter("channel <> ''").groupBy("event_id").agg(F.countDistinct("channel").alias("n")), f"WITH {REP} SELECT event_id, count(DISTINCT channel) AS n FROM rep WHERE channel <> '' GROUP BY event_id"),
    "channel_append_compat": (lambda s, d: linking.channel_list(S.reports(s, d)), COMPAT_SQL),
    "channel_append_set": (
        lambda s, d: linking.channel_list(S.reports(s, d), compat=False),
        f"WITH {REP}, f AS (SELECT event_id, channel, min(seq) AS seq FROM rep WHERE channel <> '' GROUP BY 1, 2) SELECT e.event_id, coalesce(string_agg(channel, ', ' ORDER BY f.seq), '') AS channels FROM (SELECT DISTINCT event_id FROM rep) e LEFT JOIN f ON f.event_id = e.event_id GROUP BY e.event_id",
    ),
    "evidence_span": (
        lambda s, d: places.spelled(S.texts(s, d).select("id", "text"), phrases(s, d)),
        f"WITH {PHR}, hit AS (SELECT doc_id AS id, pos, CASE WHEN {NEAR} THEN regexp_extract(text, {SPELLED}, 1) ELSE '' END AS span FROM documents, phr) SELECT id, pos, span FROM hit WHERE span <> ''",
    ),
    "evidence_hits": (
        lambda s, d: places.spelled(S.texts(s, d).select("id", "text"), phrases(s, d)).groupBy("id").agg(F.count("*").alias("spans"), F.countDistinct("pos").alias("phrases")),
        f"WITH {PHR}, hit AS (SELECT doc_id AS id, pos, CASE WHEN {NEAR} THEN regexp_extract(text, {SPELLED}, 1) ELSE '' END AS span FROM documents, phr) SELECT id, count(*) AS spans, count(DISTINCT pos) AS phrases FROM hit WHERE span <> '' GROUP BY id",
    ),
    "severity_trend": (
        lambda s, d: feed.severity_trend(S.events(s, d), "event_type"),
        f"""WITH {EV}, t AS (SELECT event_type, id, round(avg(severity) OVER (PARTITION BY event_type ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS trend FROM ev)
SELECT event_type, id, trend, CASE WHEN trend IS NULL THEN 'UNMEASURED' WHEN trend <= 3 THEN 'LOW' WHEN trend <= 6 THEN 'ELEVATED' WHEN trend <= 8 THEN 'HIGH' ELSE 'CRITICAL' END AS band FROM t""",
    ),
    "reply_validation": (
        lambda s, d: S.events(s, d).select("id", T.reply_fields(F.concat(F.lit('{"event_type":"cyber","severity":'), F.col("k").cast("string"), F.lit(',"location_name":"IDF","summary":"x"}'))).alias("r")).select("id", "r.status", "r.severity", "r.location_name"),
        f"WITH {EV} SELECT id, CASE WHEN k BETWEEN 1 AND 10 THEN 'ok' ELSE 'parse_failed' END AS status, CASE WHEN k BETWEEN 1 AND 10 THEN k END AS severity, CASE WHEN k BETWEEN 1 AND 10 THEN 'Unknown' END AS location_name FROM ev",
    ),
    "sentinel_retired": (
        lambda s, d: guards.retire_sentinel(S.events(s, d).withColumn("lat", F.when(F.col("k") == 3, V.SENTINEL_LAT).otherwise(F.col("lat"))).withColumn("lon", F.when(F.col("k") == 3, V.SENTINEL_LON).otherwise(F.col("lon")))).select("id", "lat", "lon", "is_geolocated"),
        f"WITH {EV} SELECT id, CASE WHEN k <> 3 THEN lat END AS lat, CASE WHEN k <> 3 THEN lon END AS lon, CASE WHEN k = 3 THEN false ELSE is_geolocated END AS is_geolocated FROM ev",
    ),
}
