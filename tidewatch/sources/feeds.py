"""Readers of landed feed payloads: articles, aircraft, vessels, sensor series, orbital elements, table dumps.

Transport (polling, sockets) lands raw payloads as files; these functions turn rows of payloads into tables, in batch
or as the body of a stream. What cannot be read yields no rows or a status, never an invented value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions.geo import truthy

ITEM = "title STRING, description STRING, summary STRING, link STRING, guid STRING, pubDate STRING, published STRING, updated STRING"


def articles(payloads: DataFrame) -> DataFrame:
    """payloads: source, xml. RSS items, or Atom entries where there is no channel: source, title, description, url,
    published, published_missing. Items without a url are dropped, and documents that do not parse give nothing."""
    is_rss = F.contains("xml", F.lit("<channel"))
    tag = F.when(is_rss, "item").otherwise("entry")
    blocks = F.call_function("regexp_extract_all", F.col("xml"), F.concat(F.lit("(?s)<"), tag, F.lit(r"[\s>].*?</"), tag, F.lit(">")), F.lit(0))
    item = payloads.select("source", is_rss.alias("rss"), F.explode(blocks).alias("b"))

    def inner(name: str) -> Column:
        raw = F.regexp_extract("b", rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
        text = F.regexp_replace(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]+>", "")
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
            text = F.replace(text, F.lit(a), F.lit(b))
        return F.nullif(F.trim(text), F.lit(""))

    href = F.nullif(F.regexp_extract("b", r"<link[^>]*href=[\"']([^\"']+)", 1), F.lit(""))
    when = F.coalesce(*[T.feed_time(inner(n)) for n in ("pubDate", "published", "updated")])
    out = item.select("source", inner("title").alias("title"), F.coalesce(inner("description"), inner("summary")).alias("description"), F.coalesce(inner("link"), href).alias("url"), when.alias("published"))
    return out.filter("url is not null").withColumn("published_missing", F.col("published").isNull())


ADSB = "hex STRING, flight STRING, r STRING, lat DOUBLE, lon DOUBLE, alt_geom STRING, alt_baro STRING, gs DOUBLE, track DOUBLE, true_heading DOUBLE, nac_p INT, nic INT"


def aircraft_objects(payloads: DataFrame) -> DataFrame:
    """payloads: json with a list of objects under ac. Positions only; zero counts as absent where a fallback exists."""
    a = payloads.select(F.explode(F.from_json("json", f"ac ARRAY<STRUCT<{ADSB.replace(' STRING', ': STRING').replace(' DOUBLE', ': DOUBLE').replace(' INT', ': INT')}>>")["ac"]).alias("a")).select("a.*")
    geom, baro = F.col("alt_geom").try_cast("double"), F.col("alt_baro").try_cast("double")
    return a.filter("lat is not null and lon is not null").select(
        F.col("hex").alias("icao24"), F.trim("flight").alias("callsign"), "lon", "lat", truthy(geom, baro).alias("altitude"), F.lit("ft").alias("altitude_unit"), F.col("gs").alias("velocity"), truthy(F.col("track"), F.col("true_heading")).alias("heading"),
        F.coalesce(F.col("alt_baro") == "ground", F.lit(False)).alias("on_ground"), "nac_p", "nic",
    )


def aircraft_arrays(payloads: DataFrame) -> DataFrame:
    """payloads: json with positional arrays under states (metres; no integrity figures)."""
    s = payloads.select(F.explode(F.from_json("json", "states ARRAY<ARRAY<STRING>>")["states"]).alias("s"))
    at = lambda i: F.get("s", F.lit(i))
    num = lambda i: at(i).try_cast("double")
    null = F.lit(None).cast("int")
    return s.select(
        at(0).alias("icao24"), F.trim(at(1)).alias("callsign"), num(5).alias("lon"), num(6).alias("lat"), truthy(num(7), num(13)).alias("altitude"), F.lit("m").alias("altitude_unit"), num(9).alias("velocity"), num(10).alias("heading"),
        F.coalesce(at(8).try_cast("boolean"), F.lit(False)).alias("on_ground"), null.alias("nac_p"), null.alias("nic"),
    ).filter("lat is not null and lon is not null")


def first_answer(*sources: DataFrame) -> DataFrame:
    """Rows of the first source (in order) that has any; empty if none has."""
    tagged = [s.withColumn("_p", F.lit(i)) for i, s in enumerate(sources)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    best = rows.agg(F.min("_p").alias("_p"))
    return rows.join(F.broadcast(best), "_p", "left_semi").drop("_p")


def vessel_messages(payloads: DataFrame) -> DataFrame:
    """payloads: json, seen. Position and static messages in one shape; fields of the other type are null."""
    v = F.try_parse_json("json")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    kind = get("$.MessageType", "string")
    body = lambda p, s, t: F.coalesce(get(f"$.Message.PositionReport.{p}", t) if p else F.lit(None), get(f"$.Message.ShipStaticData.{s}", t) if s else F.lit(None))
    return payloads.select(
        get("$.MetaData.MMSI", "string").alias("mmsi"), kind.alias("msg_type"), F.trim(get("$.MetaData.ShipName", "string")).alias("ship_name"), get("$.MetaData.latitude", "double").alias("lat"), get("$.MetaData.longitude", "double").alias("lon"),
        body("Sog", None, "double").alias("sog"), body("TrueHeading", None, "double").alias("true_heading"), body("Cog", None, "double").alias("cog"), body("NavigationalStatus", None, "int").alias("nav_status"),
        body(None, "Type", "int").alias("type"), body(None, "Destination", "string").alias("destination"), body(None, "Dimension.A", "int").alias("dim_a"), body(None, "Dimension.B", "int").alias("dim_b"), F.col("seen").alias("ts"),
    ).filter("mmsi is not null and msg_type in ('PositionReport', 'ShipStaticData')")


def series_samples(series: DataFrame) -> tuple[DataFrame, DataFrame]:
    """series: code, datasource, from, step, values, fetch_status. The series with what is known of them, and their
    samples in long form; a value that is null, NaN or infinite is a sample that was not measured."""
    known = series.select("code", "datasource", "step", (F.col("fetch_status") == "ok").alias("fetched"))
    usable = series.filter("step > 0 and from is not null").select("code", "datasource", "from", "step", F.posexplode("values"))
    return known, usable.select("code", "datasource", (F.col("from") + F.col("pos") * F.col("step")).alias("t"), F.col("col").alias("v"))


def annotations(payloads: DataFrame, *keep: str) -> DataFrame:
    """payloads: json with outages under annotations: one row each, ongoing when it has no end, beside the columns to keep.
    A payload that is null or does not read has none."""
    one = "id: STRING, locations: ARRAY<STRING>, eventType: STRING, startDate: STRING, endDate: STRING, outage: STRUCT<outageCause: STRING, outageType: STRING>, scope: STRING, asns: ARRAY<BIGINT>"
    a = payloads.select(*keep, F.explode(F.from_json("json", f"annotations ARRAY<STRUCT<{one}>>")["annotations"]).alias("a")).select(*keep, "a.*")
    return a.select(*keep, "id", "locations", F.col("eventType").alias("event_type"), F.col("startDate").alias("start"), F.col("endDate").alias("end"), F.col("endDate").isNull().alias("ongoing"), F.col("outage.outageCause").alias("cause"), "scope", "asns")


def attack_targets(payloads: DataFrame, *keep: str) -> DataFrame:
    """payloads: json with the places that most attack traffic went to under top_0: one row each with its share, beside what the
    share is of. The share is null where none was given, never 0."""
    one = "targetCountryAlpha2: STRING, targetCountryName: STRING, value: STRING, rank: INT"
    j = payloads.select(*keep, F.from_json("json", f"meta STRUCT<units: STRING, normalization: STRING, lastUpdated: STRING>, top_0 ARRAY<STRUCT<{one}>>").alias("j"))
    t = j.select(*keep, "j.meta", F.explode("j.top_0").alias("t"))
    return t.select(*keep, F.col("t.targetCountryAlpha2").alias("code"), F.col("t.targetCountryName").alias("name"), F.col("t.value").try_cast("double").alias("share"), F.col("t.rank").alias("rank"), F.col("meta.units").alias("units"), F.col("meta.normalization").alias("normalization"), F.col("meta.lastUpdated").alias("last_updated"))


def orbital_elements(lines: DataFrame) -> DataFrame:
    """lines: document, text. Name, line 1 and line 2 of each group of three lines that starts as it should."""
    rows = lines.select("document", F.posexplode(F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")))
    g = rows.groupBy("document", F.floor(F.col("pos") / 3).alias("n")).agg(*[F.max(F.when(F.col("pos") % 3 == i, F.trim("col"))).alias(c) for i, c in enumerate(("name", "line1", "line2"))])
    return g.filter(F.col("line1").startswith("1 ") & F.col("line2").startswith("2 ")).select("document", "n", "name", "line1", "line2")


def seen_before(now: DataFrame, cached: DataFrame, key: str, max_age_s: int = 21_600) -> DataFrame:
    """Rows of now whose key the cache (key, fetched_at) holds no younger than max_age_s."""
    fresh = cached.filter(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("fetched_at") < max_age_s)
    return now.join(fresh.select(key).distinct(), key, "left_anti")


def newest_per(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")
