"""Attack-wave documents: nested JSON with an envelope to be found, severity, summary, place and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = """wave_number INT, description STRING, escalation STRUCT<new_country_targeted: BOOLEAN, new_weapon_first_use: BOOLEAN>, impact STRUCT<fatalities: INT, injuries: INT>, weapons STRUCT<payload: STRING>,
targets STRUCT<targets: STRING, target_coordinates: STRUCT<lat: DOUBLE, lon: DOUBLE>, israeli_locations: MAP<STRING, BOOLEAN>, us_bases: ARRAY<STRUCT<country_code: STRING>>, landings_countries: ARRAY<STRING>, israel_targeted: BOOLEAN>,
timing STRUCT<announced_utc: STRING, probable_launch_time: STRING>"""

# Positions by city flag (in order of precedence) and by country.
CITY_FLAGS = {
    "targeted_tel_aviv": (32.0853, 34.7818), "targeted_jerusalem": (31.7683, 35.2137), "targeted_haifa": (32.8191, 34.9983),
    "targeted_negev_beersheba": (31.2518, 34.7913), "targeted_northern_periphery": (33.0735, 35.1215), "targeted_eilat": (29.5577, 34.9519),
}
COUNTRIES = {
    "IL": (32.0853, 34.7818), "BH": (26.2235, 50.5876), "AE": (24.4539, 54.3773), "QA": (25.1188, 51.3246), "SA": (26.3055, 50.1083), "IQ": (33.3128, 44.3615), "JO": (31.9522, 35.9310),
    "OM": (23.5880, 58.3829), "KW": (29.3759, 47.9774), "SY": (33.5102, 36.2913), "LB": (33.8938, 35.5018), "YE": (15.3694, 44.1910), "IR": (35.6892, 51.3890), "PK": (33.7290, 73.0931),
}


def parsed(json: Column) -> Column:
    return F.from_json(json, SCHEMA)


def elements(files: DataFrame) -> DataFrame:
    """files: document, json (a whole document). A row per wave: document, pos, json as written.

    A document is a list, or holds one under waves, else data, else under the first key whose list begins with a wave. Empty lists
    are passed over; a document that is none of this, is null or does not read gives no rows."""
    named = F.from_json("json", "map<string, string>")
    full = lambda x: F.when(F.size(x) > 0, x)
    listed = lambda text: full(F.when(F.startswith(F.ltrim(text), F.lit("[")), F.from_json(text, "array<string>")))
    is_wave = lambda text: F.coalesce(F.map_contains_key(F.from_json(F.get(listed(text), F.lit(0)), "map<string, string>"), F.lit("wave_number")), F.lit(False))
    other = F.get(F.filter(F.map_values(named), is_wave), F.lit(0))
    lists = F.coalesce(listed(F.col("json")), listed(F.try_element_at(named, F.lit("waves"))), listed(F.try_element_at(named, F.lit("data"))), listed(other))
    return files.select("document", F.posexplode(lists).alias("pos", "json"))


def judged(files: DataFrame, stored: DataFrame, prefix: str) -> DataFrame:
    """A row per wave of the files with its status: imported, existing, no_position, no_time or bad_time; and the event it makes.

    stored: source_url of what is there. A wave is known by its number (none counts as 0): of several with one number that can
    be imported, the first by document and place in it is, and those after it are existing. The first is found by a minimum for each
    number, so a number that a third of all waves share is no task's."""
    w, at = F.col("w"), F.struct("document", "pos")
    rows = elements(files).withColumn("w", parsed(F.col("json")))
    said = F.coalesce(*[F.nullif(w["timing"][c], F.lit("")) for c in ("announced_utc", "probable_launch_time")])
    place = position(w)
    rows = rows.select(
        "document", "pos", at.alias("_at"), F.concat(F.lit(prefix), F.coalesce(w["wave_number"], F.lit(0)).cast("string")).alias("source_url"), said.alias("_said"), F.try_to_timestamp(said).alias("timestamp"),
        place["lat"].alias("lat"), place["lon"].alias("lon"), severity(w).alias("severity"), summary(w).alias("summary"), location(w).alias("location_name"), F.left("json", F.lit(5000)).alias("raw_text"),
    )
    why = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "no_position").when(F.col("_said").isNull(), "no_time").when(F.col("timestamp").isNull(), "bad_time").otherwise("imported")
    rows = rows.withColumn("status", why)
    first = rows.filter("status = 'imported'").groupBy("source_url").agg(F.min("_at").alias("_first"))
    there = stored.select("source_url").distinct().withColumn("_there", F.lit(True))
    rows = rows.join(first, "source_url", "left").join(there, "source_url", "left")
    existing = F.col("_there") | (F.col("_at") > F.col("_first"))
    return rows.withColumn("status", F.when(F.coalesce(existing, F.lit(False)), "existing").otherwise(F.col("status"))).drop("_at", "_said", "_first", "_there")


def imported(waves: DataFrame) -> DataFrame:
    """The events that judged waves make."""
    return waves.filter("status = 'imported'").drop("status")


def severity(w: Column) -> Column:
    one = lambda c: F.when(c, 1).otherwise(0)
    dead = w["impact"]["fatalities"]
    return F.least(F.lit(10), F.lit(6) + one(w["escalation"]["new_country_targeted"]) + one(w["escalation"]["new_weapon_first_use"]) + one(dead > 5) + one(dead > 20))


def summary(w: Column) -> Column:
    said = lambda label, c: F.when(c != "", F.concat(F.lit(label), c, F.lit(".")))
    dead, hurt = F.coalesce(w["impact"]["fatalities"], F.lit(0)), F.coalesce(w["impact"]["injuries"], F.lit(0))
    toll = F.when((dead != 0) | (hurt != 0), F.concat(F.lit("Casualties: "), dead.cast("string"), F.lit(" killed, "), hurt.cast("string"), F.lit(" injured.")))
    return F.left(F.concat_ws(" ", F.nullif(w["description"], F.lit("")), said("Weapons: ", w["weapons"]["payload"]), said("Targets: ", w["targets"]["targets"]), toll), F.lit(2000))


def location(w: Column) -> Column:
    t = w["targets"]["targets"]
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit("Middle East")).otherwise(F.left(F.trim(F.split_part(t, F.lit(","), F.lit(1))), F.lit(100)))


def point(p: tuple[float, float]) -> Column:
    return F.struct(F.lit(p[0]).alias("lat"), F.lit(p[1]).alias("lon"))


def position(w: Column) -> Column:
    """Stated position, else the first flagged city, base country, landing country, else the default of a targeted country; null without any."""
    t = w["targets"]
    stated = F.when(t["target_coordinates"]["lat"].isNotNull() & t["target_coordinates"]["lon"].isNotNull(), F.struct(t["target_coordinates"]["lat"].alias("lat"), t["target_coordinates"]["lon"].alias("lon")))
    flags = [F.when(t["israeli_locations"][f], point(p)) for f, p in CITY_FLAGS.items()]
    table = F.create_map(*[x for c, p in COUNTRIES.items() for x in (F.lit(c), point(p))])
    first = lambda codes: table[F.get(F.filter(F.transform(codes, lambda c: F.upper(F.coalesce(c, F.lit("")))), lambda c: c.isin(*COUNTRIES)), F.lit(0))]
    return F.coalesce(stated, *flags, first(F.transform(t["us_bases"], lambda b: b["country_code"])), first(t["landings_countries"]), F.when(t["israel_targeted"], point(COUNTRIES["IL"])))


def sample_json(n: Column, k: Column) -> Column:
    """A wave document derived from two numbers, for queries over generated data."""
    return F.to_json(
        F.struct(
            n.alias("wave_number"),
            F.struct((k % 2 == 0).alias("new_country_targeted"), (k % 3 == 0).alias("new_weapon_first_use")).alias("escalation"),
            F.struct(k.alias("fatalities"), (k % 9).alias("injuries")).alias("impact"),
            F.struct(
                F.when(k % 4 != 0, F.concat(F.lit("City "), k.cast("string"), F.lit(", Other"))).alias("targets"),
                F.when(k % 5 == 0, F.struct((k / 2).alias("lat"), (k / 3).alias("lon"))).alias("target_coordinates"),
                F.create_map(F.lit("targeted_haifa"), k % 7 == 0, F.lit("targeted_eilat"), k % 11 == 0).alias("israeli_locations"),
                F.array(F.struct(F.when(k % 3 == 1, "iq").otherwise("zz").alias("country_code"))).alias("us_bases"),
                F.array(F.lit(None).cast("string"), F.when(k % 2 == 1, "ye")).alias("landings_countries"),
                (k % 8 == 0).alias("israel_targeted"),
            ).alias("targets"),
        )
    )
