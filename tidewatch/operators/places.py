"""Gazetteer lookup: exact and contained names, precision tiers. The gazetteer is a table: key, kind (known or
directional), lat, lon, tier, uncertainty_m."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.functions.geo import TIERS, coarser
from tidewatch.functions.text import any_of, evidence_span, once, quoted
from tidewatch.session import cut, small


def tier_rank(tier: Column) -> Column:
    return F.coalesce(*[F.when(tier == t, i) for i, t in enumerate(TIERS)], F.lit(len(TIERS)))


def voted_tiers(gazetteer: DataFrame) -> DataFrame:
    """The most precise tier of each position."""
    return gazetteer.groupBy("lat", "lon").agg(F.min_by("tier", tier_rank(F.col("tier"))).alias("tier"))


#: Texts and keys that share a beginning, of so many at most, may be broadcast.
MET_ROWS = 300_000
#: Characters of words: those of any script, or of ASCII alone, where any other letter ends a word.
UNICODE, ASCII = r"\p{L}\p{N}_", "A-Za-z0-9_"


def longest_contained(texts: DataFrame, keys: DataFrame, letters: str = UNICODE) -> DataFrame:
    """id and the longest key that text contains as whole words (ties: smallest pos). texts: id, text; keys: key, pos. letters: what words
    are made of.

    Single words and pairs of neighbouring words of the texts, without the texts, meet the first one or two words of the
    keys in an equi-join; only the texts and keys that share such a beginning are looked at."""
    word = f"[^{letters}]+"
    edge = r"(?U)\b" if letters == UNICODE else f"(?:(?<=[{letters}])(?![{letters}])|(?<![{letters}])(?=[{letters}]))"
    listed = lambda c: F.filter(F.split(c, word), lambda w: w != "")
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: F.concat(x, F.lit(" "), y))
    k = keys.select(F.lower("key").alias("key"), "pos").withColumn("w", listed(F.col("key"))).filter(F.size("w") > 0)
    k = cut(k.select("key", "pos", F.concat_ws(" ", F.slice("w", 1, 2)).alias("start"), F.size("w").alias("n")))
    single = not k.filter("n = 1").isEmpty()
    t = texts.select("id", F.lower("text").alias("low"))
    words = t.select("id", listed(F.col("low")).alias("w"))
    starts = F.concat(F.col("w"), pairs(F.col("w"))) if single else pairs(F.col("w"))
    met = words.select("id", F.explode(F.array_distinct(starts)).alias("start")).join(small(k.drop("n")), "start").select(F.col("id").alias("_id"), "key", "pos")
    hit = F.contains("low", F.col("key")) & F.rlike("low", F.concat(F.lit(edge), quoted(F.col("key")), F.lit(edge.removeprefix("(?U)"))))
    found = t.join(met, F.col("id").eqNullSafe(F.col("_id"))).filter(hit)
    return found.groupBy("id").agg(F.max_by("key", F.struct(F.length("key"), -F.col("pos"))).alias("key"))


def folded(text: Column) -> Column:
    """text in a form that has letters equal where patterns that ignore case have them equal, letter by letter, so that what a pattern
    finds in a text lies in the text's form as well. The concat stands there as the optimizer takes lower(upper(x)) for lower(x)."""
    swap = lambda c, signs, by: F.when(any_of(c, signs), F.translate(c, signs, by)).otherwise(c)
    return once(F.lower(F.concat(F.upper(swap(text, "İẞ", "Iß")), F.lit(""))), lambda low: swap(low, "ς", "σ"))


def spelled(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """id, pos and span for every text and key that it spells as whole words. texts: id, text; keys: key, pos.

    Hashes of three neighbouring words of the text, without the text, meet those of the first three words of keys in an equi-join (two or one
    where keys have no more); only texts and keys that share such a beginning are looked at, the key's letters first and the pattern then.
    Words are runs of letters and digits here: what a pattern takes for a word's end is one for them. Keys without a word character are spelled nowhere."""
    listed = lambda c: F.filter(F.split(c, r"[^A-Za-z0-9_\p{L}\p{Nd}]+"), lambda w: w != "")
    k = keys.select("key", "pos", listed(folded(F.col("key"))).alias("w")).withColumn("n", F.least(F.size("w"), F.lit(3)))
    k = cut(k.select("key", "pos", "n", F.expr("case n when 1 then xxhash64(w[0]) when 2 then xxhash64(w[0], w[1]) when 3 then xxhash64(w[0], w[1], w[2]) end").alias("start")).filter(F.rlike("key", F.lit(r"(?U)\w"))))
    lengths = {r["n"] for r in k.select("n").distinct().collect()}  # 0 to 3

    def starts(w: Column) -> Column:
        at = lambda i, n: F.slice(w, F.lit(i), F.greatest(F.size(w) - (n - 1), F.lit(0)))
        one, two = F.transform(w, lambda x: F.xxhash64(x)), lambda n: F.zip_with(at(1, n), at(2, n), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
        of = {1: one, 2: F.transform(two(2), lambda p: F.xxhash64(p["x"], p["y"])), 3: F.zip_with(two(3), at(3, 3), lambda p, z: F.xxhash64(p["x"], p["y"], z))}
        return F.concat(*[of[n] for n in sorted(lengths - {0})])

    met = keys.select(F.lit(None).cast(texts.schema["id"].dataType).alias("_id"), "key", "pos").limit(0)
    if lengths - {0}:
        begun = texts.select("id", F.explode(F.array_distinct(once(listed(folded(F.col("text"))), starts))).alias("start"))
        met = met.unionByName(begun.join(small(k.drop("n")), "start").select(F.col("id").alias("_id"), "key", "pos"))
    if 0 in lengths:  # signs that count as word characters and are neither letters nor digits
        met = met.unionByName(texts.select(F.col("id").alias("_id")).crossJoin(k.filter("n = 0").select("key", "pos")))
    met = cut(met.distinct())
    both = texts.select("id", "text").join(small(met, MET_ROWS), F.col("id").eqNullSafe(F.col("_id")))
    near = both.filter(F.contains(folded(F.col("text")), folded(F.col("key"))))
    return near.select("id", "pos", evidence_span(F.col("text"), F.col("key")).alias("span")).filter("span <> ''")


def resolve(names: DataFrame, gazetteer: DataFrame, letters: str = UNICODE) -> DataFrame:
    """id, lat, lon, precision, uncertainty_m, method for names (id, name): exact in the directional table, exact in
    the known one, else the longest known and then directional key contained in the name, one tier coarser. Names
    of no place resolve to nothing."""
    key = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    asked = names.select("id", key.alias("key")).filter(~F.col("key").isin(*V.NOT_A_PLACE))
    fields = ["lat", "lon", "tier", "uncertainty_m"]
    one = Window.partitionBy("kind", "key").orderBy(F.desc("pos"))
    g = gazetteer.withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")

    def named(kind: str, method: str, order: int) -> DataFrame:
        return asked.join(g.filter(F.col("kind") == kind).select("key", *fields), "key").select("id", *fields, F.lit(method).alias("method"), F.lit(order).alias("o"))

    def contained(kind: str, order: int) -> DataFrame:
        hit = longest_contained(asked.select("id", F.col("key").alias("text")), g.filter(F.col("kind") == kind).select("key", "pos"), letters)
        rows = hit.join(g.filter(F.col("kind") == kind).select("key", *fields), "key")
        return rows.select("id", "lat", "lon", coarser(F.col("tier")).alias("tier"), "uncertainty_m", F.lit("partial").alias("method"), F.lit(order).alias("o"))

    found = named("directional", "directional-exact", 0).unionByName(named("known", "table-exact", 1)).unionByName(contained("known", 2)).unionByName(contained("directional", 3))
    best = found.groupBy("id").agg(F.min_by(F.struct("lat", "lon", F.col("tier").alias("precision"), "uncertainty_m", "method"), "o").alias("r")).select("id", "r.*")
    return names.select("id").join(best, "id", "left")
