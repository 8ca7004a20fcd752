"""Measurements over an archive: rates with their denominators, distributions, modes, overlaps, sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.session import cut, small

Z = 1.96
#: Bands that a key's range of values is cut into for ranks.
BANDS = 1024


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a proportion; (0, 1) without observations."""
    p = hits / n
    centre = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.when(n > 0, F.greatest(centre - half, F.lit(0.0))).otherwise(0.0), F.when(n > 0, F.least(centre + half, F.lit(1.0))).otherwise(1.0)


def rates(rows: DataFrame, key: Column, hit: Column, name: str) -> DataFrame:
    """Per key: n, hits, rate, and the interval."""
    r = rows.groupBy(key.alias(name)).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    lo, hi = wilson(F.col("hits"), F.col("n"))
    return r.select(name, "n", "hits", F.round(F.col("hits") / F.col("n"), 9).alias("rate"), F.round(lo, 9).alias("lo"), F.round(hi, 9).alias("hi"))


def modal_position(rows: DataFrame, key: str, first: str) -> DataFrame:
    """Per key: all rows, distinct positions, and the most frequent position (ties: the one met first)."""
    at = rows.groupBy(key, "lat", "lon").agg(F.count("*").alias("n"), F.min(first).alias("first"))
    best = F.max_by(F.struct("lat", "lon"), F.struct("n", -F.col("first")))
    return at.groupBy(key).agg(F.sum("n").alias("total"), F.count("*").alias("positions"), F.max("n").alias("at_mode"), best.alias("m")).select(key, "total", "positions", "at_mode", F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"))


def distribution(rows: DataFrame, key: str, value: str) -> DataFrame:
    """How many keys occur how often."""
    return rows.groupBy(key).agg(F.count("*").alias(value)).groupBy(value).agg(F.count("*").alias("keys"))


def cumulative(rows: DataFrame, key: str, part: str) -> DataFrame:
    """Share of rows per key within part, and its running sum, most frequent first."""
    n = rows.groupBy(part, key).agg(F.count("*").alias("n"))
    by = Window.partitionBy(part).orderBy(F.desc("n"), key)
    total = F.sum("n").over(Window.partitionBy(part))
    return n.select(part, key, "n", F.round(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, 0)) / total, 9).alias("cumulative"))


def id_overlaps(messages: DataFrame, top: int = 8) -> DataFrame:
    """Pairs of the `top` channels of most messages: ids shared, and those expected by chance in the common id range.

    The pairing is of that fixed number of summary rows."""
    s = messages.groupBy("channel").agg(F.min("message_id").alias("lo"), F.max("message_id").alias("hi"), F.count("*").alias("n")).orderBy(F.desc("n"), "channel").limit(top)
    ids = messages.select("channel", "message_id").distinct()
    big = ids.join(F.broadcast(s.select("channel")), "channel")
    a, b = big.select(F.col("channel").alias("a"), "message_id"), big.select(F.col("channel").alias("b"), "message_id")
    shared = a.join(b, "message_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    x, y = s.select(*[F.col(c).alias(f"a_{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns])
    pairs = x.join(F.broadcast(y), F.col("a_channel") < F.col("b_channel")).select("*", F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi")).filter("lo <= hi")
    inside = lambda side: big.join(F.broadcast(pairs), (F.col("channel") == F.col(f"{side}_channel")) & F.col("message_id").between(F.col("lo"), F.col("hi"))).groupBy("a_channel", "b_channel").agg(F.count("*").alias(f"{side}_in"))
    both = pairs.join(inside("a"), ["a_channel", "b_channel"], "left").join(inside("b"), ["a_channel", "b_channel"], "left").join(shared.withColumnsRenamed({"a": "a_channel", "b": "b_channel"}), ["a_channel", "b_channel"], "left").fillna(0, ["a_in", "b_in", "shared"])
    return both.select(F.col("a_channel").alias("a"), F.col("b_channel").alias("b"), "shared", F.round(F.col("a_in") * F.col("b_in") / (F.col("hi") - F.col("lo") + 1), 6).alias("expected"))


def sentinel_census(rows: DataFrame) -> DataFrame:
    """One row: positions at, near (bands of 0.01 and 1 degree) and half at the sentinel."""
    dlat, dlon = F.abs(F.col("lat") - V.SENTINEL_LAT), F.abs(F.col("lon") - V.SENTINEL_LON)
    far = F.greatest(dlat, dlon)
    n = lambda c: F.count_if(c)
    return rows.agg(F.count("*").alias("rows"), F.count("lat").alias("located"), n(far == 0).alias("exact"), n((far > 0) & (far <= 0.01)).alias("near"), n((far > 0.01) & (far <= 1)).alias("band"), n((dlat == 0) != (dlon == 0)).alias("half"))


def latency(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: total, upper-middle median, the value at place floor(0.95 n), largest; nulls come first. Rows without a key are left out.

    A window runs over the distinct values of BANDS bands of a key, and another over the bands: no task holds a key's rows."""
    n = rows.groupBy(key, value).agg(F.count("*").alias("c"))
    ends = n.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-300))
    n = n.join(ends, key).withColumn("_band", F.coalesce(F.floor((F.col(value) - F.col("_lo")) / span * BANDS), F.lit(-1)))
    before = n.groupBy(key, "_band").agg(F.sum("c").alias("_n"))
    before = before.select(key, "_band", (F.sum("_n").over(Window.partitionBy(key).orderBy("_band")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(key)).alias("n"))
    to = F.col("_before") + F.sum("c").over(Window.partitionBy(key, "_band").orderBy(value))
    r = n.join(before, [key, "_band"]).select(key, value, "c", "n", to.alias("_to"))
    at = lambda i: F.max(F.when((F.col("_to") > i) & (F.col("_to") - F.col("c") <= i), F.col(value)))
    return r.groupBy(key).agg(F.max("n").alias("n"), at(F.floor(F.col("n") / 2)).alias("median"), at(F.least(F.floor(F.col("n") * 95 / 100), F.col("n") - 1)).alias("p95"), F.max(value).alias("largest"))


def allocation(strata: DataFrame, size: int, least: int = 20) -> DataFrame:
    """strata: stratum, n. Rows to draw from each: in proportion, `least` at least, never more than there are."""
    total = F.sum("n").over(Window.partitionBy())
    return strata.withColumn("draw", F.least(F.greatest(F.lit(least), F.bround(size * F.col("n") / total)), F.col("n")).cast("long"))


def pooled(rows: DataFrame, stratum: str, share: float = 0.01) -> DataFrame:
    """Rows with strata of less than `share` of all rows pooled as '(small)'."""
    n = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    n = n.withColumn("_small", F.col("_n") < share * F.sum("_n").over(Window.partitionBy()))
    return rows.join(n, stratum).withColumn(stratum, F.when(F.col("_small"), "(small)").otherwise(F.col(stratum))).drop("_n", "_small")


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int, seed: int = 0) -> DataFrame:
    """The allocated number of rows of each stratum, those of the smallest seeded hash: reruns agree."""
    pool = pooled(rows, stratum)
    draw = allocation(pool.groupBy(stratum).agg(F.count("*").alias("n")), size).select(stratum, "draw")
    n = cut(draw)
    # Only rows whose hash lies under a bound that leaves twice what is drawn, and 20 more, are ranked; a stratum whose bound lets too few pass (hardly ever) is ranked whole.
    sizes = pool.groupBy(stratum).agg(F.count("*").alias("_n")).join(n, stratum)
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    hashed = pool.withColumn("_h", place)
    bound = sizes.select(stratum, "draw", ((2 * F.col("draw") + 20) / F.col("_n") * 2.0**32).alias("_most"))
    passed = hashed.join(bound, stratum).filter("_h < _most").groupBy(stratum).agg(F.count("*").alias("_c"))
    bound = small(cut(bound.join(passed, stratum, "left").select(stratum, "draw", F.when(F.coalesce("_c", F.lit(0)) >= F.col("draw"), F.col("_most")).otherwise(2.0**32).alias("_most"))))
    by = Window.partitionBy(stratum).orderBy("_h", key)
    return hashed.join(bound, stratum).filter("_h < _most").withColumn("_i", F.row_number().over(by)).filter("_i <= draw").drop("_i", "draw", "_h", "_most")


def bottom_k(rows: DataFrame, bucket: str, key: str, k: int, seed: int = 0, salts: int = 32) -> DataFrame:
    """A uniform sample of k rows of each bucket (all of a smaller one), all buckets in one pass: those of smallest seeded hash of the
    key, numbered in column `place`. Reruns agree, whatever the partitions; a null bucket is a bucket.

    The k smallest of the union are among the k smallest of its parts, so every task passes on k rows of a bucket and salt at
    most (Spark's rank limit, for k up to its threshold of 1000), and no task meets a bucket's rows, hot or not."""
    hashed = rows.withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))).withColumn("_salt", F.crc32(F.col("_h").cast("binary")) % salts)
    by = Window.partitionBy(bucket, "_salt").orderBy("_h", key)
    parts = hashed.withColumn("_i", F.row_number().over(by)).filter(F.col("_i") <= k)
    return parts.withColumn("place", F.row_number().over(Window.partitionBy(bucket).orderBy("_h", key))).filter(F.col("place") <= k).drop("_h", "_salt", "_i")


def stratified_estimate(sampled: DataFrame, population: DataFrame) -> DataFrame:
    """sampled: stratum, hit (boolean); population: stratum, n. One row: the weighted proportion, its standard error with
    finite-population correction, and whether any stratum showed variance."""
    s = sampled.groupBy("stratum").agg(F.count("*").alias("m"), F.count_if(F.col("hit")).alias("hits"))
    r = population.join(s, "stratum").withColumn("w", F.col("n") / F.sum("n").over(Window.partitionBy())).withColumn("p", F.col("hits") / F.col("m"))
    v = F.when((F.col("m") > 1) & (F.col("n") > 0), F.col("w") * F.col("w") * (1 - F.col("m") / F.col("n")) * F.col("p") * (1 - F.col("p")) / (F.col("m") - 1)).otherwise(0.0)
    return r.agg(F.round(F.sum(F.col("w") * F.col("p")), 9).alias("estimate"), F.round(F.sqrt(F.sum(v)), 9).alias("se"), F.bool_or(v > 0).alias("has_variance"))


def coverage(universe: DataFrame, sampled: DataFrame, key: str, floor: int = 20) -> DataFrame:
    """One row: keys sampled at all, not at all, exactly once, and up to the floor."""
    n = universe.select(key).distinct().join(sampled.groupBy(key).agg(F.count("*").alias("n")), key, "left").fillna(0, ["n"])
    return n.agg(F.count_if(F.col("n") >= 1).alias("some"), F.count_if(F.col("n") == 0).alias("none"), F.count_if(F.col("n") == 1).alias("one"), F.count_if(F.col("n") <= floor).alias("at_floor"))


def funnel(rows: DataFrame, ok: Column, noise: Column, low: Column) -> DataFrame:
    """One row of counts on like denominators: read, measured, not noise, stored."""
    return rows.agg(F.count("*").alias("read"), F.count_if(ok).alias("measured"), F.count_if(ok & ~noise).alias("not_noise"), F.count_if(ok & ~noise & ~low).alias("stored"))
