"""Column functions for what is shown: labels of ages, ratios, moves and durations, places on a time line, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def age_label(seconds: Column) -> Column:
    """45s, 3m41s, 2h05m; null stays null."""
    s = seconds.cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    m, h = F.floor(s / 60), F.floor(s / 3600)
    return F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(m.cast("string"), F.lit("m"), two(s % 60), F.lit("s"))).otherwise(F.concat(h.cast("string"), F.lit("h"), two(m % 60), F.lit("m")))


def uncertainty_label(metres: Column) -> Column:
    """Metres below a kilometre, else whole kilometres; an extent never measured says so."""
    return F.when(metres.isNull(), F.lit("unmeasured")).when(metres < 1000, F.concat(F.lit("±"), metres.cast("string"), F.lit("m"))).otherwise(F.concat(F.lit("±"), F.floor(metres / 1000 + 0.5).cast("string"), F.lit("km")))


def duration_label(start: Column, end: Column) -> Column:
    """<1D, or whole days."""
    days = F.floor((F.unix_timestamp(end) - F.unix_timestamp(start)) / 86_400)
    return F.when(days < 1, F.lit("<1D")).otherwise(F.concat(days.cast("string"), F.lit("D")))


def move_label(x: Column) -> Column:
    """A share as a signed percentage: more decimals for small moves, 'flat' for none."""
    p = F.round(x * 100, 2)
    sign = F.when(p > 0, F.lit("+")).otherwise(F.lit(""))
    digits = F.when(F.abs(p) < 1, F.format_number(p, 2)).when(F.abs(p) < 10, F.format_number(F.round(p, 1), 1)).otherwise(F.format_number(F.round(p, 0), 0))
    return F.when(p == 0, F.lit("flat")).when(p.isNotNull(), F.concat(sign, digits, F.lit("%")))


def timeline_percent(ts: Column, start: Column, end: Column) -> Column:
    """Place of ts between start and end in percent; a span shorter than a minute counts as a minute."""
    span = F.greatest(F.unix_timestamp(end) - F.unix_timestamp(start), F.lit(60))
    return 100 * (F.unix_timestamp(ts) - F.unix_timestamp(start)) / span


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def runs(samples: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Runs of measured samples (keys, t, v) without a gap: start, end and size of each."""
    by = Window.partitionBy(*keys).orderBy("t")
    live = samples.filter("v is not null").withColumn("island", F.col("t") - step * F.row_number().over(by))
    return live.groupBy(*keys, "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count("*").alias("n")).drop("island")


def flat_trace(mad: Column, baseline: Column, n: Column, rule: float = -0.02, least: int = 4) -> Column:
    """Whether a trace is flat against its baseline; null when it is too short to say."""
    return F.when((n >= least) & (baseline != 0), mad / baseline <= abs(rule) / 20)


#: How a little-endian point with SRID 4326 begins, and how long it is, in hexadecimal digits.
EWKB_POINT, EWKB_DIGITS = "0101000020E6100000", 50


def _double(digits: Column) -> Column:
    """The double of 16 hexadecimal digits, least byte first. Exact: a whole number of at most 53 bits times a power of two."""
    high = F.concat(*[F.substring(digits, at, 2) for at in range(15, 0, -2)])
    head, tail = F.conv(F.substring(high, 1, 3), 16, 10).cast("int"), F.conv(F.substring(high, 4, 13), 16, 10).cast("long")
    e, sign = head % 2048, F.when(head >= 2048, -1.0).otherwise(1.0)
    special = F.when(tail == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    whole = F.when(e > 0, tail + (1 << 52)).otherwise(tail).cast("double")
    return sign * F.when(e == 2047, special).otherwise(whole * F.pow(F.lit(2.0), (F.greatest(e, F.lit(1)) - 1075).cast("double")))


def ewkb_point(hex_text: Column) -> Column:
    """Struct (status, lon, lat) of a little-endian point with SRID 4326 in hexadecimal; anything else is undecodable, not null."""
    good = hex_text.rlike(f"^[0-9A-Fa-f]{{{EWKB_DIGITS}}}$") & F.startswith(F.upper(hex_text), F.lit(EWKB_POINT))
    at = lambda start: F.when(good, _double(F.substring(hex_text, start, 16)))
    status = F.when(hex_text.isNull(), "null").when(good, "point").otherwise("undecodable")
    return F.struct(status.alias("status"), at(19).alias("lon"), at(35).alias("lat"))
