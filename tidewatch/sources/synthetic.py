"""Generated events, bursts, aircraft and vessels: rows of a given table with seeded columns; reruns agree.

Movers go from target to target in steps of equal length. A leg's number of steps follows from its length, and the next leg's
beginning from where the last one ended, so legs are folded in order; all ticks of a leg then follow in closed form, a row each,
and no tick waits for the one before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import values as V
from tidewatch.functions.geo import heading
from tidewatch.session import small

#: Numbers are drawn from so many values: seven hexadecimal digits of a hash.
DRAWS = 1 << 28


def uniform(seed: int, *key: Column) -> Column:
    """A number in [0, 1) from a key (by default the row's id) and a seed."""
    parts = [k.cast("string") for k in key or (F.col("id"),)]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts, F.lit(str(seed)))), 1, 7), 16, 10).cast("long") / DRAWS


def banded(bands, u: Column) -> Column:
    """The value of the first band (value, upper end) that u lies under."""
    return F.coalesce(*[F.when(u < end, F.lit(value)) for value, end in bands])


def around(x: Column, amount: float, u: Column) -> Column:
    """x moved by at most `amount` either way."""
    return x + (2 * u - 1) * amount


def events(rows: DataFrame, places: DataFrame, now: Column, seed: int = 1) -> DataFrame:
    """An event for each of rows (id), weighted by type and severity, with exponential ages before `now` up to a limit, near one of
    places (place from 0 without gaps, name, lat, lon). Without places there are no events."""
    u = lambda n: uniform(seed + n)
    age = F.least(-F.log(1 - u(1)) * V.DEMO_MEAN_AGE_S, F.lit(V.DEMO_OLDEST_S)).cast("long")
    drawn = rows.select(
        "id", banded(V.DEMO_KINDS, u(0)).alias("event_type"), F.timestamp_seconds(F.unix_timestamp(now) - age).alias("ts"), (banded(V.DEMO_SEVERITIES, u(2)) + F.floor(u(3) * 2).cast("int")).alias("severity"),
        F.floor(u(4) * F.lit(places.count())).cast("int").alias("place"), u(5).alias("_y"), u(6).alias("_x"),
    )
    near = drawn.join(small(places), "place")
    return near.select("id", "event_type", "ts", "severity", "name", around(F.col("lat"), V.DEMO_JITTER, F.col("_y")).alias("lat"), around(F.col("lon"), V.DEMO_JITTER, F.col("_x")).alias("lon"))


def bursts(ticks: DataFrame, seed: int = 9) -> DataFrame:
    """ticks: id. Every eighth tick gives, three times in ten, a burst of three to five severe events."""
    size = F.when((F.col("id") % 8 == 0) & (uniform(seed) < 0.3), (3 + F.floor(uniform(seed + 1) * 3)).cast("int")).otherwise(0)
    b = ticks.select("id", size.alias("size")).filter("size > 0").select(F.col("id").alias("tick"), F.explode(F.sequence(F.lit(1), "size")).alias("nth"))
    return b.withColumn("severity", (7 + F.floor(uniform(seed + 2, F.col("tick"), F.col("nth")) * 4)).cast("int"))


def there_and_back(route: Column, at: Column, onward: Column, legs: int) -> Column:
    """The next `legs` points of a route (array) from its point number `at`, onward or back, turning at its ends."""
    n = F.size(route)
    period = F.greatest(F.lit(1), 2 * (n - 1))
    begin = F.when(onward, at).otherwise(period - at)

    def point(j: Column) -> Column:
        phase = F.pmod(begin + j, period)
        return F.element_at(route, F.when(phase < n, phase).otherwise(period - phase).cast("int") + 1)

    return F.transform(F.sequence(F.lit(1), F.lit(legs)), point)


LEG = "leg int, start long, steps long, lat double, lon double, to_lat double, to_lon double, d double"


def legs(movers: DataFrame, near: float) -> DataFrame:
    """movers: entity, lat, lon, step (degrees a tick), targets (array of lat, lon, a few). The legs of each: from which tick and
    position, to which target, in how many steps. A target is reached when it is nearer than `near`; the tick that finds so
    takes up the next target and does not move. Null steps, or none above zero, give no leg; a mover without targets has none."""
    array = f"array<struct<{LEG.replace(' ', ':').replace(',:', ',')}>>"

    def onward(was: Column, to: Column) -> Column:
        d = F.hypot(to["lat"] - was["lat"], to["lon"] - was["lon"])
        measured = F.struct(was["tick"].alias("tick"), was["lat"].alias("lat"), was["lon"].alias("lon"), was["legs"].alias("legs"), to["lat"].alias("to_lat"), to["lon"].alias("to_lon"), d.alias("d"))
        return F.element_at(F.transform(F.array(measured), moved), 1)

    def moved(m: Column) -> Column:
        steps = F.when(m["d"] < near, F.lit(0)).otherwise(F.floor((m["d"] - near) / F.col("step")) + 1).cast("long")
        left = F.when(m["d"] > 0, F.greatest(m["d"] - steps * F.col("step"), F.lit(0.0)) / m["d"]).otherwise(0.0)
        leg = F.struct(F.size(m["legs"]).alias("leg"), m["tick"].alias("start"), steps.alias("steps"), m["lat"].alias("lat"), m["lon"].alias("lon"), m["to_lat"].alias("to_lat"), m["to_lon"].alias("to_lon"), m["d"].alias("d"))
        return F.struct((m["tick"] + steps + 1).alias("tick"), (m["to_lat"] + (m["lat"] - m["to_lat"]) * left).alias("lat"), (m["to_lon"] + (m["lon"] - m["to_lon"]) * left).alias("lon"), F.array_append(m["legs"], leg).cast(array).alias("legs"))

    begin = F.struct(F.lit(0).cast("long").alias("tick"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.array().cast(array).alias("legs"))
    return movers.filter("step > 0 and lat is not null and lon is not null").select("entity", "step", F.explode(F.aggregate("targets", begin, onward, lambda end: end["legs"])).alias("l"), F.size("targets").alias("n")).select("entity", "step", "l.*", (F.col("l.leg") == F.col("n") - 1).alias("last"))


def positions(movers: DataFrame, near: float, ticks: int, noise: float = 0.0, seed: int = 1) -> DataFrame:
    """Where each mover is from tick 0 to `ticks`, where it heads to and whether it took up a new target. When the targets are
    used up it stays. noise is added to what is reported, not to the way."""
    end = F.when(F.col("last"), F.lit(ticks)).otherwise(F.least(F.col("start") + F.col("steps"), F.lit(ticks)))
    t = legs(movers, near).filter(F.col("start") <= ticks).withColumn("tick", F.explode(F.sequence("start", end.cast("long"))))
    done = F.when(F.col("d") > 0, F.least(F.least(F.col("tick") - F.col("start"), F.col("steps")) * F.col("step") / F.col("d"), F.lit(1.0))).otherwise(1.0)
    dlat, dlon = F.col("to_lat") - F.col("lat"), F.col("to_lon") - F.col("lon")
    u = lambda n: uniform(seed + n, F.col("entity"), F.col("tick"))
    return t.withColumn("_f", done).select(
        "entity", "tick", "leg", around(F.col("lat") + dlat * F.col("_f"), noise, u(0)).alias("lat"), around(F.col("lon") + dlon * F.col("_f"), noise, u(1)).alias("lon"),
        F.when(F.col("_f") < 1, heading(dlat, dlon)).otherwise(0.0).alias("heading"), ((F.col("tick") == F.col("start")) & (F.col("leg") > 0)).alias("arrived"),
    )
