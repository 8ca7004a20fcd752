"""Robust outage detection over sensor series (code, datasource, t epoch seconds, v; v null: not measured).

Every comparison is of medians. Samples are dealt to the probes and windows they serve by arithmetic on their age, so no
range join is needed; each step is one grouped percentile over all series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import values as V

KEY = ["code", "datasource"]


def median(x: Column) -> Column:
    return F.percentile(x, F.lit(0.5))


def clean(v: Column) -> Column:
    """NaN and infinities are not measured."""
    return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)


def least_baseline(source: Column) -> Column:
    return F.coalesce(*[F.when(source == k, F.lit(x)) for k, x in V.MIN_BASELINE.items()], F.lit(V.MIN_BASELINE_OTHER))


def aged(samples: DataFrame) -> DataFrame:
    """Measured samples with their age d against the series' last measured one."""
    live = samples.withColumn("v", clean(F.col("v"))).filter("v is not null")
    last = live.groupBy(*KEY).agg(F.max("t").alias("last_t"))
    return live.join(last, KEY).withColumn("d", F.col("last_t") - F.col("t"))


def downsample(samples: DataFrame, points: int = V.SPARK_POINTS) -> DataFrame:
    """Median of each of `points` buckets of consecutive samples; a bucket without measured samples stays null."""
    by = Window.partitionBy(*KEY)
    rows = samples.withColumn("i", F.row_number().over(by.orderBy("t")) - 1).withColumn("n", F.count("*").over(by))
    return rows.groupBy(*KEY, F.floor(F.col("i") / F.ceil(F.col("n") / points)).alias("bucket")).agg(F.round(median(clean(F.col("v"))), 2).alias("v"))


def swing(rows: DataFrame, keys: list[str], v: str = "v", least: int = V.VARIANCE_POINTS) -> DataFrame:
    """Per key: n, mid (median) and mad (median absolute deviation); mad null under `least` rows."""
    rows = rows.select(*keys, v)
    mid = rows.groupBy(*keys).agg(F.count(v).alias("n"), median(F.col(v)).alias("mid"))
    mad = rows.join(mid, keys).groupBy(*keys, "n", "mid").agg(median(F.abs(F.col(v) - F.col("mid"))).alias("mad"))
    return mad.withColumn("mad", F.when(F.col("n") >= least, F.col("mad")))


def comparisons(samples: DataFrame, probes: int = V.RULER_PROBES) -> DataFrame:
    """For the last instant (probe 0) and each of `probes` hours before: current, baseline, reason, deviation.

    Current is the median of the 90 minutes up to the probe, baseline that of three hours around the same time a day
    before. A sample serves the probes whose windows hold its age."""
    rows, stride = aged(samples), V.RULER_STRIDE_S

    def served(lo: Column, hi: Column, side: str) -> DataFrame:
        return rows.filter(F.least(hi, F.lit(probes)) >= F.greatest(lo, F.lit(0))).select(*KEY, "v", F.explode(F.sequence(F.greatest(lo, F.lit(0)), F.least(hi, F.lit(probes)))).alias("probe"), F.lit(side).alias("side"))

    d = F.col("d")
    now = served((F.floor((d - V.CURRENT_S) / stride) + 1).cast("int"), F.floor(d / stride).cast("int"), "now")
    base = served(F.ceil((d - V.DAY_S - V.SEASONAL_S) / stride).cast("int"), F.floor((d - V.DAY_S + V.SEASONAL_S) / stride).cast("int"), "base")
    is_now, is_base = F.col("side") == "now", F.col("side") == "base"
    out = now.unionByName(base).groupBy(*KEY, "probe").agg(
        F.count_if(is_now).alias("n_now"), F.count_if(is_base).alias("n_base"), median(F.when(is_now, F.col("v"))).alias("current"), median(F.when(is_base, F.col("v"))).alias("baseline")
    )
    few = (F.col("n_now") < V.CURRENT_POINTS) | (F.col("n_base") < V.BASELINE_POINTS)
    reason = F.when(few, "insufficient_points").when(F.col("baseline") < least_baseline(F.col("datasource")), "low_baseline")
    out = out.withColumn("reason", reason)
    return out.withColumn("deviation", F.when(F.col("reason").isNull(), (F.col("current") - F.col("baseline")) / F.col("baseline")))


def ruler(compared: DataFrame) -> DataFrame:
    """The series' own swing on that comparison: MAD of the deviations at the hourly probes, null under eight."""
    return swing(compared.filter("probe > 0 and reason is null"), KEY, "deviation", V.RULER_LEAST).select(*KEY, F.col("mad").alias("typical"))


def verdict(deviation: Column, typical: Column) -> tuple[Column, Column, Column]:
    """(depressed, robust_z, z_basis)."""
    flat = typical < V.TYPICAL_FLOOR
    z = F.when(~flat, deviation / typical)
    depressed = F.when(typical.isNull(), False).when(flat, deviation <= V.FLAT_ABSOLUTE).otherwise(z <= V.Z_DEPRESSED)
    return depressed, z, F.when(typical.isNull(), "unavailable").when(flat, "flat-sensor-absolute").otherwise("relative")


def _scored(series: DataFrame, samples: DataFrame, facts: DataFrame, until: Column) -> DataFrame:
    """Common tail: availability, reasons in order, verdict. series: KEY, step, fetched; facts: KEY, why, current,
    baseline, deviation, typical, and what else is reported."""
    state = samples.groupBy(*KEY).agg(F.count("*").alias("samples"), F.count(clean(F.col("v"))).alias("points"), F.count_if(F.col("v").isNotNull() & clean(F.col("v")).isNull()).alias("bad"), F.max(F.when(clean(F.col("v")).isNotNull(), F.col("t"))).alias("last_t"))
    rows = series.join(state, KEY, "left").join(facts, KEY, "left")
    age = F.greatest(until - F.col("last_t"), F.lit(0))
    stale = age > F.greatest(V.STALE_STEPS * F.col("step"), F.lit(V.STALE_FLOOR_S))
    reason = (
        F.when(~F.col("fetched"), "fetch_failed").when(F.coalesce("samples", F.lit(0)) == 0, "no_series").when((F.col("points") == 0) & (F.col("bad") > 0), "bad_values").when(F.col("points") == 0, "all_null")
        .when(stale, "stale_series").when(F.col("why").isNotNull(), F.col("why")).when(F.col("current").isNull(), "insufficient_points").when(F.col("typical").isNull(), "no_variance_estimate")
    )
    rows = rows.withColumn("reason", reason).withColumn("available", F.col("reason").isNull())
    depressed, z, basis = verdict(F.col("deviation"), F.col("typical"))
    ok = F.col("available")
    return rows.select(*KEY, "available", "reason", *[c for c in facts.columns if c not in (*KEY, "why", "deviation", "typical")], F.when(ok, F.col("deviation")).alias("deviation"), F.when(ok, F.col("typical")).alias("typical"), (ok & depressed).alias("depressed"), F.when(ok, z).alias("robust_z"), F.when(ok, basis).otherwise("unavailable").alias("z_basis"), F.coalesce("points", F.lit(0)).alias("points"), age.alias("data_age"))


def short_score(series: DataFrame, samples: DataFrame, until: Column) -> DataFrame:
    """Current 90 minutes against the same time yesterday."""
    compared = comparisons(samples)
    facts = compared.filter("probe = 0").select(*KEY, F.col("reason").alias("why"), F.when(F.col("reason") != "insufficient_points", F.col("current")).when(F.col("reason").isNull(), F.col("current")).alias("current"), "baseline", "deviation").join(ruler(compared), KEY, "left")
    return _scored(series, samples, facts, until)


def daily(samples: DataFrame, days: int = V.LONG_DAYS) -> DataFrame:
    """Median of each day before the last instant (day 0 is the last 24 hours), null under three samples."""
    rows = aged(samples).withColumn("day", F.floor(F.col("d") / V.DAY_S).cast("int")).filter(F.col("day") < days)
    n = F.count("v")
    return rows.groupBy(*KEY, "day").agg(n.alias("n"), F.when(n >= V.LONG_DAY_POINTS, median(F.col("v"))).alias("v"))


def slopes(days: DataFrame) -> DataFrame:
    """Theil-Sen: median of all pairwise slopes of the daily medians, per day forward in time."""
    a, b = days.filter("v is not null").alias("a"), days.filter("v is not null").alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in KEY]
    pairs = a.join(b, [*on, F.col("a.day") > F.col("b.day")])
    return pairs.groupBy(*[F.col(f"a.{k}").alias(k) for k in KEY]).agg(median((F.col("b.v") - F.col("a.v")) / (F.col("a.day") - F.col("b.day"))).alias("slope"))


def long_score(series: DataFrame, samples: DataFrame, until: Column) -> DataFrame:
    """Last 24 hours against days two to seven."""
    rows = aged(samples).filter(F.col("d") < V.LONG_DAYS * V.DAY_S)
    recent, old = F.col("d") < V.DAY_S, F.col("d") >= V.DAY_S
    levels = rows.groupBy(*KEY).agg(F.count_if(recent).alias("n_now"), F.count_if(old).alias("n_base"), median(F.when(recent, F.col("v"))).alias("current"), median(F.when(old, F.col("v"))).alias("baseline"))
    days = daily(samples)
    spread = swing(days.filter("day > 0 and v is not null"), KEY).select(*KEY, F.col("n").alias("n_days"), "mid", "mad")
    facts = levels.join(spread, KEY, "left").join(slopes(days), KEY, "left")
    few = (F.col("n_now") < V.LONG_DAY_POINTS) | (F.col("n_base") < V.LONG_BASELINE_POINTS)
    why = F.when(few, "insufficient_points").when(F.col("baseline") < least_baseline(F.col("datasource")), "low_baseline").when(F.coalesce("n_days", F.lit(0)) < V.LONG_LEAST_DAYS, "insufficient_days")
    typical = F.when(F.col("mid") != 0, F.col("mad") / F.col("mid") * F.col("mid") / F.col("baseline"))
    shown = lambda c: F.when(~few, F.col(c))
    facts = facts.select(*KEY, why.alias("why"), shown("current").alias("current"), shown("baseline").alias("baseline"), F.when(why.isNull(), (F.col("current") - F.col("baseline")) / F.col("baseline")).alias("deviation"), F.when(why.isNull(), typical).alias("typical"), F.when(why.isNull(), F.col("slope") / F.col("baseline")).alias("trend_per_day"))
    return _scored(series, samples, facts, until)


def agree(depressed: Column, available: Column) -> Column:
    return (depressed >= 2) & (2 * depressed > available)


def states(short: DataFrame, long: DataFrame) -> DataFrame:
    """State per code over its sensors on both baselines: counts, state, basis, worst deviations."""

    def rolled(df: DataFrame, tail: str) -> DataFrame:
        return df.groupBy("code").agg(F.count_if("available").alias(f"available{tail}"), F.count_if("depressed").alias(f"depressed{tail}"), F.min(F.when(F.col("available"), F.col("deviation"))).alias(f"worst{tail}"))

    r = rolled(short, "").join(rolled(long, "_long"), "code", "full").fillna(0, ["available", "depressed", "available_long", "depressed_long"])
    d, a, dl, al = (F.col(c) for c in ("depressed", "available", "depressed_long", "available_long"))
    state = F.when(agree(d, a), "disruption_sudden").when(agree(dl, al), "disruption_sustained").when((d >= 2) | (dl >= 2), "partial").when(a >= 2, "nominal").otherwise("degraded")
    basis = F.when(agree(d, a), "short").when(agree(dl, al), "long").when((d >= 2) & (dl >= 2), "both").when(d >= 2, "short").when(dl >= 2, "long")
    return r.withColumn("state", state).withColumn("basis", basis)


def ranked(rows: DataFrame) -> DataFrame:
    """Disruptions first, then partial, then the rest; within the first two by worst deviation; then by code."""
    rank = F.when(F.col("state").startswith("disruption"), 0).when(F.col("state") == "partial", 1).when(F.col("state") == "degraded", 2).otherwise(3)
    worst = F.least("worst", "worst_long")
    return rows.select("*", rank.alias("rank")).withColumn("place", F.row_number().over(Window.orderBy("rank", F.when(F.col("rank") <= 1, worst).otherwise(0.0), "code")))


def status(rows: DataFrame) -> DataFrame:
    """One row: codes, codes with any available sensor, and whether anything was seen at all."""
    return rows.agg(F.count("*").alias("codes"), F.count_if(F.col("available") > 0).alias("seen")).withColumn("status", F.when(F.col("seen") == 0, "unavailable").otherwise("ok"))


def last_good(polls: DataFrame) -> DataFrame:
    """polls: branch, ts, ok, value. The last good value and time of each branch, and whether the newest poll failed."""
    newest = polls.groupBy("branch").agg(F.max_by("ok", "ts").alias("ok"), F.max_by(F.struct("value", "ts"), F.when(F.col("ok"), F.col("ts"))).alias("good"))
    state = F.when(F.col("ok"), "ok").when(F.col("good").isNotNull(), "stale").otherwise("error")
    return newest.select("branch", state.alias("status"), F.col("good.value").alias("value"), F.col("good.ts").alias("as_of"))
