"""Spatio-temporal near-duplicate linking and the folding of evidence into events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import values as V
from tidewatch.functions.geo import haversine
from tidewatch.session import cut, small

#: Messages of close pairs, and rows that are filed, of so many at most may be broadcast.
PAIRS_BROADCAST = 300_000


def near(probes: DataFrame, stored: DataFrame, window_s: int = V.DUP_WINDOW_S, radius_km: float = V.DUP_RADIUS_KM, earlier: bool = True) -> DataFrame:
    """Pairs (probe_id, id) of one event_type within the window, located with located inside the radius or unlocated
    with unlocated. Both sides: id, event_type, ts, lat, lon. earlier: only stored rows of smaller id.

    A binned join: probes look into three time bins and, if located, nine grid cells; each pair meets once. Rows of
    cells are half a degree of latitude high; their cells are one degree of longitude wide, four from 60 degrees on
    (at least 50 km up to 83 degrees), and wrap around at the date line. Both sides are shuffled: files are too small a
    measure of what they hold in memory to broadcast one of them by."""

    def column_of(lon: Column, cy: Column, step: int = 0) -> Column:
        width = F.when(F.abs(cy) >= 120, 4).otherwise(1)
        return F.pmod(F.floor((lon + 180) / width) + step, F.lit(360) / width).cast("int")

    located = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    ts = F.col("ts").cast("timestamp")
    base = ["id", "event_type", "ts", "lat", "lon", located.alias("located"), F.unix_micros(ts).alias("us"), F.floor(F.unix_timestamp(ts) / window_s).alias("bin")]
    row = F.when(located, F.floor(F.col("lat") * 2)).otherwise(0)
    s = stored.select(*base, row.alias("cy")).withColumn("cx", F.when(F.col("located"), column_of(F.col("lon"), F.col("cy"))).otherwise(0))
    p = probes.select(*base, F.explode(F.when(located, F.array(row - 1, row, row + 1)).otherwise(F.array(row))).alias("cy"))
    p = p.withColumn("cx", F.explode(F.when(F.col("located"), F.array(*[column_of(F.col("lon"), F.col("cy"), d) for d in (-1, 0, 1)])).otherwise(F.array(F.lit(0)))))
    p = p.withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)))
    p, s = p.alias("p"), s.alias("s")
    same = [F.col(f"p.{c}") == F.col(f"s.{c}") for c in ("event_type", "located", "bin", "cy", "cx")]
    close = F.when(F.col("p.located"), haversine(F.col("p.lat"), F.col("p.lon"), F.col("s.lat"), F.col("s.lon")) <= radius_km).otherwise(True)
    rule = (F.abs(F.col("p.us") - F.col("s.us")) <= window_s * 1_000_000) & close
    rule = rule & ((F.col("s.id") < F.col("p.id")) if earlier else (F.col("s.id") != F.col("p.id")))
    return p.join(s.hint("merge"), same).filter(rule).select(F.col("p.id").alias("probe_id"), F.col("s.id").alias("id"), F.col("s.ts").alias("ts"), F.col("p.located").alias("located"))


def candidates(probes: DataFrame, stored: DataFrame, **how) -> DataFrame:
    """near(), with each probe's candidates ranked newest first and capped as the link rule has it."""
    newest = Window.partitionBy("probe_id").orderBy(F.desc("ts"), F.desc("id"))
    cap = F.when(F.col("located"), V.DUP_CAP_LOCATED).otherwise(V.DUP_CAP_UNLOCATED)
    return near(probes, stored, **how).withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= cap).select("probe_id", "id", "rank")


def similar_pairs(messages: DataFrame, probes: DataFrame | None = None, texts: DataFrame | None = None, **how) -> DataFrame:
    """Pairs (probe_id, id, ts of id) of messages (near() columns and text) whose word sets are alike. probes: those of the
    messages that look for earlier ones (all). texts: id and text of all messages (more do no harm), where they lie apart.

    A pair first meets by the sizes of its sets, then by their signs (two bytes a word, no word of which two sets share lies in
    places of one sign alone), and only pairs that both let pass by the words, which are then read once more out of these texts alone."""
    texts = messages if texts is None else texts
    words_of = lambda texts: texts.select("id", T.word_set(F.col("text")).alias("words"))
    signs = cut(words_of(texts).select("id", F.size("words").alias("n"), T.places_of(F.col("words")).alias("sign"))).filter("n > 0")  # a filter before would find the words twice
    a, b = F.col("n"), F.col("m")
    # The shared part is at most the smaller set: 5 shared > 2 (n + m - shared) needs 7 min(n, m) > 2 (n + m).
    enough = lambda shared: 7 * shared > 2 * (a + b)
    pairs = near(messages if probes is None else probes, messages, **how).join(signs.select(F.col("id").alias("probe_id"), "n"), "probe_id").join(signs.select("id", F.col("n").alias("m")), "id").filter(enough(F.least(a, b)))
    met = pairs.join(signs.select("id", F.col("sign").alias("other")), "id").join(signs.select(F.col("id").alias("probe_id"), "sign"), "probe_id")
    # A place that only one set has holds a word that only this set has.
    shared = F.size(F.array_intersect("sign", "other"))
    most = F.least(a - F.size("sign"), b - F.size("other")) + shared
    close = cut(met.filter(enough(most)).select("probe_id", "id", "ts"))
    looked = small(close.select(F.explode(F.array("probe_id", "id")).alias("id")).distinct(), PAIRS_BROADCAST)
    sets = cut(words_of(texts.join(looked, "id", "left_semi")))
    both = close.join(sets.select(F.col("id").alias("probe_id"), F.col("words").alias("a")), "probe_id").join(sets.withColumnRenamed("words", "b"), "id")
    both = both.withColumn("n", F.size("a")).withColumn("m", F.size("b"))
    return both.filter(enough(F.size(F.array_intersect("a", "b")))).select("probe_id", "id", "ts")


def leaders(messages: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """id, leader: each message, in order of id, joins the newest earlier leader that it is like, or leads itself.

    Who leads depends on earlier decisions. Each round decides the messages whose newest leading like is known: all that
    are newer are decided and do not lead. One without a leading like leads, the others join. Rounds number the longest
    chain of likes at most; a round joins the pairs still open with the last decisions, so no group meets in one task,
    and what is decided is not read again."""
    pairs = cut(similar_pairs(messages) if pairs is None else pairs)
    done = [messages.select("id").join(pairs.select(F.col("probe_id").alias("id")).distinct(), "id", "left_anti").select("id", F.lit(True).alias("leads"), F.col("id").alias("leader"))]
    done[0] = cut(done[0])
    open_ = pairs.withColumn("leads", F.lit(None).cast("boolean"))
    while True:
        last = done[-1].select("id", F.col("leads").alias("now"))
        open_ = cut(open_.join(last, "id", "left").withColumn("leads", F.coalesce("leads", "now")).drop("now"))
        place = F.struct("ts", "id")
        best, waiting = F.max(F.when(F.col("leads"), place)), F.max(F.when(F.col("leads").isNull(), place))
        rounds = open_.groupBy("probe_id").agg(best.alias("best"), waiting.alias("waiting")).filter("waiting is null or best > waiting")
        ready = cut(rounds.select(F.col("probe_id").alias("id"), F.col("best").isNull().alias("leads"), F.coalesce("best.id", "probe_id").alias("leader")))
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, done).select("id", "leader")
        done.append(ready)
        open_ = open_.join(ready.select(F.col("id").alias("probe_id")), "probe_id", "left_anti")


def first_seen(reports: DataFrame) -> DataFrame:
    """event_id, channel, seq of each named channel's first report."""
    return reports.filter("channel <> ''").groupBy("event_id", "channel").agg(F.min("seq").alias("seq"))


def fold(reports: DataFrame) -> DataFrame:
    """reports: event_id, seq (the event's own has the least), channel, reliability, severity, status. Per event: report_count, severity
    (its own; the largest of all where its own reading is ok), n_channels (named, distinct), reliability.

    Each merge takes the larger of the current reliability and its own (null counts as 1), then adds 1 once three distinct
    named channels reported, up to 5. Written out over all merges that is min(5, max over j of (value j + additions from
    merge j on)). Four additions reach 5 from any value, so what counts is how many reports came from the third channel's first one
    on, and which those are where they are three at most. So an event's reports are only ever added up, and never meet in one task."""
    third = first_seen(reports).groupBy("event_id").agg(F.count("*").alias("n_channels"), F.get(F.array_sort(F.collect_list("seq")), F.lit(2)).alias("third"))  # one entry per channel
    rows = reports.join(third, "event_id", "left").withColumn("late", F.coalesce(F.col("seq") >= F.col("third"), F.lit(False))).withColumn("value", F.coalesce("reliability", F.lit(1)))
    sums = rows.groupBy("event_id").agg(
        F.count("*").alias("report_count"), F.min_by(F.struct("status", "severity"), "seq").alias("own"), F.max("severity").alias("most"), F.max("n_channels").alias("n_channels"),
        F.max("value").alias("top"), F.max(F.when(~F.col("late"), F.col("value"))).alias("before"), F.count_if("late").alias("plus"),
    )
    few = sums.filter("plus between 1 and 3").select("event_id", F.col("plus"), F.col("before"))
    place = F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("seq")))  # three rows at most
    last = rows.filter("late").select("event_id", "seq", "value").join(few, "event_id").withColumn("gain", F.col("value") + place).groupBy("event_id").agg(F.greatest(F.max("gain"), F.max(F.col("before") + F.col("plus"))).alias("gained"))
    reliability = F.when(F.col("plus") == 0, F.least("top", F.lit(5))).when(F.col("plus") > 3, 5).otherwise(F.least("gained", F.lit(5)))
    severity = F.when(F.col("own.status").eqNullSafe("ok"), F.col("most")).otherwise(F.col("own.severity"))
    return sums.join(last, "event_id", "left").select("event_id", "report_count", severity.alias("severity"), F.coalesce("n_channels", F.lit(0)).cast("long").alias("n_channels"), reliability.cast("int").alias("reliability"))


def channel_list(reports: DataFrame, compat: bool = True) -> DataFrame:
    """event_id, channels: names in order of arrival, joined by comma and space. compat: a name contained in the text so far is
    left out even where it is only part of another name; else names are told apart. (A name already seen is contained, so
    first reports are enough.)"""
    names = first_seen(reports).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "channel"))), lambda r: r["channel"]).alias("names"))  # one entry per channel
    step = lambda acc, c: F.when(F.contains(acc, c), acc).when(acc == "", c).otherwise(F.concat(acc, F.lit(", "), c))
    text = F.aggregate("names", F.lit(""), step) if compat else F.array_join("names", ", ")
    return reports.select("event_id").distinct().join(names, "event_id", "left").select("event_id", F.coalesce(text, F.lit("")).alias("channels"))


def linked_events(messages: DataFrame) -> DataFrame:
    """The flagship: messages (id, event_type, ts, lat, lon, text, channel, reliability, severity, status) linked to
    leaders, each leader with its folded evidence."""
    lead = leaders(messages)
    return fold(messages.join(lead, "id").select(F.col("leader").alias("event_id"), F.col("id").alias("seq"), "channel", "reliability", "severity", "status"))
