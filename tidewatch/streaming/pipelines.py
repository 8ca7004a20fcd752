"""Structured Streaming forms: exactly-once guards, windowed counts, tracks with state, and sinks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tidewatch.functions import text as T
from tidewatch.functions import values as V


def guarded(messages: DataFrame, keys: list[str], delay: str = "30 minutes") -> DataFrame:
    """Each message once: duplicates by key within the watermark are dropped and their state expires with it."""
    return messages.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


def gated(messages: DataFrame) -> DataFrame:
    """Messages with a time and a text that are not noise."""
    return T.without_noise(messages.filter("ts is not null and text is not null and text <> ''"))


def counted(events: DataFrame, key: str, size: str, slide: str | None = None, delay: str = "15 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.window("ts", size, slide or size), key).agg(F.count("*").alias("n"))


def in_order(batches: Iterator[pd.DataFrame]) -> dict[str, list]:
    """A key's rows as lists by column, in order of (ts, id): a key has few rows, and frames cost more than rows."""
    parts = list(batches)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts)
    order = np.lexsort((rows["id"].to_numpy(), rows["ts"].to_numpy()))
    return {c: rows[c].iloc[order].tolist() for c in rows.columns}


TRACK_OUT = "entity long, ts timestamp, id long, lat double, lon double"
TRACK_STATE = "lat double, lon double, last_us long"


def tracked(points: DataFrame, ttl_s: int = V.TRACK_TTL_S, delay: str = "10 minutes") -> DataFrame:
    """Recorded points of each entity (entity, ts, id, lat, lon): a point equal to the last recorded one, and at most
    ttl_s younger, is skipped and does not renew the track. State is dropped when the watermark passes the last recorded
    point by ttl_s: no later point can be equal in time, so batches do not matter."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        lat, lon, last = state.get if state.exists else (None, None, 0)
        rows = in_order(batches)
        out = []
        for ts, id_, y, x in zip(*(rows[c] for c in ("ts", "id", "lat", "lon")), strict=True):
            us = ts.value // 1000
            if (lat, lon) != (y, x) or us - last > ttl_s * 1_000_000:
                out.append((key[0], ts, id_, y, x))
                lat, lon, last = y, x, us
        state.update((lat, lon, last))
        due = last // 1000 + ttl_s * 1000
        if due > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(due)
        if out:
            yield pd.DataFrame(out, columns=["entity", "ts", "id", "lat", "lon"])

    return points.withWatermark("ts", delay).groupBy("entity").applyInPandasWithState(step, TRACK_OUT, TRACK_STATE, "append", GroupStateTimeout.EventTimeTimeout)


VESSEL = "lat double, lon double, sog double, true_heading double, cog double, nav_status int"
STATIC = "type int, destination string, length int"
SEEN = "ts timestamp, seen timestamp, placed boolean"
VESSEL_OUT = f"mmsi string, last_ts timestamp, seen timestamp, {VESSEL}, {STATIC}, name string, expired boolean"
VESSEL_KINDS = dict(c.split() for c in VESSEL_OUT.split(", "))
#: What is held of a vessel, in this order, and by a group of vessels, a list of each; times are microseconds there.
HELD = [*(c.split()[0] for c in f"{VESSEL}, {STATIC}".split(", ")), "name", "last_ts", "seen", "placed"]
GROUP_STATE = ", ".join(f"{c} array<{'boolean' if c == 'placed' else VESSEL_KINDS[c].replace('timestamp', 'long')}>" for c in ["mmsi", *HELD])
GROUP_OUT = VESSEL_OUT.replace("timestamp", "long")
#: Groups that vessels are dealt to by a hash of their mmsi. A stream keeps the number it began with.
VESSEL_GROUPS = 1_024


def known(kind: str, values: list) -> list:
    """values with None for each that is missing, and whole numbers as such (a column with gaps comes as floats)."""
    return [None if gap else int(x) if kind == "int" else x for x, gap in zip(values, pd.isna(pd.Series(values, dtype=object)), strict=True)]


def hear(held: dict, rows: dict[str, list], ttl) -> None:
    """Messages in order change what is held of their vessels: each field keeps its latest value. A name from a position message never
    erases one; a static message's name always counts.

    A vessel is seen with its last position (its last static message while it has none); a message that comes more than ttl after
    that starts anew, whether or not the vessel was ended before, so batches do not matter."""
    columns = [known(VESSEL_KINDS[c], rows[c]) for c in HELD[:8]]
    length = [(a or 0) + (b or 0) for a, b in zip(known("int", rows["dim_a"]), known("int", rows["dim_b"]), strict=True)]
    for mmsi, msg, name, t, lat, lon, sog, heading, cog, status, kind, to, size in zip(rows["mmsi"], rows["msg_type"], rows["ship_name"], rows["ts"], *columns, length, strict=True):
        v = held.get(mmsi)
        if v is None or t - v[11] > ttl:
            v = held[mmsi] = [None] * 12 + [False]
        if msg == "PositionReport":
            for i, x in enumerate((lat, lon, sog, heading, cog, status)):
                if x is not None:
                    v[i] = x
            if (name or "").strip():
                v[9] = name
            v[11], v[12] = t, True
        else:
            if kind is not None:
                v[6] = kind
            if to is not None:
                v[7] = to
            v[8], v[9] = size, name or ""
            if not v[12]:
                v[11] = t
        v[10] = t


class VesselState(StatefulProcessor):
    """What is known of one vessel (see hear), in states that are written apart: place, static fields, name and times.

    A timer in event time, ttl_s after the vessel was seen, drops all states and says so."""

    def __init__(self, ttl_s: int) -> None:
        self.ttl = pd.Timedelta(seconds=ttl_s)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place, self.static, self.name, self.times = (handle.getValueState(n, t) for n, t in (("place", VESSEL), ("static", STATIC), ("name", "name string"), ("times", SEEN)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        states = (self.place, self.static, self.name, self.times)
        were = [x and list(x) for x in (state.get() for state in states)] if self.times.exists() else [None] * 4  # times is there whenever another is
        held = {}
        if were[3]:
            held[key[0]] = [*(were[0] or [None] * 6), *(were[1] or [None] * 3), *(were[2] or [None]), *map(pd.Timestamp, were[3][:2]), were[3][2]]
        hear(held, in_order(rows), self.ttl)
        now = held[key[0]]
        for state, value, was in zip(states, (now[:6], now[6:9], now[9:10], now[10:]), were, strict=True):
            if all(x is None for x in value):
                if was is not None:
                    state.clear()
            elif value != was:
                state.update(tuple(value))
        if not were[3] or were[3][1] != now[11]:
            if were[3]:
                self.handle.deleteTimer(self.due(were[3][1]))
            self.handle.registerTimer(self.due(now[11]))
        yield frame([(key[0], now, False)], VESSEL_KINDS)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = [None] * 10 + list(self.times.get())
        for state in (self.place, self.static, self.name, self.times):
            state.clear()
        yield frame([(key[0], held, True)], VESSEL_KINDS)

    def due(self, seen) -> int:
        return int((pd.Timestamp(seen) + self.ttl).timestamp() * 1000) + 1


def frame(vessels: list[tuple], kinds: dict[str, str]) -> pd.DataFrame:
    """(mmsi, what is held, expired) as rows; columns are made with their types, as casts of a frame cost more than all else."""

    def column(kind: str, values: list):
        if kind == "int":
            return pd.array(values, "Int32")
        if kind == "double":
            return np.array(values, "float64")  # None becomes nan
        return np.array([pd.Timestamp(x).to_datetime64() for x in values], "datetime64[us]") if kind == "timestamp" else values

    ids, held, expired = zip(*vessels, strict=True)
    columns = {"mmsi": ids, "expired": expired} | dict(zip(HELD, zip(*held, strict=True), strict=True))
    return pd.DataFrame({c: column(kind, list(columns[c])) for c, kind in kinds.items()})


def vessels(messages: DataFrame, ttl_s: int = V.VESSEL_TTL_S, delay: str = "10 minutes", groups: int | None = VESSEL_GROUPS) -> DataFrame:
    """A row for each vessel (mmsi) that a batch changed, and one with `expired` when it ends. Messages at 0, 0 are left out. In a
    batch messages count in order of (ts, id).

    groups: vessels share a state and a timeout by so many hashes of their mmsi, so a batch calls Python once a group; a group's state is written
    whole when one of its vessels says something. None: each vessel is a call with states of its own (VesselState), which costs some
    milliseconds a vessel and batch."""
    real = messages.filter(~((F.coalesce("lat", F.lit(1)) == 0) & (F.coalesce("lon", F.lit(1)) == 0))).filter("mmsi is not null and ts is not null").withWatermark("ts", delay)
    if groups is None:
        return real.groupBy("mmsi").transformWithStateInPandas(VesselState(ttl_s), VESSEL_OUT, "Update", "EventTime")
    ttl = ttl_s * 1_000_000
    due = lambda v: (v[11] + ttl) // 1000 + 1
    kinds = dict(c.split() for c in GROUP_OUT.split(", "))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, *columns = state.get if state.exists else [[] for _ in range(1 + len(HELD))]
        held = {mmsi: list(v) for mmsi, *v in zip(ids, *columns, strict=True)}
        out = []
        if not state.hasTimedOut:
            rows = in_order(x.drop(columns="ts").rename(columns={"us": "ts"}) for x in batches)
            hear(held, rows, ttl)
            out += [(mmsi, held[mmsi], False) for mmsi in dict.fromkeys(rows["mmsi"])]
        now = state.getCurrentWatermarkMs()
        ended = [mmsi for mmsi, v in held.items() if due(v) <= now]
        out += [(mmsi, [None] * 10 + held.pop(mmsi)[10:], True) for mmsi in ended]
        if held:
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(min(map(due, held.values())))
        else:
            state.remove()
        if out:
            yield frame(out, kinds)

    dealt = real.withColumns({"us": F.unix_micros("ts"), "part": F.pmod(F.xxhash64("mmsi"), F.lit(groups))})
    rows = dealt.groupBy("part").applyInPandasWithState(step, GROUP_OUT, GROUP_STATE, "update", GroupStateTimeout.EventTimeTimeout)
    return rows.select(*[F.timestamp_micros(c).alias(c) if kind == "timestamp" else c for c, kind in VESSEL_KINDS.items()])


ARRIVAL = "polls long, failed long, late long, arrivals long, last_ts timestamp, last_id long, held long, arrived_at timestamp"
ARRIVAL_OUT = f"feed string, {ARRIVAL}"


class ArrivalState(StatefulProcessor):
    """When a feed's payload last changed. held is the hash of the newest payload; the first one is no arrival, a poll that failed
    (null hash) changes nothing, and one that comes later than a newer poll was counted is late and changes nothing either."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("arrival", ARRIVAL)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        polls, failed, late, arrivals, last_ts, last_id, held, stamp = self.state.get() if self.state.exists() else (0, 0, 0, 0, None, None, None, None)
        batch = pd.concat(list(rows))
        good = batch[batch["failed"] == 0].sort_values(["ts", "id"])
        if last_ts is not None:
            old = (good["ts"] < last_ts) | ((good["ts"] == last_ts) & (good["id"] <= last_id))
            late += int(old.sum())
            good = good[~old]
        polls, failed = polls + len(batch), failed + int(batch["failed"].sum())
        if len(good):
            hashes = good["hash"].to_numpy()
            changed = hashes != np.concatenate([[hashes[0] if held is None else held], hashes[:-1]])
            arrivals += int(changed.sum())
            if changed.any():
                stamp = good["ts"].to_numpy()[changed][-1]
            last_ts, last_id, held = good["ts"].iloc[-1], int(good["id"].iloc[-1]), int(hashes[-1])
        stamp = None if stamp is None else pd.Timestamp(stamp)
        now = (polls, failed, late, arrivals, last_ts, last_id, held, stamp)
        self.state.update(now)
        out = pd.DataFrame([[key[0], *now]], columns=[c.split()[0] for c in ARRIVAL_OUT.split(", ")], dtype=object)
        yield out.astype(dict.fromkeys(("polls", "failed", "late", "arrivals"), "int64") | dict.fromkeys(("last_id", "held"), "Int64") | dict.fromkeys(("last_ts", "arrived_at"), "datetime64[us]"))


def arrivals(polls: DataFrame) -> DataFrame:
    """polls: feed, ts, id, payload (null: the poll failed). A row for each feed that a batch polled: how many polls there were so far and
    when a payload came that differs from the one before it (null: never). Payloads are hashed where they are read; a feed's
    part of one batch, 25 bytes a poll, is put in order in one task, so the trigger bounds it. Polls without a feed or a time are left out."""
    slim = polls.filter("feed is not null and ts is not null and id is not null").select("feed", "ts", "id", F.xxhash64("payload").alias("hash"), F.col("payload").isNull().cast("int").alias("failed"))
    return slim.groupBy("feed").transformWithStateInPandas(ArrivalState(), ARRIVAL_OUT, "Update", "None")


def run_available(stream: DataFrame, out: str, checkpoint: str, body: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> list[dict]:
    """Process everything that is there, then stop; what the batches report of themselves. Files are written exactly once; body replaces
    the file sink. States of several parts need the store that has column families, so it serves all streams here."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    w = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    w = w.foreachBatch(body) if body else w.format("parquet").option("path", out)
    query = w.start()
    query.awaitTermination()
    return [json.loads(p.json) for p in query.recentProgress]
