"""The ingest sink and the message source: crashes between writes, replays, restarts, messages sent twice."""

import json
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import linking
from tidewatch.sources import messages
from tidewatch.streaming import ingest, pipelines

WORDS = ["convoy", "bridge", "northern", "district", "reported", "explosion", "harbour", "officials", "several", "crossing", "overnight", "damage", "station", "power", "airport", "closed"]


def some(n=60, seed=1):
    """Messages over two midnights; every third repeats most of the words of the one before from another channel."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = " ".join(rng.sample(WORDS, 10)) if i % 3 != 1 else " ".join(rows[-1][3].split()[:9]) + " tonight again"
        ts = datetime(2024, 3, 1, 22, 30, tzinfo=timezone.utc) + timedelta(minutes=5 * i)
        kind = rows[-1][5] if i % 3 == 1 else rng.choice(["strike", "cyber"])
        rows.append((i, f"c{i % 4}" if i % 7 else "", 100 + i, text, ts, kind, None, None, rng.choice([None, 3, 5, 9]), rng.choice([None, 1, 3, 5]), rng.choice(["ok", "ok", "parse_failed"]), None))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, ingest.MESSAGE)


def tables(store):
    events = [tuple(r) for r in store.events().select("id", "report_count", "severity", "n_channels", "reliability", "channels", "day").collect()]
    reports = [tuple(r) for r in store.reports().select("event_id", "id", "channel", "message_id", "day").collect()]
    return sorted(map(str, events)), sorted(map(str, reports)), sorted(map(str, store.checkpoints().collect()))


def fill(spark, root, parts):
    store = ingest.Store(spark, str(root))
    for epoch, rows in enumerate(parts):
        ingest.ingest(store)(frame(spark, rows), epoch)
    return store


def test_steps_give_what_one_batch_gives(spark, tmp_path):
    rows = some(36)
    one = fill(spark, tmp_path / "one", [rows])
    many = fill(spark, tmp_path / "many", [rows[:20], [], rows[5:30], rows[30:]])
    assert tables(one) == tables(many)
    want = linking.linked_events(frame(spark, rows)).collect()
    got = {r["id"]: r for r in one.events().collect()}
    assert len(got) == len(want) < len(rows)
    for r in want:
        assert all(got[r["event_id"]][c] == r[c] for c in ("report_count", "severity", "n_channels", "reliability"))
    leads = {r["event_id"] for r in want}
    far = {r["channel"]: r["last_message_id"] for r in one.checkpoints().collect()}
    assert far == {c: max(m for i, c_, m, *_ in rows if c_ == c and i in leads) for c in {r[1] for r in rows if r[0] in leads}}


@pytest.mark.parametrize("at", ["reports", "commit"])
def test_a_crash_between_writes_leaves_nothing_and_its_replay_all(spark, tmp_path, monkeypatch, at):
    rows = some(30)
    whole = tables(fill(spark, tmp_path / "whole", [rows[:20], rows[20:]]))
    store = fill(spark, tmp_path / "crashed", [rows[:20]])
    before = tables(store)

    class Crash(Exception):
        pass

    def crash(*_):
        raise Crash

    if at == "commit":
        monkeypatch.setattr(store, "commit", crash)
    else:
        writer = type(spark.range(1).write)
        write = writer.parquet

        def failing(self, path, *a, **k):
            if f"/{at}/epoch=1" in path:
                crash()
            return write(self, path, *a, **k)

        monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(Crash):
        ingest.ingest(store)(frame(spark, rows[20:]), 1)
    monkeypatch.undo()
    assert tables(store) == before
    ingest.ingest(store)(frame(spark, rows[20:]), 1)
    assert tables(store) == whole
    ingest.ingest(store)(frame(spark, rows[20:]), 1)  # committed: skipped
    assert tables(store) == whole


def test_gates_and_keys(spark, tmp_path):
    text = "a long enough message about the bridge and the harbour in the district"
    at = datetime(2024, 3, 1, tzinfo=timezone.utc)
    rows = [(0, "a", 1, text, at, "x", None, None, 5, None, "ok", None), (1, "a", 1, text, at, "y", None, None, 5, None, "ok", None), (2, None, 1, text, at, "z", None, None, None, None, None, None), (3, None, 1, text, at, "w", None, None, None, None, None, None)]
    rows += [(4, "b", 1, "  ", at, "x", None, None, None, None, None, None), (5, "b", 2, None, at, "x", None, None, None, None, None, None), (6, "b", 3, "short", at, "x", None, None, None, None, None, None), (7, "b", 4, text, at, "x", None, None, 1, None, "ok", None)]
    rows += [(8, "b", 5, text, None, "x", None, None, None, None, None, None), (9, "b", 6, text, at - timedelta(days=2), "x", None, None, None, None, None, None)]
    store = ingest.Store(spark, str(tmp_path))
    ingest.ingest(store, "2024-02-29 12:00:00")(frame(spark, rows), 0)
    assert sorted(r["id"] for r in store.events().collect()) == [0, 2, 3]
    empty = ingest.Store(spark, str(tmp_path / "none"))
    assert empty.events().count() == empty.reports().count() == empty.checkpoints().count() == 0


def line(i, **more):
    return json.dumps({"channel": f"c{i % 3}", "message_id": i, "seen": 1_709_000_000 + i, "text": f"m{i}\n é"} | more, ensure_ascii=False)


def test_message_source_reads_each_number_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    spark.dataSource.register(messages.Messages)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def read():
        stream = spark.readStream.format("message_log").option("path", str(log)).load()
        pipelines.run_available(stream, out, checkpoint)
        return sorted((r["offset"], r["message_id"], r["text"]) for r in spark.read.parquet(out).collect())

    assert read() == []
    (log / "0.jsonl").write_text("".join(line(i) + "\n" for i in range(7)))
    (log / "7.jsonl").write_text("not json\n[1]\n" + json.dumps({"message_id": "x", "seen": None, "text": 3}) + "\n")
    (log / ".half").write_text(line(99))
    want = [(i, i, f"m{i}\n é") for i in range(7)] + [(i, None, None) for i in (7, 8, 9)]
    assert read() == want
    assert read() == want
    (log / "10.jsonl").write_text("".join(line(i) + "\n" for i in range(10, 15)))
    assert read() == want + [(i, i, f"m{i}\n é") for i in range(10, 15)]


def test_partitions_split_segments(tmp_path, monkeypatch):
    log = tmp_path / "log"
    log.mkdir()
    (log / "0.jsonl").write_text("".join(line(i) + "\n" for i in range(25)))
    (log / "25.jsonl").write_text("".join(line(i) + "\n" for i in range(25, 31)))
    monkeypatch.setattr(messages, "PART", 10)
    reader = messages.Log(f"file://{log}")
    assert reader.latestOffset() == {"next": 31}
    parts = reader.partitions({"next": 3}, {"next": 31})
    assert [(p.start, p.end) for p in parts] == [(3, 13), (13, 23), (23, 25), (25, 31)]
    assert [x for p in parts for b in reader.read(p) for x in b.column(0).to_pylist()] == list(range(3, 31))


def test_landed_messages_are_numbered_in_order(spark, tmp_path):
    rows = [(i, f"c{i % 2}", i, datetime(2024, 1, 1, tzinfo=timezone.utc), f"t{i}") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, channel string, message_id long, seen timestamp, text string").repartition(3)
    assert messages.land(df.filter("id < 30"), str(tmp_path)) == 30
    assert messages.land(df.filter("id >= 30"), str(tmp_path), 30) == 50
    assert messages.land(df.filter("id > 99"), str(tmp_path), 50) == 50
    reader = messages.Log(str(tmp_path))
    got = [x for p in reader.partitions({"next": 0}, reader.latestOffset()) for b in reader.read(p) for x in zip(*(b.column(c).to_pylist() for c in (0, 2)), strict=True)]
    assert got == [(i, i) for i in range(50)]
