"""Streams whose state matters, and dumps read in several tasks."""

import gzip
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tidewatch.operators import feed
from tidewatch.plans import stream_queries
from tidewatch.sources import dumps
from tidewatch.streaming import pipelines

DUMP = r"""-- a dump
COPY public.reports (id, text) FROM stdin;
1	no\tevent
COPY public.events (id) FROM stdin in a text
\.

COPY public.events (id, "source", channel_name, raw_text) FROM stdin;
{rows}
\.

COPY public.events (id, source, channel_name, raw_text) FROM stdin;
9999	x	y	a second block
\.
""".replace("COPY public.events (id) FROM stdin in a text\n", "")


def row(i):
    return {0: f"{i}\tweb\t\\N\ta\\nb\\\\n {i} café", 1: f"{i}\trss\t\tq\\q \\101 end\\", 2: f"{i}\tshort"}[min(i % 7, 2) if i % 7 < 3 else 0]


def want(n):
    out = []
    for i in range(n):
        kind = min(i % 7, 2) if i % 7 < 3 else 0
        if kind == 0:
            out.append((str(i), "web", None, f"a\nb\\n {i} café"))
        elif kind == 1:
            out.append((str(i), "rss", "", "qq 101 end\\"))
    return sorted(out, key=str)


def read(spark, path):
    rows = [r["row"] for r in dumps.copy_rows(spark, path, "public.events").collect()]
    names = ("id", "source", "channel_name", "raw_text")
    assert all(sorted(r) == sorted(names) for r in rows)
    return sorted((tuple(r[c] for c in names) for r in rows), key=str)


def test_a_dump_read_by_many_tasks(spark, tmp_path):
    n = 3000
    (tmp_path / "dump.sql").write_text(DUMP.format(rows="\n".join(map(row, range(n)))))
    path, was = str(tmp_path / "dump.sql"), spark.conf.get("spark.sql.files.maxPartitionBytes")
    one = read(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", str((tmp_path / "dump.sql").stat().st_size // 9))
    try:
        assert dumps.lines(spark, path).rdd.getNumPartitions() >= 8
        assert read(spark, path) == one == want(n)
        assert dumps.copy_counts(spark, path, "public.events").first().asDict() == {"rows": len(one), "short": n - len(one)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    with gzip.open(tmp_path / "dump.sql.gz", "wt") as f:
        f.write(DUMP.format(rows="\n".join(map(row, range(50)))))
    assert read(spark, str(tmp_path / "dump.sql.gz")) == want(50)


def test_dumps_without_the_table_or_its_end(spark, tmp_path):
    (tmp_path / "none.sql").write_text("junk\n\\.\n")
    assert read(spark, str(tmp_path / "none.sql")) == []
    (tmp_path / "torn.sql").write_text("COPY public.events (id, source, channel_name, raw_text) FROM stdin;\n1\ta\tb\tc\n2\ta")
    assert read(spark, str(tmp_path / "torn.sql")) == [("1", "a", "b", "c")]
    assert dumps.copy_counts(spark, str(tmp_path / "torn.sql"), "public.events").first().asDict() == {"rows": 1, "short": 1}


def test_escapes_round_trip(spark):
    texts = ["", "a\nb\tc\r\\d", "\\n", "\\\\", "\b\f\v", "end\\", None, "\\N"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", dumps.unescape(F.when(dumps.escape(F.col("t")) != "\\N", dumps.escape(F.col("t")))).alias("u"))
    assert all(r["t"] == r["u"] for r in df.collect())


def dropped(reports, name):
    return sum(int(s["customMetrics"].get(name, 0)) for p in reports for s in p["stateOperators"])


def test_the_guards_state_finds_duplicates(spark, data):
    reports: list = []
    got = stream_queries.stream_dedup(spark, data, reports)
    ids = [r["event_id"] for r in got.select("event_id").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{data}/events.parquet").count()
    assert dropped(reports, "numDroppedDuplicateRows") > 0
    assert sum(s["numRowsDroppedByWatermark"] for p in reports for s in p["stateOperators"]) > 0


FIELDS = "mmsi string, msg_type string, ship_name string, ts timestamp, id long, lat double, lon double, sog double, true_heading double, cog double, nav_status int, type int, destination string, dim_a int, dim_b int"


def test_vessels_over_batches(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    place = lambda m, minute, i, name=None, **x: (m, "PositionReport", name, start + timedelta(minutes=minute), i, x.get("lat", 1.0), 2.0, x.get("sog"), None, 3.0, 4, None, None, None, None)
    static = lambda m, minute, i, name=None, to=None: (m, "ShipStaticData", name, start + timedelta(minutes=minute), i, None, None, None, None, None, None, 70, to, 100, None)
    steps = [
        [place("a", 0, 1, "ALPHA", sog=5.0), static("b", 1, 2, "BETA", "X"), place("z", 0, 3, lat=0.0)[:6] + (0.0,) + place("z", 0, 3)[7:], static("c", 0, 90, "GAMMA")],
        [place("b", 4, 4, " "), place("a", 5, 5, sog=None), static("a", 3, 6, "", "Y")],
        [place("b", 30, 7, "NEW"), place("b", 31, 8)],
        [place("d", 120, 9)],
        [place("d", 121, 10)],
    ]
    seen = []
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(FIELDS).parquet(f"{tmp_path}/in")
    for rows in steps:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        pipelines.run_available(pipelines.vessels(stream), "", f"{tmp_path}/checkpoint", lambda b, e: seen.extend((e, r) for r in b.collect()), "update")
    assert not any(r["mmsi"] == "z" for _, r in seen)
    a = [r for _, r in seen if r["mmsi"] == "a" and not r["expired"]]
    assert [(r["name"], r["sog"], r["destination"], r["length"]) for r in a] == [("ALPHA", 5.0, None, None), ("", 5.0, "Y", 100)]
    b = [r for _, r in seen if r["mmsi"] == "b" and not r["expired"]]
    assert [(r["name"], r["type"], r["lat"]) for r in b] == [("BETA", 70, None), ("BETA", 70, 1.0), ("NEW", None, 1.0)]  # 26 minutes away: a new vessel
    assert {r["mmsi"] for _, r in seen if r["expired"]} == {"a", "b", "c"}


def test_trends_carry_over_ranges(spark):
    rows = [(f"k{i % 3 if i < 200 else 0}", i, i // 5, (i * 7) % 11 if i % 4 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, id long, ts long, severity int")
    got = {r["id"]: r["trend"] for r in feed.severity_trend(df, "k").collect()}
    for k, i, _, _ in rows:
        last = [s for kk, j, _, s in rows if kk == k and j <= i][-20:]
        known = [s for s in last if s is not None]
        assert got[i] == (round(sum(known) / len(known), 6) if known else None)
