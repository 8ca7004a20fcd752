"""What reviews found on odd inputs and larger tables."""

import random
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import values as V
from tidewatch.operators import guards, linking, places
from tidewatch.sources import dumps
from tidewatch.streaming import ingest, pipelines


def test_no_side_of_the_link_join_is_broadcast(spark, capsys):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, "x", at + timedelta(minutes=i), None, None) for i in range(40)], "id long, event_type string, ts timestamp, lat double, lon double")
    pairs = linking.candidates(df, df)
    assert pairs.count() == sum(min(i, 15) for i in range(40))
    pairs.explain()
    assert "BroadcastHashJoin" not in capsys.readouterr().out


def test_spans_of_words_that_elsewhere_stand_for_no_place(spark):
    df = spark.createDataFrame([(1, "era como un lugar", "un", None), (2, "era como un lugar", "", None), (3, "un", "un", "")], "id int, raw_text string, location_name string, evidence_span string")
    assert [r["evidence_span"] for r in guards.repair_spans(df, no_places=("",)).orderBy("id").collect()] == ["un", "", ""]
    assert [r["evidence_span"] for r in guards.repair_spans(df).orderBy("id").collect()] == ["", "", ""]


def test_words_of_ascii_end_at_other_letters(spark):
    texts = spark.createDataFrame([(1, "Bergech zu denüau"), (2, "bergech zu denx"), (3, "éold mill é"), (4, "an Old mill²")], "id int, text string")
    keys = spark.createDataFrame([("bergech zu den", 1), ("old mill", 2), ("old", 3)], "key string, pos int")
    assert {(r["id"], r["key"]) for r in places.longest_contained(texts, keys, places.ASCII).collect()} == {(1, "bergech zu den"), (3, "old mill"), (4, "old mill")}
    assert {(r["id"], r["key"]) for r in places.longest_contained(texts, keys).collect()} == {(4, "old")}


def test_dumps_get_more_files_as_they_grow(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(dumps, "FILE_BYTES", 2_000)
    rows = spark.range(1000).selectExpr("id", "concat('text ', id) as raw_text")
    path = str(tmp_path / "dump")
    dumps.write_blocks(dumps.copy_lines(rows, "id"), rows.columns, path, "public.events")
    files = [p for p in (tmp_path / "dump").iterdir() if p.name.endswith(".txt")]
    assert len(files) >= 6 and max(p.stat().st_size for p in files) < 4_000
    assert all(p.read_text().startswith("COPY public.events (id, raw_text) FROM stdin;\n") and p.read_text().endswith("\n\\.\n") for p in files)
    got = dumps.copy_rows(spark, path, "public.events").select("row.id", "row.raw_text")
    assert sorted((int(r["id"]), r["raw_text"]) for r in got.collect()) == [(i, f"text {i}") for i in range(1000)]


def test_a_toll_is_looked_for_once(spark):
    rows = [("three people were killed", "count_then_kill", 3), ("MıſſING ones", "wounded", None), ("قتل 5", "arabic", None), ("no one was killed", "zero", 0), ("", None, None), (None, None, None), ("a quiet day", "none", None)]
    got = spark.createDataFrame(rows, "text string, bucket string, n int").select(T.toll(F.col("text")).alias("t"), "bucket", "n")
    assert all((r["t"]["bucket"], r["t"]["count"]) == (r["bucket"], r["n"]) for r in got.collect())
    assert T.toll_count(F.col("text"))._jc.toString().count("(?:wounded|injur") == 1


class Kept:
    def __init__(self):
        self.value, self.written = None, 0

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value, self.written = value, self.written + 1

    def clear(self):
        self.value = None


def test_a_vessels_states_are_written_only_when_they_change():
    vessel, kept = pipelines.VesselState(900), []
    timers = type("Handle", (), {"getValueState": lambda _, *a: kept.append(Kept()) or kept[-1], "registerTimer": lambda *_: None, "deleteTimer": lambda *_: None})
    vessel.init(timers())
    row = lambda i: pd.DataFrame([("a", "PositionReport", "A", pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i), i, 1.0, 2.0, None, None, 3.0, 4, None, None, None, None)], columns=["mmsi", "msg_type", "ship_name", "ts", "id", "lat", "lon", "sog", "true_heading", "cog", "nav_status", "type", "destination", "dim_a", "dim_b"])
    for i in range(3):
        out = list(vessel.handleInputRows(("a",), iter([row(i)]), None))
        assert out[0]["lat"].tolist() == [1.0] and out[0]["nav_status"].tolist() == [4] and out[0]["name"].tolist() == ["A"]
    assert [x.written for x in kept[1:]] == [0, 1, 3]  # static, name, times


def test_messages_sent_again_write_no_day_anew_and_texts_move_once(spark, tmp_path, monkeypatch):
    text = "a long enough message about the bridge and the harbour in the district "
    row = lambda i, n, day: (i, "a", n, text + "x" * n, datetime(2024, 3, day), "x", None, None, 5, None, "ok", None)
    store = ingest.Store(spark, str(tmp_path))
    moved = []
    monkeypatch.setattr(linking, "similar_pairs", lambda known, new, texts, f=linking.similar_pairs: moved.append((known.columns, new.columns)) or f(known, new, texts))
    for epoch, rows in enumerate([[row(0, 1, 1)], [row(1, 1, 1), row(2, 2, 5)]]):
        ingest.ingest(store)(spark.createDataFrame(rows, ingest.MESSAGE), epoch)
    assert {d.day: e for d, e in store.written("events", None).items()} == {1: [0], 5: [1]}
    assert sorted((r["id"], r["text"]) for r in store.events().collect()) == [(0, text + "x"), (2, text + "xx")]
    assert not any("text" in c for pair in moved for c in pair)


def test_only_texts_that_begin_a_key_are_looked_at(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "the red barn, the old mill"), (2, "by THE  red mill"), (3, "the red mill²"), (4, "ΟΔΌΣ ένας STRAẞE"), (5, "x Ⓐ; ⓐ"), (6, "«the red mill»"), (7, "οδός"), (None, "the Red Mill")], "id int, text string")
    keys = spark.createDataFrame([("the red mill", 1), ("οδόσ", 2), ("straße", 3), ("Ⓐ", 4), ("ένας straße", 5), ("red mill", 6), ("...", 7)], "key string, pos int")
    met, cut = [], places.cut
    monkeypatch.setattr(places, "cut", lambda df: met.append(cut(df)) or met[-1])
    show = lambda df: {(r["id"], r["pos"], r["span"]) for r in df.collect()}
    got = show(places.spelled(texts, keys))
    assert got == show(texts.crossJoin(keys).select("id", "pos", T.evidence_span(F.col("text"), F.col("key")).alias("span")).filter("span <> ''"))
    assert {(4, 2), (4, 5), (5, 4), (6, 1), (None, 6), (7, 2)} <= {(i, pos) for i, pos, _ in got}
    assert {r["_id"] for r in met[-1].filter("pos = 1").collect()} == {2, 3, 6, None}


def test_vessels_of_a_group_share_a_state_and_come_out_as_each_alone(spark, tmp_path):
    rng, fields = random.Random(3), "mmsi string, msg_type string, ship_name string, ts timestamp, id long, lat double, lon double, sog double, true_heading double, cog double, nav_status int, type int, destination string, dim_a int, dim_b int"
    maybe = lambda *x: rng.choice([None, *x])
    steps, seen, state = [[], [], []], {}, []
    for i in range(600):
        at = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=10 * i + rng.randrange(-300, 300))
        static = rng.random() < 0.3
        said = (None, None, None, None, None, None, maybe(70), maybe("A", "B"), maybe(9), maybe(5)) if static else (maybe(1.5), 2.0, maybe(5.0), None, maybe(3.0), maybe(1, 4), None, None, None, None)
        steps[i // 200].append((f"v{rng.randrange(60)}", "ShipStaticData" if static else "PositionReport", maybe("", " ", f"S{i % 9}"), at, i, *said))
    for groups in (4, None):
        at, out = f"{tmp_path}/{groups}", seen.setdefault(groups, [])
        for rows in steps:
            spark.createDataFrame(rows, fields).coalesce(1).write.mode("append").parquet(f"{at}/in")
            stream = pipelines.vessels(spark.readStream.schema(fields).parquet(f"{at}/in"), groups=groups)
            said = pipelines.run_available(stream, "", f"{at}/checkpoint", lambda b, e, out=out: out.extend((e, *r) for r in b.collect()), "update")
            state += [s["numRowsTotal"] for p in said for s in p["stateOperators"]] if groups else []
    order = lambda rows: sorted(rows, key=str)
    assert order(seen[4]) == order(seen[None]) and any(r[-1] for r in seen[4]) and len({r[1] for r in seen[4]}) == 60
    assert 0 < max(state) <= 4


def test_a_batch_of_many_days_is_few_files_and_its_texts_are_written_once(spark, tmp_path):
    text = "a long enough message about the bridge and the harbour in the district "
    rows = [(i, "a", i, text + "x" * i, datetime(2024, 1, 1) + timedelta(days=i), "x", None, None, 5, None, "ok", None) for i in range(60)]
    store = ingest.Store(spark, str(tmp_path))
    for epoch, part in enumerate((rows[:50], rows[40:])):
        ingest.ingest(store)(spark.createDataFrame(part, ingest.MESSAGE), epoch)
    assert len(store.written("events", None)) == 60
    for name in ("events", "reports"):
        files = [str(f) for f in tmp_path.glob(f"{name}/**/*.parquet")]
        assert 0 < len(files) <= 2 * 4 and not any("text" in spark.read.parquet(f).columns for f in files)  # a file per epoch and partition at most
    assert sorted((r["id"], r["text"]) for r in store.events().collect()) == [(r[0], r[3]) for r in rows]
    assert sorted((r["event_id"], r["text"]) for r in store.reports().collect()) == [(r[0], r[3]) for r in rows]
    late = datetime(2024, 2, 20).date()  # the fiftieth day
    assert {r["id"] for r in store.events([late, datetime(2024, 1, 5).date()]).collect()} == {4, 50}


def test_words_are_read_of_texts_in_close_pairs_alone(spark, monkeypatch):
    at, near_ = datetime(2024, 1, 1), "officials reported damage along the northern bridge tonight"
    df = spark.createDataFrame([(i, "x", at + timedelta(minutes=i), None, None, t) for i, t in enumerate([near_, "seven other words stand here for nothing", near_ + " again", "what nobody else would ever think of"])], "id long, event_type string, ts timestamp, lat double, lon double, text string")
    kept, cut = [], linking.cut
    monkeypatch.setattr(linking, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    assert [(r["probe_id"], r["id"]) for r in linking.similar_pairs(df).collect()] == [(2, 0)]
    assert {r["id"] for x in kept if "words" in x.columns for r in x.collect()} == {0, 2}


def test_noise_trims_and_counts_as_patterns_do(spark):
    rng = random.Random(5)
    space = [" ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "᠎", " ", "​", " ", " ", "　", "﻿"]
    texts = ["".join(rng.choice(space) * rng.randrange(3) + "w" * rng.randrange(40) for _ in range(rng.randrange(40))) for _ in range(300)] + ["", " ", "wait " * 25, "wait " * 26, " wait" * 7 + " x" * 500, "w" * 500 + " w" * 24, "w" * 500 + " w" * 25]
    trimmed = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    t = F.col("t")
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", F.btrim("t", F.lit(V.WHITE)).alias("b"), trimmed(t).alias("s"), T._words_at_most(trimmed(t), 26).alias("n"), F.size(F.split(trimmed(t), r"(?U)\s+")).alias("all")).collect()
    assert all(r["b"] == r["s"] and r["n"] == min(r["all"], 26) for r in rows)


def test_all_noise_phrases_are_looked_for_at_once(spark):
    rng, long = random.Random(7), "A report of the district about the bridge, the harbour and the station"
    texts = [None, "", " \t ", "too short", long, long + " lol ", long + " lol but", "Wait, what was " + "said " * 6, "wait " + "said " * 30, "İ " + long, "lol, " + long]
    texts += [f"{long}{rng.choice([' ', '', chr(160)])}{p.upper() if rng.random() < 0.5 else p}{rng.choice(['', ' x'])}" for p in V.NOISE_PHRASES] + [f"{long} {p[:-1]}" for p in V.NOISE_PHRASES] + [f"{long} {p.replace('.', 'x').replace('+', 'p').replace('?', 's')}" for p in V.NOISE_PHRASES]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    plain = rows.filter(~T.is_noise(F.col("text"))).orderBy("id").collect()
    assert T.without_noise(rows).orderBy("id").collect() == plain and 40 < len(plain) < len(texts) - 60
    at = rows.withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    assert pipelines.gated(at)._jdf.queryExecution().executedPlan().toString().count("Contains(") == 0


def test_rows_among_ids_are_found_by_bits(spark, monkeypatch):
    rng = random.Random(11)
    ids = {rng.randrange(100_000) for _ in range(3_000)} | {0, 1, 7, 8, 32_767, 32_768, 32_769, 1 << 40}
    rows = spark.range(100_000).union(spark.createDataFrame([(1 << 40,), ((1 << 40) + 1,)], "id long")).withColumn("text", F.lit("t"))
    wanted = spark.createDataFrame([(i,) for i in ids], "id long")
    found = ingest.among(rows, wanted)
    assert found.columns == ["id", "text"] and sorted(r["id"] for r in found.collect()) == sorted(ids)
    assert ingest.among(rows, wanted.limit(0)).count() == 0
    monkeypatch.setattr(ingest, "BITS", 2)
    assert ingest.among(rows, wanted).count() == 100_002
