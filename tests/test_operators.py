"""Linking, folding, guards, outages, places and readers against plain models and fixed vectors."""

import random
import statistics
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.functions import text as T
from tidewatch.functions import values as V
from tidewatch.operators import guards, integrity, linking, outage, places, tracks
from tidewatch.sources import feeds

T0 = datetime(2026, 9, 20, 12)
A, B = (32.0853, 34.7818), (33.6, 36.3)


def messages(spark, rows):
    return spark.createDataFrame([(i, k, t, p and p[0], p and p[1], x) for i, k, t, p, x in rows], "id long, event_type string, ts timestamp, lat double, lon double, text string")


def linked(spark, stored, incoming):
    rows = messages(spark, [(1, *stored), (2, *incoming)])
    return linking.similar_pairs(rows).count() == 1


def test_candidate_rule(spark):
    s = "Natanz enrichment facility struck overnight"
    m = timedelta(minutes=1)
    base = ("military", T0, A, s)
    near, far = (A[0] + 0.05, A[1] + 0.05), B
    assert not linked(spark, ("military", T0, None, s), base)
    assert not linked(spark, base, ("military", T0, None, s))
    assert linked(spark, base, ("military", T0, near, s))
    assert not linked(spark, base, ("military", T0, far, s))
    assert linked(spark, ("military", T0, None, s), ("military", T0, None, s))
    assert not linked(spark, base, ("diplomatic", T0, A, s))
    assert linked(spark, base, ("military", T0 + 14 * m, A, s))
    assert not linked(spark, base, ("military", T0 + 16 * m, A, s))
    assert not linked(spark, ("military", T0, None, "aaa bbb ccc"), ("military", T0, None, "bbb ccc ddd eee"))
    assert linked(spark, ("military", T0, (10.0, 179.9), s), ("military", T0, (10.0, -179.9), s))
    assert linked(spark, ("military", T0, (59.99, 20.0), s), ("military", T0, (60.01, 20.3), s))


def test_no_nested_loop_in_the_link_join(spark):
    rows = messages(spark, [(1, "military", T0, A, "x")])
    plan = linking.near(rows, rows)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_leaders_against_a_plain_scan(spark):
    rng = random.Random(5)
    words = ["alpha", "bravo", "delta", "gamma", "kappa", "omega"]
    rows = [(i, "t", T0 + timedelta(minutes=rng.randrange(60)), None, " ".join(rng.sample(words, 3))) for i in range(60)]
    got = {r["id"]: r["leader"] for r in linking.leaders(messages(spark, rows)).collect()}
    lead, want = [], {}
    for i, _, t, _, x in rows:
        best = None
        for j, u, y in lead:
            a, b = set(x.split()), set(y.split())
            if abs((t - u).total_seconds()) <= 900 and 5 * len(a & b) > 2 * len(a | b) and (best is None or (u, j) > best):
                best = (u, j)
        want[i] = best[1] if best else i
        if not best:
            lead.append((i, t, x))
    assert got == want


def test_fold(spark):
    cases = {  # (reliability, channels in order): result
        1: ([4, 1, 1], ["same", "same", "same"], 4), 2: ([4, 1, 1], ["a", "b", "c"], 5), 3: ([5, 1, 1], ["a", "b", "c"], 5), 4: ([4, 1, 1], ["", "", "c"], 4), 5: ([2, 1, 1, 1, 1], ["a", "b", "c", "c", ""], 5),
        6: ([None, 3, None, 2], ["a", "b", "b", "c"], 4),
    }
    rows = [(k, i, c, r, None, "ok") for k, (rel, ch, _) in cases.items() for i, (r, c) in enumerate(zip(rel, ch))]
    df = spark.createDataFrame(rows, "event_id int, seq int, channel string, reliability int, severity int, status string")
    got = {r["event_id"]: r["reliability"] for r in linking.fold(df).collect()}
    assert got == {k: want for k, (_, _, want) in cases.items()}


def test_channel_list_keeps_the_substring_rule(spark):
    df = spark.createDataFrame([(1, 0, "abc"), (1, 1, "b"), (1, 2, "x")], "event_id int, seq int, channel string")
    assert linking.channel_list(df).first()["channels"] == "abc, x"
    assert linking.channel_list(df, compat=False).first()["channels"] == "abc, b, x"


def test_sentinel_and_guards(spark):
    df = spark.createDataFrame([(1, -25.0, 80.0, True), (2, 1.0, 2.0, None)], "id int, lat double, lon double, is_geolocated boolean")
    once = guards.retire_sentinel(df)
    assert [tuple(r) for r in once.orderBy("id").collect()] == [(1, None, None, False), (2, 1.0, 2.0, None)]
    assert guards.retire_sentinel(once).exceptAll(once).count() == 0
    m = spark.createDataFrame([("a", 4821), ("b", 4821)], "channel string, message_id int")
    assert [r["channel"] for r in guards.unseen(m, m.filter("channel = 'a'"), "channel", "message_id").collect()] == ["b"]


def test_integrity_zone(spark):
    def fleet(n, bad, alt=25000.0):
        return [(10.0, 10.0, alt, False, 5 if i < bad else 8, 9) for i in range(n)]

    schema = "lat double, lon double, altitude double, on_ground boolean, nic int, nac_p int"
    assert integrity.zones(spark.createDataFrame(fleet(10, 3), schema)).first()["ratio"] == 0.3
    assert integrity.status(spark.createDataFrame(fleet(9, 3), schema)).first()["status"] == "insufficient_coverage"
    assert integrity.status(spark.createDataFrame(fleet(10, 3, 19900.0), schema)).first()["status"] == "no_integrity_data"


def test_compact_track(spark):
    rows = [("e", T0 + timedelta(seconds=i), i, x, x) for i, x in enumerate([1.0, 1.0, 2.0, 2.0, 1.0])]
    got = tracks.compact(spark.createDataFrame(rows, "entity string, ts timestamp, id int, lat double, lon double")).orderBy("id").collect()
    assert [r["lat"] for r in got] == [1.0, 2.0, 1.0]


def plain_compare(live, end, floor):
    cur = [v for t, v in live if end - V.CURRENT_S < t <= end]
    base = [v for t, v in live if abs(t - (end - V.DAY_S)) <= V.SEASONAL_S]
    if len(cur) < 2 or len(base) < 4:
        return "insufficient_points", None
    b = statistics.median(base)
    return ("low_baseline", None) if b < floor else (None, (statistics.median(cur) - b) / b)


def test_comparisons_against_a_plain_model(spark):
    rng = random.Random(3)
    rows = [("c", "s", 600 * i, 100 + 20 * rng.random()) for i in range(300) if rng.random() < 0.8]
    got = {r["probe"]: (r["reason"], r["deviation"]) for r in outage.comparisons(spark.createDataFrame(rows, "code string, datasource string, t long, v double")).collect()}
    live = [(t, v) for _, _, t, v in rows]
    last = live[-1][0]
    for probe in range(23):
        reason, dev = plain_compare(live, last - 3600 * probe, 1.0)
        r, d = got.get(probe, ("insufficient_points", None))
        assert r == reason and (dev is None or abs(d - dev) < 1e-12)


def test_flat_series_and_staleness(spark):
    def score(drop, until=None):
        rows = [("c", "bgp", 300 * i, 1000.0 * (1 - (drop if 300 * i > 172_800 - 5400 else 0))) for i in range(577)]
        s = spark.createDataFrame([("c", "bgp", 300, True)], "code string, datasource string, step int, fetched boolean")
        return outage.short_score(s, spark.createDataFrame(rows, "code string, datasource string, t long, v double"), F.lit(until or 172_800)).first()

    hit = score(0.03)
    assert hit["available"] and hit["depressed"] and hit["robust_z"] is None
    assert score(0.01)["depressed"] is False
    assert score(0.0, 172_800 + 3601)["reason"] == "stale_series"


def test_state_machine(spark):
    def state(d, a, dl, al):
        one = lambda d, a: spark.createDataFrame([("c", i < a, i < d, -0.1) for i in range(4)], "code string, available boolean, depressed boolean, deviation double")
        return outage.states(one(d, a), one(dl, al)).first()

    assert state(2, 3, 0, 4)["state"] == "disruption_sudden"
    assert (state(2, 4, 0, 4)["state"], state(2, 4, 0, 4)["basis"]) == ("partial", "short")
    assert state(1, 3, 2, 3)["state"] == "disruption_sustained"
    assert state(0, 1, 0, 0)["state"] == "degraded"
    assert state(1, 3, 0, 3)["state"] == "nominal"


def test_places(spark):
    g = spark.createDataFrame(
        [("natanz", 0, "known", 33.7, 51.7, "facility", 100), ("arak", 1, "known", 34.0, 49.0, "city", 200), ("galilee", 2, "directional", 32.8, 35.6, "admin1", 300)],
        "key string, pos int, kind string, lat double, lon double, tier string, uncertainty_m int",
    )
    n = spark.createDataFrame([(1, "Maarakeh"), (2, "airstrike near Natanz overnight"), (3, " Galilee "), (4, "IDF"), (5, None), (6, "Arak")], "id int, name string")
    got = {r["id"]: (r["precision"], r["method"]) for r in places.resolve(n, g).collect()}
    assert got == {1: (None, None), 2: ("city", "partial"), 3: ("admin1", "directional-exact"), 4: (None, None), 5: (None, None), 6: ("city", "table-exact")}


def test_spelled_looks_at_every_text_and_key(spark):
    keys = spark.createDataFrame([("red old mill", 1), ("old mill", 22), ("İzmir desk", 3), ("a.b", 4), ("ſtone bridge", 5)], "key string, pos int")
    texts = spark.createDataFrame([(1, "The RED old Mill; red old mill"), (2, "oldmill, an Old mill²"), (7, "the izmir desk"), (None, "red old\nmill, a.b"), (5, None), (6, "axb cold mill"), (8, "Stone Bridge")], "id int, text string")
    got = {(r["id"], r["pos"], r["span"]) for r in places.spelled(texts, keys).collect()}
    want = {(r["id"], r["pos"], r["span"]) for r in texts.crossJoin(keys).select("id", "pos", T.evidence_span(F.col("text"), F.col("key")).alias("span")).filter("span <> ''").collect()}
    assert {(1, 1, "RED old Mill"), (1, 22, "old Mill"), (None, 4, "a.b")} <= got
    assert got == want


def test_readers(spark):
    rss = "<rss><channel><item><title>A &amp; B</title><link>http://x/1</link><pubDate>Tue, 01 Sep 2026 10:00:00 GMT</pubDate></item><item><title>no url</title></item></channel></rss>"
    atom = '<feed><entry><title>T</title><link href="http://x/2"/><updated>2026-09-01T10:00:00Z</updated></entry></feed>'
    got = feeds.articles(spark.createDataFrame([("r", rss), ("a", atom), ("b", "broken <")], "source string, xml string")).orderBy("url").collect()
    assert [(r["title"], r["url"], r["published_missing"]) for r in got] == [("A & B", "http://x/1", False), ("T", "http://x/2", False)]
    ac = '{"ac":[{"hex":"a","lat":1.0,"lon":2.0,"alt_geom":0,"alt_baro":"31000","track":0,"true_heading":90,"nic":8},{"hex":"b"}]}'
    a = feeds.aircraft_objects(spark.createDataFrame([(ac,)], "json string")).collect()
    assert [(r["icao24"], r["altitude"], r["heading"]) for r in a] == [("a", 31000.0, 90.0)]
    tle = "NAME\n1 25544U\n2 25544\nBAD\nx\ny\n"
    assert [r["name"] for r in feeds.orbital_elements(spark.createDataFrame([(1, tle)], "document int, text string")).collect()] == ["NAME"]
