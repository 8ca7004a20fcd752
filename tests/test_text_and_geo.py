"""Vectors of the text and position functions."""

from pyspark.sql import functions as F

from tidewatch.functions import geo as G
from tidewatch.functions import text as T


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def test_word_sets_and_similarity(spark):
    assert set(one(spark, T.word_set(F.col("t")), t="Israeli F-35s hit Natanz!")) == {"israeli", "f35s", "hit", "natanz"}
    assert [w for w in one(spark, T.word_set(F.col("t")), t="a an of to") if w] == []
    ab = dict(a="aaa bbb ccc", b="bbb ccc ddd eee")
    assert one(spark, T.similar(T.word_set(F.col("a")), T.word_set(F.col("b"))), **ab) is False  # exactly 0.4
    assert one(spark, T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b"))), **ab) == 0.4
    assert one(spark, T.jaccard(T.word_set(F.col("a")), T.word_set(F.col("b"))), a="", b="natanz") == 0.0


def test_noise(spark):
    real = "Explosions were reported near the northern port overnight according to two local officials"
    assert one(spark, T.is_noise(F.col("t"), F.lit(None).cast("int")), t=real) is False
    assert one(spark, T.is_noise(F.col("t"), F.lit(2)), t=real) is True
    assert one(spark, T.is_noise(F.col("t"), F.lit(3)), t=real) is False
    assert one(spark, T.is_noise(F.col("t")), t="lol") is True
    assert one(spark, T.is_noise(F.col("t")), t="Wait I thought the war was over already, what happened?") is True


def test_evidence_span(spark):
    rows = [
        ("An Israeli airstrike on Zrariyeh killed 17 people.", "Zrariyeh", "Zrariyeh"),
        ("Rockets fell across SOUTHERN LEBANON overnight", "southern Lebanon", "SOUTHERN LEBANON"),
        ("İzmir desk: strike on Zrariyeh overnight", "Zrariyeh", "Zrariyeh"),
        ("Shelling near Kiryat Shemona", "Kirya", ""),
        ("UPDATE: Over 200 Israelis injured in last 24 hours", "Israel", ""),
        ("Casualty figures remain unknown after the blast.", "Unknown", ""),
        ("anything", "", ""),
    ]
    got = spark.createDataFrame(rows, "raw string, loc string, want string").select(T.evidence_span(F.col("raw"), F.col("loc")).alias("got"), "want", "raw").collect()
    for r in got:
        assert r["got"] == r["want"] and r["got"] in r["raw"]


def test_reply_validation(spark):
    rows = [
        ('{"severity": true}', "parse_failed", None), ('{"severity": 5, "killed_reported": false}', "parse_failed", None), ('{"severity": 5, "killed_reported": "17"}', "ok", 17),
        ('{"severity": 5, "killed_reported": 0}', "ok", 0), ('{"severity": 5, "killed_reported": null}', "ok", None), ('{"severity": 11}', "parse_failed", None), ('{"severity": 0}', "parse_failed", None),
        ('{"severity": 5, "killed_reported": -1}', "parse_failed", None), ("{}", "parse_failed", None), ('[{"severity": 5}]', "parse_failed", None), ("nonsense", "parse_failed", None), ('```json\n{"severity": 4}\n```', "ok", None),
    ]
    got = spark.createDataFrame(rows, "r string, status string, killed int").select("r", "status", "killed", T.reply_fields(F.col("r")).alias("x")).collect()
    for r in got:
        assert r["x"]["status"] == r["status"], r
        assert r["x"]["killed_reported"] == r["killed"], r


def test_boxes_and_tiers(spark):
    box = G.box_precision(F.col("s"), F.col("n"), F.col("w"), F.col("e"))
    assert one(spark, box, s=32.0, n=32.1, w=34.7, e=34.8)["precision"] == "city"
    null = F.lit(None).cast("double")
    assert one(spark, G.box_precision(null, null, null, null), s=1.0).asDict() == {"precision": "country_centroid", "uncertainty_m": None}
    assert one(spark, G.coarser(F.lit("facility")), s=1.0) == "city"
    assert one(spark, G.coarser(F.lit("region_named")), s=1.0) == "region_named"
    assert one(spark, G.grid(F.col("x")), x=2.0) == 2  # 2.5 cells: halves to even
    assert one(spark, G.is_located(F.lit(1.0), F.lit(2.0), F.lit(None).cast("boolean")), s=1.0) is True


def test_feed_time(spark):
    assert str(one(spark, T.feed_time(F.col("t")), t="Tue, 01 Sep 2026 10:00:00 GMT")) == "2026-09-01 10:00:00"
    assert str(one(spark, T.feed_time(F.col("t")), t="2026-09-01T10:00:00Z")) == "2026-09-01 10:00:00"
    assert one(spark, T.feed_time(F.col("t")), t="yesterday") is None


def test_stated_tolls(spark):
    rows = [
        ("12 Palestinians were killed", "count_then_kill", 12), ("at least 60 dead", "count_then_kill", 60), ("Killing at least 1,200", "kill_then_count", 1200), ("Fire kills one in the north", "kill_then_count", 1),
        ("killed 3 days ago", "none", None), ("killed 7 October", "none", None), ("Death toll rises to 40", "death_toll_phrase", 40), ("A young paramedic was killed", "singular", 1),
        ("No one was killed", "zero", 0), ("No casualties in the raid", "zero", 0), ("No casualties have been announced yet", "zero_unpublished", None), ("No one was reported killed", "zero_unpublished", None),
        ("Over 200 injured", "wounded", None), ("Dozens killed", "none", None), ("\u0627\u0633\u062a\u0634\u0647\u0627\u062f 12", "arabic", None), ("quiet day", "none", None), (None, None, None), ("", None, None), ("seventeen reported dead", "count_then_kill", 17),
    ]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "id int, text string")
    got = {r["id"]: (r["b"], r["n"]) for r in df.select("id", T.toll_bucket(F.col("text")).alias("b"), T.toll_count(F.col("text")).alias("n")).collect()}
    assert {rows[i][0]: got[i] for i in got} == {t: (b, n) for t, b, n in rows}
