"""The import of attack waves: envelopes, what is skipped and why, repeats."""

import json

from tidewatch.sources import waves


def wave(n, at="2026-03-01T10:00:00Z", lat=1.0, **more):
    return {"wave_number": n, "timing": {"announced_utc": at}, "targets": {"target_coordinates": {"lat": lat, "lon": 2.0}}} | more


def test_envelopes(spark):
    w = wave(1)
    docs = [[w, w], {"waves": [w]}, {"waves": [], "data": [w]}, {"z": [w], "a": [{"wave_number": None}, w]}, {"a": [1], "b": [{"n": 1}], "c": [w]}, {"waves": []}, {"a": 1}, [], 7, None]
    rows = [(i, None if d is None else json.dumps(d)) for i, d in enumerate(docs)] + [(len(docs), "{broken")]
    got = waves.elements(spark.createDataFrame(rows, "document long, json string")).collect()
    assert sorted((r["document"], r["pos"]) for r in got) == [(0, 0), (0, 1), (1, 0), (2, 0), (3, 0), (4, 0)]
    assert all(json.loads(r["json"]) == w for r in got)


def test_what_is_skipped_and_why(spark):
    rows = [
        (1, [wave(1), wave(2), wave(2), wave(3, at=None), wave(4, at="soon"), wave(5, lat=None)]),
        (2, [wave(3), wave(1), wave(None), wave(0), wave(6, at=None, timing={"announced_utc": "", "probable_launch_time": "2026-03-01T11:00:00+00:00"})]),
    ]
    files = spark.createDataFrame([(i, json.dumps(x)) for i, x in rows], "document long, json string").repartition(2)
    stored = spark.createDataFrame([("u#1",), ("u#1",), (None,)], "source_url string")
    judged = waves.judged(files, stored, "u#")
    got = {(r["document"], r["pos"]): r["status"] for r in judged.collect()}
    assert [got[1, i] for i in range(6)] == ["existing", "imported", "existing", "no_time", "bad_time", "no_position"]
    assert [got[2, i] for i in range(5)] == ["imported", "existing", "imported", "existing", "imported"]
    assert sorted(r["source_url"] for r in waves.imported(judged).collect()) == ["u#0", "u#2", "u#3", "u#6"]
    again = waves.judged(files, waves.imported(judged).select("source_url"), "u#")
    assert {r["source_url"] for r in waves.imported(again).collect()} == {"u#1"}
