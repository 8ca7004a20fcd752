"""Annotations of a second source: stale polls, bounded lists, others, and payloads that do not read."""

import json

from pyspark.sql import functions as F

from tidewatch.operators import corroboration as C
from tidewatch.sources import feeds

ANN = "poll string, id string, locations array<string>, start string, ongoing boolean"


def test_a_failed_call_shows_the_last_good_one_as_stale(spark):
    polls = spark.createDataFrame([("1", False), ("2", True), ("3", False), ("4", True)], "poll string, good boolean")
    rows = [("2", "a", ["x", "x", "y"], "s1", True), ("2", "b", ["x"], None, False), ("2", "c", ["x"], "s3", False), ("2", "d", None, "s4", True)]
    got = {(r["poll"], r["code"]): tuple(r)[2:] for r in C.corroborated(polls, spark.createDataFrame(rows, ANN), ["x", "z"], listed=2).collect()}
    assert got["1", "x"] == (False, False, None, None, None, [])
    assert got["2", "x"] == (True, False, "2", True, 3, ["a", "c"])
    assert got["3", "x"] == (True, True, "2", True, 3, ["a", "c"])
    assert got["3", "z"] == (True, True, "2", False, 0, [])
    assert got["4", "x"] == (True, False, "4", False, 0, [])
    assert len(got) == 8


def test_others_are_those_that_name_places_and_none_watched(spark):
    rows = [("1", "a", ["x"], "s1", True), ("1", "b", ["q", "x"], "s1", True), ("1", "c", [], "s1", True), ("1", "d", None, "s1", True), ("1", "e", ["q"], None, False), ("1", "f", ["q"], "s2", False), ("1", "g", ["q"], "s1", True), ("1", "h", ["q", None], "s0", False), ("2", None, ["q"], None, False)]
    got = C.discovered(spark.createDataFrame(rows, ANN), ["x"], limit=3).orderBy("poll", "place").collect()
    assert [(r["poll"], r["id"]) for r in got] == [("1", "g"), ("1", "f"), ("1", "h"), ("2", None)]


def test_payloads(spark):
    good = {"annotations": [{"id": "a", "locations": ["x"], "startDate": "s", "endDate": None, "outage": {"outageCause": "CABLE"}, "asns": [1]}, {"id": "b", "endDate": "e"}]}
    df = spark.createDataFrame([("1", json.dumps(good)), ("2", None), ("3", "{not json"), ("4", "{}")], "poll string, json string")
    got = feeds.annotations(df, "poll").select("poll", "id", "ongoing", "cause").collect()
    assert [tuple(r) for r in got] == [("1", "a", True, "CABLE"), ("1", "b", False, None)]
    top = {"meta": {"units": "%"}, "top_0": [{"targetCountryAlpha2": "X", "value": "1.5", "rank": 1}, {"targetCountryAlpha2": "Y", "rank": 2}, {"targetCountryAlpha2": "Z", "value": "much"}]}
    got = feeds.attack_targets(spark.createDataFrame([(json.dumps(top),), (None,), ("[]",)], "json string")).select("code", "share", "rank", "units")
    assert [tuple(r) for r in got.collect()] == [("X", 1.5, 1, "%"), ("Y", None, 2, "%"), ("Z", None, None, "%")]
