"""When a feed's payload last changed, over batches and over a table."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewatch.operators import feed
from tidewatch.streaming import pipelines

FIELDS = "feed string, ts timestamp, id long, payload string"
START = datetime(2024, 1, 1)


def poll(name, second, payload, i=None):
    return name, None if second is None else START + timedelta(seconds=second), second if i is None else i, payload


STEPS = [
    [poll("ais", 0, "a"), poll("ais", 10, "a"), poll("once", 0, "x"), poll("down", 5, None), poll(None, 5, "q"), poll("ais", None, "q", 1)],
    [poll("ais", 20, None), poll("ais", 30, "a")],  # a failed poll and the same payload: no arrival
    [poll("ais", 50, "c"), poll("ais", 40, "b"), poll("ais", 60, "c"), poll("once", 60, "x")],  # unordered within a batch
    [poll("ais", 45, "late"), poll("ais", 60, "c")],  # older than what was counted, and a poll once more
    [poll("ais", 70, ""), poll("ais", 80, "")],  # an empty payload is a payload
]


def test_a_stamp_moves_only_with_the_payload(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream, seen = spark.readStream.schema(FIELDS).parquet(f"{tmp_path}/in"), []
    for rows in STEPS:
        spark.createDataFrame(rows, FIELDS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = {}
        pipelines.run_available(pipelines.arrivals(stream), "", f"{tmp_path}/checkpoint", lambda b, e, got=got: got.update({r["feed"]: r for r in b.collect()}), "update")
        seen.append(got)
    at = lambda r: None if r["arrived_at"] is None else (r["arrived_at"] - START).total_seconds()
    assert [at(s["ais"]) for s in seen] == [None, None, 50, 50, 70]
    assert [(s["ais"]["polls"], s["ais"]["failed"], s["ais"]["late"], s["ais"]["arrivals"]) for s in seen] == [(2, 0, 0, 0), (4, 1, 0, 0), (7, 1, 0, 2), (9, 1, 2, 2), (11, 1, 2, 3)]
    assert at(seen[2]["once"]) is None and seen[2]["once"]["polls"] == 2
    assert seen[0]["down"]["failed"] == 1 and seen[0]["down"]["last_ts"] is None and None not in seen[0]


def test_the_same_over_a_table(spark):
    rows = [p for i, step in enumerate(STEPS) if i != 3 for p in step]
    df = feed.ages(feed.arrivals(spark.createDataFrame(rows * 2, FIELDS).distinct()), F.lit(START + timedelta(seconds=131)).cast("timestamp"))
    got = {r["feed"]: r for r in df.collect()}
    assert set(got) == {"ais", "once", "down"}
    assert (got["ais"]["polls"], got["ais"]["failed"], got["ais"]["age_s"], got["ais"]["stale"]) == (9, 1, 61.0, True)
    assert got["once"]["age_s"] is None and got["once"]["stale"] is None  # nothing arrived: neither fresh nor stale
    assert (got["down"]["failed"], got["down"]["last_ts"]) == (1, None)
    assert feed.arrivals(spark.createDataFrame([], FIELDS)).count() == 0
