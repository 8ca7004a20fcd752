"""Movers in closed form against steps one by one, and feeds whose payloads arrive."""

import math
import random

from tidewatch.sources import synthetic


def walked(lat, lon, step, targets, near, ticks):
    leg, out = 0, [(0, 0, lat, lon, False)]
    for t in range(1, ticks + 1):
        to, took = targets[leg], False
        d = math.hypot(to[0] - lat, to[1] - lon)
        if d < near:
            took = leg + 1 < len(targets)
            leg += took
        else:
            f = min(1.0, step / d)
            lat, lon = lat + (to[0] - lat) * f, lon + (to[1] - lon) * f
        out.append((t, leg, lat, lon, took))
    return out


def test_movers_match_steps_one_by_one(spark):
    rng = random.Random(5)
    point = lambda: (rng.uniform(20, 24), rng.uniform(40, 44))
    rows = [(i, *point(), rng.uniform(0.02, 0.9), [point() for _ in range(rng.randint(1, 6))]) for i in range(30)]
    rows += [(100, 20.0, 40.0, 0.5, [(20.0, 40.0)]), (101, 20.0, 40.0, 5.0, [(21.0, 40.0), (21.0, 40.0), (20.0, 40.0)])]  # already there; a step longer than the way
    odd = [(200, 20.0, 40.0, None, [(21.0, 40.0)]), (201, None, 40.0, 0.5, [(21.0, 40.0)]), (202, 20.0, 40.0, 0.0, [(21.0, 40.0)]), (203, 20.0, 40.0, 0.5, [])]
    schema = "entity long, lat double, lon double, step double, targets array<struct<lat:double,lon:double>>"
    got = {}
    for r in synthetic.positions(spark.createDataFrame(rows + odd, schema), 0.3, 90).collect():
        got.setdefault(r["entity"], []).append((r["tick"], r["leg"], r["lat"], r["lon"], r["arrived"]))
    assert set(got) == {r[0] for r in rows}
    for entity, lat, lon, step, targets in rows:
        want = walked(lat, lon, step, targets, 0.3, 90)
        have = sorted(got[entity])
        assert [(t, leg, took) for t, leg, _, _, took in have] == [(t, leg, took) for t, leg, _, _, took in want]
        assert all(abs(a[2] - b[2]) < 1e-9 and abs(a[3] - b[3]) < 1e-9 for a, b in zip(have, want, strict=True))


def test_there_and_back(spark):
    from pyspark.sql import functions as F

    def naive(n, at, step, count):
        out = []
        for _ in range(count):
            if not 0 <= at + step < n:
                step = -step
            at += step
            out.append(at)
        return out

    rows = [(list(range(n)), at, onward) for n in (2, 3, 5) for at in range(n - 1) for onward in (True, False)]
    df = spark.createDataFrame(rows, "route array<int>, at int, onward boolean")
    for r in df.select("*", synthetic.there_and_back(F.col("route"), F.col("at"), F.col("onward"), 9).alias("p")).collect():
        assert r["p"] == naive(len(r["route"]), r["at"], 1 if r["onward"] else -1, 9)
    assert spark.sql("select array(7) as route").select(synthetic.there_and_back(F.col("route"), F.lit(0), F.lit(True), 3).alias("p")).first()["p"] == [7, 7, 7]
