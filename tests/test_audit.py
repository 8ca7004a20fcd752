"""The sentinel audit, geometry and per-bucket samples against plain models."""

import hashlib
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.display import ewkb_point
from tidewatch.operators import archive, audit
from tidewatch.plans import audit_queries as Q

SCHEMA = "id long, lat double, lon double, geometry string, location_name string, severity int, source string, event_type string, report_count int"


def hexed(lon, lat, kind=0x20000001, srid=4326):
    return struct.pack("<BIIdd", 1, kind, srid, lon, lat).hex()


def test_geometry_equals_the_packed_doubles(spark):
    rng = random.Random(5)
    values = [0.0, -0.0, 80.0, -25.0, 5e-324, -2.2250738585072009e-308, 2.2250738585072014e-308, 1.7976931348623157e308, float("inf"), float("-inf")]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)] + [rng.uniform(-180, 180) for _ in range(2000)]
    values = [v for v in values if v == v]
    rows = [(i, hexed(v, -v) if i % 2 else hexed(v, -v).upper()) for i, v in enumerate(values)]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i int, g string").select("i", ewkb_point(F.col("g")).alias("p")).collect()}
    for i, v in enumerate(values):
        assert (got[i]["status"], struct.pack("<d", got[i]["lon"]), struct.pack("<d", got[i]["lat"])) == ("point", struct.pack("<d", v), struct.pack("<d", -v))


def test_what_is_no_such_point_is_undecodable(spark):
    bad = ["", "00", "zz" * 25, hexed(1, 2)[:-2], hexed(1, 2) + "00", hexed(1, 2, srid=3857), hexed(1, 2, kind=1), "00" + hexed(1, 2)[2:]]
    got = [r["p"] for r in spark.createDataFrame([(x,) for x in [*bad, None]], "g string").select(ewkb_point(F.col("g")).alias("p")).collect()]
    assert [tuple(p) for p in got] == [("undecodable", None, None)] * len(bad) + [("null", None, None)]


def sample_of(pairs, k, seed=0):
    by = defaultdict(list)
    for key, bucket in pairs:
        by[bucket].append((hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key))
    return sorted(((b, i, key) for b, rows in by.items() for i, (_, key) in enumerate(sorted(rows)[:k], 1)), key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_bottom_k_holds_each_bucket_whatever_the_partitions(spark, parts):
    """One bucket holds a third of all rows, one is null, one is smaller than the sample."""
    pairs = [(i, "hot" if i % 3 == 0 else None if i % 50 == 1 else "rare" if i in (2, 5) else f"b{i % 4}") for i in range(6000)]
    rows = spark.createDataFrame(pairs, "key long, bucket string").repartition(parts)
    got = archive.bottom_k(rows, "bucket", "key", 11, seed=3)
    assert sorted(((r["bucket"], r["place"], r["key"]) for r in got.collect()), key=str) == sample_of(pairs, 11, 3)
    assert got.columns == ["key", "bucket", "place"]
    assert archive.bottom_k(rows.limit(0), "bucket", "key", 11).count() == 0


def test_bottom_k_limits_ranks_before_the_shuffle(spark):
    rows = spark.range(1000).selectExpr("id as key", "id % 3 as bucket")
    plan = archive.bottom_k(rows, "bucket", "key", 5)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.rindex("Exchange hashpartitioning") :]
    assert "WindowGroupLimit" in below and "Partial" in below


def test_toll_samples_are_those_of_all_documents(spark, data):
    from tidewatch.functions import text as T
    from tidewatch.plans import substrate as S

    pairs = [tuple(r) for r in S.messages(spark, data).select("id", T.toll_bucket(F.col("text"))).collect()]
    assert sorted(((r["bucket"], r["place"], r["id"]) for r in Q.toll_samples(spark, data).collect()), key=str) == sample_of(pairs, 20)


def rows_of(n=900):
    rng = random.Random(11)
    place = [(-25.0, 80.0), (-25.0, 80.0), (None, None), (-25.0, None), (-25.005, 80.0), (31.5, 34.5), (-25.0, 81.0), (-20.0, 80.0), (-25.0000005, 80.0)]
    shape = [None, "", hexed(80, -25), hexed(34.5, 31.5), hexed(80, -25, kind=0xA0000001), "junk"]
    names = ["Unknown", None, " N/A ", "", *[f"p{i}" for i in range(8)]]
    return [(i, *rng.choice(place), rng.choice(shape), rng.choice(names), rng.choice([None, 3, 5]), rng.choice([None, "a", "b"]), rng.choice(["x", "y"]), rng.choice([None, 0, 1, 2])) for i in range(n)]


def test_counters_and_profile_equal_a_scan(spark):
    want, profile, bands = Counter(), Counter(), (0.000001, 0.0001, 0.01, 0.1, 1.0, 5.0)
    for _, lat, lon, g, name, severity, source, kind, count in rows_of():
        exact, both = (lat, lon) == (-25.0, 80.0), lat is not None and lon is not None
        status = "null" if not g else "point" if g in (hexed(80, -25), hexed(34.5, 31.5)) else "undecodable"
        there = g == hexed(80, -25)
        want.update({"rows": 1, "lat_null": lat is None, "lon_null": lon is None, "located": both, f"geom_{'decoded' if status == 'point' else status}": 1, "geom_sentinel": there, "geom_sentinel_not_selected": there and not exact})
        want.update({"severity_5": severity == 5, "unknown": name == "Unknown", "rejected": name is not None and name.strip().lower() in audit.REJECTED})
        if exact:
            want.update({"exact": 1, "exact_geom_agrees" if there else "exact_geom_elsewhere" if status == "point" else f"exact_geom_{status}": 1, "exact_unknown_5": severity == 5 and name == "Unknown", "exact_merged": (count or 0) > 1})
            profile.update([("location_name", name), ("severity", severity and str(severity)), ("source", source), ("event_type", kind)])
        elif both:
            want.update({"half_lat": lat == -25.0, "half_lon": lon == 80.0})
            off = max(abs(lat + 25), abs(lon - 80))
            want.update([f"band_{i}" for i, b in enumerate(bands, 1) if off <= b][:1])
    rows = spark.createDataFrame(rows_of(), SCHEMA)
    assert {k: v for k, v in audit.counters(rows).first().asDict().items() if v} == {k: int(v) for k, v in want.items() if v}
    assert {(r["dimension"], r["value"]): r["n"] for r in audit.profile(rows).collect()} == dict(profile)
    assert set(audit.counters(rows.limit(0)).first()) == {0} and audit.profile(rows.limit(0)).count() == 0


def test_estimators_equal_a_scan(spark):
    """The most frequent position of a name is the one met first among equals, as in a scan in the order of ids."""
    by = defaultdict(Counter)
    for _, lat, lon, _, name, *_ in rows_of():
        by[name][lat, lon] += 1
    want = Counter(dict.fromkeys(("census", "proxy", "charged_not_on", "missed", "repairable_rows", "repairable_names"), 0))
    for name, at in by.items():
        (lat, lon), _ = at.most_common(1)[0]
        on, real = at[-25.0, 80.0], sum(n for (a, o), n in at.items() if a is not None and o is not None and (a, o) != (-25.0, 80.0))
        near = lat is not None and lon is not None and abs(lat + 25) < 0.01 and abs(lon - 80) < 0.01
        want.update({"census": on, "proxy": near * sum(at.values()), "charged_not_on": near * (sum(at.values()) - on), "missed": (not near) * on})
        if name != "Unknown" and on and real:
            want.update({"repairable_rows": on, "repairable_names": 1})
    rows = spark.createDataFrame(rows_of(), SCHEMA)
    assert audit.estimators(rows).first().asDict() == dict(want)
    assert set(audit.estimators(rows.limit(0)).first()) == {0}
