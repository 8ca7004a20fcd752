"""Documents without doc_id, a third of all: dealt out like others, none lost, in a defined order."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewatch.llm import mixing, syncmers, tokenfile

SCHEMA = "doc_id long, text string, source string"


@pytest.fixture(scope="module", params=["third", "two", "all", "one"])
def rows(request):
    rng = random.Random(7)
    text = lambda: " ".join(rng.choices([f"w{i}" for i in range(300)], k=40))
    return {
        "third": [(None if i % 3 == 0 else i, text(), "s") for i in range(900)],
        "two": [(None, text(), "s"), (None, text(), "s"), *((i, text(), "s") for i in range(20))],
        "all": [(None, text(), "s") for _ in range(300)] + [(None, None, None), (None, "", "s")],
        "one": [(None, text(), "s")],
    }[request.param]


def parts(df, ranges, n):
    some = df.select(F.col("doc_id").isNull().alias("w"), tokenfile.Ranges.key().alias("k")).toPandas()
    return np.bincount(ranges.part(some["w"].to_numpy(bool), some["k"].to_numpy(np.int64)), minlength=n)


def test_no_range_holds_much_more_than_the_others(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    ranges = tokenfile.Ranges(df, 12)
    sizes = parts(df, ranges, ranges.n)
    assert sizes.sum() == len(rows) and len(sizes) == ranges.n
    if len(rows) > 100:
        assert sizes.max() <= 2 * np.median(sizes)


def test_token_files(spark, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = tokenfile.read(tokenfile.write(spark.createDataFrame(rows, SCHEMA), path)).toPandas().sort_values("start")
    assert len(got) == len(rows) and list(got["start"]) == [0, *np.cumsum(got["n_tokens"])[:-1]]
    ids = [None if x != x else int(x) for x in got["doc_id"]]
    none = sum(r[0] is None for r in rows)
    assert ids == [None] * none + sorted(r[0] for r in rows if r[0] is not None)
    encode = tokenfile.encoder(path, False, True).encode
    want = sorted(np.append(x, 2).astype("<u4").tobytes() for x in encode([r[1] or "" for r in rows]))
    assert sorted(bytes(x) for x in got["ids"]) == want


def test_fingerprints_follow_the_order(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    order = [r["text"] or "" for r in df.select("text", F.col("doc_id").isNull().alias("w"), tokenfile.Ranges.key().alias("k")).orderBy("w", F.desc("k"), F.coalesce("text", F.lit(""))).collect()]
    want = []
    for i, t in enumerate(order):
        half = len(t) // 2
        want.append(hashlib.sha256((t[: len(t) - half] + order[(i + 1) % len(order)][:half]).encode()).hexdigest())
    assert sorted(r["edited_sha256"] for r in syncmers.fingerprints(df).collect()) == sorted(want)


def test_mix(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    a, b = (sorted(map(tuple, mixing.mix(df.repartition(k)).collect()), key=str) for k in (3, 7))
    assert a == b and len(a) == len(rows)
    total, target = sum(r[5] for r in a), sum({r[2]: r[3] for r in a}.values())
    assert abs(total - target) <= 0.02 * target + max(r[1] for r in a)
    assert sorted(map(tuple, mixing.mixed(df.repartition(3)).collect()), key=str) == sorted(map(tuple, mixing.mixed(df.repartition(7)).collect()), key=str)
