"""Whitening, centroid clustering and repeated passages against naive versions and edge cases."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatch.llm import centroids, queries, substrings, whitening
from tidewatch.session import cut, spent

VECTORS = "vec_id long, embedding array<float>, label int, deviation string, cluster string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y") for i, v in rows], VECTORS)


def some_vectors(n, d=64, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, d)) * np.linspace(0.05, 0.5, d)).astype(np.float32)
    return [(i, r.tolist()) for i, r in enumerate(x)]


ODD = [(9000, None), (9001, []), (9002, [0.1] * 63), (9003, [None] + [0.1] * 63), (9004, [float("nan")] + [0.1] * 63), (9005, [float("-inf")] + [0.1] * 63)]


def test_whitening_against_numpy(spark):
    rows = some_vectors(400)
    rows += [rows[3], (None, rows[5][1]), (7, rows[7][1]), *((i, rows[0][1]) for i in range(500, 700))]
    got = whitening.components(vectors(spark, rows + ODD)).collect()
    x = np.floor(64 * np.array([v for _, v in rows], np.float32).astype(float)).astype(np.int64) + 1_000_000
    n = len(x)
    c = x - x.mean(axis=0)
    v = c.T @ c / n
    values, directions = np.linalg.eigh(v)
    values, directions = values[::-1][:32], directions[:, ::-1][:, :32]
    want = c @ directions / np.sqrt(values)
    s = x.sum(axis=0)
    dev = [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True)) for r in x]
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    assert Counter((r["vec_id"], r["deviation"]) for r in got) == Counter({k: 32 * m for k, m in Counter(zip((i for i, _ in rows), dev, strict=True)).items()})
    first = {i: j for j, (i, _) in reversed(list(enumerate(rows)))}
    for comp in range(32):
        a = np.array([r["whitened"] for r in got if r["component"] == comp + 1])
        b = np.array([want[first[r["vec_id"]], comp] for r in got if r["component"] == comp + 1])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
    assert all(math.isclose(r["explained"], values[r["component"] - 1] / np.trace(v), rel_tol=1e-9) for r in got)
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9


@pytest.mark.parametrize(
    ("rows", "n", "usable"),
    [([], 0, 0), (ODD[:2], 0, 0), ([(1, [0.5, 2.0])], 1, 0), ([(1, [0.5, 2.0]), (1, [0.5, 2.0])], 2, 0), ([(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0]), (3, [5.0])], 2, 1)],
)
def test_whitening_without_variance(spark, rows, n, usable):
    got = whitening.components(vectors(spark, rows)).collect()
    d = max([len(v or []) for _, v in rows], default=0)
    assert len(got) == n * d and sum(r["whitened"] is not None for r in got) == n * usable
    if n and not usable:
        assert all(r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    if usable:
        assert {r["vec_id"] for r in got} == {1, 2} and got[0]["identity_error"] < 1e-12


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(1, [1e30, 1.0]), (2, [-3.0e12, 2.0]), (3, [2.0e9, 2.0])]
    got = {r["vec_id"]: r["deviation"] for r in whitening.components(vectors(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: None}
    x = np.array([[2**40, 3], [5, 7]])
    dev = whitening.deviations(x, 10**9, [2**40 + 5, 10])
    assert dev.tolist() == [[2**40 * 10**9 - 2**40 - 5, 3 * 10**9 - 10], [5 * 10**9 - 2**40 - 5, 7 * 10**9 - 10]]
    assert whitening.squares(np.array([[3, 4], [2**31, 2**31], [2**32, 0]], dtype=object)) == [25, None, None]


def test_whiten_keeps_other_columns(spark):
    df = vectors(spark, some_vectors(50, 5) + ODD)
    w = whitening.fit(whitening.vectors_of(df))
    out = whitening.whiten(df, w)
    assert out.columns == ["vec_id", "embedding", "label", "cluster", "deviation", "whitened"]
    y = np.array([r["whitened"] for r in out.collect()])
    assert y.shape == (50, 5) and np.allclose(np.cov(y.T, bias=True), np.eye(5), atol=1e-9)


def lloyd(rows, k=8, rounds=10, seed=3):
    kept = [(i, [math.floor(1024 * x) for x in np.array(v, np.float32).astype(float).tolist()]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "z"
    c = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), [(x % 2**64).to_bytes(8, "little") for x in r[1]]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((d2(v, p), j) for j, p in enumerate(c))
    for _ in range(rounds):
        own = [[] for _ in c]
        for _, v in kept:
            own[nearest(v)[1]].append(v)
        c = [[sum(x) // len(o) for x in zip(*o, strict=True)] if o else p for o, p in zip(own, c, strict=True)]
    at = [(i, *nearest(v)) for i, v in kept]
    total = Counter()
    for _, d, j in at:
        total[j] += d
    return sorted((str(i), j, d, total[j], sum(total.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in at)


def clustered(spark, rows):
    cols = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    return sorted((str(r["vec_id"]), *(r[c] for c in cols)) for r in centroids.described(vectors(spark, rows)).collect())


def test_clustering_against_naive_rounds(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(11, 64))
    rows = [(i, (middles[rng.integers(11)] + 0.3 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(300)]
    rows += [rows[0], (None, rows[1][1]), (None, rows[2][1]), *((i, rows[9][1]) for i in range(400, 560))]
    assert clustered(spark, rows + ODD) == lloyd(rows + ODD)


def test_clustering_of_ties_and_few_vectors(spark):
    rng = random.Random(2)
    grid = [(i, [rng.choice([0.0, 1.0]) if j < 3 else 0.0 for j in range(64)]) for i in range(90)]
    assert clustered(spark, grid) == lloyd(grid)
    for n in (0, 1, 2, 5):
        assert clustered(spark, grid[:n]) == lloyd(grid[:n])
    same = [(i, [0.25] * 64) for i in range(20)]
    assert clustered(spark, same) == lloyd(same)
    huge = [(i, [float(rng.choice([1e4, -3e4, 2.5e4])) for _ in range(64)]) for i in range(30)]
    assert clustered(spark, huge) == lloyd(huge)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 9), st.integers(1, 4))
def test_bounds_never_hide_a_nearest_centroid(seed, k, d):
    rng = np.random.default_rng(seed)
    v = rng.integers(-6, 7, (60, d)).astype(float)
    c = centroids.Centroids(rng.integers(-6, 7, (k, d)).astype(float), np.zeros(k))
    at, upper, lower, _ = centroids.scan(v, c)
    for _ in range(4):
        new = c.points + rng.integers(-1, 2, (k, d)) * rng.integers(0, 2, (k, 1))
        moved = np.sqrt(((new - c.points) ** 2).sum(axis=1)) * (1 + centroids.PAD)
        c = centroids.Centroids(new, moved)
        at, upper, lower, _ = centroids.search(v, at, upper, lower, c)
        assert at.tolist() == centroids.scan(v, c)[0].tolist()
        apart = np.sqrt(np.array([centroids.squared(v, p) for p in c.points]))
        assert (upper >= apart[at, range(60)]).all()
        if k > 1:
            others = np.where(np.arange(k)[:, None] == at, np.inf, apart).min(axis=0)
            assert (lower <= others).all()


def test_bounds_save_distances(spark):
    rng = np.random.default_rng(6)
    middles = 3 * rng.normal(size=(8, 64))
    rows = [(i, (middles[i % 8] + 0.1 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(800)]
    made = centroids.cluster(vectors(spark, rows))
    assert made.took[0] == 8 * 800 and made.took[-1] < 2 * 800


def test_spent_deletes_only_what_cut_wrote(spark, tmp_path):
    a = cut(spark.range(5))
    path = a.inputFiles()[0]
    spent(a)
    with pytest.raises(Exception, match=r"(?i)exist|FILE"):
        spark.read.parquet(path).count()
    spark.range(5).write.parquet(str(tmp_path / "b"))
    b = spark.read.parquet(str(tmp_path / "b"))
    spent(b)
    assert b.count() == 5


def naive_repeats(texts, length=35):
    ws = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for w in ws:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        out.append((len(w), sum(gone), [x for x, g in zip(w, gone, strict=True) if not g]))
    return out


def agree(spark, texts, ids=None, length=35):
    want = naive_repeats(texts, length)
    got = substrings.repeats(spark.createDataFrame([(i, t, 1, "e") for i, t in zip(ids or range(len(texts)), texts, strict=True)], "doc_id long, text string, mark int, spans string").repartition(5), length).collect()
    digest = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted((str(i), n, m, digest(w)) for i, (n, m, w) in zip(ids or range(len(texts)), want, strict=True))
    for r in got:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"] and all(s["stop"] - s["start"] >= length for s in r["spans"])
        assert all(a["stop"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    return want


def test_repeats_against_every_window(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    run = lambda n: " ".join(rng.choices(words, k=n))
    shared = [run(n) for n in (34, 35, 36, 50, 61, 90, 200, 400)]
    texts = [run(rng.choice([0, 10, 34, 35, 60, 300])) for _ in range(40)]
    for _ in range(120):
        texts.append(" ".join(x for _ in range(rng.randint(1, 3)) for x in (run(rng.choice([0, 1, 5, 30])), rng.choice(shared))))
    texts += [f"{run(20)} {shared[4]} {run(20)}" for _ in range(60)]
    for _ in range(30):
        w = rng.choice(texts[40:160]).split()
        a, b = sorted(rng.choices(range(len(w) + 1), k=2))
        texts.append(" ".join(w[:a] + w[b:]))
    texts += [texts[50], texts[50], texts[60].replace(" ", "\n "), texts[3].upper(), shared[6], shared[6] + " " + shared[6]]
    want = agree(spark, texts)
    assert 0 < sum(0 < m < n for n, m, _ in want) < len(want)


def test_repeats_of_low_variety_and_edge_cases(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "a " * 34, "b " * 35, "c " * 36, "d " * 3000, "x y " * 40, "x y z " * 30, "y x " * 17 + "y", "é é " * 20]
    texts += [" ".join(rng.choices("ab", k=rng.choice([50, 120, 200]))) for _ in range(12)]
    agree(spark, texts)
    one = " ".join(f"t{i}" for i in range(60))
    agree(spark, [one, one, None, None, one + " more", "only " + one], [None, None, None, None, None, 4])
    agree(spark, [])
    agree(spark, [f"s{j} " + " ".join(f"k{i}" for i in range(12)) + f" e{j}" for j in range(9)], length=12)


def test_without_repeats_keeps_columns_and_clean_texts(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    texts = ["  clean\n\ntext ", f"a  {passage}  b", f"c {passage}", passage, passage]
    got = {r["doc_id"]: r for r in substrings.without_repeats(spark.createDataFrame([(i, t, "e", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept string, repeats_id int")).collect()}
    assert [got[i]["text"] for i in range(5)] == ["  clean\n\ntext ", "a b", "c", "", ""]
    assert got[1]["kept"] == "e" and got[1]["repeats_id"] == 7


def test_equal_windows_select_the_same_anchor():
    rng = random.Random(3)
    w = substrings.hashes([str(rng.randrange(50)).encode() for _ in range(400)])
    at, _ = substrings.anchors(w)
    places = set(at.tolist())
    for i in range(len(w) - 34):
        own = [p for p in places if i <= p <= i + 25]
        assert own
        alone, _ = substrings.anchors(w[i : i + 35])
        assert len(alone) == 1 and int(alone[0]) + i in places


def test_anchors_of_long_texts_are_those_of_one_pass(monkeypatch):
    rng = random.Random(4)
    w = substrings.hashes([str(rng.randrange(9)).encode() for _ in range(1000)])
    one = substrings.anchors(w)[0].tolist()
    g = substrings.grams(w, substrings.ANCHOR)
    order = [(int(x) >> 20, i) for i, x in enumerate(g)]
    assert one == sorted({min(order[i : i + 26])[1] for i in range(len(g) - 25)})
    monkeypatch.setattr(substrings, "PLACES", 64)
    at = substrings.anchors(w)[0].tolist()
    order = [(int(x) >> 6, i) for i, x in enumerate(g)]
    assert at == sorted({min(order[i : i + 26])[1] for i in range(len(g) - 25)})


def test_registered_rows(spark, data):
    ids = sorted(r["vec_id"] for r in spark.read.parquet(f"{data}/embeddings.parquet").select("vec_id").collect())
    got = queries.QUERIES["op11_whitening"](spark, data)
    assert sorted(r["vec_id"] for r in got.filter("component = 32").collect()) == ids
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
