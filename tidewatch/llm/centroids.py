"""Centroid clustering of integer vectors by rounds of assignment and means, with exponion search.

A vector keeps two bounds from round to round: `upper` is no less than the distance to its centroid, `lower` no more than that
to any other. They move with the centroids. While upper stays under lower, and under half the distance from its centroid to the
next one, the vector is not looked at. Else upper is made exact, and if that is not enough, only centroids in the ball of
radius 2 upper + (distance to the nearest other centroid) around its own can be nearest or second nearest; they are a prefix of
the own centroid's list of the others, sorted by distance. Bounds are padded against rounding and the radius is
inclusive, so ties are seen, and go to the smaller number by exact integer distances.

A round is one pass: it reads the vectors with their bounds from the shared folder and writes them anew, and each task adds
a row per cluster with exact sums, from which the next centroids come. So a lost executor costs tasks of one round; what the round
before wrote is deleted then. What the driver holds is one sum per cluster and component. A round that moves no centroid is
the last to do anything, so the rest are skipped.

Defined cases: null vectors, vectors of another length, and those with null or non-finite entries are left out; the integers are
floor(SCALE * x), held within 62 bits; distances are exact, null where they exceed 64 bits; with fewer vectors than centroids each is one;
vectors of the same hash (repeated or null ids) are ordered by their components; null ids seed after all others; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, lean, spent

K, ROUNDS, SEED = 8, 10, 3
DIMENSIONS, SCALE = 64, 1024
#: Up to this size of components differences, squares and their sums over DIMENSIONS stay exact in doubles; beyond it Python integers are used.
EXACT = 1 << 22
MOST = 2**62
SLICE = 4_000
#: Bounds are widened by this part, well over the rounding of a few operations.
PAD = 1e-9


@dataclass
class Centroids:
    """points: integers, one row each; moved: how far each moved into this place (padded)."""

    points: np.ndarray
    moved: np.ndarray

    def __post_init__(self) -> None:
        k = len(self.points)
        apart = np.sqrt(np.array([squared(self.points, p).astype(float) for p in self.points]).reshape(k, k))
        np.fill_diagonal(apart, np.inf)
        self.near = apart.argsort(axis=1, kind="stable")[:, : k - 1]
        self.apart = np.take_along_axis(apart, self.near, axis=1)
        #: Distance to the nearest other centroid.
        self.alone = self.apart[:, 0] if k > 1 else np.full(k, np.inf)

    def digest(self, j: int) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.points[j]).encode()).hexdigest()


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of v to c, as int64 or, for large components, as Python integers."""
    if v.dtype == object or c.dtype == object:
        return ((v.astype(object) - c.astype(object)) ** 2).sum(axis=1)
    d = v - c
    return np.einsum("ij,ij->i", d, d).astype(np.int64)


def integers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles while they are exact, else Python integers."""
    y = np.floor(x.astype(np.float64) * scale)
    if not y.size or np.abs(y).max() < EXACT:
        return y
    whole = [int(a) for a in np.clip(y, -MOST, MOST).ravel().tolist()]
    return np.array(whole, dtype=object).reshape(y.shape)


def packed(v: np.ndarray) -> list[bytes]:
    """Components as little-endian 64-bit integers."""
    return [r.tobytes() for r in v.astype(np.int64)]


def unpacked(column: pa.Array, d: int) -> np.ndarray:
    v = np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, d)
    return v.astype(np.float64) if not v.size or np.abs(v).max() < EXACT else v.astype(object)


def kept(vectors: DataFrame, d: int = DIMENSIONS) -> DataFrame:
    """vec_id and v (integers, packed) of the vectors that take part."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            rows = np.flatnonzero((np.array(column.value_lengths().fill_null(-1)) == d))
            flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(-1, d)
            fine = np.isfinite(x).all(axis=1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(rows[fine])), pa.array(packed(integers(x[fine])), pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(cells, "vec_id long, v binary")


def first(points: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k points with the smallest hash of their ids."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = points.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()
    return [np.frombuffer(r["v"], np.int64) for r in rows]


def shaped(rows: list[list[int]] | list[np.ndarray], d: int) -> np.ndarray:
    whole = np.array([[int(x) for x in r] for r in rows], dtype=object).reshape(-1, d)
    return whole.astype(np.float64) if not whole.size or max(map(abs, whole.ravel().tolist())) < EXACT else whole


def search(v: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Cluster and bounds of the vectors v, given those for the centroids' last places; and how many distances that took."""
    at, upper, lower = at.copy(), upper.copy(), lower.copy()
    upper += c.moved[at]
    most = np.argsort(c.moved)[::-1]
    lower -= np.where(at == most[0], c.moved[most[1]] if len(most) > 1 else 0.0, c.moved[most[0]])
    safe = np.maximum(lower, c.alone[at] / 2 * (1 - PAD))
    open_ = np.flatnonzero(~(upper < safe))
    took = 0
    for j in np.unique(at[open_]):
        rows = open_[at[open_] == j]
        own = squared(v[rows], c.points[j])
        took += len(rows)
        upper[rows] = np.sqrt(own.astype(float)) * (1 + PAD)
        still = ~(upper[rows] < safe[rows])
        rows, own = rows[still], own[still]
        if not len(rows):
            continue
        radius = (2 * upper[rows] + c.alone[j]) * (1 + PAD)
        reach = np.searchsorted(c.apart[j], radius, side="right")
        best, which = own.copy(), np.full(len(rows), j)
        next_ = np.full(len(rows), np.inf)
        for place in range(reach.max()):
            some = np.flatnonzero(reach > place)
            other = c.near[j][place]
            got = squared(v[rows[some]], c.points[other])
            took += len(some)
            nearer = (got < best[some]) | ((got == best[some]) & (other < which[some]))
            next_[some] = np.where(nearer, np.minimum(next_[some], best[some].astype(float)), np.minimum(next_[some], got.astype(float)))
            best[some] = np.where(nearer, got, best[some])
            which[some] = np.where(nearer, other, which[some])
        at[rows] = which
        upper[rows] = np.sqrt(best.astype(float)) * (1 + PAD)
        lower[rows] = np.sqrt(next_) * (1 - PAD)
    return at, upper, lower, took


def scan(v: np.ndarray, c: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same without bounds: every centroid."""
    d = np.array([squared(v, p) for p in c.points]).reshape(len(c.points), len(v))
    at = d.argmin(axis=0) if d.dtype != object else np.array([min(range(len(d)), key=lambda j: d[j, i]) for i in range(len(v))], int)
    near = np.sort(d.astype(float), axis=0)
    return at, np.sqrt(near[0]) * (1 + PAD), (np.sqrt(near[1]) * (1 - PAD) if len(near) > 1 else np.full(len(v), np.inf)), d.size


_STATE = "vec_id long, v binary, cluster int, upper double, lower double, distance long, rows long, sums array<string>"


def assigned(points: DataFrame, c: Centroids, d: int, bounded: bool, last: bool) -> DataFrame:
    """points with cluster and bounds (with the exact distance where `last`), and from each task a row per cluster with the number
    and the sums of its vectors (as text: they are exact whatever their size)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        k = len(c.points)
        n, took, sums, inertia = np.zeros(k, np.int64), 0, [[0] * d for _ in range(k)], [0] * k
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                v = unpacked(some.column(1), d)
                found = search(v, *(some.column(i).to_numpy() for i in (2, 3, 4)), c) if bounded else scan(v, c)
                at, upper, lower, tried = found
                took += tried
                distance = [None] * len(v)
                for j in np.unique(at):
                    rows = np.flatnonzero(at == j)
                    n[j] += len(rows)
                    sums[j] = [a + int(b) for a, b in zip(sums[j], v[rows].sum(axis=0), strict=True)]
                    if last:
                        for i, x in zip(rows.tolist(), squared(v[rows], c.points[j]).tolist(), strict=True):
                            distance[i] = x if x < 2**63 else None
                            inertia[j] += x
                made = [some.column(0), some.column(1), pa.array(at, pa.int32()), pa.array(upper), pa.array(lower), pa.array(distance, pa.int64()), *(pa.nulls(len(v), t) for t in (pa.int64(), pa.list_(pa.string())))]
                yield pa.RecordBatch.from_arrays(made, names=names)
        own = [j for j in range(k) if n[j]]
        texts = [[str(x) for x in [*sums[j], inertia[j], took if j == own[0] else 0]] for j in own]
        nulls = [pa.nulls(len(own), t) for t in (pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([nulls[0], nulls[1], pa.array(own, pa.int32()), *nulls[2:], pa.array(n[own]), pa.array(texts, pa.list_(pa.string()))], names=names)

    names = [x.split()[0] for x in _STATE.split(", ")]
    return points.select("vec_id", "v", *(["cluster", "upper", "lower"] if bounded else [])).mapInArrow(cells, _STATE)


def totals(state: DataFrame, k: int, d: int) -> tuple[list[int], list[list[int]], int]:
    """Vectors, component sums and then the sum of distances of each cluster, exact; and all distances tried."""
    each = state.filter("rows is not null").select("cluster", "rows", F.posexplode("sums").alias("at", "s")).groupBy("cluster", "at")
    n, sums = [0] * k, [[0] * (d + 2) for _ in range(k)]
    for r in each.agg(F.sum("rows").alias("rows"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k (d + 2) rows
        n[r["cluster"]] = r["rows"]
        sums[r["cluster"]][r["at"]] = int(r["s"])
    return n, sums, sum(s[d + 1] for s in sums)


@dataclass
class Clustering:
    points: DataFrame
    centroids: Centroids | None
    inertia: list[int]
    #: Distances tried in each pass.
    took: list[int]


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED, d: int = DIMENSIONS) -> Clustering:
    """points: vec_id, cluster and distance of every kept vector after the given rounds and a last assignment."""
    points = cut(kept(vectors, d))
    start = shaped(first(points, k, seed), d)
    k = len(start)
    if not k:
        return Clustering(points.selectExpr("vec_id", "0 as cluster", "0L as distance"), None, [], [])
    c, took, state = Centroids(start, np.zeros(k)), [], points
    for _ in range(rounds):
        before, state = state, cut(assigned(state, c, d, bool(took), False))
        spent(before)
        n, sums, tried = totals(state, k, d)
        took.append(tried)
        new = shaped([[x // n[j] for x in sums[j][:d]] if n[j] else [int(x) for x in c.points[j]] for j in range(k)], d)
        moved = np.array([math.sqrt(float(squared(new[j : j + 1], c.points[j])[0])) for j in range(k)]) * (1 + PAD)
        c = Centroids(new, moved)
        state = state.filter("rows is null")
        if not moved.any():
            break
    before, state = state, cut(assigned(state, c, d, bool(took), True))
    spent(before)
    _, sums, tried = totals(state, k, d)
    return Clustering(state.filter("rows is null").select("vec_id", "cluster", "distance"), c, [s[d] for s in sums], [*took, tried])


def described(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """The clustering's points with the inertia of their cluster and of all (null beyond 64 bits), and their centroid's digest."""
    made = cluster(vectors, k, rounds, seed)
    held = lambda x: x if x < 2**63 else None
    facts = [(j, held(x), held(sum(made.inertia)), made.centroids.digest(j)) for j, x in enumerate(made.inertia)]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")  # k rows
    return made.points.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
