"""Whitening of embeddings: mean, covariance in a second pass, eigenvectors, and a projection to unit variance.

1. Entries become integers; each task adds up its vectors exactly and a tree of merges gives the sums, so the mean has no rounding.
2. Each task centres its vectors by those sums, (n x - S) / n with an exact numerator, and adds up outer products by a matrix product;
   treeAggregate merges the d by d matrices, a few at a time, so the driver gets a handful of them whatever the number of tasks.
3. The driver finds eigenvectors by LAPACK's symmetric solver; the projection, d by K, goes to all tasks.
4. A third pass measures the covariance of what comes out (centred within tasks, merged by the rule for two samples' moments) against the identity.

What a task and the driver hold grows with d squared alone; vectors are never shuffled.

Defined cases: null and empty vectors, and those with null or non-finite entries are dropped; so are vectors of another length than the commonest one
(of equally common ones the longest); integers are held within 62 bits; repeated rows count each; null ids stay; deviation is
null where it exceeds 64 bits; components without variance (an eigenvalue under d rounding errors of the largest) have a null whitened value and no part
in the identity error, which is null where there is none; explained is null without any variance; an empty table gives no rows;
the sign of a component makes its largest entry positive (of equal ones the first); extra columns are ignored by `vectors_of` and kept by `whiten`.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from tidewatch.llm.common import columns, fresh, lean

K = 32
SCALE, SHIFT = 64, 1_000_000
MOST = 2**62
#: Vectors handled at once.
SLICE = 4_000
#: Matrices that meet in one task of the tree, as a depth.
DEPTH = 2


@dataclass
class Whitening:
    """n vectors, their sums (Python integers), and of each component its direction, eigenvalue and share of the variance."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def usable(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)


def integers(c: np.ndarray) -> np.ndarray:
    """floor(SCALE c) + SHIFT as int64."""
    return np.clip(np.floor(c * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def of_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and integer vectors of the usable vectors in a column of lists of doubles, by length."""
    size = np.asarray(column.value_lengths().fill_null(0))
    for d in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == d)
        c = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        fine = np.isfinite(c).all(axis=1)
        if fine.any():
            yield rows[fine], integers(c[fine])


def added(x: np.ndarray) -> list[int]:
    """Exact column sums."""
    return (x if np.abs(x).max() < MOST // len(x) else x.astype(object)).sum(axis=0).tolist()


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64, or Python integers where those are too small."""
    if np.abs(x).max(initial=0) * float(n) < MOST and max(map(abs, sums)) < MOST:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, dtype=object)


def squares(dev: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows, null beyond 64 bits."""
    top = float(np.abs(dev).max(initial=0))
    if dev.dtype != object and top * top * dev.shape[1] < MOST:
        return np.einsum("ij,ij->i", dev, dev).tolist()
    whole = (dev.astype(object) ** 2).sum(axis=1).tolist()
    return [x if x < 2**63 else None for x in whole]


def merged(vectors: DataFrame, begin: Callable, add: Callable, merge: Callable):
    """What tasks make of their vectors, merged by a tree; None if there are none. begin() gives a task's state, add(state, x) takes in integer vectors."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        state = begin()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                for _, x in of_length(batch.column(0).slice(lo, SLICE)):
                    state = add(state, x)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(state)], pa.binary())], names=["state"])

    states = vectors.mapInArrow(cells, "state binary").rdd.map(lambda r: pickle.loads(bytes(r["state"])))
    join = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return states.treeAggregate(None, join, join, depth=DEPTH)


def joined_sums(a: dict, b: dict) -> dict:
    out = dict(a)
    for d, (n, s) in b.items():
        m, t = out.get(d, (0, [0] * d))
        out[d] = m + n, [x + y for x, y in zip(s, t, strict=True)]
    return out


def product(state: np.ndarray | None, x: np.ndarray, n: int, sums: list[int]) -> np.ndarray | None:
    if x.shape[1] != len(sums):
        return state
    c = deviations(x, n, sums).astype(np.float64) / n
    return c.T @ c if state is None else state + c.T @ c


def projected(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened coordinates of integer vectors on the components with variance."""
    c = deviations(x, w.n, w.sums).astype(np.float64) / w.n
    return c @ (w.directions[:, w.usable] / np.sqrt(w.values[w.usable]))


def moments(state: tuple | None, x: np.ndarray, w: Whitening) -> tuple | None:
    if x.shape[1] != len(w.sums):
        return state
    y = projected(x, w)
    mean = y.mean(axis=0)
    own = len(y), mean, (y - mean).T @ (y - mean)
    return own if state is None else joined_moments(state, own)


def joined_moments(a: tuple, b: tuple) -> tuple:
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] * b[0] / n)


def vectors_of(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.select(F.col(column).cast("array<double>").alias("c"))


def fit(vectors: DataFrame, k: int = K) -> Whitening | None:
    """The whitening of `vectors_of` a table; None if no vector is left."""
    found = merged(vectors, dict, lambda state, x: joined_sums(state, {x.shape[1]: (len(x), added(x))}), joined_sums)
    if not found:
        return None
    n, sums = found[max(found, key=lambda d: (found[d][0], d))]
    v = merged(vectors, lambda: None, partial(product, n=n, sums=sums), np.add) / n
    values, directions = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:k]
    values, directions = np.maximum(values[order], 0.0), directions[:, order]
    top = np.abs(directions).argmax(axis=0)
    directions *= np.where(directions[top, np.arange(len(top))] < 0, -1.0, 1.0)
    w = Whitening(n, sums, directions, values, float(np.trace(v)))
    if w.usable.any():
        m = merged(vectors, lambda: None, partial(moments, w=w), joined_moments)
        w.identity_error = float(np.abs(m[2] / m[0] - np.eye(len(m[1]))).max())
    return w


def whiten(df: DataFrame, w: Whitening, column: str = "embedding") -> DataFrame:
    """The rows of df whose vector takes part, with `deviation` and `whitened` (one value per component; a column of such a name is replaced)."""
    known = df.sparkSession.sparkContext.broadcast(w)
    d, usable = len(w.sums), w.usable
    old = df.drop("deviation", "whitened")
    at = fresh(old, "whitening_vector")
    rows = old.select(*columns(old), F.col(column).cast("array<double>").alias(at))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                for own, x in of_length(some.column(some.num_columns - 1)):
                    if x.shape[1] != d:
                        continue
                    y = np.full((len(x), len(usable)), np.nan)
                    y[:, usable] = projected(x, known.value)
                    flat = pa.array(y.ravel(), mask=np.tile(~usable, len(x)))
                    whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, max(1, len(usable))), pa.int32()), flat)
                    deviation = pa.array(squares(deviations(x, known.value.n, known.value.sums)), pa.int64())
                    kept = some.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays([*kept.columns[:-1], deviation, whitened], names=[*kept.schema.names[:-1], "deviation", "whitened"])

    schema = StructType([*old.schema.fields, StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])
    return rows.mapInArrow(cells, schema)


def components(df: DataFrame, k: int = K) -> DataFrame:
    """A row per vector that takes part and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    w = fit(vectors_of(df), k)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        return df.sparkSession.createDataFrame([], kinds)
    explained = F.array(*[F.lit(float(e / w.trace) if w.trace > 0 else None).cast("double") for e in w.values])
    rows = whiten(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), w).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, "at").alias("explained"), F.lit(w.identity_error).cast("double").alias("identity_error"),
    )
