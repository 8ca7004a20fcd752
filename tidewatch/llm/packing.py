"""Packing documents into sequences of bounded length with balanced attention cost.

A piece of n tokens costs LINEAR n + QUADRATIC n n (attention stays within a piece). A document's whole multiples
of the capacity are full sequences. The rests are pooled, POOL sequences' worth at a time, in the order of the
input split: as many sequences are opened as the pool's tokens need at least, and the rests, longest first, each go to
the sequence of lowest cost that has room for them. When none has room for all of it, a rest is cut over the
cheapest sequences with room. So a pool leaves less than one sequence of padding. Every task packs its own split:
nothing is shuffled and no group meets.

Defined cases: null text is empty and has the end id alone; a null doc_id stays null; repeated rows are packed each;
rests that tie in length go in the order of the split, sequences that tie in cost by their number; very long texts
are cut into full sequences; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm import tokens
from tidewatch.llm.common import lean
from tidewatch.llm.tokens import encoder

CAPACITY = 1024
POOL = 512
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
END = 0
#: Pieces that go back to Spark at once: their ids are held three times meanwhile.
ROWS = 250
#: Pieces that a worker remembers where nothing else needs its memory (not with `spare`).
CACHE = 1_000_000
#: Texts encoded at once.
SLICE = 250
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def assign(lengths: np.ndarray, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(rest, from, length, sequence) for rests of the given lengths, none above the capacity."""
    n = -(-int(lengths.sum()) // capacity)
    cost, room = np.zeros(n), np.full(n, capacity, np.int64)
    out = []

    def put(i: int, at: int, length: int, s: int) -> None:
        cost[s] += linear * length + quadratic * length * length
        room[s] -= length
        out.append((i, at, length, s))

    for i in np.argsort(-lengths, kind="stable"):
        left, at = int(lengths[i]), 0
        s = int(np.argmin(np.where(room >= left, cost, np.inf)))
        if room[s] >= left:
            put(i, 0, left, s)
            continue
        while left:
            s = int(np.argmin(np.where(room > 0, cost, np.inf)))
            take = min(left, int(room[s]))
            put(i, at, take, s)
            at, left = at + take, left - take
    return out


def pack(docs: DataFrame, path: str, spaced: bool = True, end: int = END, capacity: int = CAPACITY, pool: int = POOL, added: bool = True, spare: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian 32-bit).

    path: the tokenizer's file, present on every executor. added: see tokens.Encoder. spare: whether a task
    gives back what it freed after each batch, and at its end the tokenizer and the pieces that it met, for executors
    with little memory beside other stages; the next task then meets them again."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(keep="tokens")
        encode = encoder(path, spaced, added, tokens.CACHE if spare else CACHE).encode
        number = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rests: list[tuple[int, int, np.ndarray, int]] = []
        waiting = 0

        def settle() -> None:
            nonlocal number, waiting
            fill: dict[int, int] = {}
            for i, at, length, s in assign(np.array([len(r[2]) for r in rests], np.int64), capacity):
                doc, start, ids, total = rests[i]
                rows.append((doc, start + at, length, total, number + s, fill.get(s, 0), ids[at : at + length].tobytes()))
                fill[s] = fill.get(s, 0) + length
            number += len(fill)
            rests.clear()
            waiting = 0

        def flush() -> pa.RecordBatch:
            names = [c.split()[0] for c in SCHEMA.split(", ")]
            kinds = [pa.int64()] * 6 + [pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                for doc, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, end).astype("<u4")
                    whole = len(ids) // capacity * capacity
                    for at in range(0, whole, capacity):
                        rows.append((doc, at, capacity, len(ids), number, 0, ids[at : at + capacity].tobytes()))
                        number += 1
                    if whole < len(ids):
                        rests.append((doc, whole, ids[whole:], len(ids)))
                        waiting += len(ids) - whole
                    if waiting >= pool * capacity:
                        settle()
                    if len(rows) >= ROWS:
                        yield flush()
            if spare:
                lean(keep="tokens")
        if rests:
            settle()
        if rows:
            yield flush()
        if spare:
            encode = batch = part = ids = None
            lean()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(packed, SCHEMA)
