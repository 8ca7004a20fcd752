"""Token ids in files of patched frame-of-reference blocks, written and read back through Spark.

Ids of all documents, in ascending order of doc_id, are cut into segments (whole documents, about SEGMENT ids) of
blocks of BLOCK ids. A block holds its minimum, the differences to it packed at the bit width that covers one of
PERCENTILES of them (the one of least size), and the rest as exceptions: position and the bits above that width. A segment's payload is

    magic "TWPF", count of ids, count of blocks (u32); block starts in bytes (u32 each); then per block
    minimum (u32), width (u8), count of exceptions (u8), packed low bits, exception positions (u8 each),
    exception high bits (u32 each); all little-endian.

The block starts let a reader decode any span of ids alone. Documents are dealt to ranges of doc_id by
approximate quantiles over all of them; a segment row names its range and its start within the range, so only one
total per range has to be summed over the ranges.

Defined cases: null text is empty and has the end id alone; very long texts are encoded whole, and a segment holds
one longer than it; null doc_ids sort first, by the text's hash; rows that share a doc_id follow each other in the order of their ids, so
repeated rows tie without effect; an empty table gives no segments; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, lean, partitions
from tidewatch.llm.tokens import encoder

BLOCK = 128
PERCENTILES = (0.75, 0.9, 0.97, 1.0)
SEGMENT = 1 << 18
END = 2
#: Pieces that a worker remembers while it encodes.
CACHE = 1_000_000
MAGIC = b"TWPF"


def quantiles(keys: DataFrame, n: int) -> list[int]:
    """At most n - 1 cut points of the only column of keys, in order."""
    got = keys.agg(F.percentile_approx(F.col(keys.columns[0]), [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    return sorted(set(got or []))


class Ranges:
    """n ranges of documents in ascending order of doc_id. Documents without one come first, in order of the text's hash, in as many
    ranges as their share asks for, so they are dealt out like others (copies of one text without doc_id stay together)."""

    def __init__(self, docs: DataFrame, n: int) -> None:
        rows, none = docs.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
        n = max(n, 2) if 0 < none < rows else n
        self.first = min(max(1, round(n * none / rows)), n - (none < rows)) if none else 0
        self.n = n
        keys = lambda of, k: np.array(quantiles(docs.filter(of).select(self.key().alias("key")), k), np.int64)
        self.none = keys(F.col("doc_id").isNull(), self.first) if none else np.array([], np.int64)
        self.some = keys(F.col("doc_id").isNotNull(), n - self.first) if none < rows else np.array([], np.int64)

    @staticmethod
    def key() -> Column:
        """A document's place among those with (or without) a doc_id."""
        return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))

    def part(self, without: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.where(without, np.searchsorted(self.none, key, "left"), self.first + np.searchsorted(self.some, key, "left")).astype(np.int32)


_LENGTH = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bits(x: np.ndarray) -> np.ndarray:
    """Bit length of each value below 2 ** 32."""
    if x.dtype == np.uint16:
        return _LENGTH[x]
    return np.where(x >> 16 > 0, 16 + _LENGTH[x >> 16], _LENGTH[x & 0xFFFF])


def pack_ids(ids: np.ndarray) -> bytes:
    n, count = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return MAGIC + struct.pack("<II", 0, 0)
    full = np.append(ids, np.full(count * BLOCK - n, ids[-1], ids.dtype)).reshape(count, BLOCK)
    low = full.min(1)
    rel = full - low[:, None]
    word, unit = ("<u2", 16) if rel.max() < 65536 else ("<u4", 32)
    rel = rel.astype(word)
    ranks = sorted({int(p * BLOCK) - 1 for p in PERCENTILES})
    length, ordered = bits(rel), np.partition(rel, ranks, axis=1)
    width, least = np.zeros(count, np.int64), np.full(count, np.inf)
    for r in ranks:
        w = bits(ordered[:, r])
        cost = BLOCK // 8 * w.astype(np.int64) + 5 * (length > w[:, None]).sum(1)
        width, least = np.where(cost < least, w, width), np.minimum(cost, least)
    over = length > width[:, None]
    extra = over.sum(1)
    row, where = np.nonzero(over)
    places, highs = where.astype(np.uint8).tobytes(), (rel[row, where].astype("<u4") >> width[row].astype(np.uint32)).tobytes()
    ends = np.cumsum(extra).tolist()
    body: list[bytes] = [b""] * count
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w == unit:
            packed = rel[at].view(np.uint8)
        else:
            each = np.unpackbits(rel[at].view(np.uint8).reshape(len(at), BLOCK, unit // 8), axis=2, bitorder="little")[:, :, :w]
            packed = np.packbits(each.reshape(len(at), -1), axis=1, bitorder="little")
        rows, step = packed.tobytes(), packed.shape[1]
        for j, (b, start, n_extra) in enumerate(zip(at.tolist(), low[at].tolist(), extra[at].tolist(), strict=True)):
            to = ends[b]
            body[b] = struct.pack("<IBB", start, w, n_extra) + rows[j * step : (j + 1) * step] + places[to - n_extra : to] + highs[4 * (to - n_extra) : 4 * to]
    size = np.fromiter(map(len, body), np.int64, count)
    starts = 12 + 4 * count + np.cumsum(size) - size
    return MAGIC + struct.pack("<II", n, count) + starts.astype("<u4").tobytes() + b"".join(body)


def unpack_ids(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (exclusive; all without them)."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of token ids")
    n, count = struct.unpack_from("<II", data, 4)
    last = count if last is None else min(last, count)
    if first >= last:
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    starts = np.frombuffer(data, "<u4", count, 12).astype(np.int64)[first:last]
    head = raw[starts[:, None] + np.arange(6)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4")
    width, extra = head[:, 4].astype(np.int64), head[:, 5].astype(np.int64)
    out = np.zeros((last - first, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        unit, word = (16, "<u2") if w <= 16 else (32, "<u4")
        packed = raw[starts[at][:, None] + 6 + np.arange(BLOCK // 8 * w)]
        if w != unit:
            wide = np.zeros((len(at), BLOCK, unit), np.uint8)
            wide[:, :, :w] = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(at), BLOCK, w)
            packed = np.packbits(wide.reshape(len(at), -1), axis=1, bitorder="little")
        out[at] = packed.view(word)
    total = int(extra.sum())
    if total:
        block = np.repeat(np.arange(last - first), extra)
        nth = np.arange(total) - np.repeat(np.cumsum(extra) - extra, extra)
        tail = starts + 6 + BLOCK // 8 * width
        high = raw[(tail + extra)[block][:, None] + 4 * nth[:, None] + np.arange(4)].view("<u4")[:, 0]
        out[block, raw[tail[block] + nth]] |= high << width[block].astype(np.uint32)
    out += low
    return out.ravel()[: min(n, last * BLOCK) - first * BLOCK]


SEGMENTS = "part int, start_in_part long, doc_ids array<long>, counts array<int>, payload binary"


def write(docs: DataFrame, path: str, spaced: bool = False, end: int = END, added: bool = True) -> DataFrame:
    """Segments of the ids of docs, as a written table: part, start_in_part, doc_ids, counts, payload."""
    ranges = Ranges(docs, partitions(docs.sparkSession))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean(keep="tokens")
        own = encoder(path, spaced, added, CACHE)
        encode = own.encode
        kind, wide = ("<u2", 2) if own.tokenizer.get_vocab_size() <= 65536 > end else ("<u4", 4)
        last = np.array([end], kind).tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                some = batch.slice(lo, 2000)
                ids = [x.astype(kind).tobytes() + last for x in encode(some.column(2).to_pylist())]
                part = ranges.part(some.column(0).is_null().to_numpy(zero_copy_only=False), some.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), some.column(1), some.column(0), pa.array([len(x) // wide for x in ids], pa.int32()), pa.array(ids, pa.binary())],
                    names=["part", "key", "doc_id", "count", "ids"],
                )

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list = []
        held: list[np.ndarray] = []
        part, start, total = None, 0, 0
        lean()

        def flush() -> pa.RecordBatch:
            nonlocal start, total
            payload = pack_ids(np.concatenate(held))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([start]), pa.array([names[:]], pa.list_(pa.int64())), pa.array([[len(x) for x in held]], pa.list_(pa.int32())), pa.array([payload], pa.binary())],
                names=["part", "start_in_part", "doc_ids", "counts", "payload"],
            )
            start += total
            total = 0
            names.clear()
            held.clear()
            return out

        for batch in batches:
            for p, doc, count, raw in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if p != part:
                    if held:
                        yield flush()
                    part, start = p, 0
                names.append(doc)
                held.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * count else "<u4"))
                total += count
                if total >= SEGMENT:
                    yield flush()
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), Ranges.key().alias("key"), "text").mapInArrow(encoded, "part int, key long, doc_id long, count int, ids binary")
    ordered = rows.repartitionById(ranges.n, F.col("part")).sortWithinPartitions("part", "key", "ids")
    return cut(ordered.mapInArrow(segments, SEGMENTS))


def read(segments: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document, decoded from the segments."""
    totals = segments.select("part", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    bases = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                start, docs, counts, payload = (batch.column(c)[i].as_py() for c in range(4))
                ids, counts = unpack_ids(payload), np.asarray(counts, np.int64)
                to = np.cumsum(counts)
                flat = ids.astype("<u4").tobytes()
                each = [flat[4 * (b - n) : 4 * b] for b, n in zip(to.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(start + to - counts), pa.array(counts), pa.array(each, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"],
                )

    at = segments.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start_in_part")).alias("start"), "doc_ids", "counts", "payload")
    return at.mapInArrow(decoded, "doc_id long, start long, n_tokens long, ids binary")
