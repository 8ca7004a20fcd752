"""Fingerprints of closed syncmers: k-mers whose least inner substring lies at one of their edges.

A k-mer of K characters is an anchor when the smallest hash among its inner substrings of S characters is that of
the first or the last of them. That depends on the k-mer alone, so copied passages keep their anchors wherever
they stand, and any window of 2 K - S - 1 characters holds one. A fingerprint lists the anchors' 32-bit hashes in
text order (hexadecimal); an anchor equal to the one before it is listed once, so that a character repeated for
pages is one anchor. Likeness is Dice's: twice the distinct anchors shared over the sum of both.

Defined cases: a null text is empty and has the empty fingerprint; very long texts are read whole; a text shorter than K, or without anchors, is
one anchor as a whole; two empty fingerprints are alike (1), an empty and another are not (0). A document's next is
the one before it in ascending doc_id (the first's is the last); rows that share a doc_id stand in the order of
their texts; null doc_ids come last in descending order, by the hash of their texts; a single row is its own next; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import lean, partitions
from tidewatch.llm.tokenfile import Ranges

K, S = 32, 8
_P, _ODD = 0x100000001B3, np.uint64(0x9E3779B97F4A7C15)


def power(n: int) -> np.uint64:
    return np.uint64(pow(_P, n, 1 << 64))


def anchors(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the closed syncmers of a text, in order."""
    text = text or ""
    if not text:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) >= K:
        h, n = codes.astype(np.uint64) + np.uint64(1), 1
        while n < S:  # S is a power of two
            h, n = h[:-n] * power(n) + h[n:], 2 * n
        inner = ((h * _ODD) >> np.uint64(32)).astype(np.uint32)
        width = K - S + 1
        least, n = inner, 1
        while 2 * n <= width:
            least, n = np.minimum(least[:-n], least[n:]), 2 * n
        count = len(codes) - K + 1
        least = np.minimum(least[:count], least[width - n : width - n + count])
        at = np.flatnonzero((least == inner[:count]) | (least == inner[width - 1 : width - 1 + count]))
        whole = h[at]
        for i in range(1, K // S):
            whole = whole * power(S) + h[at + i * S]
        mixed = (whole ^ (whole >> np.uint64(31))) * _ODD
        name = (mixed >> np.uint64(32)).astype(np.uint32)
        if len(name):
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            return name[new], at[new]
    digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest()
    return np.frombuffer(digest, ">u4").astype(np.uint32), np.zeros(1, np.int64)


def shown(name: np.ndarray) -> str:
    return name.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """a, b: distinct sorted hashes."""
    if not len(a) and not len(b):
        return 1.0
    return 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))


def shared_passages(a: str, b: str) -> list[tuple[int, int, int]]:
    """Positional matching: (position in a, position in b, anchors) of runs of shared anchors at one offset, longest first."""
    (x, p), (y, q) = anchors(a), anchors(b)
    first = dict(zip(y[::-1].tolist(), q[::-1].tolist(), strict=True))
    found: list[list[int]] = []
    for h, i in zip(x.tolist(), p.tolist(), strict=True):
        if h in first:
            if found and found[-1][1] - found[-1][0] == first[h] - i:
                found[-1][2] += 1
            else:
                found.append([i, first[h], 1])
    return sorted(((i, j, n) for i, j, n in found), key=lambda r: -r[2])


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame) -> DataFrame:
    """A row per document: its fingerprint, that of its edited text (the last half replaced by the beginning of the
    next document, in descending doc_id), and their likenesses.

    Documents are dealt to ranges of doc_id. The largest doc_id of a range is also sent to the range above, whose
    last document it follows; so every task finds each document's successor by reading its rows in order."""
    ranges = Ranges(docs, partitions(docs.sparkSession))
    part = F.pandas_udf(lambda w, k: pd.Series(ranges.part(w.to_numpy(bool), k.to_numpy())), "int")
    rows = docs.select(F.col("doc_id").isNull().alias("without"), Ranges.key().alias("key"), F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    heads = rows.select(part("without", "key").alias("part"), "without", "key").groupBy("part", "without").agg(F.max("key").alias("key"))
    down, everything = Window.orderBy(F.desc("part")), Window.partitionBy()
    heads = heads.select("without", "key", F.coalesce(F.lag("part").over(down), F.min("part").over(everything)).alias("part"))
    ahead = rows.join(F.broadcast(heads), ["without", "key"]).select("part", F.lit(True).alias("ahead"), "key", "doc_id", "text")
    dealt = rows.select(part("without", "key").alias("part"), F.lit(False).alias("ahead"), "key", "doc_id", "text").unionByName(ahead)
    ordered = dealt.repartitionById(ranges.n, F.col("part")).sortWithinPartitions("part", "ahead", F.desc("key"), "text")
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held = None  # the document whose next is still to come: part, doc_id, text, anchors, distinct anchors
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[c.split()[0] for c in OUT.split(", ")])
            out.clear()
            return got

        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                some = batch.slice(lo, 500)
                for p, ahead, doc, text in zip(*(some.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                    if ahead and held is None:
                        continue
                    name = anchors(text)[0]
                    distinct = np.unique(name)
                    if held is not None:
                        _, doc0, text0, name0, distinct0 = held
                        half = len(text0) // 2
                        edited = text0[: len(text0) - half] + text[:half]
                        name1 = anchors(edited)[0]
                        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                        out.append((doc0, len(text0), sha, shown(name0), shown(name1), likeness(distinct0, np.unique(name1)), likeness(distinct0, distinct)))
                    held = None if ahead else (p, doc, text, name, distinct)
                if len(out) >= 2000:
                    yield flush()
        if out:
            yield flush()

    return ordered.mapInArrow(printed, OUT)
