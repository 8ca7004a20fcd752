"""Passages that occur more than once, by seed and extend: winnowed anchors are the seeds, and what surrounds two
occurrences of one anchor is compared in both directions up to the length that counts.

A window is `LENGTH` consecutive words of one document. Of the ANCHOR-word grams of each window, winnowing selects the one
of the least hash (the leftmost of equal ones), which depends on the window's words alone: two equal windows select the
same anchor at the same place. So every repeat shows as two occurrences of an anchor, and anchors that occur once are
dropped after one slim shuffle of hashes.

Extension never lists the pairs of an anchor's occurrences, as a passage that a third of all documents hold would have
their square. Words further from an anchor than LENGTH - ANCHOR share no window with it, so an occurrence is
extended over that many words each way (its surroundings, less at the ends of a text), and occurrences are compared as classes:

1. Occurrences with the same surroundings are one class. A class of two or more has been extended in full: all it covers is repeated.
2. Where an anchor has several classes, one occurrence of each is extended word by word: for each number of words to
   the left, with as many to the right as make up a window, those that agree are a class again, and a class of two or more is a repeat.

The union of both, merged, gives the maximal repeats of each document. Interior anchors of a passage take one row each; only anchors
near the ends of passages, where surroundings differ, take the second step. Copies of a whole text are known by the hash of their words:
they are repeats from end to end, stand in the seeds once a task at most, and need no spans.

Surroundings, windows and texts are compared by 128-bit hashes.

Defined cases: null and empty texts have no words and no repeats; texts under LENGTH words have none; very long texts are
read whole, their anchors in slices; a repeated row repeats all windows of its text; null doc_ids are told apart by their texts;
ties are leftmost; extra columns are ignored by `repeats` and kept by `without_repeats`; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, cut, fresh, lean, small

LENGTH = 35
#: Words of an anchor. Winnowing selects about two of LENGTH - ANCHOR + 2 grams.
ANCHOR = 10
LOWEST = -(2**63)
SLICE = 200
#: Anchors whose surroundings are hashed at once.
AT_ONCE = 10_000
#: Grams among which anchors are looked for at once.
PLACES = 1 << 20
#: Ids of documents to read again may be broadcast up to this many.
IDS = 1_000_000
_ODD = np.random.default_rng(12).integers(1, 2**63, (2, 1 << 12), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HALF = np.uint64(32)
NOTHING = hashlib.sha256(b"").hexdigest()


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 60_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_SEEN = Hashes()


def forget() -> None:
    _SEEN.clear()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_SEEN.__getitem__, ws), np.uint64, len(ws))


def mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of the rows of h: a sum of the words' hashes, each scrambled by its place."""
    parts = []
    for lo in range(0, len(h), AT_ONCE):
        x = h[lo : lo + AT_ONCE] * _ODD[lane, : h.shape[1]]
        x ^= x >> _HALF
        parts.append(x.sum(axis=1, dtype=np.uint64))
    out = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return (out ^ (out >> np.uint64(29))) * _ODD[lane, -1]


def grams(h: np.ndarray, q: int) -> np.ndarray:
    return mixed(np.lib.stride_tricks.sliding_window_view(h, q), 0) if len(h) >= q else h[:0]


def anchors(h: np.ndarray, length: int = LENGTH, q: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the grams that some window of `length` words selects: the least by the hash's high bits, then the leftmost."""
    g = grams(h, q)
    span, total = length - q + 1, len(g)
    if total < span:
        return np.zeros(0, np.int64), g[:0]
    found = []
    for lo in range(0, total - span + 1, PLACES - span):
        own = g[lo : lo + PLACES]  # places stand in the low bits of the order
        least = (own & ~np.uint64(PLACES - 1)) | np.arange(len(own), dtype=np.uint64)
        wide = 1
        while wide < span:  # least of `wide` neighbours, doubled while that fits
            step = min(wide, span - wide)
            least = np.minimum(least[:-step], least[step:])
            wide += step
        at = (least & np.uint64(PLACES - 1)).astype(np.int64)
        found.append(lo + at[np.concatenate([[True], at[1:] != at[:-1]])])
    at = np.concatenate(found) if len(found) == 1 else np.unique(np.concatenate(found))
    return at, g[at]


def surroundings(h: np.ndarray, at: np.ndarray, length: int = LENGTH, q: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the words around each anchor, as far as a window that holds it can reach. A text's end counts as a sign of its own."""
    reach = length - q
    padded = np.concatenate([np.full(reach, 1, np.uint64), h, np.full(reach, 2, np.uint64)])
    around = np.lib.stride_tricks.sliding_window_view(padded, q + 2 * reach)
    parts = [around[at[i : i + AT_ONCE]] for i in range(0, len(at), AT_ONCE)] or [around[at]]
    return tuple(np.concatenate([mixed(p, lane) for p in parts]) for lane in (0, 1))


def text_name(joined: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(joined)
    return (x >> 64) - 2**63, (x & (2**64 - 1)) - 2**63


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat).cast(kind))


def prints(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, mark, n (words), sha (of all words), h1 and h2 (name of the text), and for the first text of its name in a task the
    anchors: at, anchor, c1 and c2 (surroundings)."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                n, sha, h1, h2 = [], [], [], []
                found: tuple[list, ...] = ([], [], [], [])
                for text in some.column(2).to_pylist():
                    joined = b" ".join(ws := words(text))
                    name = text_name(joined)
                    n.append(len(ws))
                    sha.append(hashlib.sha256(joined).hexdigest())
                    h1.append(name[0])
                    h2.append(name[1])
                    if len(ws) < length or name in seen:
                        at, anchor, c = np.zeros(0, np.int64), np.zeros(0, np.uint64), (np.zeros(0, np.uint64),) * 2
                    else:
                        seen.add(name)
                        h = hashes(ws)
                        at, anchor = anchors(h, length)
                        c = surroundings(h, at, length)
                    for held, x in zip(found, (at, anchor, *c), strict=True):
                        held.append(x)
                made = [lists(found[0], pa.int32()), *(lists(x, pa.int64()) for x in found[1:])]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(n, pa.int32()), pa.array(sha, pa.string()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), *made], names=["doc_id", "mark", "n", "sha", "h1", "h2", "at", "anchor", "c1", "c2"])

    return docs.select("doc_id", "mark", "text").mapInArrow(listed, "doc_id long, mark long, n int, sha string, h1 long, h2 long, at array<int>, anchor array<long>, c1 array<long>, c2 array<long>")


def windows(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, mark, start, w1 and w2 (128 bits of the window's words) and sure for the windows that hold an anchor of
    docs (doc_id, mark, text, seeds: at, sure); sure where an anchor that is sure gives the window."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        gathered, rows = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows
            doc, mark, times, *columns = zip(*gathered, strict=True)
            start, w1, w2, sure = (np.concatenate(c) for c in columns)
            of = [pa.array(np.repeat(np.array(x, np.int64), times)) for x in (doc, mark)]
            gathered.clear()
            rows = 0
            return pa.RecordBatch.from_arrays([*of, pa.array(start.astype(np.int32)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(sure)], names=["doc_id", "mark", "start", "w1", "w2", "sure"])

        for batch in batches:
            for i in range(batch.num_rows):
                h = hashes(words(batch.column(2)[i].as_py()))
                state = np.zeros(len(h) - length + 1, np.int8)
                for seed in batch.column(3)[i].as_py():
                    own = state[max(0, seed["at"] + ANCHOR - length) : seed["at"] + 1]
                    np.maximum(own, 2 if seed["sure"] else 1, out=own)
                start = np.flatnonzero(state)
                view = np.lib.stride_tricks.sliding_window_view(h, length)
                for lo in range(0, len(start), AT_ONCE):
                    s = start[lo : lo + AT_ONCE]
                    gathered.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), len(s), s, mixed(view[s], 0), mixed(view[s], 1), state[s] == 2))
                    rows += len(s)
                    if rows >= AT_ONCE:
                        yield flush()
        if gathered:
            yield flush()

    return docs.select("doc_id", "mark", "text", "seeds").mapInArrow(cells, "doc_id long, mark long, start int, w1 long, w2 long, sure boolean")


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias("doc_id"), F.xxhash64("text").alias("mark"), "text")


def texts_with(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with what places (written: doc_id, mark and a list) has of them. Where the keys are few enough, other texts are not moved."""
    some = docs.join(small(places.select("doc_id", "mark"), IDS), ["doc_id", "mark"], "left_semi")
    return some.join(places, ["doc_id", "mark"])


def spans(seen: DataFrame, docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, mark, start, stop of repeats in texts that occur once: seen has the columns of `prints` and `copied`."""
    reach = length - ANCHOR
    each = seen.select("doc_id", "mark", "n", "copied", F.explode(F.arrays_zip("at", "anchor", "c1", "c2")).alias("s"), "h1", "h2")
    each = each.select("doc_id", "mark", "n", "copied", "s.*", F.xxhash64("h1", "h2", "s.at").alias("who"))
    shared = cut(each.groupBy("anchor").agg(F.min("who").alias("a"), F.max("who").alias("b")).filter("a <> b").select("anchor"))
    seeds = cut(each.join(shared, "anchor", "left_semi"))

    # Occurrences with the same surroundings; "sure" if more than one.
    least = F.min(F.struct("who", "doc_id", "mark", "at")).alias("lo")
    classes = seeds.groupBy("anchor", "c1", "c2").agg(least, F.max("who").alias("hi"), F.max("copied").alias("copied"))
    classes = cut(classes.select("anchor", "c1", "c2", "lo.doc_id", "lo.mark", "lo.at", (F.col("copied") | (F.col("lo.who") < F.col("hi"))).alias("sure")))
    whole = seeds.filter("not copied").join(classes.filter("sure").select("c1", "c2"), ["c1", "c2"], "left_semi")
    extended = whole.select("doc_id", "mark", F.greatest(F.col("at") - reach, F.lit(0)).alias("start"), F.least(F.col("at") + length, "n").alias("stop"))

    # Where surroundings differ: word by word, one occurrence of each class.
    open_ = cut(classes.groupBy("anchor").agg(F.count("*").alias("c"), F.min("sure").alias("all_sure")).filter("c > 1 and not all_sure").select("anchor"))
    places = classes.join(open_, "anchor", "left_semi").groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "sure")).alias("seeds"))
    at = cut(windows(texts_with(docs, cut(places)), length))
    who = F.xxhash64("doc_id", "mark", "start")
    twice = at.groupBy("w1", "w2").agg(F.min(who).alias("a"), F.max(who).alias("b"), F.max("sure").alias("sure")).filter("sure or a <> b").select("w1", "w2")
    more = at.filter("not sure").join(cut(twice), ["w1", "w2"], "left_semi")
    return extended.filter(F.col("stop") - F.col("start") >= length).unionByName(more.select("doc_id", "mark", "start", (F.col("start") + length).alias("stop")))


def without(docs: DataFrame) -> DataFrame:
    """doc_id, mark, spans (merged), kept (the words left, joined by one space), n_removed and sha of docs (doc_id, mark, text, found)."""

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                spans_, kept, removed, sha = [], [], [], []
                for text, found in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    ws = words(text)
                    edges = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(edges, [s["start"] for s in found], 1)
                    np.add.at(edges, [s["stop"] for s in found], -1)
                    gone = np.cumsum(edges)[:-1] > 0
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans_.append([{"start": a, "stop": b} for a, b in turns.reshape(-1, 2).tolist()])
                    left = b" ".join(w for w, x in zip(ws, gone.tolist(), strict=True) if not x)
                    kept.append(left.decode("utf-8", "replace"))
                    removed.append(int(gone.sum()))
                    sha.append(hashlib.sha256(left).hexdigest())
                made = [pa.array(spans_, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(kept, pa.string()), pa.array(removed, pa.int32()), pa.array(sha, pa.string())]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *made], names=["doc_id", "mark", "spans", "kept", "n_removed", "sha"])

    return docs.select("doc_id", "mark", "text", "found").mapInArrow(cells, "doc_id long, mark long, spans array<struct<start: int, stop: int>>, kept string, n_removed int, sha string")


def parts(docs: DataFrame, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """Every row of docs (doc_id, mark, n, sha of all its words, copied: the same words stand in another row too), and what
    `without` makes of those that are repeated in part."""
    if not ANCHOR < length <= 2000:
        raise ValueError(f"windows have {ANCHOR + 1} to 2000 words")
    docs = keyed(docs)
    seen = cut(prints(docs, length))
    copies = cut(seen.filter(F.col("n") >= length).groupBy("h1", "h2").agg(F.count("*").alias("c")).filter("c > 1").select("h1", "h2", F.lit(True).alias("copied")))
    seen = seen.join(copies, ["h1", "h2"], "left").withColumn("copied", F.coalesce("copied", F.lit(False)))
    found = spans(seen, docs, length).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("found"))
    partly = cut(without(texts_with(docs, cut(found))))
    return seen.select("doc_id", "mark", "n", "sha", "copied"), partly


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans (the maximal repeats: start and stop in words) for every row of docs."""
    seen, partly = parts(docs, length)
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n").alias("stop")))
    none = F.array().cast("array<struct<start:int,stop:int>>")
    out = seen.join(partly.select("doc_id", "mark", "spans", "n_removed", F.col("sha").alias("left")), ["doc_id", "mark"], "left")
    return out.select(
        F.when(F.col("doc_id") != LOWEST, F.col("doc_id")).alias("doc_id"), F.col("n").cast("long").alias("n_words"),
        F.when(F.col("copied"), F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copied"), F.lit(NOTHING)).otherwise(F.coalesce("left", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), all_).otherwise(F.coalesce("spans", none)).alias("spans"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the words of repeats taken out of their texts. Texts without repeats stay as they are; of others the words left
    are joined by one space."""
    seen, partly = parts(docs, length)
    id_, mark, kept, copied = (fresh(docs, c) for c in ("repeats_id", "repeats_mark", "repeats_kept", "repeats_copied"))
    rows = docs.select("*", F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST)).alias(id_), F.xxhash64("text").alias(mark))
    left = partly.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("kept").alias(kept))
    gone = seen.filter("copied").select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.lit(True).alias(copied)).distinct()
    text = F.when(F.col(copied), F.lit("")).otherwise(F.coalesce(kept, "text")).alias("text")
    return rows.join(left, [id_, mark], "left").join(gone, [id_, mark], "left").select(*[text if name.lower() == "text" else c for c, name in zip(columns(docs), docs.columns, strict=True)])
