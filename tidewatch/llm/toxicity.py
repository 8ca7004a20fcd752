"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A feature is the presence of a character n-gram (3 to 7 characters, lower case, ASCII punctuation as space) in a
text; its value is the log ratio of its smoothed document frequency among toxic and among other training texts.
Logistic regression with a ridge penalty weighs these values. Training takes a sample of labelled rows, bounded by
TRAIN_ROWS of each class (those of the smallest hash of doc_id); the classes' true sizes weigh the loss, so scores
keep the base rate. Scoring reads whole texts, in runs of bounded size.

Defined cases: null and empty texts get the score of the intercept alone; very long texts are read whole, in runs;
labels repeated for a document count once, toxic if any is; without labels of both classes every text gets
PRESUMED, below the threshold; rows whose doc_id repeats are each scored, equal texts alike; a score equal to the threshold is
toxic; of n-grams that tie for the last place among FEATURES, those of the smaller hash stay; an empty table gives no
rows; extra columns pass through, but for one of the name of the score, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lean, runs

TRAIN_ROWS = 3000
GRAMS = (3, 4, 5, 6, 7)
FEATURES = 8192
MIN_DOCS = 4
RIDGE = 0.02
STEPS = 300
THRESHOLD = 0.3
#: The score of any text where there is nothing to learn from.
PRESUMED = 0.1
BITS = 22
RUN_CHARS = 250_000
_P, _ODD = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_CLASS = np.arange(128, dtype=np.uint32)
_CLASS[[i for i in range(128) if not chr(i).isalnum()]] = 32


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the hashes of all n-grams of the joined texts, the texts' starts, and each text's last gram start + 1."""
    lower = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], codes).astype(np.uint64)
    sizes = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = codes + np.uint64(1)
    for n in range(2, GRAMS[-1] + 1):
        if len(codes) < n:
            return
        h = h[:-1] * _P + codes[n - 1 :]
        if n in GRAMS:
            yield (h + np.uint64(n)) * _ODD, starts, np.maximum(ends - n + 1, starts)


def hits(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each distinct n-gram of a text whose bucket is marked in the table."""
    found = []
    for h, starts, ends in grams(texts):
        at = np.flatnonzero(table[h >> np.uint64(64 - BITS)])
        doc = np.searchsorted(starts, at, "right") - 1
        inside = at < ends[doc]
        found.append((doc[inside], h[at[inside]]))
    doc, key = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    return doc[first], key[first]


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashes of the chosen n-grams (ascending), their weights (ratio times coefficient), the intercept."""
    pos, neg = int(toxic.sum()), int((1 - toxic).sum())
    base = float(np.log((weight[toxic == 1].sum() + 1) / (weight[toxic == 0].sum() + 1)))
    none = np.zeros(0, np.uint64), np.zeros(0), float(np.log(PRESUMED / (1 - PRESUMED)))
    if not pos or not neg:
        return none

    def z(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mean = (a + b + 1) / (pos + neg + 2)
        return np.abs(a / pos - b / neg) / np.sqrt(mean * (1 - mean) * (1 / pos + 1 / neg))

    # Which buckets of n-grams tell the classes apart at all, then which n-grams in them.
    count = np.zeros((2, 1 << BITS), np.uint16 if len(texts) < 65536 else np.int32)
    for i, t in enumerate(texts):
        parts = [h[: e[0]] >> np.uint64(64 - BITS) for h, _, e in grams([t])]
        if parts:
            count[int(toxic[i]), np.unique(np.concatenate(parts))] += 1
    score = np.zeros(1 << BITS, np.float32)
    for lo in range(0, 1 << BITS, 1 << 18):
        some = count[:, lo : lo + (1 << 18)].astype(np.float64)
        score[lo : lo + (1 << 18)] = np.where(some.sum(0) >= MIN_DOCS, z(some[1], some[0]), 0)
    del count
    least = -np.partition(-score, 2 * FEATURES)[2 * FEATURES]
    table = score > max(least, 0)
    del score
    # Run by run, as all hits at once would take several times their size.
    docs, cols, keys = [], [], []
    for lo, hi in runs(texts, RUN_CHARS):
        d, k = hits(texts[lo:hi], table)
        k, col = np.unique(k, return_inverse=True)
        docs.append((d + lo).astype(np.int32))
        cols.append(col.astype(np.int32))
        keys.append(k)
    names = np.unique(np.concatenate(keys))
    a, b = np.zeros(len(names)), np.zeros(len(names))
    for i, d in enumerate(docs):
        cols[i] = np.searchsorted(names, keys[i]).astype(np.int32)[cols[i]]
        a += np.bincount(cols[i], toxic[d], len(names))
        b += np.bincount(cols[i], 1 - toxic[d], len(names))
    score = np.where(a + b >= MIN_DOCS, z(a, b), 0)
    kept = np.sort(np.argsort(-score, kind="stable")[:FEATURES])
    kept = kept[score[kept] > 0]
    if not len(kept):
        return none
    ratio = np.log((a[kept] + 1) / (pos + 2)) - np.log((b[kept] + 1) / (neg + 2))
    place = np.full(len(names), -1)
    place[kept] = np.arange(len(kept))
    for i, col in enumerate(cols):
        at = place[col]
        docs[i], cols[i] = docs[i][at >= 0], at[at >= 0].astype(np.int32)
    doc, col = np.concatenate(docs).astype(np.int64), np.concatenate(cols).astype(np.int64)
    del docs, cols, keys
    value = ratio[col]
    share = weight / weight.sum()
    w, c, vw, vc = np.zeros(len(kept)), base, np.zeros(len(kept)), 0.0
    gw2, gc2 = np.zeros(len(kept)), 0.0
    for step in range(1, STEPS + 1):  # Adam on the weighted, ridge-penalised log loss
        margin = np.bincount(doc, value * w[col], len(texts)) + c
        err = share * (1 / (1 + np.exp(-np.clip(margin, -35, 35))) - toxic)
        gw = np.bincount(col, value * err[doc], len(kept)) + RIDGE / len(kept) * w
        gc = err.sum()
        vw, vc = 0.9 * vw + 0.1 * gw, 0.9 * vc + 0.1 * gc
        gw2, gc2 = 0.999 * gw2 + 0.001 * gw * gw, 0.999 * gc2 + 0.001 * gc * gc
        lift, damp = 1 - 0.9**step, 1 - 0.999**step
        w = w - 0.02 * (vw / lift) / (np.sqrt(gw2 / damp) + 1e-9)
        c = c - 0.02 * (vc / lift) / (np.sqrt(gc2 / damp) + 1e-9)
    return names[kept], ratio * w, float(c)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray, float]:
    """Fit on at most `rows` labelled documents of each class. labels: doc_id, toxic (0 or 1).

    The sample meets in one task, as bounded; a model of at most FEATURES rows comes back."""
    once = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_toxic"))
    sizes = {r["_toxic"]: r["n"] for r in once.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = once.filter("_toxic = 1").orderBy(*by).limit(rows).unionByName(once.filter("_toxic = 0").orderBy(*by).limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.max(F.coalesce(F.col("text"), F.lit(""))).alias("text"), F.max("_toxic").alias("_toxic"))

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lean()
        got = list(batches)
        if not got:
            return
        all_ = pd.concat(got).sort_values("doc_id")
        y = all_["_toxic"].to_numpy(np.float64)
        weight = np.where(y == 1, sizes.get(1, 0) / max(1, (y == 1).sum()), sizes.get(0, 0) / max(1, (y == 0).sum()))
        key, w, c = fit(all_["text"].tolist(), y, weight)
        yield pd.DataFrame({"key": np.append(key.view(np.int64), 0), "w": np.append(w, c), "intercept": np.append(np.zeros(len(key), bool), True)})

    model = texts.repartition(1).mapInPandas(one, "key long, w double, intercept boolean").toPandas()
    terms = model[~model["intercept"]]
    c = model.loc[model["intercept"], "w"]
    return terms["key"].to_numpy(np.int64).view(np.uint64), terms["w"].to_numpy(), float(c.iloc[0]) if len(c) else float(np.log(PRESUMED / (1 - PRESUMED)))


def scorer(model: tuple[np.ndarray, np.ndarray, float]) -> Column:
    """The probability of being toxic, of column text."""
    keys, weights, c = model

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lean()
        table = np.zeros(1 << BITS, bool)
        table[keys >> np.uint64(64 - BITS)] = True
        for texts in batches:
            yield scores(texts, table)

    def scores(texts: pd.Series, table: np.ndarray) -> pd.Series:
        all_ = [t if t is not None else "" for t in texts]
        margin = np.full(len(all_), c)
        for a, b in runs(all_, RUN_CHARS):
            doc, key = hits(all_[a:b], table)
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            known = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            margin[a:b] += np.bincount(doc[known], weights[at[known]], b - a)
        return pd.Series(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    return F.pandas_udf(each, "double")("text")


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], out: str = "score") -> DataFrame:
    """docs with the probability of being toxic in column `out`, in place of a column of that name."""
    return docs.withColumn(out, scorer(model))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those scored at or above the threshold."""
    return docs.filter(scorer(train(docs, labels)) < threshold)
