"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source.

Each text's statistics become a vector: log mean word length, and the shares of signs that are neither letters nor
digits, of capitals and of vowels, as angles (arcsine of the root). A short text's shares are shrunk to its
language's medians by PSEUDO words, so that all lengths spread alike. For each language and source, each language
and all rows the estimate is the mean and covariance of the fraction H of rows whose covariance has the least
determinant. Three starts are tried (medians with absolute deviations; the correlation of bounded values; the spatial
signs); from each, concentration steps (the H rows nearest to the current estimate give the next) run until the
determinant falls no more, and the start that ends with the least one counts. A step is two aggregations over all rows of all
groups, merged before the shuffle; only sums per group travel. Equal texts of a source count once, so copies
cannot make it narrow. A group's estimate is then shrunk to that of its language, and a language's to that of all
rows, by PRIOR rows, and a source is at most as narrow as NARROW of its language's variance in any direction. A document is rejected when its squared Mahalanobis distance passes the
chi-squared quantile of TAIL.

Defined cases: null text has no words and fails the base rules; null language and source are values of their own;
very long texts are measured whole; constant statistics get variance from the levels above, at last from ROOT;
a distance equal to the cutoff is kept; repeated rows are judged alike; an empty table gives no rows; extra columns,
whatever their names, are ignored by `judge` and kept by `keep_regular`.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, cut, lean, small

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Part of a group's rows that the estimate rests on; steps at most, and the fall of the log determinant that still counts.
H, STEPS, FALL = 0.75, 20, 1e-4
#: Words of its language's median text that each text is mixed with.
PSEUDO = 60
#: Rows that the level above counts as, and the standard deviation of each part at the last.
PRIOR, ROOT = 40, 0.05
#: Least variance of a source in any direction, as a part of its language's.
NARROW = 0.25
#: Chance of a clean document to be rejected, were the vectors normal.
TAIL = 1e-12
D = 4
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_signs long, n_upper long, n_vowels long"
_MIX = np.random.default_rng(7).integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)


def repeat_words(words: list) -> int:
    """Words in windows of five words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.uint64, count=len(words))
    m = np.uint64(len(number))
    if len(number) < 6000:  # the windows' numbers are exact
        key = ids[:n].copy()
        for i in range(1, WINDOW):
            key = key * m + ids[i : i + n]
    else:
        key = sum((ids[i : i + n] + np.uint64(1)) * _MIX[i] for i in range(WINDOW))
        key ^= (key >> np.uint64(29)) * _MIX[0]
    order = np.argsort(key, kind="stable")
    sorted_ = key[order]
    same = sorted_[1:] == sorted_[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    edge = np.zeros(len(words) + 1, np.int32)
    edge[at] += 1
    edge[at + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


@lru_cache(100_000)
def kinds(code: int) -> tuple[bool, bool, bool]:
    """Whether a character is a letter or digit, a capital, a vowel (accents apart)."""
    c = chr(code)
    return c.isalnum(), c != c.lower(), unicodedata.normalize("NFD", c.lower())[0] in "aeiouy"


def measure(text: str | None) -> tuple[int, ...]:
    if not text:
        return (0,) * 8
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at exactly space, tab, LF, VT, FF and CR
    blank = sum(text.count(c) for c in " \t\n\v\f\r")
    dup, seen = 0, set()
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\v\f\r"):
                if line in seen:
                    dup += 1
                seen.add(line)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if codes.max() < 0x3000:
        counts = np.bincount(codes)
        each = np.flatnonzero(counts)
        counts = counts[each]
    else:
        each, counts = np.unique(codes, return_counts=True)
    alnum, upper, vowels = (np.array([kinds(c) for c in each.tolist()], np.int64).T @ counts).tolist()
    return len(words), len(text) - blank, sum(text.count(c) for c in SYMBOLS), dup, repeat_words(words), len(text) - blank - alnum, upper, vowels


def measured(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    lean()
    for some in texts:
        yield pd.DataFrame([measure(t) for t in some], columns=[c.split()[0] for c in STATS.split(", ")], dtype="int64")


X = [f"x{i}" for i in range(D)]
def vector() -> list[Column]:
    """The parts of the vector, of the counts and the language's medians."""
    alnum = F.col("word_chars") - F.col("n_signs")

    def angle(k: Column, of: Column, share: str, a_word: str) -> Column:
        p = (k + PSEUDO * F.col(a_word) * F.col(share)) / (of + PSEUDO * F.col(a_word))
        return F.asin(F.sqrt(F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))))

    return [
        F.log((F.col("word_chars") + PSEUDO * F.col("c_chars")) / (F.col("n_words") + PSEUDO)),
        angle(F.col("n_signs"), F.col("word_chars"), "c_signs", "c_chars"),
        angle(F.col("n_upper"), alnum, "c_upper", "c_alnum"),
        angle(F.col("n_vowels"), alnum, "c_vowels", "c_alnum"),
    ]


CENTRES = ["c_chars", "c_alnum", "c_signs", "c_upper", "c_vowels"]


def centres(rows: DataFrame) -> DataFrame:
    """The medians of each language (of, CENTRES), of rows that pass the base rules."""
    words, chars, alnum = F.col("n_words"), F.col("word_chars"), F.greatest(F.col("word_chars") - F.col("n_signs"), F.lit(1))
    of = [chars / words, alnum / words, F.col("n_signs") / chars, F.col("n_upper") / alnum, F.col("n_vowels") / alnum]
    return small(cut(rows.groupBy("of").agg(*[F.percentile_approx(v, 0.5, 1000).alias(c) for c, v in zip(CENTRES, of, strict=True)])))


def distance() -> Column:
    """Squared Mahalanobis distance to `mean`; `whiten` holds the rows of the inverse Cholesky factor, lower triangle."""
    off = [F.col(x) - F.element_at("mean", i + 1) for i, x in enumerate(X)]
    k, total = 0, F.lit(0.0)
    for i in range(D):
        part = F.lit(0.0)
        for j in range(i + 1):
            k += 1
            part = part + F.element_at("whiten", k) * off[j]
        total = total + part * part
    return total


def full(low: np.ndarray) -> np.ndarray:
    """The symmetric matrix of a lower triangle."""
    out = np.zeros((D, D))
    out[np.tril_indices(D)] = low
    return out + np.tril(out, -1).T


def whitening(cov: np.ndarray) -> list[float]:
    """The inverse Cholesky factor, with the variance of numeric noise added."""
    return np.linalg.inv(np.linalg.cholesky(cov + np.eye(D) * max(1e-12, 1e-9 * np.trace(cov))))[np.tril_indices(D)].tolist()


MODEL = "group string, start int, n long, mean array<double>, cov array<double>, whiten array<double>, size double"


def started(sums: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Three starts of each group from its medians, deviations and the sums of bounded values and of spatial signs."""
    for batch in sums:
        out = []
        for r in batch.itertuples(index=False):
            sd = np.diag(np.asarray(r.sd))
            bounded = full(np.asarray(r.tq) / r.n) - np.outer(r.ts, r.ts) / r.n**2
            spread = np.sqrt(np.diag(bounded) + 1e-9)
            for k, shape in enumerate((np.eye(D), bounded / np.outer(spread, spread) + 1e-6 * np.eye(D), D * full(np.asarray(r.uq) / r.n) + 1e-6 * np.eye(D))):
                out.append((r.group, k, r.n, list(r.mean), (sd @ shape @ sd)[np.tril_indices(D)].tolist(), whitening(sd @ shape @ sd), math.inf))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])


def concentrated(sums: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and covariance of the nearest rows of each group and start, and the log determinant (size)."""
    for batch in sums:
        out = []
        for r in batch.itertuples(index=False):
            mean = np.asarray(r.s) / r.n
            cov = full(np.asarray(r.q) / r.n) - np.outer(mean, mean)
            cov[np.diag_indices(D)] = np.maximum(np.diag(cov), 0)
            values, axes = np.linalg.eigh(cov)
            cov = axes @ np.diag(np.maximum(values, 0)) @ axes.T
            out.append((r.group, r.start, r.n, mean.tolist(), cov[np.tril_indices(D)].tolist(), whitening(cov), float(np.log(np.maximum(values, 1e-12)).sum())))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MODEL.split(", ")])


def products(x: list[Column]) -> Column:
    return F.array(*[F.sum(x[i] * x[j]) for i in range(D) for j in range(i + 1)])


def determinants(rows: DataFrame) -> DataFrame:
    """rows: group, x0...; gives group, n, mean, cov of the estimate of least determinant."""
    few = lambda df: small(cut(df))
    median = few(rows.groupBy("group").agg(F.array(*[F.percentile_approx(x, 0.5, 1000) for x in X]).alias("mean")))
    off = [F.col(x) - F.element_at("mean", i + 1) for i, x in enumerate(X)]
    spread = few(rows.join(median, "group").groupBy("group").agg(F.first("mean").alias("mean"), F.array(*[F.percentile_approx(F.abs(o), 0.5, 1000) * 1.4826 + 1e-6 for o in off]).alias("sd")))
    z = [o / F.element_at("sd", i + 1) for i, o in enumerate(off)]
    norm = F.sqrt(sum((v * v for v in z), F.lit(1e-18)))
    t, u = [F.tanh(v) for v in z], [v / norm for v in z]
    sums = rows.join(spread, "group").groupBy("group").agg(F.count("*").alias("n"), F.first("mean").alias("mean"), F.first("sd").alias("sd"), F.array(*[F.sum(v) for v in t]).alias("ts"), products(t).alias("tq"), products(u).alias("uq"))
    now = few(sums.mapInPandas(started, MODEL))
    done = None
    for _ in range(STEPS):
        at = rows.join(now.select("group", "start", "mean", "whiten"), "group").select("group", "start", *X, distance().alias("d"))
        most = few(at.groupBy("group", "start").agg(F.percentile_approx("d", H, 1000).alias("most")))
        near = at.join(most, ["group", "start"]).filter("d <= most").groupBy("group", "start").agg(F.count("*").alias("n"), F.array(*[F.sum(x) for x in X]).alias("s"), products([F.col(x) for x in X]).alias("q"))
        then = near.mapInPandas(concentrated, MODEL).join(now.select("group", "start", F.col("size").alias("before")), ["group", "start"])
        then = cut(then)
        ended = then.filter(F.col("size") > F.col("before") - FALL).drop("before")
        done = ended if done is None else done.unionByName(ended)
        going = then.filter(F.col("size") <= F.col("before") - FALL).drop("before")
        if going.isEmpty():
            break
        now = small(going)
    else:
        done = done.unionByName(going)
    return cut(done.groupBy("group").agg(F.min_by(F.struct("n", "mean", "cov"), F.struct("size", "start")).alias("r")).select("group", "r.*"))


def chi2(x: float, d: int) -> float:
    """The chi-squared distribution's upper tail for an even number of degrees."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(d // 2))


def quantile(tail: float, d: int = D) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        lo, hi = ((lo + hi) / 2, hi) if chi2((lo + hi) / 2, d) > tail else (lo, (lo + hi) / 2)
    return lo


#: What makes the covariance of the nearest H of normal rows that of all of them.
WIDEN = H / (1 - chi2(quantile(1 - H), D + 2))


def blended(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """pair, mean, whiten: each estimate shrunk to the level above, a source's kept from being much narrower than its language."""

    def shrunk(n: float, mean: list, cov: list, mean0: np.ndarray, cov0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (n * np.asarray(mean) + PRIOR * mean0) / (n + PRIOR), (n * full(np.asarray(cov)) * WIDEN + PRIOR * cov0) / (n + PRIOR)

    for batch in batches:
        means, factors = [], []
        for r in batch.itertuples(index=False):
            m0, c0 = shrunk(r.n0, r.mean0, r.cov0, np.asarray(r.mean0), np.eye(D) * ROOT**2)
            m1, c1 = shrunk(r.n1, r.mean1, r.cov1, m0, c0)
            m2, c2 = shrunk(r.n2, r.mean2, r.cov2, m1, c1)
            root = np.linalg.cholesky(c1)
            back = np.linalg.inv(root)
            values, axes = np.linalg.eigh(back @ c2 @ back.T)
            c2 = root @ axes @ np.diag(np.maximum(values, NARROW)) @ axes.T @ root.T
            means.append(m2.tolist())
            factors.append(whitening(c2))
        yield pd.DataFrame({"pair": batch["pair"], "of": batch["of"], "mean": means, "whiten": factors})


def statistics(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """doc_id, lang, source, the counts, mark (of the text) and base_failed of every row; `row` is carried as row."""
    more = [] if row is None else [row.alias("row")]
    # Called deterministic, it would be planned twice where rows are filtered by it: two calls, and two Python workers, for each task.
    each = F.pandas_udf(measured, STATS).asNondeterministic()
    stats = docs.select("doc_id", "lang", "source", each("text").alias("m"), F.xxhash64("text").alias("mark"), *more)
    stats = stats.select("doc_id", "lang", "source", "m.*", "mark", *["row" for _ in more])
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select("*", failed.alias("base_failed"))


def fit(rows: DataFrame) -> DataFrame:
    """The estimate that holds for each language and source: pair, mean, whiten, CENTRES. rows: written statistics."""
    rows = rows.filter("not base_failed").withColumn("pair", pair()).withColumn("of", F.to_json(F.struct("lang")))
    middle = centres(rows)
    vectors = rows.join(middle, "of").select("pair", "of", "mark", *[v.alias(x) for v, x in zip(vector(), X, strict=True)]).dropDuplicates(["pair", "mark"])
    levels = F.explode(F.array(F.concat(F.lit("2"), "pair"), F.concat(F.lit("1"), "of"), F.lit("0")))
    each = cut(vectors.select("pair", "of", *X))
    best = determinants(each.select(levels.alias("group"), *X))
    at = lambda k: small(best.select("group", *[F.col(c).alias(f"{c}{k}") for c in ("n", "mean", "cov")])).withColumnRenamed("group", f"group{k}")
    pairs = each.select("pair", "of").distinct().select("*", F.concat(F.lit("2"), "pair").alias("group2"), F.concat(F.lit("1"), "of").alias("group1"), F.lit("0").alias("group0"))
    for k in range(3):
        pairs = pairs.join(at(k), f"group{k}")
    return cut(pairs.mapInPandas(blended, "pair string, of string, mean array<double>, whiten array<double>").join(middle, "of").drop("of"))


def pair() -> Column:
    return F.to_json(F.struct("lang", "source"))


def decide(rows: DataFrame, model: DataFrame, tail: float = TAIL) -> DataFrame:
    """rows with distance (null where the base rules fail) and kept."""
    both = rows.withColumn("pair", pair()).join(small(model), "pair", "left")
    both = both.select("*", *[v.alias(x) for v, x in zip(vector(), X, strict=True)])
    d = F.when(~F.col("base_failed"), distance())
    return both.withColumn("distance", d).withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= quantile(tail)))


def judge(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """Statistics, base_failed, distance and kept for every row of docs."""
    rows = cut(statistics(docs))
    return decide(rows, fit(rows), tail).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def keep_regular(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """docs without those that the rules reject. The statistics are measured again, so that no text is written or moved."""
    model = fit(cut(statistics(docs)))
    return decide(statistics(docs, F.struct(*columns(docs))), model, tail).filter("kept").select("row.*")
