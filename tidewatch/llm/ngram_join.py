"""Near copies: an exact Jaccard self-join on sets of word 5-grams, and the groups that its links form.

Texts with the same set count as one. Two sets can only reach the threshold if they share a token among the first
n - ceil(t n) + 1 of each in any common order; the order here is by hash, with the corpus's most frequent tokens
last, so that passages which many documents share bring nobody together. The order decides cost alone, never the
result. Tokens that exactly the same sets show bring the same pairs together, so one of them stands for all (a
passage that two documents share is one token then, not forty). What shares such a token meets in two steps:

1. Each token has a leader, the set that shares the largest part of its prefix with others (an original rather than
   one of its edited copies); every set that has enough tokens with one leader is compared with it.
2. Where the sets of a token still belong to different groups, the rest meet in tiles of (token, size band): a
   band is a factor t ** -SPAN of sizes, and a set looks into the one or two bands that sizes from t n to n / t
   fall into. Hashed bitmap signatures bound a pair's overlap from above, (n + m - differing bits) / 2, inside the
   join; only pairs that pass leave it, and of those only pairs with enough tokens in common are compared.

What is enough follows from the order: past the end of the prefix that ends first, sets of n and m tokens share at most
max(ceil(t n), ceil(t m)) - 1 tokens, so a link's prefixes share the rest of what it needs.

Comparison is the exact intersection of the sorted hash arrays. Pairs of one group are never listed: copies of one
text link to their leader, so a group of any size costs as many comparisons as it has members; the pairs of a leader
that has many are dealt out, its set going along with each part. Groups are found by alternating large and small
stars over the links.

Defined cases: null texts and texts without words have size 0 and link with nothing; fewer words than five are one
shingle; very long texts have sets of their size, nothing is cut, and signatures that bound less; repeated rows and equal texts share
a group; ties cannot arise, as the smallest doc_id names a group; null doc_ids rank below all others; an empty table
gives no rows; extra columns are ignored by `groups` and kept by `keep_first`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import columns, cut, fresh, lean, small

WORDS = 5
PERCENT = 80
#: Tokens that many documents of a task share are counted; the most frequent HOT of them come last in the order.
LOCAL, HOT = 2, 500_000
#: Tokens of a task are counted when so many have gathered.
GATHERED = 1_000_000
#: 64-bit words of a bitmap signature.
LONGS = 32
#: Pairs of one set that meet in one task at most, about: with more, they are dealt out.
SPREAD = 200
#: A size band spans this many times the factor of sizes that can link.
SPAN = 4
#: Ids of documents to compare may be broadcast up to this many.
IDS = 1_000_000
LOWEST = -(2**63)
SLICE = 1000
_MIX = np.random.default_rng(11).integers(1, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_SEEN = Hashes()


def forget() -> None:
    _SEEN.clear()


def shingles(text: str | None, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text; words are lower-cased A-Z and split at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_SEEN) > 60_000:
        _SEEN.clear()
    h = np.fromiter(map(_SEEN.__getitem__, words), np.uint64, len(words))
    m = min(k, len(h))
    key = np.full(len(h) - m + 1, m, np.uint64)
    for i in range(m):
        x = h[i : len(h) - m + 1 + i] * _MIX[i]
        key += x ^ (x >> np.uint64(32))
    key *= _ODD
    key ^= key >> np.uint64(29)
    return np.unique(key * _MIX[0])


def name_of(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63


def frequent(docs: DataFrame, k: int = WORDS) -> np.ndarray:
    """The most frequent shingles over all documents (different texts of a task counted once), rarest first."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        sets: dict[int, np.ndarray] = {}
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal total
            token, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
            sets.clear()
            total = 0
            return pa.RecordBatch.from_arrays([pa.array(token[n >= LOCAL].view(np.int64)), pa.array(n[n >= LOCAL])], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                s = shingles(text, k)
                if (name := name_of(s)) not in sets:
                    sets[name] = s
                    total += len(s)
                if total >= GATHERED:
                    yield flush()
        if sets:
            yield flush()

    top = docs.select("text").mapInArrow(counted, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(HOT)
    got = top.select("token").toPandas()["token"].to_numpy(np.int64)
    return got.view(np.uint64)[::-1].copy()


def need(n: int) -> int:
    """Least overlap that a set of n tokens has with any set that it links to."""
    return -(-PERCENT * n // 100)


def prefixes(docs: DataFrame, hot: np.ndarray, k: int = WORDS) -> DataFrame:
    """doc_id, mark, part (the task), n, name (of the set), and of the first such set in its task prefix and sig (else null)."""
    order = np.argsort(hot)
    hot_key = hot[order]

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen: set[int] = set()
        part = TaskContext.get().partitionId()
        marked = np.zeros(1 << 22, bool)
        marked[hot_key >> np.uint64(42)] = True
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                some = batch.slice(lo, SLICE)
                sizes, names, firsts, sigs = [], [], [], []
                for text in some.column(1).to_pylist():
                    s = shingles(text, k)
                    name, n = name_of(s), len(s)
                    sizes.append(n)
                    names.append(name)
                    if not n or name in seen:
                        firsts.append(s[:0])
                        sigs.append(None)
                        continue
                    seen.add(name)
                    sigs.append(bitmap(s))
                    last = np.flatnonzero(marked[s >> np.uint64(42)])
                    if len(last):
                        at = np.minimum(np.searchsorted(hot_key, s[last]), len(hot_key) - 1)
                        known = hot_key[at] == s[last]
                        last, at = last[known], at[known]
                        cold = np.ones(n, bool)
                        cold[last] = False
                        s = np.concatenate([s[cold], s[last[np.argsort(order[at])]]])
                    firsts.append(s[: n - need(n) + 1])
                flat = np.concatenate(firsts) if firsts else np.zeros(0, np.uint64)
                ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))
                columns = [some.column(0), some.column(2), pa.array([part] * len(names), pa.int32()), pa.array(sizes, pa.int32()), pa.array(names, pa.int64()), prefix, pa.array(sigs, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "mark", "part", "n", "name", "prefix", "sig"])

    return docs.select("doc_id", "text", mark_of().alias("mark")).mapInArrow(listed, "doc_id long, mark long, part int, n int, name long, prefix array<long>, sig array<long>")


def bitmap(s: np.ndarray) -> np.ndarray:
    out = np.zeros(LONGS * 64, np.uint8)
    out[(s >> np.uint64(20)) % np.uint64(LONGS * 64)] = 1
    return np.packbits(out).view(np.int64)


B = [f"b{i}" for i in range(LONGS)]


def arrays(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """name and tokens (sorted) of the sets of docs, each set once for each task that meets it."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                sets = {}
                for text in batch.column(0).slice(lo, SLICE).to_pylist():
                    s = shingles(text, k)
                    if (name := name_of(s)) not in seen:
                        sets[name] = s.view(np.int64)
                seen.update(sets)
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.list_(pa.int64()))], names=["name", "tokens"])

    return docs.select("text").mapInArrow(built, "name long, tokens array<long>")


def sized(n: Column, m: Column) -> Column:
    return (F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT)


def may_link(x: str, y: str) -> Column:
    """Whether sets x and y can reach the threshold, by their sizes and the differing bits of their signatures."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in B), F.lit(0))
    # overlap <= (n + m - differ) / 2, and a link needs 100 overlap >= PERCENT (n + m - overlap)
    return sized(n, m) & ((n + m - differ) * (100 + PERCENT) >= 2 * PERCENT * (n + m))


def enough(n: Column, m: Column, shared: Column) -> Column:
    """Whether sets of n and m tokens whose prefixes share so many tokens can link."""
    need = lambda size: F.ceil(PERCENT * size / 100)
    return shared >= F.ceil(PERCENT * (n + m) / (100 + PERCENT)) - F.greatest(need(n), need(m)) + 1


def hot_names(pairs: DataFrame) -> DataFrame:
    """The names b of more than SPREAD pairs (a, b), with the number of parts that their pairs are dealt into."""
    many = pairs.groupBy(F.col("b").alias("name")).agg(F.count("*").alias("n")).filter(F.col("n") > SPREAD)
    return cut(many.select("name", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts")))


def with_both(pairs: DataFrame, side: DataFrame, hot: DataFrame, column: str) -> DataFrame:
    """pairs (a, b) with x and y, `column` of both sets from side (name, `column`). The pairs of a hot b are dealt into parts
    by a, and b's row goes to each."""
    hot = small(hot)
    left = pairs.join(hot.withColumnRenamed("name", "b"), "b", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts").cast("long")), F.lit(0).cast("long")).alias("part"))
    left = left.join(side.select(F.col("name").alias("a"), F.col(column).alias("x")), "a")
    right = side.select("name", column).join(hot, "name", "left").select(F.col("name").alias("b"), F.col(column).alias("y"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("parts"), F.lit(1)).cast("long") - 1)).alias("part"))
    return left.join(right, ["b", "part"]).select("a", "b", "x", "y")


def verified(pairs: DataFrame, hot: DataFrame, docs: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection. first: the document that shows each set (name, doc_id)."""
    names = cut(pairs.select(F.explode(F.array("a", "b")).alias("name")).distinct())
    ids = cut(names.join(first, "name").select("doc_id"))
    tokens = arrays(docs.join(small(ids, IDS), "doc_id", "left_semi"), k)
    tokens = cut(tokens.join(small(names, IDS), "name", "left_semi"))
    shared = F.size(F.array_intersect("x", "y"))
    links = with_both(pairs, tokens, hot, "tokens").filter(shared * (100 + PERCENT) >= PERCENT * (F.size("x") + F.size("y")))
    return cut(links.select("a", "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """name, root (the smallest name reachable) for every name in links (a, b): alternating large and small stars."""
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    now = state(edges)
    while now[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(least, "u")
        edges_next = cut(star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        then = state(edges_next)
        edges = edges_next
        if then == now:
            break
        now = then
    return edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "name")


def joined(comp: DataFrame, more: DataFrame) -> DataFrame:
    """comp (name, root) with more links (a, b): groups are nodes now, so only what the new links touch goes through rounds again."""
    root = lambda c: comp.select(F.col("name").alias(c), F.col("root").alias(f"{c}_root"))
    ends = more.join(root("a"), "a", "left").join(root("b"), "b", "left")
    over = cut(components(ends.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))))
    old = comp.join(over.select(F.col("name").alias("root"), F.col("root").alias("top")), "root", "left").select("name", F.coalesce("top", "root").alias("root"))
    return cut(old.unionByName(over.join(comp.select("name").distinct(), "name", "left_anti")))


def number(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LOWEST))


def mark_of() -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def owners(sets: DataFrame) -> DataFrame:
    """One row for each set: of the tasks that met it, the first's."""
    shown = sets.filter("sig is not null").select("name", "part", "n", "prefix", "sig")
    tasks = shown.groupBy("name").agg(F.min("part").alias("own"), F.count("*").alias("c")).filter("c > 1")
    later = cut(shown.select("name", "part").join(tasks, "name").filter("part > own").select("name", "part"))
    return shown.join(small(later), ["name", "part"], "left_anti")


def shared_tokens(sets: DataFrame) -> DataFrame:
    """token, times, name, n, and score for the tokens that different sets show; of tokens that the same sets show, one,
    and how many they are (times).

    score: the part of the set's prefix that it shares with others."""
    tokens = sets.select("name", "n", F.size("prefix").alias("p"), F.explode("prefix").alias("token"))
    same = tokens.groupBy("token").agg(F.count("*").cast("int").alias("c"), F.bit_xor(F.xxhash64("name")).alias("x")).filter("c > 1")
    kept = cut(same.groupBy("c", "x").agg(F.min("token").alias("token"), F.count("*").alias("times")).select("token", "times"))
    shared = cut(tokens.join(small(kept), "token"))
    score = shared.groupBy("name", "p").agg(F.sum("times").alias("c")).select("name", (F.col("c") / F.col("p")).alias("score"))
    return shared.join(score, "name").select("token", "times", "name", "n", "score")


def linked(docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The set of every row of docs (doc_id, mark, n, name), and name and root of the sets that link."""
    docs = docs.select(number(docs).alias("doc_id"), "text")
    sets = cut(prefixes(docs, frequent(docs, k), k))
    first = sets.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    shown = owners(sets)
    shared = cut(shared_tokens(shown))

    # Every set with its tokens' leaders.
    lead = shared.groupBy("token").agg(F.max_by(F.struct(F.col("name").alias("leader"), F.col("n").alias("m")), F.struct("score", "name")).alias("l")).select("token", "l.*")
    shared = cut(shared.join(lead, "token").select("token", "times", "name", "n", "leader", "m"))
    n, m = F.col("n"), F.col("m")
    met = shared.filter((F.col("name") != F.col("leader")) & sized(n, m)).groupBy(F.col("name").alias("a"), F.col("leader").alias("b"), "n", "m")
    pairs = cut(met.agg(F.sum("times").alias("c")).filter(enough(n, m, F.col("c"))).select("a", "b"))
    links = verified(pairs, hot_names(pairs), docs, first, k)
    comp = cut(components(links))

    # Tokens whose sets are still in different groups: what is not in the leader's group meets the others.
    inside = shared.join(comp, "name", "left").select("token", "times", "name", "n", F.coalesce("root", "name").alias("group"))
    leaders = shared.select("leader").distinct().join(comp.select(F.col("name").alias("leader"), "root"), "leader", "left").select("leader", F.coalesce("root", "leader").alias("home"))
    homes = lead.join(leaders, "leader").select("token", "home")
    kinds = small(cut(inside.groupBy("token").agg(F.min("group").alias("g0"), F.max("group").alias("g1")).filter("g0 < g1").join(homes, "token").select("token", "home")))
    open_ = cut(inside.join(kinds, "token").select("token", "times", "name", "n", "group", "home"))
    if open_.isEmpty():
        return sets.select("doc_id", "mark", "n", "name"), comp
    bits = cut(shown.join(open_.select("name").distinct(), "name", "left_semi").select("name", *[F.get("sig", F.lit(i)).alias(b) for i, b in enumerate(B)]))
    full = open_.join(bits, "name")
    band = lambda size: F.floor(F.log(size) / (SPAN * math.log(100 / PERCENT)) + 1e-9).cast("int")
    y = full.withColumn("band", band(F.col("n"))).alias("y")
    x = full.filter(F.col("group") != F.col("home")).withColumn("band", F.explode(F.sequence(band(F.col("n") * PERCENT / 100 * 0.999), band(F.col("n") * 100 / PERCENT * 1.001)))).alias("x")
    n, m = F.col("x.n"), F.col("y.n")
    meets = (
        (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.group") != F.col("y.group"))
        & ((F.col("y.group") == F.col("y.home")) | (F.col("x.name") < F.col("y.name")))
        & may_link("x", "y")
    )
    found = x.join(y, meets).groupBy(F.col("x.name").alias("a"), F.col("y.name").alias("b"), n.alias("n"), m.alias("m")).agg(F.sum("x.times").alias("c"))
    rest = cut(found.filter(enough(F.col("n"), F.col("m"), F.col("c"))).select("a", "b"))
    if not rest.isEmpty():
        more = verified(rest, hot_names(rest), docs, first, k)
        if not more.isEmpty():
            comp = joined(comp, more)

    return sets.select("doc_id", "mark", "n", "name"), comp


def groups(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of docs."""
    sets, comp = linked(docs, k)
    first = sets.filter("n > 0").groupBy("name").agg(F.min("doc_id").alias("doc_id"))
    roots = first.join(comp, "name", "left").select("name", "doc_id", F.coalesce("root", "name").alias("root"))
    label = roots.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(label, "root").select("name", "component_id")
    null = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    out = sets.select("doc_id", "n", "name").join(named, "name", "left")
    return out.select(null("doc_id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn("component_id", null("component_id"))


def keep_first(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """docs with one row of each group, and all rows without words.

    The row of a group is that of the smallest doc_id; where rows of the group share it, of the smallest set name and
    mark; of rows with one text too, the one whose other columns sort first. Rows of different groups may share a doc_id."""
    sets, comp = linked(docs, k)
    texts = sets.filter("n > 0").groupBy("name", "doc_id", "mark").agg(F.count("*").alias("of"))
    least = texts.groupBy("name").agg(F.min(F.struct("doc_id", "mark", "of")).alias("r")).join(comp, "name", "left")
    ruled = F.min(F.struct("r.doc_id", "name", "r.mark", "r.of")).alias("r")
    heads = least.groupBy(F.coalesce("root", "name").alias("root")).agg(ruled).select("r.doc_id", "r.mark", "r.of")
    at, mark = fresh(docs, "at"), fresh(docs, "mark")
    kept = cut(heads.unionByName(sets.filter("n = 0").select("doc_id", "mark", F.lit(1).cast("long").alias("of")).distinct()).withColumnsRenamed({"doc_id": at, "mark": mark}))
    rows = docs.select("*", number(docs).alias(at), mark_of().alias(mark))
    once = kept.filter("of = 1").select(at, mark)
    out = rows.join(small(once, IDS), [at, mark], "left_semi").select(*columns(docs))
    more = kept.filter("of > 1").select(at, mark)
    if not more.isEmpty():
        order = F.struct("text", *[F.to_json(F.struct(c)) for c, name in zip(columns(docs), docs.columns, strict=True) if name not in ("doc_id", "text")])
        same = rows.join(small(more, IDS), [at, mark], "left_semi").groupBy(at, mark)
        out = out.unionByName(same.agg(F.min_by(F.struct(*columns(docs)), order).alias("r")).select("r.*"))
    return out
