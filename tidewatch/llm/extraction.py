"""Main text of HTML pages by maximum-scoring subsequence.

A page becomes a sequence of tags and words. Every word and tag has a score, and the contiguous run of greatest
total score is the content region; one linear scan finds it. Scores are log odds of lying inside the content,
learnt from labelled pages: pages whose markup names the region itself (an article or main element). A word's
score depends on the kinds (element name and first class word) of the blocks around it: the block it stands in, with
the element's name alone where the kind was never seen, and the worst of the blocks around that; a tag's on its own
kind. At most SAMPLE labelled pages are read for this. What was seen weighs against a prior of PRIOR words: kinds that
the lists NEVER and NAMES call boilerplate, or that are hidden, start at -BOUND, others positive for words, negative for tags. So
the lists speak only where the labelled pages don't. Whether an article or main element is around is what the scores are learnt from,
never a score. For the region a word counts zero at least, so an advert between paragraphs costs its tags, however long it is. What
lies inside the region and is not of it is found by a second scan, over the region's blocks with all scores: it leaves out the
runs of blocks that lose least, where each run costs SWITCH.

The text: character references decoded, white space inside a block made one space, trimmed, blocks joined by one
space. Defined cases: null or empty html gives empty text; text without any tag is content; very long pages are read
whole; of runs of equal score the first counts; unclosed elements end with their parents; repeated rows are extracted
each; pages without a positive run give empty text; an empty table gives no rows; extra columns pass through, but
for one named text, which is replaced.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import lean

#: Labelled pages that the scores are learnt from at most (those of the smallest hash of page_id).
SAMPLE = 2000
WORD, TAG = 1.0, -0.5
#: Log odds are kept within this; a kind counts PRIOR pseudo-observations at its prior score.
BOUND, PRIOR = 3.0, 20.0
#: What an element's name says of a kind never seen counts so much.
NAME = 0.5
#: What it costs to leave out a run of blocks: the prior of a tag.
SWITCH = -TAG

#: Elements by role.
CONTENT = {"article", "main"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "select", "audio", "video"}
NEVER = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "label", "input", "fieldset"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "ruby", "rt", "rp", "img", "nobr"}
#: Words of class, id or role that name what is not the article.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent", "cookie", "cookies", "discussion", "disqus", "footer", "form", "gdpr", "header", "login",
    "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "pagination", "pager", "popup", "privacy", "promo", "promoted", "promotion", "related", "replies", "reply", "respond", "search",
    "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "contentinfo", "complementary", "alert", "warning",
}

PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>", re.S)
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)


def kind_of(name: str, attributes: str) -> str:
    """Name and first class word of a start tag, after "!" if a list calls it boilerplate."""
    words: list[str] = []
    if "=" in attributes:
        for value in NAMED.findall(attributes):
            words += [w for w in SPLIT.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", html.unescape(value.strip("\"'"))).lower()) if w]
    listed = name in NEVER or (name not in CONTENT and name not in ("body", "html") and not NAMES.isdisjoint(words)) or (" hidden" in attributes or "none" in attributes or "aria-hidden" in attributes) and bool(HIDDEN.search(attributes))
    return "!" * bool(listed) + name + ("." + words[0] if words else "")


#: The blocks around a text: kinds from the outermost to the nearest, after the last that names the content or the
#: body; whether the text is in a link.
Around = tuple[tuple[str, ...], bool]


def parts(page: str) -> Iterator[tuple[str, str | Around, str, bool, bool]]:
    """(what, kind, text, breaks, inside): tags (what = tag) and stretches of text (what = text, kind = the blocks around it)
    in page order. breaks: a block starts or ends; inside: in an article or main element,
    which is what the scores are learnt from; extraction doesn't look at it."""
    stack: list[tuple[str, str]] = []

    def around() -> Around:
        from_ = next((i + 1 for i in range(len(stack) - 1, -1, -1) if stack[i][0] in CONTENT or stack[i][0] in ("body", "html")), 0)
        return tuple(k for n, k in stack[from_:] if n not in INLINE), any(n == "a" for n, _ in stack[-4:])

    def inside() -> bool:
        return any(n in CONTENT for n, _ in stack)

    at = 0
    for m in PARTS.finditer(page):
        if m.start() < at:
            continue
        slash, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if m.start() > at:
            yield "text", around(), page[at : m.start()], False, inside()
        at = m.end()
        if not name:  # comments, declarations
            continue
        name = name.lower()
        if slash:
            if any(n == name for n, _ in stack):
                while stack.pop()[0] != name:
                    pass
            yield "tag", "/" + name, "", name not in INLINE, inside()
            continue
        kind = kind_of(name, attributes or "")
        if name in RAW and not (attributes or "").rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "tag", kind, "", name not in INLINE, inside()
            continue
        if name == "p":  # a paragraph ends the one before it
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE:
                    break
        if name == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        if name == "body":
            stack.clear()
        if name not in VOID and not (attributes or "").rstrip().endswith("/"):
            stack.append((name, kind))
        yield "tag", kind, "", name not in INLINE, inside()
    if at < len(page):
        rest = page[at:]
        cut = re.search(r"<[/a-zA-Z!?][^<>]*\Z", rest)  # a tag cut off by the end of the page
        yield "text", around(), rest[: cut.start()] if cut else rest, False, inside()


def nearest(blocks: tuple[str, ...], link: bool) -> str:
    return (blocks[-1] if blocks else "") + ("/a" if link else "")


def name_of(kind: str) -> str:
    return re.split(r"[./]", kind.lstrip("!"), maxsplit=1)[0]


def learn(pages: pd.DataFrame) -> pd.DataFrame:
    """Words or tags inside and outside the content of the labelled pages: by the nearest block (word), by its name
    alone (name), by each block around (block), and by tag."""
    seen: Counter = Counter()
    for page in pages["html"]:
        for what, kind, text, _, inside in parts(page or ""):
            if what == "tag":
                seen["tag", kind, inside] += 1
                continue
            blocks, link = kind
            if n := len(text.split()):
                seen["word", nearest(blocks, link), inside] += n
                seen["name", name_of(nearest(blocks, link)), inside] += n
                for k in set(blocks):
                    seen["block", k, inside] += n
    return pd.DataFrame([(w, k, i, n) for (w, k, i), n in seen.items()], columns=["what", "kind", "inside", "n"])


Scores = dict[str, dict[str, tuple[float, int]]]


def weights(pages: DataFrame, sample: int = SAMPLE) -> Scores:
    """(log odds of lying inside, count) of what a bounded sample of labelled pages shows; the sample bounds the kinds too."""
    labelled = pages.select("page_id", "html").filter(F.lower("html").rlike("<(article|main)[ >]"))
    some = labelled.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample)
    counts = labelled.join(F.broadcast(some), "page_id", "left_semi").select("html").mapInPandas(lambda it: map(learn, it), "what string, kind string, inside boolean, n long")
    table = counts.groupBy("what", "kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("a"), F.sum("n").alias("n"))
    out: Scores = {"word": {}, "name": {}, "block": {}, "tag": {}}
    for r in table.collect():
        out[r["what"]][r["kind"]] = max(-BOUND, min(BOUND, math.log((r["a"] + 0.5) / (r["n"] - r["a"] + 0.5)))), r["n"]
    return out


def shrunk(seen: tuple[float, int] | None, prior: float) -> float:
    odds, n = seen or (0.0, 0)
    return (n * odds + PRIOR * prior) / (n + PRIOR)


def word_score(around: Around, scores: Scores) -> float:
    """The score of a word by the blocks around it."""
    blocks, link = around
    listed = [shrunk(scores["block"].get(k), -BOUND) for k in set(blocks) if k[0] == "!"]
    kind = nearest(blocks, link)
    own = shrunk(scores["word"].get(kind), NAME * shrunk(scores["name"].get(name_of(kind)), WORD))
    return min([own, *listed, *(x for k in set(blocks) if k[0] != "!" and (x := shrunk(scores["block"].get(k), 0.0)) < 0)])


def best_run(scores: list[float]) -> tuple[int, int]:
    """The run (from, to) of the greatest total, the first of equals; empty where no score is positive."""
    best, run, start, region = 0.0, 0.0, 0, (0, 0)
    for i, score in enumerate(scores):
        if run <= 0:
            run, start = 0.0, i
        run += score
        if run > best:
            best, region = run, (start, i + 1)
    return region


def cut_runs(scores: list[float]) -> list[bool]:
    """Which blocks of the region stay. The runs that are left out lose least in all, where each run costs SWITCH: one linear
    scan with two states. Ties keep a block."""
    keep, drop, came = 0.0, -math.inf, []
    for score in scores:
        came.append((drop > keep, drop >= keep - SWITCH))  # whether the best way to either state leads over a block left out
        keep, drop = max(keep, drop) + score, max(drop, keep - SWITCH)
    stays, kept = [], drop <= keep
    for to_keep, to_drop in reversed(came):
        stays.append(kept)
        kept = not (to_keep if kept else to_drop)
    return stays[::-1]


def extract(page: str | None, scores: Scores) -> str:
    seq = list(parts(page or ""))
    known: dict[Around, float] = {}
    each = []
    plain = not any(x[0] == "tag" for x in seq)
    for what, kind, text, _, _ in seq:
        if what == "tag":
            each.append(min(TAG / 10, shrunk(scores["tag"].get(kind), TAG)))
        else:
            if kind not in known:
                known[kind] = WORD if plain else word_score(kind, scores)
            each.append(len(text.split()) * max(0.0, known[kind]))
    lo, hi = best_run(each)
    # The region may begin or end inside a block: take in what the block holds besides.
    while 0 < lo < len(seq) and not seq[lo - 1][3]:
        lo -= 1
    while 0 < hi < len(seq) and not seq[hi][3]:
        hi += 1
    # What lies in the region and is not of it (adverts between paragraphs) is found by a scan of its blocks.
    blocks, losses = [[]], [0.0]
    for what, kind, text, breaks, _ in seq[lo:hi]:
        if what == "text":
            blocks[-1].append(text)
            losses[-1] += len(text.split()) * known[kind]
        elif breaks or kind == "br":
            blocks.append([])
            losses.append(0.0)
    kept = (" ".join(html.unescape("".join(b)).split()) for b, stays in zip(blocks, cut_runs(losses), strict=True) if stays)
    return " ".join(filter(None, kept))


def main_text(pages: DataFrame, scores: Scores | None = None) -> DataFrame:
    """pages with column `text`, the main text of `html`."""
    scores = scores or weights(pages)

    def each(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lean()
        for some in batches:
            yield pd.Series([extract(p, scores) for p in some], dtype=object)

    return pages.withColumn("text", F.pandas_udf(each, "string")("html"))
