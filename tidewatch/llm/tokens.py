"""Token ids of whole texts by a public tokenizer file, with the pieces between white space remembered.

The tokenizers used here never join characters across the pieces that PIECES finds (a word with at most one space
before it, or white space; letters and digits apart from other signs where nothing can bind them), so the ids of a
text are those of its pieces in turn. That holds for texts of ASCII and Latin-1 letters, where no normalisation joins
or changes characters by their neighbours; any other text, and one that spells an added token, goes to the library
as a whole. Pieces already met are not encoded again; the memory holds about CACHE pieces, and when it is full those
met but once are dropped.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from tidewatch.llm.common import runs

CACHE = 150_000
RUN_CHARS = 400_000
TOGETHER = 200
_SPACE = r"[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+"
#: By (spaced, fine): letters and digits apart from other signs where the text has no apostrophe and no underscore.
PIECES = {
    (True, False): re.compile(rf" ?[^ \t\n\r]+|{_SPACE}"),
    (True, True): re.compile(rf" ?\w+| ?[^\w \t\n\r]+|{_SPACE}"),
    (False, False): re.compile(r"[^ \t\n\r]+"),
    (False, True): re.compile(r"\w+|[^\w \t\n\r]+"),
}
#: What a text must not hold for its pieces to be encoded apart: all but ASCII signs and Latin-1 letters.
OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")


class Numbers(dict):
    """Numbers in the order of first sight; `new` holds the pieces not yet encoded."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """spaced: whether white space is part of the ids (byte-level tokenizers), or dropped. added: whether the name of
    an added token in a text stands for that token, as in the library's plain call, or is text like any other."""

    def __init__(self, path: str, spaced: bool, added: bool = True, cache: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.cache = cache
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.names = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        # What can stand between pieces in one call of the tokenizer: always a piece of its own with one known id.
        self.between, self.never = ("\n", re.compile(r"[\s\d]*[\n\r\t]")) if spaced else (" 7 ", re.compile("[^7]*7"))
        self.mark = self.raw([self.between])[0]
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.flat = np.zeros(0, np.uint32)
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int32)

    def thin(self) -> None:
        """Drop the pieces met but once; forget all if too many are left."""
        kept = np.flatnonzero(self.met > 1)
        if len(kept) > self.cache // 2:
            self.forget()
            return
        names = list(self.number)
        self.number = Numbers()
        self.number.update((names[i], n) for n, i in enumerate(kept.tolist()))
        size = self.size[kept]
        to = np.cumsum(size)
        self.flat = self.flat[np.repeat(self.start[kept] - to + size, size) + np.arange(int(size.sum()))]
        self.start, self.size, self.met = to - size, size, np.zeros(len(kept), np.int32)

    def raw(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece. Short pieces are encoded TOGETHER at a time, with marks between them."""
        out: list = [None] * len(pieces)
        never = self.never.match
        joined = [i for i, p in enumerate(pieces) if len(p) < 100 and (p.isalpha() or not never(p))]
        groups = [joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)]
        for group, ids in zip(groups, self.raw([self.between.join([pieces[i] for i in g]) for g in groups]), strict=True):
            ends = np.flatnonzero(ids == self.mark[0])
            if len(self.mark) == 1 and len(ends) == len(group) - 1:
                for i, a, b in zip(group, [0, *(ends + 1).tolist()], [*ends.tolist(), len(ids)], strict=True):
                    out[i] = ids[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self.raw([pieces[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, or None where it has to be encoded as a whole."""
        if OTHER.search(text) or any(name in text for name in self.names):
            return None
        if not self.spaced:
            text = text.lower()  # as this tokenizer does itself
        return PIECES[self.spaced, "'" not in text and "_" not in text].findall(text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        all_, out = [t or "" for t in texts], []
        for a, b in runs(all_, RUN_CHARS):
            if len(self.number) > self.cache:
                self.thin()
            parts = [self.pieces(t) for t in all_[a:b]]
            whole = [i for i, p in enumerate(parts) if p is None]
            parts = [p or [] for p in parts]
            count = np.fromiter(map(len, parts), np.int64, b - a)
            at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
            if new := self.number.new:
                got = self.encoded(new)
                size = np.fromiter(map(len, got), np.int64, len(got))
                self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
                self.size = np.concatenate([self.size, size])
                self.flat = np.concatenate([self.flat, *got])
                self.met = np.concatenate([self.met, np.zeros(len(got), np.int32)])
            seen = np.bincount(at)
            self.met[: len(seen)] += seen.astype(np.int32)
            size = self.size[at]
            to = np.cumsum(size)
            ids = self.flat[np.repeat(self.start[at] - to + size, size) + np.arange(int(size.sum()))]
            ends = np.concatenate([[0], to])[np.cumsum(count)]
            each = np.split(ids, ends[:-1])
            for i in whole:
                each[i] = self.raw([all_[a + i]])[0]
            out += each
            if any(len(t) > 10_000 for t in new):  # runs without a space are not kept
                self.forget()
            self.number.new = []
        return out


_ENCODERS: dict[tuple[str, bool, bool, int], Encoder] = {}


def encoder(path: str, spaced: bool, added: bool = True, cache: int = CACHE) -> Encoder:
    """One encoder for each worker process; tasks that it runs later find the pieces already met."""
    if (path, spaced, added, cache) not in _ENCODERS:
        _ENCODERS[path, spaced, added, cache] = Encoder(path, spaced, added, cache)
    return _ENCODERS[path, spaced, added, cache]


def release() -> None:
    """Give up the encoders of this worker process."""
    _ENCODERS.clear()
