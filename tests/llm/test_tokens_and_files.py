"""Token ids, packing and token files against the tokenizers library itself."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.llm import packing, tokenfile, tokens

TEXTS = [
    (5, "Hello, world! it's  two  spaces\n\nand\tlines"), (3, None), (9, ""), (1, "word " * 3000), (7, "a.b,c). (x), y_. d;. \"q.\" 3.14,15 it's. x', ,. , ."), (2, "nb\xa0sp \x1c É İ Σας ΣΑΣ ½ x² 日本語"),
    (8, "don’t ‘quote’ ### %%%&& !!"), (5, "Hello, world! it's  two  spaces\n\nand\tlines"), (11, " lead and trail "),
]
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain(path, text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def docs(spark):
    return spark.createDataFrame([(i, t, i, "x") for i, t in TEXTS], "doc_id long, text string, start long, ids string")  # clashing names


@pytest.mark.parametrize("path,spaced", [(BYTE, True), (WORD, False)])
def test_encoder_equals_the_library(path, spaced):
    e = tokens.Encoder(path, spaced)
    for _ in range(2):
        assert [x.tolist() for x in e.encode([t for _, t in TEXTS])] == [plain(path, t) for _, t in TEXTS]
    e.thin()
    assert [x.tolist() for x in e.encode([t for _, t in TEXTS])] == [plain(path, t) for _, t in TEXTS]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=" \n\tabcXYZÉé'’_.,!#09²½Ⅳ ", max_size=60))
def test_encoder_on_any_text(text):
    for path, spaced in ((BYTE, True), (WORD, False)):
        assert tokens.encoder(path, spaced).encode([text])[0].tolist() == plain(path, text)


def test_packing_covers_every_id_once(spark):
    rows = packing.pack(docs(spark), BYTE).toPandas()
    seq = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, s in seq:
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 1024
    want = sorted((i, zlib.crc32(np.array([*plain(BYTE, t), 0], "<u4").tobytes())) for i, t in TEXTS)
    got = []
    for (i, total), d in rows.groupby(["doc_id", "doc_tokens"]):
        copies = sum(1 for j, t in TEXTS if j == i)
        assert d["length"].sum() == total * copies
        if copies == 1:
            d = d.sort_values("start")
            assert d["start"].tolist() == (d["length"].cumsum() - d["length"]).tolist()
            got.append((i, zlib.crc32(b"".join(d["ids"]))))
    assert got == [x for x in want if sum(1 for j, _ in TEXTS if j == x[0]) == 1]


@given(st.lists(st.integers(1, 1024), max_size=60))
def test_assignment_leaves_less_than_one_sequence(lengths):
    a = np.array(lengths, np.int64)
    got = packing.assign(a)
    used: dict = {}
    done = dict.fromkeys(range(len(lengths)), 0)
    for i, at, n, s in got:
        assert at == done[i] and n > 0
        done[i] += n
        used[s] = used.get(s, 0) + n
    assert list(done.values()) == lengths and all(u <= 1024 for u in used.values())
    assert len(used) == -(-sum(lengths) // 1024)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60000), max_size=400), st.integers(0, 3))
def test_blocks_round_trip(ids, first):
    a = np.array(ids, np.uint32)
    data = tokenfile.pack_ids(a)
    assert np.array_equal(tokenfile.unpack_ids(data), a)
    assert np.array_equal(tokenfile.unpack_ids(data, first, first + 1), a[first * 128 : (first + 1) * 128])


def test_token_files(spark):
    got = tokenfile.read(tokenfile.write(docs(spark), WORD)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("c")).orderBy("start").collect()
    at = 0
    assert [r["doc_id"] for r in got] == sorted(i for i, _ in TEXTS)
    texts = {i: t for i, t in TEXTS}
    for r in got:
        ids = [*plain(WORD, texts[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["c"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert packing.pack(none, BYTE).count() == 0
    assert tokenfile.read(tokenfile.write(none, WORD)).count() == 0


def test_workers_encode_no_piece_twice_while_they_remember_it():
    words = ["".join("abcdefghij"[int(c)] for c in str(i)) for i in range(600_000)]
    texts = [" ".join(words[i : i + 5_000]) for i in range(0, len(words), 5_000)]
    for path, spaced, cache in ((BYTE, True, packing.CACHE), (WORD, False, tokenfile.CACHE)):
        e = tokens.Encoder(path, spaced, True, cache)
        first = e.encode(texts)
        e.raw = None  # nothing is left to encode
        assert all((a == b).all() for a, b in zip(first, e.encode(texts), strict=True))
