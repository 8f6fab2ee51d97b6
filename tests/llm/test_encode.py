import os
import random

import pytest

pytest.importorskip("ledgerfen.llm")
from hypothesis import given, settings
from hypothesis import strategies as st
from ledgerfen.llm import encode as e

pytestmark = pytest.mark.skipif(not os.path.exists(e.RANKS), reason="no vocabulary")


@pytest.fixture(scope="module")
def tokens():
    return e.read_ranks()


@pytest.fixture(scope="module")
def encoder(tokens):
    return e.Encoder(tokens)


@pytest.fixture(scope="module")
def public(tokens):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def merged(piece: bytes, ids: dict[bytes, int]) -> list[int]:
    """The merges one by one: the earliest pair of the least rank first."""
    parts = [bytes([b]) for b in piece]
    while True:
        ranked = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
        if not ranked:
            return [ids[p] for p in parts]
        i = min(ranked)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(encoder, public, tokens, text):
    ids = encoder.encode(text)
    assert ids == public.encode_ordinary(text)
    assert e.Decoder(tokens).decode(ids) == text


def test_pieces_against_merging(encoder, tokens):
    rng, ids = random.Random(1), {t: i for i, t in enumerate(tokens)}
    for k in range(1500):
        letters = ("ab", "aeinst", "thereinting", "aà́日")[k % 4]
        piece = "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))).encode()
        assert encoder.piece(piece) == merged(piece, ids)


def test_special_strings_and_long_texts(encoder, public):
    for text in ("<|endoftext|>", " \t\n  x", "a" * 50_000, "don't we'll", "　 x", "0123456789" * 50, "👩‍👧", "\x00﻿"):
        assert encoder.encode(text) == public.encode_ordinary(text)


def test_small_vocabulary_needs_backtracking():
    """Longest matches alone would fail: 'abcd' starts with the token 'abc', but the merges give 'ab' and 'cd'."""
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"cd", b"bc", b"abc"]
    got = e.Encoder(tokens).piece(b"abcd")
    assert got == merged(b"abcd", {t: i for i, t in enumerate(tokens)}) == [256, 257]


def test_table(spark, public):
    from pyspark.sql import functions as F

    data = [(1, "Hello world"), (2, None), (3, ""), (4, "  \n "), (None, "x"), (1, "Hello world"), (5, "ß" * 3000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = sorted(((r.doc_id, list(r.ids)) for r in e.encode(docs).collect()), key=str)
    assert got == sorted(((i, public.encode_ordinary(t or "")) for i, t in data), key=str)
    back = sorted(((r.doc_id, r.text) for r in e.decode(e.encode(docs)).collect()), key=str)
    assert back == sorted(((i, t or "") for i, t in data), key=str)
    assert e.encode(docs.limit(0)).count() == 0
    assert [r.text for r in e.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).collect()] == [""]


def test_bad_vocabularies_and_ids(tokens, tmp_path):
    with pytest.raises(ValueError):
        e.Vocabulary([b"a", b"b"])
    (tmp_path / "x").write_bytes(b"YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        e.read_ranks(str(tmp_path / "x"))
    with pytest.raises(IndexError):
        e.Decoder(tokens).decode([len(tokens)])
    with pytest.raises(IndexError):
        e.Decoder(tokens).decode([-1])
