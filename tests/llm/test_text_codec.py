"""The encoder against the tokenizers library, and exact round trips."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from oreline.llm.bpe import Codec, decode_documents, digests, encode_documents, read_vocabulary, share

PATH = public_tokenizers.path("byte_bpe_50k.json")
CODEC, THEIRS = Codec(read_vocabulary(PATH)), Tokenizer.from_file(PATH)


def same(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    return CODEC.encode(text) == ids and CODEC.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text(text):
    assert same(text)


def test_awkward_pieces():
    draw = random.Random(5)
    parts = ["a", "the", " ", "  ", "\n", "\t", "22", ",", "...", "é", "日本", "\x1c", "\x85", "<|endoftext|>", "'s", "'ll", "²", "😀", "́", "​", "_", "ing", "\r\n", "　", "-", "ß"]
    assert all(same("".join(draw.choice(parts) for _ in range(draw.randint(0, 14)))) for _ in range(3000))


@pytest.mark.parametrize("text", ["a" * 50_000, "ab" * 20_000, " " * 20_000, "=-" * 10_000, "x y" * 20_000, "<|endoftext|>" * 50, ""])
def test_long_and_empty(text):
    assert same(text)


def test_documents(spark):
    rows = [(1, "Hello  world", "q"), (2, None, "q"), (3, "", "r"), (3, "", "r"), (None, "again again", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    shared = share(spark, PATH)
    encoded = encode_documents(docs, shared)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    back = [(r.doc_id, r.text) for r in decode_documents(encoded, shared).collect()]
    assert sorted(back, key=str) == sorted([(i, t or "") for i, t, _ in rows], key=str)
    for r in digests(docs, shared).collect():
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        ids = THEIRS.encode(text, add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert digests(docs.limit(0), shared).count() == 0
