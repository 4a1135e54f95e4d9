"""Byte-level BPE against the tiktoken library, and round trips."""

from __future__ import annotations

import base64
import hashlib
import struct

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from carefold.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = [
    "", " ", "\n", "a", "  two  spaces ", "it's we'll I'D 'tis 's", "tabs\tand\r\nlines \n\n x", "12345 6 ７８", "é ü 漢字 🙂🙂",
    "<|endoftext|>", "a'sb 'll'll ''s", "x" * 5000, "ab" * 3000, " nbsp  em", " 　 wide", "$%&/()=?", "it''s  'S",
]


@pytest.mark.parametrize("text", TEXTS)
def test_like_library(coder, library, text):
    ids = coder.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdltrevm09aé漢🙂 <|>"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(coder, library, text):
    assert coder.encode(text).tolist() == library.encode_ordinary(text)


def test_perfect_hash_is_minimal(coder):
    whole = coder.whole
    assert len(whole.values) == len(coder.ranks)
    assert sorted(whole.values.tolist()) == sorted(coder.ranks.values())


def test_query_columns(spark, coder, library):
    rows = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x" * 20000)]
    docs = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.round_trip(docs, coder).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(docs.limit(0), coder).collect() == []


def test_encode_then_decode(spark, coder):
    docs = spark.createDataFrame([(1, "some text é"), (2, None)], "doc_id long, text string")
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(bpe.encode(docs, coder), coder).collect()}
    assert back == {1: "some text é".encode(), 2: b""}
    assert np.frombuffer(bpe.encode(docs, coder).filter("doc_id = 1").first().ids, "<u4").tolist() == coder.encode("some text é").tolist()
