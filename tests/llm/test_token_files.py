"""Token files and token counts: like the tokenizers library, round trips, damage, stitching."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from carefold.llm import bpe, token_counts, token_files
from carefold.llm._common import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdltrevmSDL09aéß²漢İ <|>._-"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(library, text):
    assert token_files.words(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


_PART = st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "<|", "don't", "'", " ", "\n", "é", "e\u0301", "\u0301", "漢", "Word", "7", "İ"])


@settings(max_examples=300, deadline=None)
@given(st.lists(_PART, max_size=12).map("".join))
def test_special_strings(library, text):
    assert token_files.words(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["", " ", "It's we'll I'D", "é é", "A<|endoftext|>B", "12345 a1b2", "ab" * 4000, "x_y-z...", "naïve CAFÉ bar", "ﬁ Å Å"])
def test_some_texts(library, text):
    assert token_files.words(PATH).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_memory_is_bounded_and_decides_nothing(library, monkeypatch):
    """Looked up in a plain dict, which sets need for a fast look; full, it is cleared in the middle of a text."""
    monkeypatch.setattr(token_files, "MEMO_ENTRIES", 3)
    coder = token_files.Words(PATH)
    for text in ("one two three four five six one", "x" * 100 + " one 12 don't", "seven<|endoftext|>one eight nine ten", "漢 one"):
        assert coder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
        assert type(coder.memo) is dict and len(coder.memo) <= 3


def test_frames():
    data = token_files.frame(b"one") + token_files.frame(b"")
    payload, at = token_files.unframe(data, 0)
    assert payload == b"one" and token_files.unframe(data, at) == (b"", len(data))
    for i in range(at):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            token_files.unframe(bytes(broken), 0)
    with pytest.raises(ValueError):
        token_files.unframe(data[: at - 1], 0)


def test_payloads():
    for ids in ([], [1, 2], [70000, 3]):
        doc, back = token_files.from_payload(token_files.to_payload(-5, np.array(ids, "<u4")))
        assert doc == -5 and back.tolist() == ids
    assert token_files.from_payload(token_files.to_payload(None, np.array([2], "<u4")))[0] is None


def test_written_and_read(spark, library):
    rnd = random.Random(1)
    rows = [(i * 3 % 101, " ".join(rnd.choice(["Word", "it's", "é", "zig"]) for _ in range(rnd.randint(0, 30)))) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "a<|endoftext|>b <|startoftext|>"), (5, rows[0][1])]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int").repartition(3)
    to = shared_dir(spark, "test-files")
    index = token_files.write(docs, PATH, to)
    shuffled = index.orderBy(F.rand(3))
    got = token_files.with_starts(token_files.read(shuffled, to), index).collect()
    got = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(library.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID])
    at = 0
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and ids in texts[r.doc_id]
        texts[r.doc_id].remove(ids)
        at += len(ids)


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: tuple(r)[1:] for r in token_files.query(spark, sf).collect()}
    at = 0
    for doc_id, text in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert got[doc_id] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    to = shared_dir(spark, "test-none")
    index = token_files.write(none, PATH, to)
    assert token_files.with_starts(token_files.read(index, to), index).collect() == []


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 21])
def test_separator_scan(spark, tmp_path, block):
    rnd = random.Random(block)
    (tmp_path / "flat").mkdir()
    want = []
    for name, closed in (("a.ids", True), ("b.ids", False), ("c.ids", True)):
        ids, start = [], 0
        lengths = [rnd.choice([0, 0, 1, 2, 30]) for _ in range(20)] if name != "c.ids" else []
        for k, n in enumerate(lengths):
            ids += [rnd.randint(0, 8) for _ in range(n)] + [9]
            want.append((name, k, start, n, True))
            start = len(ids)
        if not closed:
            ids += [1, 2, 3, 4]
            want.append((name, 20, start, 4, False))
        (tmp_path / "flat" / name).write_bytes(np.array(ids, "<u2").tobytes())
    got = token_counts.count_tokens(spark, f"file://{tmp_path}", 9, 2, block)
    assert sorted(map(tuple, got.select("file", "ordinal", "start", "n_tokens", "complete").collect())) == sorted(want)


def test_counts_of_documents(spark):
    sf = "/root/testdata/sf0.001"
    coder = bpe.ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    want = sorted((r.doc_id, len(coder.encode(r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(map(tuple, token_counts.query(spark, sf).collect())) == want


@pytest.mark.parametrize("doc_id", [None, 7])
def test_a_hot_doc_id_goes_to_many_files(spark, doc_id):
    rows = [(doc_id, f"word{i} it's") for i in range(400)] + [(i, "alone") for i in range(100, 120)]
    to = shared_dir(spark, "test-files")
    index = token_files.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), PATH, to)
    sizes = {r.file: r["count"] for r in index.groupBy("file").count().collect()}
    assert len(sizes) > 2 and max(sizes.values()) < 300
    got = sorted(token_files.with_starts(token_files.read(index, to), index).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [doc_id] * 400 + list(range(100, 120))
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(got, got[1:], strict=False))
