"""Substring dedup against a comparison of all windows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from carefold.llm import substring
from carefold.llm._bitmap import Bitmap


def brute(rows: list[tuple], length: int) -> list[tuple]:
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = Counter(tuple(w[s : s + length]) for _, w in docs for s in range(len(w) - length + 1))
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - length + 1):
            if seen[tuple(w[s : s + length])] > 1:
                gone.update(range(s, s + length))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed: int, length: int) -> list[tuple]:
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(rnd.choice([2, 40, 5000]))]
    fresh = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passages = [fresh(rnd.randint(length - 3, 3 * length)) for _ in range(4)]
    rows = []
    for i in range(30):
        words = fresh(rnd.randint(0, 2 * length))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, 4)
            words += p[a : len(p) - rnd.randint(0, 4)] + fresh(rnd.randint(0, 6))
        rows.append((i, rnd.choice([" ", "  ", "\n"]).join(words)))
    rows += [rows[3], (None, rows[5][1]), (99, None), (100, ""), (101, rows[7][1].replace(" ", " ", 1))]
    return rows


@pytest.mark.parametrize("seed", range(6))
def test_like_all_windows(spark, seed):
    length = 35 if seed % 2 else 12
    rows = corpus(seed, length)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int")
    got = sorted(map(tuple, substring.digest(docs, length, 8).collect()), key=repr)
    assert got == brute(rows, length)


def test_copies_in_one_document_and_runs(spark):
    run = " ".join(["same"] * 200)
    alone = " ".join(f"u{i}" for i in range(60))
    rows = [(1, run), (2, alone), (3, alone + " x " + alone)] + [(10 + i, run) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.digest(docs).collect()), key=repr) == brute(rows, substring.WINDOW)


def test_a_full_bitmap_lets_all_anchors_through(spark, monkeypatch):
    monkeypatch.setattr(substring, "bitmap_of", lambda *_: Bitmap(np.full(1, -1).view(np.uint64)))
    rows = corpus(3, 12)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, substring.digest(docs, 12, 8).collect()), key=repr) == brute(rows, 12)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_that_repeat_in_all(spark, doc_id):
    """Their spans are one small set, so the work is in proportion to the rows."""
    text, n = " ".join(f"w{i}" for i in range(60)), 20_000
    docs = spark.range(n).select(F.lit(doc_id).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    assert substring.digest(docs).groupBy("n_words", "n_removed").count().collect() == [(60, 60, n)]
    spans = substring.repeats(docs.select("doc_id", F.lit(1).cast("long").alias("row"), "text")).collect()
    assert [len(r.spans) for r in spans] == [len({(s.start, s.end) for s in spans[0].spans})]


def test_texts_left(spark):
    p = " ".join(f"p{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"a {p} b"), (2, f"c {p} d"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_removed) for r in substring.dedup(docs).collect()} == {1: ("a b", 40), 2: ("c d", 40), 3: ("", 0)}


def test_empty(spark):
    assert substring.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
