"""Greedy string tiling against a word-by-word version."""

from __future__ import annotations

import random

import pytest

from carefold.llm import decontam
from carefold.llm._arrays import word_hashes


def slow_tiles(doc: list, item: list, gram: int) -> int:
    """Words of the item covered: mark the longest free match, the first in both, until none has ``gram`` words."""
    in_doc, in_item = [False] * len(doc), [False] * len(item)
    while True:
        best = (gram - 1, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not in_doc[i + n] and not in_item[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < gram:
            return sum(in_item)
        for k in range(n):
            in_doc[i + k] = in_item[j + k] = True


@pytest.mark.parametrize("seed", range(60))
def test_tiles_like_word_by_word(seed):
    rnd = random.Random(seed)
    words = [b"w%d" % i for i in range(rnd.choice([2, 5, 30, 200]))]
    item = [rnd.choice(words) for _ in range(rnd.randint(5, 60))]
    doc = [rnd.choice(words) for _ in range(rnd.randint(0, 40))]
    cut = sorted(rnd.sample(range(len(item)), 2))
    parts = [item[: cut[0]], item[cut[0] : cut[1]], item[cut[1] :], doc]
    rnd.shuffle(parts)
    doc = sum(parts, [])
    found = decontam.tiles(word_hashes(doc), word_hashes(item), 5)
    taken = set()
    for i, j, n in found:
        assert doc[i : i + n] == item[j : j + n] and n >= 5
        assert not taken & set(range(j, j + n))
        taken |= set(range(j, j + n))
    assert len(taken) == slow_tiles(doc, item, 5)


def brute(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    out = set()
    for doc_id, text in docs:
        own = decontam.words_of(text)
        for item_id, of in items:
            item = decontam.words_of(of)
            if item and (covered := slow_tiles(own, item, min(decontam.GRAM, len(item)))) >= decontam.THRESHOLD * len(item):
                out.add((doc_id, item_id, round(covered / len(item), 9)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,bits", [(1, decontam.BITS), (2, decontam.BITS), (3, 64), (4, 1 << 10)])
def test_report_like_all_pairs(spark, seed, bits):
    """Items with a common beginning, documents with parts of items in any order; bitmaps that let grams through."""
    rnd = random.Random(seed)
    template = [f"t{i}" for i in range(9)]
    items = [(i, " ".join(template + [f"i{i}w{rnd.randint(0, 20)}" for _ in range(rnd.choice([0, 3, 11, 25, 40]))])) for i in range(25)]
    items += [(30, "one"), (31, "a b a b a b a b a b a b"), (32, items[3][1]), (None, items[4][1]), (33, None), (34, " ... ")]
    docs = []
    for i in range(60):
        parts = [[f"d{rnd.randint(0, 50)}" for _ in range(rnd.randint(0, 20))]]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            words = (rnd.choice(items)[1] or "").split()
            a, b = sorted(rnd.choices(range(len(words) + 1), k=2))
            parts += rnd.choice([[words], [words[b:], words[:a]], [words[a:b]], [words[a:], words[:a]]])
        rnd.shuffle(parts)
        docs.append((i, " ".join(sum(parts, []))))
    docs += [(100, "A b, a b" * 40), (None, items[0][1]), (101, None), (7, docs[8][1]), (7, docs[8][1]), (102, "one")]
    found, members = decontam.matches(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), bits=bits
    )
    got = {(r.doc, r.item_id, round(r.coverage, 9)) for r in found.join(members, "item").collect()}
    assert sorted(got, key=repr) == brute(docs, items)
    reported = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, round(r.coverage, 9)) for r in reported.collect()} == got


def test_repeated_words_do_not_multiply():
    """A word that fills a very long document and an item: the places add up."""
    import time

    doc, item = word_hashes([b"a"] * 400_000 + [b"b"]), word_hashes([b"a"] * 2000)
    began = time.perf_counter()
    assert decontam.Stretches(doc).cover(item, 5, 1000) == (2000, 2000)
    assert time.perf_counter() - began < 10


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6", 1, 2, 3, 4, 5, 6, 7), (2, "clean", 1, 2, 3, 4, 5, 6, 7)],
                                 "doc_id long, text string, _id int, _key int, _row int, key int, row int, r int, `a.b` int")
    items = spark.createDataFrame([(1, "q1 q2 q3 q4 q5 q6", 8, 9)], "item_id long, text string, item int, words int")
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "clean", 1, 2, 3, 4, 5, 6, 7)]


@pytest.fixture
def tables(spark):
    passage = " ".join(f"q{i}" for i in range(40))
    turned = " ".join(f"q{i}" for i in [*range(20, 40), *range(20)])
    part = " ".join(f"q{i}" for i in range(15))
    rows = [(1, f"before {passage} after"), (2, f"x {turned} y"), (3, f"little of it: {part}"), (4, "nothing at all of this kind"), (5, None), (6, ""), (7, passage.upper()),
            (7, "clean"), (None, passage), (8, "Short item")]
    docs = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, row int")
    items = spark.createDataFrame([(1, passage), (2, passage), (3, None), (4, "..."), (None, "short, item")], "item_id long, text string")
    return docs, items


def test_report_and_clean(spark, tables):
    docs, items = tables
    found = {(r.doc_id, r.item_id) for r in decontam.report(docs, items).collect()}
    assert found == {(d, i) for d in (1, 2, 7, None) for i in (1, 2)} | {(8, None)}
    left = sorted((tuple(r) for r in decontam.clean(docs, items).collect()), key=repr)
    assert [r[:2] for r in left] == [(3, docs.filter("doc_id = 3").first().text), (4, "nothing at all of this kind"), (5, None), (6, ""), (7, "clean")]


def test_empty(spark, tables):
    docs, items = tables
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()
    assert decontam.clean(docs.limit(0), items).count() == 0
