"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

import corpus_pipeline
from carefold.llm import nearcopies


def words_sets(text: str | None) -> set:
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def kept(rows: list[tuple]) -> list[int]:
    sets = [words_sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                parent[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(least.values())


def corpus() -> list[tuple]:
    rnd = random.Random(3)
    passage = [f"p{k}" for k in range(30)]
    texts = []
    for b in range(25):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(rnd.choice([1, 3, 5, 8, 40, 90, 250]))]
        if b % 3 == 0:
            base += passage  # a common passage alone makes no near copies
        for _ in range(rnd.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rnd.choice([0, 1, 1, 2, 4, 6])):
                words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 4000)}"
            texts.append(" ".join(words))
    texts += [None, "", " \n", texts[0], texts[0].upper()]
    ids = rnd.sample(range(5000), len(texts))
    return list(zip(ids, texts, strict=True))


def test_stage_like_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == kept(rows)


def test_sample_decides_no_result(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(nearcopies, "SAMPLE", 7)
    monkeypatch.setattr(nearcopies, "PAIRS", 5)
    monkeypatch.setattr(nearcopies, "MAX_GROUP", 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == kept(rows)


def test_sketches_differ_by_no_more_than_their_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, size=n)) for n in (3, 200, 300, 900, 1100)]
    sets += [np.unique(np.concatenate([s[2:], rng.integers(0, 1 << 62, size=3)])) for s in sets]
    drawn = nearcopies.Sketches(pa.array([nearcopies.sketch(s) for s in sets], pa.list_(pa.int64())))
    a, b = (x.ravel() for x in np.indices((len(sets), len(sets))))
    for i, j, d in zip(a.tolist(), b.tolist(), drawn.differ(a, b).tolist(), strict=True):
        assert d <= len(np.setxor1d(sets[i], sets[j])) and (d == 0 or i != j)


def test_a_similarity_of_just_four_fifths(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(2, " ".join(words)), (1, " ".join(words + [f"e{i}" for i in range(9)])), (4, " ".join(words[:-1])), (3, " ".join(words + [f"f{i}" for i in range(10)]))]
    got = nearcopies.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == kept(rows) == [1, 3]


def test_simhash_decides_by_repeats(spark):
    """A passage many times over with another end: the sets differ, the shingles with repeats don't."""
    words = lambda x, n: " ".join(f"{x}{i}" for i in range(n))
    ends = [f"{' '.join([words('p', 20)] * times)} {words(x, 15)}" for x, times in (("a", 40), ("b", 40), ("c", 40), ("d", 4))]
    rows = [(5, ends[0]), (3, ends[1]), (4, ends[2]), (9, ends[3]), (7, words("a", 15)), (8, ends[0].upper())]
    assert kept(rows) == [3, 4, 5, 7, 9]  # by sets alone
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == [3, 7, 9]


def test_repeats_are_items_of_their_own():
    every = np.array([5, 9, 5, 5, 1, 9], dtype=np.uint64)
    assert len(nearcopies.repeats(every)) == len(set(nearcopies.repeats(every).tolist())) == 3
    assert set(nearcopies.repeats(every[:3]).tolist()) < set(nearcopies.repeats(every).tolist())
    assert len(nearcopies.repeats(every[:2])) == len(nearcopies.repeats(every[:0])) == 0


def test_no_documents(spark):
    assert nearcopies.one_of_each(spark.createDataFrame([], "doc_id long, text string")).collect() == []
