"""SimHash near-dedup against a comparison of all fingerprints."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from carefold.llm import simhash


def fingerprint(text: str | None) -> int:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints: list[int], limit: int) -> list[int]:
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= limit:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two THREE", "a b c d", "A b c d e f g a b c d", "é É  x y z w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == fingerprint(text)


def test_like_all_pairs(spark):
    rnd = random.Random(5)
    base = [[f"w{rnd.randint(0, 300)}" for _ in range(rnd.randint(1, 200))] for _ in range(40)]
    rows = []
    for i in range(160):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = "changed"
        rows.append((1000 - i, " ".join(words)))
    rows += [(5, None), (3, ""), (4, " "), (7, rows[0][1]), (7, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    prints = [fingerprint(t) for _, t in rows]
    of = classes(prints, simhash.LIMIT)
    least = {c: min((r[0] for r, k in zip(rows, of, strict=True) if k == c and r[0] is not None), default=None) for c in of}
    want = sorted(((r[0], p - (1 << 64) if p >> 63 else p, least[c]) for r, p, c in zip(rows, prints, of, strict=True)), key=repr)
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=repr) == want
    left = {r.doc_id for r in simhash.one_of_each(docs).collect()}
    assert left == {c for c in least.values() if c is not None}


@pytest.mark.parametrize("n,seed", [(300, 1), (3000, 2)])
def test_index_gives_all_components(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, size=n // 10, dtype=np.uint64)
    fp = centres[rng.integers(0, len(centres), n)].copy()
    for _ in range(4):
        flip = rng.random(n) < 0.6
        fp[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum(), dtype=np.uint64)
    fp = np.unique(fp)
    u, v = simhash.link_groups(np.zeros(len(fp), np.int64), fp)
    at = {x: i for i, x in enumerate(fp.view(np.int64).tolist())}
    labels = simhash.unite(np.arange(len(fp)), np.array([at[x] for x in u.tolist()]), np.array([at[x] for x in v.tolist()]))
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    i, j = np.nonzero(far <= simhash.LIMIT)
    assert (simhash.unite(np.arange(len(fp)), i, j) == labels).all()


@pytest.mark.parametrize("most,levels", [(4, 1), (4, 3), (40, 2), (40, 3), (100_000, 3)])
def test_split_groups_give_all_components(spark, monkeypatch, most, levels):
    """Groups above the bound: by further blocks of bits, and in slices."""
    monkeypatch.setattr(simhash, "MAX_GROUP", most)
    monkeypatch.setattr(simhash, "LEVELS", levels)
    rng = np.random.default_rng(most + levels)
    fp = np.repeat(rng.integers(0, 1 << 63, size=12, dtype=np.uint64), 25)
    for _ in range(5):
        flip = rng.random(len(fp)) < 0.6
        fp[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum(), dtype=np.uint64)
    fp = np.unique(np.concatenate([fp, rng.integers(0, 1 << 63, size=200, dtype=np.uint64)]))
    nodes = spark.createDataFrame([(x,) for x in fp.view(np.int64).tolist()], "fp long")
    groups = simhash._groups(nodes, simhash.LIMIT)
    assert most > 100 or groups.groupBy("g").count().agg({"count": "max"}).first()[0] < len(fp) / 2
    of = {r.u: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    want = classes(fp.tolist(), simhash.LIMIT)
    least: dict[int, int] = {}
    for x, c in zip(fp.view(np.int64).tolist(), want, strict=True):
        least[c] = min(x, least.get(c, x))
    assert [of.get(x, x) for x in fp.view(np.int64).tolist()] == [least[c] for c in want]


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(2, "a b c", 1, 2, 3), (1, "A b c", 4, 5, 6)], "doc_id long, text string, _id int, first int, r int")
    left = simhash.one_of_each(docs)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(1, "A b c", 4, 5, 6)]


def test_components_of_a_star(spark):
    edges = spark.createDataFrame([(i, 0) for i in range(1, 3000)] + [(5000, 4000)], "u long, v long")
    got = {r.u: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 3000)} | {5000: 4000}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100)], "u long, v long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
