"""Recall for a set of queries against all pairs."""

from __future__ import annotations

import random

from carefold.operators import recall


def test_each_query_has_its_neighbours(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK", 3)
    monkeypatch.setattr(recall, "ROWS", 7)
    rnd = random.Random(4)
    rows = [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(40)]
    rows += [(40, list(rows[3][1])), (41, None), (42, [0.0] * 4), (43, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    full = [r for r in rows if r[1] and len(r[1]) == 4 and any(r[1])]
    want = {q: sorted((-round(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, 9), i) for i, b in full)[:5] for q, a in full if q % 10 == 0}
    got: dict[int, list] = {}
    for r in recall.top_k_each(vectors, vectors.filter("vec_id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((-round(r.similarity, 9), r.id))
    assert {q: sorted(x) for q, x in got.items()} == want


def test_an_index_that_looks_everywhere_is_exact(spark, monkeypatch):
    monkeypatch.setattr(recall, "BLOCK", 4)
    monkeypatch.setattr(recall, "ROWS", 9)
    rnd = random.Random(8)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(6)]) for i in range(150)] + [(200 + i, [1.0] * 6) for i in range(60)]  # a third are equal
    rows += [(900, None), (901, [0.0] * 6), (902, [1.0, 2.0]), (None, [1.0] * 6)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = recall.Index(vectors, 5, cells=7)
    asked = vectors.filter("vec_id % 10 = 0")
    rounded = lambda df: sorted((r.query_id, r.id, round(r.similarity, 9)) for r in df.collect())
    assert rounded(index.search(asked, probes=7)) == rounded(recall.top_k_each(vectors, asked, 5))
    parts = index.rows.selectExpr("size(part_rows) AS n").collect()
    assert sum(r.n for r in parts) == 210 and max(r.n for r in parts) < 40


def test_recall_of_the_index(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asked = vectors.filter("vec_id % 50 = 0")
    index = recall.Index(vectors, 10)
    told = recall.found_share(index.search(asked), recall.top_k_each(vectors, asked, 10)).selectExpr("sum(found) / sum(neighbours) AS share", "count(*) AS n").first()
    assert told.n == 40 and told.share >= 0.9 and index.probes < len(index.of)


def test_an_index_of_nothing(spark):
    vectors = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    assert recall.Index(vectors, 3).search(vectors).collect() == []
