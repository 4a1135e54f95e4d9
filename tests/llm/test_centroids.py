"""Centroid clustering against plain Python with whole numbers of any size."""

from __future__ import annotations

import hashlib
import math
import random

import pytest

from carefold.llm import centroids
from tests.oracle import assert_same, connect

SCHEMA = "vec_id long, embedding array<float>, label int, chunk int, cluster string"


def lloyd(rows: list[tuple], k: int, rounds: int, dims: int) -> tuple[list[tuple], list[list[int]]]:
    """([(vec_id, cluster, distance)], centroids)."""
    limit = 1 << 27
    kept = [(i, [max(-limit, min(limit, math.floor(64 * x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    of = [list(v) for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(of))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(of)):
            if mine := [v for (_, v), c in zip(kept, own, strict=True) if c == j]:
                of[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, j, d) for i, v in kept for d, j in [nearest(v)]], of


def made(n: int, dims: int, seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    rows = [(i, [rnd.choice([-1.5, 0.25, 1.0]) + rnd.gauss(0, 0.2) for _ in range(dims)]) for i in range(n)]
    rows = [(i, [struct_float(x) for x in v]) for i, v in rows]
    return rows + [(1, rows[0][1]), (1, rows[3][1]), (None, rows[2][1]), (None, rows[4][1])] + [(900 + i, rows[5][1]) for i in range(n // 3)]


def struct_float(x: float) -> float:
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize("k,rounds,dims,width,chunk", [(5, 3, 8, 3, 7), (16, 2, 6, 16, 4096), (1, 1, 4, 2, 5), (40, 3, 5, 1, 6)])
def test_like_plain_python(spark, monkeypatch, k, rounds, dims, width, chunk):
    monkeypatch.setattr(centroids, "CHUNK", chunk)
    rows = made(60, dims, k)
    bad = [(2000, None), (2001, []), (2002, [1.0] * (dims - 1)), (2003, [None] + [1.0] * (dims - 1)), (2004, [float("nan")] + [1.0] * (dims - 1)), (2005, [float("-inf")] * dims)]
    large = [(3000, [3e38] * dims), (3001, [-3e38] * dims), (3002, [40000.0] * dims)]
    vectors = spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows + bad + large], SCHEMA).repartition(3)
    labels, of = centroids.cluster(vectors, k, rounds, dims, width)
    want, want_of = lloyd([(i, None if v is None else [struct_float(x) if x is not None else None for x in v]) for i, v in rows + bad + large], k, rounds, dims)
    assert of.tolist() == want_of
    assert sorted(map(tuple, labels.collect()), key=repr) == sorted(want, key=repr)


def test_query(spark, tmp_path):
    rows = made(90, 64, 3)
    spark.createDataFrame([(i, v, 0, 0, "x") for i, v in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, of = lloyd(rows, 16, 3, 64)
    per = {j: sum(d for _, c, d in want if c == j) for j in range(16)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in of]
    got = sorted(map(tuple, centroids.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, j, d, per[j], sum(per.values()), digest[j]) for i, j, d in want), key=repr)


def test_nothing_to_cluster(spark, tmp_path):
    spark.createDataFrame([(1, None, 0, 0, "x")], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = centroids.query(spark, str(tmp_path))
    assert found.collect() == [] and found.columns == [c.split()[0] for c in centroids.RESULT.split(", ")]


def test_too_many_cells(spark):
    with pytest.raises(ValueError):
        centroids.cluster(spark.createDataFrame([], SCHEMA), k=1 << 20, dims=64)


def test_query_matches_sql(spark):
    assert_same(centroids.query(spark, "/root/testdata/sf0.001"), connect("/root/testdata/sf0.001"), centroids.ORACLE)
