"""Centroid clustering (operator 11): Lloyd's algorithm on whole numbers, sharded by dimension.

Method: vectors are packed into chunks of rows, and every chunk is cut into column blocks of ``width`` dimensions,
which are stored apart and in the order of the blocks. A round is

* column-block tasks: each (chunk, block) meets only its block's slice of the centroids and gives the exact partial
  squared distances of its rows to each of them;
* the chunk is the key of the reduction: the blocks' partial distances are added and the least is taken;
* the assignment goes back to the column blocks; each adds up its own dimensions by cluster, and the sums by (block,
  cluster, dimension) give the new slice, floor(sum / count), of which no task sees more than its own block.

Chunks have a fixed size whatever values their rows hold, so equal vectors, one large cluster or one common vec_id are
no hot key anywhere. The centroids are k x dims numbers, at most MOST_CELLS of them: these alone are sent to the tasks
or come to the driver.

Components are floor(SCALE * x) of x as a double, exact up to 2 ** 27 and held at that beyond (|x| above two million),
so that squared distances fit a long. Defined results: vectors that are null, of another length, or with a null or
non-finite component are no rows of the result; null vec_ids are hashed as an empty text, and rows that repeat a vec_id
are vectors of their own (as first centroids in the order of their components); fewer vectors than ``k`` give fewer
centroids; an empty table gives an empty result; extra columns are not read. An inertia beyond a long is the largest long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._common import materialize, table

CLUSTERS = 16
ROUNDS = 3
DIMS = 64
SCALE = 64
#: Dimensions of a column block, and rows of a chunk.
WIDTH = 16
CHUNK = 4096
#: Numbers that the centroids may have in all (8 MB).
MOST_CELLS = 1 << 20
#: The greatest component.
LIMIT = 1 << 27
_MOST_LONG = (1 << 63) - 1

RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def kept(vectors: DataFrame, dims: int = DIMS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that are clustered, as doubles."""
    v = vectors[f"`{vector_column}`"].cast("array<double>")
    rows = vectors.select(vectors[f"`{id_column}`"].cast("long").alias("vec_id"), v.alias("v"))
    return rows.filter((F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))


def whole(values: np.ndarray) -> np.ndarray:
    """The components as whole numbers."""
    return np.clip(np.floor(SCALE * values.astype(np.float64)), -LIMIT, LIMIT).astype("<i4")


def first_centroids(rows: DataFrame, k: int) -> np.ndarray:
    """The ``k`` vectors whose vec_ids' hashes are least, in the order of these."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    least = rows.orderBy(hashed, "v").limit(k).select("v").collect()
    return np.array([whole(np.array(r.v)) for r in least], dtype=np.int64)


def packed(rows: DataFrame, width: int) -> DataFrame:
    """(chunk, vec_ids, blocks): up to CHUNK rows, and their components by column block; a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                some = batch.slice(at, CHUNK)
                cells = whole(some.column("v").flatten().to_numpy()).reshape(some.num_rows, -1)
                blocks = [np.ascontiguousarray(cells[:, b : b + width]).tobytes() for b in range(0, cells.shape[1], width)]
                yield pa.record_batch(
                    [pa.array([seen]), pa.array([some.column("vec_id")], pa.list_(pa.int64())), pa.array([blocks], pa.list_(pa.binary()))], ["chunk", "vec_ids", "blocks"]
                )
                seen += 1

    return materialize(rows.mapInArrow(run, "chunk long, vec_ids array<long>, blocks array<binary>"), "lloyd-chunks")


def sharded(chunks: DataFrame) -> DataFrame:
    """(block, chunk, cells), in the order of the blocks: a file has neighbouring chunks of one block or few; stored."""
    parts = max(1, int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = chunks.select(F.posexplode("blocks").alias("block", "cells"), "chunk").select("block", "chunk", "cells")
    return materialize(each.repartitionByRange(parts, "block", "chunk"), "lloyd-shards")


def partial_distances(cells: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of each row of a block to each slice of the centroids."""
    out = np.empty((len(cells), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        apart = cells - c
        out[:, j] = np.einsum("ij,ij->i", apart, apart)
    return out


def assign(shards: DataFrame, centroids: np.ndarray, width: int) -> DataFrame:
    """(chunk, cluster, distance): for each chunk its rows' nearest centroids, the smaller number of equals, packed."""
    k = len(centroids)
    slices = [(b, np.ascontiguousarray(centroids[:, at : at + width]).tobytes()) for b, at in enumerate(range(0, centroids.shape[1], width))]
    slices = shards.sparkSession.createDataFrame(slices, "block int, slices binary")

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, cells, own in zip(*(batch.column(c).to_pylist() for c in ("chunk", "cells", "slices")), strict=True):
                own = np.frombuffer(own, "<i8").reshape(k, -1)
                found = partial_distances(np.frombuffer(cells, "<i4").reshape(-1, own.shape[1]).astype(np.int64), own)
                small = found.astype("<u4") if found.max() < 1 << 32 else found.astype("<u8")
                yield pa.record_batch([pa.array([chunk]), pa.array([small.itemsize], pa.int32()), pa.array([small.tobytes()])], ["chunk", "size", "partial"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, blocks in zip(batch.column("chunk").to_pylist(), batch.column("blocks").to_pylist(), strict=True):
                total = sum(np.frombuffer(b["partial"], f"<u{b['size']}").astype(np.int64) for b in blocks).reshape(-1, k)
                cluster = total.argmin(axis=1)
                distance = total[np.arange(len(total)), cluster]
                yield pa.record_batch([pa.array([chunk]), pa.array([cluster.astype("<i4").tobytes()]), pa.array([distance.astype("<i8").tobytes()])], ["chunk", "cluster", "distance"])

    met = shards.join(F.broadcast(slices), "block").select("chunk", "cells", "slices")
    found = met.mapInArrow(partials, "chunk long, size int, partial binary")
    # One row for each block of a chunk meets here.
    reduced = found.groupBy("chunk").agg(F.collect_list(F.struct("size", "partial")).alias("blocks"))
    return reduced.mapInArrow(nearest, "chunk long, cluster binary, distance binary")


def moved(shards: DataFrame, assigned: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """The centroids after a round; each column block makes its own slice, clusters without vectors keep theirs."""
    k = len(centroids)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}  # by block: for each cluster the sums, and last the count
        for batch in batches:
            for block, cells, cluster in zip(*(batch.column(c).to_pylist() for c in ("block", "cells", "cluster")), strict=True):
                cluster = np.frombuffer(cluster, "<i4")
                cells = np.frombuffer(cells, "<i4").reshape(len(cluster), -1)
                own = total.setdefault(block, np.zeros((k, cells.shape[1] + 1), dtype=np.int64))
                for j in np.unique(cluster):
                    of = cells[cluster == j]
                    own[j, :-1] += of.sum(axis=0, dtype=np.int64)
                    own[j, -1] += len(of)
        for block, own in total.items():
            j = np.flatnonzero(own[:, -1])
            dims = own.shape[1] - 1
            columns = [np.full(len(j) * dims, block, np.int32), np.repeat(j, dims).astype(np.int32), np.tile(np.arange(dims, dtype=np.int32), len(j)), own[j, :-1].ravel(), np.repeat(own[j, -1], dims)]
            yield pa.record_batch([pa.array(c) for c in columns], ["block", "cluster", "place", "s", "n"])

    met = shards.join(assigned.select("chunk", "cluster"), "chunk").select("block", "cells", "cluster")
    added = met.mapInArrow(sums, "block int, cluster int, place int, s long, n long").groupBy("block", "cluster", "place").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    new = centroids.copy()
    for r in added.select((F.col("block") * width + F.col("place")).alias("dim"), "cluster", F.expr("(s - pmod(s, n)) div n").alias("x")).collect():  # k x dims rows at most
        new[r.cluster, r.dim] = r.x
    return new


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dims: int = DIMS, width: int = WIDTH) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the centroids after ``rounds`` rounds)."""
    if k * dims > MOST_CELLS:
        raise ValueError(f"at most {MOST_CELLS} numbers of centroids")
    rows = kept(vectors, dims)
    centroids = first_centroids(rows, k)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), centroids
    chunks = packed(rows, width)
    shards = sharded(chunks)
    for _ in range(rounds):
        centroids = moved(shards, assign(shards, centroids, width), centroids, width)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = [np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in (("cluster", "<i4"), ("distance", "<i8"))]
                yield pa.record_batch([batch.column("vec_ids")[i].values, *map(pa.array, one)], ["vec_id", "cluster", "distance"])

    met = chunks.select("chunk", "vec_ids").join(assign(shards, centroids, width), "chunk")
    labels = met.select("vec_ids", "cluster", "distance").mapInArrow(unpack, "vec_id long, cluster int, distance long")
    return materialize(labels, "lloyd-labels"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, centroids = cluster(table(spark, sf_dir, "embeddings"))
    if not len(centroids):
        return spark.createDataFrame([], RESULT)
    inertia = {r.cluster: int(r.s) for r in labels.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows at most
    total = min(sum(inertia.values()), _MOST_LONG)
    about = [(j, min(s, _MOST_LONG), total, hashlib.sha256(",".join(map(str, centroids[j].tolist())).encode()).hexdigest()) for j, s in inertia.items()]
    about = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return labels.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The query's rows for another engine, every pair of a vector and a centroid compared."""
    apart = "CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    assigned = "SELECT r, min({{'d': {apart}, 'j': j}}) AS m FROM k, c{n} GROUP BY r"
    parts = [
        f"""k AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(greatest(least(floor({SCALE} * CAST(x AS DOUBLE)), {LIMIT}), -{LIMIT}) AS BIGINT)) AS v
             FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})""",
        f"""c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS j, v AS c FROM (SELECT v, sha256(concat('1:', vec_id)) AS h FROM k ORDER BY h, v LIMIT {CLUSTERS}))""",
    ]
    for n in range(ROUNDS):
        parts += [
            f"a{n} AS ({assigned.format(apart=apart, n=n)})",
            f"""s{n} AS (SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT m.j AS j, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM k JOIN a{n} USING (r)) GROUP BY j, i)""",
            f"""c{n + 1} AS (SELECT o.j, coalesce(w.c, o.c) AS c FROM c{n} o LEFT JOIN (SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{n} GROUP BY j) w ON w.j = o.j)""",
        ]
    parts.append(f"z AS ({assigned.format(apart=apart, n=ROUNDS)})")
    return "WITH " + ",\n".join(parts) + f"""
        SELECT vec_id, CAST(m.j AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.j) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
               sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM k JOIN z USING (r) JOIN c{ROUNDS} ON c{ROUNDS}.j = m.j"""


ORACLE = _oracle()
