"""Recall: the k rows whose vectors are most like a query's, by comparison with all rows or by an index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carefold.storage import materialize

#: Queries that meet a batch of rows at a time, and rows of such a batch.
BLOCK = 256
ROWS = 4096


def dot(a: Column, b: Column) -> Column:
    """The inner product of two arrays of numbers, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is null, of length zero or not as long as the other."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def top_k(vectors: DataFrame, query: list[float], k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, similarity): the ``k`` most similar rows, ties by id; rows without a similarity never come.

    The query is a literal in the plan, each partition keeps its own best k, and only these meet.
    """
    asked = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_column).alias("id"), cosine(F.col(vector_column), asked).alias("similarity"))
    return scored.filter("similarity IS NOT NULL").orderBy(F.desc("similarity"), "id").limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, id, similarity): for each row of ``queries`` its ``k`` most similar rows of ``vectors``, ties by id.

    Every pair is compared, the row itself included; ids are longs and not null. Queries are grouped into blocks of
    about BLOCK, each pair of a block and a part of the rows is one task's work and gives the block's best k there;
    these meet in a shuffle on the query.
    """

    def grouped(rows: DataFrame, size: int, name: str) -> DataFrame:
        n = max(1, -(-rows.count() // size))
        return _packed(_plain(rows, id_column, vector_column).withColumn(name, F.pmod(F.xxhash64("id"), F.lit(n))), name)

    pairs = grouped(queries, BLOCK, "block").crossJoin(grouped(vectors, ROWS, "part"))
    return _best_of(pairs.repartition("block", "part"), k)


def _plain(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, vector) of the rows that have both."""
    rows = rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    return rows.filter("id IS NOT NULL AND vector IS NOT NULL")


def _packed(rows: DataFrame, *key: str) -> DataFrame:
    """The rows of each key as one array, named after the last column of the key."""
    return rows.groupBy(*key).agg(F.collect_list(F.struct("id", "vector")).alias(f"{key[-1]}_rows"))


def _best_of(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, similarity): the best ``k`` of each query over all its pairs of a block of queries and a part of the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part in zip(batch.column("block_rows"), batch.column("part_rows"), strict=True):
                yield best(block.values, part.values)

    def best(block: pa.StructArray, part: pa.StructArray) -> pa.RecordBatch:
        out: list[tuple] = []
        ids = part.field("id").to_numpy()
        by_size: dict[int, list[int]] = {}
        for i, n in enumerate(part.field("vector").value_lengths().to_pylist()):
            by_size.setdefault(n, []).append(i)
        matrices = {}
        for n, at in by_size.items():
            rows = np.array([part.field("vector")[i].as_py() for i in at], dtype=np.float64).reshape(len(at), n)
            norms = np.einsum("ij,ij->i", rows, rows)
            matrices[n] = rows, norms, ids[at]
        for query_id, vector in zip(block.field("id").to_pylist(), block.field("vector").to_pylist(), strict=True):
            if len(vector) not in matrices:
                continue
            rows, norms, of = matrices[len(vector)]
            asked = np.array(vector, dtype=np.float64)
            with np.errstate(all="ignore"):
                norm = np.sqrt(norms * (asked @ asked))
                found = np.where(norm > 0, np.einsum("ij,j->i", rows, asked) / norm, np.nan)
            fit = np.flatnonzero(~np.isnan(found))
            first = fit[np.lexsort((of[fit], -found[fit]))[:k]]
            out += zip([query_id] * len(first), of[first].tolist(), found[first].tolist(), strict=True)
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "id", "similarity"])

    near = pairs.select("block_rows", "part_rows").mapInArrow(run, "query_id long, id long, similarity double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
    return near.withColumn("place", place).filter(F.col("place") <= k).drop("place")


# An inverted-file index.

#: Numbers of the sample that centroids are fitted on (64 MB), at most so many centroids, and rows of the sample for each.
SAMPLE_CELLS = 1 << 24
MOST_CELLS, PER_CELL = 4096, 8
ROUNDS = 8
#: Rows of the sample that are asked for, and the share of their neighbours there that the probed cells must have.
ASKED, TARGET = 200, 0.95


def unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Centroids of unit vectors by a few rounds of spherical k-means; the first are spread evenly over the rows."""
    of = sample[np.linspace(0, len(sample) - 1, cells).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ of.T, axis=1)
        total = np.zeros_like(of)
        np.add.at(total, own, sample)
        has = np.bincount(own, minlength=cells) > 0
        of[has] = unit(total[has])
    return of


def probes_for(sample: np.ndarray, of: np.ndarray, k: int) -> int:
    """How many cells must be looked at for TARGET of the neighbours of rows of the sample. In all rows the neighbours are
    nearer than in a sample, so it takes no more there."""
    own = np.argmax(sample @ of.T, axis=1)
    asked = sample[:: max(1, len(sample) // ASKED)]
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ of.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)  # of each cell in the order of probing
    needed = np.take_along_axis(place, own[near], axis=1)
    share = [(needed < p).mean() for p in range(1, len(of) + 1)]
    return 1 + int(np.argmax(np.array(share) >= TARGET)) if share and max(share) >= TARGET else len(of)


class Index:
    """Rows by cells of like direction: a query looks at the cells nearest to it and at all rows of these.

    Centroids are fitted on a sample of bounded size (rows whose id's hash is divisible by a number), every row is
    assigned, and similarities of what is looked at are exact. A cell's rows are packed into parts of about ROWS, so a
    cell of any size is many tasks' work. Defined results: as in ``top_k_each``; vectors of another length than the
    sample's most frequent one, or of length zero, are in no cell and are never found.
    """

    def __init__(self, vectors: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding", cells: int | None = None):
        self.columns = id_column, vector_column
        rows = _plain(vectors, id_column, vector_column)
        n = rows.count()
        dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
        self.dims = dims[0].d if dims else 0
        rows = rows.filter((F.size("vector") == self.dims) & (dot(F.col("vector"), F.col("vector")) > 0))
        every = max(1, -(-n * max(1, self.dims) // SAMPLE_CELLS))
        sampled = rows.filter(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select(F.xxhash64("id", F.lit(1)).alias("o"), "id", "vector")
        sample = sampled.orderBy("o", "id").toArrow().column("vector").combine_chunks()
        sample = unit(sample.flatten().to_numpy().reshape(-1, max(1, self.dims)))
        cells = max(1, min(MOST_CELLS, len(sample) // PER_CELL, int(n**0.5))) if cells is None else cells
        self.of = fit_cells(sample, cells) if len(sample) else np.zeros((0, max(1, self.dims)))
        self.probes = probes_for(sample, self.of, k) if len(sample) else 0
        self.k = k
        placed = materialize(self._placed(rows, 1), "index-rows")
        parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).alias("parts"))  # a row for each cell
        dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        self.rows = materialize(_packed(dealt, "cell", "part"), "index-parts")

    def _placed(self, rows: DataFrame, probes: int) -> DataFrame:
        """(cell, id, vector): each row with its nearest cells."""
        shared = rows.sparkSession.sparkContext.broadcast(self.of)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = shared.value
            for batch in batches:
                if not batch.num_rows or not len(of):
                    continue
                near = unit(batch.column("vector").flatten().to_numpy().reshape(-1, of.shape[1])) @ of.T
                cell = np.argsort(-near, axis=1, kind="stable")[:, :probes]
                row = pa.array(np.repeat(np.arange(len(cell)), cell.shape[1]))
                yield pa.record_batch([pa.array(cell.ravel().astype(np.int32)), batch.column("id").take(row), batch.column("vector").take(row)], ["cell", "id", "vector"])

        return rows.mapInArrow(run, "cell int, id long, vector array<double>")

    def search(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query_id, id, similarity): the best of each query in the cells that it looks at."""
        asked = _plain(queries, *self.columns).filter((F.size("vector") == self.dims) & (dot(F.col("vector"), F.col("vector")) > 0))
        placed = self._placed(asked, self.probes if probes is None else probes)
        n = max(1, -(-asked.count() // BLOCK))
        blocks = _packed(placed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n))), "cell", "block")
        return _best_of(blocks.join(self.rows, "cell").repartition("cell", "block", "part"), self.k)


def found_share(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, neighbours, found): how many of each query's exact neighbours were found."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    return exact.join(hit, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("neighbours"), F.count("hit").alias("found"))
