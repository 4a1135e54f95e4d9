r"""SimHash near-dedup (operator 5): fingerprints linked at a few differing bits, and their components.

Method: a Gray-order hierarchical index. Fingerprints are sorted by their rank in the reflected Gray code, so that
neighbours share most bits. Runs of neighbours become nodes that keep the bits all of them agree on (a mask and
a value); runs of nodes become upper nodes in the same way. Two nodes are compared on the bits both have fixed: the
differences add up on the way down, and a pair of groups is dropped as a whole once they exceed the limit.

Distribution: two fingerprints within ``limit`` bits agree on one of ``limit + 1`` blocks of bits. Each distinct
fingerprint goes, once per block, to the group of those with equal bits there, and each group gets an index of
its own. Groups hold distinct 64-bit numbers only (copies of a text are one number). A group of more than MAX_GROUP is
split exactly: two of its members within the limit agree on one of ``limit + 1`` blocks of the bits that the group
leaves open, too, so its members go on, once per such block, to groups that agree on more bits. What is still
larger after LEVELS blocks (one dense family) is cut into slices, and each two slices meet in a group of their own. So
no task ever holds more than a bounded group, and the work per fingerprint stays flat as their number grows.

Two nodes all of whose members are already connected are not compared again. Each group returns at most one link per
fingerprint, to the least of its component there; links meet in a distributed connected-components loop (large star,
small star) that writes its state to shared storage.

Defined results: null and empty texts have fingerprint zero and link like any other; repeated rows are rows
of one component; the component of null doc_ids is the least non-null doc_id reachable, null if there is none;
an empty table gives an empty result; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._arrays import U64
from carefold.llm._common import join_with_hot_keys, materialize, rows_as, sliced, table

SHINGLE = 4
LIMIT = 4
SEED = 42

#: Children of a node of the index.
FAN = 16
#: Groups of more fingerprints are searched piece by piece, so that what is connected already is skipped.
LARGE = 1024
#: Rows of complete groups that a task indexes at a time, and pairs of members that it may expand at a time.
CHUNK = 1_000_000
PAIRS = 1 << 22
#: Larger groups are split by further blocks of bits, up to so many blocks, and then into slices of half this size.
MAX_GROUP = 8192
LEVELS = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The hashes of the text's word shingles, repeats included; a text of fewer words is one shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, dtype=U64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    spans = zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in spans], dtype=U64)


def fold(hashes: np.ndarray) -> int:
    """The number whose bit b is set if it is in over half of the hashes; zero of none."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of the text's word shingles."""
    return fold(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(t.as_py(), shingle) for t in batch.column("text")], dtype=U64)
            yield pa.record_batch([batch.column("doc_id"), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """The place of each number in the reflected Gray code."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp ^ (fp >> U64(s))
    return fp


def unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the least member of each component) after linking a[i] and b[i]."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return labels
        a, b = a[apart], b[apart]
        low = np.minimum(la, lb)[apart]
        np.minimum.at(labels, la[apart], low)
        np.minimum.at(labels, lb[apart], low)
        while (up := labels[labels] != labels).any():
            labels[up] = labels[labels[up]]


class GrayIndex:
    """The hierarchical index over groups of fingerprints sorted by group and Gray rank."""

    def __init__(self, group: np.ndarray, fp: np.ndarray):
        self.fp = fp
        both, some, of = fp, fp, group
        self.levels = [(np.full(len(fp), ~U64(0)), fp, np.arange(len(fp)))]  # mask, value, first child
        while len(of) > 1 and (of[1:] == of[:-1]).any():
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            size = np.diff(np.append(begin, len(of)))
            place = np.arange(len(of)) - np.repeat(begin, size)
            first = np.flatnonzero(place % FAN == 0)
            both = np.bitwise_and.reduceat(both, first)
            some = np.bitwise_or.reduceat(some, first)
            mask = ~(both ^ some)
            self.levels.append((mask, both & mask, first))
            of = of[first]

    def bounds(self, labels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per level the least and greatest label under each node."""
        out = [(labels, labels)]
        for _, _, first in self.levels[1:]:
            low, high = out[-1]
            out.append((np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)))
        return out

    def links(self, level: int, a: np.ndarray, b: np.ndarray, limit: int, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of entries under the node pairs (a, b), a <= b, within ``limit`` bits and not yet connected."""
        bounds = self.bounds(labels)
        while True:
            mask, value, first = self.levels[level]
            differ = np.bitwise_count((value[a] ^ value[b]) & mask[a] & mask[b])
            low, high = bounds[level]
            known = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
            keep = (differ <= limit) & ~known
            a, b = a[keep], b[keep]
            if level == 0:
                return a, b
            n_below = len(self.levels[level - 1][0])
            last = np.append(first[1:], n_below)
            wide = last - first
            count = wide[a] * wide[b]
            pair = np.repeat(np.arange(len(a)), count)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)
            x = first[a[pair]] + at // wide[b[pair]]
            y = first[b[pair]] + at % wide[b[pair]]
            same = a[pair] == b[pair]
            once = ~same | (x <= y)
            a, b, level = x[once], y[once], level - 1


def link_groups(group: np.ndarray, fp: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, the least of its component in its group) for those that have another one's."""
    order = np.lexsort((gray_rank(fp), group))
    group, fp = group[order], fp[order]
    index = GrayIndex(group, fp)
    labels = np.arange(len(fp))
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, len(group)))
    # Neighbours in Gray order that are near are connected before anything is searched.
    near = np.flatnonzero((group[1:] == group[:-1]) & (np.bitwise_count(fp[1:] ^ fp[:-1]) <= limit))
    labels = unite(labels, near, near + 1)
    # Small groups: all at once, from their roots.
    top = len(index.levels) - 1
    roots = np.arange(len(index.levels[top][0]))
    small = roots[size <= LARGE]
    done = np.cumsum(size[small] ** 2) // PAIRS
    for part in np.split(small, np.flatnonzero(np.diff(done)) + 1):
        labels = unite(labels, *index.links(top, part, part, limit, labels))
    # Large groups: each node of the third level against itself and those after it, connecting in between.
    for g in np.flatnonzero(size > LARGE).tolist():
        level = min(2, top)
        nodes = np.array([begin[g], begin[g] + size[g]])
        for _, _, first in index.levels[1 : level + 1]:
            nodes = np.searchsorted(first, nodes)
        for node in range(nodes[0], nodes[1]):
            later = np.arange(node, nodes[1])
            for part in np.array_split(later, max(1, len(later) // 256)):
                labels = unite(labels, *index.links(level, np.full(len(part), node), part, limit, labels))
    least = fp.view(np.int64).copy()
    np.minimum.at(least, labels, fp.view(np.int64))
    least = least[labels]
    other = least != fp.view(np.int64)
    return fp.view(np.int64)[other], least[other]


def _finer(mask: int, limit: int) -> list[int]:
    """``mask`` with each of limit + 1 blocks of its open bits added in turn."""
    free = [b for b in range(64) if not mask >> b & 1]
    edges = [len(free) * i // (limit + 1) for i in range(limit + 2)]
    return [mask | sum(1 << b for b in free[s:e]) for s, e in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _groups(nodes: DataFrame, limit: int) -> DataFrame:
    """(g, fp): groups that have each two fingerprints within the limit in common; g is a hash, so that two groups
    may fall together, which only adds to what is compared."""

    def dealt(rows: DataFrame, masks: list[int]) -> DataFrame:
        finer = F.create_map(*[x for m in masks for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in _finer(m, limit)]))])
        rows = rows.select("fp", F.explode(F.element_at(finer, F.col("mask"))).alias("mask"))
        return rows.withColumn("g", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))))

    masks, out = [0], []
    rows = nodes.select("fp", F.lit(0).cast("long").alias("mask"))
    for level in range(LEVELS):
        rows = dealt(rows, masks)
        masks = [f for m in masks for f in _finer(m, limit)]
        sizes = rows.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > MAX_GROUP)
        large = materialize(sizes.withColumn("of", F.col("n")), "simhash-large")
        if large.isEmpty():
            return _union([*out, rows])
        met = materialize(join_with_hot_keys(rows, large, "g", "n", rows.count()), "simhash-groups")
        out.append(met.filter("of IS NULL"))
        rows = met.filter("of IS NOT NULL")
    out.append(sliced(rows, "g", "of", "fp", MAX_GROUP))
    return _union(out)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0].select("g", "fp")
    for part in parts[1:]:
        out = out.unionByName(part.select("g", "fp"))
    return out


def links(nodes: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(u, v): links between the distinct fingerprints of ``nodes`` (fp) that give their components."""
    dealt = _groups(nodes, limit).repartition("g").sortWithinPartitions("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), dtype=np.int64)
        for batch in batches:
            held = np.concatenate([held, np.stack([batch.column("g").to_numpy(), batch.column("fp").to_numpy()])], axis=1)
            if held.shape[1] >= CHUNK and (held[0] != held[0, -1]).any():
                whole = int(np.searchsorted(held[0], held[0, -1]))
                yield linked(held[:, :whole])
                held = held[:, whole:]
        yield linked(held)

    def linked(rows: np.ndarray) -> pa.RecordBatch:
        u, v = link_groups(rows[0], np.ascontiguousarray(rows[1]).view(U64), limit) if rows.shape[1] else (rows[0], rows[1])
        return pa.record_batch([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(u, root): for each node of ``edges`` (u, v) but the roots themselves, the least node connected to it.

    A node that a large share of all edges has, such as the centre of a star, is joined as a hot key.
    """
    edges = materialize(edges, purpose)
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges.select("u", F.col("v").alias("root"))
        state = now
        # Large star: every larger neighbour of u links to the least of u and its neighbours.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        least = materialize(least, purpose)
        large = join_with_hot_keys(both.filter("v > u"), least, "u", "n", 2 * now[0])
        large = materialize(large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), purpose)
        # Small star: u and its smaller neighbours link to the least of these.
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = materialize(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), purpose)
        small = join_with_hot_keys(down, least, "u", "n", large.count())
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), purpose)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the least doc_id reachable over links."""
    prints = materialize(fingerprints(docs, shingle), "simhash")
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "simhash-nodes")
    roots = components(links(nodes.select("fp"), limit), "simhash-links")
    rooted = nodes.join(roots.withColumnRenamed("u", "fp"), "fp", "left")
    rooted = materialize(rooted.withColumn("root", F.coalesce("root", "fp")), "simhash-roots")
    per_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
    per_root = materialize(per_root, "simhash-components")
    answer = join_with_hot_keys(rooted.drop("least"), per_root, "root", "m", nodes.count())
    answer = materialize(answer.select("fp", "n", "component_id"), "simhash-answer")
    return join_with_hot_keys(prints, answer, "fp", "n", prints.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its component; rows that repeat one doc_id all stay."""
    groups = near_duplicates(docs, shingle, limit)
    firsts = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    rows = rows_as(docs)
    return rows.join(firsts, rows["r"]["doc_id"].cast("long").eqNullSafe(firsts["first"]), "left_semi").select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
