"""One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more (a pipeline stage).

Method: SimHash first, then an exact set-similarity join by prefixes for what it can't see. At a Jaccard similarity of
0.8, fingerprints of 64 bits differ in about 10 bits and often in 15: no limit that an index can search finds all such
pairs and no others. So the Gray-order index of ``simhash`` links the fingerprints that differ in a few bits, which
gives each document a leader, the least set of its group. A fingerprint counts a shingle as often as it stands in the
text, so documents are compared to their leaders by their shingles with repeats, too: such near copies (a passage many
times over, with another end) are found by SimHash alone, as the join compares sets. The join then finds every pair of
similar sets that is left. Shingles get
one order for all documents, rare before common. Two sets at 0.8 or more share a shingle among the first
``n - ceil(0.8 n) + 1`` of either, so only those meet in a shuffle, and every pair found there is compared by its whole
sets. The order of common shingles comes from a bounded sample; it decides how many pairs meet, never which are found.

Before whole sets are compared, pairs are dropped by a bound that holds always: each set has a sketch of which
residues it hits an odd number of times, of about as many bits as shingles, and two sketches differ in no more places
than their sets (the longer one is folded to the other's size). Shingles of what is left are cut anew from the texts
that a bitmap lets through, so that neither shingles nor texts are stored or shuffled for all documents.

Families of near copies would meet in all their pairs. So each set is first compared to its leader by SimHash and to
two more, one of each shingle being such. Of what meets again only pairs that are not connected by then and pass the
bound in the task are compared.

Defined results: as in ``simhash.one_of_each``; texts of fewer words than a shingle are one shingle, texts without
words are copies of each other. Near copies are two documents whose sets are similar, or one and its leader by SimHash
whose shingles with repeats are; of documents with equal sets the least doc_id stands for all in the latter. Shingles
and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carefold.llm import simhash
from carefold.llm._arrays import U64, mix, ragged
from carefold.llm._bitmap import bitmap_of
from carefold.llm._common import join_with_hot_keys, materialize, rows_as, sliced, text_key

SHINGLE = 5
#: The least similarity of near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Documents whose shingles are counted, and how many of the most common shingles are put last.
SAMPLE = 20_000
COMMON = 100_000
#: The least number of bits of a sketch; a set of n shingles has 2 ** k of them, n or more.
BITS = 256
#: Pairs that a task holds at a time, and longs of their sketches.
PAIRS, CELLS = 1 << 20, 1 << 23
#: Rows of a key that a task compares at a time; larger keys are cut into slices, each two of which meet.
MAX_GROUP = 20_000


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the text's distinct word shingles."""
    return np.unique(simhash.shingle_hashes(text, SHINGLE).view(np.int64))


def prefix(grams: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set, one of which any similar set has among its own first ones; ``common`` is sorted."""
    if not len(grams):
        return grams
    a, b = SIMILAR
    of = np.zeros(len(grams), dtype=np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        of = np.where(common[at] == grams, rank[at], 0)
    return grams[np.lexsort((grams, of))[: len(grams) + (-a * len(grams)) // b + 1]]


def sketch(grams: np.ndarray) -> np.ndarray:
    bits = max(BITS, 1 << max(0, len(grams) - 1).bit_length())
    odd = np.bincount(grams & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _folded(a: Column, n: Column) -> Column:
    """A sketch of ``n`` longs made of a longer one: residues that fall together add up."""
    more = F.sequence(F.lit(1), (F.size(a) / n).cast("int") - 1)
    added = F.aggregate(more, F.slice(a, 1, n), lambda s, i: F.zip_with(s, F.slice(a, i * n + 1, n), lambda x, y: x.bitwiseXOR(y)))
    return F.when(F.size(a) <= n, a).otherwise(added)


def maybe_similar(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """By the sizes of two sets and by their sketches."""
    p, q = SIMILAR
    size = F.least(F.size(a), F.size(b))
    differ = F.aggregate(F.zip_with(_folded(a, size), _folded(b, size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return (q * n_a >= p * n_b) & (q * n_b >= p * n_a) & ((p + q) * differ <= (q - p) * (n_a + n_b))


def similar(a: Column, b: Column) -> Column:
    p, q = SIMILAR
    return (p + q) * F.size(F.array_intersect(a, b)) >= p * (F.size(a) + F.size(b))


def repeats(every: np.ndarray) -> np.ndarray:
    """A number for each time but the first that a shingle stands in a text, the same in all texts."""
    gram, n = np.unique(every, return_counts=True)
    gram, n = gram[n > 1], n[n > 1] - 1
    nth = ragged(np.ones(len(n), dtype=np.int64), n)
    return mix(np.repeat(gram, n) ^ mix(nth.astype(U64))).view(np.int64)


def similar_with_repeats(a: Column, b: Column, more_a: Column, more_b: Column) -> Column:
    p, q = SIMILAR
    both = F.size(F.array_intersect(a, b)) + F.size(F.array_intersect(more_a, more_b))
    return (p + q) * both >= p * (F.size(a) + F.size(b) + F.size(more_a) + F.size(more_b))


def set_id(grams: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(grams.tobytes(), simhash.SEED)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of a sample, sorted, and their counts there; those met once in a batch do not count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingles(t.as_py()) for t in batch.column("text")]
            gram, n = np.unique(np.concatenate([np.zeros(0, np.int64), *rows]), return_counts=True)
            yield pa.record_batch([pa.array(gram[n > 1]), pa.array(n[n > 1])], ["gram", "n"])

    every = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).select(F.col("text").cast("string"))
    counted = sample.repartition(4).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    rows = counted.orderBy(F.desc("n"), "gram").limit(COMMON).collect()
    gram, n = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
    order = np.argsort(gram)
    return gram[order], n[order]


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, tk, sid, n, prefix, sketch, fp): sid names the set, tk the text, fp is the fingerprint."""
    common = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, n, first, drawn, fp = [], [], [], [], []
            for text in batch.column("text"):
                every = simhash.shingle_hashes(text.as_py(), SHINGLE)
                grams = np.unique(every.view(np.int64))
                fp.append(simhash.fold(every))
                sid.append(set_id(grams))
                n.append(len(grams))
                first.append(prefix(grams, *common.value))
                drawn.append(sketch(grams))
            sid = np.array(sid, dtype=U64).view(np.int64)
            columns = [batch.column("doc_id"), batch.column("tk"), pa.array(sid), pa.array(n, pa.int64()), _lists(first), _lists(drawn), pa.array(np.array(fp, dtype=U64).view(np.int64))]
            yield pa.record_batch(columns, ["doc_id", "tk", "sid", "n", "prefix", "sketch", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text").cast("string")).alias("tk"))
    return rows.mapInArrow(run, "doc_id long, tk long, sid long, n long, prefix array<long>, sketch array<long>, fp long")


def _grams(docs: DataFrame, sets: DataFrame, sids: DataFrame) -> DataFrame:
    """(sid, grams, more) of the sets named in ``sids``, and maybe of some others; more are the repeats of a set's least document."""
    one = sets.select("sid", "doc_id", "tk").join(sids, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "tk")).alias("at"))
    named = materialize(one.select(F.xxhash64("at.doc_id", "at.tk").alias("name")), "near-ids")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap_of(named, "name"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = np.flatnonzero(shared.value.has(batch.column("name").to_numpy().view(U64)))
            every = [simhash.shingle_hashes(batch.column("text")[i].as_py(), SHINGLE) for i in wanted.tolist()]
            grams = [np.unique(h.view(np.int64)) for h in every]
            sid = np.array([set_id(g) for g in grams], dtype=U64).view(np.int64)
            at = [batch.column(c).take(pa.array(wanted)) for c in ("doc_id", "tk")]
            yield pa.record_batch([pa.array(sid), *at, _lists(grams), _lists([repeats(h) for h in every])], ["sid", "doc_id", "tk", "grams", "more"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), text_key(F.col("text").cast("string")).alias("tk"))
    rows = rows.withColumn("name", F.xxhash64("doc_id", "tk")).mapInArrow(run, "sid long, doc_id long, tk long, grams array<long>, more array<long>")
    least = rows.groupBy("sid").agg(F.min_by(F.struct("grams", "more"), F.struct("doc_id", "tk")).alias("r"))
    return materialize(least.select("sid", "r.*"), "near-grams")


def _meetings(keyed: DataFrame) -> DataFrame:
    """(key, sid, n, lead, lead_n): the sets that share a key, with one of them that leads; another leads under another
    key. A task goes through its sorted rows and holds a key's leader only."""
    dealt = keyed.withColumn("mixed", F.xxhash64("sid", "key")).repartition("key").sortWithinPartitions("key", "mixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.zeros((5, 0), dtype=np.int64)  # key, sid, n of the last row, and sid and n of its leader
        for batch in batches:
            key, sid, n = (np.concatenate([before[i], batch.column(c).to_numpy()]) for i, c in enumerate(("key", "sid", "n")))
            first = np.concatenate([[True], key[1:] != key[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(key)), 0))
            lead, lead_n = sid[at], n[at]
            held = before.shape[1]
            if held:
                same = at == 0
                lead[same], lead_n[same] = before[3, 0], before[4, 0]
            again = ~first & np.concatenate([[False], sid[1:] != sid[:-1]])
            rows = np.flatnonzero(again)
            if len(rows):
                leaders = rows[np.unique(key[rows], return_index=True)[1]]  # a leader counts once another has come
                yield pa.record_batch(
                    [pa.array(np.concatenate([x[rows], y[leaders]])) for x, y in ((key, key), (sid, lead), (n, lead_n), (lead, lead), (lead_n, lead_n))],
                    ["key", "sid", "n", "lead", "lead_n"],
                )
            before = np.array([[key[-1]], [sid[-1]], [n[-1]], [lead[-1]], [lead_n[-1]]]) if len(key) else before

    return dealt.mapInArrow(run, "key long, sid long, n long, lead long, lead_n long")


class Sketches:
    """Sketches of different sizes, one after the other."""

    def __init__(self, column: pa.ListArray):
        self.flat = column.flatten().to_numpy().view(U64)  # bits of negative numbers are counted by their absolute value
        self.size = column.value_lengths().to_numpy().astype(np.int64)
        self.start = np.cumsum(self.size) - self.size

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """In how many places the sketches a[i] and b[i] differ, the longer one folded."""
        out = np.zeros(len(a), dtype=np.int64)
        sizes = self.size[a] << 32 | self.size[b]
        for both in np.unique(sizes).tolist():
            p, q = both >> 32, both & 0xFFFFFFFF
            of = np.flatnonzero(sizes == both)
            for some in np.array_split(of, max(1, len(of) * max(p, q) // CELLS)):
                x, y = (self._cut(i[some], size, min(p, q)) for i, size in ((a, p), (b, q)))
                out[some] = np.bitwise_count(x ^ y).sum(axis=1)
        return out

    def _cut(self, rows: np.ndarray, size: int, to: int) -> np.ndarray:
        cells = self.flat[self.start[rows][:, None] + np.arange(size)]
        return np.bitwise_xor.reduce(cells.reshape(len(rows), size // to, to), axis=1)


def _apart(rows: DataFrame) -> DataFrame:
    """(u, v): the pairs that share their key, have no common root yet and may be similar by their sizes and sketches.

    ``rows`` have key, root, sid, n and sketch, at most MAX_GROUP of them for a key; a task holds one key's at a time.
    """
    dealt = rows.select("key", "root", "sid", "n", "sketch").repartition("key").sortWithinPartitions("key", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            if held and held[-1].column("key")[0].as_py() != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield from _pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            elif not held and key[0] != key[-1]:
                cut = int(np.searchsorted(key, key[-1]))
                yield from _pairs(pa.Table.from_batches([batch.slice(0, cut)]))
            else:
                cut = 0
            held.append(batch.slice(cut))
        if held:
            yield from _pairs(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "u long, v long")


def _pairs(of: pa.Table) -> Iterator[pa.RecordBatch]:
    p, q = SIMILAR
    of = of.combine_chunks()
    key, root, sid, n = (of.column(c).to_numpy() for c in ("key", "root", "sid", "n"))
    drawn = Sketches(of.column("sketch").combine_chunks())
    new = key[1:] != key[:-1]
    end = np.append(np.flatnonzero(new) + 1, len(key))
    run = np.append(np.flatnonzero(new | (root[1:] != root[:-1])) + 1, len(key))
    end = np.repeat(end, np.diff(np.concatenate([[0], end])))
    after = np.repeat(run, np.diff(np.concatenate([[0], run])))
    count = end - after  # each row meets those behind its own run
    rows = np.flatnonzero(count)
    while len(rows):
        take = max(1, int(np.searchsorted(np.cumsum(count[rows]), PAIRS, "right")))
        some, rows = rows[:take], rows[take:]
        a = np.repeat(some, count[some])
        b = np.arange(len(a)) - np.repeat(np.cumsum(count[some]) - count[some], count[some]) + after[a]
        near = np.flatnonzero((q * n[a] >= p * n[b]) & (q * n[b] >= p * n[a]))
        a, b = a[near], b[near]
        near = np.flatnonzero((p + q) * drawn.differ(a, b) <= (q - p) * (n[a] + n[b]))
        u, v = sid[a[near]], sid[b[near]]
        yield pa.record_batch([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])


def _similar_pairs(docs: DataFrame, sets: DataFrame, pairs: DataFrame, sketches: DataFrame, led: DataFrame | None = None) -> DataFrame:
    """The pairs (u, v) whose sets are similar, and those of ``led`` (u, v) whose shingles with repeats are, too."""

    def of(rows: DataFrame, side: str) -> DataFrame:
        return rows.select(*[F.col(c).alias(side if c == "sid" else f"{c}_{side}") for c in rows.columns])

    drawn = pairs.join(of(sketches, "v"), "v").join(of(sketches, "u"), "u")
    maybe = drawn.filter(maybe_similar(F.col("sketch_u"), F.col("sketch_v"), F.col("n_u"), F.col("n_v")))
    maybe = maybe.select("u", "v", F.lit(False).alias("led"))
    if led is not None:
        maybe = maybe.unionByName(led.select("u", "v", F.lit(True).alias("led"))).groupBy("u", "v").agg(F.max("led").alias("led"))
    maybe = materialize(maybe, "near-maybe")
    grams = _grams(docs, sets, maybe.select(F.explode(F.array("u", "v")).alias("sid")).distinct())
    both = maybe.join(of(grams, "v"), "v").join(of(grams, "u"), "u")
    repeated = F.col("led") & similar_with_repeats(*[F.col(f"{c}_{side}") for c in ("grams", "more") for side in "uv"])
    return both.filter(similar(F.col("grams_u"), F.col("grams_v")) | repeated).select("u", "v")


def _simhash_leaders(sets: DataFrame) -> DataFrame:
    """(sid, lead): the least set among those whose fingerprints the Gray-order index connects.

    A set's fingerprint is that of its least document.
    """
    prints = materialize(sets.groupBy("sid").agg(F.min(F.struct("doc_id", "tk", "fp")).alias("at")).select("at.fp", "sid"), "near-prints")
    nodes = materialize(prints.groupBy("fp").agg(F.min("sid").alias("least")), "near-nodes")
    linked = simhash.components(simhash.links(nodes.select("fp")), "near-links").withColumnRenamed("u", "fp")
    rooted = materialize(nodes.join(linked, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "near-groups")
    least = materialize(rooted.groupBy("root").agg(F.min("least").alias("lead"), F.count("*").alias("n")), "near-leaders")
    led = join_with_hot_keys(rooted.select("fp", "root"), least, "root", "n", rooted.count())
    return prints.join(led.select("fp", "lead"), "fp").select("sid", "lead").filter("sid <> lead").distinct()


def roots(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, root): for the sets that have similar ones, the least of those connected; ``sets`` as _sets gives them."""
    met = materialize(_meetings(sets.select(F.explode("prefix").alias("key"), "sid", "n")), "near-met")
    met_sets = met.select("key", "sid", "n").distinct()
    sketches = sets.select("sid", "n", "sketch").join(met.select("sid").distinct(), "sid", "left_semi").dropDuplicates(["sid"])
    sketches = materialize(sketches, "near-sketches")
    p, q = SIMILAR
    led = met.filter("sid <> lead").filter((q * F.col("n") >= p * F.col("lead_n")) & (q * F.col("lead_n") >= p * F.col("n")))
    led = led.groupBy("sid").agg(F.min("lead").alias("a"), F.max("lead").alias("b"))
    led = led.select("sid", F.explode(F.array_distinct(F.array("a", "b"))).alias("lead"))
    pairs, by_prints = (x.select(F.greatest("sid", "lead").alias("u"), F.least("sid", "lead").alias("v")).filter("u <> v").distinct() for x in (led, _simhash_leaders(sets)))
    found = _similar_pairs(docs, sets, pairs, sketches, by_prints)
    known = materialize(simhash.components(found, "near-links").withColumnRenamed("u", "sid"), "near-known")
    rooted = met_sets.join(known, "sid", "left").select("key", F.coalesce("root", "sid").alias("root"), "sid", "n")
    rooted = materialize(rooted, "near-rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("of")).filter("a <> b").select("key", "of")
    drawn = rooted.join(several, "key").join(sketches.select("sid", "sketch"), "sid")
    apart = _apart(sliced(drawn, "key", "of", "sid", MAX_GROUP))
    second = _similar_pairs(docs, sets, apart.distinct(), sketches)
    links = known.select(F.col("sid").alias("u"), F.col("root").alias("v")).unionByName(second)
    return simhash.components(links, "near-links")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least among its near copies; rows that repeat one doc_id all stay."""
    sets = materialize(_sets(docs), "near-sets")
    least = sets.groupBy("sid").agg(F.min("doc_id").alias("least"))
    rooted = least.join(roots(docs, sets).withColumnRenamed("u", "sid"), "sid", "left")
    firsts = rooted.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("least").alias("first")).select("first").distinct()
    rows = rows_as(docs)
    return rows.join(firsts, rows["r"]["doc_id"].cast("long").eqNullSafe(firsts["first"]), "left_semi").select("r.*")
