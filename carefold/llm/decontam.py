"""Benchmark decontamination (operator 8): greedy string tiling of documents against test items.

Method. Word grams that a document shares with an item are seeds. For each document and item that may share enough,
the longest match is marked first, again and again: a match covers words that no earlier match has taken, in the
document and in the item; of equally long ones the first in the document goes first, then the first in the item.
Matches of a length are found by running Karp-Rabin hashes over the windows that are still free, and the longest
length by halving. The share of an item's words that its tiles cover is the test: at ``threshold`` or more the
document is contaminated. Tiles may come in any order, so reordered passages are caught like straight ones.

Distribution. Items never go through the driver. Their grams are a table; a bitmap of it (two bits a gram, at most
BITS in all whatever the benchmark's size, by a bitwise-or aggregation) goes to the tasks that read the documents,
once and without a shuffle. A document keeps the stretches of words whose grams are in the bitmap; most keep nothing.
The kept grams meet the items' grams in a shuffle; grams and items that a large share of documents hold are salted.
A document that covers enough of an item must share some of its rarer grams, so the grams common to many items
make no pairs by themselves. What meets is streamed to the document's stretches, one item at a time. The work for a
pair grows with the places of shared grams in the document and the item, not with their product. Equal items
are one.

Words are runs of characters without ASCII white space and punctuation, in lower case. Defined results: a null or
empty text has no matches; an item of fewer words than a gram is a gram as a whole; an item without words matches
nothing; rows that repeat both doc_id and text are one document; null item_ids are items like any other; equal items each match; an
empty corpus or benchmark leaves everything clean; ``clean`` keeps extra columns of any name, others are not read.
Grams, words and items are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carefold.llm._arrays import U64, prefix_sums, ragged, range_hash, word_hashes
from carefold.llm._bitmap import BITS, Bitmap, bitmap_of
from carefold.llm._common import join_salted, join_with_hot_keys, materialize, rows_as, table, text_key

GRAM = 5
THRESHOLD = 0.5

#: Stands between stretches of a document; no word's hash.
GAP = U64(0)

#: Fixed value: ASCII punctuation, each turned into a space.
_TO_SPACE = bytes(0x20 if c < 0x80 and not (chr(c).isalnum()) else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_TO_SPACE).split()


def gram_hashes(hashes: np.ndarray, gram: int) -> np.ndarray:
    at = np.arange(max(0, len(hashes) - gram + 1))
    return range_hash(prefix_sums(hashes), at, at + gram)


class Side:
    """One of two word sequences that are tiled: which words are free, and the hashes of free windows."""

    def __init__(self, words: np.ndarray):
        self.prefix = prefix_sums(words)
        self.taken = np.zeros(len(words) + 1, dtype=np.int64)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of n free words."""
        before = np.concatenate([[0], np.cumsum(self.taken[:-1])])
        at = np.flatnonzero(before[n:] == before[: len(before) - n])
        return at, range_hash(self.prefix, at, at + n)

    def is_free(self, at: int, n: int) -> bool:
        return not self.taken[at : at + n].any()

    def take(self, at: int, n: int) -> None:
        self.taken[at : at + n] = 1


def tiles(doc: np.ndarray, item: np.ndarray, gram: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of two sequences of word hashes: (place in doc, place in item, length), longest first."""
    a, b = Side(doc), Side(item)
    out: list[tuple[int, int, int]] = []

    def meet(n: int) -> bool:
        return bool(np.isin(b.windows(n)[1], a.windows(n)[1]).any())

    most = min(len(doc), len(item))
    while most >= gram and meet(gram):
        low = gram
        while low < most:  # the longest length at which windows meet; shorter ones meet there too
            middle = (low + most + 1) // 2
            low, most = (middle, most) if meet(middle) else (low, middle - 1)
        out += _mark(a, b, low)
        most = low - 1
    return out


def _mark(a: Side, b: Side, n: int) -> list[tuple[int, int, int]]:
    """Take all matches of n words, n being the longest length of any."""
    at, hashes = a.windows(n)
    places: dict[int, list[int]] = {}
    for j, h in zip(*(x[::-1].tolist() for x in b.windows(n)), strict=True):
        places.setdefault(h, []).append(j)  # the first is last
    known = np.isin(hashes, np.array(list(places), dtype=U64))
    out, free_from = [], 0
    for i, h in zip(at[known].tolist(), hashes[known].tolist(), strict=True):
        if i < free_from:
            continue
        left = places[h]
        while left and not b.is_free(left[-1], n):
            left.pop()
        if left:
            j = left.pop()
            a.take(i, n)
            b.take(j, n)
            out.append((i, j, n))
            free_from = i + n
    return out


class Stretches:
    """What a document may share with any item, and its grams in order of their hashes."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self.by_size:
            found = gram_hashes(self.words, size)
            order = np.argsort(found, kind="stable")
            self.by_size[size] = found[order], order
        return self.by_size[size]

    def cover(self, item: np.ndarray, gram: int, need: int) -> tuple[int, int] | None:
        """(words of the item that tiles cover, longest tile); None if fewer than ``need`` can be covered."""
        size = min(gram, len(item))
        own = gram_hashes(item, size)
        hashes, order = self.grams(size)
        low, high = (np.searchsorted(hashes, own, side=s) for s in ("left", "right"))
        hit = np.flatnonzero(high > low)
        if np.count_nonzero(_spread(hit, size, len(item))) < need:
            return None
        _, once = np.unique(own[hit], return_index=True)
        at = np.sort(order[ragged(low[hit][once], (high - low)[hit][once])])
        found = tiles(_cut_out(self.words, _spread(at, size, len(self.words))), item, size)
        covered = sum(n for _, _, n in found)
        return (covered, found[0][2]) if covered >= need else None


def _spread(at: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in a gram that starts at one of ``at``."""
    steps = np.zeros(n + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + size, -1)
    return np.cumsum(steps[:n]) > 0


def _cut_out(words: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """The words to keep, with a GAP wherever others stood between them."""
    at = np.flatnonzero(keep)
    if not len(at):
        return words[:0]
    gap = np.flatnonzero(np.diff(at) > 1) + 1
    return np.insert(words[at], gap, GAP)


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, words) for each distinct sequence of words, and (item, item_id) for those that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [word_hashes(words_of(t.as_py())) for t in batch.column("text")]
            key = [range_hash(prefix_sums(w), np.array([0]), np.array([len(w)])).view(np.int64)[0] if len(w) else None for w in words]
            yield pa.record_batch(
                [pa.array(key, pa.int64()), batch.column("item_id"), pa.array([w.tobytes() for w in words], pa.binary())], ["item", "item_id", "words"]
            )

    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "item long, item_id long, words binary")
    rows = materialize(rows.filter("item IS NOT NULL"), "benchmark-items")
    return rows.select("item", "words").dropDuplicates(["item"]), rows.select("item", "item_id")


def _item_grams(items: DataFrame, gram: int, threshold: float) -> DataFrame:
    """(gram, item, size, places, spare): the grams of each item; any ``spare`` places may be left out as seeds.

    A tile of n words has n - size + 1 >= n / size grams, so tiles over ``need`` words have need / size grams at least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, data in zip(batch.column("item").to_pylist(), batch.column("words"), strict=True):
                words = np.frombuffer(data.as_py(), dtype=U64)
                size = min(gram, len(words))
                found, places = np.unique(gram_hashes(words, size), return_counts=True)
                spare = max(0, -(-_need(len(words), threshold) // size) - 1)
                n = len(found)
                yield pa.record_batch(
                    [pa.array(found.view(np.int64)), pa.array(np.full(n, item)), pa.array(np.full(n, size, np.int32)), pa.array(places.astype(np.int32)),
                     pa.array(np.full(n, spare, np.int64))],
                    ["gram", "item", "size", "places", "spare"],
                )

    return items.mapInArrow(run, "gram long, item long, size int, places int, spare long")


def _need(n_words: int, threshold: float) -> int:
    """The least number of words that are ``threshold`` of an item, and one at least."""
    need = max(1, math.floor(threshold * n_words) - 1)
    while need / n_words < threshold:
        need += 1
    return need


def _seeds(grams: DataFrame) -> DataFrame:
    """(gram, item): what a document that covers enough of an item must share one of; the most common are left out."""
    items_of = materialize(grams.groupBy("gram").agg(F.count("*").alias("n_items")), "gram-counts")
    counted = join_with_hot_keys(grams, items_of.withColumn("n", F.col("n_items")), "gram", "n", grams.count())
    order = Window.partitionBy("item").orderBy(F.desc("n_items"), "gram").rowsBetween(Window.unboundedPreceding, 0)
    return counted.withColumn("so_far", F.sum("places").over(order)).filter("so_far > spare").select("gram", "item")


def _stretches(docs: DataFrame, bitmap: Bitmap, sizes: list[int]) -> DataFrame:
    """(doc, row, words, grams): the documents that have grams in the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            of, words, grams = [], [], []
            for i, text in enumerate(batch.column("text")):
                own = word_hashes(words_of(text.as_py()))
                keep, met = np.zeros(len(own), bool), []
                for size in sizes:
                    found = gram_hashes(own, size)
                    hit = np.flatnonzero(known.has(found))
                    if len(hit):
                        keep |= _spread(hit, size, len(own))
                        met.append(found[hit])
                if met:
                    of.append(i)
                    words.append(_cut_out(own, keep).tobytes())
                    grams.append(np.unique(np.concatenate(met)).view(np.int64))
            ends = np.cumsum([0] + [len(g) for g in grams]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *grams])))
            at = pa.array(of, pa.int64())
            yield pa.record_batch([batch.column("doc").take(at), batch.column("row").take(at), pa.array(words, pa.binary()), listed], ["doc", "row", "words", "grams"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), text_key(F.col("text").cast("string")).alias("row"), F.col("text").cast("string"))
    return keyed.mapInArrow(run, "doc long, row long, words binary, grams array<long>").dropDuplicates(["doc", "row"])


def _tiled(stretches: DataFrame, pairs: DataFrame, gram: int, threshold: float) -> DataFrame:
    """(doc, row, item, coverage, longest) for the pairs that reach the threshold.

    A document's stretches come first and its items after them, one row each: a task holds one document at a time.
    """
    both = stretches.select("doc", "row", F.lit(None).cast("long").alias("item"), "words").unionByName(pairs.select("doc", "row", "item", "words"))
    dealt = both.repartition("doc", "row").sortWithinPartitions("doc", "row", F.asc_nulls_first("item"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Stretches(np.zeros(0, U64))
        for batch in batches:
            out = []
            for doc, row, item, data in zip(*(batch.column(c) for c in ("doc", "row", "item", "words")), strict=True):
                words = np.frombuffer(data.as_py(), dtype=U64)
                if not item.is_valid:
                    held = Stretches(words)
                elif found := held.cover(words, gram, _need(len(words), threshold)):
                    out.append((doc.as_py(), row.as_py(), item.as_py(), found[0] / len(words), found[1]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
            yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], ["doc", "row", "item", "coverage", "longest"])

    return dealt.mapInArrow(run, "doc long, row long, item long, coverage double, longest long")


def matches(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(doc, row, item, coverage, longest) for each document and distinct item that reach the threshold, and the
    (item, item_id) that have it. row tells documents of one doc_id apart by their texts; ``threshold`` is above 0."""
    items, members = _items(benchmark)
    items = materialize(items, "benchmark-distinct")
    grams = materialize(_item_grams(items, gram, threshold), "benchmark-grams")
    sizes = sorted(r[0] for r in grams.select("size").distinct().collect())  # numbers up to ``gram``
    stretches = materialize(_stretches(docs, bitmap_of(grams, "gram", bits), sizes), "document-stretches")
    met = materialize(stretches.select("doc", "row", F.explode("grams").alias("gram")), "document-grams")
    pairs = materialize(join_salted(met, _seeds(grams), "gram").select("doc", "row", "item").distinct(), "document-items")
    found = _tiled(stretches.select("doc", "row", "words"), join_salted(pairs, items, "item"), gram, threshold)
    return materialize(found, "document-tiles"), members


def report(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, coverage, longest): the contaminated documents with each item that they hold."""
    found, members = matches(docs, benchmark, gram, threshold)
    return join_salted(found, members, "item").select(F.col("doc").alias("doc_id"), "item_id", "coverage", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    bad = matches(docs, benchmark, gram, threshold)[0].select("doc", "row").distinct()
    keyed = rows_as(docs).withColumn("key", text_key(F.col("r.text").cast("string")))
    same = keyed["r"]["doc_id"].cast("long").eqNullSafe(bad["doc"]) & (keyed["key"] == bad["row"])
    return keyed.join(bad, same, "left_anti").select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contaminated document: the items it holds, in order, and the largest coverage."""
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"), F.max("longest").alias("longest")
    )
