"""Substring dedup (operator 2): remove the words covered by repeated windows of consecutive words.

Method: seed and extend.

* Seeds: of every window of ``length`` words, the k-word gram with the least hash (the rightmost of equals) is its
  anchor. Equal windows have equal anchors at equal places, so whatever repeats meets in a join on the anchor.
  An anchor serves a run of neighbouring windows; the words of that run, its *reach*, extend the anchor both ways.
* Extend at once: occurrences of an anchor with the same whole reach form a class. Two or more in a class repeat
  over the full reach. A class is one row however many copies it has, so no pairs are made, and the counts are
  pre-aggregated before they are shuffled.
* Extend word by word: where an anchor has several classes, one row per class is compared window by window with
  the other classes of the anchor, both ways from the anchor; only the windows found again are kept.
* Maximal repeats: overlapping and adjacent repeats of a document are united, and their words removed.

Windows are told apart by the anchor's and the window's 64-bit hashes together. Which anchors need the second
extension the tasks know from a bitmap of at most 16 MB; anchors that it lets through besides change nothing, as their
classes have no window in common or are repeated as a whole. Every step is a shuffle on hashes that the optimiser may
split when skewed.

Defined results: a null text has no words. Repeated rows are documents of their own: their windows repeat, and as the
spans of rows with one doc_id and text are the same, they are one set however many such rows there are. Null
doc_ids are kept and handled like other ids. Documents shorter than a window stay as they are. An empty table
gives an empty result. Extra columns are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._arrays import U64, mix, prefix_sums, range_hash, word_hashes
from carefold.llm._bitmap import Bitmap, bitmap_of
from carefold.llm._common import materialize, table, text_key

WINDOW = 35
GRAM = 8


def words_of(text: str | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+`; bytes.split() cuts at just these characters."""
    return (text or "").encode().split()


def anchors(hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor hash, reach hash, first window, number of windows) per anchor, and the words' prefix hashes."""
    n_windows = len(hashes) - length + 1
    prefix = prefix_sums(hashes)
    at = np.arange(len(hashes) - gram + 1)
    grams = range_hash(prefix, at, at + gram)
    width = length - gram + 1
    views = np.lib.stride_tricks.sliding_window_view(grams[::-1], width)
    owner = len(grams) - 1 - (np.arange(n_windows) + views.argmin(axis=1))[::-1]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.append(first, n_windows))
    reach = range_hash(prefix, first, first + count + length - 1)
    place = (owner[first] - first).astype(U64)  # the anchor's place in its reach
    return grams[owner[first]], mix(reach + place * U64(0x8CB92BA72F3D8DD7)), first, count, prefix


def _occurrences(docs: DataFrame, length: int, gram: int, windows: bool, only: Bitmap | None = None) -> DataFrame:
    """One row per anchor occurrence; with ``windows`` also the hash of each of its windows."""
    spark = docs.sparkSession
    wanted = None if only is None else spark.sparkContext.broadcast(only)
    names = ["doc_id", "row", "anchor", "reach", "first", "n"] + ["windows"] * windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = None if wanted is None else wanted.value
        for batch in batches:
            found, from_row = [], []
            for i, text in enumerate(batch.column("text")):
                words = words_of(text.as_py())
                if len(words) < length:
                    continue
                anchor, reach, first, count, prefix = anchors(word_hashes(words), length, gram)
                if keys is not None:
                    keep = keys.has(anchor)
                    anchor, reach, first, count = anchor[keep], reach[keep], first[keep], count[keep]
                if not len(anchor):
                    continue
                from_row.append(np.full(len(anchor), i))
                part = [anchor.view(np.int64), reach.view(np.int64), first.astype(np.int32), count.astype(np.int16)]
                if windows:
                    starts = np.concatenate([np.arange(s, s + c) for s, c in zip(first, count, strict=True)])
                    part.append(range_hash(prefix, starts, starts + length).view(np.int64))
                found.append(part)
            if not found:
                continue
            rows = pa.array(np.concatenate(from_row))
            columns = [batch.column("doc_id").take(rows), batch.column("row").take(rows)]
            flat = [np.concatenate(x) for x in zip(*found, strict=True)]
            columns += [pa.array(x) for x in flat[:4]]
            if windows:
                ends = np.concatenate([[0], np.cumsum(flat[3], dtype=np.int64)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat[4])))
            yield pa.record_batch(columns, names)

    schema = "doc_id long, row long, anchor long, reach long, first int, n short" + ", windows array<long>" * windows
    return docs.mapInArrow(run, schema)


def repeats(docs: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, row, spans): the repeated stretches, as (first word, end word), of each document that has any.

    ``docs`` has doc_id, row and text; doc_id and row identify a document.
    """
    occurrences = _occurrences(docs, length, gram, windows=False)
    classes = occurrences.groupBy("anchor", "reach").agg(F.count("*").alias("copies"))
    classes = materialize(classes, "substring-classes")

    whole = classes.filter("copies > 1").select("anchor", "reach")
    full = occurrences.join(whole, ["anchor", "reach"]).select(
        "doc_id", "row", F.col("first").alias("start"), (F.col("first") + F.col("n") + (length - 1)).alias("end")
    )

    # Anchors with several classes, one of which has no copy of its whole reach.
    several = classes.groupBy("anchor").agg(F.count("*").alias("n"), F.min("copies").alias("least"))
    several = materialize(several.filter("n > 1 AND least = 1").select("anchor"), "substring-anchors")
    extended = _occurrences(docs, length, gram, windows=True, only=bitmap_of(several, "anchor"))
    one = extended.groupBy("anchor", "reach").agg(
        F.count("*").alias("copies"), F.first(F.struct("doc_id", "row", "first", "windows")).alias("o")
    )
    one = materialize(one.select("anchor", "copies", "o.*"), "substring-extended")
    # The windows of one reach differ from each other: equal windows have their anchor at equal places.
    each = one.select("anchor", "copies", "doc_id", "row", F.posexplode("windows").alias("i", "window"), "first")
    shared = each.groupBy("anchor", "window").agg(F.count("*").alias("times")).filter("times > 1")
    partly = (
        each.filter("copies = 1")
        .join(shared, ["anchor", "window"])
        .select("doc_id", "row", (F.col("first") + F.col("i")).alias("start"), (F.col("first") + F.col("i") + length).alias("end"))
    )
    spans = full.unionByName(partly)
    return spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def covered(n: int, spans: list[dict] | None) -> np.ndarray:
    """Which of n words lie in one of the spans."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for span in spans or ():
        steps[span["start"]] += 1
        steps[span["end"]] -= 1
    return np.cumsum(steps[:n]) > 0


def _with_spans(docs: DataFrame, length: int, gram: int) -> DataFrame:
    keyed = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("row"), F.col("text").cast("string"))
    spans = repeats(keyed, length, gram).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), "spans")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    return keyed.join(spans, same, "left").select("doc_id", "text", "spans")


def dedup(docs: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, text, n_words, n_removed): the words left, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([k.decode() for k, _, _ in out], pa.string()),
                 pa.array([n for _, n, _ in out], pa.int64()), pa.array([r for _, _, r in out], pa.int64())],
                ["doc_id", "text", "n_words", "n_removed"],
            )

    return _with_spans(docs, length, gram).mapInArrow(run, "doc_id long, text string, n_words long, n_removed long")


def _kept(text: str | None, spans: list[dict] | None) -> tuple[bytes, int, int]:
    words = words_of(text)
    if not spans:
        return b" ".join(words), len(words), 0
    gone = covered(len(words), spans)
    kept = [words[i] for i in np.flatnonzero(~gone).tolist()]
    return b" ".join(kept), len(words), len(words) - len(kept)


def digest(docs: DataFrame, length: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256): ``dedup`` with the digest of the words left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_kept(t.as_py(), s.as_py()) for t, s in zip(batch.column("text"), batch.column("spans"), strict=True)]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([n for _, n, _ in out], pa.int64()),
                 pa.array([r for _, _, r in out], pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k, _, _ in out], pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return _with_spans(docs, length, gram).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
