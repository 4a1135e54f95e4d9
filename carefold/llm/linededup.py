r"""Line dedup (operator 10): drop lines that several documents share, but where they stand first.

Method: lines are exploded and normalised (ASCII white space stripped at both ends, A-Z in lower case), keys of at
least ``min_chars`` code points are hashed to 128 bits, and each hash's documents are counted: least and greatest
doc_id differ just where two documents hold it. The aggregation combines map-side, so a line that a third of all
documents hold is one row per task. Lines of repeated keys are then dropped but in the least doc_id, and each
document is put together again from the lines left, by position.

The join of lines with repeated keys uses ``join_with_hot_keys``: very common lines (at most 1,000 keys can be that
common) are broadcast, all others meet in a shuffle. Lines travel as hashes and positions; a text is shuffled once,
to meet the positions to drop.

Defined results: a null or empty text is one empty line and stays empty; rows that repeat a doc_id are one document
in the counts, and keep their own lines; a null doc_id counts as less than any other; an empty table gives an empty
result; extra columns of any name stay in ``dedup``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carefold.llm._common import ASCII_SPACE, join_with_hot_keys, materialize, rows_as, table, text_key

MIN_CHARS = 10

#: Rows whose lines or texts a task holds at a time, beside the batch that they come in.
ROWS = 1024

#: Stands for a null doc_id in comparisons.
NO_ID = -(1 << 63)


def line_keys(text: str, min_chars: int) -> tuple[list[int], list[bytes]]:
    """Positions and 128-bit key hashes of the lines whose key has at least ``min_chars`` code points."""
    at, hashes = [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        key = line.strip(ASCII_SPACE).lower()  # bytes: A-Z only
        if len(key) >= 4 * min_chars or len(key) >= min_chars and len(key.decode()) >= min_chars:
            at.append(i)
            hashes.append(xxhash.xxh3_128_digest(key))
    return at, hashes


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, pos, h): the lines of at least ``min_chars`` code points; h is a 128-bit hash of the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            of, at, hashes = [], [], []
            for i, text in enumerate(batch.column("text")):
                places, found = line_keys(text.as_py(), min_chars)
                of += [i] * len(places)
                at += places
                hashes += found
            rows = pa.array(of, pa.int64())
            yield pa.record_batch(
                [batch.column("doc").take(rows), batch.column("row").take(rows), pa.array(at, pa.int32()), pa.array(hashes, pa.binary())],
                ["doc", "row", "pos", "h"],
            )

    return docs.mapInArrow(run, "doc long, row long, pos int, h binary")


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), text_key(F.col("text")).alias("row"), text.alias("text"))


def drops(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc, row, positions): the positions of the lines to drop, for documents that have any."""
    lines = hashed_lines(_keyed(docs), min_chars)
    per_key = lines.groupBy("h").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.count("*").alias("n"))
    repeated = materialize(per_key.filter("least < most").drop("most"), "repeated-lines")
    total = repeated.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # Shares are of the lines with repeated keys: the others find no partner.
    met = join_with_hot_keys(lines, repeated, "h", "n", total)
    return met.filter("doc > least").groupBy("doc", "row").agg(F.collect_set("pos").alias("positions"))


def _joined(docs: DataFrame, min_chars: int) -> DataFrame:
    """(r, positions): the rows of ``docs`` as structs, and the positions to drop (null: none)."""
    found, rows = drops(docs, min_chars), rows_as(docs)
    same = (F.coalesce(rows["r"]["doc_id"].cast("long"), F.lit(NO_ID)) == found["doc"]) & (text_key(rows["r"]["text"].cast("string")) == found["row"])
    return rows.join(found, same, "left").select("r", "positions")


def _without(text: str | None, positions: list[int] | None) -> tuple[str, int, int]:
    """(text left, lines before, lines dropped)."""
    if not positions:
        return text or "", (text or "").count("\n") + 1, 0
    gone = set(positions)
    lines = (text or "").split("\n")
    return "\n".join(line for i, line in enumerate(lines) if i not in gone), len(lines), len(gone)


def dedup(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs``, all columns, with the repeated lines taken out of text; a text of which nothing is left is empty."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            columns = batch.column("r").flatten()
            texts = columns[at]
            new = [
                t.as_py() if d.as_py() is None else _without(t.as_py(), d.as_py())[0]
                for t, d in zip(texts, batch.column("positions"), strict=True)
            ]
            columns[at] = pa.array(new, texts.type)
            yield pa.record_batch(columns, names)

    return _joined(docs, min_chars).mapInArrow(run, docs.schema)


def digest(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256)."""
    joined = _joined(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), min_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            ids, texts = batch.column("r").flatten()
            out = [_without(t.as_py(), d.as_py()) for t, d in zip(texts, batch.column("positions"), strict=True)]
            yield pa.record_batch(
                [ids, pa.array([n for _, n, _ in out], pa.int64()), pa.array([n for _, _, n in out], pa.int64()),
                 pa.array([hashlib.sha256(t.encode()).hexdigest() for t, _, _ in out], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
firsts AS (
  SELECT k, min(doc_id) AS least FROM keyed WHERE length(k) >= 10
  GROUP BY k HAVING count(DISTINCT doc_id) > 1),
judged AS (
  SELECT keyed.*, coalesce(keyed.doc_id > least, false) AS dropped FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
