"""Token counts (operator 6): documents and their tokens in flat token files that have no index.

Method: separator scan. A flat file is nothing but ids of a fixed width, each document followed by an end id. Files
are cut into blocks of a fixed size wherever the documents lie; each task scans its blocks for the end id with a
vectorised comparison and keeps the separators' places. A prefix scan over one small row per block (how many
separators, where the last one is) then tells each block how many documents end before it and where the document
that it begins in started, which stitches documents that span blocks, however many.

Defined results: an empty file has no documents; ids after the last separator are a document of their own
(``complete`` is false); a document may have no tokens; a file whose size is no multiple of the width is an error.
For documents that are written first: null and empty texts have no tokens, repeated rows and null doc_ids are
documents like any other, an empty table gives an empty result, extra columns are not written.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carefold.llm._common import materialize, shared_dir, table
from carefold.llm.bpe import ByteBpe

BLOCK_IDS = 1 << 21


def write_flat(docs: DataFrame, bpe: ByteBpe, end_id: int, to: str) -> DataFrame:
    """Write each partition's ids to one flat file under ``to``/flat; returns (file, ordinal, doc_id).

    Ids take 2 bytes, or 4 where the vocabulary or the end id needs it.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(bpe)
    width = id_width(bpe, end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        files, folder = pyarrow.fs.FileSystem.from_uri(f"{to}/flat")
        part = TaskContext.get().partitionId()
        name, attempt = f"part-{part:06d}.ids", f"{folder}/.part-{part:06d}-{uuid.uuid4().hex}"
        end = np.array([end_id], dtype=f"<u{width}").tobytes()
        out, done = None, 0
        for batch in batches:
            if out is None:
                files.create_dir(folder)
                out = files.open_output_stream(attempt)
            for text in batch.column("text"):
                out.write(coder.encode(text.as_py() or "").astype(f"<u{width}").tobytes() + end)
            n = batch.num_rows
            yield pa.record_batch(
                [pa.array([name] * n), pa.array(np.arange(done, done + n)), batch.column("doc_id")], ["file", "ordinal", "doc_id"]
            )
            done += n
        if out is not None:
            out.close()
            files.move(attempt, f"{folder}/{name}")

    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return materialize(chosen.mapInArrow(run, "file string, ordinal long, doc_id long"), "flat-order")


def id_width(bpe: ByteBpe, end_id: int) -> int:
    return 2 if max(len(bpe.id_length) - 1, end_id) < 1 << 16 else 4


def scan_blocks(spark: SparkSession, at: str, end_id: int, width: int, block: int = BLOCK_IDS) -> DataFrame:
    """(file, block, ids, separators): per block of ``block`` ids its size and the separators' places in the file."""
    listed = spark.read.format("binaryFile").load(f"{at}/flat").select(F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    last = F.floor((F.col("length") - 1) / (block * width))
    blocks = listed.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    blocks = blocks.repartition("file", "block")  # so that the blocks of a large file go to many tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(f"{at}/flat")
        for batch in batches:
            for r in batch.to_pylist():
                if r["length"] % width:
                    raise ValueError(f"{r['file']} is not a whole number of ids")
                start = r["block"] * block
                with files.open_input_file(f"{folder}/{r['file']}") as source:
                    ids = np.frombuffer(source.read_at(min(block * width, r["length"] - start * width), start * width), dtype=f"<u{width}")
                places = start + np.flatnonzero(ids == end_id)
                yield pa.record_batch(
                    [pa.array([r["file"]]), pa.array([r["block"]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([places], pa.list_(pa.int64()))],
                    ["file", "block", "ids", "separators"],
                )

    return blocks.mapInArrow(run, "file string, block long, ids long, separators array<long>")


def count_tokens(spark: SparkSession, at: str, end_id: int, width: int, block: int = BLOCK_IDS) -> DataFrame:
    """(file, ordinal, start, n_tokens, complete): the documents of each file under ``at``/flat in order."""
    scanned = materialize(scan_blocks(spark, at, end_id, width, block), "separators")
    summary = scanned.select(
        "file", "block", "ids", F.size("separators").cast("long").alias("n"), F.try_element_at("separators", F.lit(-1)).alias("last")
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = summary.select(
        "file",
        "block",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents"),
        F.coalesce(F.last("last", ignorenulls=True).over(before) + 1, F.lit(0)).alias("begun"),
        F.last("last", ignorenulls=True).over(whole).alias("final"),
        F.sum("ids").over(whole).alias("total"),
        F.sum("n").over(whole).alias("all"),
        F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull().alias("closing"),
    )
    joined = scanned.select("file", "block", "separators").join(carried, ["file", "block"])
    starts = F.concat(F.array("begun"), F.transform("separators", lambda p: p + 1))
    ended = joined.select("file", "documents", F.posexplode(F.arrays_zip(starts.alias("s"), F.col("separators").alias("e"))).alias("i", "d"))
    ended = ended.filter("d.e IS NOT NULL").select(
        "file", (F.col("documents") + F.col("i")).alias("ordinal"), F.col("d.s").alias("start"), (F.col("d.e") - F.col("d.s")).alias("n_tokens"), F.lit(True).alias("complete")
    )
    tail_start = F.coalesce(F.col("final") + 1, F.lit(0))
    tail = carried.filter(F.col("closing") & (tail_start < F.col("total"))).select(
        "file", F.col("all").alias("ordinal"), tail_start.alias("start"), (F.col("total") - tail_start).alias("n_tokens"), F.lit(False).alias("complete")
    )
    return ended.unionByName(tail)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens): tokens of each document, counted in flat files that are written first."""
    import public_tokenizers

    bpe = ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end_id = len(bpe.id_length)
    to = shared_dir(spark, "flat-tokens")
    order = write_flat(table(spark, sf_dir, "documents"), bpe, end_id, to)
    if order.isEmpty():
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"))
    counted = count_tokens(spark, to, end_id, id_width(bpe, end_id))
    return order.join(counted, ["file", "ordinal"], "left").select("doc_id", "n_tokens")
