"""Token-ID / binary output (operator 4): length-delimited records with masked checksums and an offset index.

Method. A data file is a run of records, each

    length (8 bytes) | masked checksum of these 8 bytes (4) | payload | masked checksum of the payload (4)

all little-endian, and a payload is doc_id (8 bytes, signed), 1 byte that tells whether doc_id is null, 1 byte that
gives the width of an id (2 or 4 bytes), and the ids. A checksum is the CRC-32 of the bytes, rotated right by 15
bits plus a constant, so that checksums of data that hold checksums stay apart. The index is a separate table of
one row per record: file, byte offset, byte length, doc_id, place in the file, ids of the records before it in the
file. It lets a reader fetch records in any order.

Documents are range-partitioned and sorted by doc_id, so files follow each other in ascending doc_id order and a
partition's files are written as it is read. A file is written under a name of its own attempt and renamed when whole,
so a task that is run again after a lost executor leaves the same files. Files and index go to shared storage.

Defined results: a null or empty text has no ids but the end id; the string of a special token that stands in a text
becomes that token's id, as the library has it; null doc_ids come first; rows that repeat a doc_id
are ordered by their text's hash and are records of their own; an empty table gives no files and an empty result;
extra columns are not written.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from carefold.llm._common import shared_dir, table, text_key

END_ID = 2
MEMO_ENTRIES = 500_000

#: Fixed value: what is added to a rotated checksum.
MASK_DELTA = 0xA282EAD8

INDEX = "file string, offset long, size long, doc_id long, place long, before long, n_tokens long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(length)) + payload + struct.pack("<I", masked(payload))


def unframe(data: bytes, offset: int) -> tuple[bytes, int]:
    """(payload, offset of the next record); raises ValueError if a checksum doesn't hold."""
    length = data[offset : offset + 8]
    if len(length) < 8 or struct.pack("<I", masked(length)) != data[offset + 8 : offset + 12]:
        raise ValueError(f"damaged length at byte {offset}")
    start = offset + 12
    end = start + struct.unpack("<Q", length)[0]
    payload = data[start:end]
    if len(payload) < end - start or struct.pack("<I", masked(payload)) != data[end : end + 4]:
        raise ValueError(f"damaged record at byte {offset}")
    return payload, end + 4


def to_payload(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return struct.pack("<qBB", doc_id or 0, doc_id is None, width) + ids.astype(f"<u{width}").tobytes()


def from_payload(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, is_null, width = struct.unpack_from("<qBB", payload)
    return None if is_null else doc_id, np.frombuffer(payload, dtype=f"<u{width}", offset=10).astype("<u4")


class Words:
    """Ids of a piece of text by the tokenizers library, remembered per worker; of bounded size.

    The strings of special tokens are cut out of a text first, as the library does; pieces are then free of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.memo: dict[str, bytes] = {}  # a plain one, as sets look pieces up in it fast
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens must be plain strings that are matched as they stand")
        self.special = {t.content: np.array([i], dtype="<u4").tobytes() for i, t in added.items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.tokenizer.encode_special_tokens = True  # a piece in lower case may look like one and is none
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def _of(self, piece: str) -> bytes:
        if (packed := self.memo.get(piece)) is not None:
            return packed
        ids = self.tokenizer.encode(piece, add_special_tokens=False).ids
        return self._put(piece, np.array(ids, dtype="<u4").tobytes())

    def _put(self, piece: str, packed: bytes) -> bytes:
        if len(self.memo) >= MEMO_ENTRIES:
            self.memo.clear()
        if len(piece) <= 64:
            self.memo[piece] = packed
        return packed

    def learn(self, pieces: list[str], narrow: bool) -> None:
        """Remember the ids of new pieces; those of letters only, in a ``narrow`` text, are words and go as one text."""
        new = set(pieces).difference(self.memo)
        if narrow and (letters := [p for p in new if p.isalpha()]):
            found = self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0]
            ids = np.array(found.ids, dtype="<u4")
            data, at = ids.tobytes(), 0
            for piece, end in zip(letters, ((np.flatnonzero(self.ends_word[ids]) + 1) * 4).tolist(), strict=True):
                self._put(piece, data[at:end])
                at = end
            new = new.difference(letters)
        new = list(new)
        for piece, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self._put(piece, np.array(found.ids, dtype="<u4").tobytes())

    def encode(self, text: str) -> np.ndarray:
        if not any(s in text for s in self.special):
            return np.frombuffer(self._plain(text), dtype="<u4")
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        out.append(self._plain(text[at:]))
        return np.frombuffer(b"".join(out), dtype="<u4")

    def _plain(self, text: str) -> bytes:
        pieces, narrow = split(text)
        self.learn(pieces, narrow)
        try:
            return b"".join(map(self.memo.__getitem__, pieces))
        except KeyError:  # long pieces are not remembered, and others may be forgotten by now
            return b"".join(map(self._of, pieces))


@cache
def words(path: str) -> Words:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    return Words(path)


#: The letters in lower case and the white space among the characters below U+0100.
_LETTERS, _SPACES = "a-zªµºß-öø-ÿ", r"\x09-\x0D\x20\x85\xA0"

_RUNS = re.compile(f"[^{_SPACES}]+")
_PIECES = re.compile(f"[{_LETTERS}]+|[^{_LETTERS}{_SPACES}]+")


def split(text: str) -> tuple[list[str], bool]:
    r"""Pieces of the text that the vocabulary's normaliser and pre-tokenizer treat apart from each other.

    They always cut at white space. Between letters and other characters they cut too, unless an apostrophe
    is near (contractions) or characters compose or change their number in lower case; texts with characters
    from U+0100 on are therefore cut at ASCII white space only. The flag tells that there are none.
    """
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return re.findall(r"[^\x20\x09-\x0D]+", text), False
    low = text.lower()
    if "'" not in low:
        return _PIECES.findall(low), True
    pieces = []
    for run in _RUNS.findall(low):  # a run with an apostrophe stays in one piece
        pieces += [run] if "'" in run else _PIECES.findall(run)
    return pieces, True


def write(docs: DataFrame, vocabulary: str, to: str, end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids to ``to``/data and the index to ``to``/index; returns the index."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = words(vocabulary)
        end = np.array([end_id], dtype="<u4")
        files, folder = pyarrow.fs.FileSystem.from_uri(f"{to}/data")
        part = TaskContext.get().partitionId()
        name, attempt = f"part-{part:06d}.bin", f"{folder}/.part-{part:06d}-{uuid.uuid4().hex}"
        out, offset, place, before = None, 0, 0, 0
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.concatenate([coder.encode(text.as_py() or ""), end])
                record = frame(to_payload(doc_id, ids))
                if out is None:
                    files.create_dir(folder)
                    out = files.open_output_stream(attempt)
                out.write(record)
                rows.append((name, offset, len(record), doc_id, place, before, len(ids)))
                offset, place, before = offset + len(record), place + 1, before + len(ids)
            kinds = (pa.string(), *[pa.int64()] * 6)
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [c.split()[0] for c in INDEX.split(", ")])
        if out is not None:
            out.close()
            files.move(attempt, f"{folder}/{name}")

    # The text is a sort key so that rows which repeat a doc_id have one order, whatever the input's order is, and part of
    # the ranges so that a doc_id with many rows, or a null one, is many tasks' work.
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = chosen.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), text_key(F.col("text")))
    ordered = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), text_key(F.col("text")))
    ordered.mapInArrow(run, INDEX).write.parquet(f"{to}/index")
    return spark.read.schema(INDEX).parquet(f"{to}/index")


def read(index: DataFrame, at: str) -> DataFrame:
    """(file, place, doc_id, before, ids): the records that ``index`` names, in whatever order it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = pyarrow.fs.FileSystem.from_uri(f"{at}/data")
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out = []
            for r in rows:
                if r["file"] != name:
                    name, source = r["file"], files.open_input_file(f"{folder}/{r['file']}")
                payload, _ = unframe(source.read_at(r["size"], r["offset"]), 0)
                doc_id, ids = from_payload(payload)
                out.append((name, r["place"], doc_id, r["before"], ids.tobytes()))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["file", "place", "doc_id", "before", "ids"])

    schema = "file string, place long, doc_id long, before long, ids binary"
    return index.select("file", "offset", "size", "place", "before").mapInArrow(run, schema)


def with_starts(records: DataFrame, index: DataFrame) -> DataFrame:
    """Adds start, the ids of all records before; files follow each other by name.

    The window runs over one row per file, the number of files being the input's size by a file's.
    """
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("_n"))
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("file", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    return records.join(F.broadcast(base), "file").withColumn("start", F.col("_base") + F.col("before")).drop("_base")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = shared_dir(spark, "token-files")
    index = write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), to)
    records = read(index, to)
    out = with_starts(records, index)
    return out.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
