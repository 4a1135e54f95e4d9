r"""Byte-level BPE encoding and decoding (operator 1).

Method: two tiers. A minimal perfect hash over the vocabulary resolves, for all pre-tokens of a text at once,
those that are a vocabulary entry as a whole; what it misses is merged with a heap of candidate pairs over a
linked list of bytes. Results of the second tier are remembered per worker in a table of bounded size.

The vocabulary (50,000 entries or so: its size does not depend on the data) goes to the executors with the task.
There is no shuffle: each row is encoded where it is read.

Defined results: a null text is the empty text; the empty text has no ids; rows are independent, so repeated
rows, null doc_ids and extra columns are kept as they are (extra columns are dropped by ``encode``'s projection).
Lone surrogates cannot occur in Spark strings. Texts of any length work: the heap makes a long run of letters
cost n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carefold.llm._arrays import (
    LETTER, SPACE, U64, character_classes, code_points, mix, prefix_sums, ragged, range_hash,
)

#: Second-tier results remembered by a worker; when full it starts anew.
MEMO_ENTRIES = 1_000_000

#: The suffixes that the pre-token pattern splits off after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


class PerfectHash:
    """Minimal perfect hash by hash-and-displace: key -> slot 0..n-1, checked against the stored key's bytes."""

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        hashes = np.array([hash_bytes(k) for k in keys], dtype=U64)
        if len(np.unique(hashes)) != n:
            raise ValueError("two keys share a hash")
        self.buckets = max(1, n * 2 // 3)
        bucket = ((hashes >> U64(33)) % U64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(cuts)
        self.shift = np.zeros(self.buckets, dtype=np.int64)
        slot_of = np.full(n, -1, dtype=np.int64)
        taken = np.zeros(n, dtype=bool)
        for b in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)].tolist():
            group = order[cuts[b] : cuts[b + 1]]
            for d in range(0, 1 << 30, 32):
                slots = self._slots(hashes[group][None, :], np.arange(d, d + 32, dtype=U64)[:, None], n)
                ordered = np.sort(slots, axis=1)
                fits = np.flatnonzero(~taken[slots].any(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1))
                if len(fits):
                    slot_of[group] = slots[fits[0]]
                    taken[slots[fits[0]]] = True
                    self.shift[b] = d + fits[0]
                    break
        # Single keys go straight to the slots that are left.
        alone = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(~taken)
        slot_of[order[cuts[alone]]] = left
        self.shift[alone] = -1 - left
        by_slot = np.argsort(slot_of)
        self.n = n
        self.hashes = hashes[by_slot]
        self.values = np.array(values, dtype=np.uint32)[by_slot]
        ordered = [keys[i] for i in by_slot]
        self.lengths = np.array([len(k) for k in ordered], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.blob = np.frombuffer(b"".join(ordered), dtype=np.uint8)

    @staticmethod
    def _slots(hashes: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
        return (mix(hashes + shift * U64(0xA0761D6478BD642F)) % U64(n)).astype(np.int64)

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each range of data: is it a key, and its value if so."""
        shift = self.shift[((hashes >> U64(33)) % U64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -1 - shift, self._slots(hashes, np.maximum(shift, 0).astype(U64), self.n))
        hit = np.flatnonzero((self.hashes[slot] == hashes) & (self.lengths[slot] == end - start))
        length = (end - start)[hit]
        same = data[ragged(start[hit], length)] == self.blob[ragged(self.starts[slot[hit]], length)]
        wrong = np.add.reduceat(~same, np.cumsum(length) - length) if len(hit) else np.zeros(0)
        found = np.zeros(len(start), dtype=bool)
        found[hit[wrong == 0]] = True
        return found, self.values[slot]


def hash_bytes(key: bytes) -> int:
    prefix = prefix_sums(np.frombuffer(key, dtype=np.uint8))
    return int(range_hash(prefix, np.array([0]), np.array([len(key)]))[0])


def merge_with_heap(data: bytes, ranks: dict[bytes, int], two: list[int]) -> list[int]:
    """Merge the pair of least rank, leftmost first, until none is in the vocabulary; n log n for n bytes.

    The part at i is data[i:after[i]]; pair[i] is the rank of that part joined with the next, -1 if it has none.
    ``two`` has the ranks of all pairs of bytes.
    """
    n = len(data)
    bits = n.bit_length()
    at = (1 << bits) - 1
    get, push, pop = ranks.get, heapq.heappush, heapq.heappop
    pair = [two[a << 8 | b] for a, b in zip(data, data[1:])]  # noqa: B905
    pair.append(-1)
    heap = [rank << bits | i for i, rank in enumerate(pair) if rank >= 0]
    heapq.heapify(heap)
    after = list(range(1, n + 1))
    before = list(range(-1, n))
    while heap:
        top = pop(heap)
        i = top & at
        if pair[i] != top >> bits:  # one of its parts was merged meanwhile
            continue
        j = after[i]
        k = after[i] = after[j]
        pair[j] = -1
        before[k] = i
        if k < n and (rank := get(data[i : after[k]], -1)) >= 0:
            push(heap, rank << bits | i)
            pair[i] = rank
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            rank = pair[h] = get(data[h:k], -1)
            if rank >= 0:
                push(heap, rank << bits | h)
    out, i = [], 0
    while i < n:
        j = after[i]
        out.append(ranks[data[i:j]])
        i = j
    return out


class Memo(dict):
    """Second-tier results by piece, packed; of bounded size."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.two = [ranks.get(bytes((a, b)), -1) for a in range(256) for b in range(256)]

    def __missing__(self, piece: bytes) -> bytes:
        ids = merge_with_heap(piece, self.ranks, self.two)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= MEMO_ENTRIES:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


def pretokens(text: str) -> tuple[np.ndarray, np.ndarray]:
    r"""Byte offsets (start, end) of the matches of the public byte-BPE pattern.

    The pattern's alternatives are: an apostrophe with one of SUFFIXES; letters, numbers or other characters,
    each with one space before them; white space up to the last one before a word; the white space left.
    """
    cps = code_points(text)
    n = len(cps)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = character_classes()[cps]
    first = np.empty(n + 1, dtype=bool)
    first[0] = first[n] = True
    np.not_equal(kind[1:], kind[:-1], out=first[1:n])
    # The last white space before a word: a plain space goes with the word, another one stands alone.
    word_start = np.flatnonzero(first[1:n] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    first[word_start - 1] = True
    first[word_start[cps[word_start - 1] == 0x20]] = False
    # An apostrophe that starts a match and is followed by a suffix.
    for i in np.flatnonzero((cps[:-1] == 0x27) & (kind[1:] == LETTER)).tolist() if n > 1 else ():
        if first[i]:
            for suffix in SUFFIXES:
                if text.startswith(suffix, i + 1):
                    first[i + 1] = False
                    first[i + 1 + len(suffix)] = True
                    break
    cuts = np.flatnonzero(first)
    if not text.isascii():
        width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
        cuts = np.concatenate([[0], np.cumsum(width)])[cuts]
    return cuts[:-1], cuts[1:]


class ByteBpe:
    """The encoder and decoder of one vocabulary of byte strings and ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.whole = PerfectHash(list(ranks), list(ranks.values()))
        self.memo = Memo(ranks)
        size = max(ranks.values()) + 1
        by_id = [b""] * size
        for piece, i in ranks.items():
            by_id[i] = piece
        self.id_length = np.array([len(p) for p in by_id], dtype=np.int64)
        self.id_start = np.concatenate([[0], np.cumsum(self.id_length)[:-1]])
        self.id_bytes = np.frombuffer(b"".join(by_id), dtype=np.uint8)

    def __reduce__(self) -> tuple:
        return _restored, ({k: v for k, v in self.__dict__.items() if k != "memo"},)

    @classmethod
    def from_file(cls, path: str) -> ByteBpe:
        """Reads lines of base64 piece and rank."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)})

    def encode(self, text: str) -> np.ndarray:
        raw = text.encode()
        start, end = pretokens(text)
        if not len(start):
            return np.zeros(0, dtype="<u4")
        data = np.frombuffer(raw, dtype=np.uint8)
        found, value = self.whole.find(data, start, end, range_hash(prefix_sums(data), start, end))
        missed = np.flatnonzero(~found)
        pieces = [raw[s:e] for s, e in zip(start[missed].tolist(), end[missed].tolist(), strict=True)]
        parts = list(map(self.memo.__getitem__, pieces))
        count = np.ones(len(start), dtype=np.int64)
        count[missed] = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) // 4
        place = np.cumsum(count) - count
        out = np.empty(int(count.sum()), dtype="<u4")
        out[place[found]] = value[found]
        out[ragged(place[missed], count[missed])] = np.frombuffer(b"".join(parts), dtype="<u4")
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        i = ids.astype(np.int64)
        return self.id_bytes[ragged(self.id_start[i], self.id_length[i])].tobytes()


def _restored(state: dict) -> ByteBpe:
    out = ByteBpe.__new__(ByteBpe)
    out.__dict__.update(state, memo=Memo(state["ranks"]))
    return out


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType())])


def encode(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, ids): each text's token ids as little-endian unsigned 32-bit integers."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)  # a vocabulary: its size is fixed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            ids = [coder.encode(t.as_py() or "").tobytes() for t in batch.column("text")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, IDS)


def decode(encoded: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, decoded): the bytes that each row's ids stand for; null ids give no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            out = [coder.decode(np.frombuffer(x.as_py() or b"", dtype="<u4")) for x in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """Encode, then decode the ids; per row the digests of both, so that neither leaves the task."""
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        for batch in batches:
            n, sha, back = [], [], []
            for t in batch.column("text"):
                ids = coder.encode(t.as_py() or "")
                n.append(len(ids))
                sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(coder.decode(ids)).hexdigest())
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = ByteBpe.from_file(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), bpe)
