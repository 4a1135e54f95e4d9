"""A bitmap of 64-bit keys, two bits a key: tells most keys that are not in a table apart without a shuffle.

Its size has a fixed bound whatever the table's size is. A key of the table is always found; others may be, and more
of them the fuller the bitmap is, so whoever uses it joins what it lets through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carefold.llm._arrays import U64, mix

#: Most bits of a bitmap (16 MB), and bits for each key below that.
BITS = 1 << 27
BITS_PER_KEY = 32


class Bitmap:
    def __init__(self, words: np.ndarray):
        self.words = words

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for slot in _slots(keys, len(self.words) << 6):
            found &= (self.words[slot >> U64(6)] >> (slot & U64(63)) & U64(1)).astype(bool)
        return found


def _slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = U64(bits - 1)
    return keys & mask, mix(keys) & mask


def bitmap_of(table: DataFrame, key: str, most: int = BITS) -> Bitmap:
    """The bitmap of column ``key``, longs that are hashes; ``table`` is a stored table, its rows are counted.

    Each task sends the words of the bitmap that it has bits for, and these are aggregated by bitwise or.
    """
    bits = 1 << max(6, min(most.bit_length() - 1, (BITS_PER_KEY * table.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots = np.unique(np.concatenate(_slots(batch.column(0).to_numpy().view(U64), bits)))
            at, value = slots >> U64(6), U64(1) << (slots & U64(63))
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.zeros(0, np.int64)
            value = np.bitwise_or.reduceat(value, first) if len(at) else value
            yield pa.record_batch([pa.array(at[first].view(np.int64)), pa.array(value.view(np.int64))], ["at", "bits"])

    found = table.select(F.col(key)).mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(bits >> 6, dtype=U64)
    words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(U64)
    return Bitmap(words)
