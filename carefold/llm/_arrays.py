"""Numpy helpers that tasks use on one document or one block at a time."""

from __future__ import annotations

from functools import cache

import numpy as np
import regex
import xxhash

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64


@cache
def _powers(size: int, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(size, base, dtype=U64)
        out[0] = 1
        return np.cumprod(out, dtype=U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    size = 1 << max(12, int(n).bit_length())
    return _powers(size, _BASE)[:n], _powers(size, pow(_BASE, -1, 1 << 64))[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the information of all bits over all bits (the finaliser of splitmix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """Karp-Rabin prefix hashes: entry i covers values[:i]."""
    out = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum(values.astype(U64) * powers(len(values))[0], out=out[1:], dtype=U64)
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, the same wherever the range stands."""
    inverse = powers(len(prefix))[1]
    length = (end - start).astype(U64)
    return mix((prefix[end] - prefix[start]) * inverse[start] + length * U64(0xD6E8FEB86659FD93))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=U64, count=len(words))


def ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The indices start[0], start[0]+1, ... of all ranges, one after the other."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(start - (ends - length), length)


LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3


@cache
def character_classes() -> np.ndarray:
    r"""Class of each code point: \p{L}, \p{N}, white space or other, as the tokenizers' patterns see them."""
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for what, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = what
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
