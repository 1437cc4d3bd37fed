"""Word shingles of whole texts as 64-bit hashes, many texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK = (1 << 18) - 1  # bytes hashed together, small beside a worker's memory (powers of one block fit 2^18); a longer text is a block of its own
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229)
BYTE_CODES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, INVERSE)):
            _POWERS[i] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base))])
    return _POWERS[0], _POWERS[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words in lower-cased UTF-8 bytes.

    A word's hash is its polynomial over the bytes, from prefix sums.
    """
    space = SPACES[block]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
    starts, ends = edge[::2], edge[1::2]
    up, down = powers(len(block) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[LOWER[block]] * up[: len(block)])])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def blocks_of(texts: pa.Array) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Row numbers, joined bytes and the start of each text, block by block."""
    rows: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, value in enumerate(texts):
        raw = (value.as_py() or "").encode("utf-8", "surrogatepass") + b"\n"
        if rows and size + len(raw) > BLOCK:
            yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])
            rows, parts, size = [], [], 0
        rows.append(i)
        parts.append(raw)
        size += len(raw)
    if rows:
        yield rows, np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every text.

    Texts with fewer words than ``width`` have the whole sequence as their one
    shingle; texts without words have an empty set.
    """
    none = np.zeros(0, np.uint64)
    for rows, block, starts in blocks_of(texts):
        words, places = word_hashes(block)
        rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
        for k in range(width):
            rolled = rolled * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(rolled)]
        rolled = mix(rolled)
        bounds = np.searchsorted(places, starts)
        for row, a, z in zip(rows, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a >= width:
                yield row, np.unique(rolled[a : z - width + 1])
            elif z > a:
                h = np.array([z - a], np.uint64)
                for w in range(a, z):
                    h = mix(h * np.uint64(0xA0761D6478BD642F) + words[w : w + 1])
                yield row, h
            else:
                yield row, none
