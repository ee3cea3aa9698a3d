"""Whole-batch text work on UTF-8 bytes with numpy: words, their codes, byte n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

#: Bytes worked on at a time; a longer row is worked on in parts of this size.
BLOCK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True

#: All ASCII but letters and digits; bytes of other characters belong to words.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_RNG = np.random.default_rng(20240229)
_TABLE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_RNG.integers(1 << 40, 1 << 62)) * 2 + 1
_STEPS = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs only give equal outputs."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK + 4096)
        tables = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            tables.append(np.cumprod(factors, dtype=np.uint64))
        if size > 4 * BLOCK:  # a rare giant word; don't keep tables for it
            return tables
        _powers[:] = tables
    return _powers


class Words(NamedTuple):
    doc: np.ndarray  # row of each word
    start: np.ndarray  # first byte, counted from the first row's start
    end: np.ndarray
    code: np.ndarray  # 64-bit code of the word's bytes


def spans(buf: np.ndarray, edges: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs without separators; no run crosses an edge."""
    inside = ~separator[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = edges[(edges > 0) & (edges < len(buf))]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def codes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A code for each run, from its bytes after `table`, in parts of bounded size."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + BLOCK)))
        part = table[buf[base : int(ends[j - 1])]]
        up, down = _power_tables(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_TABLE[part] * up[: len(part)], out=sums[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE, table: np.ndarray = LOWER) -> Words:
    """The words of consecutive rows of an Arrow string buffer."""
    buf, edges = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    starts, ends = spans(buf, edges, separator)
    doc = np.searchsorted(edges, starts, side="right") - 1
    return Words(doc, starts, ends, codes(buf, starts, ends, table))


def code_of(word: str) -> int:
    """The code of one word, as words_of gives it."""
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(codes(raw, np.array([0]), np.array([len(raw)]))[0])


def shingle_codes(code: np.ndarray, width: int) -> np.ndarray:
    """A code for each `width` consecutive word codes, in order."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total += mix(code[k : k + n] ^ _STEPS[k]) * _STEPS[k + 8]
    return mix(total)


def grams(buf: np.ndarray, edges: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of each run of `width` bytes within a row, hashed to `bits` bits."""
    n = len(buf) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint32)
    for k in range(width):
        value = (value << np.uint32(8)) | buf[k : k + n]
    value ^= np.uint32(width * 0x9E3779B1 & 0xFFFFFFFF)
    value *= np.uint32(0x85EBCA6B)
    value ^= value >> np.uint32(15)
    value *= np.uint32(0xC2B2AE35)
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    keep = row[:n] == row[width - 1 :]
    return row[:n][keep], (value[keep] >> np.uint32(32 - bits)).astype(np.int64)
