"""The 64-bit key hash of the byte formats, and their bloom filter."""

from __future__ import annotations

from collections.abc import Iterable
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the byte formats.
SEED = 1469598103934665603
PRIME = 1099511628211
WORD, HALF = (1 << 64) - 1, (1 << 32) - 1


def hash64(data: bytes, seed: int = SEED) -> int:
    """Each byte is mixed in by xor and a multiplication modulo 2^64."""
    state = seed
    for byte in data:
        state = (state ^ byte) * PRIME & WORD
    return state


def hash64_all(keys: list[bytes]) -> np.ndarray:
    """The hashes of many keys: one pass for each byte position, the longest keys first,
    so the keys that still have a byte there are a prefix."""
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    flat, start = np.frombuffer(b"".join(keys), np.uint8).astype(np.uint64), np.cumsum(size) - size
    order = np.argsort(-size, kind="stable")
    start, state = start[order], np.full(len(keys), SEED, np.uint64)
    live = np.searchsorted(-size[order], -np.arange(1, int(size.max(initial=0)) + 1), side="right")
    for at, n in enumerate(live):
        state[:n] = (state[:n] ^ flat[start[:n] + at]) * np.uint64(PRIME)
    out = np.empty_like(state)
    out[order] = state
    return out


@F.pandas_udf(T.LongType())
def _signed(keys: pd.Series) -> pd.Series:
    found = hash64_all([b"" if k is None else bytes(k) for k in keys]).view(np.int64)
    return pd.Series(found, dtype="Int64").mask(keys.isna())


def hash64_column(column: str | Column) -> Column:
    """The hash as an unsigned decimal, for columns of binary keys; null stays null."""
    signed = _signed(column).cast("decimal(20,0)")
    return F.when(signed < 0, signed + F.lit(Decimal(1 << 64))).otherwise(signed).cast("decimal(20,0)")


def probes(bits_per_key: int) -> int:
    """Probes per key: 0.69 of the bits per key, rounded down, from 1 to 30."""
    return min(30, max(1, int(bits_per_key * 0.69)))


def positions(keys: list[bytes], bits: int, count: int) -> np.ndarray:
    """Probe positions, a row for each key, by double hashing; the stride is the hash
    rotated by 17 bits, cut to 32."""
    state = hash64_all(keys)
    stride = (state >> np.uint64(17) | state << np.uint64(15)) & np.uint64(HALF)
    steps = np.arange(count, dtype=np.uint64)
    return ((state[:, None] + stride[:, None] * steps) % np.uint64(bits) & np.uint64(HALF)).astype(np.int64)


def bloom_build(keys: Iterable[bytes], bits_per_key: int = 10) -> bytes:
    """Filter bytes, and in the last byte the number of probes."""
    keys = list(keys)
    size = (max(64, len(keys) * bits_per_key) + 7) // 8
    field, count = np.zeros(size * 8, bool), probes(bits_per_key)
    field[positions(keys, size * 8, count)] = True
    return np.packbits(field, bitorder="little").tobytes() + bytes([count])


def bloom_may_contain_all(filter_: bytes, keys: list[bytes]) -> np.ndarray:
    """False only for keys that were not added; a filter too short to hold one says maybe."""
    if len(filter_) < 2 or filter_[-1] == 0:
        return np.ones(len(keys), bool)
    field = np.unpackbits(np.frombuffer(filter_[:-1], np.uint8), bitorder="little")
    return field[positions(keys, len(field), filter_[-1])].all(axis=1)


def bloom_may_contain(filter_: bytes, key: bytes) -> bool:
    return bool(bloom_may_contain_all(filter_, [key])[0])
