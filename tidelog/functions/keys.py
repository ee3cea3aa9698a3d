"""Keys are byte strings in unsigned byte order, a shorter one before its extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.model import DELETED, MISSING, OK, PUT

def as_bytes(key: bytes | str) -> bytes:
    return key.encode() if isinstance(key, str) else bytes(key)


def literal(key: bytes | str) -> Column:
    """A binary literal, which scans push down."""
    return F.lit(bytearray(as_bytes(key)))


def compare(a: bytes, b: bytes) -> int:
    return (a > b) - (a < b)


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    stem = prefix.rstrip(b"\xff")
    return stem[:-1] + bytes([stem[-1] + 1]) if stem else None


def in_range(column: Column, low: bytes | None, high: bytes | None, closed: bool = False) -> Column:
    """low <= column < high, or <= high if closed; None is unbounded."""
    out = F.lit(True)
    if low is not None:
        out &= column >= literal(low)
    if high is not None:
        out &= (column <= literal(high)) if closed else (column < literal(high))
    return out


def with_prefix(column: Column, prefix: bytes) -> Column:
    """A range, because a range reaches the scan's statistics and startswith does not."""
    return in_range(column, prefix, successor(prefix))


def overlap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Whether two closed ranges meet."""
    return ~((a_low > b_high) | (a_high < b_low))


def remove_prefix(column: Column, count: int) -> Column:
    return F.substring(column, count + 1, 2**31 - 1)


def status_of(op: int | None) -> str:
    """The lookup status by the operation of a key's newest change, if it has one."""
    return MISSING if op is None else OK if op == PUT else DELETED


def status(found: Column, op: Column) -> Column:
    """The lookup status of a key's newest change."""
    return F.when(~found, MISSING).when(op == PUT, OK).otherwise(DELETED)
