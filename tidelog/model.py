"""Data model: change rows, options, lookup status, errors."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

PUT, DELETE = 1, 2

#: A change. `seq` is the version: of one key's changes the largest wins.
CHANGES = T.StructType([
    T.StructField("key", T.BinaryType(), False),
    T.StructField("op", T.ByteType(), False),
    T.StructField("value", T.BinaryType(), True),
    T.StructField("seq", T.LongType(), False),
])

OK, DELETED, MISSING = "OK", "NotFound: deleted", "NotFound: not found"


class StoreError(Exception):
    """Any failure of the store."""


class NotFound(StoreError):
    """The key holds no value; str() tells whether it was deleted."""


class InvalidArgument(StoreError):
    """An option, a bound or a batch that cannot be accepted."""


class Corruption(StoreError):
    """Stored data that cannot be what was written."""


class Conflict(StoreError):
    """Another writer published a version first; reopen and retry."""


@dataclass(frozen=True)
class Options:
    """Sizes in bytes. Defaults are those of an embedded store; a cluster raises them."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    write_buffer_size: int = 4 << 20
    block_size: int = 4 << 10
    #: Bytes of run files that reads may keep cached.
    block_cache_size: int = 64 << 20
    #: Sets the false-positive rate of the runs' bloom filters; 0 writes none.
    bloom_bits_per_key: int = 10
    #: Runs that reads may keep cached.
    max_open_files: int = 500
    num_levels: int = 7
    #: More runs than this on level 0 call for a compaction.
    level0_trigger: int = 4
    #: Bytes of a run's data file, which sets the number of range partitions.
    target_file_size: int = 128 << 20
    #: Whether compactions drop tombstones that hide nothing any more.
    drop_tombstones: bool = True
    auto_flush: bool = False
    auto_compact: bool = False

    def __post_init__(self):
        for name in ("write_buffer_size", "block_size", "max_open_files", "target_file_size"):
            if getattr(self, name) < 1:
                raise InvalidArgument(f"{name} must be positive")
        if self.num_levels < 2:
            raise InvalidArgument("num_levels must be at least 2")
        if self.bloom_bits_per_key < 0 or self.block_cache_size < 0 or self.level0_trigger < 1:
            raise InvalidArgument("bloom_bits_per_key, block_cache_size and level0_trigger must not be negative")


@dataclass(frozen=True)
class ReadOptions:
    #: Keep the runs that a read needs in Spark's cache, as far as the options of the
    #: store allow. Off by default: a cached run is scanned whole once.
    fill_cache: bool = False


@dataclass(frozen=True)
class Segment:
    """A committed batch of changes that no run covers yet."""

    number: int
    path: str
    rows: int
    bytes: int
    min_seq: int
    max_seq: int


@dataclass(frozen=True)
class Run:
    """An immutable run, sorted by key, one version a key. Bounds are hex strings."""

    level: int
    number: int
    path: str
    smallest: str
    largest: str
    file_size: int
    entries: int
    tombstones: int
    min_seq: int
    max_seq: int

    def overlaps(self, low: str | None, high: str | None) -> bool:
        """Whether the run's closed key range meets [low, high]; None is unbounded."""
        return not ((high is not None and self.smallest > high) or (low is not None and self.largest < low))


@dataclass(frozen=True)
class Version:
    """One state of a store: what a manifest holds."""

    version: int = 0
    next_number: int = 1
    next_seq: int = 1
    segments: tuple[Segment, ...] = field(default=())
    runs: tuple[Run, ...] = field(default=())
    #: Stream batches already applied, newest id for each stream.
    streams: tuple[tuple[str, int], ...] = field(default=())
