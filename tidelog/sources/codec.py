"""The byte formats of log and table files, for reading and writing such files.

All integers are little-endian. A varint has seven bits a byte, low bits first, the top
bit set on all but the last byte.

log record  varint payload length, payload (type byte, varint key length, varint value
            length, key, value), u32 checksum: the low half of the payload's hash
data block  entries: varint key length, varint value length + 1, key, type byte, value
index       entries: varint key length, first key, u64 block offset, u64 block size
footer      u64 index offset and size, u64 filter offset and size, u32 version, u32
            padding, u64 magic; 48 bytes
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.functions.hashing import HALF, bloom_build, bloom_may_contain, hash64
from tidelog.model import Corruption

# Fixed values of the format.
MAGIC = 0xDB4775248B80FB57
VERSION = 1
FOOTER = struct.Struct("<QQQQIIQ")

LOG_SCHEMA = "segment string, pos long, op byte, key binary, value binary"
TABLE_SCHEMA = "path string, key binary, op byte, value binary"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    """(value, position after it); Corruption if the bytes end first."""
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Corruption("varint is cut short")
        byte = data[at]
        value, at, shift = value | (byte & 0x7F) << shift, at + 1, shift + 7
        if byte < 0x80:
            return value, at


def take(data: bytes, at: int, n: int) -> tuple[bytes, int]:
    if at + n > len(data):
        raise Corruption("data is cut short")
    return data[at : at + n], at + n


def log_record(op: int, key: bytes, value: bytes) -> bytes:
    payload = bytes([op]) + varint(len(key)) + varint(len(value)) + key + value
    return varint(len(payload)) + payload + struct.pack("<I", hash64(payload) & HALF)


def read_log(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(op, key, value) of the records before the first bad or cut one."""
    at = 0
    while at < len(data):
        try:
            length, at = read_varint(data, at)
            payload, at = take(data, at, length)
            checksum, at = take(data, at, 4)
            if struct.unpack("<I", checksum)[0] != hash64(payload) & HALF or not payload:
                return
            keys_, i = read_varint(payload, 1)
            values, i = read_varint(payload, i)
            key, i = take(payload, i, keys_)
            value, i = take(payload, i, values)
        except Corruption:
            return
        yield payload[0], key, value


def data_block(entries: Iterable[tuple[bytes, int, bytes]]) -> bytes:
    return b"".join(varint(len(k)) + varint(len(v) + 1) + k + bytes([op]) + v for k, op, v in entries)


def read_block(data: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    at = 0
    while at < len(data):
        n, at = read_varint(data, at)
        m, at = read_varint(data, at)
        key, at = take(data, at, n)
        body, at = take(data, at, m)
        yield key, body[0], body[1:]


def index_block(entries: Iterable[tuple[bytes, int, int]]) -> bytes:
    return b"".join(varint(len(k)) + k + struct.pack("<QQ", offset, size) for k, offset, size in entries)


def read_index(data: bytes) -> list[tuple[bytes, int, int]]:
    at, out = 0, []
    while at < len(data):
        n, at = read_varint(data, at)
        key, at = take(data, at, n)
        place, at = take(data, at, 16)
        out.append((key, *struct.unpack("<QQ", place)))
    return out


def write_table(entries: Iterable[tuple[bytes, int, bytes]], block_size: int = 4096, bits_per_key: int = 10) -> bytes:
    """A table file of (key, op, value) entries in key order."""
    body, index, block, size, all_keys = bytearray(), [], [], 0, []
    for entry in entries:
        block.append(entry)
        all_keys.append(entry[0])
        size += len(data_block([entry]))
        if size >= block_size:
            index.append((block[0][0], len(body), size))
            body += data_block(block)
            block, size = [], 0
    if block:
        index.append((block[0][0], len(body), size))
        body += data_block(block)
    at_index, raw = len(body), index_block(index)
    body += raw
    at_filter, filter_ = len(body), bloom_build(all_keys, bits_per_key)
    body += filter_
    return bytes(body) + FOOTER.pack(at_index, len(raw), at_filter, len(filter_), VERSION, 0, MAGIC)


class TableFile:
    """An open table file."""

    def __init__(self, data: bytes):
        if len(data) < FOOTER.size:
            raise Corruption("file too short for a footer")
        index, index_size, filter_, filter_size, version, _, magic = FOOTER.unpack(data[-FOOTER.size :])
        if magic != MAGIC or version != VERSION:
            raise Corruption("bad footer")
        if max(index + index_size, filter_ + filter_size) > len(data) - FOOTER.size:
            raise Corruption("footer points outside the file")
        self.data, self.index, self.filter = data, read_index(data[index : index + index_size]), data[filter_ : filter_ + filter_size]

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for _, offset, size in self.index:
            yield from read_block(self.data[offset : offset + size])

    def get(self, key: bytes) -> tuple[int, bytes] | None:
        """(op, value), by filter, then the last block whose first key is not above it."""
        if not bloom_may_contain(self.filter, key):
            return None
        below = [e for e in self.index if e[0] <= key]
        if not below:
            return None
        _, offset, size = below[-1]
        return next(((op, v) for k, op, v in read_block(self.data[offset : offset + size]) if k == key), None)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(T._parse_datatype_string(schema))


def _files(spark: SparkSession, path: str, schema: str, rows) -> DataFrame:
    """Rows of whole files; one file is one record, and one task's work."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                made = list(rows(name, content))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], f.type) for i, f in enumerate(out)], schema=out)

    return spark.read.format("binaryFile").load(path).select("path", F.col("content")).mapInArrow(run, schema)


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """(segment, pos, op, key, value): the valid prefix of each log file."""
    return _files(spark, path, LOG_SCHEMA, lambda name, data: ((name, i, op, k, v) for i, (op, k, v) in enumerate(read_log(data))))


def read_table_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, key, op, value) of table files; Corruption fails the job."""
    return _files(spark, path, TABLE_SCHEMA, lambda name, data: ((name, k, op, v) for k, op, v in TableFile(data)))
