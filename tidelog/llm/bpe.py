"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be joined
by a merge: every merge result is a vocabulary token. Such a pair therefore marks a
certain cut. Each pre-token is cut there, the fragments are encoded independently of
one another, and their ids are concatenated. Fragments are short and recur often, so
they are remembered, within a bound.

Defined results: a null text is the empty text and has no ids; a text of any length is
encoded whole; rows are independent, so repeated rows give repeated results; an empty
table gives an empty table; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import arrow_schema, documents, frugal, only, small_batches

VOCABULARY = "byte_bpe_50k.json"
# Fixed value: the pre-tokenizer's published pattern.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens remembered per worker, and the longest one worth remembering.
CACHE_ENTRIES, CACHE_CHARS = 150_000, 48


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Codec:
    """Encodes and decodes with one vocabulary file. What only some callers need is
    built when first used; a worker may hold a codec for long."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = b"\n".join(f"{self.ids[raw(a)]} {self.ids[raw(b)]}".encode() for a, b in pairs)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.library = self._library()

    def _library(self) -> tiktoken.Encoding | None:
        """The compiled library, where ids of merge results rise with merge order, so
        that ids can serve it as ranks."""
        by_id, last = {i: t for t, i in self.ids.items()}, -1
        for line in self.merges.split(b"\n") if self.merges else []:
            a, b = map(int, line.split())
            joined = self.ids[by_id[a] + by_id[b]]
            if joined <= last:
                return None
            last = joined
        if any(bytes([b]) not in self.ids for b in range(256)):
            return None
        return tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=self.ids, special_tokens=self.special)

    @functools.cached_property
    def by_id(self) -> list[bytes]:
        tokens = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        return [tokens.get(i, b"") for i in range(max(tokens) + 1)]

    @functools.cached_property
    def ranks(self) -> dict[tuple[bytes, bytes], int]:
        pairs = (tuple(map(int, line.split())) for line in self.merges.split(b"\n") if line)
        return {(self.by_id[a], self.by_id[b]): n for n, (a, b) in enumerate(pairs)}

    @functools.cached_property
    def decimals(self) -> list[bytes]:
        return [str(i).encode() for i in range(len(self.by_id))]

    @functools.cached_property
    def words(self):
        return regex.compile(PRETOKEN)

    @functools.cached_property
    def cutter(self):
        longest_first = sorted(self.special, key=len, reverse=True)
        return regex.compile("|".join(map(regex.escape, longest_first))) if self.special else None

    @functools.cached_property
    def joinable(self) -> np.ndarray:
        """Whether two bytes occur side by side in some token."""
        inside = np.zeros(65536, bool)
        for token in self.ids:
            if len(token) > 1:
                b = np.frombuffer(token, np.uint8).astype(np.int64)
                inside[b[:-1] << 8 | b[1:]] = True
        return inside

    @functools.cached_property
    def joinable_bytes(self) -> bytes:
        return self.joinable.tobytes()

    @functools.cached_property
    def merger(self):
        """The library's merge loop, or the one below."""
        core = getattr(self.library, "_core_bpe", None)
        return getattr(core, "encode_single_piece", self.merge)

    @functools.cached_property
    def memory(self) -> Memory:
        return Memory(self)

    def encode_whole(self, text: str) -> np.ndarray:
        """The same ids from the compiled library where it can serve this vocabulary:
        for callers that need ids but not the splitting."""
        if self.library is None:
            return np.frombuffer(self.encode_bytes(text), "<u4")
        return self.library.encode_to_numpy(text, allowed_special="all")

    def merge(self, fragment: bytes) -> list[int]:
        """Joins the lowest-ranked adjacent pair, leftmost first, until none is left;
        O(n log n) through a heap of pairs over a linked list."""
        parts = [fragment[i : i + 1] for i in range(len(fragment))]
        after = [*range(1, len(parts)), -1]
        before = [-1, *range(len(parts) - 1)]
        heap = [(r, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := self.ranks.get((a, b))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, joined = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j < 0 or self.ranks.get((parts[i], parts[j])) != rank or parts[i] + parts[j] != joined:
                continue
            parts[i], parts[j], after[i] = joined, None, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                right = after[left] if left >= 0 else -1
                if left >= 0 and right >= 0 and (r := self.ranks.get((parts[left], parts[right]))) is not None:
                    heapq.heappush(heap, (r, left, parts[left] + parts[right]))
        return [self.ids[p] for p in parts if p is not None]

    def fragments(self, piece: bytes) -> list[bytes]:
        """The piece, cut wherever two adjacent bytes occur in no token."""
        if len(piece) > 64:
            b = np.frombuffer(piece, np.uint8).astype(np.int64)
            cuts = (np.flatnonzero(~self.joinable[b[:-1] << 8 | b[1:]]) + 1).tolist()
        else:
            table = self.joinable_bytes
            cuts = [i for i in range(1, len(piece)) if not table[piece[i - 1] << 8 | piece[i]]]
        if not cuts:
            return [piece]
        edges = [0, *cuts, len(piece)]
        return [piece[a:b] for a, b in zip(edges, edges[1:])]

    def piece_ids(self, piece: str) -> bytes:
        """Little-endian ids of one pre-token: those of its fragments in order."""
        merger = self.merger
        ids = [i for f in self.fragments(piece.encode()) for i in merger(f)]
        return np.array(ids, "<u4").tobytes()

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        look_up, words = self.memory.__getitem__, self.words.findall
        if self.cutter is None or not self.cutter.search(text):
            return b"".join(map(look_up, words(text)))
        out, at = [], 0
        for m in self.cutter.finditer(text):
            out += map(look_up, words(text[at : m.start()]))
            out.append(np.array([self.special[m[0]]], "<u4").tobytes())
            at = m.end()
        out += map(look_up, words(text[at:]))
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text or ""), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """Invalid UTF-8 becomes U+FFFD, one for each maximal invalid part."""
        return b"".join(map(self.by_id.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def decimal(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.decimals.__getitem__, ids.tolist()))


class Memory(dict):
    """Pre-token to ids; emptied when full, so a worker's memory stays bounded."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        ids = self.codec.piece_ids(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES:
                self.clear()
            self[piece] = ids
        return ids


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec per file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def default_path() -> str:
    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<long>) for each row of docs (doc_id, text)."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    out = arrow_schema("doc_id long, ids array<long>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], schema=out)

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), "doc_id long, ids array<long>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids); null ids give the empty text."""
    small_batches(encoded.sparkSession)
    path = path or default_path()
    out = arrow_schema("doc_id long, text string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(i or [], np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=out)

    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes each text in one pass and returns digests of both."""
    small_batches(docs.sparkSession)
    path = path or default_path()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            counts, ids_digest, text_digest = [], [], []
            for value in batch.column(1):
                ids = own.encode(value.as_py())
                counts.append(len(ids))
                ids_digest.append(hashlib.sha256(own.decimal(ids)).hexdigest())
                text_digest.append(hashlib.sha256(own.decode(ids).encode()).hexdigest())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digest, pa.string()), pa.array(text_digest, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(run), schema)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir))


QUERIES = {"op1_bpe": op1_bpe}
ORACLE: dict[str, str] = {}
