"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds: word k-mers that are the least of some window of WINDOW k-mers in a row, so
   any two equal stretches of K + WINDOW - 1 words share one. Texts are read whole.
2. Seeds are dealt by their hash in packed rows. Each occurrence is matched to the first
   document that holds the seed and to the nearest one before it: a number of matches
   that is linear in the occurrences, whatever the size of a group. Matches to all
   documents would be quadratic. Common seeds, found by counting those of all texts, have
   the same matches, but are dealt by blocks of documents in order, and each block is told
   the seed's first holder of all and its last one in the blocks before.
3. The matches of two documents are joined into segments along diagonals, and segments
   into chains: the best chain that ends in a segment is a prefix maximum over smaller
   source positions, kept in a Fenwick tree, less a cost for the gap.
4. Chains are aligned word by word: along diagonals, across gaps by longest common
   subsequence, and beyond both ends while it pays. A stretch of MIN_WORDS or more with
   at least MIN_IDENTITY equal words is a passage.
5. A chain whose segments better chains of the document cover waits until those are
   aligned; if words of its segments are then in no passage, it is aligned too.
6. A passage whose seeds led to documents that hold parts of it only is still missing.
   All its seeds are shared, so it lies in a stretch of shared seeds, and there of shared
   long seeds, found in the same way. In these, the windows of MIN_WORDS words that are in
   no passage become seeds themselves, and are matched to
   the first document that holds the whole window, chained and aligned as before. So
   each word of an exact repeat of MIN_WORDS words is in a passage. Documents whose window
   lies in an exact repeat of an earlier one don't take part: they are not the first to
   hold it.

The first document (smallest doc_id, then place in the scan; a null id comes last) keeps
a passage; it is reported for each later one, with the document it repeats.

Defined results: words are runs of characters other than space and U+0009 to U+000D, A-Z
in lower case. Null, empty and short texts have no passages; repeats within one document
are none; of repeated rows the later repeats the earlier; an empty table gives an empty
table. Other columns, of any name, are not read; `without_passages` returns them unchanged but for
text and, where there is such a column, n_chars, and drops documents of which nothing
is left.
"""

from __future__ import annotations

import bisect
import gc
import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidelog.llm import bytesops, packed_rows
from tidelog.llm.common import arrow_schema, documents, frugal, numbered, only, place_of, row_key, shuffle_parts, small_batches, spans_of, staged, steady, text_buffer
from tidelog.llm.exact_dedup import BROADCAST_ROWS, without_rows

K, WINDOW = 6, 8
#: The same of the long seeds that tell where whole windows may be shared: any MIN_WORDS
#: equal words share one.
LONG, LONG_WINDOW = 36, 15
MIN_WORDS, MIN_IDENTITY = 50, 0.8
#: Words within which a seed that recurs counts as part of a run of repeats.
TANDEM = 64
#: Seeds on one diagonal are one segment up to this distance.
REACH = 30
#: Cost of a word of gap in either document; a chain counts from this score on.
GAP_COST, MIN_SCORE = 0.5, 20.0
#: Words around a chain that alignment may extend it by.
MARGIN = 48
#: A run of this many unequal words ends a passage.
BREAK = 12
#: Cells of the table of a longest common subsequence held at once.
TABLE_CELLS = 250_000
PART_SEEDS = 2_000_000
#: A seed is common from so many occurrences on, or from this share of the number of
#: documents if that is more, but from COMMON_MOST at the latest.
COMMON_COUNT, COMMON_SHARE, COMMON_MOST = 1000, 1e-3, 1_000_000
#: Bit of a packed position: the seed recurs there, or the window is in no passage yet.
MARK = np.uint32(1 << 31)
NO_ID = np.iinfo(np.int64).max


def seeds(data: np.ndarray, offsets: np.ndarray, mask: np.uint64) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, codes, word positions) of each row that has seeds, in order; positions of
    seeds that recur nearby have MARK."""
    for a, b in spans_of(offsets, bytesops.BLOCK):
        words = bytesops.words_of(data, offsets[a : b + 1])
        code = bytesops.shingle_codes(words.code, K) & mask
        if len(code) < WINDOW:
            continue
        least = code
        for step in (1, 2, 4):  # least of 8 in a row by doubling
            least = np.minimum(least[:-step], least[step:])
        whole = words.doc[: len(least)] == words.doc[WINDOW + K - 2 :]
        least = np.where(whole, least, np.uint64(0))
        cover = np.concatenate([np.zeros(WINDOW - 1, np.uint64), least, np.zeros(WINDOW - 1, np.uint64)])
        for step in (1, 2, 4):  # greatest least of the windows that hold a position
            cover = np.maximum(cover[:-step], cover[step:])
        chosen = np.flatnonzero((cover == code) & (code > 0))
        first = np.searchsorted(words.doc, np.arange(b - a))
        edges = np.searchsorted(words.doc[chosen], np.arange(b - a + 1))
        for i in np.flatnonzero(np.diff(edges)):
            at = chosen[edges[i] : edges[i + 1]]
            numbers, again = told_apart(code[at], at, mask)
            yield a + int(i), numbers, (at - first[i]).astype(np.uint32) | np.where(again, MARK, np.uint32(0))


def told_apart(code: np.ndarray, at: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Codes in which seeds that recur within TANDEM words are told apart by their number
    in that run, so runs of repeated words are matched word by word, not all to one; and
    which are such."""
    if len(np.unique(code)) == len(code):
        return code, np.zeros(len(code), bool)
    order = np.lexsort((at, code))
    c, p = code[order], at[order]
    fresh = np.append(True, (c[1:] != c[:-1]) | (p[1:] - p[:-1] > TANDEM))
    index = np.arange(len(c))
    number = index - np.maximum.accumulate(np.where(fresh, index, 0))
    out = code.copy()
    again = number > 0
    out[order[again]] = bytesops.mix(c[again] ^ number[again].astype(np.uint64) << np.uint64(20)) & mask
    recurs = np.zeros(len(c), bool)
    recurs[order] = again
    return out, recurs


def mask_of(bits: int) -> np.uint64:
    return np.uint64((((1 << bits) - 1) << (64 - bits)) | ((1 << 48) - 1))


def prepared(docs: DataFrame) -> DataFrame:
    return only(docs, "doc_id", "text").select(row_key().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NO_ID))).alias("doc"), "text")


def binary(array: np.ndarray, kind) -> bytes:
    return np.ascontiguousarray(array, kind).tobytes()


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def buffers(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table[name].to_pylist()), kind)


def common_seeds(ready: DataFrame, n_docs: int, mask: np.uint64) -> tuple[np.ndarray, int]:
    """Seeds, among them all common ones, and a bound on their occurrences. Texts are
    counted in chunks. In those that hold less than their share of half of what makes a
    seed common, it has less than that half in all, so the others add up to more than half
    of it. Which seeds these are decides only how they are dealt, not what they match."""
    half = max(COMMON_COUNT, min(COMMON_SHARE * n_docs, COMMON_MOST)) / 2
    out = arrow_schema("code long, n long")

    def counted(held: list[np.ndarray], docs: int) -> pa.RecordBatch:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        enough = n >= half * docs / n_docs
        return pa.RecordBatch.from_arrays([pa.array(code[enough].view(np.int64)), pa.array(n[enough])], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, docs = [], 0, 0
        for batch in batches:
            each = [code for _, code, _ in seeds(*text_buffer(batch.column(0)), mask)]
            held, size, docs = held + each, size + sum(map(len, each)), docs + batch.num_rows
            if size >= PART_SEEDS:
                yield counted(held, docs)
                held, size, docs = [], 0, 0
        if held:
            yield counted(held, docs)

    # Each has half or more, so there are few of them, however many documents there are.
    found = ready.select("text").mapInArrow(frugal(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).where(F.col("n") >= half).toArrow()
    return np.sort(found["code"].to_numpy().view(np.uint64)), 2 * int(found["n"].to_numpy().sum())


def block_starts(ready: DataFrame, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(doc, row) of the first document of each block of documents in order."""
    parts = ready.select("doc", "row").repartitionByRange(blocks, "doc", "row").groupBy(F.spark_partition_id().alias("block"))
    first = parts.agg(F.min(F.struct("doc", "row")).alias("f")).select("f.*").toArrow()
    doc, row = first["doc"].to_numpy(), first["row"].to_numpy()
    order = np.lexsort((row, doc))
    return doc[order], row[order]


def block_of(starts: tuple[np.ndarray, np.ndarray], docs: np.ndarray, rows: np.ndarray) -> np.ndarray:
    n = len(starts[0])
    own = np.arange(n + len(docs)) >= n
    order = np.lexsort((own, np.append(starts[1], rows), np.append(starts[0], docs)))
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(~own[order]) - 1
    return np.maximum(out[n:], 0)


def listed(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    if not len(sorted_codes):
        return np.zeros(len(codes), bool)
    return sorted_codes[np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)] == codes


#: What packed rows say of a document and of its seeds.
OWNERS, ITEMS = {"rows": np.int64, "docs": np.int64}, {"low": np.uint32, "mid": np.uint16, "pos": np.uint32}
#: The same of common seeds, which are named by their place among these.
COMMON_ITEMS = {"place": np.uint32, "pos": np.uint32}
MATCHED = "bucket int, rows binary, docs binary, counts binary, pos binary, src_rows binary, src_docs binary, src binary, src_pos binary"


def dealt(ready: DataFrame, common: np.ndarray, bits: int) -> DataFrame:
    """Packed rows: the seeds of some documents in one part of the hash range."""
    rest, mask = packed_rows.fine_bits(bits), mask_of(bits)
    schema = packed_rows.schema_of(OWNERS, ITEMS, rest)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i, code, pos in seeds(*text_buffer(batch.column(2)), mask):
                rare = ~listed(common, code)
                parts.append((np.full(rare.sum(), i), code[rare], pos[rare]))
            if parts:
                yield packed(dealt_rows(rows, docs, parts, bits, rest), out)

    return packed_rows.finer(ready.mapInArrow(frugal(run), schema), bits, OWNERS, ITEMS)


def dealt_rows(rows: np.ndarray, docs: np.ndarray, parts: list[tuple], bits: int, rest: int) -> list[tuple]:
    """(owner, code, pos) arrays, packed by part; owner is a place in rows and docs."""
    owner, code, pos = (np.concatenate(x) for x in zip(*parts))
    part, fine = packed_rows.coarse(code, bits, rest)
    return packed_rows.rows_of(part, owner, [rows, docs], [code.astype(np.uint32), (code >> np.uint64(32)).astype(np.uint16), pos.astype(np.uint32), *fine])


def dealt_common(ready: DataFrame, common: np.ndarray, starts: tuple[np.ndarray, np.ndarray], mask: np.uint64) -> DataFrame:
    """Packed rows: the common seeds of some documents of one block."""
    schema = packed_rows.schema_of(OWNERS, COMMON_ITEMS)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i, code, pos in seeds(*text_buffer(batch.column(2)), mask):
                hit = listed(common, code)
                parts.append((np.full(hit.sum(), i), np.searchsorted(common, code[hit]), pos[hit]))
            if parts:
                owner, place, pos = (np.concatenate(x) for x in zip(*parts))
                made = packed_rows.rows_of(block_of(starts, docs, rows)[owner], owner, [rows, docs], [place.astype(np.uint32), pos.astype(np.uint32)])
                if made:
                    yield packed(made, out)

    return ready.mapInArrow(frugal(run), schema)


def match_rows(row, doc, pos, src_row, src_doc, src_pos, bits: int) -> list[tuple]:
    """Matches, packed by bucket of the target's row."""
    bucket = (bytesops.mix(row.astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.int64)
    order = np.lexsort((row, bucket))
    row, doc, pos, src_row, src_doc, src_pos, bucket = (x[order] for x in (row, doc, pos, src_row, src_doc, src_pos, bucket))
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    made = []
    for a, b in zip(edges[:-1], edges[1:]):
        own, first, n = np.unique(row[a:b], return_index=True, return_counts=True)
        sources, where, src = np.unique(src_row[a:b], return_index=True, return_inverse=True)
        made.append((
            int(bucket[a]), binary(own, np.int64), binary(doc[a:b][first], np.int64), binary(n, np.uint32), binary(pos[a:b], np.uint32),
            binary(sources, np.int64), binary(src_doc[a:b][where], np.int64), binary(src, np.uint32), binary(src_pos[a:b], np.uint32),
        ))
    return made


class Occurrences(NamedTuple):
    """Of seeds, by code, then in the order of documents and of words."""

    code: np.ndarray
    row: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    marked: np.ndarray
    lead: np.ndarray  # where the code begins
    before: np.ndarray  # the one before the code's first in this document


def occurrences(table: pa.Table, code: np.ndarray) -> Occurrences:
    rows, docs, counts = buffers(table, "rows", np.int64), buffers(table, "docs", np.int64), buffers(table, "counts", np.uint32)
    pos = buffers(table, "pos", np.uint32)
    rank = np.empty(len(rows), np.int64)
    by_rank = np.lexsort((rows, docs))
    rank[by_rank] = np.arange(len(rows))
    owner = np.repeat(rank, counts)
    marked, pos = pos >= MARK, pos & ~MARK
    order = np.lexsort((pos, owner, code))
    code, owner, pos, marked = code[order], owner[order], pos[order], marked[order]
    new_code = np.append(True, code[1:] != code[:-1])[: len(code)]
    new_run = new_code | np.append(True, owner[1:] != owner[:-1])[: len(code)]
    lead = np.maximum.accumulate(np.where(new_code, np.arange(len(code)), 0))
    before = np.maximum.accumulate(np.where(new_run, np.arange(len(code)), 0)) - 1
    return Occurrences(code, rows[by_rank][owner], docs[by_rank][owner], pos, marked, lead, before)


def matched(parts: DataFrame, bits: int, windows: bool = False) -> DataFrame:
    """Each occurrence of a seed with its first holder and the nearest one before. The
    first holder's own occurrences are matched to themselves, to show where its seeds
    are shared, and so are those that recur nearby, which may be shared by another
    number. For whole windows, only the marked ones with their first holder."""
    out = arrow_schema(MATCHED)

    def run(table: pa.Table) -> pa.Table:
        o = occurrences(table, buffers(table, "low", np.uint32).astype(np.uint64) | buffers(table, "mid", np.uint16).astype(np.uint64) << np.uint64(32))
        is_later = o.row != o.row[o.lead]
        later = np.flatnonzero(is_later & o.marked if windows else is_later)
        target, source = later, o.lead[later]
        if not windows:
            other = later[o.row[o.before[later]] != o.row[o.lead[later]]]
            shared = np.bincount(o.lead, is_later, len(o.code)) > 0
            own = np.flatnonzero(~is_later & (shared[o.lead] | o.marked))
            target, source = np.concatenate([later, other, own]), np.concatenate([source, o.before[other], own])
        made = match_rows(o.row[target], o.doc[target], o.pos[target], o.row[source], o.doc[source], o.pos[source], bits)
        return pa.Table.from_batches([packed(made, out)])

    return parts.groupBy("part").applyInArrow(frugal(run), MATCHED)


def block_ends(blocks: DataFrame) -> DataFrame:
    """The first and the last occurrence of each common seed in each block."""
    schema = "part int, place long, first_doc long, first_row long, first_pos long, last_doc long, last_row long, last_pos long"
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        o = occurrences(table, buffers(table, "place", np.uint32))
        first = np.unique(o.lead)
        last = np.append(first[1:], len(o.code))[: len(first)] - 1
        columns = [np.full(len(first), table["part"][0].as_py()), o.code[first], *(v[at] for at in (first, last) for v in (o.doc, o.row, o.pos))]
        return pa.Table.from_arrays([pa.array(v.astype(np.int64)).cast(f.type) for v, f in zip(columns, out)], schema=out)

    return blocks.groupBy("part").applyInArrow(frugal(run), schema)


def matched_common(blocks: DataFrame, bits: int) -> DataFrame:
    """The same for common seeds, block by block."""
    out = arrow_schema(MATCHED)
    ordered = Window.partitionBy("place").orderBy("part")  # a seed has a row for each block at most
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = block_ends(blocks).select(
        "part",
        "place",
        *(F.first(f"first_{c}").over(whole).alias(f"first_{c}") for c in ("doc", "row", "pos")),
        *(F.lag(f"last_{c}", 1, -1).over(ordered).alias(f"last_{c}") for c in ("doc", "row", "pos")),
        (F.first("first_row").over(whole) != F.last("last_row").over(whole)).alias("shared"),
    )

    def run(both: tuple[pa.Table, pa.Table]) -> pa.Table:
        table, seeds_ = both
        o = occurrences(table, buffers(table, "place", np.uint32))
        seeds_ = seeds_.sort_by("place")
        at = np.searchsorted(seeds_["place"].to_numpy(), o.code)
        first, last = ([seeds_[f"{w}_{c}"].to_numpy()[at] for c in ("row", "doc", "pos")] for w in ("first", "last"))
        inside = o.before >= o.lead
        near = [np.where(inside, v[o.before], u) for v, u in zip((o.row, o.doc, o.pos), last)]
        is_later = o.row != first[0]
        later, other = np.flatnonzero(is_later), np.flatnonzero(is_later & (near[0] != first[0]))
        own = np.flatnonzero(~is_later & (seeds_["shared"].to_numpy()[at] | o.marked))
        target = np.concatenate([later, other, own])
        source = (np.concatenate([u[later], v[other], w[own]]) for u, v, w in zip(first, near, (o.row, o.doc, o.pos)))
        made = match_rows(o.row[target], o.doc[target], o.pos[target], *source, bits)
        return pa.Table.from_batches([packed(made, out)])

    work = frugal(run)
    return blocks.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(lambda table, seeds_: work((table, seeds_)), MATCHED)


class Fenwick:
    """Prefix maxima over positions 0 to n - 1, with who holds them."""

    def __init__(self, n: int):
        self.best, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def add(self, at: int, value: float, who: int) -> None:
        at += 1
        while at < len(self.best):
            if value > self.best[at]:
                self.best[at], self.who[at] = value, who
            at += at & -at

    def prefix(self, below: int) -> tuple[float, int]:
        """The largest value at a position < below."""
        value, who = float("-inf"), -1
        while below > 0:
            if self.best[below] > value:
                value, who = self.best[below], self.who[below]
            below -= below & -below
        return value, who


def chains(x0: list[int], x1: list[int], y0: list[int]) -> list[tuple[float, list[int]]]:
    """Chains of segments [x0, x1) x [y0, y0 + x1 - x0), each a score and its segments in
    order; every segment is in one chain at most. A chain gains the words it covers and
    pays GAP_COST for each word of gap in either document."""
    n = len(x0)
    y1 = [y0[i] + x1[i] - x0[i] for i in range(n)]
    ends = sorted(set(y1))
    place = {y: k for k, y in enumerate(ends)}
    tree, score, back = Fenwick(len(ends)), [0.0] * n, [-1] * n
    opening, closing = sorted(range(n), key=lambda i: (x0[i], y0[i])), sorted(range(n), key=lambda i: x1[i])
    done = 0
    for i in opening:
        while done < n and x1[closing[done]] <= x0[i]:
            j = closing[done]
            tree.add(place[y1[j]], score[j] + GAP_COST * (x1[j] + y1[j]), j)
            done += 1
        value, j = tree.prefix(bisect.bisect_right(ends, y0[i]))
        gain = value - GAP_COST * (x0[i] + y0[i])
        score[i] = x1[i] - x0[i] + max(0.0, gain)
        if gain > 0:
            back[i] = j
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        if used[i]:
            continue
        path, at = [], i
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = back[at]
        lost = score[at] if at >= 0 else 0.0  # the rest belongs to a better chain
        out.append((score[i] - lost, path[::-1]))
    return out


CHAINED = "row long, doc long, src_row long, src_doc long, lo int, hi int, src_lo int, src_hi int, x array<int>, y array<int>, n array<int>, later boolean"


def stretches(row: np.ndarray, x: np.ndarray, width: int, window: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """(row, first words, lengths) of the stretches in which all seeds may be shared:
    seeds of equal text are no further than `window` apart, and as near to its ends."""
    order = np.lexsort((x, row))
    row, x = row[order], x[order]
    step = np.append(True, (row[1:] != row[:-1]) | (x[1:] - x[:-1] > window)) if len(x) else np.zeros(0, bool)
    first = np.flatnonzero(step)
    lo, hi = np.maximum(x[first] - window + 1, 0), x[np.append(first[1:], len(x))[: len(first)] - 1] + width + window - 1
    row, lo, hi = (v[hi - lo >= MIN_WORDS] for v in (row[first], lo, hi))
    edges = np.flatnonzero(np.diff(row, prepend=-1, append=-2)).tolist() if len(row) else [0]
    for a, b in zip(edges[:-1], edges[1:]):
        yield int(row[a]), lo[a:b].tolist(), (hi - lo)[a:b].tolist()


def chained(matches: DataFrame, width: int = K) -> DataFrame:
    """The chains of each document by seeds of `width` words; `later` are those whose
    segments better ones cover; by whole windows, only chains that add words to better
    ones, those that add most first; by long seeds, none. A row that is its own source has the stretches, as x and
    n, in which the document's seeds are shared."""
    out = arrow_schema(CHAINED)

    def run(table: pa.Table) -> pa.Table:
        counts = buffers(table, "counts", np.uint32)
        row, doc = np.repeat(buffers(table, "rows", np.int64), counts), np.repeat(buffers(table, "docs", np.int64), counts)
        sources, source_docs = buffers(table, "src_rows", np.int64), buffers(table, "src_docs", np.int64)
        base, at = [], 0
        for s, n in zip(table["src"].to_pylist(), table["src_rows"].to_pylist()):
            base.append(np.frombuffer(s, np.uint32).astype(np.int64) + at)
            at += len(n) // 8
        which = np.concatenate(base) if base else np.zeros(0, np.int64)
        src, src_doc = sources[which], source_docs[which]
        x, y = buffers(table, "pos", np.uint32).astype(np.int64), buffers(table, "src_pos", np.uint32).astype(np.int64)
        made = []
        if width != MIN_WORDS:
            own, at = np.unique(row, return_index=True)
            doc_of = dict(zip(own.tolist(), doc[at].tolist()))
            made = [(r, doc_of[r], r, doc_of[r], 0, 0, 0, 0, lo, [], n, False) for r, lo, n in stretches(row, x, width, WINDOW if width == K else LONG_WINDOW)]
            if width == LONG:
                return pa.Table.from_batches([packed(made, out)])
            other = row != src
            row, doc, src, src_doc, x, y = (v[other] for v in (row, doc, src, src_doc, x, y))
        order = np.lexsort((x, x - y, src, row))
        row, doc, src, src_doc, x, y = (v[order] for v in (row, doc, src, src_doc, x, y))
        step = np.append(True, (row[1:] != row[:-1]) | (src[1:] != src[:-1]) | (x[1:] - y[1:] != x[:-1] - y[:-1]) | (x[1:] - x[:-1] > REACH)) if len(x) else np.zeros(0, bool)
        first = np.flatnonzero(step)
        last = np.append(first[1:], len(x))[: len(first)] - 1
        row, doc, src, src_doc, x0, x1, y0 = row[first], doc[first], src[first], src_doc[first], x[first], x[last] + width, y[first]
        pair = np.cumsum(np.append(True, (row[1:] != row[:-1]) | (src[1:] != src[:-1]))) - 1 if len(row) else np.zeros(0, int)
        enough = np.bincount(pair, weights=x1 - x0)[pair] >= MIN_SCORE if len(row) else np.zeros(0, bool)
        row, doc, src, src_doc, x0, x1, y0, pair = (v[enough] for v in (row, doc, src, src_doc, x0, x1, y0, pair))
        found = []
        edges = np.flatnonzero(np.diff(pair, prepend=-1, append=-2)).tolist() if len(pair) else [0]
        for a, b in zip(edges[:-1], edges[1:]):
            for score, path in chains(x0[a:b].tolist(), x1[a:b].tolist(), y0[a:b].tolist()):
                if score >= MIN_SCORE:
                    found.append((int(row[a]), -score, int(src_doc[a]), int(src[a]), a, path))
        found.sort()
        for _, own in itertools.groupby(found, key=lambda f: f[0]):
            own = list(own)
            segments = [[(int(x0[a + i]), int(x1[a + i])) for i in path] for *_, a, path in own]
            covered = np.zeros(max(v for each in segments for _, v in each), bool)
            fresh = lambda each: sum(int((~covered[u:v]).sum()) for u, v in each)
            kept: set[int] = set()
            for least in (10,) if width == K else (10, 1):
                for k, each in enumerate(segments):
                    if k not in kept and fresh(each) >= least:
                        kept.add(k)
                        for u, v in each:  # not the gaps: other documents may have them
                            covered[u:v] = True
            # Segments of whole windows are equal words and surely become passages.
            for k in range(len(own)) if width == K else sorted(kept):
                r, _, s, src_, a, path = own[k]
                p = [a + i for i in path]
                lo, hi, top = segments[k][0][0], max(v for _, v in segments[k]), int((y0[p] + x1[p] - x0[p]).max())
                made.append((r, int(doc[a]), src_, s, max(0, lo - MARGIN), hi + MARGIN, max(0, int(y0[p[0]]) - MARGIN), top + MARGIN, x0[p].tolist(), y0[p].tolist(), (x1[p] - x0[p]).tolist(), k not in kept))
        return pa.Table.from_batches([packed(made, out)])

    return matches.groupBy("bucket").applyInArrow(frugal(run), CHAINED)


def common_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which words of a lie on a longest common subsequence with b."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a)):
        hit = np.where(a[i] == b, table[i, :-1] + 1, 0)
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], hit))
    out, j = np.zeros(len(a), bool), len(b)
    for i in range(len(a), 0, -1):
        if table[i, j] == table[i - 1, j]:
            continue
        while table[i, j - 1] == table[i, j]:
            j -= 1
        out[i - 1] = True
        j -= 1
    return out


def common_lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of a with each prefix of b."""
    row = np.zeros(len(b) + 1, np.int32)
    for word in a:
        hit = np.where(word == b, row[:-1] + 1, 0)
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], hit))
    return row


def common_words(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """common_run in memory linear in the words: halves a where the table is large
    (Hirschberg)."""
    if len(a) * len(b) <= TABLE_CELLS:
        return common_run(a, b)
    if len(a) == 1:
        return np.array([(a[0] == b).any()])
    half = len(a) // 2
    at = int(np.argmax(common_lengths(a[:half], b) + common_lengths(a[half:][::-1], b[::-1])[::-1]))
    return np.concatenate([common_words(a[:half], b[:at]), common_words(a[half:], b[at:])])


def equal_words(a: np.ndarray, b: np.ndarray, x: list[int], y: list[int], n: list[int], cut: np.ndarray | None = None) -> np.ndarray:
    """Which words of a are aligned to an equal word of b, given a chain. In cut, if it
    is given, words are marked that may not follow the one before in b."""
    out = np.zeros(len(a), bool)
    i = k = 0
    for turn, (p, q, m) in enumerate(zip(x, y, n)):
        skip = max(0, i - p, k - q)  # segments on different diagonals may overlap
        p, q, m = p + skip, q + skip, m - skip
        if m <= 0:
            continue
        if turn == 0 or not out.any():
            m0 = min(p, q)
            same = a[p - m0 : p][::-1] == b[q - m0 : q][::-1]
            if m0:
                gain = np.cumsum(2 * same - 1)
                reach = int(np.argmax(gain)) + 1 if gain.max() > 0 else 0
                out[p - reach : p] = same[:reach][::-1]
        elif p - i == q - k:
            out[i:p] = a[i:p] == b[k:q]
        else:
            if (p - i) * (q - k) > 0:
                out[i:p] = common_words(a[i:p], b[k:q])
            if cut is not None:
                cut[i : p + 1] = True
        m = min(m, len(a) - p, len(b) - q)
        out[p : p + m] = a[p : p + m] == b[q : q + m]
        i, k = p + m, q + m
    m = min(len(a) - i, len(b) - k)
    if m > 0:
        same = a[i : i + m] == b[k : k + m]
        gain = np.cumsum(2 * same - 1)
        reach = int(np.argmax(gain)) + 1 if gain.max() > 0 else 0
        out[i : i + reach] = same[:reach]
    return out


def passages_in(equal: np.ndarray, gap: int = BREAK) -> list[tuple[int, int]]:
    """Stretches that start and end with equal words, with no run of `gap` unequal ones,
    long and equal enough; a stretch that is not equal enough is split at shorter runs."""
    at = np.flatnonzero(equal)
    out = []
    for part in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1) if len(at) else []:
        lo, hi = int(part[0]), int(part[-1]) + 1
        if hi - lo < MIN_WORDS:
            continue
        if len(part) >= MIN_IDENTITY * (hi - lo):
            out.append((lo, hi))
        elif gap > 1:
            out += [(lo + a, lo + b) for a, b in passages_in(equal[lo:hi], gap // 2)]
    return out


FOUND = "row long, doc_id long, start_word int, n_words int, source_doc_id long, source_row long, identity double, exact array<struct<start_word:int,n_words:int>>"


def exact_runs(equal: np.ndarray, cut: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the runs of MIN_WORDS or more equal words without a cut."""
    begins = equal & np.append(True, ~equal[:-1] | cut[1:])
    ends = equal & np.append(~equal[1:] | cut[1:], True)
    return [(int(a), int(b - a + 1)) for a, b in zip(np.flatnonzero(begins), np.flatnonzero(ends)) if b - a + 1 >= MIN_WORDS]


def words_outside(spans: list[tuple[int, int]], within: list[dict] | None) -> int:
    """How many words of the spans [lo, hi) are in none of the passages `within`."""
    if not within:
        return sum(hi - lo for lo, hi in spans)
    end = max(hi for _, hi in spans)
    free = np.ones(end, bool)
    for p in within:
        free[p["start_word"] : p["start_word"] + p["n_words"]] = False
    return sum(int(free[lo:hi].sum()) for lo, hi in spans)


def still_open(chains_: DataFrame, done: DataFrame) -> DataFrame:
    """The chains with words in none of the passages already found, with those passages."""
    known = done.groupBy("row").agg(F.collect_list(F.struct("start_word", "n_words")).alias("known"))
    both = chains_.join(known, "row", "left").select(*chains_.columns, "known")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(*(batch.column(c).to_pylist() for c in ("x", "n", "known")))
            yield batch.filter(pa.array([words_outside([(u, u + m) for u, m in zip(x, n)], k) > 0 for x, n, k in each], pa.bool_()))

    return both.mapInArrow(frugal(run), both.schema)


def aligned(pairs: DataFrame) -> DataFrame:
    """The passages of the pairs; only those with words that are in none already known."""
    out = arrow_schema(FOUND)
    light = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            words = [batch.column(batch.schema.get_field_index(c)) for c in "ab"]
            flat = [(w.values.to_numpy(), w.offsets.to_numpy()) for w in words]
            for i, r in enumerate(batch.select(light).to_pylist()):
                a, b = (v[at[i] : at[i + 1]] for v, at in flat)
                x, y = [v - r["lo"] for v in r["x"]], [v - r["src_lo"] for v in r["y"]]
                cut = np.zeros(len(a), bool)
                equal = equal_words(a, b, x, y, r["n"], cut)
                for lo, hi in passages_in(equal):
                    at = r["lo"] + lo
                    if not words_outside([(at, r["lo"] + hi)], r.get("known")):
                        continue
                    ids = [None if v == NO_ID else v for v in (r["doc"], r["src_doc"])]
                    exact = [{"start_word": at + u, "n_words": m} for u, m in exact_runs(equal[lo:hi], cut[lo:hi])]
                    made.append((r["row"], ids[0], at, hi - lo, ids[1], r["src_row"], float(equal[lo:hi].mean()), exact))
            if made:
                yield packed(made, out)

    return pairs.mapInArrow(frugal(run), FOUND)


def window_codes(words: np.ndarray, size: int = MIN_WORDS) -> np.ndarray:
    """A code for each `size` words in a row, by doubling."""
    code, width = bytesops.mix(words.astype(np.int64).view(np.uint64)), 1
    while 2 * width <= size:
        code, width = bytesops.mix(code[:-width] * np.uint64(3) + code[width:]), 2 * width
    rest = size - width
    return bytesops.mix(code[: max(0, len(code) - rest)] * np.uint64(5) + code[rest:])


def long_seeds(words: DataFrame, shared: DataFrame, bits: int) -> DataFrame:
    """Packed rows of the long seeds in stretches of shared seeds: the windows of LONG
    words that are the least of some LONG_WINDOW in a row."""
    rest, mask = packed_rows.fine_bits(bits), mask_of(bits)
    schema = packed_rows.schema_of(OWNERS, ITEMS, rest)
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i, (lows, sizes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                text, found = batch.column(4)[i].values.to_numpy(), []
                for lo, n in zip(lows, sizes):
                    code = window_codes(text[lo : lo + n], LONG) & mask
                    if len(code) >= LONG_WINDOW:
                        least = np.lib.stride_tricks.sliding_window_view(code, LONG_WINDOW)
                        found.append(lo + np.unique(np.argmin(least, axis=1) + np.arange(len(least))))
                if found:
                    at = np.unique(np.concatenate(found))
                    parts.append((np.full(len(at), i), window_codes(text, LONG)[at] & mask, at.astype(np.uint32)))
            if parts:
                yield packed(dealt_rows(rows, docs, parts, bits, rest), out)

    rows = shared.select("row", "doc", "x", "n").join(words, "row").select("row", "doc", "x", "n", "words").mapInArrow(frugal(run), schema)
    return packed_rows.finer(rows, bits, OWNERS, ITEMS)


def windows(words: DataFrame, shared: DataFrame, known: DataFrame, bits: int) -> DataFrame | None:
    """Packed rows of the windows of MIN_WORDS in stretches of shared seeds, without those
    in exact repeats; those in no passage at all are marked. None if none is."""
    done = known.groupBy("row").agg(F.collect_list(F.struct("start_word", "n_words")).alias("known"), F.flatten(F.collect_list("exact")).alias("exact"))
    schema = "row long, doc long, at array<int>, marked array<boolean>"
    rest, mask = packed_rows.fine_bits(bits), mask_of(bits)
    dealt_ = packed_rows.schema_of(OWNERS, ITEMS, rest)
    planned, out = arrow_schema(schema), arrow_schema(dealt_)

    def starts(r: dict) -> tuple[np.ndarray, np.ndarray]:
        """The first words of a document's windows, and whether each is in no passage."""
        end = max(x + n for x, n in zip(r["x"], r["n"])) + 1
        part, closed = np.zeros(end, bool), np.zeros(end, bool)
        for x, n in zip(r["x"], r["n"]):
            part[x : max(x, x + n - MIN_WORDS + 1)] = True
        for flags, value, spans_ in ((part, False, r["exact"]), (closed, True, r["known"])):
            for p in spans_ or ():
                flags[p["start_word"] : max(p["start_word"], p["start_word"] + p["n_words"] - MIN_WORDS + 1)] = value
        at = np.flatnonzero(part)
        return at, ~closed[at]

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [(r, *starts(r)) for r in batch.to_pylist()]
            rows = [(r["row"], r["doc"], at, marked) for r, at, marked in each if len(at)]
            if rows:
                yield packed(rows, planned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            parts = []
            for i in range(batch.num_rows):
                at, text = (batch.column(c)[i].values.to_numpy() for c in (2, 4))
                fits = at + MIN_WORDS <= len(text)  # a stretch may end beyond the text
                at, marked = at[fits], batch.column(3)[i].values.to_numpy(zero_copy_only=False)[fits]
                if len(at):
                    parts.append((np.full(len(at), i), window_codes(text)[at] & mask, at.astype(np.uint32) | np.where(marked, MARK, np.uint32(0))))
            if parts:
                yield packed(dealt_rows(rows, docs, parts, bits, rest), out)

    both = shared.select("row", "doc", "x", "n").join(done, "row", "left")
    chosen = staged(both.mapInArrow(frugal(plan), schema), "windows")
    if chosen.where(F.exists("marked", lambda m: m)).isEmpty():
        return None
    rows = chosen.join(words, "row").select("row", "doc", "at", "marked", "words").mapInArrow(frugal(run), dealt_)
    return packed_rows.finer(rows, bits, OWNERS, ITEMS)


def word_codes(ready: DataFrame, rows: DataFrame) -> DataFrame:
    """(row, words) of the listed rows; the list is broadcast only if counted as small."""
    small = rows.count() <= BROADCAST_ROWS
    chosen = ready.select("row", "text").join(F.broadcast(rows) if small else rows, "row", "left_semi")
    schema = "row long, words array<int>"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in spans_of(offsets, bytesops.BLOCK):
                words = bytesops.words_of(data, offsets[a : b + 1])
                edges = np.searchsorted(words.doc, np.arange(b - a + 1)).astype(np.int32)
                values = pa.array((words.code & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(edges), values)], schema=out)

    return chosen.mapInArrow(frugal(run), schema)


def settled(df: DataFrame, label: str) -> DataFrame:
    """df staged, and its exchanges' files let go: Spark removes them when the driver's JVM
    finds that nothing refers to them, which by itself may be after the last exchange."""
    out = staged(df, label)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def passages(docs: DataFrame) -> DataFrame:
    """One row for each passage that repeats an earlier document's: row, doc_id,
    start_word, n_words, source_doc_id, source_row, identity."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = steady(docs)
    docs = only(docs, "doc_id", "text")
    size = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    wanted = max(shuffle_parts(spark), (size.bytes or 0) // 6 * 2 // (WINDOW + 1) // PART_SEEDS, 2)
    bits = min(32, int(np.ceil(np.log2(wanted))))
    mask, ready = mask_of(bits), prepared(docs)
    common, most = common_seeds(ready, size.n, mask)
    matches = matched(dealt(ready, common, bits), bits)
    if len(common):
        starts = block_starts(ready, max(shuffle_parts(spark), most // PART_SEEDS))
        blocks = staged(dealt_common(ready, common, starts, mask), "common")
        matches = matches.unionByName(matched_common(blocks, bits))
    found = settled(chained(matches), "chains")
    links, shared = found.where("row <> src_row"), found.where("row = src_row")
    rows = staged(found.select("row").union(links.select("src_row")).distinct(), "rows")
    words = settled(word_codes(ready, rows), "words")
    cut = lambda words_, lo, hi: F.slice(words_, F.col(lo) + 1, F.col(hi) - F.col(lo))
    source = words.select(F.col("row").alias("src_row"), F.col("words").alias("src_words"))

    def pairs(chains_: DataFrame) -> DataFrame:
        own = chains_.join(words, "row").withColumn("a", cut("words", "lo", "hi")).drop("words")
        return own.join(source, "src_row").withColumn("b", cut("src_words", "src_lo", "src_hi")).drop("src_words")

    spans_ = lambda found_: found_.select("row", "start_word", "n_words")
    first = settled(aligned(pairs(links.where("NOT later"))), "first")
    rest = settled(still_open(links.where("later"), spans_(first)), "open")
    known = settled(first.unionByName(aligned(pairs(rest))), "known")
    # Short seeds are shared by chance the more, the larger the table; long ones are not.
    shared = settled(chained(matched(long_seeds(words, shared, bits), bits), LONG), "shared")
    whole = windows(words, shared, known, bits)
    if whole is None:
        return known.drop("exact")
    more = settled(still_open(chained(matched(whole, bits, True), MIN_WORDS), spans_(known)), "more")
    return known.unionByName(aligned(pairs(more))).drop("exact")


def without_passages(docs: DataFrame) -> DataFrame:
    """docs without the passages that repeat an earlier document's."""
    docs = steady(docs)
    spans = staged(passages(docs).select("row", "start_word", "n_words"), "passages")
    by_row = staged(spans.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start_word", "n_words"))).alias("s")).select("row", F.col("s.start_word").alias("from"), F.col("s.n_words").alias("len")), "spans")
    rest = without_rows(docs, by_row)

    @F.pandas_udf("string")
    def remaining(text: pd.Series, start: pd.Series, length: pd.Series) -> pd.Series:
        return pd.Series([cut_text(t, s, n) for t, s, n in zip(text, start, length)], dtype=object)

    small = by_row.count() <= BROADCAST_ROWS
    hit = numbered(docs).withColumn("row", row_key()).join(F.broadcast(by_row) if small else by_row, "row")
    text = f"c{place_of(docs.columns, 'text')}"
    hit = hit.withColumn(text, remaining(text, "from", "len")).where(F.col(text).rlike("[^\\x20\\x09-\\x0D]"))
    if "n_chars" in docs.columns:
        at = docs.columns.index("n_chars")
        hit = hit.withColumn(f"c{at}", F.length(text).cast(docs.schema[at].dataType))
    return numbered(rest).unionByName(hit.drop("row", "from", "len")).toDF(*docs.columns)


def cut_text(text: str, start, length) -> str:
    """The text without the given runs of words and the white space after each."""
    data, offsets = text_buffer(pa.array([text]))
    words = bytesops.words_of(data, offsets)
    raw, keep = text.encode(), np.ones(len(data[: offsets[-1]]), bool)
    for s, n in zip(start, length):
        end = int(words.start[s + n]) if s + n < len(words.start) else len(raw)
        keep[int(words.start[s]) : end] = False
    return np.frombuffer(raw, np.uint8)[keep].tobytes().decode()


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(documents(spark, sf_dir)).drop("row", "source_row")


QUERIES = {"op8_substring_dedup": op8_substring_dedup}
ORACLE: dict[str, str] = {}
