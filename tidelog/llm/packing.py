"""Sequence packing by Karmarkar-Karp multiway differencing.

Each document is its token ids and then an end id, cut into whole windows and a rest,
from which a small piece is cut whose size varies: large pieces come first in the
differencing, and small ones level what they leave. The pieces of some hundreds of
windows are partitioned together:
every piece starts as a partial partition; the two partial partitions with the largest
imbalance are merged, the fullest window of one with the emptiest of the other, until
one is left, whose windows are nearly equal. If the fullest exceeds the capacity, the
window count rises and the differencing runs again.

Scale: a document's cuts depend only on its length. Documents are dealt to groups by a
hash of their row, and the number of groups follows from the totals of all tokens and of
all pieces, so a group has the same size at any scale, whatever the documents' lengths,
and no key is hot. A partial partition holds only its windows that have a piece, so the
differencing of a group takes memory in proportion to its pieces.

Defined results: a null or empty text is the end id alone; repeated rows are packed
each for itself; a text of any length is packed whole; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bpe
from tidelog.llm.common import arrow_schema, documents, frugal, only, row_key, small_batches, staged

CAPACITY = 2048
END_ID = 1
#: Sizes of the small pieces, from the first to below the sum of both.
SMALL, SMALL_SPAN = 8, 56
#: Windows that one group of rests fills, and pieces that it has, about.
GROUP_WINDOWS, GROUP_PIECES = 256, 32_768
#: A window of a partial partition is one integer: its load, and below that its node.
NODE_BITS = 32


def cuts(length: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of a document's pieces: whole windows, then the rest less a small piece,
    then that piece; a short rest stays whole."""
    whole, rest = divmod(length, capacity)
    small = SMALL + rest * 7919 % SMALL_SPAN
    return [capacity] * whole + ([rest - small, small] if rest > 4 * small else [rest] if rest else [])


def merged(a: list[int], b: list[int], windows: int, left: array, right: array) -> list[int]:
    """Two partial partitions as one, each a falling list of its windows with a piece:
    the fullest window of one joins the emptiest of the other, so where both together
    have more than there are, the emptiest of those meet. Loads are kept relative to the
    emptiest window."""
    met = len(a) + len(b) - windows
    if met < 0:
        return sorted(a + b, reverse=True)
    node = (1 << NODE_BITS) - 1
    out = a[: len(a) - met] + b[: len(b) - met]
    for x, y in zip(a[len(a) - met :], reversed(b[len(b) - met :])):
        left.append(x & node)
        right.append(y & node)
        out.append(((x >> NODE_BITS) + (y >> NODE_BITS)) << NODE_BITS | len(left) - 1)
    out.sort(reverse=True)
    least = out[-1] >> NODE_BITS << NODE_BITS
    return [x - least for x in out] if least else out


def difference(sizes: np.ndarray | list[int], windows: int) -> list[np.ndarray]:
    """Karmarkar-Karp: the indexes of `sizes` in each of `windows` near-equal windows.
    Pieces that are still alone wait in an array, the largest first; partial partitions
    wait in a heap."""
    sizes = np.asarray(sizes, np.int64)
    n = len(sizes)
    if not n:
        return []
    alone = np.argsort(-sizes, kind="stable")
    left, right = array("q", [-1]) * n, array("q", [-1]) * n
    heap: list[tuple[int, int, list[int]]] = []
    at = tick = 0

    def take() -> list[int]:
        """The partial partition with the largest imbalance."""
        nonlocal at
        if at < n and (not heap or sizes[alone[at]] >= -heap[0][0]):
            i = int(alone[at])
            at += 1
            return [int(sizes[i]) << NODE_BITS | i]
        return heapq.heappop(heap)[2]

    while n - at + len(heap) > 1:
        both = merged(take(), take(), windows, left, right)
        tick += 1
        spread = (both[0] >> NODE_BITS) - (both[-1] >> NODE_BITS if len(both) == windows else 0)
        heapq.heappush(heap, (-spread, tick, both))
    left, right = np.frombuffer(left, np.int64), np.frombuffer(right, np.int64)
    out = []
    for node in take():
        members, stack = [], np.array([node & (1 << NODE_BITS) - 1])
        while len(stack):
            leaf = left[stack] < 0
            members.append(stack[leaf])
            stack = np.concatenate([left[stack[~leaf]], right[stack[~leaf]]])
        out.append(np.sort(np.concatenate(members)))
    return out


def windows_for(sizes: np.ndarray | list[int], capacity: int = CAPACITY) -> list[np.ndarray]:
    """The near-equal windows of the smallest count tried whose fullest one fits."""
    sizes = np.asarray(sizes, np.int64)
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, count)
        if max((int(sizes[w].sum()) for w in found), default=0) <= capacity:
            return found
        count += 1


def tokenised(docs: DataFrame, path: str, with_ids: bool, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, deal, doc_tokens, crcs[, ids]) for each document."""
    schema = "doc_id long, deal long, doc_tokens long, crcs array<long>" + (", ids array<long>" if with_ids else "")
    out = arrow_schema(schema)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.codec(path)
        for batch in batches:
            lengths, crcs, ids = [], [], []
            for value in batch.column(2):
                raw = own.encode_whole(value.as_py() or "").astype("<u4").tobytes() + end
                lengths.append(len(raw) // 4)
                at, sums = 0, []
                for n in cuts(len(raw) // 4, capacity):
                    sums.append(zlib.crc32(raw[at : at + 4 * n]))
                    at += 4 * n
                crcs.append(sums)
                if with_ids:
                    ids.append(np.frombuffer(raw, "<u4").astype(np.int64))
            columns = [batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int64()))] if with_ids else []), schema=out)

    docs = only(docs, "doc_id", "text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(row_key()).alias("deal"), "text").mapInArrow(frugal(run), schema)


def pack(
    docs: DataFrame, path: str | None = None, with_ids: bool = False, capacity: int = CAPACITY, group_windows: int = GROUP_WINDOWS, end_id: int = END_ID
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, and its ids if asked for."""
    small_batches(docs.sparkSession)
    pieces = staged(tokenised(docs, path or bpe.default_path(), with_ids, capacity, end_id), "tokens")
    total = pieces.agg(F.sum(F.col("doc_tokens") % capacity).alias("rests"), F.sum(F.size("crcs")).alias("pieces")).first()
    groups = max(1, round((total.rests or 0) / (capacity * group_windows)), -(-(total.pieces or 0) // GROUP_PIECES))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<long>" if with_ids else "")
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("deal", "ascending")]).combine_chunks()
        group, tokens = table["group"][0].as_py(), table["doc_tokens"].to_numpy()
        each = [cuts(t, capacity) for t in tokens.tolist()]
        of = np.repeat(np.arange(len(each)), [len(c) for c in each])
        length = np.fromiter((n for c in each for n in c), np.int64, len(of))
        del each
        after = np.cumsum(length)
        start = after - length - (np.cumsum(tokens) - tokens)[of]
        sequence, offset = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
        whole, rest = np.flatnonzero(length == capacity), np.flatnonzero(length < capacity)
        sequence[whole] = np.arange(len(whole))
        for k, window in enumerate(windows_for(length[rest], capacity)):
            at = rest[window]
            sequence[at] = len(whole) + k
            offset[at] = np.cumsum(length[at]) - length[at]
        columns = [table["doc_id"].take(pa.array(of)), start, length, pc.list_flatten(table["crcs"]), tokens[of], group << 32 | sequence, offset]
        if with_ids:  # a document's pieces follow one another, as its ids do
            edges = pa.array(np.append(0, after).astype(np.int32))
            columns.append(pa.ListArray.from_arrays(edges, pc.list_flatten(table["ids"]).combine_chunks()))
        return pa.table(columns, schema=out)

    dealt = pieces.withColumn("group", F.pmod("deal", F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(frugal(run), schema)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


QUERIES = {"op9_packing": op9_packing}
ORACLE: dict[str, str] = {}
