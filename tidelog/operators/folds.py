"""Sequential folds: buffer rotation and block building.

Both depend on all rows before, in order. A run's blocks are one task's work; callers keep
runs bounded. A log of any length is cut into pieces, which are folded from every row where
a generation can start, and then linked.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.sources.scratch import folder

#: Bytes charged for an entry besides key and value, as a typical 64-bit layout has it.
ENTRY_BYTES = 40

#: A log of at most so many rows is folded by one task; a longer one in pieces of about as many.
PIECE_ROWS = 200_000


def varint_size(n: F.Column) -> F.Column:
    """Bytes of n as a varint: seven bits a byte."""
    size = F.lit(1)
    for bits in range(7, 36, 7):
        size += (n >= F.lit(1 << bits)).cast("int")
    return size


def encoded_size(key_bytes: F.Column, value_bytes: F.Column) -> F.Column:
    """Bytes of an entry in a data block: both lengths, the key, a type byte, the value."""
    return varint_size(key_bytes) + varint_size(value_bytes + 1) + key_bytes + 1 + value_bytes


def blocks(entries: DataFrame, target: int) -> DataFrame:
    """(run, block, first_key, entries, bytes) of (run, key, size) rows: entries fill a
    block in key order; the block ends with the entry that reaches the target."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        out, run = [], table["run"][0].as_py()
        first, count, size = None, 0, 0
        for key, n in zip(table["key"].to_pylist(), table["size"].to_pylist()):
            first = key if count == 0 else first
            count, size = count + 1, size + n
            if size >= target:
                out.append((run, len(out), first, count, size))
                count = size = 0
        if count:
            out.append((run, len(out), first, count, size))
        return pa.table({name: [r[i] for r in out] for i, name in enumerate(("run", "block", "first_key", "entries", "bytes"))}, schema=arrow)

    key_type = entries.schema["key"].dataType.simpleString()
    arrow = pa.schema([("run", pa.int64()), ("block", pa.int64()), ("first_key", pa.string() if key_type == "string" else pa.binary()), ("entries", pa.int64()), ("bytes", pa.int64())])
    rows = entries.select(F.col("run").cast("long").alias("run"), "key", F.col("size").cast("long").alias("size"))
    return rows.groupBy("run").applyInArrow(fold, f"run long, block long, first_key {key_type}, entries long, bytes long")


def rotations(log: DataFrame, threshold: int) -> DataFrame:
    """(log, generation, first_seq, last_seq, entries, bytes): the buffer's generations
    over (log, seq, key, key_bytes, value_bytes). A key new to the buffer is charged key,
    value and ENTRY_BYTES, an overwrite its value; the buffer rotates when the charge
    reaches the threshold, which is positive. The last generation may be open. All rows of
    a key have the same key_bytes. Logs are counted first; long ones that have a name are
    folded in pieces here and now, into a table in the shared folder."""
    rows = log.select(F.col("log").cast("long").alias("log"), F.col("seq").cast("long").alias("seq"), "key", F.col("key_bytes").cast("long").alias("key_bytes"), F.col("value_bytes").cast("long").alias("value_bytes"))
    long = {r["log"]: r["n"] for r in rows.groupBy("log").agg(F.count("*").alias("n")).where((F.col("n") > PIECE_ROWS) & F.col("log").isNotNull()).collect()}
    if not long:
        return _whole(rows, threshold)
    is_long = F.coalesce(F.col("log").isin(list(long)), F.lit(False))
    return _pieces(rows.where(is_long), -(-sum(long.values()) // PIECE_ROWS), threshold).unionByName(_whole(rows.where(~is_long), threshold))


def _whole(rows: DataFrame, threshold: int) -> DataFrame:
    """The generations of logs, each in one task."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        out, name = [], table["log"][0].as_py()
        seen, first, last, rows, size = set(), 0, 0, 0, 0
        for seq, key, k, v in zip(*(table[c].to_pylist() for c in ("seq", "key", "key_bytes", "value_bytes"))):
            first = seq if rows == 0 else first
            size += v if key in seen else k + v + ENTRY_BYTES
            seen.add(key)
            rows, last = rows + 1, seq
            if size >= threshold:
                out.append((name, len(out), first, last, rows, size))
                seen, rows, size = set(), 0, 0
        if rows:
            out.append((name, len(out), first, last, rows, size))
        return pa.table({c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("log", "generation", "first_seq", "last_seq", "entries", "bytes"))})

    return rows.groupBy("log").applyInArrow(fold, "log long, generation long, first_seq long, last_seq long, entries long, bytes long")


# A generation depends on no row before its first, so where it ends is a function of where
# it starts; a later start never ends earlier. Each piece of a log (a range of its rows)
# follows the chains of generations from all rows where one may start that the pieces
# before leave open: such chains meet, and those that pass through one start after equally
# many generations come from neighbouring entries, low to high. What a piece leaves open
# ends in the rows of a later piece before the end of the one generation that starts at
# its first row, its head; so groups of a piece's last rows, pieces in which no generation
# ends, and the next head are folded likewise. Then one row an exit is left to walk along.
#
# Rows in these small tables:
#   piece  entries: rows of the piece; closed: whether a generation ends in it
#   head   a row of a head
#   open   a row that may be in an open generation; start: one may begin there. Rows that
#          no generation in question is charged for are left out of both
#   node   a generation, the depth-th of the chains from entries low to high
#   exit   where (at) these chains leave, after depth generations
# Places (at, low, high) are counted from the first row of the piece, or of the log.
_NODE = "kind string, at long, depth long, low long, high long, first_seq long, last_seq long, entries long, bytes long"


def _links(keys: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The rows before and after each with the same key; -1 or the number of rows: none."""
    codes = keys.combine_chunks().dictionary_encode("encode").indices.to_numpy()
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    before, after = np.full(len(codes), -1), np.full(len(codes), len(codes))
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]
    return before, after


def _closings(before: np.ndarray, after: np.ndarray, key_bytes: np.ndarray, value_bytes: np.ndarray, threshold: int, starts: int) -> tuple[list[int], list[int]]:
    """Of generations that start at each of the first rows: the rows after their last ones,
    up to the first that is still open at the end; the charges of all."""
    before, after, value, new = before.tolist(), after.tolist(), value_bytes.tolist(), (key_bytes + value_bytes + ENTRY_BYTES).tolist()
    n, j, size, ends, sizes = len(value), 0, 0, [], []
    for i in range(starts):
        while size < threshold and j < n:
            size += value[j] if before[j] >= i else new[j]
            j += 1
        if size >= threshold:
            ends.append(j)
        sizes.append(size)
        size -= value[i] if after[i] < j else new[i]
    return ends, sizes


def _chains(entries: Iterable[int], ends: list[int]) -> tuple[list[tuple], list[tuple]]:
    """(start, depth, low, high) of the generations that chains from the entries reach and
    that end, and of the places where the chains stop."""
    reached = {e: {0: (e, e)} for e in entries}
    nodes = []
    for i, j in enumerate(ends):
        for depth, (low, high) in reached.pop(i, {}).items():
            nodes.append((i, depth, low, high))
            to = reached.setdefault(j, {})
            known = to.get(depth + 1, (low, high))
            to[depth + 1] = min(low, known[0]), max(high, known[1])
    return nodes, [(i, depth, low, high) for i, at in reached.items() for depth, (low, high) in at.items()]


def _columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    """Columns without nulls."""
    return [table[c].combine_chunks().to_numpy(zero_copy_only=True) for c in names]


def _pieces(rows: DataFrame, parts: int, threshold: int) -> DataFrame:
    """The generations of logs, cut into about so many pieces."""
    found_type = T._parse_datatype_string(f"{_NODE}, log long, piece long, closed long, seq long, start boolean, key_bytes long, value_bytes long").add("key", rows.schema["key"].dataType)
    schema = to_arrow_schema(found_type)

    def made(kind: str, log: int, piece: int, **columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns |= {"kind": [kind] * n, "log": [log] * n, "piece": [piece] * n}
        arrays = [columns.get(f.name) for f in schema]
        return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if a is None else a.cast(f.type) if isinstance(a, pa.Array) else pa.array(a, f.type) for f, a in zip(schema, arrays)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table, piece = pa.Table.from_batches(batches), TaskContext.get().partitionId()
        logs = _columns(table, "log")[0]
        edges = [0, *(np.flatnonzero(logs[1:] != logs[:-1]) + 1).tolist(), len(logs)]
        for a, b in zip(edges, edges[1:]):
            yield from fold(table["log"][a].as_py(), piece, table.slice(a, b - a))

    def fold(log: int, piece: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        seq, key_bytes, value_bytes = _columns(table, "seq", "key_bytes", "value_bytes")
        n = len(seq)
        before, after = _links(table["key"])
        ends, sizes = _closings(before, after, key_bytes, value_bytes, threshold, n)
        head = ends[0] if ends else n
        charged = (value_bytes > 0) | (before < 0)
        entries = [0, *(np.flatnonzero(charged[:head]) + 1).tolist()]
        yield made("piece", log, piece, entries=[n], closed=[int(bool(ends))])
        if ends:
            nodes, exits = _chains(entries, ends)
            start, depth, low, high = np.array(nodes, "int64").reshape(-1, 4).T
            end = np.array(ends, "int64")[start]
            yield made("node", log, piece, at=start, depth=depth, low=low, high=high, first_seq=seq[start], last_seq=seq[end - 1], entries=end - start, bytes=np.array(sizes, "int64")[start])
            at, depth, low, high = np.array(exits, "int64").reshape(-1, 4).T
            yield made("exit", log, piece, at=at, depth=depth, low=low, high=high)
            yield picked("head", log, piece, table, np.flatnonzero(charged[:head]), [0])
            open_ = shown = np.unique(at[at < n])
        else:
            open_, shown = np.array([e for e in entries if e < n], "int64"), [0]
        if len(open_):
            place = np.arange(open_[0], n)
            newest = open_[np.searchsorted(open_, place, "right") - 1]
            kept = (value_bytes[place] > 0) | (before[place] < newest) | (place == n - 1)
            yield picked("open", log, piece, table, place[kept], shown)

    def picked(kind: str, log: int, piece: int, table: pa.Table, place: np.ndarray, starts) -> pa.RecordBatch:
        some = table.select(["seq", "key", "key_bytes", "value_bytes"]).take(pa.array(place))
        return made(kind, log, piece, at=place, start=np.isin(place, starts), **{c: some[c].combine_chunks() for c in some.column_names})

    # the ranges' bounds come from a sample of the rows, so all that follows reads one run's output
    path = folder(rows.sparkSession, "rotations")
    rows.repartitionByRange(parts, "log", "seq").sortWithinPartitions("log", "seq").mapInArrow(cut, found_type).write.parquet(path)
    found = rows.sparkSession.read.schema(found_type).parquet(path)

    in_order = Window.partitionBy("log").orderBy("piece")
    pieces = found.where("kind = 'piece'").select(
        "log", "piece", F.sum("closed").over(in_order).alias("group"), F.coalesce(F.sum("entries").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    placed = found.where("kind <> 'piece'").join(pieces, ["log", "piece"])
    shifted = [(F.col(c) + F.col("before")).alias(c) for c in ("at", "low", "high")]
    same = ["kind", "depth", "first_seq", "last_seq", "entries", "bytes"]
    inner = placed.where("kind in ('node', 'exit')").select("log", (2 * F.col("group") - 1).alias("unit"), *same, *shifted)
    groups = placed.where("kind in ('head', 'open')").select(
        "log", (2 * F.when(F.col("kind") == "head", F.col("group") - 1).otherwise(F.col("group"))).alias("unit"), "kind", (F.col("at") + F.col("before")).alias("at"), "seq", "key", "key_bytes", "value_bytes", "start"
    )
    outer = groups.groupBy("log", "unit").applyInArrow(lambda table: _between(table, threshold), f"log long, unit long, {_NODE}")
    every = inner.unionByName(outer)
    walked = every.where("kind = 'exit'").select("log", "unit", "at", "depth", "low", "high").groupBy("log").applyInArrow(_walk, "log long, unit long, entry long, base long")
    return every.where("kind = 'node'").join(walked, ["log", "unit"]).where("entry between low and high").select(
        "log", (F.col("base") + F.col("depth")).alias("generation"), "first_seq", "last_seq", "entries", "bytes"
    )


def _between(table: pa.Table, threshold: int) -> pa.Table:
    """The nodes and exits of the rows from one piece's last to the next head."""
    table = table.sort_by("at")
    at, seq, key_bytes, value_bytes = _columns(table, "at", "seq", "key_bytes", "value_bytes")
    last = table["kind"][-1].as_py() == "open"
    n = len(at) if last else table["kind"].to_pylist().index("head")
    before, after = _links(table["key"])
    ends, sizes = _closings(before, after, key_bytes, value_bytes, threshold, n)
    starts = np.flatnonzero(np.array(table["start"].to_pylist())).tolist()
    nodes, exits = _chains(starts + [len(at)] if last else starts, ends)
    at = np.append(at, at[-1] + 1)
    out = [("node", int(at[i]), depth, int(at[low]), int(at[high]), int(seq[i]), int(seq[ends[i] - 1]), int(at[ends[i] - 1] - at[i]) + 1, sizes[i]) for i, depth, low, high in nodes]
    for i, depth, low, high in exits:
        if last and i < n:
            out.append(("node", int(at[i]), depth, int(at[low]), int(at[high]), int(seq[i]), int(seq[-1]), int(at[-1] - at[i]), sizes[i]))
        # the row after the last is the next of the log, kept here or not
        out.append(("exit", int(at[i - 1]) + 1 if depth else int(at[i]), depth, int(at[low]), int(at[high]), None, None, None, None))
    columns = {"log": pa.array([table["log"][0].as_py()] * len(out), pa.int64()), "unit": pa.array([table["unit"][0].as_py()] * len(out), pa.int64())}
    for i, c in enumerate(c.split()[0] for c in _NODE.split(", ")):
        columns[c] = pa.array([r[i] for r in out], pa.int64() if i else pa.string())
    return pa.table(columns)


def _walk(table: pa.Table) -> pa.Table:
    """Where the log's one chain enters each unit, and the generations before."""
    table = table.sort_by([("unit", "ascending"), ("low", "ascending")])
    unit, at, depth, low, high = _columns(table, "unit", "at", "depth", "low", "high")
    edges = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
    entry, base, out = 0, 0, []
    for a, b in zip(edges, edges[1:]):
        i = a + int(np.searchsorted(low[a:b], entry, "right")) - 1
        if i < a or high[i] < entry:
            raise AssertionError(f"no chain from row {entry} of log {table['log'][0].as_py()}")
        out.append((int(unit[a]), entry, base))
        entry, base = int(at[i]), base + int(depth[i])
    columns = {"log": pa.array([table["log"][0].as_py()] * len(out), pa.int64())}
    return pa.table(columns | {c: pa.array([r[i] for r in out], pa.int64()) for i, c in enumerate(("unit", "entry", "base"))})
