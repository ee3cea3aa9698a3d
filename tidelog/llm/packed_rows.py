"""Packed rows: many small items of many owners in one row, dealt by a part of the items'
hash range.

A row has one binary column for each property of an owner, how many items each owner has,
and one binary column for each property of an item, owner by owner. Rows are made batch by
batch, so where there are very many parts a batch would fill each with an item or two. Then
items are dealt to coarse parts first, and within a task, which sees many batches of one
coarse part, packed again by finer parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.common import arrow_schema, frugal

#: Bits of the part that the first exchange goes by.
COARSE_BITS = 12
#: Items that a task packs again at once.
ITEMS = 4_000_000

Columns = dict[str, type]


def schema_of(owners: Columns, items: Columns, fine: int = 0) -> str:
    return ", ".join(["part int", *(f"{n} binary" for n in owners), "counts binary", *(f"{n} binary" for n in items), *["fine binary"] * (fine > 0)])


def rows_of(part: np.ndarray, owner: np.ndarray, owners: list[np.ndarray], items: list[np.ndarray]) -> list[tuple]:
    """Packed rows of items with a part and an owner, which is a place in owners' arrays;
    the items of an owner are together, and stay in order."""
    order = np.argsort(part, kind="stable")
    part, owner, items = part[order], owner[order], [x[order] for x in items]
    edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
    made = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
        own, n = np.unique(owner[a:b], return_counts=True)
        made.append((int(part[a]), *(x[own].tobytes() for x in owners), n.astype(np.uint32).tobytes(), *(x[a:b].tobytes() for x in items)))
    return made


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(schema)], schema=schema)


def fine_bits(bits: int) -> int:
    """Bits of a part's number that the first exchange leaves to the second."""
    return max(0, bits - COARSE_BITS)


def coarse(code: np.ndarray, bits: int, rest: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The part that items go to first, and the `rest` bits of their part's number that
    they must carry, if any."""
    part = (code >> np.uint64(64 - bits)).astype(np.int64)
    return (part, []) if not rest else (part >> rest, [(part & ((1 << rest) - 1)).astype(np.uint32)])


def finer(rows: DataFrame, bits: int, owners: Columns, items: Columns) -> DataFrame:
    """Rows by coarse parts, packed again by parts of `bits` bits."""
    rest = fine_bits(bits)
    if not rest:
        return rows
    out = arrow_schema(schema_of(owners, items))

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        joined = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind)
        counts = joined("counts", np.uint32)
        per_row = np.array([len(x) // 4 for x in table["fine"].to_pylist()])
        part = np.repeat(table["part"].to_numpy().astype(np.int64), per_row) << rest | joined("fine", np.uint32)
        owner = np.repeat(np.arange(len(counts)), counts)
        return batch_of(rows_of(part, owner, [joined(*c) for c in owners.items()], [joined(*c) for c in items.items()]), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += sum(len(x.as_buffer()) // 4 for x in batch.column(batch.schema.get_field_index("fine")))
            if size >= ITEMS:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return rows.repartition("part").mapInArrow(frugal(run), schema_of(owners, items))
