"""Newest version per key, and what follows from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.model import DELETE, PUT, Run


def latest(changes: DataFrame) -> DataFrame:
    """The newest change of each key, tombstones included.

    One aggregation with map-side combine: a hot key shrinks to one row per task
    before the shuffle. `op` must not be filtered before this, or deletes are undone.
    """
    newest = F.max_by(F.struct("op", "value", "seq"), "seq").alias("v")
    return changes.groupBy("key").agg(newest).select("key", "v.op", "v.value", "v.seq")


def live(changes: DataFrame) -> DataFrame:
    """Keys that hold a value now."""
    return latest(changes).where(F.col("op") == PUT).select("key", "value")


def snapshot(changes: DataFrame) -> DataFrame:
    """All keys in order with their newest change; a tombstone has an empty value."""
    state = latest(changes)
    empty = F.lit("").cast(state.schema["value"].dataType)
    return state.withColumn("value", F.when(F.col("op") == DELETE, empty).otherwise(F.col("value"))).orderBy("key")


def merge_ranked(changes: DataFrame, rank: str) -> DataFrame:
    """K-way merge of runs: of each key the change of the lowest rank (the newest run).
    Within a run a key occurs once; ties fall to the larger seq."""
    best = F.min_by(F.struct("op", "value", "seq"), F.struct(rank, (-F.col("seq")).alias("s"))).alias("v")
    return changes.groupBy("key").agg(best).select("key", "v.op", "v.value", "v.seq")


def lookup(changes: DataFrame, probes: DataFrame) -> DataFrame:
    """(key, status, value) for each probe key; probes (key) are kept as they come."""
    wanted = changes.join(probes.select("key").distinct(), "key", "left_semi")
    state = latest(wanted).withColumn("found", F.lit(True))
    out = probes.join(state, "key", "left")
    found = F.coalesce("found", F.lit(False))
    return out.select("key", keys.status(found, F.col("op")).alias("status"), F.when(F.col("op") == PUT, F.col("value")).alias("value"))


def compact(changes: DataFrame, blockers: list[Run] | None) -> DataFrame:
    """The newest change of each key of some runs. `blockers` are the runs left out that
    may hold an older version: a tombstone stays only where one's key range holds its
    key. None keeps all tombstones."""
    state = latest(changes)
    if blockers is None:
        return state
    hidden = [keys.in_range(F.col("key"), low, high, closed=True) for low, high in merged_ranges(blockers)]
    needed: Column = reduce(lambda a, b: a | b, hidden, F.lit(False))
    return state.where((F.col("op") == PUT) | needed)


def merged_ranges(runs: list[Run], most: int = 64) -> list[tuple[bytes, bytes]]:
    """Disjoint closed ranges that cover the runs; beyond `most`, neighbours are joined,
    which keeps more tombstones than it must but never too few."""
    out: list[list[bytes]] = []
    for run in sorted(runs, key=lambda r: r.smallest):
        low, high = bytes.fromhex(run.smallest), bytes.fromhex(run.largest)
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    step = -(-len(out) // most) or 1
    return [(out[i][0], out[min(i + step, len(out)) - 1][1]) for i in range(0, len(out), step)]
