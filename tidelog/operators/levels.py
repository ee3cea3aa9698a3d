"""Which runs a read must look at and which a compaction takes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.model import Run


def run_order(runs) -> list[Run]:
    """Level 0 newest first, deeper levels by smallest key."""
    return sorted(runs, key=lambda r: (r.level, -r.number if r.level == 0 else 0, r.smallest, r.number))


def candidates(runs, key: bytes) -> list[Run]:
    """Runs whose key range holds the key, in the order in which they are newer."""
    return [r for r in run_order(runs) if r.overlaps(key.hex(), key.hex())]


def pick_level(runs, trigger: int) -> int | None:
    """Level 0 if it has more runs than the trigger."""
    return 0 if sum(r.level == 0 for r in runs) > trigger else None


def hull(runs) -> tuple[str, str]:
    """Least and greatest key of some runs."""
    return min(r.smallest for r in runs), max(r.largest for r in runs)


def pick_inputs(runs, level: int) -> list[Run]:
    """All runs of the level, and those of the next that meet the hull of their keys."""
    own = [r for r in runs if r.level == level]
    if not own:
        return []
    low, high = hull(own)
    return own + [r for r in runs if r.level == level + 1 and r.overlaps(low, high)]


def range_inputs(runs, low: str | None, high: str | None) -> tuple[list[Run], int]:
    """Runs that overlap [low, high], with what keeps the target level disjoint, and
    that level: one below the deepest input, but at least 1."""
    chosen = [r for r in runs if r.overlaps(low, high)]
    if not chosen:
        return [], 1
    while True:
        target = max(1, max(r.level for r in chosen))
        least, most = hull(chosen)
        more = [r for r in runs if r not in chosen and r.level == target and r.overlaps(least, most)]
        if not more:
            return chosen, target
        chosen += more


def run_table(entries: DataFrame) -> DataFrame:
    """(run, smallest, largest, entries) of each run of (run, key) rows."""
    return entries.groupBy("run").agg(F.min("key").alias("smallest"), F.max("key").alias("largest"), F.countDistinct("key").alias("entries"))


#: Rows of a run table that a join may send to all tasks, counted first.
BROADCAST_RUNS = 10_000
#: Cuts of the key space where a run table is larger.
CUTS = 256


def cuts(table: DataFrame, rows: int) -> list:
    """About CUTS keys that split the runs' smallest keys evenly, from a bounded sample."""
    share = int(min(1.0, 16 * CUTS / rows) * (1 << 30))
    found = [r[0] for r in table.where(F.pmod(F.xxhash64("run", "smallest"), F.lit(1 << 30)) < share).select("smallest").orderBy("smallest").toLocalIterator()]
    return sorted({found[len(found) * i // CUTS] for i in range(1, CUTS)}) if found else []


def piece(key: Column, edges: list) -> Column:
    """The piece of the key space that holds a key: how many cuts are not above it."""
    values = F.array(*[F.lit(bytearray(e) if isinstance(e, bytes | bytearray) else e) for e in edges])
    return F.size(F.filter(values, lambda e: e <= key)) if edges else F.lit(0)


def in_pieces(low: str, high: str, edges: list) -> Column:
    """All pieces that a range meets."""
    return F.sequence(piece(F.col(low), edges), piece(F.col(high), edges))


def candidate_join(probes: DataFrame, table: DataFrame) -> DataFrame:
    """(key, run) for each probe and each run whose range holds it. A run table that was
    counted and found small is sent to all tasks; a larger one is cut at pieces of the
    key space, which probes and runs are then joined by."""
    inside = F.col("key").between(F.col("smallest"), F.col("largest"))
    rows = table.count()
    if rows <= BROADCAST_RUNS:
        return probes.join(F.broadcast(table), inside)
    edges = cuts(table, rows)
    cut = table.withColumn("__piece", F.explode(in_pieces("smallest", "largest", edges)))
    return probes.withColumn("__piece", piece(F.col("key"), edges)).join(cut, "__piece").where(inside).drop("__piece")


def overlap_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of runs whose ranges meet; both are run tables. The right one is sent to all
    tasks if counted as small; else both are cut at pieces of the key space, and a pair
    counts in the first piece that both meet."""
    a = left.select(F.col("run").alias("run_a"), F.col("smallest").alias("sa"), F.col("largest").alias("la"))
    b = right.select(F.col("run").alias("run_b"), F.col("smallest").alias("sb"), F.col("largest").alias("lb"))
    meet = keys.overlap(F.col("sa"), F.col("la"), F.col("sb"), F.col("lb"))
    rows = right.count()
    if rows <= BROADCAST_RUNS:
        return a.join(F.broadcast(b), meet).select("run_a", "run_b")
    edges = cuts(right, rows)
    cut = lambda t, low, high: t.withColumn("__piece", F.explode(in_pieces(low, high, edges)))
    both = cut(a, "sa", "la").join(cut(b, "sb", "lb"), "__piece").where(meet)
    return both.where(F.col("__piece") == piece(F.greatest("sa", "sb"), edges)).select("run_a", "run_b")
