"""What of a log survives a crash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def valid_prefix(records: DataFrame, ok: str = "ok") -> DataFrame:
    """Records (segment, pos, ok, ...) before the first bad one of their segment. The
    position of that one is an aggregate with map-side combine, joined back, so a long
    segment is no single task's work."""
    first_bad = records.where(~F.col(ok)).groupBy("segment").agg(F.min("pos").alias("__bad"))
    out = records.join(first_bad, "segment", "left")
    return out.where(F.col("__bad").isNull() | (F.col("pos") < F.col("__bad"))).drop("__bad")


def discarded(records: DataFrame, ok: str = "ok") -> DataFrame:
    """(segment, records, kept, discarded)."""
    total = records.groupBy("segment").agg(F.count("*").alias("records"))
    kept = valid_prefix(records, ok).groupBy("segment").agg(F.count("*").alias("kept"))
    both = total.join(kept, "segment", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return both.withColumn("discarded", F.col("records") - F.col("kept"))


#: Generations numbered together.
STRETCH = 100_000


def generations(log: DataFrame) -> DataFrame:
    """Numbers for files in the order they are made: log k, then its table, and so on;
    (generation, log_number, table_number) from (generation) rows, one per rotation.
    Rows are numbered within stretches of generations, after the sum of all stretches
    before, so no task orders more than a stretch, or one row for each."""
    rows = log.select("generation", F.floor(F.col("generation") / STRETCH).alias("stretch"))
    before = F.sum("n").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy("stretch").agg(F.count("*").alias("n")).select("stretch", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("stretch").orderBy("generation"))
    order = (F.col("place") + F.col("before")).cast("long")
    return rows.withColumn("place", place).join(offsets, "stretch").select("generation", (2 * order - 1).alias("log_number"), (2 * order).alias("table_number"))
