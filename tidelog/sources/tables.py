"""Log segments and sorted runs, both Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.model import CHANGES, DELETE, PUT, InvalidArgument, Options, Run, Segment
from tidelog.sources.files import Files

#: As CHANGES, but for data that was not checked yet.
LOOSE = T.StructType([T.StructField(f.name, f.dataType) for f in CHANGES])


def read_changes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The changes in some segments and runs; no path, no rows."""
    if not paths:
        return spark.createDataFrame([], CHANGES)
    return spark.read.schema(CHANGES).parquet(*paths)


def write_segment(changes: DataFrame, files: Files, root: str, number: int) -> Segment | None:
    """Appends a batch as a segment; None for an empty batch. The batch is checked where
    it was written, so its source is computed once; a bad one is removed again."""
    path = f"{root}/log/number={number:012d}-{uuid.uuid4().hex[:8]}"
    changes.select(*CHANGES.fieldNames()).write.parquet(path)
    written = changes.sparkSession.read.schema(LOOSE).parquet(path)
    known = F.col("key").isNotNull() & F.col("seq").isNotNull() & F.coalesce(F.col("op").isin(PUT, DELETE), F.lit(False))
    each = written.groupBy("key", "seq").agg(F.count("*").alias("n"), F.count(F.when(~known, 1)).alias("bad"))
    stats = each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.max("n").alias("most"),
        F.min("seq").alias("low"), F.max("seq").alias("high"),
    ).first()
    twice = not stats.bad and stats.n > 0 and stats.most > 1
    if not stats.n or stats.bad or twice:
        files.delete(path)
    if stats.bad:
        raise InvalidArgument(f"{stats.bad} rows without a key, an ordinal or a known op")
    if twice:
        raise InvalidArgument("a key comes twice; name a column that orders its rows")
    return Segment(number, path, stats.n, files.size(path), stats.low, stats.high) if stats.n else None


def write_run(state: DataFrame, files: Files, root: str, level: int, number: int, options: Options, bytes_in: int, rows_in: int) -> Run | None:
    """Writes one version a key as a run: range-partitioned and sorted by key, with a
    bloom filter on it, sized for the keys of a file at most, whose rate of false
    positives is that of an ideal filter with the given bits per key. Bounds come from an aggregate over what was written, never from
    file names. None if there is nothing to write."""
    path = f"{root}/level={level}/number={number:012d}-{uuid.uuid4().hex[:8]}"
    parts = max(1, -(-bytes_in // options.target_file_size))
    rows = state.select(*CHANGES.fieldNames()).repartitionByRange(parts, "key").sortWithinPartitions("key")
    writer = rows.write.option("parquet.page.size", str(options.block_size)).option("parquet.bloom.filter.enabled#key", str(options.bloom_bits_per_key > 0).lower())
    if options.bloom_bits_per_key:
        writer.option("parquet.bloom.filter.expected.ndv#key", str(max(1, -(-rows_in // parts)))).option("parquet.bloom.filter.fpp#key", str(max(1e-9, 0.6185**options.bloom_bits_per_key)))
    writer.option("parquet.block.size", str(max(options.block_size * 256, 8 << 20))).parquet(path)
    stats = read_changes(state.sparkSession, [path]).agg(
        F.count("*").alias("n"), F.sum((F.col("op") == DELETE).cast("long")).alias("deletes"), F.min("seq").alias("low"), F.max("seq").alias("high"),
        F.hex(F.min("key")).alias("smallest"), F.hex(F.max("key")).alias("largest"),
    ).first()
    if not stats.n:
        files.delete(path)
        return None
    return Run(level, number, path, stats.smallest.lower(), stats.largest.lower(), files.size(path), stats.n, stats.deletes, stats.low, stats.high)
