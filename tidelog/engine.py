"""The store: open, put, delete, get, scan, flush, compact.

A write is a committed log segment. A flush turns all segments into one sorted run on
level 0; a compaction merges runs. Each is published by one manifest version, so data is
always in exactly one place that readers see, and a crash loses nothing committed. One
writer at a time: the loser of a race gets Conflict and may reopen and retry.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions import keys
from tidelog.model import DELETE, PUT, InvalidArgument, NotFound, Options, ReadOptions, Run, Version
from tidelog.operators import levels, merge
from tidelog.sources import tables
from tidelog.sources.files import Files
from tidelog.sources.manifest import Manifest

#: Probe keys that a lookup may send to all tasks, counted first.
BROADCAST_KEYS = 100_000


class RunCache:
    """Runs that reads keep in Spark's cache, the least recently used going first where
    they exceed the bytes or the number allowed. Runs never change, so none grows stale."""

    def __init__(self, spark: SparkSession, options: Options):
        self.spark, self.most_bytes, self.most_runs = spark, options.block_cache_size, options.max_open_files
        self.held: OrderedDict[str, tuple[int, DataFrame]] = OrderedDict()

    def frame(self, run: Run, fill: bool) -> DataFrame | None:
        """The cached run; None if it isn't and shall not or cannot be."""
        if run.path in self.held:
            self.held.move_to_end(run.path)
        elif not fill or run.file_size > self.most_bytes:
            return None
        else:
            self.held[run.path] = run.file_size, tables.read_changes(self.spark, [run.path]).persist()
            while sum(n for n, _ in self.held.values()) > self.most_bytes or len(self.held) > self.most_runs:
                self.drop(next(iter(self.held)))
        return self.held[run.path][1]

    def drop(self, path: str) -> None:
        self.held.pop(path)[1].unpersist()

    def clear(self) -> None:
        for path in list(self.held):
            self.drop(path)


class Store:
    def __init__(self, spark: SparkSession, path: str, options: Options, manifest: Manifest, version: Version):
        self.spark, self.path, self.options = spark, path, options
        self.files, self.manifest, self.version = manifest.files, manifest, version
        self.cache = RunCache(spark, options)

    # -- life cycle

    @classmethod
    def open(cls, spark: SparkSession, path: str, options: Options | None = None) -> Store:
        """Opens the newest version; replays nothing, since segments are read in place."""
        options = options or Options()
        path = path.rstrip("/")
        manifest = Manifest(Files(spark, path), path)
        known = manifest.versions()
        if known and options.error_if_exists:
            raise InvalidArgument(f"{path} exists")
        if not known:
            if not options.create_if_missing:
                raise InvalidArgument(f"{path} does not exist")
            manifest.files.make(manifest.folder)
            version = manifest.commit(Version())
        else:
            version = manifest.load()
        return cls(spark, path, options, manifest, version)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Nothing is pending, for a commit is durable; only the cache is dropped."""
        self.cache.clear()

    def refresh(self) -> Version:
        """Moves to the newest published version."""
        self.version = self.manifest.load()
        return self.version

    def _commit(self, **changes) -> None:
        self.version = self.manifest.commit(self.version, **changes)
        for path in self.cache.held.keys() - {r.path for r in self.version.runs}:
            self.cache.drop(path)

    # -- writes

    def apply(self, changes: DataFrame, order: str | None = None, stream: tuple[str, int] | None = None) -> int:
        """Commits a batch of (key, op, value) rows and returns how many it has.

        seq is assigned here, once: the store's counter plus the row's ordinal, which
        `order` names (an integral column; of one key's rows the largest wins). Without
        it each key may come once in the batch. A stream batch that was applied before
        is skipped.
        """
        if stream and dict(self.version.streams).get(stream[0], -1) >= stream[1]:
            return 0
        rows = changes.select(
            F.col("key").cast("binary").alias("key"), F.col("op").cast("byte").alias("op"),
            F.when(F.col("op") == PUT, F.coalesce(F.col("value").cast("binary"), F.lit(bytearray()))).otherwise(F.lit(bytearray())).alias("value"),
            (F.col(order).cast("long") if order else F.lit(0).cast("long")).alias("ordinal"),
        )
        low = (rows.agg(F.min("ordinal")).first()[0] if order else 0) or 0
        base, number = self.version.next_seq, self.version.next_number
        batch = rows.withColumn("seq", F.col("ordinal") - F.lit(low) + F.lit(base)).drop("ordinal")
        segment = tables.write_segment(batch, self.files, self.path, number)
        streams = tuple(sorted((dict(self.version.streams) | dict([stream] if stream else [])).items()))
        if segment is None:
            if stream:
                self._commit(streams=streams)
            return 0
        self._commit(next_number=number + 1, next_seq=segment.max_seq + 1, segments=(*self.version.segments, segment), streams=streams)
        if self.options.auto_flush and sum(s.bytes for s in self.version.segments) >= self.options.write_buffer_size:
            self.flush()
        return segment.rows

    def put_all(self, rows: DataFrame, order: str | None = None) -> int:
        """Puts (key, value) rows."""
        return self.apply(rows.withColumn("op", F.lit(PUT)), order)

    def delete_all(self, rows: DataFrame, order: str | None = None) -> int:
        """Deletes (key) rows; a key that does not exist is no error."""
        return self.apply(rows.withColumn("op", F.lit(DELETE)).withColumn("value", F.lit(None).cast("binary")), order)

    def write(self, changes: Iterable[tuple[bytes | str, bytes | str | None]]) -> int:
        """Commits (key, value) pairs in order as one batch, durably, as all writes; a
        value of None deletes."""
        rows = [(keys.as_bytes(k), DELETE if v is None else PUT, None if v is None else keys.as_bytes(v), i) for i, (k, v) in enumerate(changes)]
        return self.apply(self.spark.createDataFrame(rows, "key binary, op byte, value binary, i long"), "i")

    def put(self, key: bytes | str, value: bytes | str) -> None:
        self.write([(key, value)])

    def delete(self, key: bytes | str) -> None:
        self.write([(key, None)])

    # -- reads

    def _read(self, runs: list[Run], options: ReadOptions) -> DataFrame:
        """The changes of all segments and of some runs, cached runs from the cache."""
        frames = {r.path: self.cache.frame(r, options.fill_cache) for r in runs}
        plain = [s.path for s in self.version.segments] + [p for p, frame in frames.items() if frame is None]
        return reduce(DataFrame.unionByName, [f for f in frames.values() if f is not None], tables.read_changes(self.spark, plain))

    def _changes(self, low: bytes | None = None, high: bytes | None = None, options: ReadOptions = ReadOptions()) -> DataFrame:
        """Changes that may concern [low, high], from segments and from the runs whose
        bounds meet it; both conditions reach the scan."""
        limit = [None if k is None else k.hex() for k in (low, high)]
        runs = levels.run_order(r for r in self.version.runs if r.overlaps(*limit))
        return self._read(runs, options).where(keys.in_range(F.col("key"), low, high, closed=True))

    def lookup(self, key: bytes | str, options: ReadOptions = ReadOptions()) -> DataFrame:
        """(key, status, value) of one key, from the files that may hold it."""
        key = keys.as_bytes(key)
        return merge.lookup(self._point(key, options), self.spark.createDataFrame([(key,)], "key binary"))

    def _point(self, key: bytes, options: ReadOptions) -> DataFrame:
        """Changes of one key, from the segments and the runs whose bounds hold it."""
        return self._read(levels.candidates(self.version.runs, key), options).where(F.col("key") == keys.literal(key))

    def get(self, key: bytes | str, options: ReadOptions = ReadOptions()) -> bytes:
        """The key's value; raises NotFound("deleted") or NotFound("not found")."""
        key = keys.as_bytes(key)
        newest = self._point(key, options).agg(F.max_by(F.struct("op", "value"), "seq").alias("v")).first().v
        if newest is None:
            raise NotFound("not found")
        if newest.op != PUT:
            raise NotFound("deleted")
        return bytes(newest.value)

    def multi_get(self, probes: DataFrame, options: ReadOptions = ReadOptions()) -> DataFrame:
        """(key, status, value) for each row of probes (key). Few keys bound the files
        and are sent to all tasks; many are joined by shuffle."""
        probes = probes.select(F.col("key").cast("binary").alias("key"))
        bounds = probes.agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n")).first()
        if not bounds.n:
            return merge.lookup(tables.read_changes(self.spark, []), probes)
        found = self._changes(bytes(bounds.low) if bounds.low is not None else None, bytes(bounds.high) if bounds.high is not None else None, options)
        small = bounds.n <= BROADCAST_KEYS
        distinct = probes.distinct()
        wanted = found.join(F.broadcast(distinct) if small else distinct, "key", "left_semi")
        return merge.lookup(wanted, probes)

    def scan(self, low: bytes | str | None = None, high: bytes | str | None = None, options: ReadOptions = ReadOptions()) -> DataFrame:
        """(key, value) of the live keys with low <= key < high, in order."""
        low, high = (None if k is None else keys.as_bytes(k) for k in (low, high))
        found = self._changes(low, high, options).where(keys.in_range(F.col("key"), low, high))
        return merge.live(found).orderBy("key")

    def prefix(self, prefix: bytes | str, options: ReadOptions = ReadOptions()) -> DataFrame:
        prefix = keys.as_bytes(prefix)
        return self.scan(prefix, keys.successor(prefix), options)

    def live(self, options: ReadOptions = ReadOptions()) -> DataFrame:
        """(key, value) of all live keys, in no order."""
        return merge.live(self._changes(options=options))

    def snapshot(self) -> DataFrame:
        """(key, op, value, seq) of all keys in order, tombstones included."""
        return merge.snapshot(self._changes())

    def at(self, version: int) -> Store:
        """The store as of an earlier manifest version that vacuum() has not removed;
        for reading."""
        return Store(self.spark, self.path, self.options, self.manifest, self.manifest.load(version))

    # -- maintenance

    def flush(self) -> Run | None:
        """Turns all segments into one run on level 0; without segments, nothing."""
        segments = self.version.segments
        if not segments:
            return None
        state = merge.latest(tables.read_changes(self.spark, [s.path for s in segments]))
        number = self.version.next_number
        run = tables.write_run(state, self.files, self.path, 0, number, self.options, sum(s.bytes for s in segments), sum(s.rows for s in segments))
        self._commit(next_number=number + 1, segments=(), runs=(*self.version.runs, run))
        if self.options.auto_compact:
            self.maybe_compact()
        return run

    def maybe_compact(self) -> Run | None:
        """Compacts level 0 into level 1 if it has more runs than the trigger."""
        level = levels.pick_level(self.version.runs, self.options.level0_trigger)
        return None if level is None else self._compact(levels.pick_inputs(self.version.runs, level), level + 1)

    def compact_range(self, low: bytes | str | None = None, high: bytes | str | None = None) -> Run | None:
        """Merges all runs that overlap [low, high] into one."""
        low, high = (None if k is None else keys.as_bytes(k).hex() for k in (low, high))
        if low is not None and high is not None and low > high:
            raise InvalidArgument("the lower bound is above the upper")
        inputs, target = levels.range_inputs(self.version.runs, low, high)
        return self._compact(inputs, min(target, self.options.num_levels - 1))

    def _compact(self, inputs: list[Run], target: int) -> Run | None:
        if not inputs:
            return None
        left = [r for r in self.version.runs if r not in inputs]
        newest = max(r.max_seq for r in inputs)
        blockers = [r for r in left if r.min_seq < newest] if self.options.drop_tombstones else None
        state = merge.compact(tables.read_changes(self.spark, [r.path for r in inputs]), blockers)
        number = self.version.next_number
        run = tables.write_run(state, self.files, self.path, target, number, self.options, sum(r.file_size for r in inputs), sum(r.entries for r in inputs))
        self._commit(next_number=number + 1, runs=tuple(left) + ((run,) if run else ()))
        return run

    def vacuum(self, keep_versions: int = 1) -> int:
        """Removes older versions, and data that no remaining version names; how many
        paths went. Only for times when no other writer and no reader of an older
        version is at work."""
        last = self.manifest.load().version
        self.manifest.forget(last - keep_versions + 1)
        named = set()
        for v in self.manifest.versions():
            version = self.manifest.load(v)
            named |= {x.path.rsplit("/", 1)[1] for x in (*version.segments, *version.runs)}
        gone = 0
        for folder in self.files.names(self.path):
            if folder == "log" or folder.startswith("level="):
                for name in self.files.names(f"{self.path}/{folder}"):
                    if name not in named:
                        self.files.delete(f"{self.path}/{folder}/{name}")
                        gone += 1
        return gone
