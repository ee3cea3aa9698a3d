"""The query catalogue: each query with the SQL that must give the same rows.

All derive one change log from `events`: a key per user and event type, the event's id as
seq, every fourth event a delete. `run` deals the log into runs of 1000 changes.
"""

from __future__ import annotations

import posixpath
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.engine import Store
from tidelog.functions import keys
from tidelog.functions.hashing import PRIME, SEED, bloom_build, bloom_may_contain_all, hash64_column
from tidelog.model import DELETE, OK, PUT, NotFound, Options, ReadOptions
from tidelog.operators import folds, levels, merge, wal
from tidelog.sources import codec
from tidelog.sources.scratch import folder
from tidelog.streaming.ingest import ingest

BLOCK_BYTES, BUFFER_BYTES = 4096, 16384
PROBES = ("000001:click", "000002:view", "000003:purchase", "000004:signup", "000005:click", "000006:view", "000007:logout", "999999:click", "000012:")

LOG = (
    "L AS (SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') || ':' || event_type AS key, event_id AS seq, "
    "CASE WHEN event_id % 4 = 0 THEN 2 ELSE 1 END AS op, CASE WHEN event_id % 4 = 0 THEN '' ELSE props END AS value, "
    "event_id // 1000 AS run FROM events)"
)
LATEST = "T AS (SELECT * FROM L QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"
RUNS = "R AS (SELECT run, min(key) AS smallest, max(key) AS largest, count(DISTINCT key) AS entries FROM L GROUP BY run)"
STATUS = "CASE WHEN T.op = 1 THEN 'OK' WHEN T.op = 2 THEN 'NotFound: deleted' ELSE 'NotFound: not found' END"


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log (key, op, value, seq, run) as a projection of `events`."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    deleted = F.col("event_id") % 4 == 0
    return events.select(
        F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), "event_type").alias("key"),
        F.when(deleted, DELETE).otherwise(PUT).alias("op"),
        F.when(deleted, "").otherwise(F.col("props")).alias("value"),
        F.col("event_id").alias("seq"),
        F.floor(F.col("event_id") / 1000).cast("long").alias("run"),
    )


def plain(frame: DataFrame) -> DataFrame:
    """Binary columns as strings, small integers as bigint."""
    kinds = dict(frame.dtypes)
    cast = {"binary": "string", "tinyint": "bigint", "int": "bigint"}
    return frame.select(*[F.col(c).cast(cast.get(k, k)).alias(c) for c, k in kinds.items()])


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE[function.__name__] = sql
        return function

    return add


# -- on the change log alone


@query(f"WITH {LOG}, {LATEST} SELECT key, value FROM T WHERE op = 1")
def q_live(spark, sf_dir):
    return merge.live(changes(spark, sf_dir))


@query(f"WITH {LOG} SELECT key, value, seq FROM L WHERE op = 1 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def q_overwrite(spark, sf_dir):
    return merge.latest(changes(spark, sf_dir).where(F.col("op") == PUT)).select("key", "value", "seq")


@query(f"WITH {LOG}, {LATEST}, P AS (SELECT '{PROBES[0]}' AS key) SELECT P.key, {STATUS} AS status, CASE WHEN T.op = 1 THEN T.value END AS value FROM P LEFT JOIN T ON P.key = T.key")
def q_get(spark, sf_dir):
    probe = spark.createDataFrame([(PROBES[0],)], "key string")
    return merge.lookup(changes(spark, sf_dir).where(F.col("key") == PROBES[0]), probe)


@query(
    f"WITH {LOG}, {LATEST}, P AS (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS key) "
    f"SELECT P.key, {STATUS} AS status, CASE WHEN T.op = 1 THEN T.value END AS value FROM P LEFT JOIN T ON P.key = T.key"
)
def q_multi_get(spark, sf_dir):
    probes = spark.createDataFrame([(p,) for p in PROBES], "key string")
    return merge.lookup(changes(spark, sf_dir), probes)


@query(f"WITH {LOG}, {LATEST} SELECT key, CAST(op AS BIGINT) AS op, value, seq FROM T")
def q_snapshot(spark, sf_dir):
    return plain(merge.snapshot(changes(spark, sf_dir)))


@query(f"WITH {LOG}, {LATEST} SELECT key, value FROM T WHERE op = 1 AND key >= '000010' AND key < '000020'")
def q_range_scan(spark, sf_dir):
    return merge.live(changes(spark, sf_dir).where((F.col("key") >= "000010") & (F.col("key") < "000020")))


@query(f"WITH {LOG}, {LATEST} SELECT key, value FROM T WHERE op = 1 AND starts_with(key, '000012:')")
def q_prefix_scan(spark, sf_dir):
    log = changes(spark, sf_dir)
    return merge.live(log.where(keys.with_prefix(F.col("key").cast("binary"), b"000012:")))


@query(
    f"WITH {LOG}, S AS (SELECT run AS segment, seq AS pos, key, seq % 1000 <> 700 + run AS ok FROM L) "
    "SELECT segment, pos, key FROM S QUALIFY min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY pos) = 1"
)
def q_wal_prefix(spark, sf_dir):
    return wal.valid_prefix(_wal(spark, sf_dir)).select("segment", "pos", "key")


@query(
    f"WITH {LOG}, S AS (SELECT run AS segment, seq AS pos, seq % 1000 <> 700 + run AS ok FROM L), "
    "K AS (SELECT *, min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY segment ORDER BY pos) AS good FROM S) "
    "SELECT segment, count(*) AS records, CAST(sum(good) AS BIGINT) AS kept, CAST(count(*) - sum(good) AS BIGINT) AS discarded FROM K GROUP BY segment"
)
def q_wal_discarded(spark, sf_dir):
    return wal.discarded(_wal(spark, sf_dir))


def _wal(spark, sf_dir):
    log = changes(spark, sf_dir)
    return log.select(F.col("run").alias("segment"), F.col("seq").alias("pos"), "key", (F.col("seq") % 1000 != 700 + F.col("run")).alias("ok"))


@query(f"WITH {LOG}, {RUNS} SELECT run, smallest, largest, entries FROM R")
def q_run_meta(spark, sf_dir):
    return levels.run_table(changes(spark, sf_dir))


@query(f"WITH {LOG}, {RUNS}, P AS (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS key) SELECT P.key, count(*) AS candidates FROM P JOIN R ON P.key BETWEEN smallest AND largest GROUP BY P.key")
def q_candidates(spark, sf_dir):
    probes = spark.createDataFrame([(p,) for p in PROBES], "key string")
    return levels.candidate_join(probes, levels.run_table(changes(spark, sf_dir))).groupBy("key").agg(F.count("*").alias("candidates"))


@query(
    f"WITH {LOG}, {RUNS}, H AS (SELECT min(smallest) AS lo, max(largest) AS hi FROM R WHERE run >= 5) "
    "SELECT run, smallest, largest FROM R, H WHERE run < 5 AND NOT (smallest > hi OR largest < lo)"
)
def q_overlap(spark, sf_dir):
    table = levels.run_table(changes(spark, sf_dir))
    hull = table.where("run >= 5").agg(F.lit(-1).alias("run"), F.min("smallest").alias("smallest"), F.max("largest").alias("largest"))
    met = levels.overlap_join(table.where("run < 5"), hull).select(F.col("run_a").alias("run"))
    return table.join(met, "run", "left_semi").select("run", "smallest", "largest")


@query(f"WITH {LOG}, {LATEST} SELECT key, CAST(op AS BIGINT) AS op, value, seq FROM T")
def q_merge_ranked(spark, sf_dir):
    """Runs 0 to 4 are an older level, later runs level 0, the newest first."""
    log = changes(spark, sf_dir)
    rank = F.when(F.col("run") < 5, F.lit(1 << 40) - F.col("run")).otherwise(-F.col("run"))
    return plain(merge.merge_ranked(log.withColumn("rank", rank), "rank"))


def older(log: DataFrame) -> DataFrame:
    """The older half of all runs, as inputs of a compaction."""
    return log.where(F.col("run") <= (log.agg(F.max("run")).first()[0] or 0) // 2)


OLDER = "run <= (SELECT coalesce(max(run), 0) // 2 FROM L)"


@query(f"WITH {LOG}, O AS (SELECT * FROM L WHERE {OLDER}) SELECT key, CAST(op AS BIGINT) AS op, value, seq FROM O QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1")
def q_compact_keep(spark, sf_dir):
    return plain(merge.compact(older(changes(spark, sf_dir)), None))


@query(f"WITH {LOG}, O AS (SELECT * FROM L WHERE {OLDER} QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1) SELECT key, CAST(op AS BIGINT) AS op, value, seq FROM O WHERE op = 1")
def q_compact_drop(spark, sf_dir):
    return plain(merge.compact(older(changes(spark, sf_dir)), []))


BY_RUN_BLOCKS = f"""
WITH RECURSIVE {LOG},
E AS (SELECT run, key, octet_length(encode(key)) AS k, octet_length(encode(value)) AS v FROM L QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1),
S AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY key) AS i, key, 1 + (k >= 128)::INT + (k >= 16384)::INT + 1 + (v + 1 >= 128)::INT + (v + 1 >= 16384)::INT + k + 1 + v AS size FROM E),
B AS (SELECT run, i, key, 0 AS block, size AS total FROM S WHERE i = 1
      UNION ALL SELECT S.run, S.i, S.key, CASE WHEN B.total >= {BLOCK_BYTES} THEN B.block + 1 ELSE B.block END, CASE WHEN B.total >= {BLOCK_BYTES} THEN S.size ELSE B.total + S.size END
      FROM B JOIN S ON S.run = B.run AND S.i = B.i + 1),
D AS (SELECT run, block, min(key) AS first_key, count(*) AS entries, max(total) AS bytes FROM B GROUP BY run, block),
I AS (SELECT run, block, first_key, entries, bytes, sum(bytes) OVER (PARTITION BY run ORDER BY block) - bytes AS place FROM D)"""


@query(f"{BY_RUN_BLOCKS} SELECT run, CAST(block AS BIGINT) AS block, first_key, entries, CAST(bytes AS BIGINT) AS bytes FROM I")
def q_blocks(spark, sf_dir):
    """The data blocks of every run."""
    newest = F.max_by("value", "seq").alias("value")
    state = changes(spark, sf_dir).groupBy("run", "key").agg(newest)
    size = folds.encoded_size(F.octet_length("key"), F.octet_length("value"))
    return folds.blocks(state.select("run", "key", size.alias("size")), BLOCK_BYTES)


GENERATIONS_SQL = f"""{LOG},
S AS (SELECT seq, octet_length(encode(key)) AS k, octet_length(encode(value)) AS v, coalesce(lag(seq) OVER (PARTITION BY key ORDER BY seq), -1) AS prev, row_number() OVER (ORDER BY seq) AS i FROM L),
G AS (SELECT i, seq, 0 AS generation, seq AS first_seq, k + v + {folds.ENTRY_BYTES} AS total FROM S WHERE i = 1
      UNION ALL SELECT S.i, S.seq, G.generation + (G.total >= {BUFFER_BYTES})::INT, CASE WHEN G.total >= {BUFFER_BYTES} THEN S.seq ELSE G.first_seq END,
        CASE WHEN G.total >= {BUFFER_BYTES} THEN k + v + {folds.ENTRY_BYTES} WHEN S.prev < G.first_seq THEN G.total + k + v + {folds.ENTRY_BYTES} ELSE G.total + v END
      FROM G JOIN S ON S.i = G.i + 1),
A AS (SELECT generation, min(first_seq) AS first_seq, max(seq) AS last_seq, count(*) AS entries, max(total) AS bytes FROM G GROUP BY generation)"""


def _rotations(spark, sf_dir):
    log = changes(spark, sf_dir)
    return folds.rotations(log.select(F.lit(0).alias("log"), "seq", "key", F.octet_length("key").alias("key_bytes"), F.octet_length("value").alias("value_bytes")), BUFFER_BYTES)


@query(f"WITH RECURSIVE {GENERATIONS_SQL} SELECT CAST(0 AS BIGINT) AS log, CAST(generation AS BIGINT) AS generation, first_seq, last_seq, entries, CAST(bytes AS BIGINT) AS bytes FROM A")
def q_rotations(spark, sf_dir):
    return _rotations(spark, sf_dir)


@query(f"WITH RECURSIVE {GENERATIONS_SQL} SELECT CAST(generation AS BIGINT) AS generation, CAST(2 * generation + 1 AS BIGINT) AS log_number, CAST(2 * generation + 2 AS BIGINT) AS table_number FROM A")
def q_version_ids(spark, sf_dir):
    return wal.generations(_rotations(spark, sf_dir))


@query(
    f"WITH {LOG}, F AS (SELECT DISTINCT run, CASE WHEN run < 4 THEN 1 ELSE 0 END AS level FROM L) "
    "SELECT CAST(level AS BIGINT) AS level, count(*) AS files FROM F GROUP BY level HAVING count(*) > 4"
)
def q_pick_level(spark, sf_dir):
    files = changes(spark, sf_dir).select("run", F.when(F.col("run") < 4, 1).otherwise(0).cast("long").alias("level")).distinct()
    return files.groupBy("level").agg(F.count("*").alias("files")).where("files > 4")


@query(
    f"WITH {LOG}, E AS (SELECT run, octet_length(encode(key)) AS k, octet_length(encode(value)) AS v FROM L) SELECT run, count(*) AS entries, CAST(sum(1 + (k >= 128)::INT + "
    "(k >= 16384)::INT + 1 + (v + 1 >= 128)::INT + (v + 1 >= 16384)::INT + k + 1 + v) AS BIGINT) AS bytes FROM E GROUP BY run"
)
def q_encoded_size(spark, sf_dir):
    size = folds.encoded_size(F.octet_length("key"), F.octet_length("value"))
    return changes(spark, sf_dir).groupBy("run").agg(F.count("*").alias("entries"), F.sum(size).cast("long").alias("bytes"))


def hash_sql(values: str) -> str:
    """The key hash of a list of byte values."""
    return (
        f"list_reduce(list_prepend({SEED}::UBIGINT, list_transform({values}, lambda c: c::UBIGINT)), "
        f"lambda h, b: ((xor(h, b)::UHUGEINT * {PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"
    )


def bytes_sql(text: str) -> str:
    """The byte values of an ASCII string."""
    return f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: ord(c))"


@query(f"WITH {LOG}, {LATEST} SELECT key, CAST({hash_sql(bytes_sql('key'))} AS VARCHAR) AS hash FROM T")
def q_key_hash(spark, sf_dir):
    return merge.latest(changes(spark, sf_dir)).select("key", hash64_column(F.col("key").cast("binary")).cast("string").alias("hash"))


@query(f"WITH {LOG}, {LATEST} SELECT key, substr(key, 8) AS rest FROM T")
def q_remove_prefix(spark, sf_dir):
    return merge.latest(changes(spark, sf_dir)).select("key", keys.remove_prefix(F.col("key"), 7).alias("rest"))


# A run's filter has 10 bits for each of its n keys, 64 at least, in whole bytes, and six
# probes; an absent key passes if all its positions are set by keys of the run.
BLOOM_SQL = f"""
WITH {LOG}, K AS (SELECT DISTINCT run, key FROM L),
N AS (SELECT run, count(*) AS n, CAST((greatest(64, count(*) * 10) + 7) // 8 * 8 AS UBIGINT) AS bits FROM K GROUP BY run),
H AS (SELECT K.run, K.key, own, N.bits, {hash_sql(bytes_sql("K.key || CASE WHEN own THEN '' ELSE '?' END"))} AS h
      FROM K JOIN N ON K.run = N.run, (VALUES (true), (false)) AS v(own)),
P AS (SELECT run, key, own, CAST(((h::UHUGEINT + i::UHUGEINT * (((h >> 17) | ((h % 131072) << 15)) % 4294967296)::UHUGEINT) % 18446744073709551616::UHUGEINT) % bits::UHUGEINT AS UBIGINT) AS pos
      FROM H, range(6) AS r(i)),
S AS (SELECT DISTINCT run, pos FROM P WHERE own),
C AS (SELECT P.run, P.key, P.own, bool_and(S.pos IS NOT NULL) AS may FROM P LEFT JOIN S ON S.run = P.run AND S.pos = P.pos GROUP BY ALL)
SELECT run, count(*) FILTER (own) AS keys, count(*) FILTER (own AND NOT may) AS false_negatives, count(*) FILTER (NOT own AND may) AS false_positives FROM C GROUP BY run"""


@query(BLOOM_SQL)
def q_bloom_check(spark, sf_dir):
    """Per run: its keys, how many its filter denies (none may be), and how many of as
    many absent keys it lets through."""
    schema = pa.schema([(c, pa.int64()) for c in ("run", "keys", "false_negatives", "false_positives")])

    def check(table: pa.Table) -> pa.Table:
        own = sorted(k.encode() for k in set(table["key"].to_pylist()))
        filter_ = bloom_build(own)
        found = [bloom_may_contain_all(filter_, k) for k in (own, [k + b"?" for k in own])]
        row = (table["run"][0].as_py(), len(own), int((~found[0]).sum()), int(found[1].sum()))
        return pa.Table.from_arrays([pa.array([v], pa.int64()) for v in row], schema=schema)

    return changes(spark, sf_dir).select("run", "key").groupBy("run").applyInArrow(check, "run long, keys long, false_negatives long, false_positives long")


# -- in the byte formats


VARINT_SQL = "CASE WHEN {n} < 128 THEN [{n}] WHEN {n} < 16384 THEN [{n} % 128 + 128, {n} // 128] ELSE [{n} % 128 + 128, {n} // 128 % 128 + 128, {n} // 16384] END"


def varint_sql(n: str) -> str:
    """The bytes of a varint below 2^21."""
    return VARINT_SQL.format(n=f"({n})")


def hex_sql(values: str) -> str:
    return f"array_to_string(list_transform({values}, lambda b: printf('%02x', CAST(b AS INT))), '')"


def by_run(spark, sf_dir, work, schema: str):
    """What `work` makes of the rows (run, seq, op, key, value) of each run, in order of
    seq; a log or a table file is one sequence of bytes, and so one task's work."""
    out = codec.arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("seq").to_pylist()
        return pa.Table.from_pylist(list(work(rows[0]["run"], [(r["seq"], r["op"], r["key"].encode(), r["value"].encode()) for r in rows])), schema=out)

    return changes(spark, sf_dir).groupBy("run").applyInArrow(run, schema)


def put_file(path: str, name: str, data: bytes) -> None:
    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, name), compression=None) as out:
        out.write(data)


def table_of(rows: list[tuple]) -> bytes:
    """The table file of a run's newest changes."""
    newest = {key: (key, op, value) for _, op, key, value in rows}
    return codec.write_table([newest[k] for k in sorted(newest)], BLOCK_BYTES)


RECORD_SQL = f"""
WITH {LOG}, B AS (SELECT seq, list_concat([op], {varint_sql('length(key)')}, {varint_sql('length(value)')}, {bytes_sql('key')}, {bytes_sql('value')}) AS p FROM L),
C AS (SELECT seq, p, {hash_sql('p')} % 4294967296 AS c FROM B)
SELECT seq, {hex_sql(f"list_concat({varint_sql('len(p)')}, p, [c % 256, c // 256 % 256, c // 65536 % 256, c // 16777216])")} AS record FROM C"""


@query(RECORD_SQL)
def q_log_record(spark, sf_dir):
    """The bytes of each change's log record."""
    return by_run(spark, sf_dir, lambda run, rows: ({"seq": s, "record": codec.log_record(op, k, v).hex()} for s, op, k, v in rows), "seq long, record string")


@query(
    f"WITH {LOG}, S AS (SELECT run, seq % 1000 AS pos, op, key, value, seq % 1000 <> 700 + run % 300 AS ok FROM L) "
    "SELECT run, pos, CAST(op AS BIGINT) AS op, key, value FROM S QUALIFY min(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY pos) = 1"
)
def q_log_files(spark, sf_dir):
    """A log file of each run, with a damaged record, read back from its bytes."""
    path = folder(spark, "logs")

    def write(run, rows):
        parts = [bytearray(codec.log_record(op, k, v)) for _, op, k, v in rows]
        for part, (seq, *_) in zip(parts, rows):
            if seq % 1000 == 700 + run % 300:
                part[-1] ^= 1
        put_file(path, f"run-{run}.log", b"".join(parts))
        yield {"run": run}

    by_run(spark, sf_dir, write, "run long").write.format("noop").mode("overwrite").save()
    found = codec.read_log_files(spark, f"{path}/run-*.log")
    return plain(found.select(run_of("segment"), "pos", "op", "key", "value"))


def run_of(column: str):
    return F.regexp_extract(column, r"run-(\d+)\.", 1).cast("long").alias("run")


def table_files(spark, sf_dir) -> str:
    """A folder with a table file of each run."""
    path = folder(spark, "tables")

    def write(run, rows):
        put_file(path, f"run-{run}.sst", table_of(rows))
        yield {"run": run}

    by_run(spark, sf_dir, write, "run long").write.format("noop").mode("overwrite").save()
    return path


@query(f"WITH {LOG} SELECT run, key, CAST(op AS BIGINT) AS op, value FROM L QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1")
def q_table_files(spark, sf_dir):
    found = codec.read_table_files(spark, f"{table_files(spark, sf_dir)}/run-*.sst")
    return plain(found.select(run_of("path"), "key", "op", "value"))


@query(
    f"WITH {LOG}, T AS (SELECT * FROM L QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1), "
    f"P AS (SELECT DISTINCT run, p.key FROM L, (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS key) p) "
    f"SELECT P.run, P.key, {STATUS} AS status, CASE WHEN T.op = 1 THEN T.value END AS value FROM P LEFT JOIN T ON T.run = P.run AND T.key = P.key"
)
def q_table_get(spark, sf_dir):
    """Point reads from each run's table file: filter, index, one block."""

    def read(run, rows):
        file = codec.TableFile(table_of(rows))
        for key in PROBES:
            op, value = file.get(key.encode()) or (None, b"")
            yield {"run": run, "key": key, "status": keys.status_of(op), "value": value.decode() if op == PUT else None}

    return by_run(spark, sf_dir, read, "run long, key string, status string, value string")


@query(f"{BY_RUN_BLOCKS} SELECT run, CAST(block AS BIGINT) AS block, first_key, CAST(place AS BIGINT) AS block_offset, CAST(bytes AS BIGINT) AS block_bytes FROM I")
def q_table_index(spark, sf_dir):
    """The index of each run's table file: a block's first key, place and size."""

    def read(run, rows):
        for i, (key, offset, size) in enumerate(codec.TableFile(table_of(rows)).index):
            yield {"run": run, "block": i, "first_key": key.decode(), "block_offset": offset, "block_bytes": size}

    return by_run(spark, sf_dir, read, "run long, block long, first_key string, block_offset long, block_bytes long")


@query(
    f"{BY_RUN_BLOCKS}, Z AS (SELECT run, CAST(sum(bytes) AS BIGINT) AS index_offset, CAST(sum(1 + length(first_key) + 16) AS BIGINT) AS index_bytes, "
    "CAST((greatest(64, sum(entries) * 10) + 7) // 8 + 1 AS BIGINT) AS filter_bytes FROM I GROUP BY run) "
    "SELECT run, index_offset, index_bytes, index_offset + index_bytes AS filter_offset, filter_bytes, index_offset + index_bytes + filter_bytes + 48 AS file_bytes FROM Z"
)
def q_table_footer(spark, sf_dir):
    """What the footer of each run's table file says, and the file's size."""

    def read(run, rows):
        data = table_of(rows)
        index, index_bytes, filter_, filter_bytes, _, _, magic = codec.FOOTER.unpack(data[-codec.FOOTER.size :])
        assert magic == codec.MAGIC
        yield {"run": run, "index_offset": index, "index_bytes": index_bytes, "filter_offset": filter_, "filter_bytes": filter_bytes, "file_bytes": len(data)}

    return by_run(spark, sf_dir, read, "run long, index_offset long, index_bytes long, filter_offset long, filter_bytes long, file_bytes long")


@query(f"SELECT event_id, {hex_sql(varint_sql('event_id'))} AS varint, event_id AS back FROM events")
def q_varints(spark, sf_dir):
    out = codec.arrow_schema("event_id long, varint string, back long")

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            made = [codec.varint(i) for i in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.hex() for m in made]), pa.array([codec.read_varint(m, 0)[0] for m in made], pa.int64())], schema=out)

    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id").mapInArrow(run, "event_id long, varint string, back long")


@query(
    f"WITH RECURSIVE {LOG}, S AS (SELECT run, seq, octet_length(encode(key)) AS k, octet_length(encode(value)) AS v, "
    "coalesce(lag(seq) OVER (PARTITION BY run, key ORDER BY seq), -1) AS prev, row_number() OVER (PARTITION BY run ORDER BY seq) AS i FROM L), "
    f"G AS (SELECT run, i, seq, 0 AS generation, seq AS first_seq, k + v + {folds.ENTRY_BYTES} AS total FROM S WHERE i = 1 "
    f"UNION ALL SELECT S.run, S.i, S.seq, G.generation + (G.total >= {BUFFER_BYTES})::INT, CASE WHEN G.total >= {BUFFER_BYTES} THEN S.seq ELSE G.first_seq END, "
    f"CASE WHEN G.total >= {BUFFER_BYTES} THEN k + v + {folds.ENTRY_BYTES} WHEN S.prev < G.first_seq THEN G.total + k + v + {folds.ENTRY_BYTES} ELSE G.total + v END "
    "FROM G JOIN S ON S.run = G.run AND S.i = G.i + 1) "
    "SELECT run AS log, CAST(generation AS BIGINT) AS generation, min(first_seq) AS first_seq, max(seq) AS last_seq, count(*) AS entries, CAST(max(total) AS BIGINT) AS bytes FROM G GROUP BY run, generation"
)
def q_rotations_by_log(spark, sf_dir):
    """The buffer's generations where each run is a log of its own."""
    log = changes(spark, sf_dir)
    return folds.rotations(log.select(F.col("run").alias("log"), "seq", "key", F.octet_length("key").alias("key_bytes"), F.octet_length("value").alias("value_bytes")), BUFFER_BYTES)


# -- through a store on disk


def filled(spark: SparkSession, sf_dir: str, batches: int = 5, compact: bool = False) -> Store:
    """A store that took the log in batches, each flushed but the last."""
    store = Store.open(spark, folder(spark, "store"), Options(level0_trigger=2))
    log = changes(spark, sf_dir)
    for i in range(batches):
        store.apply(_slice(log, i, batches), "seq")
        if i + 1 < batches:
            store.flush()
    if compact:
        store.maybe_compact()
    return store


def _slice(log: DataFrame, i: int, parts: int) -> DataFrame:
    """The i-th of some stretches of the log, by seq."""
    top = log.agg(F.max("seq")).first()[0] or 0
    edge = [top * k // parts for k in range(parts)] + [top + 1]
    return log.where((F.col("seq") >= edge[i] + (i > 0)) & (F.col("seq") < edge[i + 1] + (i + 1 < parts)))


@query(ORACLE["q_live"])
def q_store_live(spark, sf_dir):
    return plain(filled(spark, sf_dir).live())


@query(ORACLE["q_live"])
def q_store_compacted(spark, sf_dir):
    store = filled(spark, sf_dir, compact=True)
    store.flush()
    store.compact_range()
    return plain(store.live())


@query(ORACLE["q_multi_get"])
def q_store_multi_get(spark, sf_dir):
    return plain(filled(spark, sf_dir, compact=True).multi_get(spark.createDataFrame([(p,) for p in PROBES], "key string")))


@query(ORACLE["q_range_scan"])
def q_store_scan(spark, sf_dir):
    return plain(filled(spark, sf_dir).scan("000010", "000020"))


@query(ORACLE["q_prefix_scan"])
def q_store_prefix(spark, sf_dir):
    return plain(filled(spark, sf_dir).prefix("000012:"))


@query(ORACLE["q_multi_get"])
def q_store_get(spark, sf_dir):
    """Single reads: a value, or an error that says why there is none."""
    store, found = filled(spark, sf_dir, compact=True), []
    for key in PROBES:
        try:
            found.append((key, OK, store.get(key).decode()))
        except NotFound as error:
            found.append((key, f"NotFound: {error}", None))
    return spark.createDataFrame(found, "key string, status string, value string")


@query(ORACLE["q_live"])
def q_store_reopened(spark, sf_dir):
    with filled(spark, sf_dir) as store:
        path = store.path
    return plain(Store.open(spark, path, Options(create_if_missing=False)).live())


@query(ORACLE["q_live"])
def q_store_cached(spark, sf_dir):
    """The second of two reads that keep runs cached."""
    store, options = filled(spark, sf_dir), ReadOptions(fill_cache=True)
    store.live(options).write.format("noop").mode("overwrite").save()
    return plain(store.live(options))


def layered(spark: SparkSession, sf_dir: str) -> Store:
    """A store with eight runs, the older four of them compacted into one on level 1."""
    store = Store.open(spark, folder(spark, "store"), Options(level0_trigger=2))
    log = changes(spark, sf_dir)
    for i in range(8):
        store.apply(_slice(log, i, 8), "seq")
        store.flush()
        if i == 3:
            store.maybe_compact()
    return store


LAYERED = f"""
WITH {LOG}, M AS (SELECT coalesce(max(seq), 0) AS top FROM L),
X AS (SELECT L.*, len(list_filter(range(1, 8), lambda k: seq > top * k // 8)) AS slice FROM L, M),
D AS (SELECT * FROM X WHERE slice < 4 QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
R AS (SELECT 0 AS level, slice, min(key) AS smallest, max(key) AS largest, count(DISTINCT key) AS entries FROM X WHERE slice >= 4 GROUP BY slice
      UNION ALL SELECT 1, 0, min(key), max(key), count(*) FROM D WHERE op = 1 HAVING count(*) > 0),
O AS (SELECT row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -slice ELSE 0 END, smallest) AS place, * FROM R)"""


def run_rows(spark, runs, **more):
    """Runs in the order in which reads look at them."""
    rows = [(*more.values(), i + 1, r.level, bytes.fromhex(r.smallest).decode(), bytes.fromhex(r.largest).decode(), r.entries) for i, r in enumerate(levels.run_order(runs))]
    head = "".join(f"{name} long, " if isinstance(v, int) else f"{name} string, " for name, v in more.items())
    return spark.createDataFrame(rows, f"{head}place long, level long, smallest string, largest string, entries long")


@query(f"{LAYERED} SELECT place, CAST(level AS BIGINT) AS level, smallest, largest, entries FROM O")
def q_run_order(spark, sf_dir):
    return run_rows(spark, layered(spark, sf_dir).version.runs)


@query(
    f"{LAYERED}, H AS (SELECT min(smallest) AS low, max(largest) AS high, count(*) AS files FROM R WHERE level = 0) "
    "SELECT CAST(0 AS BIGINT) AS picked, place, CAST(level AS BIGINT) AS level, smallest, largest, entries FROM O, H WHERE files > 2 AND (level = 0 OR NOT (smallest > high OR largest < low))"
)
def q_compaction_inputs(spark, sf_dir):
    """The level that a compaction would take, and its inputs there and one below."""
    runs = layered(spark, sf_dir).version.runs
    level = levels.pick_level(runs, 2)
    return run_rows(spark, [] if level is None else levels.pick_inputs(runs, level), picked=level or 0)


@query(
    f"{LAYERED}, P AS (SELECT unnest([{', '.join(repr(p) for p in PROBES)}]) AS probe) "
    "SELECT probe, row_number() OVER (PARTITION BY probe ORDER BY place) AS place, CAST(level AS BIGINT) AS level, smallest, largest, entries FROM P JOIN O ON probe BETWEEN smallest AND largest"
)
def q_candidate_order(spark, sf_dir):
    """The runs that a read of each probe looks at, in their order."""
    runs = layered(spark, sf_dir).version.runs
    found = [run_rows(spark, levels.candidates(runs, p.encode()), probe=p) for p in PROBES]
    return reduce(DataFrame.unionByName, found)


@query(f"WITH {LOG}, {LATEST} SELECT key, CAST(op AS BIGINT) AS op, value FROM T")
def q_store_snapshot(spark, sf_dir):
    return plain(filled(spark, sf_dir).snapshot().drop("seq"))


@query(ORACLE["q_live"])
def q_stream_live(spark, sf_dir):
    """The log as a stream, one run per micro-batch."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    path = folder(spark, "stream")
    store = Store.open(spark, f"{path}/store")
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    deleted = F.col("event_id") % 4 == 0
    log = events.select(
        F.concat(F.lpad(F.col("user_id").cast("string"), 6, "0"), F.lit(":"), "event_type").alias("key"),
        F.when(deleted, DELETE).otherwise(PUT).alias("op"), F.when(deleted, "").otherwise(F.col("props")).alias("value"), F.col("event_id").alias("seq"),
    )
    ingest(log, store, f"{path}/checkpoint", order="seq").awaitTermination()
    return plain(store.live())
