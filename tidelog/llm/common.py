"""What the text operators share: inputs, the shared folder, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import inspect
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of text handed to Python at once; bounds a worker's memory.
BATCH_ROWS = 500

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once per application, so that their Python
    workers can import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="tidelog-")) / "tidelog.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches of scans and of Python small enough that very long texts fit.
    Every operator begins with this, so what the last one left is given back here."""
    ship(spark)
    relieve(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8388608")
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))


def give_back() -> None:
    """Returns freed memory to the system; workers are reused and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def relieve(spark: SparkSession) -> None:
    """Returns the driver's freed memory to the system, its JVM's native heap included:
    compilers and planners of many jobs leave much there that the allocator keeps."""
    gc.collect()
    give_back()
    jvm, array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    kind = jvm.java.lang.Class.forName
    with contextlib.suppress(Py4JError):  # a JVM without this command keeps its memory
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        method = next(m for m in kind("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        none, given = array(jvm.java.lang.Object, 0), array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        given[2], given[3] = none, array(jvm.java.lang.String, 0)
        method.invoke(server, given)


def frugal(work):
    """A grouped or batch function whose worker gives memory back after each call or
    at the end of each task."""
    if inspect.isgeneratorfunction(work):

        @functools.wraps(work)
        def batches(it):
            try:
                yield from work(it)
            finally:
                give_back()

        return batches

    @functools.wraps(work)
    def group(table):
        try:
            return work(table)
        finally:
            give_back()

    return group


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A runtime setting for as long as the block runs."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; only on a local master, where driver and
    executors are one process, may it be unset, and is then one of this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        path = _OWN.setdefault(app, "") or f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        _OWN[app] = path
    return path.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/tidelog-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop_path)
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a
    lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Plans whose rows come in the same partitions and order however often they run.
_STEADY = {"Relation", "LocalRelation", "LogicalRDD", "Project", "Filter", "SubqueryAlias", "View", "Range"}


def steady(df: DataFrame) -> DataFrame:
    """df if it only scans, projects and filters; else a written copy of it."""
    tree = df._jdf.queryExecution().analyzed().treeString()
    nodes = {re.split(r"[ (\[]", line.lstrip(" :+-*'!"), maxsplit=1)[0] for line in tree.splitlines() if line.strip()}
    return df if nodes <= _STEADY else staged(df, "steady")


def place_of(columns: list[str], name: str) -> int:
    """Where a column stands: the first of exactly this name, or else of any case."""
    same = [i for i, c in enumerate(columns) if c == name] or [i for i, c in enumerate(columns) if c.lower() == name.lower()]
    if not same:
        raise ValueError(f"there is no column {name}")
    return same[0]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named c0, c1, ...: by place, so names with dots, names that
    differ in case only and names that an operator uses itself do no harm."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever others there are."""
    return numbered(df).select(*[F.col(f"c{place_of(df.columns, n)}").alias(n) for n in names])


def row_key() -> F.Column:
    """A row id from the scan's partition and position, for steady inputs: a rerun task
    reads the same split in the same order, so it gives the same ids again."""
    return F.monotonically_increasing_id()


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_mod(column: str, modulus: int) -> F.Column:
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not (pa.types.is_string(column.type) or pa.types.is_binary(column.type)):
        column = column.cast(pa.string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets.astype(np.int64)


def spans_of(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each; a longer row stands alone."""
    start, n = 0, len(offsets) - 1
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


def arrow_schema(schema: T.StructType | str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T._parse_datatype_string(schema) if isinstance(schema, str) else schema)
