"""Micro-batches become runs, once each."""

from pyspark.sql import functions as F

from tidelog.engine import Store
from tidelog.streaming.ingest import ingest


def test_stream(spark, tmp_path):
    schema, source = "key string, op int, value string, seq long", str(tmp_path / "in")
    parts = [[("a", 1, "1", 1), ("b", 1, "2", 2)], [("a", 2, "", 3)], [("a", 1, "3", 4), ("c", 1, "4", 5), ("b", 2, "", 6)]]
    store = Store.open(spark, f"file://{tmp_path}/db")
    for n, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest(stream, store, str(tmp_path / "checkpoint"), order="seq").awaitTermination()
        assert len(store.version.runs) == n + 1
    assert {(bytes(r.key), bytes(r.value)) for r in store.live().collect()} == {(b"a", b"3"), (b"c", b"4")}
    again = spark.createDataFrame(parts[0], schema)
    assert store.apply(again, "seq", ("changes", 1)) == 0  # a batch that was applied before
    assert store.live().where(F.col("key") == b"b").count() == 0
