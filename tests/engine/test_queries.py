"""Every query runs, and gives the rows of its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from tidelog.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    assert all(kind in ("string", "bigint", "double") for _, kind in got.dtypes), got.dtypes
    rows = sorted((tuple(r) for r in got.select(*sorted(got.columns)).collect()), key=str)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == sorted(got.columns)
    assert rows == sorted((tuple(r) for r in want.select(*sorted(want.columns)).fetchall()), key=str)


def test_blocks_of_every_run(spark, tmp_path):
    events = duckdb.sql(
        "SELECT i AS event_id, TIMESTAMP '2024-01-01' AS ts, i * 7 % 150 AS user_id, ['click', 'view', 'signup'][1 + i % 3] AS event_type, "
        "1.0::DOUBLE AS value, repeat('p', (i % 400)::INT) AS props FROM range(3500) t(i)"
    )
    events.write_parquet(str(tmp_path / "events.parquet"))
    got = sorted(tuple(r) for r in catalogue.QUERIES["q_blocks"](spark, str(tmp_path)).select("run", "block", "first_key", "entries", "bytes").collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert got == sorted(duck.sql(catalogue.ORACLE["q_blocks"]).fetchall())
    assert {r[0] for r in got} == {0, 1, 2, 3} and len(got) > 8


def test_varints_of_any_length(spark, tmp_path):
    want = {127: "7f", 128: "8001", 16384: "808001", 2**21 - 1: "ffff7f", 2**21: "80808001", 5_999_999: "ff9aee02", 2**28: "8080808001", 2**63 - 1: "ff" * 8 + "7f"}
    spark.createDataFrame([(n,) for n in want], "event_id long").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["q_varints"](spark, str(tmp_path)).collect()
    assert {r.event_id: r.varint for r in got} == want and all(r.back == r.event_id for r in got)


@pytest.mark.parametrize("name", ["q_version_ids", "q_rotations"])
def test_a_long_log_is_no_single_task(spark, duck, monkeypatch, name):
    whole, rows = catalogue.folds._whole, []
    monkeypatch.setattr(catalogue.folds, "PIECE_ROWS", 100)
    monkeypatch.setattr(catalogue.folds, "_whole", lambda some, n: rows.append(some.count()) or whole(some, n))
    got = catalogue.QUERIES[name](spark, DATA)
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall()) and rows == [0]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
