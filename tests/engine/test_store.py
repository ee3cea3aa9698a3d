"""The store: contract, crash safety, and random operations against a dictionary."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tidelog import model
from tidelog.engine import Store
from tidelog.model import Conflict, Corruption, InvalidArgument, NotFound, Options, ReadOptions


@pytest.fixture()
def path(tmp_path):
    return f"file://{tmp_path}/db"


def rows(frame):
    return [(bytes(r.key), bytes(r.value)) for r in frame.collect()]


def test_walkthrough(spark, path):
    with Store.open(spark, path) as db:
        db.write([("foo", "bar"), ("hello", "world"), ("key1", "value1")])
        assert db.get("foo") == b"bar"
        db.flush()
        assert db.get("key1") == b"value1" and db.get(b"hello") == b"world"
        db.delete("foo")
        with pytest.raises(NotFound, match="^deleted$"):
            db.get("foo")
        with pytest.raises(NotFound, match="^not found$"):
            db.get("nothing")
        db.delete("nothing")
        with pytest.raises(NotFound, match="^deleted$"):
            db.get("nothing")


EDGES = [(b"", b"empty key"), (b"\x00", b""), (b"\x7f", b"1"), (b"\x80", b"2"), (b"\xff", b"3"), (b"\xff\xff", b"4"), (b"a", b"5"), (b"ab", b"x" * 10_000)]


def test_byte_order_empty_values_and_prefixes(spark, path):
    db = Store.open(spark, path)
    db.write(reversed(EDGES))
    for _ in range(2):  # from the log, then from a run
        assert rows(db.scan()) == sorted(EDGES)
        assert db.get(b"\x00") == b"" and db.get("") == b"empty key"
        assert rows(db.prefix("a")) == [(b"a", b"5"), (b"ab", b"x" * 10_000)]
        assert rows(db.prefix(b"\xff")) == [(b"\xff", b"3"), (b"\xff\xff", b"4")] and rows(db.scan("a", "ab")) == [(b"a", b"5")]
        db.flush()
    run = db.version.runs[0]
    assert (run.smallest, run.largest, run.entries, run.tombstones) == ("", "ffff", 8, 0)


def test_overwrite_delete_and_put_again_across_runs(spark, path):
    db = Store.open(spark, path, Options(level0_trigger=4))
    for i, value in enumerate([b"1", None, b"2", None, None, b"3"]):
        db.write([("k", value), (f"other{i}", "x")])
        db.flush()
        if value is None:
            with pytest.raises(NotFound, match="deleted"):
                db.get("k")
        else:
            assert db.get("k") == value
    before = rows(db.scan())
    assert db.maybe_compact().level == 1 and db.maybe_compact() is None
    assert rows(db.scan()) == before and db.get("k") == b"3"


def test_empty_flush_and_empty_batch_do_nothing(spark, path):
    db = Store.open(spark, path)
    version = db.version
    assert db.flush() is None and db.compact_range() is None
    assert db.write([]) == 0 and db.put_all(spark.createDataFrame([], "key binary, value binary")) == 0
    assert db.version == version and rows(db.scan()) == []
    assert db.multi_get(spark.createDataFrame([], "key binary")).count() == 0


def test_reopening_twice_without_a_flush_keeps_the_log(spark, path):
    Store.open(spark, path).put("a", "1")
    Store.open(spark, path).put("b", "2")
    db = Store.open(spark, path, Options(create_if_missing=False))
    assert rows(db.scan()) == [(b"a", b"1"), (b"b", b"2")] and len(db.version.segments) == 2


def test_open_flags_and_options(spark, path):
    with pytest.raises(InvalidArgument):
        Store.open(spark, path, Options(create_if_missing=False))
    Store.open(spark, path)
    with pytest.raises(InvalidArgument):
        Store.open(spark, path, Options(error_if_exists=True))
    for bad in ({"num_levels": 1}, {"write_buffer_size": 0}, {"bloom_bits_per_key": -1}, {"level0_trigger": 0}):
        with pytest.raises(InvalidArgument):
            Options(**bad)


def test_bad_batches_are_refused_and_leave_nothing(spark, path):
    db = Store.open(spark, path)
    bad = [
        (spark.createDataFrame([(None, 1, "v")], "key string, op int, value string"), None),
        (spark.createDataFrame([("k", 3, "v")], "key string, op int, value string"), None),
        (spark.createDataFrame([("k", 1, "v"), ("k", 1, "w")], "key string, op int, value string"), None),
        (spark.createDataFrame([("k", 1, "v", None)], "key string, op int, value string, o int"), "o"),
    ]
    for frame, order in bad:
        with pytest.raises(InvalidArgument):
            db.apply(frame, order)
    with pytest.raises(InvalidArgument):
        db.compact_range("b", "a")
    assert db.version.segments == ()


def test_a_crash_before_the_commit_leaves_no_trace(spark, path, monkeypatch):
    db = Store.open(spark, path)
    db.write([("a", "1"), ("b", "2")])

    def crash(*_, **__):
        raise RuntimeError("crash")

    for act in (lambda s: s.put("a", "lost"), lambda s: s.flush()):
        with monkeypatch.context() as m:
            m.setattr(db.manifest, "commit", crash)
            with pytest.raises(RuntimeError):
                act(db)
        db = Store.open(spark, path)
        assert rows(db.scan()) == [(b"a", b"1"), (b"b", b"2")]
    assert db.vacuum() == 2  # the segment and the run that nothing names
    assert rows(db.scan()) == [(b"a", b"1"), (b"b", b"2")]


def test_the_loser_of_a_race_gets_a_conflict(spark, path):
    one, two = Store.open(spark, path), Store.open(spark, path)
    one.put("a", "1")
    with pytest.raises(Conflict):
        two.put("a", "2")
    two.refresh()
    two.put("a", "2")
    assert Store.open(spark, path).get("a") == b"2"


def test_lost_inputs_fail_the_job_and_damaged_manifests_are_found(spark, path):
    db = Store.open(spark, path)
    for i in range(3):
        db.put("k", str(i))
        db.flush()
    db.files.delete(db.version.runs[0].path)
    version = db.version
    with pytest.raises(Exception):
        db.compact_range()
    with pytest.raises(Exception):
        db.get("k")
    assert db.refresh() == version
    db.files.publish(f"{db.manifest.folder}/.x.tmp", f"{db.manifest.folder}/{version.version + 1:012d}.json", "{")
    with pytest.raises(Corruption):
        Store.open(spark, path)


def test_tombstones_stay_while_an_older_run_may_hold_the_key(spark, path):
    db = Store.open(spark, path)
    db.write([("a", "old"), ("m", "old")])
    db.flush()
    db.compact_range()
    deep = db.version.runs
    db.write([("a", None), ("z", None), ("y", "1")])
    db.flush()
    db._compact([r for r in db.version.runs if r not in deep], 1)  # the older run is left out
    kept = {bytes(r.key) for r in db.snapshot().where(F.col("op") == model.DELETE).collect()}
    assert kept == {b"a"}  # z is outside the older run's range
    with pytest.raises(NotFound, match="deleted"):
        db.get("a")
    db.compact_range()
    assert db.snapshot().where(F.col("op") == model.DELETE).count() == 0 and rows(db.scan()) == [(b"m", b"old"), (b"y", b"1")]
    keep = Store.open(spark, path, Options(drop_tombstones=False))
    keep.delete("m")
    keep.flush()
    keep.compact_range()
    assert keep.version.runs[0].tombstones == 1


def test_old_versions_can_be_read_until_vacuum(spark, path):
    db = Store.open(spark, path)
    db.put("a", "1")
    then = db.version.version
    db.put("a", "2")
    db.flush()
    assert db.at(then).get("a") == b"1"
    db.vacuum()
    assert db.get("a") == b"2"
    with pytest.raises(Corruption):
        db.at(then)


def test_point_reads_open_only_runs_that_may_hold_the_key(spark, path):
    db = Store.open(spark, path)
    for part in ("abc", "mno", "xyz"):
        db.write([(c, c) for c in part])
        db.flush()
    files = db.lookup("n").inputFiles()
    assert len(files) == 1 and db.get("n") == b"n"
    plan = db._changes(b"m", b"o")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(key" in plan


def test_auto_flush_and_compaction(spark, path):
    db = Store.open(spark, path, Options(auto_flush=True, auto_compact=True, write_buffer_size=1, level0_trigger=2))
    for i in range(7):
        db.write([(f"k{j}", f"{i}") for j in range(i, 7)])
    assert not db.version.segments and {r.level for r in db.version.runs} <= {0, 1} and sum(r.level == 0 for r in db.version.runs) <= 2
    assert rows(db.scan()) == [(f"k{j}".encode(), str(j).encode()) for j in range(7)]


@pytest.mark.parametrize("seed", [1, 2])
def test_random_operations_against_a_dictionary(spark, path, seed):
    rng = random.Random(seed)
    options = Options(level0_trigger=2, drop_tombstones=seed % 2 == 1)
    db, want = Store.open(spark, path, options), {}
    all_keys = [bytes([rng.choice(b"\x00a\x7f\x80\xff")] * rng.randint(0, 2)) + uuid.UUID(int=i).bytes[-1:] for i in range(12)]
    for step in range(22):
        act = rng.choice(["write", "write", "flush", "compact", "range", "reopen", "vacuum"])
        if act == "write":
            batch = [(rng.choice(all_keys), rng.choice([None, b"", str(step).encode()])) for _ in range(rng.randint(1, 8))]
            db.write(batch)
            for k, v in batch:
                want[k] = v
        elif act == "flush":
            db.flush()
        elif act == "compact":
            db.maybe_compact()
        elif act == "range":
            low, high = sorted(rng.sample(all_keys, 2))
            db.compact_range(low, high)
        elif act == "reopen":
            db = Store.open(spark, path, options)
        else:
            db.vacuum()
        if act != "vacuum" or step % 2:
            assert rows(db.scan()) == sorted((k, v) for k, v in want.items() if v is not None), (step, act)
    probes = spark.createDataFrame([(bytearray(k),) for k in [*all_keys, b"none"]], "key binary")
    got = {bytes(r.key): (r.status, None if r.value is None else bytes(r.value)) for r in db.multi_get(probes).collect()}
    for k in all_keys:
        if want.get(k) is not None:
            assert got[k] == ("OK", want[k])
        else:
            assert got[k][0].startswith("NotFound")
    assert got[b"none"][0] == "NotFound: not found"


def test_cached_runs_keep_to_the_options(spark, path):
    db = Store.open(spark, path, Options(max_open_files=2))
    for part in ("abc", "mno", "xyz"):
        db.write([(c, c) for c in part])
        db.flush()
    assert not db.cache.held and db.get("n", ReadOptions(fill_cache=True)) == b"n" and len(db.cache.held) == 1
    assert "InMemoryTableScan" in db._changes(b"n", b"n")._jdf.queryExecution().executedPlan().toString()
    for _ in range(2):
        assert len(rows(db.scan(options=ReadOptions(fill_cache=True)))) == 9 and len(db.cache.held) == 2
    db.compact_range()
    assert not db.cache.held and len(rows(db.scan())) == 9
    small = Store.open(spark, path, Options(block_cache_size=1))
    assert small.get("a", ReadOptions(fill_cache=True)) == b"a" and not small.cache.held
    db.scan(options=ReadOptions(fill_cache=True))
    db.close()
    assert not db.cache.held


def test_bloom_bits_set_the_size_of_the_filter(spark, tmp_path):
    sizes = []
    for bits in (0, 4, 16):
        db = Store.open(spark, f"file://{tmp_path}/{bits}", Options(bloom_bits_per_key=bits))
        db.write([(f"key{i:05d}", "v") for i in range(3000)])
        sizes.append(db.flush().file_size)
    assert sizes[0] + 1000 < sizes[1] and sizes[1] + 2000 < sizes[2]
