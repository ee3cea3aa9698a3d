"""Operators, functions and byte formats in small."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import hashing, keys
from tidelog.model import Corruption, Run
from tidelog.operators import folds, levels, merge, wal
from tidelog.sources import codec


def run(level, number, low, high):
    return Run(level, number, f"p{number}", low, high, 1, 1, 0, number, number)


@given(st.binary(max_size=5), st.binary(max_size=6))
def test_successor_bounds_a_prefix(prefix, key):
    top = keys.successor(prefix)
    assert key.startswith(prefix) == (key >= prefix and (top is None or key < top))


@given(st.binary(max_size=4), st.binary(max_size=4))
def test_compare(a, b):
    assert keys.compare(a, b) == -keys.compare(b, a) and (keys.compare(a, b) == 0) == (a == b)


def test_hash_vectors(spark):
    want = {b"": 1469598103934665603, b"a": 4953267810257967366, b"b": 4953266710746339155, b"foo": 18102377380257174285}
    assert all(hashing.hash64(k) == v for k, v in want.items())
    frame = spark.createDataFrame([(bytearray(k),) for k in want], "k binary")
    assert {bytes(r.k): int(r.h) for r in frame.withColumn("h", hashing.hash64_column("k")).collect()} == want


def test_bloom_filter_denies_no_key_and_few_others():
    own = [f"key{i}".encode() for i in range(3000)]
    filter_ = hashing.bloom_build(own)
    assert all(hashing.bloom_may_contain(filter_, k) for k in own)
    assert sum(hashing.bloom_may_contain(filter_, f"no{i}".encode()) for i in range(3000)) < 60
    assert hashing.bloom_may_contain(b"", b"x") and hashing.bloom_may_contain(b"\x06", b"x")


def test_byte_vectors():
    assert codec.log_record(1, b"foo", b"bar").hex() == "09010303666f6f626172899ae04c"
    assert codec.log_record(2, b"foo", b"").hex() == "06020300666f6f280f1a2b"
    table = codec.write_table([(b"a", 1, b"v1"), (b"b", 1, b"v1")])
    assert table[:12].hex() == "010361017631010362017631" and table[30:39].hex() == "70000ec00018000306" and len(table) == 87
    assert table[12:30].hex() == "016100000000000000000c00000000000000"
    assert table[-48:].hex() == "0c0000000000000012000000000000001e000000000000000900000000000000010000000000000057fb808b247547db"


@given(st.dictionaries(st.binary(max_size=6), st.tuples(st.sampled_from([1, 2]), st.binary(max_size=300)), max_size=40), st.integers(1, 200))
def test_table_files(content, block):
    entries = [(k, op, v) for k, (op, v) in sorted(content.items())]
    file = codec.TableFile(codec.write_table(entries, block))
    assert list(file) == entries and all(file.get(k) == (op, v) for k, op, v in entries) and file.get(b"absent!") is None


@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.binary(max_size=200), st.binary(max_size=200)), max_size=8), st.integers(0, 2000), st.integers(1, 255))
def test_a_damaged_log_yields_a_prefix(records, at, flip):
    parts = [codec.log_record(*r) for r in records]
    data = bytearray(b"".join(parts))
    assert list(codec.read_log(bytes(data))) == records
    if data:
        at %= len(data)
        data[at] ^= flip
        whole = next(i for i in range(len(parts)) if sum(map(len, parts[: i + 1])) > at)
        got = list(codec.read_log(bytes(data)))
        assert got[:whole] == records[:whole] and len(got) <= max(len(records), whole)
        assert list(codec.read_log(bytes(data[:at])))[:whole] == records[:whole]


def test_files_of_both_kinds(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_bytes(codec.log_record(1, b"k", b"v") + codec.log_record(2, b"k", b"") + b"\x09\x01")
    (tmp_path / "log" / "b.log").write_bytes(b"")
    got = [(r.segment[-5:], r.pos, r.op, bytes(r.key), bytes(r.value)) for r in codec.read_log_files(spark, str(tmp_path / "log")).collect()]
    assert got == [("a.log", 0, 1, b"k", b"v"), ("a.log", 1, 2, b"k", b"")]
    (tmp_path / "sst").mkdir()
    (tmp_path / "sst" / "t.sst").write_bytes(codec.write_table([(b"a", 1, b"x"), (b"b", 2, b"")]))
    assert [(bytes(r.key), r.op) for r in codec.read_table_files(spark, str(tmp_path / "sst")).collect()] == [(b"a", 1), (b"b", 2)]
    with pytest.raises(Corruption):
        codec.TableFile(b"x" * 60)


def test_levels():
    runs = [run(0, 5, "05", "20"), run(0, 7, "30", "40"), run(1, 2, "00", "04"), run(1, 3, "10", "11"), run(1, 4, "38", "50"), run(2, 1, "00", "ff")]
    assert [r.number for r in levels.run_order(runs)] == [7, 5, 2, 3, 4, 1]
    assert [r.number for r in levels.candidates(runs, b"\x10")] == [5, 3, 1]
    assert {r.number for r in levels.pick_inputs(runs, 0)} == {5, 7, 3, 4}  # the hull is 05 to 40
    assert levels.pick_level(runs, 4) is None and levels.pick_level(runs[:2], 1) == 0
    chosen, target = levels.range_inputs(runs[:5], "39", "39")
    assert target == 1 and {r.number for r in chosen} == {7, 4}
    assert levels.range_inputs([], None, None) == ([], 1) and levels.pick_inputs([], 0) == []


def test_merged_ranges_cover_all():
    rng = random.Random(0)
    runs = [run(1, i, f"{a:04x}", f"{a + rng.randint(0, 90):04x}") for i, a in enumerate(rng.sample(range(60000), 300))]
    ranges = merge.merged_ranges(runs)
    assert len(ranges) <= 64 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert all(any(low <= bytes.fromhex(r.smallest) and bytes.fromhex(r.largest) <= high for low, high in ranges) for r in runs)


def test_newest_wins_and_a_filter_before_the_merge_would_not(spark):
    log = spark.createDataFrame([("k", 1, "a", 1), ("k", 2, "", 2), ("j", 1, "b", 3), ("j", 1, "c", 4)], "key string, op int, value string, seq long")
    assert [tuple(r) for r in merge.live(log).collect()] == [("j", "c")]
    assert [(r.key, r.op, r.value) for r in merge.snapshot(log).collect()] == [("j", 1, "c"), ("k", 2, "")]


def test_valid_prefix(spark):
    cases = {"first": [0, 1, 1], "middle": [1, 0, 1, 1], "last": [1, 1, 0], "good": [1, 1]}
    flat = [(name, i, bool(ok)) for name, oks in cases.items() for i, ok in enumerate(oks)]
    frame = spark.createDataFrame(flat, "segment string, pos long, ok boolean")
    got = {r.segment: (r.kept, r.discarded) for r in wal.discarded(frame).collect()}
    assert got == {"first": (0, 3), "middle": (1, 3), "last": (2, 1), "good": (2, 0)}


def test_entry_sizes_and_blocks(spark):
    entries = [(b"k" * k, 1, b"v" * v) for k, v in [(1, 0), (127, 126), (128, 127), (300, 20000), (0, 5)]]
    frame = spark.createDataFrame([(len(k), len(v), len(codec.data_block([(k, o, v)]))) for k, o, v in entries], "k int, v int, want int")
    assert frame.where(folds.encoded_size(F.col("k"), F.col("v")) != F.col("want")).count() == 0
    rows = spark.createDataFrame([(0, f"{i:03d}", n) for i, n in enumerate([30, 80, 200, 10, 20])], "run int, key string, size int")
    assert [(r.block, r.first_key, r.entries, r.bytes) for r in folds.blocks(rows, 100).collect()] == [(0, "000", 2, 110), (1, "002", 1, 200), (2, "003", 2, 30)]


def test_rotation_charges(spark):
    log = spark.createDataFrame([(0, i, k, 1, v) for i, (k, v) in enumerate([("a", 9), ("a", 9), ("b", 9), ("a", 9), ("c", 1)])], "log int, seq long, key string, key_bytes int, value_bytes int")
    got = [(r.generation, r.first_seq, r.last_seq, r.entries, r.bytes) for r in folds.rotations(log, 100).collect()]
    assert got == [(0, 0, 2, 3, 109), (1, 3, 4, 2, 92)]


def changes_of(rng: random.Random, kind: str, n: int) -> list[tuple[str, int]]:
    """(key, value bytes) of a log's rows, in order."""
    if kind == "mixed":
        return [(f"k{rng.randrange(40):02d}", rng.choice([0, 0, 5, 9, 60])) for _ in range(n)]
    if kind == "equal":  # chains that never meet
        return [(f"k{i:04d}", 9) for i in range(n)]
    if kind == "quiet":  # generations over many pieces: most rows are charged nothing
        return [(rng.choice("ab"), 0) if i % 97 else (f"k{i:04d}", 1) for i in range(n)]
    if kind == "large":  # each row ends one
        return [(f"k{i % 3}", 500) for i in range(n)]
    if kind == "still":
        return [("a", 0)] * n
    return [c for k in ("quiet", "mixed", "still", "large", "equal") for c in changes_of(rng, k, n // 5)]


@pytest.mark.parametrize("threshold, piece_rows", [(1, 250), (90, 60), (3000, 60)])
def test_rotations_in_pieces(spark, monkeypatch, threshold, piece_rows):
    rng, rows = random.Random(threshold), []
    for log, (kind, n) in enumerate([("mixed", 900), ("equal", 700), ("quiet", 900), ("large", 300), ("still", 300), ("all", 1500), ("mixed", 61), ("mixed", 20)]):
        seqs = sorted(rng.sample(range(100 * n), n))
        rows += [(log, seq, k, len(k), v) for seq, (k, v) in zip(seqs, changes_of(rng, kind, n))]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "log int, seq long, key string, key_bytes int, value_bytes int")
    want = sorted(map(tuple, folds.rotations(frame, threshold).collect()))
    whole, longest = folds._whole, []
    monkeypatch.setattr(folds, "PIECE_ROWS", piece_rows)
    monkeypatch.setattr(folds, "_whole", lambda some, n: longest.append(some.groupBy("log").count().agg(F.max("count")).first()[0]) or whole(some, n))
    got = folds.rotations(frame, threshold)
    assert got.schema == whole(frame, threshold).schema and sorted(map(tuple, got.collect())) == want
    assert longest[0] <= piece_rows


@given(st.lists(st.binary(max_size=20), max_size=30))
def test_hashes_of_many_keys(many):
    assert hashing.hash64_all(many).tolist() == [hashing.hash64(k) for k in many]


def test_probe_positions_by_plain_arithmetic():
    for key in (b"", b"a", b"foo", bytes(range(40))):
        state = hashing.hash64(key)
        stride = (state >> 17 | state << 15) & hashing.HALF
        want = [((state + i * stride & hashing.WORD) % 88) & hashing.HALF for i in range(6)]
        assert hashing.positions([key], 88, 6)[0].tolist() == want


@pytest.mark.parametrize("bound", [0, 10_000])
def test_range_joins_against_all_pairs(spark, monkeypatch, bound):
    monkeypatch.setattr(levels, "BROADCAST_RUNS", bound)
    monkeypatch.setattr(levels, "CUTS", 8)
    rng = random.Random(6)
    runs = []
    for i in range(60):
        low = rng.randrange(1000)
        runs.append((i, f"{low:04d}", f"{low + rng.choice([0, 5, 300]):04d}"))
    table = spark.createDataFrame(runs, "run long, smallest string, largest string")
    probes = [f"{rng.randrange(1300):04d}" for _ in range(80)] + ["", "~"]
    got = levels.candidate_join(spark.createDataFrame([(p,) for p in probes], "key string"), table).collect()
    assert sorted((r.key, r.run) for r in got) == sorted((p, i) for p in probes for i, low, high in runs if low <= p <= high)
    pairs = levels.overlap_join(table.where("run < 20"), table.where("run >= 20")).collect()
    assert sorted(map(tuple, pairs)) == sorted((a, b) for a, al, ah in runs[:20] for b, bl, bh in runs[20:] if not (al > bh or ah < bl))


def test_generations_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(wal, "STRETCH", 7)
    some = [g for g in range(40) if g % 5 != 2]
    got = wal.generations(spark.createDataFrame([(g,) for g in some], "generation long")).orderBy("generation").collect()
    assert [tuple(r) for r in got] == [(g, 2 * k + 1, 2 * k + 2) for k, g in enumerate(some)]
