"""Every id in exactly one piece; windows within capacity, near-equal and gapless."""

import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import subprocess
import sys

from tidelog.llm import bpe, packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80))
def test_windows_hold_each_piece_once(sizes):
    found = packing.windows_for(sizes, 100)
    assert sorted(i for w in found for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 100 for w in found)


def test_differencing_is_near_equal():
    rng = random.Random(0)
    sizes = [rng.randint(1, 512) for _ in range(600)]
    loads = [sum(sizes[i] for i in w) for w in packing.difference(sizes, 60)]
    assert len(loads) == 60 and max(loads) - min(loads) < 0.05 * max(loads)


def test_two_way_example():
    loads = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2))
    assert loads == [14, 16]  # the classical outcome of differencing


@given(st.integers(0, 20_000))
def test_cuts(n):
    assert sum(packing.cuts(n)) == n and all(0 < c <= 2048 for c in packing.cuts(n))


def test_pack(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["the", "ing", "über", "zz***"]) for _ in range(rng.choice([0, 1, 30, 900, 5000]))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (7, texts[7])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, group int")
    got = packing.pack(docs, with_ids=True, group_windows=8).collect()
    codec = bpe.codec(bpe.default_path())
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, t in rows:
        want = [*codec.encode(t).tolist(), 1] * (2 if i == 7 else 1)
        assert sorted(x for r in by_doc[i] for x in r.ids) == sorted(want)
        if i != 7:
            pieces = sorted(by_doc[i], key=lambda r: r.start)
            assert [x for r in pieces for x in r.ids] == want and all(r.doc_tokens == len(want) for r in pieces)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sum(r.length for r in got) / (2048 * len(by_sequence)) > 0.9
    assert packing.pack(docs.limit(0)).count() == 0


def plain_difference(sizes, windows):
    """Karmarkar-Karp with all windows of each partial partition written out."""
    parts = [sorted([s] + [0] * (windows - 1), reverse=True) for s in sizes]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[0] - p[-1])
        a, b = parts.pop(), parts.pop()
        parts.append(sorted((x + y for x, y in zip(a, reversed(b))), reverse=True))
    return parts[0]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), min_size=1, max_size=40, unique=True), st.integers(1, 6))
def test_differencing_against_all_windows_written_out(sizes, windows):
    found = [sum(sizes[i] for i in w) for w in packing.difference(sizes, windows)]
    want = [x for x in plain_difference(sizes, windows) if x]
    assert sum(found) == sum(want) and max(found) - (min(found) if len(found) == windows else 0) <= max(sizes)
    if windows == 2:
        assert sorted(found) == sorted(want)


def test_many_small_pieces_in_bounded_memory():
    code = (
        "import numpy as np, resource, sys; from tidelog.llm import packing; w = packing.windows_for(np.ones(600_000, int)); "
        "assert len(w) == 293 and sum(map(len, w)) == 600_000; print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)"
    )
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, env={**__import__("os").environ, "PYTHONPATH": ":".join(sys.path)}, check=True)
    assert int(out.stdout) < 500_000


def test_groups_are_bounded_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    texts = [None] * 400 + [" the" * (2047 + 2048 * 5)] * 20 + ["x " * 30_000]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string")
    got = packing.pack(docs).collect()
    assert len({r.sequence_id >> 32 for r in got}) > 5
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len({(r.doc_id, r.start) for r in got}) == len(got)
    ends = defaultdict(int)
    for r in got:
        ends[r.doc_id] += r.length
    assert all(ends[r.doc_id] == r.doc_tokens for r in got) and ends[0] == 1
