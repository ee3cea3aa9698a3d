"""The codec against the tokenizers library, and the operator on edge rows."""

import hashlib
import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidelog.llm import bpe

EDGES = ["", " ", "\n\n", "a  b", "\n\nT x", "it's we'll 'song", "é ü 漢字 😀", "<|endoftext|>a<|endoftext|>", "a" * 5000, "=" * 3000, "\t \r\n x ", "1d10t!!! ***", "a b c", "\x00\x7f"]


@pytest.fixture(scope="module")
def both():
    return bpe.Codec(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


@pytest.mark.parametrize("text", EDGES)
def test_edges(both, text):
    own, lib = both
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text).tolist() == ids == own.encode_whole(text).tolist()
    assert own.decode(np.array(ids, np.int64)) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_random(both, text):
    own, lib = both
    assert own.encode(text).tolist() == lib.encode(text, add_special_tokens=False).ids
    assert own.encode_whole(text).tolist() == own.encode(text).tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_decode_of_any_ids(both, ids):
    own, lib = both
    assert own.decode(np.array(ids, np.int64)) == lib.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=80))
def test_merge_loops_agree_and_cuts_are_certain(both, piece):
    own, _ = both
    whole = own.merge(piece)
    assert whole == list(own.merger(piece))
    assert whole == [i for f in own.fragments(piece) for i in own.merge(f)]


def test_memory_is_bounded(both, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    own = both[0]
    own.memory.clear()
    own.encode(" ".join(f"w{i}x" for i in range(500)))
    assert len(own.memory) <= 10


def test_operator(spark):
    lib = Tokenizer.from_file(bpe.default_path())
    rows = [(i, t) for i, t in enumerate(EDGES)] + [(99, None), (3, "same"), (3, "same"), (None, "x")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    got = sorted(map(tuple, bpe.round_trip(docs).collect()), key=str)
    want = []
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs.where("doc_id < 50 and doc_id <> 3"))).collect()}
    assert back == {i: t for i, t in enumerate(EDGES) if i != 3}
    assert bpe.round_trip(docs.limit(0)).count() == 0
