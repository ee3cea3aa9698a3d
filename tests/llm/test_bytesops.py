import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import bytesops as b
from tidelog.llm.common import spans_of, text_buffer


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \n\x0b", max_size=40), min_size=1, max_size=8), st.sampled_from([16, 1 << 20]))
def test_words(texts, block):
    b.BLOCK, old = block, b.BLOCK
    try:
        data, offsets = text_buffer(pa.array([None, *texts, ""], pa.string()))
        w = b.words_of(data, offsets)
    finally:
        b.BLOCK = old
    want = [(i + 1, m) for i, t in enumerate(texts) for m in re.findall(r"[^\x20\x09-\x0D]+", t)]
    raw = data[offsets[0] : offsets[-1]].tobytes()
    assert [(d, raw[s:e].decode()) for d, s, e in zip(w.doc.tolist(), w.start.tolist(), w.end.tolist())] == want
    lower = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for _, x in want]
    assert [int(c) for c in w.code] == [b.code_of(x) for x in lower]
    assert len(set(map(int, w.code))) == len(set(lower))


def test_shingles_depend_on_order():
    code = np.array([1, 2, 3, 2, 1, 1, 2, 3], np.uint64)
    s = b.shingle_codes(code, 3)
    assert s[0] == s[5] and s[0] != s[2] and len(s) == 6 and len(b.shingle_codes(code, 9)) == 0


def test_grams_stay_in_rows():
    data, offsets = text_buffer(pa.array(["abab", "", "ab", "b"], pa.string()))
    row, code = b.grams(data, offsets, 2, 16)
    assert row.tolist() == [0, 0, 0, 2] and code[0] == code[2] == code[3] != code[1]


def test_spans_and_sliced_arrays():
    data, offsets = text_buffer(pa.array(["xx", "abc", None, "d" * 9, "e"], pa.string())[1:])
    assert data[offsets[0] : offsets[1]].tobytes() == b"abc"
    assert list(spans_of(offsets, 4)) == [(0, 2), (2, 3), (3, 4)]
