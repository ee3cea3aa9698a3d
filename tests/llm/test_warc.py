"""Round trips through archives, the loser tree against a sort, and edge rows."""

import base64
import hashlib
import heapq
import io
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidelog.llm import warc
from tidelog.llm.common import fresh_path


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    tagged = [[(v, i) for v in r] for i, r in enumerate(runs)]
    assert list(warc.LoserTree(tagged, lambda t: t[0])) == list(heapq.merge(*tagged, key=lambda t: t[0]))


def test_url_keys():
    assert warc.url_key("HTTP://www.A.example.com:80/x/?b=2&a=1#top") == "com,example,a)/x?a=1&b=2"
    assert warc.url_key("https://a.org:8443") == "org,a:8443)/" and warc.url_key(None) == "" and warc.url_key("http://[bad") == "http://[bad"


def test_records_survive_reading_in_small_pieces():
    payloads = [b"", b"x" * 100_000, "é\r\n\r\nWARC/1.1".encode()]
    data = b"".join(warc.page_record(i, i, f"http://a/{i}\n", p, None) for i, p in enumerate(payloads))
    for size in (1, 7, 1 << 20):
        got = [warc.http_payload(warc.parsed(c)[1])[1] for _, _, c in warc.members(io.BytesIO(data), size)]
        assert got == payloads
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-3])))


def test_damage_is_found():
    good = warc.page_record(1, 1, "http://a/", b"abc", None)
    _, _, content = next(warc.members(io.BytesIO(good)))
    bad = warc.zlib.compressobj(1, 8, 31)
    with pytest.raises(ValueError):
        warc.read_run(io.BytesIO(bad.compress(content.replace(b"abc", b"abd")) + bad.flush()), "x")


@pytest.mark.parametrize("least, limit, tune", [(0, 32 << 20, {}), (2, 2000, {"FAN_IN": 3, "RUN_BATCH": 2, "LEAST_RANGE_ROWS": 10}), (0, 900, {"FAN_IN": 2, "RANGE_ROWS": 30, "RUN_BATCH": 3})])
def test_round_trip(spark, monkeypatch, least, limit, tune):
    for name, value in {"ARCHIVE_BYTES": limit, **tune}.items():
        monkeypatch.setattr(warc, name, value)
    rng = random.Random(least)
    html = ["", "a", "same", "<p>é\r\n</p>", "z" * 200_000]
    rows = [(i, f"http://h{rng.randrange(4)}.example.com/{rng.randrange(3)}", rng.choice([*html, f"own{i}"])) for i in range(120)]
    rng.shuffle(rows)
    rows += [(500, None, None), (501, "", "tail"), (502, "http://x/ y\n", "same")]
    pages = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, row int").repartition(5)
    folder = fresh_path(spark, "test")
    index = warc.merged(warc.read_archives(warc.write_archives(pages, folder, least), folder), folder)
    got = [r.asDict() for r in index.collect()]
    firsts = {}
    for i, _, h in sorted(rows):
        firsts.setdefault(h or "", i)
    want = {}
    for i, _, h in rows:
        raw = (h or "").encode()
        again = len(raw) >= least and firsts[h or ""] != i
        want[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", firsts[h or ""] if again else None)
    assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got} == want
    assert len(got) == len(rows) and [warc.order_of(r) for r in got] == sorted(warc.order_of(r) for r in got)
    back = {r.page_id: bytes(r.payload).decode() for r in warc.payloads(index, folder).collect()}
    assert back == {i: h or "" for i, _, h in rows if want[i][2] == "response"}


def test_repeated_and_null_ids_and_empty_table(spark):
    pages = spark.createDataFrame([(4, "u", "p"), (4, "u", "p"), (None, "u", "p"), (None, None, "q")], "page_id long, url string, html string").coalesce(1)
    got = sorted(((r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()), key=str)
    assert got == sorted([(4, "response", None), (4, "revisit", 4), (None, "revisit", 4), (None, "response", None)], key=str)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_a_second_attempt_leaves_the_first_alone(spark):
    """A task that runs again, with its rows in another order, into the same folder."""
    rows = [(i, f"http://h/{i}", f"page {i % 7}") for i in range(90)]
    folder = fresh_path(spark, "attempts")
    made = []
    for turn in range(2):
        pages = spark.createDataFrame(rows[:: 1 - 2 * turn], "page_id long, url string, html string").coalesce(2)
        made.append(warc.write_archives(pages, folder))
    for manifest in (made[0], made[1], made[0]):
        got = [r.page_id for r in warc.merged(warc.read_archives(manifest, folder), folder).collect()]
        assert sorted(got) == list(range(90))


def test_slices_of_a_run(spark, tmp_path, monkeypatch):
    schema = warc.arrow_schema(warc.INDEX)
    monkeypatch.setattr(warc, "RUN_BATCH", 4)
    rng = random.Random(1)
    rows = sorted(({"url_key": f"k{rng.randrange(6)}", "timestamp": "1", "page_id": rng.choice([None, rng.randrange(9)]), "row": i} for i in range(50)), key=warc.order_of)
    store, root = warc.fs.FileSystem.from_uri(f"file://{tmp_path}")
    assert warc.write_run(store, f"{root}/x.run", rows, schema) == 50
    keys = [warc.order_of(r) for r in rows]
    for low, high in [(None, None), (keys[0], keys[9]), (keys[9], keys[9]), (keys[20], None), (None, keys[33]), (("k2", "", False, 0, 0), ("k4", "", False, 0, 0))]:
        got = [warc.order_of(r) for r in warc.slice_of(store, f"{root}/x.run", low, high)]
        assert got == [k for k in keys if (low is None or k >= low) and (high is None or k < high)]
