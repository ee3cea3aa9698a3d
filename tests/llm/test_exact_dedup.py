"""Block naming against a dictionary, with several block sizes and edge rows."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tidelog.llm import exact_dedup


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    by = defaultdict(list)
    for (i, _), t in zip(rows, norm):
        by[t].append(i)
    out = []
    for (i, _), t in zip(rows, norm):
        ids = [x for x in by[t] if x is not None]
        out.append((i, min(ids, default=None), len(by[t]), hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def table(rng):
    base = ["".join(rng.choice("ab é") for _ in range(rng.choice([0, 1, 7, 8, 9, 16, 33, 100]))) for _ in range(40)]
    rows = [(n, rng.choice(base)) for n in range(150)]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, " "), (204, "x" * 3000), (205, "x" * 3000), (206, "x" * 2999 + "y")]
    long = "".join(rng.choice("abc d") for _ in range(90_000)).strip()
    rows += [(207, long), (208, long.replace(" ", " \n")), (209, long[:-1] + "y"), (210, "y" + long[1:]), (211, long[:-1] + "y"), (212, long * 3)]
    return rows + [(7, "twice"), (7, "twice"), (None, "twice"), (None, "no id"), (None, "no id")]


@pytest.mark.parametrize("size", [8, 4096])
def test_groups(spark, size):
    rows = table(random.Random(size))
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, name string, row int")
    got = exact_dedup.groups(docs, size).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    kept = defaultdict(list)
    for r in got:
        kept[r.text_sha256].append(r.kept)
    assert all(sum(k) == 1 for k in kept.values())
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_unique_documents_keep_all_columns(spark):
    docs = spark.createDataFrame([(1, "a  b", "q", 5), (2, "a b", "r", 6), (3, "c", None, None)], "doc_id long, text string, level string, row int")
    assert sorted(map(tuple, exact_dedup.unique_documents(docs).collect())) == [(1, "a  b", "q", 5), (3, "c", None, None)]
    assert exact_dedup.unique_documents(docs.limit(0)).count() == 0
