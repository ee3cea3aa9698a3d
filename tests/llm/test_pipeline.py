"""Every stage on the last one's output, against plain versions of the operators."""

import random
import re

import pytest

import corpus_pipeline
from test_jaccard import brute
from test_substrings import exact_repeats

WORDS = {"aa": "the of and with thing shore under glass", "bb": "der die und nicht zwölf straße baum haus", "cc": "le les été qui pour où forêt verre"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)

    def text(lang, n):
        stem = WORDS[lang].split()
        return " ".join(rng.choice(stem) if rng.random() < 0.4 else rng.choice(stem)[:3] + rng.choice(stem)[-3:] + rng.choice("abcdefgh") for _ in range(n))

    passage = text("aa", 70)
    rows = []
    for i in range(150):
        lang = rng.choice(list(WORDS))
        body = text(lang, rng.randint(3, 150))
        if i % 10 == 3:
            body += "\n" + passage + "\n" + text(lang, 100)
        rows.append((i, body, lang))
    copies = [(200 + k, rows[k][1].replace(" ", "  "), rows[k][2]) for k in range(0, 30, 3)]
    near = [(300 + k, rows[k][1] + " ende", rows[k][2]) for k in range(1, 60, 4) if len(rows[k][1].split()) > 60]
    odd = [(400, None, "aa"), (401, "", "aa"), (402, "123 456", None), (None, text("bb", 40), "bb"), rows[8], rows[8], (403, text("aa", 30_000), "aa")]
    rows += copies + near + odd
    rng.shuffle(rows)
    path = str(tmp_path_factory.mktemp("sf"))
    full = [(i, t, lang, "src", len(t or ""), "x") for i, t, lang in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, `a.row` string").coalesce(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = corpus_pipeline.staged(stage(spark, docs, folder), name)
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
    rows = lambda name: sorted((tuple(r) for r in seen[name][1].select("doc_id", "text").collect()), key=str)
    before, _ = seen["language_id"]
    assert rows("language_id") == sorted([r for r in before if r[1] and any(c.isalpha() for c in r[1])], key=str)
    before, _ = seen["exact_dedup"]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for i, t in sorted(before, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(norm(t), (i, t))
    assert rows("exact_dedup") == sorted(first.values(), key=str)
    before, _ = seen["near_dedup"]
    keep = {(i, c) for i, _, c in brute(before) if i == c}
    assert {i for i, _ in rows("near_dedup") if i is not None} == {i for i, _ in keep if i is not None}
    before, _ = seen["substring_dedup"]
    want = exact_repeats([r for r in before if r[0] is not None])
    left = dict(rows("substring_dedup"))
    for i, t in before:
        if i in want:
            # A word beside the passage may equal that of one earlier document by chance.
            assert len(left[i].split()) <= len(t.split()) - len(want[i]) + 2
        elif i is not None:
            assert left[i] == t
    assert want
    packed = seen["packing"][1]
    assert packed.agg({"length": "sum"}).first()[0] == sum(r.doc_tokens for r in packed.select("doc_id", "doc_tokens").distinct().collect())


def test_run(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 100
