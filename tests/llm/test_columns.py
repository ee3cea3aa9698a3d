"""Other columns keep their names and values, whatever they are called."""

import pytest

from tidelog.llm import bpe, exact_dedup, jaccard, langid, nbsvm, packing, quality_rules, substrings, toxicity

NAMES = ["a.b", "row", "__row", "__from", "from", "len", "c0", "key", "Doc ID`", "n"]


@pytest.fixture(scope="module")
def docs(spark):
    passage = " ".join(f"word{'abcdefghij'[i % 10]}{i}" for i in range(60))
    texts = ["shore under glass " * 5, "shore under glass " * 5, passage + " the end of it", "another begin " + passage, None, "baum haus und wald " * 4]
    rows = [(i, t, *[f"{name}{i}" for name in NAMES], len(t or "")) for i, t in enumerate(texts)]
    fields = ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES)
    out = spark.createDataFrame(rows, f"doc_id long, text string, {fields}, n_chars long").withColumn("lang", __import__("pyspark").sql.functions.lit("aa"))
    return out.coalesce(2)


@pytest.mark.parametrize("stage", [langid.in_known_language, exact_dedup.unique_documents, jaccard.one_of_each, substrings.without_passages])
def test_stages_return_all_columns(docs, stage):
    got = stage(docs)
    assert got.columns == docs.columns
    before = {r[0]: r for r in docs.collect()}
    after = got.collect()
    assert after and all(tuple(r)[2:-2] == tuple(before[r[0]])[2:-2] for r in after)


def test_operators_read_their_own_columns(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, i % 2, "z") for i in range(6)], "doc_id long, quality int, toxic int, `text` string")
    for got in (bpe.round_trip(docs), quality_rules.judged(docs), exact_dedup.groups(docs), jaccard.groups(docs), langid.identified(docs), nbsvm.classified(docs, labels), toxicity.scored(docs, labels)):
        assert sorted(r.doc_id for r in got.collect()) == list(range(6))
    assert {r.doc_id for r in packing.pack(docs).collect()} == set(range(6))


def test_a_name_in_another_case_is_not_mistaken(spark):
    with_case = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "y")], "doc_id long, text string, other string").toDF("doc_id", "text", "TEXT")
    got = exact_dedup.unique_documents(with_case)
    assert got.columns == ["doc_id", "text", "TEXT"] and [tuple(r) for r in got.collect()] == [(1, "a b", "x")]
