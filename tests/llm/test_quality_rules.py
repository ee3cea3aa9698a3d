"""Measures and verdicts against plain Python."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import quality_rules as q

STOP = {w for words in q.STOP_WORDS.values() for w in words.split()}


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = set()
    for i, w in enumerate(windows):
        if windows.count(w) > 1:
            covered |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
        "n_lines": len(lines),
        "n_stop_words": sum(w in STOP for w in words),
        "base_failed": len(words) < 10 or 100 * len(covered) > 20 * len(words),
    }


def verdict(m):
    if m["base_failed"]:
        return False
    for r in q.RULES:
        v = m[r.numerator] / m[r.denominator] if m[r.denominator] else 0.0
        if (r.low is not None and v < r.low) or (r.high is not None and v > r.high):
            return False
    return True


def check(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(texts)], "doc_id long, text string, words string, kept boolean")
    got = {r.doc_id: r.asDict() for r in q.judged(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i] == {"doc_id": i, "kept": verdict(want), **want}, t


def test_edges(spark):
    rng = random.Random(1)
    texts = [None, "", " \n\t", "a b c d", "a b c d e", "a b c d e a b c d e", "a a a a a a a a a", "x\n\nx\nx \n x", "é 漢     b", "#*$%&|<> the and", "y" * 50_000]
    texts += [" ".join(rng.choice("abc") for _ in range(n)) for n in (6, 9, 20, 60, 300)]
    texts += ["\n".join(rng.choice(["the cat sat on the mat", "of and to", "z ***"]) for _ in range(n)) for n in (2, 5, 30)]
    check(spark, texts + texts[:4])


def test_random(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.text(alphabet="ab \n\t\x0b#é", max_size=120), min_size=1, max_size=30))
    def run(texts):
        check(spark, texts)

    run()


def test_native_plan_and_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    out = q.judged(docs)
    assert out.count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
