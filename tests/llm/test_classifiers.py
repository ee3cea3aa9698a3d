"""Language ID, toxicity and quality: parts against plain versions, held-out accuracy,
edge rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidelog.llm import bytesops, langid, nbsvm, toxicity
from tidelog.llm.common import text_buffer
from tidelog.llm.labels import labelled

WORDS = {"aa": "the of and with thing shore", "bb": "der die und nicht zwölf straße", "cc": "le les été qui pour où"}
EDGES = [None, "", " \n", "123 !!", "é", "x" * 400_000]


def corpus(n=400, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        words = [rng.choice(WORDS[lang].split()) for _ in range(rng.randint(4, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            words = [w + "***" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["grobnik", "idiot", "snarfel"])
        rows.append((i, " ".join(words), lang, int(not bad), int(toxic)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(*r[:3], 0.5, True) for r in rows], "doc_id long, text string, lang string, score double, predicted boolean")
    labels = spark.createDataFrame([(r[0], *r[3:]) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    return docs, labels


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


@pytest.fixture(scope="module")
def rows():
    return corpus() + [(10_000 + i, t, None, None, None) for i, t in enumerate(EDGES)] + [(None, "the of", "aa", 1, 0), (1, "the of and with", "aa", 1, 0)]


def test_language(spark, rows):
    docs, _ = tables(spark, rows)
    got = langid.identified(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {r[0]: r[2] for r in rows if r[0] is not None and r[0] < 400}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i, 5) == 0}
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.95
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(EDGES):
        assert (by[10_000 + i].lang_pred == "und") == (t is None or not any(c.isalpha() for c in t))
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and {10_000, 10_001, 10_002, 10_003}.isdisjoint(r.doc_id for r in kept.collect())
    assert {i for i in truth} <= {r.doc_id for r in kept.collect()}
    assert langid.identified(docs.limit(0)).count() == 0


def test_language_counts_in_parts(monkeypatch):
    text = "".join(random.Random(3).choice("abc dé9") for _ in range(5000))
    data, offsets = text_buffer(pa.array([text]))
    whole = langid.counts(data, offsets)
    monkeypatch.setattr(langid, "CHUNK", 700)
    ((a, b, parts),) = langid.pieces(data, offsets)
    assert (a, b) == (0, 1) and (parts == whole).all()


def test_toxicity(spark, rows):
    docs, labels = tables(spark, rows)
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {r[0]: r[4] for r in rows if r[0] is not None and r[0] < 400 and r[0] != 1}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert toxicity.scored(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def test_quality(spark, rows):
    docs, labels = tables(spark, rows)
    got = nbsvm.classified(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    truth = {r[0]: r[3] for r in rows if r[0] is not None and r[0] < 400 and r[0] != 1}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc(i, 4) == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert nbsvm.classified(docs, labels.limit(0)).count() == len(rows)
    assert nbsvm.classified(docs.limit(0), labels).count() == 0


def test_isotonic_against_brute_force():
    rng = np.random.default_rng(1)
    m, y = rng.integers(0, 12, 60).astype(float), rng.integers(0, 2, 60).astype(float)
    knots, values = toxicity.isotonic(m, y, np.ones(60))
    got = np.interp(m, knots, values)
    levels = np.unique(m)
    mean = lambda a, b: y[(m >= a) & (m <= b)].mean()
    for level in levels:  # the max-min formula of isotonic regression
        want = max(min(mean(a, b) for b in levels[levels >= level]) for a in levels[levels <= level])
        assert abs(got[m == level][0] - want) < 1e-9


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(12, 4, replace=False)) for _ in range(60)]
    ratio, y, cost = rng.normal(size=12), rng.choice([-1.0, 1.0], 60), np.full(60, 0.7)
    w, bias = nbsvm.descend([nbsvm.packed(r) for r in rows], ratio, y, cost, rounds=400)
    x = np.zeros((60, 13))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
    x[:, 12] = 1
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    found = np.append(w, bias)
    best = loss(found)
    assert all(best <= loss(found + rng.normal(size=13) * s) + 0.02 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(50))


def test_hidden_insults_and_neighbours_show_in_features():
    texts = ["you are an idiot", "you 1d10t", "idiot said the man who went far away from all of you", ""]
    x = toxicity.features(*text_buffer(pa.array(texts)), toxicity.constant(0).lexicon)
    at = toxicity.NAMES.index
    assert x[0, at("insults")] == 0.25 and x[1, at("hidden")] == 0.5 and x[1, at("insults")] == 0
    assert x[0, at("near_you")] > 0 and x[2, at("near_you")] == 0 and not x[3].any()


def bucket_of(gram: bytes, bits: int) -> int:
    return int(bytesops.grams(np.frombuffer(gram, np.uint8), np.array([0, len(gram)]), len(gram), bits)[1][0])


def plain_cosines(text, model):
    """Plain TF-IDF: n-grams of letters in lower case, all else of ASCII one space each."""
    raw = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").encode())
    n = Counter(raw[i : i + w] for w in langid.WIDTHS for i in range(len(raw) - w + 1))
    vector = Counter()
    for gram, count in n.items():
        if gram.strip(b" "):
            vector[bucket_of(gram, langid.BITS)] += count
    for blank in (b"  ", b"   "):
        vector.pop(bucket_of(blank, langid.BITS), None)
    weight = {k: math.log1p(c) * float(model.idf[k]) for k, c in vector.items()}
    norm = math.sqrt(sum(v * v for v in weight.values())) or 1.0
    return [sum(v / norm * float(c[k]) for k, v in weight.items()) for c in model.centroids], sum(vector.values())


def test_language_against_a_plain_scorer(spark, rows):
    docs, _ = tables(spark, rows)
    model = langid.fit(langid.learnable(docs))
    got = {r.doc_id: r for r in langid.identified(docs).collect()}
    rejected = {r.doc_id: r.rejected for r in langid.predict(docs, model).collect()}
    texts = [(r[0], r[1]) for r in rows if r[0] is not None and (r[0] >= 10_000 or r[0] < 60 and r[0] != 1) and len(r[1] or "") < 100_000]
    for i, t in texts:
        if t is None or not any(c.isalpha() for c in t):
            assert (got[i].lang_pred, got[i].score, rejected[i]) == ("und", 0.0, True)
            continue
        cosines, n = plain_cosines(t, model)
        best = max(cosines)
        assert abs(got[i].score - min(1.0, max(0.0, best))) < 1e-4
        assert got[i].lang_pred in {model.langs[k] for k, c in enumerate(cosines) if c > best - 1e-4}
        floor = model.floor[int(math.log2(max(1, n)))]
        assert abs(best - floor) < 1e-4 or rejected[i] == (best < floor)


def test_every_language_is_learned(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, f"{letters[i % 26]}{letters[i // 26 % 26]}{letters[i // 676]} {letters[i % 7] * 3}", f"l{i % 1100}") for i in range(2300)]
    rows += [(5000 + i, "the of and", "l0") for i in range(3000)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model.langs) == {f"l{i}" for i in range(1100)}


def plain_features(text, lexicon):
    """The features one by one, from the text's words and characters."""
    text = text or ""
    raw, low = text.encode(), "".join(c.lower() if c.isascii() else c for c in text)
    words = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", low)
    table = dict(zip(lexicon.code.tolist(), lexicon.weight.tolist()))
    insults, second = set(toxicity.INSULTS.split()), set(toxicity.SECOND_PERSON.split())
    learned = [table.get(bytesops.code_of(w), 0.0) for w in words]
    known = [bytesops.code_of(w) in table for w in words]
    hit = [w in insults or k for w, k in zip(words, known)]
    you = [i for i, w in enumerate(words) if w in second]
    near = sum(h and any(abs(i - j) <= toxicity.NEAR_WORDS for j in you) for i, h in enumerate(hit))
    plain = low.translate(str.maketrans("013457@$", "oieastas"))
    shown = re.findall(r"[a-z0-9\u0080-\U0010ffff]+", "".join(p if o in "@$" else p for p, o in zip(plain, low)))
    hidden = max(sum(w in insults or bytesops.code_of(w) in table for w in shown) - sum(hit), 0)
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    digit = lambda b: 48 <= b <= 57
    pairs, triples = list(zip(raw, raw[1:])), list(zip(raw, raw[1:], raw[2:]))
    count, size, letters = max(len(words), 1), max(len(raw), 1), max(sum(map(letter, raw)), 1)
    return [
        sum(w in insults for w in words) / count, sum(known) / count, math.log1p(sum(known)), sum(learned) / count, max([0.0, *learned]),
        math.log1p(sum(w in insults for w in words)), near / count, hidden / count, sum(65 <= b <= 90 for b in raw) / letters,
        sum(b in b".,;:!?'\"-()" for b in raw) / size, raw.count(b"!") / size, sum(b in b"#*$%&|<>@^~_=+/\\" for b in raw) / size,
        sum(digit(b) and letter(a) or letter(b) and digit(a) for a, b in pairs) / count, sum(a == b == c and letter(c) for a, b, c in triples) / size,
        math.log1p(len(words)), sum(w in second for w in words) / count,
    ]


def plain_toxicity(x, model):
    """A walk down each tree, and a look-up in the calibration's steps."""
    margin = model.base
    for tree in model.trees:
        node = 0
        while node < len(tree.feature):
            node = 2 * node + 1 + int(x[tree.feature[node]] > tree.threshold[node])
        margin += float(tree.leaf[node - len(tree.feature)])
    knots, values = model.knots.tolist(), model.values.tolist()
    if margin <= knots[0] or margin >= knots[-1]:
        return values[0] if margin <= knots[0] else values[-1]
    k = next(i for i in range(1, len(knots)) if margin <= knots[i])
    if knots[k] == knots[k - 1]:
        return values[k]
    return values[k - 1] + (values[k] - values[k - 1]) * (margin - knots[k - 1]) / (knots[k] - knots[k - 1])


def test_toxicity_against_a_plain_scorer(spark, rows):
    docs, labels = tables(spark, rows)
    model = toxicity.fit(docs, labels.where(~toxicity.held_out()))
    assert len(model.trees) == toxicity.TREES and len(model.lexicon.code)
    texts = [t for _, t, *_ in rows if len(t or "") < 5000][:80] + ["You 1d10t!!! gr0bnik", "AAA bbb 3x", "grobnik", "#*$ <you>"]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).collect()]
    x = toxicity.features(*text_buffer(pa.array(texts)), model.lexicon)
    for t, row, score in zip(texts, x, got):
        assert np.allclose(row, plain_features(t, model.lexicon))
        assert abs(score - min(1.0, max(0.0, plain_toxicity(row.tolist(), model)))) < 1e-9


def plain_indicators(text):
    raw, found = (text or "").encode(), set()
    for w in nbsvm.WIDTHS:
        found |= {raw[i : i + w] for i in range(len(raw) - w + 1)}
    out = {bucket_of(g, nbsvm.BITS) for g in found}
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    if words:
        share = max(sum(a == b for a, b in zip(words, words[1:])) / len(words), 0.5 ** (nbsvm.SHARES - 1))
        out.add((1 << nbsvm.BITS) + int(-math.log2(share) + 1e-9))
    return sorted(out)


def test_quality_against_a_plain_margin(spark, rows):
    docs, labels = tables(spark, rows)
    model = nbsvm.fit(labelled(docs, labels.where(~nbsvm.held_out()), "quality", nbsvm.SAMPLE_ROWS, "nbsvm")[0])
    texts = [t for _, t, *_ in rows if len(t or "") < 5000][:60] + ["a a a a b", "x", "### ### ###"]
    got = [r.score for r in nbsvm.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).collect()]
    for t, score in zip(texts, got):
        found = plain_indicators(t)
        margin = model.bias
        if found:
            margin += sum(model.weights[k] for k in found) / max(math.sqrt(sum(model.ratio[k] ** 2 for k in found)), 1e-12)
        assert abs(score - 1 / (1 + math.exp(-min(30, max(-30, model.slope * margin + model.shift))))) < 1e-9


@pytest.mark.parametrize("text", ["x" * 5000, "ab é9 " * 900, " ".join(random.Random(4).choice("abcdefgh") * 3 for _ in range(3000))])
def test_indicators_do_not_depend_on_the_parts_of_a_long_text(monkeypatch, text):
    found = []
    for chunk in (1 << 10, 1 << 30):
        monkeypatch.setattr(nbsvm, "CHUNK", chunk)
        ((_, row),) = nbsvm.indicators(*text_buffer(pa.array([text])))
        found.append(row.tolist())
        assert nbsvm.unpacked(nbsvm.packed(row)).tolist() == row.tolist()
    assert found[0] == found[1] == plain_indicators(text)
    assert nbsvm.unpacked(nbsvm.packed(np.arange(60_000))).tolist() == list(range(60_000))


def test_long_texts_are_learned_from(spark):
    rng = random.Random(12)
    rows = []
    for i in range(70):
        bad, toxic = i % 2, i % 3 == 0
        words = [rng.choice(["shore", "under", "glass", "forest"]) + ("***" if bad else "") for _ in range(7000)]
        for _ in range(300 * toxic):
            words[rng.randrange(len(words))] = "idiot"
        rows.append((i, " ".join(words), "aa", 1 - bad, int(toxic)))
    assert min(len(r[1]) for r in rows) > 32_768
    docs, labels = tables(spark, rows)
    docs = docs.repartition(4)
    truth = {r[0]: r for r in rows}
    assert all(r.predicted == truth[r.doc_id][3] for r in nbsvm.classified(docs, labels).collect())
    assert all(r.predicted == truth[r.doc_id][4] for r in toxicity.scored(docs, labels).collect())


def test_an_id_that_many_share_keeps_the_sample_bounded(spark):
    docs = spark.range(0, 4000, 1, 3).selectExpr("id % 4 * id AS doc_id", "'some text' AS text")
    labels = spark.range(0, 3000, 1, 3).selectExpr("id % 3 * id AS doc_id", "CAST(id % 2 AS int) AS quality")
    rows, _ = labelled(docs, labels, "quality", 200, "x")
    assert 100 < rows.count() < 600
    assert rows.agg({"n0": "sum"}).first()[0] > 0


def test_labels_repeated_for_an_id_count_each(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (1, 1), (1, 1), (2, 1), (2, 7), (None, 1)], "doc_id long, quality int")
    rows, share = labelled(docs, labels, "quality", 1000, "x")
    assert sorted((r.text, r.n0, r.n1) for r in rows.collect()) == [("a", 1, 2), ("b", 0, 1)] and share == {0: 1.0, 1: 1.0}
