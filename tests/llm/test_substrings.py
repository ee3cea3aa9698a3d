"""Passages against a word-by-word search on planted texts; chains against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from tidelog.llm import packed_rows
from tidelog.llm import substrings as s


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def exact_repeats(rows):
    """{doc: word positions in runs of MIN_WORDS or more that an earlier document has}."""
    seen, out = set(), {}
    for doc, t in sorted(rows, key=lambda r: r[0]):
        w, hit = words(t), set()
        for i in range(len(w) - s.MIN_WORDS + 1):
            if tuple(w[i : i + s.MIN_WORDS]) in seen:
                hit |= set(range(i, i + s.MIN_WORDS))
        seen |= {tuple(w[i : i + s.MIN_WORDS]) for i in range(len(w) - s.MIN_WORDS + 1)}
        if hit:
            out[doc] = hit
    return out


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (55, 80, 200)]
    rows = []
    for _ in range(60):
        own = text(rng.randint(0, 120))
        if rng.random() < 0.5:
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(shared)
        if rng.random() < 0.3:
            own += text(20) + rng.choice(shared)
        rows.append(own)
    for _ in range(15):  # far below the length that counts
        rows.append(text(40) + shared[0][:25] + text(40))
    fuzzy = []
    for _ in range(6):
        own = list(shared[2])
        for _ in range(8):
            own[rng.randrange(len(own))] = word()
        del own[60:62]
        own[120:120] = text(2)
        fuzzy.append(len(rows))
        rows.append(text(30) + own + text(30))
    return [(i, rng.choice([" ", "\n", "  "]).join(t)) for i, t in enumerate(rows)], fuzzy


@pytest.mark.parametrize("seed, tune", [(1, {}), (2, {"COMMON_COUNT": 2}), (3, {"COMMON_COUNT": 10_000, "PART_SEEDS": 50})])
def test_passages(spark, monkeypatch, seed, tune):
    for name, value in tune.items():
        monkeypatch.setattr(s, name, value)
    if "PART_SEEDS" in tune:
        monkeypatch.setattr(packed_rows, "COARSE_BITS", 2)
        monkeypatch.setattr(packed_rows, "ITEMS", 300)
    rows, fuzzy = planted(seed)
    rows += [(900, None), (901, ""), (902, rows[3][1].upper()), (903, "w " * 20_000), (904, "x y"), (905, " ".join(words(rows[4][1])[:9]) + " w" * 300)]
    docs = spark.createDataFrame([(*r, 1, 0) for r in rows], "doc_id long, text string, row int, doc int")
    got = {}
    for r in s.passages(docs).collect():
        assert r.n_words >= s.MIN_WORDS and r.identity >= s.MIN_IDENTITY and (r.source_doc_id, r.source_row) < (r.doc_id, r.row)
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    want = exact_repeats([r for r in rows if r[0] not in fuzzy])
    for doc, places in want.items():
        assert places <= got[doc], (doc, len(places - got[doc]))
        assert len(got[doc] - places) <= 6
    for doc in fuzzy:
        assert len(got[doc]) > 180 and len(got[doc]) < 215
    assert set(got) == set(want) | set(fuzzy)


def test_removal(spark):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choice("klmnop") for _ in range(6)) for _ in range(n))
    shared, own = text(90), [text(30) for _ in range(4)]
    rows = [(1, f"{own[0]}\n{shared}"), (2, f"{own[1]}\n{shared}\n{own[2]}"), (3, shared), (4, own[3]), (5, ""), (6, None)]
    docs = spark.createDataFrame([(i, t, len(t or ""), "z") for i, t in rows], "doc_id long, text string, n_chars long, words string")
    got = {r.doc_id: r for r in s.without_passages(docs).collect()}
    assert set(got) == {1, 2, 4, 5, 6} and docs.columns == s.without_passages(docs).columns
    assert got[1].text == rows[0][1] and got[2].text == f"{own[1]}\n{own[2]}" and got[2].n_chars == len(got[2].text) and got[2].words == "z"
    assert s.without_passages(docs.limit(0)).count() == 0


def test_passage_of_another_document_in_the_gap_of_a_chain(spark):
    rng = random.Random(8)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    a, b = text(400), text(60)
    rows = [(1, a), (2, text(50) + b + text(50)), (3, text(5) + a[:200] + b + a[200:] + text(5))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = sorted((r.start_word, r.n_words, r.source_doc_id) for r in s.passages(docs).collect())
    assert got == [(5, 200, 1), (205, 60, 2), (265, 200, 1)]


def test_better_chain_that_gives_no_passage(spark):
    rng = random.Random(9)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    own = text(60)
    stretches = [text(45) for _ in range(6)]  # each too short to count, with gaps no passage spans
    far = [w for t in stretches for w in t + text(20)]
    here = [w for k, t in enumerate(stretches) for w in (t + text(20) if k != 2 else t + own)]
    rows = [(1, far), (2, text(30) + stretches[2] + own[:20] + text(30)), (3, here)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in s.passages(docs).collect()]
    assert got == [(3, 130, 65, 2)]


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(7, t), (7, t), (None, t), (3, t)], "doc_id long, text string").coalesce(1)
    got = sorted(((r.doc_id, r.n_words, r.source_doc_id) for r in s.passages(docs).collect()), key=str)
    assert got == [(7, 70, 3), (7, 70, 3), (None, 70, 3)]


def test_fenwick_prefix_maxima():
    rng = random.Random(0)
    tree, plain = s.Fenwick(50), [float("-inf")] * 50
    for k in range(200):
        at, value = rng.randrange(50), rng.random()
        tree.add(at, value, k)
        plain[at] = max(plain[at], value)
        below = rng.randrange(51)
        assert tree.prefix(below)[0] == max(plain[:below], default=float("-inf"))


def test_best_chain_against_all_chains():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        x0 = [rng.randrange(60) for _ in range(n)]
        y0 = [rng.randrange(60) for _ in range(n)]
        x1 = [x + rng.randint(5, 15) for x in x0]
        best = 0.0
        for size in range(1, n + 1):
            for path in itertools.permutations(range(n), size):
                score, fine = 0.0, True
                for k, i in enumerate(path):
                    score += x1[i] - x0[i]
                    if k:
                        j = path[k - 1]
                        gx, gy = x0[i] - x1[j], y0[i] - (y0[j] + x1[j] - x0[j])
                        fine &= gx >= 0 and gy >= 0
                        score -= s.GAP_COST * (gx + gy)
                if fine:
                    best = max(best, score)
        found = s.chains(x0, x1, y0)
        assert abs(max(f[0] for f in found) - best) < 1e-9
        assert sorted(i for _, p in found for i in p) == list(range(n))


def test_common_run_is_a_longest_subsequence():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert s.common_run(a, b).sum() == table[-1][-1]


def test_common_words_is_as_long_in_pieces(monkeypatch):
    rng = np.random.default_rng(4)
    for cells in (1, 7, 30):
        monkeypatch.setattr(s, "TABLE_CELLS", cells)
        for _ in range(40):
            a, b = rng.integers(0, 4, rng.integers(1, 25)), rng.integers(0, 4, rng.integers(1, 25))
            on = s.common_words(a, b)
            assert len(on) == len(a) and on.sum() == s.common_run(a, b).sum()
            rest = iter(b.tolist())
            assert all(w in rest for w in a[on].tolist())


def test_large_gap_is_aligned():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 30, 1800)
    b = np.concatenate([a[:700], rng.integers(0, 1 << 30, 9), a[700:]])  # the gap: 600 words by 609
    equal = s.equal_words(a, b, [0, 1200], [0, 1209], [600, 600])
    assert equal.all()


def test_passage_whose_seeds_lead_to_parts_of_it(spark):
    rng = random.Random(10)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    p = text(64)
    parts = [p[:40], p[20:], p[10:50], p, p[:45], p[18:], p[8:52], p]  # the fourth has it whole
    rows = [(i, text(30) + part + text(30)) for i, part in enumerate(parts)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in s.passages(docs).collect()]
    assert got == [(7, 30, 64, 3)]


def test_repeated_words_within_a_passage(spark):
    rng = random.Random(11)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    line = text(7)
    p = line * 8  # every seed recurs nearby
    rows = [(1, text(20) + line + p + text(20)), (2, p[:40] + text(30)), (3, text(9) + p + text(9)), (4, line + text(3) + p[3:] + text(9))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string").coalesce(1)
    got = {}
    for r in s.passages(docs).collect():
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    want = exact_repeats([(i, " ".join(t)) for i, t in rows])
    assert set(got) == set(want) == {3, 4} and all(want[i] <= got[i] for i in want)


def test_window_codes_tell_windows_apart():
    words_ = np.random.default_rng(6).integers(0, 3, 400).astype(np.int32)
    codes = s.window_codes(words_)
    windows = [tuple(words_[i : i + s.MIN_WORDS]) for i in range(len(words_) - s.MIN_WORDS + 1)]
    assert len(codes) == len(windows) and len(set(codes.tolist())) == len(set(windows))
    assert s.window_codes(np.tile(words_, 2))[400] == codes[0] and all(len(s.window_codes(words_[:n])) == max(0, n - 49) for n in range(60))


def test_exact_runs_end_where_the_source_does_not_follow():
    rng = np.random.default_rng(7)
    a = rng.integers(0, 1 << 30, 200)
    b = np.concatenate([a[:100], rng.integers(0, 1 << 30, 3), a[100:]])  # three words more between
    cut = np.zeros(200, bool)
    equal = s.equal_words(a, b, [0, 110], [0, 113], [90, 90], cut)
    assert equal.all() and s.exact_runs(equal, cut) == [(0, 90), (110, 90)]
    equal[40] = False
    assert s.exact_runs(equal, cut) == [(110, 90)] and s.exact_runs(np.ones(60, bool), np.zeros(60, bool)) == [(0, 60)]
    assert s.exact_runs(np.zeros(0, bool), np.zeros(0, bool)) == []


@pytest.mark.parametrize("count", [2, 10, 10_000])
def test_common_seeds_have_the_same_matches(spark, monkeypatch, count):
    monkeypatch.setattr(s, "COMMON_COUNT", count)
    rng = random.Random(12)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    p = text(120)
    rows = [text(15) + p[at : at + 24] + text(15) for _ in range(12) for at in range(0, 97, 12)]  # too short to count
    changed = [w if k % 15 != 7 else text(1)[0] for k, w in enumerate(p)]
    rows += [text(20) + p + text(20), text(20) + changed + text(20)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in s.passages(docs).collect()]
    assert got == [(109, 20, 120, 108)]  # the first holders of its seeds hold 24 words each


def test_matches_do_not_depend_on_how_seeds_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(s, "PART_SEEDS", 50)
    rng = random.Random(13)
    rows, _ = planted(4)
    line = " ".join(f"v{i}" for i in range(20))
    rows = [(None if i % 9 == 4 else i // 2, f"{line} {t} {line}" if i % 3 else t) for i, t in rows]  # ids that are null or repeated
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).localCheckpoint()
    got = []
    for count in (2, 20, 10_000):
        monkeypatch.setattr(s, "COMMON_COUNT", count)
        got.append(sorted(map(tuple, s.passages(docs).collect()), key=str))
    assert got[0] and got[0] == got[1] == got[2]


def test_common_seeds_are_counted_in_all_texts(spark, monkeypatch):
    monkeypatch.setattr(s, "PART_SEEDS", 300)  # seeds of a chunk
    monkeypatch.setattr(s, "COMMON_COUNT", 30)
    rng = random.Random(14)
    text = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    lines = [text(25) for _ in range(40)]
    rows = [(i, " ".join(sum((lines[k] for k in range(40) if rng.random() < (k + 1) / 80 * (1 + (i > 300))), text(9)))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(3)
    mask = s.mask_of(2)
    each = [c for _, c, _ in s.seeds(*s.text_buffer(s.pa.array([t for _, t in rows])), mask)]
    code, n = np.unique(np.concatenate(each), return_counts=True)
    found, most = s.common_seeds(s.prepared(docs), len(rows), mask)
    assert set(code[n >= 30].tolist()) <= set(found.tolist()) <= set(code[n >= 15].tolist()) and 30 < n.max()
    assert most >= n[np.isin(code, found)].sum()


def test_blocks_of_documents_in_order():
    rng = np.random.default_rng(8)
    docs, rows = rng.integers(-3, 4, 200), rng.permutation(200)
    order = np.lexsort((rows, docs))
    starts = docs[order][::23], rows[order][::23]
    assert (s.block_of(starts, docs, rows)[order] == np.arange(200) // 23).all()
    assert s.block_of((starts[0][3:], starts[1][3:]), docs, rows)[order[0]] == 0
