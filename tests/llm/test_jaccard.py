"""Components against all pairs compared, on planted copies, chains and edge rows."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import graph, jaccard, packed_rows


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def planted(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    line = " ".join(word() for _ in range(30))
    texts = []
    for _ in range(25):
        texts.append(" ".join(word() for _ in range(rng.choice([1, 3, 5, 6, 40, 200]))))
    for _ in range(12):  # unrelated texts that share a passage
        texts.append(line + " " + " ".join(word() for _ in range(rng.choice([2, 8, 50]))))
    base = [word() for _ in range(120)]
    for _ in range(25):  # near copies at many distances
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = word()
        texts.append(" ".join(own))
    chain = [word() for _ in range(100)]
    for i in range(15):  # a chain: only neighbours are similar
        texts.append(" ".join(chain))
        chain = chain[6:] + [word() for _ in range(6)]
    texts += rng.choices(texts, k=15) + [t.upper().replace(" ", "\n\t") for t in rng.choices(texts, k=5)]
    rng.shuffle(texts)
    return [(i * 3, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed, tune", [(1, {}), (2, {"PIVOTS": 0, "COMMON_COUNT": 1000}), (3, {"COMMON_COUNT": 2, "VERIFY_COST": 1e6}), (4, {"PIVOTS": 0, "BLOCK_CLASSES": 2}), (5, {"PIVOTS": 1, "BLOCK_CLASSES": 3}), (6, {"PART_SHINGLES": 20})])
def test_components(spark, monkeypatch, seed, tune):
    for name, value in tune.items():
        monkeypatch.setattr(jaccard, name, value)
    if seed == 3:
        monkeypatch.setattr(graph, "TASK_LINKS", 0)
    if seed == 6:
        monkeypatch.setattr(packed_rows, "COARSE_BITS", 2)
        monkeypatch.setattr(packed_rows, "ITEMS", 500)
    rows = planted(seed)
    rows += [(900, None), (901, ""), (902, " \n"), (903, None), (6, rows[2][1]), (6, rows[2][1]), (None, rows[5][1]), (None, "q w e r t y"), (950, "z " * 30_000)]
    docs = spark.createDataFrame([(*r, 1, b"") for r in rows], "doc_id long, text string, key int, common binary")
    got = jaccard.groups(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert all(r.doc_id == r.component_id for r in got if r.kept)


def test_one_of_each_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f g", 1), (1, "A b c d e f g", 2), (3, "a b", 3), (4, None, 4)], "doc_id long, text string, row int")
    assert sorted(map(tuple, jaccard.one_of_each(docs).collect())) == [(1, "A b c d e f g", 2), (3, "a b", 3), (4, None, 4)]
    assert jaccard.groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bound", [0, 500_000])
def test_components_of_a_graph(spark, monkeypatch, bound):
    monkeypatch.setattr(graph, "TASK_LINKS", bound)
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, i) for i in range(201, 240)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert all(root[x] == got.get(x, x) for x in root)


def test_match_length_follows_cost():
    rare, frequent = np.full(60, 2, np.uint32), np.full(60, 5000, np.uint32)
    assert 1 <= jaccard.choose_match(rare, 10, 51) <= 8 and jaccard.choose_match(rare, 10, 2) <= 2
    assert jaccard.choose_match(np.concatenate([rare[:10], frequent]), 10, 61) < jaccard.choose_match(frequent, 10, 51)
    assert jaccard.choose_match(frequent, -5, 40) == 1


def test_pages_of_one_template(spark):
    """Most pairs are near misses: the words that vary decide."""
    rng = random.Random(7)
    fixed, pool = [f"w{i}" for i in range(170)], [f"v{i}" for i in range(60)]
    rows = []
    for i in range(400):
        own = [rng.choice(pool) for _ in range(20)]
        if i % 9 == 0 and rows:  # some are near copies of one before
            own = rows[rng.randrange(len(rows))][1].split()[100:120]
            own[rng.randrange(20)] = "other"
        rows.append((i, " ".join(fixed[:100] + own + fixed[100:])))
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)
    assert 20 < sum(r.doc_id != r.component_id for r in got) < 200


def test_reach_of_a_posting_holds_all_pairs():
    """What two prefixes share, by the rule that bounds a partner's size, is enough."""
    rng = random.Random(3)
    for _ in range(300):
        n, m = sorted((rng.randint(5, 60), rng.randint(5, 60)))
        need = jaccard.needed_of(n, m)
        assert 100 * need >= 80 * (n + m - need) and 100 * (need - 1) < 80 * (n + m - need + 1)
        if need > n:
            continue
        both = set(rng.sample(range(100), need))
        a = sorted(both | set(rng.sample(range(100, 300), n - need)), key=lambda x: (x * 37) % 301)
        b = sorted(both | set(rng.sample(range(300, 500), m - need)), key=lambda x: (x * 37) % 301)
        match = {id(a): rng.randint(1, min(8, need)), id(b): rng.randint(1, min(8, need))}
        reach = lambda x, p: (180 * (len(x) - p + match[id(x)] - 1)) // 80 - len(x)
        shared = [c for c in both if reach(a, a.index(c)) >= m and reach(b, b.index(c)) >= n]
        assert len(shared) >= min(match.values())
