"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features: densities of a fixed and of a learned lexicon, their hits near a second-person
pronoun, hits that show only after obfuscation is undone, capitals, punctuation, symbols,
digits inside words, repeated characters and length. The learned lexicon holds words
whose share of toxic texts far exceeds that of others. The labelled sample is dealt to
folds; a row's features come from the lexicon of the other folds, trees grow on all
folds but one and the calibration on that one, so no row is judged by what it taught.

The model is fitted on at most about SAMPLE_ROWS labelled rows of each label, chosen by
a hash, of any length: executors count their words and make their features, so texts
never reach the driver. Scores read every text whole.

Defined results: a null or empty text has zero in all features and is scored like any
other; without labels of both classes every score is the share of label 1 (0 without
any); labels repeated for one id count each; repeated rows are scored alike; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bytesops
from tidelog.llm.common import arrow_schema, crc_mod, documents, frugal, only, small_batches, spans_of, staged, text_buffer
from tidelog.llm.labels import labelled

SAMPLE_ROWS = 6000
HELD_OUT_MODULUS = 5
THRESHOLD = 0.5
FOLDS = 4
CHUNK = 1 << 20
NEAR_WORDS = 5
#: A learned word occurs in so many toxic texts at least, and in so many times their share of others.
LEARNED_TEXTS, LEARNED_RATIO = 4, 6.0
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15

# Common insults and second-person pronouns.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash garbage worthless pathetic disgusting scum clown fool "
    "imbecile jerk bastard bitch crap shit fuck fucking asshole retard ugly filthy vermin hate kill die "
    "dummkopf arschloch idioten scheisse scheiße versager abschaum con connard salope merde ordure imbécile débile "
    "idiota estúpido imbécil basura mierda puta cabrón asqueroso tonto"
)
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus vosotros"

NAMES = (
    "insults", "learned", "learned_log", "learned_weight", "learned_most", "insults_log", "near_you", "hidden", "capitals", "punctuation",
    "exclamations", "symbols", "mixed_words", "repeats", "words_log", "you",
)

#: Digits and signs that stand in for letters.
PLAIN = bytesops.LOWER.copy()
PLAIN[np.frombuffer(b"013457@$", np.uint8)] = np.frombuffer(b"oieastas", np.uint8)
NOT_PLAIN = bytesops.NOT_ALNUM.copy()
NOT_PLAIN[np.frombuffer(b"@$", np.uint8)] = False


def _class_table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


UPPER = _class_table(bytes(range(65, 91)))
LETTER = _class_table(bytes([*range(65, 91), *range(97, 123)])) | (np.arange(256) >= 128)
DIGIT = _class_table(b"0123456789")
PUNCTUATION = _class_table(b".,;:!?'\"-()")
SYMBOL = _class_table(b"#*$%&|<>@^~_=+/\\")


class Lexicon(NamedTuple):
    code: np.ndarray  # sorted
    weight: np.ndarray


class Tree(NamedTuple):
    feature: np.ndarray  # of each inner node of a full tree, in level order
    threshold: np.ndarray
    leaf: np.ndarray


class Model(NamedTuple):
    lexicon: Lexicon
    base: float
    trees: list[Tree]
    knots: np.ndarray  # of the calibration
    values: np.ndarray


@functools.cache
def fixed(words: str) -> np.ndarray:
    return np.sort(np.array([bytesops.code_of(w) for w in words.split()], np.uint64))


def find(sorted_codes: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code is listed, and where."""
    if not len(sorted_codes):
        return np.zeros(len(codes), bool), np.zeros(len(codes), np.int64)
    at = np.minimum(np.searchsorted(sorted_codes, codes), len(sorted_codes) - 1)
    return sorted_codes[at] == codes, at


def byte_sums(buf: np.ndarray, edges: np.ndarray, flag: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(flag, out=sums[1:])
    return sums[edges[1:]] - sums[edges[:-1]]


def chunk_features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon, insults: np.ndarray, second: np.ndarray) -> np.ndarray:
    edges, buf = offsets - offsets[0], data[offsets[0] : offsets[-1]]
    rows = len(edges) - 1
    words = bytesops.words_of(data, offsets, bytesops.NOT_ALNUM)
    per_row = lambda w=None, doc=words.doc: np.bincount(doc, weights=w, minlength=rows)
    n = per_row()
    insult, _ = find(insults, words.code)
    learned, at = find(lexicon.code, words.code)
    weight = np.where(learned, lexicon.weight[at], 0.0) if len(lexicon.code) else np.zeros(len(words.code))
    you, _ = find(second, words.code)
    hit = insult | learned
    place = np.flatnonzero(you)
    near = np.zeros(len(hit), bool)
    if len(place):
        for side in (np.searchsorted(place, np.arange(len(hit))), np.searchsorted(place, np.arange(len(hit))) - 1):
            p = place[np.clip(side, 0, len(place) - 1)]
            near |= (np.abs(p - np.arange(len(hit))) <= NEAR_WORDS) & (words.doc[p] == words.doc)
    starts, ends = bytesops.spans(buf, edges, NOT_PLAIN)
    shown = bytesops.codes(buf, starts, ends, PLAIN)
    shown_doc = np.searchsorted(edges, starts, side="right") - 1
    shown_hit = find(insults, shown)[0] | find(lexicon.code, shown)[0]
    hidden = np.maximum(np.bincount(shown_doc, weights=shown_hit, minlength=rows) - per_row(hit), 0)
    digit, letter = DIGIT[buf], LETTER[buf]
    crossing = np.zeros(len(buf), bool)
    crossing[1:] = (digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])
    same = np.zeros(len(buf), bool)
    same[2:] = (buf[2:] == buf[1:-1]) & (buf[1:-1] == buf[:-2]) & letter[2:]
    most = np.zeros(rows)
    np.maximum.at(most, words.doc, weight)
    size, count = np.maximum(np.diff(edges), 1), np.maximum(n, 1)
    letters = np.maximum(byte_sums(buf, edges, letter), 1)
    columns = [
        per_row(insult) / count, per_row(learned) / count, np.log1p(per_row(learned)), per_row(weight) / count, most, np.log1p(per_row(insult)),
        per_row(hit & near) / count, hidden / count, byte_sums(buf, edges, UPPER[buf]) / letters, byte_sums(buf, edges, PUNCTUATION[buf]) / size,
        byte_sums(buf, edges, buf == ord("!")) / size, byte_sums(buf, edges, SYMBOL[buf]) / size, byte_sums(buf, edges, crossing) / count,
        byte_sums(buf, edges, same) / size, np.log1p(n), per_row(you) / count,
    ]
    return np.column_stack(columns)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of NAMES for each text."""
    insults, second = fixed(INSULTS), fixed(SECOND_PERSON)
    parts = [chunk_features(data, offsets[a : b + 1], lexicon, insults, second) for a, b in spans_of(offsets, CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, len(NAMES)))


def learn_lexicon(code: np.ndarray, toxic: np.ndarray, other: np.ndarray, n1: int, n0: int) -> Lexicon:
    """code: sorted words; toxic, other: how many of the n1 and n0 texts have them."""
    ratio = ((toxic + 0.1) / max(n1, 1)) / ((other + 0.5) / max(n0, 1))
    keep = (toxic >= max(LEARNED_TEXTS, 0.002 * n1)) & (ratio >= LEARNED_RATIO)
    return Lexicon(code[keep], np.log(ratio[keep]))


def grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, cuts: np.ndarray) -> tuple[Tree, np.ndarray]:
    """A full tree of DEPTH by second-order gain over binned features, and each row's leaf.
    x: bin numbers; cuts: the upper bound of each bin of each feature."""
    inner = (1 << DEPTH) - 1
    feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
    node = np.zeros(len(x), int)
    for level in range(DEPTH):
        first = (1 << level) - 1
        for at in range(first, 2 * first + 1):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            if len(rows) >= 10:
                g_all, h_all = gradient[rows].sum(), hessian[rows].sum()
                for f in range(x.shape[1]):
                    g = np.cumsum(np.bincount(x[rows, f], gradient[rows], BINS))[:-1]
                    h = np.cumsum(np.bincount(x[rows, f], hessian[rows], BINS))[:-1]
                    gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                    gain[(h < 1) | (h_all - h < 1)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best:
                        best, feature[at], threshold[at] = gain[k], f, cuts[f, k]
                        right = x[rows, f] > k
                if best > 1e-6:
                    node[rows] = 2 * at + 1 + right
                    continue
            node[rows] = 2 * at + 1
    leaf_of = node - inner
    g, h = np.bincount(leaf_of, gradient, 1 << DEPTH), np.bincount(leaf_of, hessian, 1 << DEPTH)
    return Tree(feature, threshold, -RATE * g / (h + 1)), leaf_of


def apply_tree(tree: Tree, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), int)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), tree.feature[node]] > tree.threshold[node])
    return tree.leaf[node - len(tree.feature)]


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[Tree]]:
    """Logistic loss; x holds raw features."""
    grid = np.quantile(x, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    cuts = np.concatenate([grid, np.full((x.shape[1], 1), np.inf)], axis=1)
    binned = np.stack([np.searchsorted(grid[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    p = np.average(y, weights=weight)
    base = float(np.log(p / (1 - p)))
    margin, trees = np.full(len(y), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        tree, leaf_of = grow(binned, weight * (p - y), weight * np.maximum(p * (1 - p), 1e-9), cuts)
        trees.append(tree)
        margin += tree.leaf[leaf_of]
    return base, trees


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (knots, values), to be joined by straight lines."""
    level, at = np.unique(margin, return_inverse=True)
    total, mass = np.bincount(at, y * weight), np.bincount(at, weight)
    blocks: list[list[float]] = []  # low, high, sum, weight
    for m, t, w in zip(level, total, mass):
        blocks.append([m, m, t, w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, s, n = blocks.pop()
            blocks[-1][1], blocks[-1][2], blocks[-1][3] = high, blocks[-1][2] + s, blocks[-1][3] + n
    knots = [k for b in blocks for k in (b[0], b[1])]
    return np.array(knots), np.array([b[2] / b[3] for b in blocks for _ in range(2)])


def raw_score(model: Model, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model.base)
    for tree in model.trees:
        out += apply_tree(tree, x)
    return out


def calibrated(model: Model, x: np.ndarray) -> np.ndarray:
    return np.clip(np.interp(raw_score(model, x), model.knots, model.values), 0.0, 1.0)


def constant(p: float) -> Model:
    return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), 0.0, [], np.array([0.0]), np.array([p]))


def dealt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """The fold of each sampled row; each fold gets its share of both labels."""
    out = np.zeros(len(n0), int)
    for rows in (np.flatnonzero(n1 == 0), np.flatnonzero(n1 > 0)):
        out[rows] = np.arange(len(rows)) % FOLDS
    return out


def word_counts(rows: DataFrame, fold: dict[int, int], n0: list[int], n1: list[int]) -> pa.Table:
    """(code, t0, t1, ..., o0, o1, ...): how many toxic and other texts of each fold have
    a word, of the words that some lexicon without one fold, or of all, may hold."""
    schema = "code long, fold int, toxic long, other long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            own = np.array([fold[r] for r in batch.column(0).to_pylist()], np.int64)
            other, toxic = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for a, b in spans_of(offsets, CHUNK):
                words = bytesops.words_of(data, offsets[a : b + 1], bytesops.NOT_ALNUM)
                order = np.lexsort((words.doc, words.code))
                code, doc = words.code[order], words.doc[order] + a
                fresh = np.ones(len(code), bool)
                fresh[1:] = (code[1:] != code[:-1]) | (doc[1:] != doc[:-1])
                code, doc = code[fresh], doc[fresh]
                place, at = np.unique(np.stack([code, own[doc].astype(np.uint64)]), axis=1, return_inverse=True)
                columns = [pa.array(place[0].view(np.int64)), pa.array(place[1].astype(np.int32)), *(pa.array(np.bincount(at.ravel(), n[doc], place.shape[1]).astype(np.int64)) for n in (toxic, other))]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    each = [F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c[0]}{k}") for c in ("toxic", "other") for k in range(FOLDS)]
    found = rows.select("row", "text", "n0", "n1").mapInArrow(frugal(run), schema).groupBy("code").agg(*each)
    total = {c: sum(F.col(f"{c}{k}") for k in range(FOLDS)) for c in "to"}
    may = F.lit(False)
    for k in (None, *range(FOLDS)):
        t, o = (total[c] - (0 if k is None else F.col(f"{c}{k}")) for c in "to")
        m1, m0 = (max(sum(n) - (0 if k is None else n[k]), 1) for n in (n1, n0))
        may |= (t >= max(LEARNED_TEXTS, 0.002 * m1)) & ((t + 0.1) / m1 >= 0.999 * LEARNED_RATIO * (o + 0.5) / m0)
    return found.where(may).toArrow()


def fold_lexicons(rows: DataFrame, fold: dict[int, int], n0: list[int], n1: list[int]) -> list[Lexicon]:
    """For each fold the lexicon of the others, and at last that of all."""
    table = word_counts(rows, fold, n0, n1)
    code = table["code"].to_numpy().view(np.uint64)
    order = np.argsort(code)
    toxic, other = (np.array([table[f"{c}{k}"].to_numpy()[order] for k in range(FOLDS)]).reshape(FOLDS, -1) for c in "to")
    out = [learn_lexicon(code[order], toxic.sum(0) - toxic[k], other.sum(0) - other[k], sum(n1) - n1[k], sum(n0) - n0[k]) for k in range(FOLDS)]
    return [*out, learn_lexicon(code[order], toxic.sum(0), other.sum(0), sum(n1), sum(n0))]


def fold_features(rows: DataFrame, fold: dict[int, int], lexicons: list[Lexicon]) -> dict[int, np.ndarray]:
    """The features of each sampled row, by the lexicon of the other folds."""
    schema = "row long, x array<double>"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            x = [features(data, offsets[i : i + 2], lexicons[fold[r]])[0] for i, r in enumerate(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], schema=out)

    table = rows.select("row", "text").mapInArrow(frugal(run), schema).toArrow()
    return dict(zip(table["row"].to_pylist(), np.array(table["x"].to_pylist()).reshape(-1, len(NAMES))))


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, part: np.ndarray, lexicon: Lexicon) -> Model:
    """weight: how many rows of the corpus a row stands for; part: its fold. Trees grow
    on all folds but the first, the calibration on that one."""
    fit = part > 0
    base, trees = boost(x[fit], y[fit], weight[fit])
    model = Model(lexicon, base, trees, np.array([0.0]), np.array([0.0]))
    knots, values = isotonic(raw_score(model, x[~fit]), y[~fit].astype(float), weight[~fit])
    return model._replace(knots=knots, values=values)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded number of labelled documents."""
    small_batches(docs.sparkSession)
    sampled, share = labelled(docs, labels, "toxic", SAMPLE_ROWS, "toxicity", each=True)
    rows = staged(sampled, "labelled")
    known = rows.select("row", "n0", "n1").orderBy(F.xxhash64("row"), "row").toArrow()
    n0, n1 = known["n0"].to_numpy(), known["n1"].to_numpy()
    mass0, mass1 = n0.sum() / share.get(0, 1.0), n1.sum() / share.get(1, 1.0)
    if len(n0) < 6 or not mass0 or not mass1:
        return constant(mass1 / (mass0 + mass1) if len(n0) else 0.0)
    part, ids = dealt(n0, n1), known["row"].to_pylist()
    fold = dict(zip(ids, part.tolist()))
    sums = [[int(n[part == k].sum()) for k in range(FOLDS)] for n in (n0, n1)]
    lexicons = fold_lexicons(rows, fold, *sums)
    by_row = fold_features(rows, fold, lexicons)
    place = np.concatenate([np.flatnonzero(n0), np.flatnonzero(n1)])
    y = np.repeat([0, 1], [(n0 > 0).sum(), (n1 > 0).sum()])
    weight = np.where(y > 0, n1[place] / share.get(1, 1.0), n0[place] / share.get(0, 1.0))
    x = np.array([by_row[r] for r in ids])[place]
    if len({0, 1} & set(y[part[place] > 0].tolist())) < 2 or not (part[place] == 0).any():
        return constant(mass1 / (mass0 + mass1))
    return train(x, y, weight, part[place], lexicons[-1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = calibrated(model, features(*text_buffer(batch.column(1)), model.lexicon))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], schema=out)

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)


def held_out() -> F.Column:
    return crc_mod("doc_id", HELD_OUT_MODULUS) == 0


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, only(labels, "doc_id", "toxic").where(~held_out()))
    out = score(docs, model)
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
