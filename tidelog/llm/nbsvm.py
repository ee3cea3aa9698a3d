"""Quality classifier: naive Bayes features in a linear support vector machine.

A text is the set of its hashed byte n-grams, case kept, and of one pattern of word
bigrams: a word and then the same word again, whichever it is, marked by how large a
share of the words it makes, in powers of two. Each indicator is scaled by the log ratio
of its counts in the two classes, each row to length one, and a linear model with hinge
loss is fitted by dual coordinate descent. Platt's sigmoid, fitted on rows that the
descent did not see, turns margins into scores.

The model is fitted on at most about SAMPLE_ROWS labelled rows, chosen by a hash, of any
length: executors make their indicators, of which a row has at most 8 KB. A text of any
length is read whole, and its indicators don't depend on how it is cut for that.

Defined results: a null or empty text has no n-grams and gets the score of the bias
alone; without labels of both classes every score is the share of label 1 (1 without
any); labels repeated for one id count each; repeated rows are scored alike; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import bytesops
from tidelog.llm.common import arrow_schema, crc_mod, documents, frugal, only, small_batches, spans_of, text_buffer
from tidelog.llm.labels import labelled

BITS = 16
WIDTHS = (1, 2, 3, 4)
#: Shares of repeated words that are told apart, halving from all of them.
SHARES = 13
SIZE = (1 << BITS) + SHARES
SAMPLE_ROWS = 8000
THRESHOLD = 0.7
HELD_OUT_MODULUS, HELD_OUT_REST = 4, 2
CHUNK = 1 << 18
ROWS = 64


class Model(NamedTuple):
    weights: np.ndarray  # class log-count ratio times the machine's weight, per indicator
    ratio: np.ndarray
    bias: float
    slope: float
    shift: float


def indicators(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted indicator numbers) of every row, in order."""
    for a, b in spans_of(offsets, CHUNK):
        for c in range(a, b, ROWS):
            d = min(b, c + ROWS)
            flags = np.zeros((d - c, SIZE), bool)
            long = d - c == 1 and offsets[d] - offsets[c] > CHUNK
            step = CHUNK if long else int(offsets[d] - offsets[c]) or 1
            for at in range(int(offsets[c]), int(offsets[d]), step):
                stop = min(at + step + max(WIDTHS) - 1, int(offsets[d]))
                edges = np.array([at, stop]) if long else offsets[c : d + 1]
                buf = data[edges[0] : edges[-1]]
                for width in WIDTHS:
                    row, bucket = bytesops.grams(buf, edges - edges[0], width, BITS)
                    flags[row, bucket] = True
            again, words = repeats(data, offsets[c : d + 1])
            spoken = np.flatnonzero(words > 0)
            share = np.maximum(again[spoken] / words[spoken], 0.5 ** (SHARES - 1))
            flags[spoken, (1 << BITS) + np.floor(-np.log2(share) + 1e-9).astype(int)] = True
            for i in range(d - c):
                yield c + i, np.flatnonzero(flags[i])


def repeats(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bigrams of each row whose words are equal, and all words."""
    words, rows = bytesops.words_of(data, offsets), len(offsets) - 1
    same = (words.code[1:] == words.code[:-1]) & (words.doc[1:] == words.doc[:-1])
    return np.bincount(words.doc[1:][same], minlength=rows), np.bincount(words.doc, minlength=rows)


def packed(row: np.ndarray) -> bytes:
    """A row's indicators in at most SIZE bits: listed, or as a bitmap if they are many."""
    if 4 * len(row) < SIZE // 8:
        return row.astype("<u4").tobytes()
    bits = np.zeros(SIZE, bool)
    bits[row] = True
    return np.packbits(bits).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) == (SIZE + 7) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))[:SIZE])
    return np.frombuffer(raw, "<u4")


def descend(rows: list[bytes], ratio: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 20) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for hinge loss over packed rows. The last component is
    the bias, whose input is one. Rows are scaled to length one before it."""
    w, bias = np.zeros(len(ratio)), 0.0
    scale = [1 / max(np.linalg.norm(ratio[unpacked(raw)]), 1e-12) for raw in rows]
    alpha, order = np.zeros(len(rows)), np.random.default_rng(7)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = unpacked(rows[i])
            v = ratio[r] * scale[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / 2.0, 0.0), cost[i])  # the row's square length is 2
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits best, by Newton's method on smoothed
    targets; the slope stays positive, so scores keep the margins' order."""
    n1, n0 = weight[y > 0].sum(), weight[y <= 0].sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[h @ margin**2 + 1e-3, h @ margin], [h @ margin, h.sum() + 1e-3]])
        step = np.linalg.solve(hess, [g @ margin + 1e-3 * (a - 1), g.sum()])
        a, b = max(a - step[0], 0.05), b - step[1]
        if abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def train(rows: list[bytes], y: np.ndarray, weight: np.ndarray) -> Model:
    """rows: packed indicators; y: 1 or 0 for each row; weight: how often it counts."""
    if not len(y) or y.min() == y.max():
        p = float(y[0]) if len(y) else 1.0
        return Model(np.zeros(SIZE), np.zeros(SIZE), 0.0, 1.0, 30.0 if p else -30.0)
    sums = np.ones((2, SIZE))
    for r, k, n in zip(rows, y, weight):
        sums[k, unpacked(r)] += n
    ratio = np.log(sums[1] / sums[1].sum()) - np.log(sums[0] / sums[0].sum())
    sign = np.where(y > 0, 1.0, -1.0)
    share = weight[y > 0].sum() / weight.sum()
    cost = weight * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    apart = np.arange(len(rows)) % 5 == 0  # for the sigmoid
    fit = np.flatnonzero(~apart)
    w, bias = descend([rows[i] for i in fit], ratio, sign[fit], cost[fit])
    weights = w * ratio
    margin = np.array([margin_of(unpacked(rows[i]), weights, ratio, bias) for i in np.flatnonzero(apart)])
    slope, shift = platt(margin, sign[apart], weight[apart])
    return Model(weights, ratio, bias, slope, shift)


def margin_of(row: np.ndarray, weights: np.ndarray, ratio: np.ndarray, bias: float) -> float:
    return float(weights[row].sum() / max(np.linalg.norm(ratio[row]), 1e-12)) + bias if len(row) else bias


def fit(rows: DataFrame) -> Model:
    """The model of (text, n0, n1) rows, which the caller has bounded."""
    small_batches(rows.sparkSession)
    schema = "found binary, n0 long, n1 long"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [packed(r) for _, r in indicators(*text_buffer(batch.column(0)))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], schema=out)

    table = rows.select("text", "n0", "n1").mapInArrow(frugal(run), schema).toArrow()
    found = sorted((raw, y, n) for y, name in enumerate(("n0", "n1")) for raw, n in zip(table["found"].to_pylist(), table[name].to_pylist()) if n)
    order = np.random.default_rng(3).permutation(len(found))
    return train([found[i][0] for i in order], np.array([found[i][1] for i in order], int), np.array([found[i][2] for i in order], float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        square = model.ratio**2
        for batch in batches:
            margin = np.full(batch.num_rows, model.bias)
            for i, row in indicators(*text_buffer(batch.column(1))):
                if len(row):
                    margin[i] += model.weights[row].sum() / max(np.sqrt(square[row].sum()), 1e-12)
            value = 1 / (1 + np.exp(-np.clip(model.slope * margin + model.shift, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value)], schema=out)

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(frugal(run), schema)


def held_out() -> F.Column:
    return crc_mod("doc_id", HELD_OUT_MODULUS) == HELD_OUT_REST


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    rows, _ = labelled(docs, only(labels, "doc_id", "quality").where(~held_out()), "quality", SAMPLE_ROWS, "nbsvm")
    model = fit(rows)
    out = score(docs, model)
    return out.withColumn("held_out", held_out()).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
ORACLE: dict[str, str] = {}
